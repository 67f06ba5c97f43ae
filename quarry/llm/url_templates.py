"""URL filters: fixed host and path rules first, then a path-template tree.

The tree: a path's segments have their digit runs and hex strings replaced by wildcards, so the
pages of a host fall onto few patterns, which are counted with their labels before anything else. Then,
level by level below each host, first by structure: segments that fewer than RARE pages of a node have are variable and
become {s}, whatever their labels and number. Then by labels: a branch keeps its name if its share of bad labels is
above its siblings' by Z standard deviations, and of the others those that are above or below the rest of them; all shares are Beta posteriors around the overall share with the
weight of PRIOR labels, so a few labels do not set a branch apart. All others are merged into one wildcard branch, however
many there are. A template whose bad share, smoothed by STRENGTH pages at the overall share, is over LIMIT is rejected.

Labels come from a table of (id, quality, toxic); a page is bad where quality is 0 or toxic is 1. Any
number of pages on one host is fine: everything is a sum per pattern, aggregated before the shuffle.

Defined results: a null url or one without "://" has an empty host and path. Segments after DEPTH are one
segment: the tree takes one round a level, and an odd url of thousands of segments must not set their number. Repeated rows
count as often as they appear; repeated labels of an id count once (bad if any is). Pages of no rule and no label are
allowed unless their template is rejected. Empty tables give no row, or no rejection.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (rule, verdict). Fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEPTH = 12
RARE = 3
Z, PRIOR = 1.96, 4.0
STRENGTH = 10.0
LIMIT = 0.5


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    s = F.filter(F.split(path, "/"), lambda x: x != "")
    s = F.transform(s, lambda x: F.when(x.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$") & ~x.rlike("^[0-9]+$"), F.lit("{hex}")).otherwise(F.regexp_replace(x, "[0-9]+", "{n}")))
    return F.when(F.size(s) <= DEPTH, s).otherwise(F.concat(F.slice(s, 1, DEPTH), F.array(F.lit("**"))))


def _posterior(lab: Column, bad: Column, prior: float) -> tuple[Column, Column]:
    """Mean and variance of a share of bad labels after ``lab`` labels."""
    mean = (bad + PRIOR * prior) / (lab + PRIOR)
    return mean, mean * (1 - mean) / (lab + PRIOR + 1)


def _set_apart(c: DataFrame, prior: float, both_ways: bool) -> DataFrame:
    """Branches (host, made, kind, lab, bad, apart) with ``kids`` and those marked that differ from the other unmarked branches of their node."""
    near = c.where("not apart").groupBy("host", "made").agg(F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    kids = c.groupBy("host", "made").agg(F.count(F.lit(1)).alias("kids"))
    d = c.drop("kids").join(kids, ["host", "made"]).join(near, ["host", "made"], "left")
    mine, mine_var = _posterior(F.col("lab"), F.col("bad"), prior)
    rest, rest_var = _posterior(F.col("all_lab") - F.col("lab"), F.col("all_bad") - F.col("bad"), prior)
    gap = F.abs(mine - rest) if both_ways else mine - rest
    differs = gap > Z * F.sqrt(mine_var + rest_var)
    return d.withColumn("apart", F.col("apart") | (F.coalesce(differs, F.lit(False)) & ~F.col("apart"))).drop("all_lab", "all_bad")


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """From (host, segs, labelled, bad): (host, segs, template, n, labelled, bad, score, rejected) per pattern."""
    pats = pages.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("lab"), F.sum("bad").alias("bad"))
    pats = scratch.cut(pats.withColumn("made", F.array().cast("array<string>")), "patterns")
    top = pats.agg(F.max(F.size("segs")), F.sum("lab"), F.sum("bad")).first()
    depth, prior = top[0] or 0, (top[2] or 0) / max(1, top[1] or 0)
    for d in range(depth):
        here = F.get("segs", F.lit(d))
        live = pats.where(here.isNotNull())
        seen = live.groupBy("host", "made", here.alias("seg")).agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        seen = seen.withColumn("kind", F.when((F.col("n") < RARE) & ~F.col("seg").contains("{"), F.lit("{s}")).otherwise(F.col("seg")))
        kinds = seen.groupBy("host", "made", "kind").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        c = kinds.withColumn("apart", F.lit(False))
        for both_ways in (False, True):
            c = _set_apart(c, prior, both_ways)
        name = c.select("host", "made", "kind", F.when((F.col("kids") > 1) & ~F.col("apart"), F.lit("*")).otherwise(F.col("kind")).alias("name"))
        name = seen.select("host", "made", "seg", "kind").join(name, ["host", "made", "kind"]).select("host", "made", "seg", "name")
        pats = scratch.cut(
            pats.withColumn("seg", here).join(name, ["host", "made", "seg"], "left").select(
                "host", "segs", "n", "lab", "bad", F.when(F.col("name").isNull(), F.col("made")).otherwise(F.concat("made", F.array("name"))).alias("made")
            ),
            "level",
        )
    tree = pats.groupBy("host", "made").agg(F.sum("n").alias("t_n"), F.sum("lab").alias("t_lab"), F.sum("bad").alias("t_bad"))
    tree = tree.withColumn("score", (F.col("t_bad") + STRENGTH * prior) / (F.col("t_lab") + STRENGTH))
    return pats.select("host", "segs", "made").join(tree, ["host", "made"]).select(
        "host", "segs", F.concat(F.lit("/"), F.array_join("made", "/")).alias("template"),
        F.col("t_n").alias("n"), F.col("t_lab").alias("labelled"), F.col("t_bad").alias("bad"), "score", (F.col("score") > LIMIT).alias("rejected"),
    )


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, template, score, verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.where(F.coalesce("quality", "toxic").isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max(bad.cast("int")).alias("is_bad"))
    p = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    p = scratch.cut(p.withColumn("segs", segments(F.col("path"))), "pages")
    seen = p.join(marks, "id", "left").select(
        "host", "segs", F.col("is_bad").isNotNull().cast("long").alias("labelled"), F.coalesce("is_bad", F.lit(0)).cast("long").alias("bad")
    )
    t = templates(seen, scratch).select("host", "segs", "template", "score", "rejected")
    rule = matched_rule(F.col("host"), F.col("path"))
    verdicts = F.lit(None).cast("string")
    for r, v in RULES:
        verdicts = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdicts)
    return p.join(t, ["host", "segs"]).withColumn("rule", rule).select(
        F.col("id").alias(id_col), "host", "path", "rule", "template", "score",
        F.coalesce(verdicts, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
