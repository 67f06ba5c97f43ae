"""Session tags: tools, file extensions and topics, derived from a session's text.

Words are counted per (session, word) before anything meets: a session of any length costs its distinct words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import words

# Fixed values.
EXTENSIONS = """
rs go py ts tsx js jsx mjs cjs sh bash zsh sql md mdx toml yaml yml json jsonc tf tfvars hcl c h cpp hpp cc hh cxx java rb php cs swift kt kts scala clj ex
exs erl lua pl pm r jl dart vue svelte css scss sass less html htm xml proto graphql gql ini cfg conf env gradle groovy cmake ps1 psm1 zig nim hs ml
""".split()
CAPS = {"tool": 12, "ext": 8, "topic": 10}


def _ranked(d: DataFrame, ns: str, *order) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1
    return d.withColumn("rank", r).where(F.col("rank") < CAPS[ns]).select("session_id", F.lit(ns).alias("ns"), F.concat(F.lit(f"{ns}:"), "value").alias("tag"), "rank")


def derive(turns: DataFrame) -> DataFrame:
    """(session_id, ns, tag, rank) of every session."""
    d = turns.where((F.coalesce(F.col("is_meta"), F.lit(0)) == 0) & (F.coalesce(F.col("is_sidechain"), F.lit(0)) == 0)).select("session_id", "seq", "text")
    found = lambda pat: F.regexp_extract_all("text", F.lit(pat), 1)
    tools = d.select("session_id", F.explode(F.array_distinct(F.transform(found("⚙ ([A-Za-z0-9_]+)"), lambda x: F.lower(x)))).alias("value")).distinct()
    exts = d.select("session_id", F.explode(F.transform(found(r"\.([A-Za-z0-9]{1,8})"), lambda x: F.lower(x))).alias("value"))
    exts = exts.where(F.col("value").isin(EXTENSIONS)).groupBy("session_id", "value").agg(F.count(F.lit(1)).alias("n"))
    # Frequencies count trimmed words; candidates are untrimmed words, one per lower-case form, with their first casing.
    trim = lambda c: F.regexp_replace(c, "^[._-]+|[._-]+$", "")
    # Dealt out before it is grouped: a grouping before the shuffle would sort all words of a task's rows and give as many.
    per = words.counted(d).repartition("session_id", "low").groupBy("session_id", "low").agg(F.sum("n").alias("n"), F.min(F.struct("seq", "pos", "word")).alias("x"))
    per = per.select("session_id", "n", F.struct("x.seq", "x.pos").alias("first"), F.col("x.word").alias("word"), F.lower(trim(F.col("x.word"))).alias("value"))
    per = per.where((F.col("value") != "") & F.col("value").rlike("[a-z]") & ~F.col("value").startswith("redacted"))
    ok = T.is_distinctive(F.col("word")) & T.is_anchor(trim(F.col("word")))
    cands = per.withColumn("freq", F.sum("n").over(Window.partitionBy("session_id", "value"))).where(ok)
    topics = _ranked(cands, "topic", F.col("freq").desc(), "first", "value")
    # Two spellings may give one topic; the better rank stays and the other leaves a gap.
    topics = topics.groupBy("session_id", "ns", "tag").agg(F.min("rank").alias("rank"))
    return _ranked(tools, "tool", "value").union(_ranked(exts, "ext", F.col("n").desc(), "value")).union(topics)
