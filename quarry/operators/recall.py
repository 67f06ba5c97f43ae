"""Prompt-time recall: at most three earlier turns worth showing with a prompt, and curated facts not shown yet."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import index, search

MIN_PROMPT = 8
MIN_TERMS = 2
MAX_REQUIRED = 3
MAX_MATCH_TERMS = 12
CANDIDATES = 30
FLOOR = 1.6
RECENCY = 0.15
MAX_SCALE = 10.0
HALF_LIFE = 30.0
MAX_LINES = 3
MAX_FACTS = 2
RARE_DF = 5
INDEX_LINES = 200


@dataclass
class Prompt:
    """What a prompt asks for: all distinctive terms, and the capped list that is matched."""

    terms: list[str]
    match: list[str] = field(default_factory=list)

    @property
    def required(self) -> int:
        return min(max(MIN_TERMS, len(self.terms) // 5), MAX_REQUIRED)


def read_prompt(spark, text: str) -> Prompt | None:
    """None where a prompt says too little."""
    if len(text.strip()) < MIN_PROMPT:
        return None
    p = F.lit(text)
    terms, match = spark.range(1).select(T.extract_terms(p), match_terms(T.extract_terms(p))).first()
    return Prompt(terms, match) if len(terms) >= MIN_TERMS else None


def match_terms(terms: Column, most: int = MAX_MATCH_TERMS) -> Column:
    """All terms, or of more than ``most`` the first by: anchors first, longer ones first, as they came."""

    def cut(ts: Column) -> Column:
        keyed = F.transform(ts, lambda t, i: F.struct((~T.is_anchor(t)).alias("a"), (-F.octet_length(t)).alias("n"), i.alias("i"), t.alias("t")))
        return F.when(F.size(ts) <= most, ts).otherwise(F.transform(F.slice(F.sort_array(keyed), 1, most), lambda x: x["t"]))

    return T.bind(terms, cut)


def _has(tokens, term: str):
    return F.exists(tokens, lambda x: T.token_matches_loose(x, F.lit(term)))


def _elsewhere(project: str, live: str | None) -> Column:
    where = F.col("project") == project
    return where if live is None else where & (F.col("session_id") != live)


def candidates(turns: DataFrame, prompt: Prompt, project: str, live: str | None = None, tokenizer=T.index_tokens) -> DataFrame:
    """The best matches in the project, of other sessions, with ``n_matched`` of all terms and whether an anchor is among them."""
    best = search.match_scores(turns, prompt.match, any_of=True, tokenizer=tokenizer, where=_elsewhere(project, live))
    return _judged(best.orderBy("score", "session_id", "seq").limit(CANDIDATES), prompt)


def indexed_candidates(spark, folder: str, prompt: Prompt, project: str, live: str | None = None, tokenizer=T.index_tokens) -> DataFrame:
    """``candidates`` from a stored index of turns: postings of the terms, then ids and projects of the rows, then the texts of the best alone."""
    r = index.Reader(spark, folder, tokenizer)
    s = index.match_scores(spark, folder, prompt.match, any_of=True, tokenizer=tokenizer, version=r.m["version"])
    ids = r.rows().where(_elsewhere(project, live)).select("rid", "session_id", "seq")
    best = ids.join(s, "rid").orderBy("score", "session_id", "seq").limit(CANDIDATES).select("rid", "score").collect()  # CANDIDATES rows at most
    scores = spark.createDataFrame([tuple(x) for x in best], "rid long, score double")
    return _judged(r.look_up(scores, [x["rid"] for x in best]).drop("rid"), prompt)


def _judged(best: DataFrame, prompt: Prompt) -> DataFrame:
    toks = T.turn_tokens(F.lower("text"))
    hit = [_has(toks, t.lower()) for t in prompt.terms]
    n = reduce(lambda a, b: a + b, [h.cast("int") for h in hit])
    anchor = reduce(lambda a, b: a | b, [h & T.is_anchor(F.lit(t)) for h, t in zip(hit, prompt.terms)])
    return best.withColumns({"n_matched": n, "anchored": anchor})


def run(turns: DataFrame, prompt_text: str, project: str, now: str, live: str | None = None, seen: DataFrame | None = None, shown_facts: int = 0, tokenizer=T.index_tokens, ahead: bool = False) -> DataFrame:
    """(session_id, seq, ts, text, score, rank): the lines to show; empty to stay silent. ``now`` is an ISO time.

    Turns from after ``now`` count as just written, or with ``ahead`` as ever newer, so their bonus grows with the distance.
    """
    prompt = read_prompt(turns.sparkSession, prompt_text)
    if prompt is None:
        return _silent(turns)
    return _lines(candidates(turns, prompt, project, live, tokenizer), prompt, now, seen, shown_facts, ahead)


def run_indexed(spark, folder: str, prompt_text: str, project: str, now: str, live: str | None = None, seen: DataFrame | None = None, shown_facts: int = 0, tokenizer=T.index_tokens, ahead: bool = False) -> DataFrame:
    """``run`` from a stored index of turns; no text is read but those of the best ``CANDIDATES`` rows."""
    prompt = read_prompt(spark, prompt_text)
    if prompt is None:
        return _silent(index.rows(spark, folder))
    return _lines(indexed_candidates(spark, folder, prompt, project, live, tokenizer), prompt, now, seen, shown_facts, ahead)


def _silent(turns: DataFrame) -> DataFrame:
    return turns.where(F.lit(False)).select("session_id", "seq", "ts", "text", F.lit(0.0).alias("score"), F.lit(0.0).alias("rank"))


def _lines(c: DataFrame, prompt: Prompt, now: str, seen: DataFrame | None, shown_facts: int, ahead: bool = False) -> DataFrame:
    c = c.where((F.col("n_matched") >= prompt.required) & F.col("anchored"))
    everything = Window.partitionBy()  # CANDIDATES rows at most
    c = c.withColumn("best", F.min("score").over(everything)).where((F.col("best") >= 0) | (F.col("score") <= F.col("best") / FLOOR))
    age = F.unix_timestamp(F.try_to_timestamp(F.lit(now))) - F.unix_timestamp(F.try_to_timestamp("ts"))
    age = (age if ahead else F.greatest(F.lit(0), age)) / 86400.0
    bonus = RECENCY * F.least(F.abs("best"), F.lit(MAX_SCALE)) * F.coalesce(F.pow(F.lit(0.5), age / HALF_LIFE), F.lit(0.0))
    c = c.withColumn("rank", F.col("score") - bonus)
    if seen is not None:
        source = F.concat(F.lit("turn:"), "session_id", F.lit("/"), F.col("seq").cast("string"))
        c = c.withColumn("source", source).join(seen.select("source").distinct(), "source", "left_anti").drop("source")
    w = Window.partitionBy("session_id").orderBy("rank", "seq")
    c = c.withColumn("k", F.row_number().over(w)).where("k = 1")
    return c.orderBy("rank", "session_id").limit(max(0, MAX_LINES - shown_facts)).select("session_id", "seq", "ts", "text", "score", "rank")


def hidden_facts(facts: DataFrame, prompt_text: str, project: str, shown: list[str] = (), tokenizer=T.index_tokens) -> DataFrame:
    """Active facts of the project that match rare terms of the prompt and are not in the visible index (``shown`` leaf paths)."""
    empty = facts.where(F.lit(False)).select("leaf_path", "title", "hook", F.lit(0.0).alias("score"))
    prompt = read_prompt(facts.sparkSession, prompt_text)
    if prompt is None:
        return empty
    terms = list(dict.fromkeys(t.rstrip(".").lower() for t in prompt.match if t.rstrip(".")))
    active = (F.col("project") == project) & (F.col("status") == "active") & F.col("superseded_at").isNull()
    cols = ("title", "hook", "description")
    m = search.match_scores(facts, terms, any_of=True, tokenizer=tokenizer, where=active, text_cols=cols)
    toks = T.turn_tokens(F.lower(F.concat_ws(" ", *cols)))
    names = T.turn_tokens(F.lower(F.concat_ws(" ", "title", "name")))
    m = m.withColumns({f"h{i}": _has(toks, t) for i, t in enumerate(terms)})
    dfs = m.agg(*[F.count_if(F.col(f"h{i}")) for i in range(len(terms))]).first()
    rare = [i for i in range(len(terms)) if 0 < dfs[i] <= RARE_DF]
    if not rare:
        return empty
    n = reduce(lambda a, b: a + b, [F.col(f"h{i}").cast("int") for i in rare])
    named = reduce(lambda a, b: a | b, [F.col(f"h{i}") & _has(names, terms[i]) for i in rare])
    ident = reduce(lambda a, b: a | b, [F.col(f"h{i}") & T.is_identifier(F.lit(terms[i])) for i in rare])
    out = m.where((n >= prompt.required) & named & ident & ~F.col("leaf_path").isin(list(shown)))
    out = out.withColumn("best", F.min("score").over(Window.partitionBy())).where((F.col("best") >= 0) | (F.col("score") <= F.col("best") / FLOOR))
    return out.orderBy("score", "leaf_path").limit(MAX_FACTS).select("leaf_path", "title", T.cap(F.col("hook"), 160).alias("hook"), "score")


def shown_paths(index_lines: DataFrame) -> list[str]:
    """Leaf paths linked in the first INDEX_LINES lines of an index (line_no, value)."""
    d = index_lines.where(F.col("line_no") < INDEX_LINES).select(F.explode(F.regexp_extract_all("value", F.lit(r"\]\(([^)]+)\)"), 1)).alias("p"))
    return [r.p for r in d.distinct().collect()]


SEEN_LINES, SEEN_KEEP, SEEN_BYTES = 4000, 2000, 512 * 1024


def trim_seen(seen: DataFrame, max_lines: int = SEEN_LINES, keep: int = SEEN_KEEP, max_bytes: int = SEEN_BYTES) -> DataFrame:
    """The newest lines of a seen log that has over ``max_lines`` lines or ``max_bytes`` bytes; ``seen`` has a growing ``n``.

    ``keep`` lines at most, and no more than fit in ``max_bytes``.
    """
    size = F.octet_length("session") + F.octet_length("source") + 2
    lines, total = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if lines <= max_lines and total <= max_bytes:
        return seen
    newest = seen.orderBy(F.col("n").desc()).limit(keep)  # one task holds no more than that
    room = F.sum(size).over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return newest.withColumn("_b", room).where(F.col("_b") <= max_bytes).drop("_b")
