"""Terms and sessions related to an anchor term by co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index, search
from quarry.sources.store import Store

MAX_SESSIONS = 300
MAX_TERMS = 1500
MIN_SESSIONS = 2
#: Places of a turn, and what stands for a seq that is null: one less than any.
_WIDTH, _NO_SEQ = 1 << 31, -(1 << 63) - 1


def anchor_sessions(turns: DataFrame, anchor: str, project: str | None = None, tokenizer=T.index_tokens) -> DataFrame:
    """(session_id, ts, seq): the newest sessions that hold the anchor phrase, with their first matching turn."""
    phrases = search.phrases_of(turns, [anchor], tokenizer)
    d = turns if not project else turns.where(search.like_contains(F.col("project"), project))
    if not phrases:
        d = d.where(F.lit(False))
    else:
        if tokenizer is T.index_tokens:
            phrases, tokenizer = search.words_of(d, phrases), T.tokens
        d = d.where(search.phrase_count(tokenizer(F.coalesce("text", F.lit(""))), phrases[0]) > 0)
    first = d.groupBy("session_id").agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"))
    return first.orderBy(F.col("ts").desc_nulls_last(), "session_id").limit(MAX_SESSIONS)


def session_terms(turns: DataFrame, sessions: DataFrame, anchor: str) -> DataFrame:
    """(session_id, low, term): distinctive terms of the sessions, with a letter, none matching a term of the anchor."""
    found = told_apart(distinctive(turns.join(sessions.select("session_id"), "session_id", "left_semi")), anchor)
    return found.groupBy("session_id", "low").agg(F.min(F.struct("place", "term")).alias("x")).select("session_id", "low", "x.term")


def distinctive(turns: DataFrame) -> DataFrame:
    """(session_id, low, place, term): distinctive words with a letter, of turns that are neither meta nor of a side chain; each spelling at its first place.

    A place is seq and position as one number, as its minimum is kept in a hash table, where that of a struct takes a sort of all words.
    What a word is like is asked once a session and spelling.
    """
    d = turns.where(F.coalesce(F.col("is_meta"), F.lit(0)) == 0).where(F.coalesce(F.col("is_sidechain"), F.lit(0)) == 0)
    row = F.coalesce(F.col("seq").cast("decimal(20,0)"), _whole(_NO_SEQ, 20)) * _whole(_WIDTH, 10)
    t = d.select("session_id", row.alias("row"), F.posexplode(T.words(F.coalesce("text", F.lit("")))).alias("pos", "term"))
    t = t.groupBy("session_id", "term").agg(F.min(F.col("row") + F.col("pos")).alias("place")).where(T.is_distinctive(F.col("term")))
    return t.select("session_id", F.lower("term").alias("low"), "place", "term").where(F.col("low").rlike("[a-z]"))


def _whole(x: int, digits: int) -> Column:
    return F.lit(str(x)).cast(f"decimal({digits},0)")


def _seq_and_pos(place: Column) -> tuple[Column, Column]:
    pos = F.pmod(place, _whole(_WIDTH, 10))
    seq = F.when(place >= _whole((_NO_SEQ + 1) * _WIDTH, 38), ((place - pos) / _whole(_WIDTH, 10)).cast("long"))
    return seq, pos.cast("int")


def told_apart(found: DataFrame, anchor: str) -> DataFrame:
    """Words none of which matches a term of the anchor."""
    for a in {anchor.lower(), *(p for p in anchor.lower().split() if p)}:
        found = found.where(~T.token_matches(F.col("low"), F.lit(a)))
    return found


def terms(turns: DataFrame, anchor: str, limit: int = 20, project: str | None = None, tokenizer=T.index_tokens) -> DataFrame:
    """(term, n_sessions, df, score), best first."""
    sessions = anchor_sessions(turns, anchor, project, tokenizer)
    per = session_terms(turns, sessions, anchor)
    cand = candidates(per, tokenizer)
    # Rows per candidate: only the runs of tokens that begin like a candidate leave a row, each once; candidates (MAX_TERMS at most) are broadcast.
    heads: dict[int, set[str]] = {}
    for r in cand.select("toks").collect():
        if r.toks:
            heads.setdefault(len(r.toks), set()).add(r.toks[0])

    def grams(ts: Column) -> Column:
        out = [F.filter(ts, lambda x: x.isin(sorted(heads[1])))] if 1 in heads else [F.array().cast("array<string>")]
        for n in sorted(k for k in heads if k > 1):
            at = F.filter(F.sequence(F.lit(1), F.size(ts)), _starts(ts, sorted(heads[n])))
            out.append(F.transform(at, _run(ts, n)))
        return F.array_distinct(F.concat(*out))

    rows = turns.select(tokenizer(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    hits = rows.select(F.explode(T.bind(F.col("t"), grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    df = cand.where(F.size("toks") > 0).select("low", "gram").join(hits, "gram").select("low", "df")
    return ranked(cand, df, turns.count(), limit)


def candidates(per: DataFrame, tokenizer) -> DataFrame:
    """(low, n_sessions, term, gram, toks): the MAX_TERMS terms of most sessions, with their tokens."""
    cand = per.groupBy("low").agg(F.count(F.lit(1)).alias("n_sessions"), F.min("term").alias("term")).where(F.col("n_sessions") >= MIN_SESSIONS)
    cand = cand.orderBy(F.col("n_sessions").desc(), "low").limit(MAX_TERMS).select("low", "n_sessions", "term", tokenizer(F.col("low")).alias("toks")).collect()
    return per.sparkSession.createDataFrame([(*r[:3], " ".join(r.toks), list(r.toks)) for r in cand], "low string, n_sessions long, term string, gram string, toks array<string>")


def ranked(cand: DataFrame, df: DataFrame, total: int, limit: int) -> DataFrame:
    """Candidates by score, from the rows (low, df) that hold them."""
    eff = F.greatest(F.coalesce("df", F.lit(0)), "n_sessions", F.lit(1))
    score = (1 + F.log(F.col("n_sessions").cast("double"))) * F.greatest(F.lit(0.0), F.log(F.lit(float(total)) / eff))
    out = cand.join(df, "low", "left").select("low", "term", "n_sessions", F.coalesce("df", F.lit(0)).alias("df"), score.alias("score"))
    return out.orderBy(F.col("score").desc(), F.col("n_sessions").desc(), "low").limit(limit)


# The same from stored structures: the index for anchors and frequencies, a forward index from sessions to their terms.

FORWARD = "bucket int, session_id string, low string, term string, seq long, pos int"


def add_to_forward(turns: DataFrame, folder: str, buckets: int = 64) -> int:
    """Write the terms of (new) turns to the forward index in ``folder``, one row a session and term; nothing that is there is read."""
    spark = turns.sparkSession
    store = Store(spark, folder)
    base = store.manifest()
    buckets = base["facts"].get("buckets", buckets)
    # Dealt out by bucket at once, so that one sort serves the grouping and the files.
    d = distinctive(turns).withColumn("bucket", index.bucket_of(F.col("session_id"), buckets)).repartition("bucket")
    d = d.groupBy("bucket", "session_id", "low").agg(F.min(F.struct("place", "term")).alias("x"))
    seq, pos = _seq_and_pos(F.col("x.place"))
    d = d.select("bucket", "session_id", "low", "x.term", seq.alias("seq"), pos.alias("pos"))
    staged = store.stage("terms", d.sortWithinPartitions("bucket", "session_id", "low"), ["bucket"])
    return store.commit(base, add={"terms": [staged]}, schemas={"terms": spark.createDataFrame([], FORWARD).schema}, facts={"buckets": buckets})


def indexed_terms(spark: SparkSession, index_folder: str, forward_folder: str, anchor: str, limit: int = 20, project: str | None = None, tokenizer=T.index_tokens) -> DataFrame:
    """``terms`` without a scan of texts: anchors and rows per term come from postings, the sessions' terms from the forward index."""
    r = index.Reader(spark, index_folder, tokenizer)
    phrase = r.phrases([anchor])[0]
    rows = r.rows().drop("text")
    if project:
        rows = rows.where(search.like_contains(F.col("project"), project))
    rows = rows if "ts" in rows.columns else rows.withColumn("ts", F.lit(None).cast("string"))
    found = r.occurrences(phrase, r.words(phrase)).select("rid") if phrase else rows.select("rid").limit(0)
    first = rows.join(found, "rid").groupBy("session_id").agg(F.min_by("ts", "seq").alias("ts"))
    newest = [x["session_id"] for x in first.orderBy(F.col("ts").desc_nulls_last(), "session_id").limit(MAX_SESSIONS).collect()]
    store = Store(spark, forward_folder)
    m = store.manifest()
    where = spark.createDataFrame([(x,) for x in newest], "s string").select(index.bucket_of(F.col("s"), m["facts"]["buckets"])).distinct()
    per = store.read("terms", m).where(F.col("bucket").isin([x[0] for x in where.collect()]) & F.col("session_id").isin(newest))
    per = told_apart(per, anchor)
    if len(m["tables"]["terms"]) > 1:  # a segment holds a session's term once
        per = per.groupBy("session_id", "low").agg(F.min_by("term", F.struct("seq", "pos")).alias("term"))
    # Numbers alone at first, which need no sort; then the spellings of the best.
    best = per.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SESSIONS).orderBy(F.col("n").desc(), "low").limit(MAX_TERMS)
    cand = candidates(per.where(F.col("low").isin([x["low"] for x in best.select("low").collect()])), _plain_or(tokenizer, r))
    rows_with = {x.low: list(x.toks) for x in cand.collect() if x.toks}
    forms = r.words([t for ts in rows_with.values() for t in ts])
    # (low, k, n, word): the words that may stand at each place of a candidate; MAX_TERMS candidates at most.
    need = [(low, k, len(ts), w) for low, ts in rows_with.items() for k, t in enumerate(ts) for w in forms[t]]
    alone, along = [x for x in need if x[2] == 1], [x for x in need if x[2] > 1]
    asked = lambda xs: F.broadcast(spark.createDataFrame(xs, "low string, k int, n int, word string"))
    blocks = lambda xs: r.blocks([x[3] for x in xs])
    met = F.col("term") == F.col("word")
    if r.removed is None and len({x[0] for x in alone}) == len(alone):  # a row is in one block of a word
        one = blocks(alone).select("term", F.col("n").cast("long").alias("hits")).join(asked(alone), met).groupBy("low").agg(F.sum("hits").alias("df"))
    else:
        one = r.hits(blocks(alone), places=False).join(asked(alone), met).select("low", "rid").distinct().groupBy("low").agg(F.count(F.lit(1)).alias("df"))
    more = r.hits(blocks(along)).join(asked(along), met).select("low", "rid", "k", "n", F.explode(F.transform("positions", lambda p: p - F.col("k"))).alias("at"))
    more = more.groupBy("low", "rid", "at", "n").agg(F.count_distinct("k").alias("m")).where("m = n").select("low", "rid")
    df = one.unionByName(more.distinct().groupBy("low").agg(F.count(F.lit(1)).alias("df")))
    return ranked(cand, df, r.n, limit)


def _plain_or(tokenizer, r: index.Reader):
    return T.index_tokens if r.facts["stemmed"] else tokenizer


def _starts(ts: Column, heads: list[str]):
    return lambda i: F.get(ts, i - 1).isin(heads)


def _run(ts: Column, n: int):
    return lambda i: F.array_join(F.slice(ts, i, n), " ")


def sessions(turns: DataFrame, anchor: str, limit: int = 10, top_terms: int = 20, project: str | None = None, tokenizer=T.index_tokens) -> DataFrame:
    """(session_id, ts, n_shared): anchor sessions by how many of the top terms they hold."""
    found = anchor_sessions(turns, anchor, project, tokenizer)
    best = terms(turns, anchor, top_terms, project, tokenizer).select("low")
    n = session_terms(turns, found, anchor).join(F.broadcast(best), "low").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_shared"))
    out = found.join(n, "session_id", "left").select("session_id", "ts", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return out.orderBy(F.col("n_shared").desc(), F.col("ts").desc_nulls_last(), "session_id").limit(limit)
