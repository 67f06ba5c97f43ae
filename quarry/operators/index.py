"""A stored inverted index that follows its archive: look terms up without reading it, append and remove rows without building anew.

The index is a store (sources/store.py), so each change is one commit. Its tables:

* ``rows``: the indexed rows under their number ``rid``; numbers of later segments are higher and never used again.
* ``postings``: one row a block of up to BLOCK rows that hold a term, partitioned by a hash of the term and sorted by it, so a look-up reads
  the row groups of its own terms alone. A block has its smallest and largest rid, what it takes to bound any score in it
  (per class of frequencies the largest one and the shortest row), and packed the rids, lengths, frequencies and positions (postings.py).
  Blocks go by falling impact, so most are skipped where only the best rows are asked for (``top``).
* ``stats``: per segment the number of rows and of tokens. Sums over segments are the statistics of the whole.
* ``removed``, ``gone``: rows that were taken out, and how many of them held each term. Look-ups leave them out and correct the
  statistics; ``compact`` writes the segments anew without them.
* ``stems``: of a stemmed index, the words under their stems. Words are indexed as they are and stemmed once each; a look-up reads the
  postings of all words of a stem.

With trigrams as tokens (``build_trigrams``) it is an index for substrings: these are phrases of trigrams.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.porter import stems
from quarry.operators import postings as P, search
from quarry.session import ship
from quarry.sources.store import Store, union

BUCKETS, SPREAD, BLOCK, TIERS = 64, 4, 128, 16
#: Blocks tell bounds for frequencies 1, 2-3, 4-7, .., and from 2 ** (CLASSES - 1) on.
CLASSES = 6
#: Literal rids up to which rows are looked up by them instead of by a join.
FEW = 2000
#: Bytes of a row group of postings, small so that a look-up skips what it does not ask for.
GROUP = {"parquet.block.size": 1 << 20, "compression": "zstd"}
_BLOCKS = "bucket int, term string, tier int, n int, tokens long, low long, high long, tfs array<int>, dls array<int>, head binary, places binary"
_STATS, _REMOVED, _GONE, _STEMS = "n long, tokens long", "rid long, dl long", "bucket int, term string, n long", "stem string, word string"


def postings(df: DataFrame, id_cols: Sequence[str], tokenizer: Callable[[Column], Column] = T.index_tokens) -> DataFrame:
    """(ids, term, tf, dl), one row per row and term."""
    d = df.select(*id_cols, tokenizer(F.coalesce(F.col("text"), F.lit(""))).alias("_t")).withColumn("dl", F.size("_t").cast("long"))
    return d.select(*id_cols, "dl", F.explode("_t").alias("term")).groupBy(*id_cols, "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select(*id_cols, "term", "tf", "dl")


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


# Writing.


def _chunks(rows: DataFrame, tokenizer: Callable[[Column], Column] | None, facts: dict) -> DataFrame:
    """(bucket, then as postings.CHUNK): what stretches of rows hold of each term; texts are turned over where they are read."""
    ship(rows.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    if facts["trigrams"]:
        d = rows.select("rid", F.lower(text).alias("text")).mapInArrow(P.trigrams, P.CHUNK)
    else:
        d = rows.select("rid", tokenizer(text).alias("t")).mapInArrow(P.words, P.CHUNK)
    return d.select(bucket_of(F.col("term"), facts["buckets"]).alias("bucket"), "*")


def _blocks(chunks: DataFrame, avg: float, spread: int) -> DataFrame:
    """Blocks of a term's hits: by falling impact in TIERS steps; a bucket is dealt out to ``spread`` tasks."""
    d = chunks.repartition("bucket", F.pmod(F.xxhash64("low"), F.lit(spread))).sortWithinPartitions("bucket", "term", "low")
    return d.mapInArrow(P.blocks(avg, search.K1, search.B, BLOCK, TIERS, CLASSES), _BLOCKS).sortWithinPartitions("bucket", "term", "tier", "low")


def _stem_table(words: DataFrame) -> DataFrame:
    """(stem, word) of (word); each distinct word is stemmed once."""
    return words.distinct().groupBy(F.pmod(F.xxhash64("word"), F.lit(4096)).alias("k")).agg(F.collect_list("word").alias("ws")).select(
        F.explode(F.arrays_zip(stems(F.col("ws")).alias("stem"), F.col("ws").alias("word"))).alias("x")
    ).select("x.stem", "x.word")


def _segment(store: Store, df: DataFrame, facts: dict, tokenizer: Callable[[Column], Column] | None) -> tuple[dict[str, list[str]], dict]:
    """Stage the tables of new rows; only these are read."""
    first = facts["next"]
    kept = [c for c in df.columns if c != "rid"]
    folder = store.stage("rows", df.select(*kept, (F.lit(first).cast("long") + F.monotonically_increasing_id()).alias("rid")))
    # The numbers are read back, so that later steps agree on them.
    rows = store.spark.read.parquet(f"{store.folder}/{folder}")
    n, last, chars = rows.agg(F.count(F.lit(1)), F.max("rid"), F.avg(F.length("text"))).first()
    avg = (chars or 0) if facts["trigrams"] else (chars or 0) / 6
    made = {"rows": [folder], "postings": [store.stage("postings", _blocks(_chunks(rows, _plain(tokenizer), facts), avg, facts["spread"]), ["bucket"], **GROUP)]}
    post = store.spark.read.schema(_BLOCKS).parquet(f"{store.folder}/{made['postings'][0]}")
    tokens = post.agg(F.sum("tokens")).first()[0] or 0
    made["stats"] = [store.stage("stats", store.spark.createDataFrame([(n, tokens)], _STATS))]
    if facts["stemmed"]:
        made["stems"] = [store.stage("stems", _stem_table(post.select(F.col("term").alias("word"))).repartitionByRange(max(1, min(8, facts["buckets"])), "stem").sortWithinPartitions("stem"))]
    return made, {"next": first if last is None else ((last >> 33) + 1) << 33}


def _plain(tokenizer: Callable[[Column], Column] | None) -> Callable[[Column], Column]:
    """What is indexed: words as they are where search is by stems."""
    return T.tokens if tokenizer is T.index_tokens else tokenizer


def build(
    df: DataFrame, folder: str, tokenizer: Callable[[Column], Column] = T.index_tokens, buckets: int = BUCKETS, spread: int | None = None, trigrams: bool = False
) -> int:
    """Write the index of ``df`` (with ``text``) under ``folder``, a place that driver and executors share; gives its version.

    The tokenizer has to be given again with each look-up. ``spread`` is the number of tasks and files that share a frequent term.
    """
    spark = df.sparkSession
    store = Store(spark, folder)
    base = store.manifest()
    if base["version"]:
        raise ValueError(f"{folder} holds an index already; append to it")
    facts = {"next": 0, "buckets": buckets, "spread": spread or SPREAD, "stemmed": tokenizer is T.index_tokens and not trigrams, "trigrams": trigrams}
    made, more = _segment(store, df, facts, tokenizer)
    empty = lambda shape: spark.createDataFrame([], shape).schema
    schemas = {"rows": spark.read.parquet(f"{folder}/{made['rows'][0]}").schema, "postings": empty(_BLOCKS), "stats": empty(_STATS), "removed": empty(_REMOVED), "gone": empty(_GONE), "stems": empty(_STEMS)}
    return store.commit(base, put=made, schemas=schemas, facts=facts | more)


def build_trigrams(df: DataFrame, folder: str, buckets: int = BUCKETS, spread: int | None = None) -> int:
    """An index of all runs of three characters of the lower-case texts."""
    return build(df, folder, None, buckets, spread, trigrams=True)


def append(df: DataFrame, folder: str, tokenizer: Callable[[Column], Column] = T.index_tokens) -> int:
    """Add rows as a segment of their own; nothing that is there already is read."""
    store = Store(df.sparkSession, folder)
    base = store.manifest()
    made, more = _segment(store, df, base["facts"], tokenizer)
    return store.commit(base, add=made, facts=more)


def _taken_out(store: Store, base: dict, gone_rows: DataFrame, tokenizer: Callable[[Column], Column] | None) -> dict[str, list[str]]:
    """Stage what takes rows out: their numbers and lengths, and per term how many held it."""
    facts = base["facts"]
    text = F.coalesce("text", F.lit(""))
    dl = F.greatest(F.length(F.lower(text)) - 2, F.lit(0)) if facts["trigrams"] else F.size(_plain(tokenizer)(text))
    gone = _chunks(gone_rows, _plain(tokenizer), facts).groupBy("bucket", "term").agg(F.sum("n").alias("n")).repartition("bucket").sortWithinPartitions("bucket", "term")
    return {"removed": [store.stage("removed", gone_rows.select("rid", dl.cast("long").alias("dl")))], "gone": [store.stage("gone", gone, ["bucket"])]}


def forget(spark: SparkSession, folder: str, where: Column, tokenizer: Callable[[Column], Column] = T.index_tokens) -> int:
    """Take out the rows that ``where`` holds for. Their text leaves the files with ``compact`` and ``vacuum``."""
    store = Store(spark, folder)
    base = store.manifest()
    return store.commit(base, add=_taken_out(store, base, rows(spark, folder, base).where(where), tokenizer))


def replace(spark: SparkSession, folder: str, where: Column, text: Column, tokenizer: Callable[[Column], Column] = T.index_tokens) -> int:
    """Give the rows that ``where`` holds for another text (as when secrets are masked later on), in one commit."""
    store = Store(spark, folder)
    base = store.manifest()
    old = rows(spark, folder, base).where(where)
    made, more = _segment(store, old.withColumn("text", text), base["facts"], tokenizer)
    return store.commit(base, add=made | _taken_out(store, base, old, tokenizer), facts=more)


def compact(spark: SparkSession, folder: str) -> int:
    """All segments as one, without the rows that were taken out; texts are not tokenised again."""
    store = Store(spark, folder)
    base = store.manifest()
    f = base["facts"]
    kept = rows(spark, folder, base)
    removed = store.read("removed", base).select("rid")
    ship(spark)
    hits = store.read("postings", base).select("bucket", "term", "n", "low", "head", "places").mapInArrow(P.single, f"bucket int, {P.CHUNK}")
    hits = hits.join(removed.withColumnRenamed("rid", "low"), "low", "left_anti").select("bucket", "term", "n", "low", "head", "places")
    n, tokens = _totals(store, base)
    put = {"rows": [store.stage("rows", kept.repartitionByRange("rid").sortWithinPartitions("rid"))], "postings": [store.stage("postings", _blocks(hits, tokens / max(1, n), f["spread"]), ["bucket"], **GROUP)]}
    put |= {"stats": [store.stage("stats", spark.createDataFrame([(n, tokens)], _STATS))], "removed": [], "gone": []}
    if f["stemmed"]:
        left = spark.read.schema(_BLOCKS).parquet(f"{folder}/{put['postings'][0]}").select(F.col("term").alias("word"))
        put["stems"] = [store.stage("stems", _stem_table(left).repartitionByRange(max(1, min(8, f["buckets"])), "stem").sortWithinPartitions("stem"))]
    return store.commit(base, put=put)


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Delete the files that the newest version does not use."""
    return Store(spark, folder).vacuum()


# Reading.


def rows(spark: SparkSession, folder: str, version: dict | int | None = None) -> DataFrame:
    """The rows of the index that were not taken out, with their rid."""
    store = Store(spark, folder)
    m = version if isinstance(version, dict) else store.manifest(version)
    d = store.read("rows", m)
    return d.join(store.read("removed", m).select("rid"), "rid", "left_anti").select(*d.columns) if m["tables"].get("removed") else d


def _totals(store: Store, m: dict) -> tuple[int, int]:
    """(rows, tokens) that were not taken out."""
    n, tokens = store.read("stats", m).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if m["tables"].get("removed"):
        less = store.read("removed", m).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n, tokens = n - less[0], tokens - less[1]
    return n, tokens


class Reader:
    """One version of an index."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: Callable[[Column], Column] | None = T.index_tokens, version: int | None = None):
        self.spark, self.store, self.tokenizer = spark, Store(spark, folder), tokenizer
        self.m = self.store.manifest(version)
        if not self.m["version"]:
            raise ValueError(f"{folder} holds no index")
        self.facts = self.m["facts"]
        self.n, self.tokens = _totals(self.store, self.m)
        self.avg = self.tokens / self.n if self.n else 0.0
        self.postings = self.store.read("postings", self.m)
        self.removed = self.store.read("removed", self.m).select("rid") if self.m["tables"].get("removed") else None

    def rows(self) -> DataFrame:
        return self.store.read("rows", self.m)

    def look_up(self, rids: DataFrame, few: Sequence[int] | None = None) -> DataFrame:
        """Rows by number; a short list is pushed down to the files, whose rows are in the order of their numbers."""
        d = self.rows()
        return d.where(F.col("rid").isin(list(few))).join(F.broadcast(rids), "rid") if few is not None else d.join(rids, "rid")

    def look_up_ids(self, scored: DataFrame, id_cols: Sequence[str]) -> list[tuple]:
        """(rid, score, ids) of the rows of a bounded list with those that equal its last."""
        d = self.rows().select("rid", *id_cols).join(scored, "rid")
        return [(x["rid"], x["score"], tuple(x[c] for c in id_cols)) for x in d.collect()]

    def phrases(self, terms: Sequence[str]) -> list[list[str]]:
        """Each term as its tokens, stems where the index is by stems."""
        if not terms:
            return []
        if self.facts["trigrams"]:
            return [[t.lower()[i : i + 3] for i in range(len(t) - 2)] for t in terms]
        cut = T.index_tokens if self.facts["stemmed"] else self.tokenizer
        row = self.spark.range(1).select(*[cut(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()
        return [list(x) for x in row]

    def words(self, tokens: Sequence[str], prefix: bool = False) -> dict[str, list[str]]:
        """The indexed words of each token: itself, those of its stem, or with ``prefix`` those that begin with it."""
        tokens = list(dict.fromkeys(tokens))
        if prefix:
            p = self.postings.select("term").where(reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in tokens])).distinct()
            every = [r["term"] for r in (p if not self.facts["stemmed"] else self._by_stem(F.col("stem").startswith(tokens[0])).select(F.col("word").alias("term"))).collect()]
            return {t: sorted(every) for t in tokens}
        if not self.facts["stemmed"]:
            return {t: [t] for t in tokens}
        out: dict[str, list[str]] = {t: [] for t in tokens}
        for r in self._by_stem(F.col("stem").isin(tokens)).collect():
            out[r["stem"]].append(r["word"])
        return {k: sorted(set(v)) for k, v in out.items()}

    def _by_stem(self, which: Column) -> DataFrame:
        return self.store.read("stems", self.m).where(which).distinct()

    def blocks(self, words: Sequence[str]) -> DataFrame:
        """The blocks of some words; only their buckets and row groups are read."""
        words = sorted(set(words))
        return self.postings.where(F.col("bucket").isin(sorted({self.bucket(w) for w in words})) & F.col("term").isin(words))

    def bucket(self, word: str) -> int:
        """``bucket_of``, worked out here."""
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % self.facts["buckets"]

    def hits(self, blocks: DataFrame, places: bool = True) -> DataFrame:
        """(term, rid, dl, tf), with ``places`` also positions, of rows that were not taken out."""
        ship(self.spark)
        h = blocks.select("term", "n", "low", "head", *["places"] * places).mapInArrow(P.hits(places), "term string, rid long, dl int, tf int" + ", positions array<int>" * places)
        return h if self.removed is None else h.join(self.removed, "rid", "left_anti")

    def occurrences(self, phrase: Sequence[str], words: dict[str, list[str]], prefix: bool = False) -> DataFrame:
        """(rid, dl, tf, starts) of the rows that hold a phrase; one of several tokens is met by positions, from the rarest on."""
        forms = [words[t] for t in phrase]
        if prefix:
            forms[-1] = self.words([phrase[-1]], prefix=True)[phrase[-1]]
        starts = lambda k: F.transform("positions", lambda x: x - k)
        places = []
        for k, f in enumerate(forms):
            h = self.hits(self.blocks(f) if f else self.postings.where(F.lit(False)))
            if len(f) > 1:  # a row may hold several of the words
                h = h.groupBy("rid", "dl").agg(F.flatten(F.collect_list("positions")).alias("positions"))
            places.append((k, h.select("rid", "dl", starts(k).alias("at"))))
        if len(places) > 1:
            sizes = {r["term"]: r["n"] for r in self.blocks([w for f in forms for w in f]).groupBy("term").agg(F.sum("n").alias("n")).collect()}
            places.sort(key=lambda p: sum(sizes.get(w, 0) for w in forms[p[0]]))
        met = places[0][1]
        for _, h in places[1:]:
            met = met.join(h.select("rid", F.col("at").alias("b")), "rid").withColumn("at", F.array_intersect("at", "b")).drop("b").where(F.size("at") > 0)
        return met.select("rid", F.col("dl").cast("long").alias("dl"), F.size("at").cast("long").alias("tf"), F.col("at").alias("starts"))

    def counted(self, phrases: list[list[str]], prefixes: Sequence[bool] = ()) -> tuple[DataFrame, list[int]]:
        """(rid, _dl, _tf, _starts) with an entry per phrase, of all rows that hold any, and the rows that hold each."""
        prefixes = list(prefixes) or [False] * len(phrases)
        words = self.words([t for p in phrases for t in p])
        found = [self.occurrences(p, words, x).withColumn("k", F.lit(k)) for k, (p, x) in enumerate(zip(phrases, prefixes))]
        every = union(found)
        # One row per phrase, from its postings alone.
        dfs = {r.k: r.n for r in every.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
        at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
        none = F.array().cast("array<int>")
        c = every.groupBy("rid").agg(
            F.max("dl").alias("_dl"), F.array(*[F.coalesce(at(k, "tf"), F.lit(0)) for k in range(len(phrases))]).alias("_tf"),
            F.array(*[F.coalesce(at(k, "starts"), none) for k in range(len(phrases))]).alias("_starts"),
        )
        return c, [dfs.get(k, 0) for k in range(len(phrases))]

    def scored(self, c: DataFrame, dfs: list[int]) -> DataFrame:
        return c.withColumn("score", search.bm25(c, (self.n, self.avg, dfs)))


def match_scores(
    spark: SparkSession, folder: str, terms: Sequence[str], any_of: bool = False, exclude: Sequence[str] = (), tokenizer: Callable[[Column], Column] = T.index_tokens, version: int | None = None
) -> DataFrame:
    """(rid, score) of matching rows, as ``search.match_scores`` gives over a scan."""
    if not [t for t in terms if t.strip()]:
        raise ValueError("no search terms")
    r = Reader(spark, folder, tokenizer, version)
    asked = r.phrases([*terms, *exclude])
    want, unwanted = [p for p in asked[: len(terms)] if p], [p for p in asked[len(terms) :] if p]
    if not want:  # as the scan: terms without a token match nothing
        return r.rows().where(F.lit(False)).select("rid", F.lit(0.0).alias("score"))
    c, dfs = r.counted(want)
    if not any_of:
        c = c.where(F.forall("_tf", lambda x: x > 0))
    words = r.words([t for p in unwanted for t in p]) if unwanted else {}
    for p in unwanted:
        c = c.join(r.occurrences(p, words).select("rid"), "rid", "left_anti")
    return r.scored(c, dfs).select("rid", "score")


def raw_scores(spark: SparkSession, folder: str, query: str, tokenizer: Callable[[Column], Column] = T.index_tokens) -> DataFrame:
    """(rid, score) of the rows that a raw query matches, as ``search.raw_scores`` gives over a scan."""
    q, r = search.RawQuery(query), Reader(spark, folder, tokenizer)
    toks = r.phrases([t for t, _ in q.phrases])
    if not all(toks):
        raise ValueError("a phrase of the query has no word")
    c, dfs = r.counted(toks, [x for _, x in q.phrases])

    def close(ks: list[int], reach: int) -> Column:
        """Whether some stretch holds every word with at most ``reach`` tokens between the first and the last."""
        lists = [F.get("_starts", F.lit(k)) for k in ks]
        inside = lambda i: reduce(lambda a, b: a & b, [F.exists(x, lambda p: (p >= i) & (p < i + reach + len(ks))) for x in lists])
        return F.exists(F.concat(*lists), inside)

    hit = lambda k: close(*q.near[~k]) if k < 0 else F.get("_tf", F.lit(k)) > 0
    return r.scored(c.where(q.test(hit)), dfs).select("rid", "score")


def keyword(
    spark: SparkSession, folder: str, terms: Sequence[str], limit: int = 15, where: Column | None = None, session: str | None = None, raw: str | None = None, fold: bool = False,
    tags: tuple[DataFrame, Sequence[str]] | None = None, snippet_words: int | None = None, id_cols: Sequence[str] = (), tokenizer: Callable[[Column], Column] = T.index_tokens, **match,
) -> DataFrame:
    """The best rows by score, with their columns, as ``search.keyword`` gives over a scan; a negative limit keeps all.

    ``where`` is a filter on rows, ``session`` a prefix of their session's id, ``tags`` (table, wanted ones) what their session must have;
    ``fold`` keeps the best of each session, with ``n_more``. Equal scores go by ``id_cols``, then by rid.
    """
    s = match_scores(spark, folder, terms, tokenizer=tokenizer, **match) if raw is None else raw_scores(spark, folder, raw, tokenizer)
    order = ["score", *id_cols, "rid"]
    own = search.like_prefix(F.col("session_id"), session) if session is not None else None
    where = own if where is None else where if own is None else where & own
    d = Reader(spark, folder, tokenizer).rows()
    if where is None and tags is None and not fold and not id_cols and 0 <= limit <= FEW:  # a bounded list, so its rows are looked up by broadcast
        out = d.join(F.broadcast(s.orderBy("score", "rid").limit(limit)), "rid").orderBy(*order)
    else:
        d = d if where is None else d.where(where)
        d = d if tags is None else search.with_tags(d, *tags)
        hits = d.join(s, "rid")
        if fold and session is None:
            hits = hits.orderBy(*order).limit(search.FOLD_WINDOW * limit) if limit > 0 else hits
            out = search.fold_sessions(hits, limit, [F.col(c) for c in order])
        else:
            out = hits.orderBy(*order)
            out = out.limit(limit) if limit >= 0 else out
            out = out.withColumn("n_more", F.lit(0).cast("long")) if fold else out
    if snippet_words:
        out = search.with_snippets(out, terms if raw is None else [t for t, _ in search.RawQuery(raw).phrases], snippet_words, stemmed=tokenizer is T.index_tokens)
    return out


def keyword_or_nearest(spark: SparkSession, folder: str, terms: Sequence[str], vectors: DataFrame, encode: Callable, limit: int = 15, **more) -> tuple[str, DataFrame]:
    """("keyword", hits), or where no row has the terms ("semantic", rows with the nearest vectors)."""
    hits = keyword(spark, folder, terms, limit, **more)
    if not hits.isEmpty():
        return "keyword", hits
    tok = more.get("tokenizer", T.index_tokens)
    return "semantic", search.semantic_turns(vectors, rows(spark, folder), encode([" ".join(terms)])[0], limit, more.get("where"), more.get("exclude", ()), tok)


@dataclass
class Read:
    """What a bounded look-up has read, and what there was."""

    blocks: int
    all_blocks: int
    postings: int
    all_postings: int


def top(
    spark: SparkSession, folder: str, terms: Sequence[str], limit: int = 15, id_cols: Sequence[str] = (), tokenizer: Callable[[Column], Column] = T.index_tokens
) -> tuple[DataFrame, Read]:
    """The best rows with any of some words, as ``keyword(.., any_of=True)``, from the blocks that can hold one of them.

    First the blocks with the highest bounds are read; the worst of the best rows there sets a limit. A row can pass it only if it
    is in a block whose bound, with the highest bounds of the other words, reaches the limit; so the other blocks are skipped. Rows found in
    those that, with the highest bounds of the words not met yet, still reach it get what these add, from the blocks whose range of numbers they lie
    in. Phrases of several tokens go to ``keyword``.
    """
    r = Reader(spark, folder, tokenizer)
    asked = [p for p in r.phrases(terms) if p]
    tokens = list(dict.fromkeys(p[0] for p in asked))
    words = r.words(tokens)
    of = {w: t for t in tokens for w in words[t]}
    if limit < 1 or not of or any(len(p) > 1 for p in asked):
        return keyword(spark, folder, terms, limit, id_cols=id_cols, tokenizer=tokenizer, any_of=True), Read(0, 0, 0, 0)
    dfs = _rows_with(r, tokens, words)
    mapped = lambda f: F.element_at(F.create_map(*[x for w in of for x in (F.lit(w), F.lit(f(w)))]), F.col("term"))
    weight = mapped(lambda w: search.idf(r.n, dfs[of[w]]) * sum(p[0] == of[w] for p in asked))
    k1, b, avg = search.K1, search.B, max(r.avg, 1e-9)
    part = lambda tf, dl: tf.cast("double") * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(avg)))
    meta = r.blocks(list(of)).select("term", "tier", "n", "low", "high", "tfs", "dls")
    meta = meta.withColumn("bound", weight * F.array_max(F.zip_with("tfs", "dls", lambda tf, dl: F.when(tf > 0, part(tf, dl)).otherwise(F.lit(0.0)))))
    most = {x["term"]: x for x in meta.groupBy("term").agg(F.max("bound").alias("bound"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()}

    def read(m: DataFrame, deep: int | None) -> DataFrame:
        """(term, rid, dl, tf, s, token) of the blocks of ``m``, of which none lies below tier ``deep``."""
        d = r.blocks(list(of)) if deep is None else r.blocks(list(of)).where(F.col("tier") <= deep)
        h = r.hits(d.join(m.select("term", "low"), ["term", "low"], "left_semi"), False)
        return h.select("term", "rid", "dl", "tf", (weight * part(F.col("tf"), F.col("dl"))).alias("s"), mapped(lambda w: of[w]).alias("token"))

    def kth(h: DataFrame) -> float:
        """What ``limit`` rows reach at least; words of one stem count by the best of them, as together they give less than their sum."""
        got = h.groupBy("rid", "token").agg(F.max("s").alias("s")).groupBy("rid").agg(F.sum("s").alias("s")).orderBy(F.col("s").desc()).limit(limit).collect()
        return got[-1]["s"] * (1 - 1e-9) if len(got) == limit else 0.0

    # Every block has a row, but it may be taken out or in several of the blocks: then there is no limit yet and all is read.
    least = kth(read(meta.orderBy(F.col("bound").desc(), "term", "low").limit(limit), None))
    others = mapped(lambda w: float(sum(x["bound"] for v, x in most.items() if v != w)))
    # Words that together cannot reach the limit lead to no row; they only add to rows that others lead to.
    weak, room = [], least
    for w in sorted(most, key=lambda w: most[w]["bound"]):
        room -= most[w]["bound"]
        if room <= 0:
            break
        weak.append(w)
    can = meta.where((F.col("bound") + others >= least) & ~F.col("term").isin(weak))
    own = read(can, can.agg(F.max("tier")).first()[0])
    least = max(least, kth(own)) if len(most) > 1 else least
    met = own.groupBy("rid").agg(F.sum("s").alias("s"), F.collect_set("term").alias("terms"))
    missing = reduce(lambda x, y: x + y, [F.when(F.array_contains("terms", w), 0.0).otherwise(float(x["bound"])) for w, x in most.items()])
    left = met.where(F.col("s") + missing >= least).select("rid")
    more = meta.join(can.select("term", "low"), ["term", "low"], "left_anti") if len(most) > 1 else meta.limit(0)
    few = [x["rid"] for x in left.limit(FEW + 1).collect()] if len(most) > 1 else []
    if 0 < len(few) <= FEW:  # else all their other blocks
        near = F.array(*map(F.lit, few)).cast("array<bigint>")
        more = more.where(F.exists(near, lambda x: (x >= F.col("low")) & (x <= F.col("high"))))
    extra = read(more, None).join(left, "rid", "left_semi") if len(most) > 1 else own.limit(0)
    got = own.join(left, "rid", "left_semi").unionByName(extra) if len(most) > 1 else own
    tf = [F.sum(F.when(F.col("token") == p[0], F.col("tf")).otherwise(0)) for p in asked]
    c = got.groupBy("rid").agg(F.max("dl").alias("_dl"), F.array(*tf).alias("_tf"))
    best = r.scored(c, [dfs[p[0]] for p in asked]).select("rid", "score")
    size = can.select("n").unionByName(more.select("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    report = Read(size[0], sum(x["blocks"] for x in most.values()), size[1], sum(x["n"] for x in most.values()))
    if id_cols:
        edge = best.orderBy("score").limit(limit).agg(F.max("score")).first()[0]
        near = best if edge is None else best.where(F.col("score") <= edge)
        return r.rows().join(near, "rid").orderBy("score", *id_cols, "rid").limit(limit), report
    return r.rows().join(F.broadcast(best.orderBy("score", "rid").limit(limit)), "rid").orderBy("score", "rid"), report


def _rows_with(r: Reader, tokens: Sequence[str], words: dict[str, list[str]]) -> dict[str, int]:
    """Rows that hold each token: of a single word from the sizes of its blocks, of several from their numbers."""
    out = {t: 0 for t in tokens}
    single = {words[t][0]: t for t in tokens if len(words[t]) == 1}
    if single:
        for x in r.blocks(list(single)).groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[single[x["term"]]] += x["n"]
        if r.removed is not None:
            for x in r.store.read("gone", r.m).where(F.col("term").isin(list(single))).groupBy("term").agg(F.sum("n").alias("n")).collect():
                out[single[x["term"]]] -= x["n"]
    for t in tokens:
        if len(words[t]) > 1:
            out[t] = r.hits(r.blocks(words[t]), False).select("rid").distinct().count()
    return out


# Substrings, over an index of trigrams.


def fuzzy(
    spark: SparkSession, folder: str, terms: Sequence[str], limit: int = 15, any_of: bool = False, exclude: Sequence[str] = (), where: Column | None = None, fold: bool = False,
    id_cols: Sequence[str] = ("session_id", "seq"),
) -> DataFrame:
    """``search.fuzzy`` through trigrams: rows with the substrings; where there are none, rows with a word one edit from a term.

    Substrings are phrases of trigrams, met by positions from the rarest trigram on, so no text is read for them. The second pass takes the
    best RELAXED_LIMIT rows by a term's trigrams and reads the texts of these alone. ``exclude`` are substrings no hit has, ``where`` filters rows, ``fold``
    keeps the best hit of each session with ``n_more``.
    """
    terms = [t.lower() for t in terms if len(t) >= 3]
    if not terms:
        raise ValueError("fuzzy search wants terms of three or more characters")
    r = Reader(spark, folder, None)
    order = ["score", *id_cols, "rid"]
    unwanted = [r.occurrences(p, {t: [t] for t in p}).select("rid") for p in r.phrases([x for x in exclude if len(x) >= 3])]
    allowed = None if where is None else r.rows().where(where).select("rid")

    def fit(c: DataFrame) -> DataFrame:
        c = reduce(lambda a, b: a.join(b, "rid", "left_anti"), unwanted, c)
        return c if allowed is None else c.join(allowed, "rid", "left_semi")

    def listed(hits: DataFrame, nearest: bool) -> DataFrame:
        hits = hits.withColumn("nearest", F.lit(nearest)).orderBy(*order)
        return search.fold_sessions(hits.limit(search.FOLD_WINDOW * limit), limit, [F.col(c) for c in order]) if fold else hits.limit(limit)

    c, dfs = r.counted(r.phrases(terms))
    hit = [F.get("_tf", F.lit(i)) > 0 for i in range(len(terms))]
    exact = fit(r.scored(c.where(reduce(lambda a, b: (a | b) if any_of else (a & b), hit)), dfs).select("rid", "score"))
    if sum(dfs) and not exact.isEmpty():
        return listed(r.rows().join(exact, "rid"), False)
    long = [t for t in terms if len(t) >= 5]
    if not long:
        return listed(r.rows().join(exact.limit(0), "rid"), False)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    near_words = F.array_distinct(F.concat(T.turn_tokens(low), F.filter(F.split(low, r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")))
    best: dict[int, float] = {}
    of_term: list[tuple[set[str], list]] = []
    for relaxed in [set(long)] if any_of else [{t} for t in dict.fromkeys(long)]:
        parts = [list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2)))[: search.TRIGRAMS] if t in relaxed else [t] for t in terms]
        flat = [x for p in parts for x in p]
        c, dfs = r.counted(r.phrases(flat))
        first, groups = 0, []
        for p in parts:
            groups.append(reduce(lambda a, b: a | b, [F.get("_tf", F.lit(first + k)) > 0 for k in range(len(p))]))
            first += len(p)
        met = fit(r.scored(c.where(reduce(lambda a, b: (a | b) if any_of else (a & b), groups)), dfs).select("rid", "score"))
        # Ties at the limit go by the ids, so the rows that equal the last come along.
        edge = met.orderBy("score").limit(search.RELAXED_LIMIT).agg(F.max("score")).first()[0]
        got = r.look_up_ids(met.where(F.col("score") <= edge), id_cols) if edge is not None else []
        of_term.append((relaxed, sorted(got, key=lambda x: (x[1], x[2], x[0]))[: search.RELAXED_LIMIT]))
    hits = []
    for relaxed, got in of_term:
        if got:
            t = r.rows().where(F.col("rid").isin([x[0] for x in got])).where(reduce(lambda a, b: a | b, [search._has_near(near_words, t) for t in sorted(relaxed)])).select("rid")
            ok = {x["rid"] for x in t.collect()}
            for rid, score, _ in got:
                if rid in ok:
                    best[rid] = min(score, best.get(rid, score))
    hits = spark.createDataFrame(list(best.items()), "rid long, score double")
    return listed(r.look_up(hits, list(best)), True)

