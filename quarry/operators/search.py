"""Retrieval: BM25 keyword search with a match algebra, fuzzy search, vector search, folding, context.

Statistics (rows, average length, rows per phrase) are of the whole table, before any filter. They take one
scan and come to the driver as one row; scoring is a second scan with the statistics as literals, so there is no
join and no shuffle but the final top-k. An archive that is searched more than once gets an index (operators/index.py).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import porter
from quarry.functions import text as T
from quarry.functions.snippet import snippet

K1, B = 1.2, 0.75
FOLD_WINDOW = 4
RELAXED_LIMIT, TRIGRAMS = 50, 24


def phrase_count(tokens: Column, phrase: Sequence[str | tuple[str, ...]]) -> Column:
    """Occurrences of consecutive tokens, each a word or one of several; the token array is evaluated once."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: _is(t, phrase[0])))
    k = len(phrase)
    if not all(isinstance(p, str) for p in phrase):

        def any_of(ts: Column) -> Column:
            at = F.sequence(F.lit(0), F.greatest(F.size(ts) - 1, F.lit(0)))
            return F.size(F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.coalesce(_is(F.get(ts, i + j), p), F.lit(False)) for j, p in enumerate(phrase)])))

        return T.bind(tokens, any_of)
    want = F.array(*[F.lit(p) for p in phrase])

    def count(ts: Column) -> Column:
        at = F.when(F.size(ts) < k, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(ts) - k + 1, F.lit(1))))
        return F.size(F.filter(at, lambda i: (F.get(ts, i - 1) == phrase[0]) & (F.slice(ts, i, k) == want)))

    return T.bind(tokens, count)


def _is(token: Column, word: str | tuple[str, ...]) -> Column:
    return token == word if isinstance(word, str) else token.isin(list(word)) if word else F.lit(False)


def words_of(df: DataFrame, phrases: list[list[str]], text_cols: Sequence[str] = ("text",)) -> list[list[tuple[str, ...]]]:
    """Phrases of stems as phrases of the words that ``df`` has of each stem.

    A word and its stem agree but for the stem's last two characters, so only words that begin that way are sought, and
    each distinct one is stemmed once; whole texts never leave the JVM.
    """
    stems = sorted({t for p in phrases for t in p})
    heads = sorted({t[: max(1, len(t) - 2)] for t in stems})
    begins = lambda w: reduce(lambda a, b: a | b, [w.startswith(h) for h in heads])
    near = F.array_distinct(F.concat(*[F.filter(T.tokens(F.coalesce(F.col(c), F.lit(""))), begins) for c in text_cols]))
    words = df.select(F.explode(near).alias("w")).distinct()
    found = words.groupBy(F.spark_partition_id()).agg(F.collect_list("w").alias("ws")).select(F.explode(F.arrays_zip(porter.stems(F.col("ws")).alias("s"), F.col("ws").alias("w"))).alias("x"))
    of: dict[str, list[str]] = {}
    for r in found.select("x.s", "x.w").where(F.col("s").isin(stems)).collect():
        of.setdefault(r["s"], []).append(r["w"])
    return [[tuple(sorted(of.get(t, ()))) for t in p] for p in phrases]


def phrases_of(df: DataFrame, terms: Sequence[str], tokenizer: Callable[[Column], Column]) -> list[list[str]]:
    """Each term as the tokens the index would have; a term without any is left out."""
    if not terms:
        return []
    spark = df.sparkSession
    row = spark.range(1).select(*[tokenizer(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return [list(x) for x in row if x]


def idf(n_rows: int, n_with: int) -> float:
    v = math.log((n_rows - n_with + 0.5) / (n_with + 0.5))
    return v if v > 0 else 1e-6


def counted(df: DataFrame, phrases: list[list[str]], tokenizer: Callable[[Column], Column], text_cols: Sequence[str] = ("text",)) -> DataFrame:
    """``df`` with ``_dl`` tokens and ``_tf``, occurrences per phrase, summed over the text columns."""
    every = F.array(*[tokenizer(F.coalesce(F.col(c), F.lit(""))) for c in text_cols])

    def count(ts: Column) -> Column:
        parts = [F.get(ts, F.lit(i)) for i in range(len(text_cols))]
        dl = reduce(lambda a, b: a + b, [F.size(x) for x in parts])
        return F.struct(dl.alias("dl"), F.array(*[reduce(lambda a, b: a + b, [phrase_count(x, p) for x in parts]) for p in phrases]).alias("tf"))

    # Filters do not pass a generator, so what they test is not computed again below it.
    d = df.withColumn("_c", F.explode(F.array(T.bind(every, count))))
    return d.withColumns({"_dl": F.col("_c.dl"), "_tf": F.col("_c.tf")}).drop("_c")


def statistics(c: DataFrame, k: int) -> tuple[int, float, list[int]]:
    """(rows, average length, rows with each phrase) of a counted table: one row to the driver."""
    row = c.agg(F.count(F.lit(1)), F.avg("_dl"), *[F.count_if(F.get("_tf", F.lit(i)) > 0) for i in range(k)]).first()
    return row[0], row[1] or 0.0, list(row[2:])


def bm25(c: DataFrame, stats: tuple[int, float, list[int]], exact: bool = True) -> Column:
    """Negative score, better is smaller."""
    n, avg, dfs = stats
    out = F.lit(0.0)
    for i, m in enumerate(dfs):
        tf = F.get("_tf", F.lit(i)).cast("double")
        out = out + F.lit(idf(n, m)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.lit(max(avg, 1e-9))))
    return -out


def match_scores(
    df: DataFrame, terms: Sequence[str], any_of: bool = False, exclude: Sequence[str] = (), tokenizer: Callable[[Column], Column] = T.index_tokens,
    where: Column | None = None, text_cols: Sequence[str] = ("text",),
) -> DataFrame:
    """Matching rows with ``score``. All phrases must occur, or any with ``any_of``; none of ``exclude``."""
    if not [t for t in terms if t.strip()]:
        raise ValueError("no search terms")
    want, unwanted = phrases_of(df, terms, tokenizer), phrases_of(df, exclude, tokenizer)
    if not want:
        return df.where(F.lit(False)).withColumn("score", F.lit(0.0))
    if tokenizer is T.index_tokens:  # the words of the stems, counted unstemmed
        both = words_of(df, [*want, *unwanted], text_cols)
        want, unwanted, tokenizer = both[: len(want)], both[len(want) :], T.tokens
    c = counted(df, want, tokenizer, text_cols)
    stats = statistics(c, len(want))
    hit = [F.get("_tf", F.lit(i)) > 0 for i in range(len(want))]
    out = counted(df, [*want, *unwanted], tokenizer, text_cols) if unwanted else c
    out = out.where(reduce(lambda a, b: (a | b) if any_of else (a & b), hit))
    for i in range(len(unwanted)):
        out = out.where(F.get("_tf", F.lit(len(want) + i)) == 0)
    if where is not None:
        out = out.where(where)
    return out.withColumn("score", bm25(out, stats)).drop("_tf", "_dl")


# Raw queries: phrases in quotes, words, prefixes*, AND, OR, NOT, parentheses and NEAR(a b, n), as full-text engines read them.

_RAW = re.compile(r'"((?:[^"]|"")*)"(\s*\*)?|([()])|([^\s()"]+)')


class RawQuery:
    """A parsed raw query: ``phrases`` as (words, prefix), and ``test``, a function from their counts to a condition."""

    def __init__(self, query: str):
        self.items = [m for m in _RAW.finditer(query)]
        self.at, self.phrases, self.near = 0, [], []
        if not self.items:
            raise ValueError("no search terms")
        self.test = self._or()
        if self.at < len(self.items):
            raise ValueError(f"unexpected {self.items[self.at][0]!r}")

    def _word(self) -> str | None:
        return self.items[self.at][4] if self.at < len(self.items) else None

    def _or(self):
        out = self._and()
        while self._word() == "OR":
            self.at += 1
            out = (lambda a, b: lambda hit: a(hit) | b(hit))(out, self._and())
        return out

    def _and(self):
        out = self._not()
        while self.at < len(self.items) and self.items[self.at][3] != ")" and self._word() != "OR":
            if self._word() == "AND":
                self.at += 1
            out = (lambda a, b: lambda hit: a(hit) & b(hit))(out, self._not())
        return out

    def _not(self):
        out = self._atom()
        while self._word() == "NOT":
            self.at += 1
            out = (lambda a, b: lambda hit: a(hit) & ~b(hit))(out, self._atom())
        return out

    def _atom(self):
        if self.at >= len(self.items):
            raise ValueError("the query ends too soon")
        m = self.items[self.at]
        self.at += 1
        if m[3] == "(":
            out = self._or()
            if self.at >= len(self.items) or self.items[self.at][3] != ")":
                raise ValueError("a parenthesis is not closed")
            self.at += 1
            return out
        if m[3] or m[4] in ("AND", "OR", "NOT"):
            raise ValueError(f"unexpected {m[0]!r}")
        if m[4] == "NEAR" and self.at < len(self.items) and self.items[self.at][3] == "(":
            return self._near()
        text, prefix = (m[1].replace('""', '"'), bool(m[2])) if m[1] is not None else (m[4].rstrip("*"), m[4].endswith("*"))
        self.phrases.append((text, prefix))
        return (lambda k: lambda hit: hit(k))(len(self.phrases) - 1)

    def _near(self):
        """Words with at most n (10) others between the first and the last."""
        self.at += 1
        words = []
        while self.at < len(self.items) and self.items[self.at][3] != ")":
            m = self.items[self.at]
            words.append(m[1] if m[1] is not None else m[4])
            self.at += 1
        self.at += 1
        reach = 10
        if len(words) > 2 and words[-2].endswith(",") and words[-1].isdigit():
            reach, words = int(words[-1]), [*words[:-2], words[-2].rstrip(",")]
        first = len(self.phrases)
        self.phrases += [(w, False) for w in words]
        self.near.append((list(range(first, first + len(words))), reach))
        return (lambda k: lambda hit: hit(~k))(len(self.near) - 1)


def _prefix_count(tokens: Column, phrase: Sequence[str]) -> Column:
    k = len(phrase)

    def count(ts: Column) -> Column:
        at = F.when(F.size(ts) < k, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(ts) - k, F.lit(0))))
        return F.size(F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.get(ts, i + j) == w for j, w in enumerate(phrase[:-1])], F.get(ts, i + k - 1).startswith(phrase[-1]))))

    return T.bind(tokens, count)


def _close(tokens: Column, words: list[list[str]], reach: int) -> Column:
    """Whether some stretch holds every word with at most ``reach`` tokens between its first and its last word."""
    every = F.array(*[F.lit(w[0]) for w in words])

    def test(ts: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1)))
        span = reach + len(words)
        return F.exists(at, lambda i: F.get(ts, i - 1).isin([w[0] for w in words]) & (F.size(F.array_except(every, F.slice(ts, i, span))) == 0))

    return T.bind(tokens, test)


def raw_scores(df: DataFrame, query: str, tokenizer: Callable[[Column], Column] = T.index_tokens, where: Column | None = None) -> DataFrame:
    """Rows that a raw query matches, with ``score``."""
    q = RawQuery(query)
    toks = phrases_of(df, [t for t, _ in q.phrases], tokenizer)
    if len(toks) < len(q.phrases):
        raise ValueError("a phrase of the query has no word")
    if tokenizer is T.index_tokens and not any(prefix for _, prefix in q.phrases) and not q.near:
        toks, tokenizer = words_of(df, toks), T.tokens
    ts = tokenizer(F.coalesce(F.col("text"), F.lit("")))

    def count(x: Column) -> Column:
        tf = [_prefix_count(x, p) if prefix else phrase_count(x, p) for p, (_, prefix) in zip(toks, q.phrases)]
        near = [_close(x, [toks[k] for k in ks], reach) for ks, reach in q.near]
        return F.struct(F.size(x).alias("dl"), F.array(*tf).alias("tf"), F.array(*near).cast("array<boolean>").alias("near"))

    c = df.withColumn("_c", F.explode(F.array(T.bind(ts, count))))
    c = c.withColumns({"_dl": F.col("_c.dl"), "_tf": F.col("_c.tf"), "_near": F.col("_c.near")}).drop("_c")
    stats = statistics(c, len(toks))
    hit = lambda k: F.get("_near", F.lit(~k)) if k < 0 else F.get("_tf", F.lit(k)) > 0
    out = c.where(q.test(hit))
    if where is not None:
        out = out.where(where)
    return out.withColumn("score", bm25(out, stats)).drop("_tf", "_dl", "_near")


def with_snippets(hits: DataFrame, terms: Sequence[str], size: int = 12, stemmed: bool = True, text_col: str = "text") -> DataFrame:
    """``hits`` with ``snip``: the best stretch of ``size`` words, matches marked."""
    return hits.withColumn("snip", snippet(F.col(text_col), [re.findall(r"[^\W_]+", t) for t in terms], size, stemmed))


def fold_sessions(hits: DataFrame, limit: int, order: Sequence[Column], session_col: str = "session_id") -> DataFrame:
    """The best hit of each session with ``n_more`` further ones, best sessions first; a negative limit keeps all."""
    best = Window.partitionBy(session_col).orderBy(*order)
    d = hits.withColumns({"_k": F.row_number().over(best), "n_more": (F.count(F.lit(1)).over(Window.partitionBy(session_col)) - 1).cast("long")})
    d = d.where("_k = 1").drop("_k").orderBy(*order)
    return d.limit(limit) if limit >= 0 else d


def keyword(
    df: DataFrame, terms: Sequence[str], limit: int = 15, session: str | None = None, id_cols: Sequence[str] = ("session_id", "seq"),
    raw: str | None = None, snippet_words: int | None = None, **match,
) -> DataFrame:
    """Top hits by BM25, one row per session; within one session (a prefix of its id) every hit.

    ``raw`` is a query in its own syntax instead of terms. With ``snippet_words`` hits come with ``snip``.
    """
    if limit == 0:
        return df.where(F.lit(False)).withColumns({"score": F.lit(0.0), "n_more": F.lit(0).cast("long")})
    if session is not None:
        own = like_prefix(F.col("session_id"), session)
        match["where"] = own if match.get("where") is None else match["where"] & own
    hits = match_scores(df, terms, **match) if raw is None else raw_scores(df, raw, **match)
    order = [F.col("score"), *map(F.col, id_cols)]
    if session is not None:
        top = hits.orderBy(*order)
        out = (top.limit(limit) if limit > 0 else top).withColumn("n_more", F.lit(0).cast("long"))
    else:
        out = fold_sessions(hits.orderBy(*order).limit(FOLD_WINDOW * limit) if limit > 0 else hits, limit, order)
    if snippet_words:
        out = with_snippets(out, terms if raw is None else [t for t, _ in RawQuery(raw).phrases], snippet_words)
    return out


def keyword_or_nearest(
    turns: DataFrame, terms: Sequence[str], vectors: DataFrame, encode: Callable[[Sequence[str]], Sequence[Sequence[float]]], limit: int = 15,
    where: Column | None = None, exclude: Sequence[str] = (), tokenizer: Callable[[Column], Column] = T.index_tokens,
) -> tuple[str, DataFrame]:
    """("keyword", hits), or where no turn has the terms ("semantic", turns with the nearest vectors)."""
    hits = keyword(turns, terms, limit, where=where, exclude=exclude, tokenizer=tokenizer)
    if not hits.isEmpty():
        return "keyword", hits
    return "semantic", semantic_turns(vectors, turns, encode([" ".join(terms)])[0], limit, where, exclude, tokenizer)


# Filters over turns.


def like_contains(c: Column, part: str) -> Column:
    """ASCII case-insensitive LIKE %part%, in which % and _ of the argument stay wildcards."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like(f"%{_low(part)}%")


def like_prefix(c: Column, part: str) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like(f"{_low(part)}%")


def _low(s: str) -> str:
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in s)


def between_dates(ts: Column, after: str | None = None, before: str | None = None) -> Column:
    """ISO text times from the day ``after`` through the day ``before``, both days included (UTC)."""
    from datetime import date, timedelta

    out = F.lit(True)
    if after:
        out = out & (ts >= date.fromisoformat(after).isoformat())
    if before:
        out = out & (ts < (date.fromisoformat(before) + timedelta(days=1)).isoformat())
    return out


def with_tags(df: DataFrame, tags: DataFrame, wanted: Sequence[str], session_col: str = "session_id") -> DataFrame:
    """Rows whose session has every wanted tag; a tag without a namespace matches any."""
    for w in wanted:
        is_it = F.col("tag") == w if ":" in w else F.substring_index("tag", ":", -1) == w
        df = df.join(tags.where(is_it).select(session_col), session_col, "left_semi")
    return df


def context(hits: DataFrame, turns: DataFrame, around: int) -> DataFrame:
    """Turns of the same session at most ``around`` apart in sequence number, each hit left out of its own context."""
    near = turns.select("session_id", F.col("seq").alias("ctx_seq"), F.col("role").alias("ctx_role"), F.col("text").alias("ctx_text"))
    keys = hits.select("session_id", "seq", F.explode(F.sequence(F.col("seq") - around, F.col("seq") + around)).alias("ctx_seq")).where("ctx_seq <> seq")
    return keys.join(near, ["session_id", "ctx_seq"]).select("session_id", "seq", "ctx_seq", "ctx_role", "ctx_text")


# Fuzzy search.


def fuzzy(df: DataFrame, terms: Sequence[str], limit: int = 15, any_of: bool = False, id_cols: Sequence[str] = ("session_id", "seq")) -> DataFrame:
    """Substring search by trigram BM25; if nothing has the substrings, rows with a word one edit from a term.

    Returns (columns of ``df``, score, nearest). The relaxed pass takes the RELAXED_LIMIT best rows by the trigrams of a relaxed
    term (TRIGRAMS at most) and keeps those with a word, in the whole text, one edit from it.
    """
    terms = [t.lower() for t in terms if len(t) >= 3]
    if not terms:
        raise ValueError("fuzzy search wants terms of three or more characters")
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    c = df.withColumns({"_dl": F.greatest(F.length(low) - 2, F.lit(0)), "_tf": F.array(*[occurrences(low, t) for t in terms])})
    stats = statistics(c, len(terms))
    hit = reduce(lambda a, b: (a | b) if any_of else (a & b), [F.get("_tf", F.lit(i)) > 0 for i in range(len(terms))])
    order = list(map(F.col, id_cols))
    exact = c.where(hit).withColumn("score", bm25(c, stats)).drop("_tf", "_dl").withColumn("nearest", F.lit(False))
    if sum(stats[2]) and exact.limit(1).count():
        return exact.orderBy("score", *order).limit(limit)
    long = [t for t in terms if len(t) >= 5]
    if not long:
        return exact.limit(0)
    words = F.array_distinct(F.concat(T.turn_tokens(low), F.filter(F.split(low, r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")))
    best = []
    # All long terms at once with any_of; else one long term at a time is relaxed, the others stay whole.
    for relaxed in [set(long)] if any_of else [{t} for t in dict.fromkeys(long)]:
        parts = [[t[i : i + 3] for i in range(len(t) - 2)] if t in relaxed else [t] for t in terms]
        parts = [list(dict.fromkeys(p))[:TRIGRAMS] for p in parts]
        flat = [x for p in parts for x in p]
        c = df.withColumns({"_dl": F.greatest(F.length(low) - 2, F.lit(0)), "_tf": F.array(*[occurrences(low, x) for x in flat])})
        c = c.withColumn("_x", F.explode(F.array(F.struct("_dl", "_tf")))).withColumns({"_dl": F.col("_x._dl"), "_tf": F.col("_x._tf")}).drop("_x")
        stats, first, groups = statistics(c, len(flat)), 0, []
        for p in parts:
            groups.append(reduce(lambda a, b: a | b, [F.get("_tf", F.lit(first + k)) > 0 for k in range(len(p))]))
            first += len(p)
        met = c.where(reduce(lambda a, b: (a | b) if any_of else (a & b), groups)).withColumn("score", bm25(c, stats)).drop("_tf", "_dl")
        met = met.orderBy("score", *order).limit(RELAXED_LIMIT)
        best.append(met.where(reduce(lambda a, b: a | b, [_has_near(words, t) for t in sorted(relaxed)])))
    out = reduce(lambda a, b: a.unionByName(b), best)  # RELAXED_LIMIT rows a term at most
    if len(best) > 1:
        w = Window.partitionBy(*id_cols).orderBy("score")
        out = out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return out.withColumn("nearest", F.lit(True)).orderBy("score", *order).limit(limit)


def _has_near(words: Column, term: str) -> Column:
    return F.exists(words, lambda w: (F.abs(F.length(w) - len(term)) <= 1) & T.within_one_edit(w, F.lit(term)))


def occurrences(text: Column, part: str) -> Column:
    """Places where ``part`` begins in ``text``, overlapping ones included."""
    import re

    return F.size(F.regexp_extract_all(text, F.lit(f"(?=({re.escape(part)}))."), 0)) if len(part) > 1 else F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


# Vector search.


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def semantic(vectors: DataFrame, query: Sequence[float], limit: int, id_col: str = "turn_id", where: Column | None = None) -> DataFrame:
    """Best vectors by dot product with ``query``; vectors of another width or with a score outside [-1.001, 1.001] are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.where(F.size("vec") == len(query)).withColumn("score", dot(F.col("vec"), q)).where(F.col("score").between(-1.001, 1.001))
    if where is not None:
        d = d.where(where)
    d = d.orderBy(F.col("score").desc(), F.col(id_col))
    return d.limit(limit) if limit >= 0 else d


def semantic_turns(
    vectors: DataFrame, turns: DataFrame, query: Sequence[float], limit: int, where: Column | None = None, exclude: Sequence[str] = (),
    tokenizer: Callable[[Column], Column] = T.index_tokens,
) -> DataFrame:
    """Turns by the dot product of their vector with ``query``, under a filter on turns and without those that hold an excluded phrase."""
    d = turns if where is None else turns.where(where)
    unwanted = phrases_of(turns, exclude, tokenizer)
    if unwanted:
        c = counted(d, unwanted, tokenizer)
        d = c.where(reduce(lambda a, b: a & b, [F.get("_tf", F.lit(i)) == 0 for i in range(len(unwanted))])).drop("_tf", "_dl")
    best = semantic(vectors.select("turn_id", "vec").join(d.select("turn_id"), "turn_id", "left_semi"), query, limit).select("turn_id", "score")
    return d.join(best, "turn_id").orderBy(F.col("score").desc(), "turn_id")


def corrupt(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """(ranked, corrupt) counts for a query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    ok = (F.size("vec") == len(query)) & F.coalesce(dot(F.col("vec"), q).between(-1.001, 1.001), F.lit(False))
    return vectors.agg(F.count_if(ok).alias("ranked"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("corrupt"))
