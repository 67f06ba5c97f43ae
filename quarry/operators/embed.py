"""Vectors of turns: which are missing, one encoding per distinct text, store, word pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 2000
MAX_PIECES = 512


def pending(turns: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """Turns with text and without a vector of the model and width."""
    have = embeddings.where((F.col("model") == model) & (F.col("dim") == dim)).select("turn_id")
    return turns.where(F.coalesce(F.col("text"), F.lit("")) != "").join(have, "turn_id", "left_anti")


def _heads(turns: DataFrame) -> DataFrame:
    return turns.select("turn_id", F.substring("text", 1, HEAD).alias("head")).withColumn("h", F.sha2("head", 256))


def text_groups(turns: DataFrame) -> DataFrame:
    """(h, head, n_ids, first_id): each distinct head of text once, with how many turns have it."""
    d = turns if "head" in turns.columns else _heads(turns)
    return d.groupBy("h").agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("n_ids"), F.min("turn_id").alias("first_id"))


def backfill(turns: DataFrame, embeddings: DataFrame, encoder: Callable[[Sequence[str]], Sequence[Sequence[float]]], model: str, dim: int) -> DataFrame:
    """(turn_id, model, dim, vec) of pending turns: each distinct head of text is encoded once, and vectors get length one."""
    todo = _heads(pending(turns, embeddings, model, dim))
    texts = text_groups(todo)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"h": p["h"], "raw": [[float(v) for v in x] for x in encoder(list(p["head"]))]})

    raw = texts.mapInPandas(encode, "h string, raw array<double>")
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, v: s + v * v))
    vecs = raw.where(F.size("raw") == dim).select("h", F.transform("raw", lambda v: F.when(norm > 0, v / norm).otherwise(v).cast("float")).alias("vec"))
    return todo.join(vecs, "h").select("turn_id", F.lit(model).alias("model"), F.lit(dim).alias("dim"), "vec")


def store(embeddings: DataFrame, new: DataFrame, turns: DataFrame) -> DataFrame:
    """Vectors replaced by newer ones of the same turn and model; only turns that still exist take new ones. Of several new ones of a turn the greatest counts."""
    new = new.join(turns.select("turn_id"), "turn_id", "left_semi")
    rest = [c for c in new.columns if c not in ("turn_id", "model")]
    new = new.groupBy("turn_id", "model").agg(F.max(F.struct(*sorted(rest, key="vec".__ne__))).alias("_v")).select("turn_id", "model", "_v.*")
    return embeddings.join(new.select("turn_id", "model"), ["turn_id", "model"], "left_anti").select(*embeddings.columns).unionByName(new.select(*embeddings.columns))


def purge_models(embeddings: DataFrame, model: str) -> DataFrame:
    return embeddings.where(F.col("model") == model)


def word_pieces(text: str, vocab: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """Lower-case words without accents, split greedily into the longest pieces of a vocabulary; a word that cannot be split is unknown."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    words, cur = [], ""
    for c in plain:
        if c.isspace() or unicodedata.category(c) == "Cc":
            words.append(cur)
            cur = ""
        elif unicodedata.category(c)[0] == "P" or c.isascii() and not c.isalnum() or "一" <= c <= "鿿":
            words += [cur, c]
            cur = ""
        else:
            cur += c
    out = []
    for w in filter(None, [*words, cur]):
        at, pieces = 0, []
        while at < len(w) and len(w) <= longest:
            end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocab), at)
            if end == at:
                break
            pieces.append(("##" if at else "") + w[at:end])
            at = end
        out += pieces if at == len(w) else [unknown]
    return out[:MAX_PIECES]


def pieces(text: Column, vocab: dict[str, int]) -> Column:
    """``word_pieces`` of a column."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else word_pieces(t, vocab))

    return cut(text)
