"""Words of sessions, counted in Arrow batches where their texts are read.

A grouping by Spark would sort every word of a task's stretch of rows first, as the first casing is kept next to the count. Here a stretch
holds distinct words alone, HELD of them at most, and gives them away when there are more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ship

#: (session, word) pairs that a task holds, and words whose kind it remembers.
HELD, KNOWN = 1 << 18, 1 << 18


class _Lower(dict):
    """Word to lower case."""

    def __missing__(self, w: str) -> str:
        low = w.lower()
        if len(self) < KNOWN:
            self[w] = low
        return low


def _counts(held: int = HELD):
    """(session_id, seq, text) to (session_id, low, n, seq, pos, word): how often, and where first, a stretch of rows holds a word."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, lower = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*").findall, _Lower()
        shape: list[pa.DataType] = []
        found: dict = {}  # session to word to [n, place of the row, pos, word]
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(s, low, n, at[1], pos, word) for s, mine in found.items() for low, (n, at, pos, word) in mine.items()]
            kinds = [shape[0], pa.string(), pa.int64(), shape[1], pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["session_id", "low", "n", "seq", "pos", "word"])

        for rb in batches:
            shape = [rb.schema.field(0).type, rb.schema.field(1).type]
            for k in range(0, rb.num_rows, 256):
                part = rb.slice(k, 256)
                for s, seq, text in zip(*(c.to_pylist() for c in part.columns)):
                    mine = found.setdefault(s, {})
                    at, before = (seq is not None, seq), len(mine)  # as Spark: null comes first
                    for pos, word in enumerate(find(text)):
                        low = lower[word]
                        x = mine.get(low)
                        if x is None:
                            mine[low] = [1, at, pos, word]
                            continue
                        x[0] += 1
                        if x[1] is not at and (at == x[1] and (pos, word) < (x[2], x[3]) or at != x[1] and (not at[0] or x[1][0] and at < x[1])):
                            x[1:] = at, pos, word
                    size += len(mine) - before
                    if size > held:
                        yield out()
                        found, size = {}, 0
        if shape:
            yield out()

    return go


def counted(turns: DataFrame) -> DataFrame:
    """(session_id, low, n, seq, pos, word): the words of each session by lower case.

    ``n`` counts; ``word`` is the first casing, at word ``pos`` of turn ``seq``. Each stretch of rows gives a word of its own, so group them.
    """
    ship(turns.sparkSession)
    d = turns.select("session_id", "seq", F.coalesce("text", F.lit("")).alias("text"))
    kind = {c: d.schema[c].dataType.simpleString() for c in ("session_id", "seq")}
    return d.mapInArrow(_counts(), f"session_id {kind['session_id']}, low string, n long, seq {kind['seq']}, pos int, word string")
