"""An archive whose every change is one commit.

The functions of ``maint`` turn frames into frames; here they are applied to the tables of a versioned store and committed together, so
readers see the archive before a change or after it, and of two writers from one version the later one begins again from the new one
(``tries`` times; with ``tries=1`` it is refused with ``StaleWriter``). Tables: turns, sessions, embeddings, tags, queue, forgotten.
Every version can be read until ``vacuum`` drops it, which serves as snapshot and retention.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import maint, sessions
from quarry.sources.store import Store

EMPTY = {
    "embeddings": "turn_id long, model string, vec array<float>",
    "tags": "session_id string, ns string, tag string, rank int",
    "queue": "session_id string, enqueue_seq long",
    "forgotten": "session_id string, forgotten_at string",
}


class Archive:
    def __init__(self, spark: SparkSession, folder: str, tries: int = 5):
        self.spark, self.store, self.tries = spark, Store(spark, folder), tries

    def create(self, turns: DataFrame, **tables: DataFrame) -> int:
        """The first version: turns, the sessions that they make up, and further tables, empty by default."""
        made = {k: self.spark.createDataFrame([], shape) for k, shape in EMPTY.items()} | {"turns": turns, "sessions": self._sessions(turns)} | tables
        return self.store.write(made)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.store.read(name, version)

    @property
    def version(self) -> int:
        return self.store.version()

    @staticmethod
    def _sessions(turns: DataFrame) -> DataFrame:
        return sessions.rollup(turns).withColumn("file_path", F.lit(None).cast("string"))

    def _change(self, f: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]]) -> int:
        """Commit the tables that ``f`` gives for those of the newest version; the others stay as they are."""
        return self.store.update(lambda store, m: f({k: store.read(k, m) for k in m["tables"]}), self.tries)

    def ingest(self, new: DataFrame) -> int:
        """New turns: what is stored stays, forgotten sessions stay away, sessions are rolled up anew."""

        def f(t):
            turns = maint.merge_turns(t["turns"], new, t["forgotten"])
            return {"turns": turns, "sessions": self._sessions(turns)}

        return self._change(f)

    def forget(self, session_id: str, now: str, confirm: bool = False) -> int:
        """A session leaves every table, and a tombstone keeps it away."""
        return self._change(lambda t: maint.forget(t, session_id, now, confirm))

    def redact(self) -> int:
        """Secrets masked in stored turns; vectors of changed turns go, tags of their sessions are derived again."""

        def f(t):
            turns, vectors, tags = maint.redact_apply(t["turns"], t["embeddings"], t["tags"])
            return {"turns": turns, "embeddings": vectors, "tags": tags}

        return self._change(f)

    def merge(self, other: Archive) -> int:
        """Another archive's sessions that are not local here and were not forgotten."""

        def f(t):
            s, turns = maint.merge_archives(t["sessions"], t["turns"], other.read("sessions"), other.read("turns"), t["forgotten"])
            return {"sessions": s, "turns": turns}

        return self._change(f)

    def retag(self, changed: DataFrame) -> int:
        """Tags of changed sessions, derived again from their turns."""
        return self._change(lambda t: {"tags": maint.replace_tags(t["tags"], t["turns"], changed)})

    def vacuum(self, keep: int = 7) -> list[str]:
        """Keep the newest versions alone; only then is what was forgotten or masked gone from the files too."""
        return self.store.vacuum(keep)
