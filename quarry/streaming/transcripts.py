"""Growing transcripts as a stream into a versioned store, every line once.

    ingest(spark, root, folder, checkpoint).awaitTermination()

Offsets are sizes in bytes per file: the driver lists files and opens none. A batch reads the new bytes of each file in ranges, short
ones several to a task; a line belongs to the range in which it ends, so a task looks back from its start to the line's beginning. Lines are counted per
range, and what a file had before comes from the store's table ``cursors``. Each batch is one commit of ``turns`` and ``cursors``, with
its number, so a batch that runs again changes nothing.

A file that has become shorter is read anew from its beginning; turns that are stored already stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quarry.session import ship
from quarry.sources.store import Store
from quarry.sources.transcripts import NOISE, _turns, turn_of

RANGE = 64 << 20
#: A task reads ranges of this many bytes together, or of a SHARE-th of the batch, and MANY ranges at most.
LEAST, SHARE, MANY = 1 << 20, 256, 500
BACK = 1 << 16
#: k is a turn's line in its range; the row with k = -1 has the range's number of lines instead.
SCHEMA = "path string, start long, fresh boolean, lines long, k long, uuid string, ts string, role string, text string, is_meta int, is_sidechain int, cwd string"
CURSORS = "path string, lines long"


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int, fresh: bool):
        super().__init__(0)
        self.path, self.start, self.stop, self.fresh = path, start, stop, fresh


class _Parts(InputPartition):
    def __init__(self, parts: list[_Part]):
        super().__init__(0)
        self.parts = parts

    @property
    def start(self) -> int:
        return self.parts[0].start

    @property
    def stop(self) -> int:
        return self.parts[-1].stop


def _dealt(parts: list[_Part], size: int) -> list[_Parts]:
    """Ranges as tasks: small ones go together, so that many short files are not as many tasks."""
    room = min(size, max(LEAST, sum(p.stop - p.start for p in parts) // SHARE))
    out, held = [], 0
    for p in parts:
        n = p.stop - p.start
        if not out or held + n > room or len(out[-1].parts) == MANY:
            out.append(_Parts([]))
            held = 0
        out[-1].parts.append(p)
        held += n
    return out


def line_start(f, at: int) -> int:
    """Where the line begins that place ``at`` of a file is in."""
    while at > 0:
        back = max(0, at - BACK)
        f.seek(back)
        end = f.read(at - back).rfind(b"\n")
        if end >= 0:
            return back + end + 1
        at = back
    return 0


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, noise: tuple[str, ...], size: int):
        self.root, self.noise, self.size = root, noise, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, base = pafs.FileSystem.from_uri(self.root)
        files = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        deep = base.rstrip("/").count("/") + 2
        return {f.path: f.size for f in files if f.is_file and f.path.endswith(".jsonl") and f.path.count("/") == deep and not f.base_name.startswith(".")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, stop in sorted(end.items()):
            at, fresh = start.get(path, 0), False
            if stop < at:
                at, fresh = 0, True
            out += [_Part(path, a, min(a + self.size, stop), fresh) for a in range(at, stop, self.size)]
        return _dealt(out, self.size)

    def read(self, parts: _Parts) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        for part in parts.parts:
            yield from self._range(fs, part)

    def _range(self, fs: pafs.FileSystem, part: _Part) -> Iterator[tuple]:
        with fs.open_input_file(part.path) as f:
            begin = line_start(f, part.start)
            f.seek(begin)
            # The line feed that ends a line lies in [start, stop).
            lines = f.read(part.stop - begin).split(b"\n")[:-1]
        for k, raw in enumerate(lines):
            try:
                t = turn_of(raw, self.noise)
            except ValueError:
                continue
            if t:
                yield part.path, part.start, part.fresh, 0, k, t["uuid"], t["ts"], t["role"], t["text"], 0, t["is_sidechain"], t["cwd"]
        yield part.path, part.start, part.fresh, len(lines), -1, None, None, None, None, None, None, None


class TranscriptSource(DataSource):
    """``root``: the folder of project folders; ``range``: bytes of a task. Read it through ``ingest``, which numbers, masks and caps."""

    @classmethod
    def name(cls) -> str:
        return "quarry_transcripts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["root"], NOISE, int(self.options.get("range", RANGE)))


def numbered(batch: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, new cursors) of a batch's rows, after the lines that ``cursors`` tell of."""
    ranges = batch.where("k = -1").select("path", "start", "fresh", "lines")
    w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.join(cursors.withColumnRenamed("lines", "had"), "path", "left")
    had = F.when(F.col("fresh"), F.lit(0)).otherwise(F.coalesce("had", F.lit(0)))
    ranges = ranges.withColumn("first", had + F.coalesce(F.sum("lines").over(w), F.lit(0)))
    turns = batch.where("k >= 0").join(ranges.select("path", "start", "first"), ["path", "start"]).withColumn("seq", F.col("first") + F.col("k"))
    now = ranges.groupBy("path").agg(F.max(F.col("first") + F.col("lines")).alias("lines"))
    return _turns(turns), cursors.join(now, "path", "left_anti").unionByName(now)


def ingest(spark: SparkSession, root: str, folder: str, checkpoint: str, size: int = RANGE, **trigger) -> StreamingQuery:
    """Keep the store in ``folder`` up with the transcripts under ``root``; ``trigger`` as for writeStream (all that is there now, by default)."""
    ship(spark)
    spark.dataSource.register(TranscriptSource)
    store = Store(spark, folder)

    def commit(batch: DataFrame, number: int) -> None:
        base = store.manifest()
        if base["facts"].get("batch", -1) >= number:
            return
        raw = spark.read.schema(SCHEMA).parquet(f"{folder}/{store.stage('raw', batch)}")  # read once
        old = store.read("cursors", base) if base["version"] else spark.createDataFrame([], CURSORS)
        turns, cursors = numbered(raw, old)
        if base["version"] and not raw.where("fresh").isEmpty():  # what was stored first stays
            turns = turns.join(store.read("turns", base).select("session_id", "project", "seq"), ["session_id", "project", "seq"], "left_anti").select(turns.columns)
        store.commit(
            base, put={"cursors": [store.stage("cursors", cursors)]}, add={"turns": [store.stage("turns", turns)]}, schemas={"turns": turns.schema, "cursors": cursors.schema}, facts={"batch": number}
        )

    d = spark.readStream.format(TranscriptSource.name()).option("root", root).option("range", str(size)).load()
    return d.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
