"""Token ids in wavelet-matrix files: one succinct, compressed file a shard.

A shard is a run of whole documents in ascending order of their ids. Its tokens are stored as bit planes, most significant
bit first; after each plane the tokens are parted stably by that bit. Planes are cut into blocks of BLOCK bits, each
compressed by itself, with the number of ones before it. So one file answers, without decoding it whole:

* access: the token at a place (one bit a plane, following the parting),
* rank and count: how often a token stands before a place, or in all,
* select: the place of a token's j-th occurrence.

File: MAGIC, then a head (HEAD), the sections ``ids`` (the documents' ids as an Arrow stream), ``lengths`` (their tokens, unsigned 64-bit),
``table`` (per plane and block: ones before it, place and size in the file), then the blocks. All numbers are little-endian.

Files are written by the tasks that hold the documents, through pyarrow's file systems, into a folder that all share: under a name
of the attempt's own first, then moved to the shard's name, so a task that runs twice leaves the same whole file. ``write`` returns a
manifest (one row a shard), which Spark writes; only what it names is read.

Defined results: null text is empty and has the end id alone. Null ids come first; rows that repeat an id follow each other in the table's order
and are stored once each. An empty table gives an empty manifest and no file. Extra columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, tidy
from .packing import crc, encoder

MAGIC = b"QWM1"
#: documents, tokens, planes, blocks a plane, bytes of the sections ids, lengths and table.
HEAD = struct.Struct("<QQIIQQQ")
BLOCK = 1 << 15
#: A shard is closed once it holds so many tokens, so it holds at most one document more.
SHARD_TOKENS = 1 << 21
END_ID = 2
LEVEL = 1
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dump(tokens: np.ndarray, lengths: np.ndarray, ids: pa.Array) -> bytes:
    """The file of a shard: its tokens, the number of tokens of each document, and the documents' ids."""
    v = tokens.astype(np.uint32 if len(tokens) and tokens.max() > 0xFFFF else np.uint16)
    n = len(v)
    planes = int(v.max()).bit_length() if n else 0
    per = -(-n // BLOCK)
    pack = zstandard.ZstdCompressor(level=LEVEL)
    table, blocks, at = np.zeros((planes, per, 3), "<u8"), [], 0
    for p in range(planes):
        bit = (v >> (planes - 1 - p)) & 1 == 1
        raw = np.packbits(bit, bitorder="little")
        ones = np.add.reduceat(_ONES[raw], np.arange(0, len(raw), BLOCK // 8), dtype=np.int64)
        table[p, 1:, 0] = np.cumsum(ones)[:-1]
        for b in range(per):
            z = pack.compress(raw[b * BLOCK // 8 : (b + 1) * BLOCK // 8].tobytes())
            table[p, b, 1:] = at, len(z)
            at += len(z)
            blocks.append(z)
        v = np.concatenate([v[~bit], v[bit]])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
        w.write_batch(pa.record_batch([ids], names=["id"]))
    sections = [pack.compress(sink.getvalue()), pack.compress(np.asarray(lengths, "<u8").tobytes()), pack.compress(table.tobytes())]
    head = HEAD.pack(len(lengths), n, planes, per, *map(len, sections))
    return b"".join([MAGIC, head, *sections, *blocks])


class WaveletFile:
    """Reads a shard from a seekable file; blocks are fetched when asked for."""

    def __init__(self, file):
        self.file = file
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.n, self.planes, self.per, *sizes = HEAD.unpack(file.read(HEAD.size))
        self._unpack = zstandard.ZstdDecompressor()
        ids, lengths, table = (self._unpack.decompress(file.read(s)) for s in sizes)
        self.ids = pa.ipc.open_stream(ids).read_all().column(0)
        self.lengths = np.frombuffer(lengths, "<u8").astype(np.int64)
        self.table = np.frombuffer(table, "<u8").astype(np.int64).reshape(self.planes, self.per, 3)
        self.data = len(MAGIC) + HEAD.size + sum(sizes)
        self._blocks: dict[tuple[int, int], np.ndarray] = {}
        # Ones of a plane, so zeros are known without the blocks.
        self.ones = [self._rank1(p, self.n) for p in range(self.planes)]

    @property
    def starts(self) -> np.ndarray:
        """Where each document begins in the shard."""
        return np.cumsum(self.lengths) - self.lengths

    def _block(self, p: int, b: int) -> np.ndarray:
        got = self._blocks.get((p, b))
        if got is None:
            _, at, size = self.table[p, b].tolist()
            self.file.seek(self.data + at)
            got = self._blocks[p, b] = np.frombuffer(self._unpack.decompress(self.file.read(size)), np.uint8)
        return got

    def _bit(self, p: int, i: int) -> int:
        return int(self._block(p, i // BLOCK)[i % BLOCK >> 3]) >> (i & 7) & 1

    def _rank1(self, p: int, i: int) -> int:
        """Ones of a plane before place i."""
        if not i:
            return 0
        b = (i - 1) // BLOCK
        raw, rest = self._block(p, b), i - b * BLOCK
        part = int(raw[rest >> 3]) & ((1 << (rest & 7)) - 1) if rest & 7 else 0
        return int(self.table[p, b, 0]) + int(_ONES[raw[: rest >> 3]].sum(dtype=np.int64)) + int(_ONES[part])

    def _select(self, p: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) zero or one of a plane."""
        before = self.table[p, :, 0] if bit else np.arange(self.per) * BLOCK - self.table[p, :, 0]
        b = int(np.searchsorted(before, j, "right")) - 1
        bits = np.unpackbits(self._block(p, b), bitorder="little")[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[b])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            bit, r = self._bit(p, i), self._rank1(p, i)
            i = self.n - self.ones[p] + r if bit else i - r
            out = out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before place ``end`` lie after the last plane."""
        if token < 0 or token.bit_length() > self.planes:
            return 0, 0
        a, z = 0, end
        for p in range(self.planes):
            ra, rz = self._rank1(p, a), self._rank1(p, z)
            if token >> (self.planes - 1 - p) & 1:
                a, z = self.n - self.ones[p] + ra, self.n - self.ones[p] + rz
            else:
                a, z = a - ra, z - rz
        return a, z

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before place ``end``."""
        a, z = self._range(token, end)
        return z - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The place of a token's j-th occurrence, from 0."""
        a, z = self._range(token, self.n)
        if not 0 <= j < z - a:
            raise IndexError(j)
        i = a + j
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - (self.n - self.ones[p]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: from the last plane up, each parting undone."""
        v = np.zeros(self.n, np.uint32 if self.planes > 16 else np.uint16)
        for p in reversed(range(self.planes)):
            self.file.seek(self.data + int(self.table[p, 0, 1]))
            body, base = self.file.read(int(self.table[p, -1, 1:].sum() - self.table[p, 0, 1])), int(self.table[p, 0, 1])
            raw = b"".join(self._unpack.decompress(body[at - base : at - base + size]) for _, at, size in self.table[p].tolist())
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros = self.n - self.ones[p]
            up = np.empty_like(v)
            up[~bit] = v[:zeros]
            up[bit] = v[zeros:] | v.dtype.type(1 << (self.planes - 1 - p))
            v = up
        return v


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(p)


def _shards(folder: str, vocabulary: str, kind: pa.DataType, shard_tokens: int, end_id: int):
    """Sorted (id, text) of a task to files; one row a file."""
    end = np.array([end_id], "<u2").tobytes()
    names = ["part", "shard", "file", "documents", "before", "tokens"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        held, lengths, ids, size, before, shard = [], [], [], 0, 0, 0

        def close():
            nonlocal held, lengths, ids, size, before, shard
            body = dump(np.frombuffer(b"".join(held), "<u2"), np.array(lengths), pa.concat_arrays(ids))
            name = f"part-{part:06d}-{shard:06d}.qwm"
            own = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as f:
                f.write(body)
            fs.move(own, f"{base}/{name}")
            row = [part, shard, name, len(lengths), before, size]
            before, shard = before + size, shard + 1
            held, lengths, ids, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        for rb in batches:
            first = 0
            for i, t in enumerate(rb.column(1)):
                b = enc(t.as_py()) + end
                held.append(b)
                lengths.append(len(b) // 2)
                size += len(b) // 2
                if size >= shard_tokens:
                    ids.append(rb.column(0).slice(first, i + 1 - first).cast(kind))
                    first = i + 1
                    yield close()
            if first < rb.num_rows:
                ids.append(rb.column(0).slice(first).cast(kind))
        if held:
            yield close()

    return go


def write(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Write ``df`` as token files under ``folder``; returns its manifest: part, shard, file, documents, before (tokens of the part before it), tokens.

    ``folder`` is one that driver and executors share and that pyarrow's file systems reach; it holds the files and, as Parquet, ``manifest``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    ship(spark)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # Ranges of (id, row), so an id that many rows repeat is spread too; the tasks follow the ranges' order.
    d = d.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")
    go = _shards(folder, vocabulary, to_arrow_type(df.schema[id_col].dataType), shard_tokens, end_id)
    made = d.mapInArrow(tidy(go), "part long, shard long, file string, documents long, before long, tokens long")
    made.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder with ``start``, the tokens of all shards before them."""
    m = spark.read.parquet(f"{folder}/manifest")
    # A row per writing task; their running sums are a few thousand additions.
    parts = m.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    first, rows = 0, []
    for r in parts:
        rows.append((r["part"], first))
        first += r["n"]
    return m.join(F.broadcast(spark.createDataFrame(rows, "part long, first long")), "part").withColumn("start", F.col("first") + F.col("before")).drop("first")


def over_files(shards: DataFrame, folder: str, f: Callable, schema: str) -> DataFrame:
    """``f(file, start)``, a generator of record batches, over every shard of a manifest; shards are dealt out one by one."""
    spark = shards.sparkSession
    ship(spark)
    tasks = max(1, min(shards.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for name, start in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                with _open(f"{folder}/{name}") as file:
                    yield from f(WaveletFile(file), start)

    return shards.select("file", "start").repartition(tasks, "file").mapInArrow(tidy(go), schema)


def documents(shards: DataFrame, folder: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Per document from the files: id, start, n_tokens, ids_crc32."""

    def go(w: WaveletFile, start: int):
        v, at = w.tokens().astype("<u2") if w.planes <= 16 else w.tokens(), w.starts
        if w.planes <= 16:
            sums = [crc(v[a : a + k].tobytes()) for a, k in zip(at.tolist(), w.lengths.tolist())]
        else:
            import zlib

            sums = [zlib.crc32(v[a : a + k].astype("<u4").tobytes()) for a, k in zip(at.tolist(), w.lengths.tolist())]
        yield pa.RecordBatch.from_arrays([w.ids.combine_chunks(), pa.array(start + at), pa.array(w.lengths), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return over_files(shards, folder, go, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def counts(shards: DataFrame, folder: str, tokens: Sequence[int]) -> DataFrame:
    """(token, n): occurrences in all files, by two ranks a plane and file."""
    want = [int(t) for t in dict.fromkeys(tokens)]

    def go(w: WaveletFile, start: int):
        yield pa.RecordBatch.from_arrays([pa.array(want, pa.int64()), pa.array([w.count(t) for t in want], pa.int64())], names=["token", "n"])

    return over_files(shards, folder, go, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, folder: str, token: int, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """(id, place in the document, position among all tokens) of a token's occurrences, by select."""

    def go(w: WaveletFile, start: int):
        at, total = w.starts, w.count(token)
        for j in range(0, total, 4096):
            pos = np.array([w.select(token, i) for i in range(j, min(total, j + 4096))], np.int64)
            doc = np.searchsorted(at, pos, "right") - 1
            yield pa.RecordBatch.from_arrays([w.ids.combine_chunks().take(pa.array(doc)), pa.array(pos - at[doc]), pa.array(start + pos)], names=[id_col, "place", "position"])

    return over_files(shards, folder, go, f"`{id_col}` {id_type}, place long, position long")


def tokens_at(shards: DataFrame, folder: str, positions: Sequence[int]) -> DataFrame:
    """(position, token) for a stated list of places among all tokens; only files that hold one are read."""
    want = sorted({int(p) for p in positions})
    holds = F.exists(F.array(*map(F.lit, want)).cast("array<bigint>"), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("tokens")))

    def go(w: WaveletFile, start: int):
        mine = [p for p in want if start <= p < start + w.n]
        yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array([w.access(p - start) for p in mine], pa.int64())], names=["position", "token"])

    return over_files(shards.where(holds), folder, go, "position long, token long")
