"""JSONL transcripts and markdown leaves as tables.

A transcript is ``root/<project>/<session>.jsonl``, one record a line. ``seq`` is the line's place in the file, blank and
broken lines included; a tail without a line end waits for the next read. Files of any size are read in ranges of bytes, as Spark
splits them (``spark.sql.files.maxPartitionBytes``): lines are counted per range, and sums over a file's ranges give their numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.redact import redact
from quarry.functions.text import cap
from quarry.session import ship

TOOL_USE_CAP, TOOL_RESULT_CAP, THINKING_CAP, RECORD_CAP = 300, 500, 2000, 8000
# Wrappers that a machine wrote. Callers add the headers of their own injections.
NOISE = ("<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-stderr>")
RECORD = "seq long, uuid string, ts string, role string, text string, is_meta int, is_sidechain int, cwd string"


def spaced_json(v) -> str:
    """JSON with ", " and ": " and keys in order."""
    return json.dumps(v, ensure_ascii=False, sort_keys=True)


def _cut(s: str, n: int) -> str:
    return s[:n] + "…" if len(s) > n else s


def result_text(v) -> str:
    """The text of a tool result, which may be a string, blocks, an object or any value."""
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        parts = [x if isinstance(x, str) else x["text"] for x in v if isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str)]
        return "\n".join(parts)
    if isinstance(v, dict) and isinstance(v.get("text"), str):
        return v["text"]
    return spaced_json(v)


def flatten(record) -> tuple[str, str] | None:
    """(role, text) of a record, not yet masked or capped; None where it is no turn."""
    if not isinstance(record, dict) or record.get("type") not in ("user", "assistant") or record.get("isMeta") is True:
        return None
    msg = record.get("message") if isinstance(record.get("message"), dict) else {}
    role = msg["role"] if isinstance(msg.get("role"), str) else record["type"]
    content, parts = msg.get("content"), []
    if isinstance(content, str):
        parts.append(content.strip())
    for b in content if isinstance(content, list) else []:
        if not isinstance(b, dict):
            continue
        kind = b.get("type")
        said = lambda k, b=b: b[k].strip() if isinstance(b.get(k), str) else ""
        if kind == "text":
            parts.append(said("text"))
        elif kind == "thinking":
            parts.append(_cut(said("thinking"), THINKING_CAP))
        elif kind == "tool_use":
            name = b["name"] if isinstance(b.get("name"), str) else "tool"
            given = b.get("input")
            parts.append(f"⚙ {name} {_cut(spaced_json({} if given is None else given), TOOL_USE_CAP)}")
        elif kind == "tool_result":
            body = result_text(b.get("content")).strip()
            parts.append(f"↪ {_cut(body, TOOL_RESULT_CAP)}" if body else "")
    text = "\n".join(p for p in parts if p).strip()
    return (role, text) if text else None


def turn_of(raw: bytes, noise: tuple[str, ...] = NOISE) -> dict | None:
    """The turn of a line, not yet masked or capped; None where it has none. Raises ValueError where it is no JSON."""
    raw = raw.strip()
    if not raw:
        return None
    rec = json.loads(raw.decode("utf-8", "replace"))
    got = flatten(rec)
    if got is None or got[1].startswith(noise):
        return None
    word = lambda k: rec[k] if isinstance(rec.get(k), str) else None
    return {"uuid": word("uuid"), "ts": word("timestamp"), "role": got[0], "text": got[1], "is_meta": 0, "is_sidechain": int(rec.get("isSidechain") is True), "cwd": word("cwd")}


def records(content: bytes, first_seq: int = 0, noise: tuple[str, ...] = NOISE) -> tuple[list[dict], int, int, int]:
    """(turns, bytes read, lines read, lines that are no JSON) of the complete lines of a file's content."""
    end = content.rfind(b"\n") + 1
    lines = content[:end].split(b"\n")[:-1]
    out, broken = [], 0
    for k, raw in enumerate(lines):
        try:
            turn = turn_of(raw, noise)
        except ValueError:
            broken += 1
            continue
        if turn:
            out.append({"seq": first_seq + k} | turn)
    return out, end, len(lines), broken


def _named(d: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return d.withColumns({"session_id": F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""), "project": F.element_at(parts, -2)})


def read_transcripts(spark: SparkSession, root: str, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """Turns of every transcript one level under each project folder, secrets masked."""
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.jsonl").text(f"{root}/*/")
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_metadata.file_size")
    lines = raw.select(F.col("value").cast("binary").alias("raw"), at[0].alias("path"), at[1].alias("start"), at[2].alias("size"))
    # Lines and bytes of each range; a range's lines stand together, so within it they are numbered as they come.
    ranges = lines.groupBy("path", "start", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"))
    w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    ranges = ranges.withColumns({"first": F.coalesce(F.sum("n").over(w), F.lit(0)), "every": F.sum("bytes").over(whole), "last": F.sum("n").over(whole)})
    # With one byte more than the file has, its last line has no end yet and waits.
    ranges = ranges.select("path", "start", "first", (F.col("last") - F.when(F.col("every") > F.col("size"), 1).otherwise(0)).alias("complete"))
    ship(spark)
    shape = "k long, uuid string, ts string, role string, text string, is_meta int, is_sidechain int, cwd string, path string, start long"
    d = lines.select("raw", "path", "start").mapInArrow(_numbered(noise), shape).join(ranges, ["path", "start"])
    d = d.withColumn("seq", F.col("k") + F.col("first")).where(F.col("seq") < F.col("complete"))
    return _turns(d)


def _numbered(noise: tuple[str, ...]):
    """Lines with their place in their range, as turns; what is no turn is counted only."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k = None, 0
        for rb in batches:
            out: dict[str, list] = {c: [] for c in ("k", "uuid", "ts", "role", "text", "is_meta", "is_sidechain", "cwd", "path", "start")}
            for raw, path, start in zip(*(c.to_pylist() for c in rb.columns)):
                at, k = ((path, start), 0) if at != (path, start) else (at, k + 1)
                try:
                    turn = turn_of(raw, noise)
                except ValueError:
                    continue
                if turn:
                    for c, v in (turn | {"k": k, "path": path, "start": start}).items():
                        out[c].append(v)
            kinds = {"k": pa.int64(), "start": pa.int64(), "is_meta": pa.int32(), "is_sidechain": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()], names=list(out))

    return go


def _turns(d: DataFrame) -> DataFrame:
    text = cap(redact(F.col("text")), RECORD_CAP)
    return _named(d).select("session_id", "seq", "uuid", "ts", "role", text.alias("text"), "is_meta", "is_sidechain", "project", "cwd")


def write_files(files: DataFrame, folder: str) -> None:
    """Write (path, content) as files under ``folder``, at the last two parts of their paths; the folder is one that all share."""

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        for rb in parts:
            for path, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                parent, name = path.split("/")[-2:]
                fs.create_dir(f"{base}/{parent}", recursive=True)
                own = f"{base}/{parent}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write(content)
                fs.move(own, f"{base}/{parent}/{name}")
            yield pa.RecordBatch.from_arrays([rb.column(0)], names=["path"])

    files.select("path", "content").mapInArrow(go, "path string").write.format("noop").mode("overwrite").save()


def parse_files(files: DataFrame, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(path, content as binary) of transcripts to their turns, secrets masked, then capped."""

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in RECORD.split(", ")]
        for p in parts:
            for path, content in zip(p["path"], p["content"]):
                rows = records(bytes(content), 0, noise)[0]
                if rows:
                    yield pd.DataFrame(rows, columns=cols).assign(path=path)

    ship(files.sparkSession)
    return _turns(files.mapInPandas(go, f"{RECORD}, path string"))


def list_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, session_id, project) of the transcripts."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*/")
    return _named(d.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))).orderBy("path")


def read_leaves(spark: SparkSession, folder: str, index: str = "MEMORY.md") -> DataFrame:
    """(leaf_path, content, error) of a folder's markdown files but the index; a file that is no UTF-8 has an error and no content."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    text = F.col("content").cast("string")
    fine = F.is_valid_utf8(text)
    d = d.select(F.element_at(F.split("path", "/"), -1).alias("leaf_path"), F.when(fine, text).alias("content"), F.when(~fine, F.lit("no valid UTF-8")).alias("error"))
    return d.where(F.col("leaf_path") != index)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of an index file."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def write_index(rendered: DataFrame, folder: str) -> None:
    """One text file a project under folder/project=..."""
    rendered.select("project", F.regexp_replace("content", r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy("project").text(folder)


EVENT = "prompt string, cwd string, session_id string, source string, transcript_path string"


def read_events(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """The fields of JSON event payloads; a payload that is no JSON object, or a field that is no text, is null. ``fresh`` marks the starts of a session."""
    one = F.from_json(col, EVENT)
    d = payloads.withColumn("_e", one)
    fields = [F.col(f"_e.{c.split()[0]}").alias(c.split()[0]) for c in EVENT.split(", ")]
    return d.select(*[c for c in payloads.columns if c != col], *fields).withColumn("fresh", F.coalesce(F.col("source").isin("startup", "clear"), F.lit(False)))
