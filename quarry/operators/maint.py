"""Maintenance as functions from frames to frames: ingest merge, queue, forget, merge of archives, re-masking, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.redact import redact
from quarry.operators import tags


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, size, mtime) to read: those whose size or time differs from the state, or that were not read to the end."""
    done = state.where("num_turns > 0").select(F.col("file_path").alias("path"), F.col("file_size").alias("size"), F.col("file_mtime").alias("mtime")).where("scan_offset = file_size")
    return listing.join(done, ["path", "size", "mtime"], "left_anti")


def merge_turns(stored: DataFrame, new: DataFrame, forgotten: DataFrame | None = None) -> DataFrame:
    """Stored turns and those new ones whose (session, seq) is not there; of equal new ones that of the earliest time, then text, wins."""
    if forgotten is not None:
        new = new.join(forgotten.select("session_id"), "session_id", "left_anti")
    rest = [c for c in new.columns if c not in ("session_id", "seq")]
    first = F.min_by(F.struct(*rest), F.struct(F.coalesce("ts", F.lit("")), F.coalesce("text", F.lit(""))))
    new = new.groupBy("session_id", "seq").agg(first.alias("_f")).select("session_id", "seq", "_f.*")
    return stored.unionByName(new.join(stored.select("session_id", "seq"), ["session_id", "seq"], "left_anti").select(*stored.columns))


def conflicts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Why a strict re-read must be refused: (session_id, seq, why), changed text or a record that came to be filtered."""
    spans = new.groupBy("session_id").agg(F.lit(1).alias("_read"))
    old = stored.join(spans.select("session_id"), "session_id", "left_semi").select("session_id", "seq", F.col("text").alias("old"))
    high = old.groupBy("session_id").agg(F.max("seq").alias("high"))
    both = old.join(new.select("session_id", "seq", F.col("text").alias("new")), ["session_id", "seq"], "full_outer").join(high, "session_id", "left")
    why = F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new")), "changed").when(F.col("new").isNull(), "gone").when(
        F.col("old").isNull() & (F.col("seq") < F.col("high")), "inserted"
    )
    return both.select("session_id", "seq", why.alias("why")).where("why is not null")


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Session rows merged by id: spans widen, a directory is kept once known, cursors only grow unless the file shrank."""
    o = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    pick = lambda c: F.max_by(c, "_new").alias(c)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c)
    shrank = F.max_by("file_size", "_new") < F.min_by("file_size", "_new")
    grow = lambda c: F.when(shrank, F.max_by(c, "_new")).otherwise(F.max(c)).alias(c)
    return o.groupBy("session_id").agg(
        *[known(c) for c in ("file_path", "project", "cwd")], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), pick("num_turns"), grow("last_seq"),
        pick("file_size"), pick("file_mtime"), F.max("checkpointed_seq").alias("checkpointed_seq"), grow("scan_offset"), grow("scan_seq"), pick("skipped_lines"), pick("partial_tail"), pick("ingested_at"),
    )


def refresh_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Session rows with rollups counted anew from their turns."""
    r = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.max("seq").alias("_s"), F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    d = sessions.join(r, "session_id", "left")
    return d.withColumns({"num_turns": F.coalesce("_n", F.lit(0)).cast("long"), "last_seq": F.coalesce("_s", F.lit(-1)).cast("long"), "first_ts": F.col("_a"), "last_ts": F.col("_b")}).select(*sessions.columns)


def enqueue_gate(asked: DataFrame, sessions: DataFrame, turns: DataFrame, queue: DataFrame) -> DataFrame:
    """(session_id, state): pruned (no typed turn, or unknown), unchanged, duplicate (queued already) or queued."""
    people = turns.where("role = 'user' and coalesce(is_sidechain, 0) = 0").select("session_id").distinct().withColumn("_u", F.lit(True))
    last = turns.groupBy("session_id").agg(F.max("seq").alias("_last"))
    d = asked.select("session_id").distinct().join(sessions.select("session_id", "checkpointed_seq", F.lit(True).alias("_s")), "session_id", "left")
    d = d.join(people, "session_id", "left").join(last, "session_id", "left").join(queue.select("session_id", F.lit(True).alias("_q")), "session_id", "left")
    state = (
        F.when(F.col("_s").isNull() | F.col("_u").isNull(), "pruned").when(F.col("_last") <= F.coalesce("checkpointed_seq", F.lit(-1)), "unchanged").when(F.col("_q").isNotNull(), "duplicate").otherwise("queued")
    )
    return d.select("session_id", state.alias("state"))


def sweep_gate(changed: DataFrame, sessions: DataFrame, turns: DataFrame, queue: DataFrame) -> DataFrame:
    """Changed sessions that have turns past their checkpoint and are not queued."""
    last = turns.groupBy("session_id").agg(F.max("seq").alias("_last"))
    d = changed.select("session_id").distinct().join(queue, "session_id", "left_anti").join(last, "session_id").join(sessions.select("session_id", "checkpointed_seq"), "session_id", "left")
    return d.where(F.col("_last") > F.coalesce("checkpointed_seq", F.lit(-1))).select("session_id")


def enqueue(queue: DataFrame, gate: DataFrame, now: str) -> DataFrame:
    """The queue with the gate's queued sessions, numbered on from its end. The queue is small state."""
    top = queue.agg(F.coalesce(F.max("enqueue_seq"), F.lit(0))).first()[0]
    fresh = gate.where("state = 'queued'").select("session_id", F.lit(now).alias("enqueued_at"), (F.row_number().over(Window.orderBy("session_id")) + top).cast("long").alias("enqueue_seq"))
    return queue.unionByName(fresh)


def pending(queue: DataFrame, sessions: DataFrame) -> DataFrame:
    """The queue, newest first, with what is known of each session."""
    return queue.join(sessions.select("session_id", "project", "last_ts", "num_turns"), "session_id", "left").orderBy(F.col("enqueue_seq").desc())


def drop(queue: DataFrame, sessions: DataFrame, session_id: str, boundary: int | None = None, abandon: bool = False) -> tuple[DataFrame, DataFrame]:
    """(queue, sessions) after a session was worked through up to ``boundary``, which may not pass its last turn."""
    row = sessions.where(F.col("session_id") == session_id).select("last_seq").first()
    if row is None:
        raise ValueError(f"no session {session_id}")
    if boundary is not None and boundary > row[0]:
        raise ValueError(f"boundary {boundary} is past the last turn {row[0]}")
    if boundary is None and not abandon:
        raise ValueError("a boundary is wanted, or abandon")
    mark = F.greatest("checkpointed_seq", F.lit(boundary).cast("long")) if boundary is not None else F.col("checkpointed_seq")
    s = sessions.withColumn("checkpointed_seq", F.when(F.col("session_id") == session_id, mark).otherwise(F.col("checkpointed_seq")))
    keep = boundary is not None and boundary < row[0] and not abandon
    return (queue if keep else queue.where(F.col("session_id") != session_id)), s


def mark_current(queue: DataFrame, sessions: DataFrame, facts: DataFrame, session_id: str, no_facts: bool = False) -> tuple[DataFrame, DataFrame]:
    """A session is done once a fact names it as its origin, or by word that it holds none."""
    if not no_facts and not facts.where(F.col("origin_session") == session_id).limit(1).count():
        raise ValueError("no fact has this session as its origin; say no_facts if it holds none")
    row = sessions.where(F.col("session_id") == session_id).select("last_seq").first()
    if row is None:
        raise ValueError(f"no session {session_id}")
    return drop(queue, sessions, session_id, row[0])


def clear(queue: DataFrame, confirm: bool = False) -> DataFrame:
    """The empty queue; one that holds sessions is cleared on confirmation alone."""
    if not confirm and not queue.isEmpty():
        raise ValueError("clearing the queue wants confirm")
    return queue.limit(0)


def queue_counts(queue: DataFrame, sessions: DataFrame, now: str, idle_s: int = 600) -> DataFrame:
    """(pending, live, waiting): queued sessions, those written within ``idle_s``, and the others."""
    d = queue.select("session_id").join(sessions.select("session_id", "last_ts"), "session_id", "left")
    live = F.coalesce(_age(now) < idle_s, F.lit(False))
    return d.agg(F.count(F.lit(1)).alias("pending"), F.count_if(live).alias("live"), F.count_if(~live).alias("waiting"))


def _age(now: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.lit(now))) - F.unix_timestamp(F.try_to_timestamp("last_ts"))


def forget(tables: dict[str, DataFrame], session_id: str, now: str, confirm: bool = False) -> dict[str, DataFrame]:
    """Archive tables without a session, and its tombstone. Vectors go with their turns."""
    if not confirm:
        raise ValueError("forgetting wants confirm")
    out = {k: v.where(F.col("session_id") != session_id) for k, v in tables.items() if k not in ("embeddings", "forgotten")}
    gone = tables["turns"].where(F.col("session_id") == session_id).select("turn_id")
    out["embeddings"] = tables["embeddings"].join(gone, "turn_id", "left_anti")
    tomb = tables["forgotten"].sparkSession.createDataFrame([(session_id, now)], "session_id string, forgotten_at string")
    out["forgotten"] = tables["forgotten"].where(F.col("session_id") != session_id).unionByName(tomb)
    return out


def plain_name(c: Column) -> Column:
    """A project name that is one path part."""
    return ~c.isin("", ".", "..") & ~c.rlike(r"[/\\]")


def merge_archives(sessions: DataFrame, turns: DataFrame, other_sessions: DataFrame, other_turns: DataFrame, forgotten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) with the other archive's sessions that have turns, are not local here and were not forgotten; secrets masked again."""
    local = sessions.where("file_path is not null").select("session_id").union(forgotten.select("session_id")).distinct()
    take = other_sessions.where(plain_name(F.col("project"))).join(other_turns.select("session_id").distinct(), "session_id", "left_semi").join(local, "session_id", "left_anti")
    new_turns = other_turns.join(take.select("session_id"), "session_id", "left_semi").withColumn("text", redact(F.col("text")))
    merged = merge_turns(turns, new_turns)
    fresh = take.join(sessions.select("session_id"), "session_id", "left_anti").withColumn("file_path", F.lit(None).cast("string")).select(*sessions.columns)
    changed = take.select("session_id")
    kept = sessions.join(changed, "session_id", "left_anti")
    again = refresh_sessions(sessions.join(changed, "session_id", "left_semi").unionByName(fresh), merged)
    return kept.unionByName(again), merged


def replace_tags(stored: DataFrame, turns: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored tags, with those of changed sessions (session_id) derived again from their turns."""
    changed = changed.select("session_id").distinct()
    again = tags.derive(turns.join(changed, "session_id", "left_semi"))
    return stored.join(changed, "session_id", "left_anti").select("session_id", "ns", "tag", "rank").unionByName(again)


def redact_apply(turns: DataFrame, embeddings: DataFrame, stored_tags: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Turns with secrets masked, vectors without those of turns that changed, and with ``stored_tags`` those of their sessions derived again."""
    d = turns.withColumn("_r", redact(F.col("text")))
    stale = d.where(~F.col("_r").eqNullSafe(F.col("text"))).select("turn_id", "session_id")
    new = d.withColumn("text", F.col("_r")).select(*turns.columns)
    out = new, embeddings.join(stale.select("turn_id"), "turn_id", "left_anti")
    return out if stored_tags is None else (*out, replace_tags(stored_tags, new, stale))


def backoff_seconds(failures: Column) -> Column:
    """An hour, doubled per further failure, a day at most."""
    return F.least(F.lit(86_400).cast("long"), (F.lit(3600) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(10)))).cast("long"))


def distill_picks(queue: DataFrame, sessions: DataFrame, now: str, limit: int = 3, idle_s: int = 600) -> DataFrame:
    """Queued sessions to work on: newest first, not live within ``idle_s``, read to their end."""
    d = queue.join(sessions, "session_id").where((_age(now) >= idle_s) & (F.coalesce("partial_tail", F.lit(0)) == 0))
    return d.orderBy(F.col("enqueue_seq").desc()).limit(limit).select("session_id", "enqueue_seq")


def distill_proof(before: DataFrame, after: DataFrame, facts: DataFrame, session_id: str, start: str, end: str, report: str) -> tuple[str, str]:
    """What a session's distilling proved: ("saved", ""), ("no_op", "") or ("rejected", why).

    ``before`` and ``after`` are (leaf_path, content) of the leaves; each changed leaf wants a fact of the session, or one updated between
    ``start`` and ``end``. Without a change the worker's report must say that it saved nothing.
    """
    hashed = lambda d, name: d.select("leaf_path", F.sha2(F.col("content"), 256).alias(name))
    d = hashed(after, "new").join(hashed(before, "old"), "leaf_path", "full_outer")
    changed = d.where(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).select("leaf_path")
    own = facts.where((F.col("origin_session") == session_id) | F.col("updated_at").between(start, end)).select("leaf_path")
    if not changed.isEmpty():
        orphan = changed.join(own, "leaf_path", "left_anti").orderBy("leaf_path").first()
        return ("saved", "") if orphan is None else ("rejected", f"changed leaf {orphan[0]} has no fact row")
    if not d.where("new is null").isEmpty():
        return "rejected", "leaf deleted during distill"
    said = any(re.fullmatch(r"SESSION_TOTAL: saved 0, updated [0-9]+", x) for x in report.splitlines())
    return ("no_op", "") if said else ("rejected", "missing exact no-op report")


def distill_finish(queue: DataFrame, sessions: DataFrame, turns: DataFrame, session_id: str, boundary: int) -> tuple[str, DataFrame, DataFrame]:
    """(state, queue, sessions) after proof: deferred while turns are missing or unread, dropped at the last turn, kept if more came."""
    last = turns.where(F.col("session_id") == session_id).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    row = sessions.where(F.col("session_id") == session_id).select(F.coalesce("skipped_lines", F.lit(0)) + F.coalesce("partial_tail", F.lit(0))).first()
    if row is None or last < boundary or row[0]:
        return "deferred", queue, sessions
    hit = F.col("session_id") == session_id
    mark = F.greatest(F.coalesce("checkpointed_seq", F.lit(-1)), F.lit(boundary)).cast("long")
    s = sessions.withColumn("checkpointed_seq", F.when(hit, mark).otherwise(F.col("checkpointed_seq")))
    return ("dropped", queue.where(~hit), s) if last == boundary else ("kept", queue, s)


VERSION = 8


def read_snapshot(spark: SparkSession, path: str, version: int = VERSION) -> dict[str, DataFrame]:
    """The tables of a snapshot by name; a snapshot of a newer version is refused."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory() and not s.getPath().getName().startswith("_"))
    found = spark.read.text(f"{path}/_version").first() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_version")) else None
    if found is not None and int(found[0]) > version:
        raise ValueError(f"the snapshot has version {found[0]}, newer than {version}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def snapshot_due(spark: SparkSession, root: str, now: str, hours: int = 24) -> bool:
    """Whether the newest snapshot under ``root`` (names are ISO times or days) is ``hours`` old, or there is none."""
    from datetime import datetime, timedelta

    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    stamps = [s.getPath().getName() for s in fs.listStatus(base) if not s.getPath().getName().startswith(".")] if fs.exists(base) else []
    parse = lambda x: datetime.fromisoformat(x.replace("Z", "")).replace(tzinfo=None)
    return not stamps or parse(now) - parse(max(stamps)) >= timedelta(hours=hours)


def snapshot(tables: dict[str, DataFrame], root: str, stamp: str, keep: int = 7) -> str:
    """Write every table under root/stamp (by way of a temporary name) and keep the newest ``keep`` snapshots."""
    spark = next(iter(tables.values())).sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    base = path_of(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/.tmp-{stamp}/{name}")
    spark.createDataFrame([(str(VERSION),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/.tmp-{stamp}/_version")
    final = path_of(f"{root}/{stamp}")
    fs.delete(final, True)
    if not fs.rename(path_of(f"{root}/.tmp-{stamp}"), final):
        raise OSError(f"cannot move the snapshot to {root}/{stamp}")
    stamps = sorted(s.getPath().getName() for s in fs.listStatus(base) if not s.getPath().getName().startswith("."))
    for old in stamps[:-keep] if keep > 0 else []:
        fs.delete(path_of(f"{root}/{old}"), True)
    return f"{root}/{stamp}"
