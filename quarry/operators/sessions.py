"""Sessions: rollups, listings, dumps, last-session card, prompt and reply trails, id resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators.search import between_dates, like_contains


def rollup(turns: DataFrame) -> DataFrame:
    """Per session: first and last time, number of turns, last sequence number, and any directory."""
    return turns.groupBy("session_id", "project").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("num_turns"), F.max("seq").alias("last_seq"), F.max("cwd").alias("cwd")
    )


def overlaps(after: str | None = None, before: str | None = None) -> Column:
    """Sessions whose span touches the days from ``after`` through ``before``."""
    out = F.lit(True)
    if after:
        out = out & between_dates(F.col("last_ts"), after)
    if before:
        out = out & between_dates(F.col("first_ts"), None, before)
    return out


def listing(sessions: DataFrame, tags: DataFrame | None = None, project: str | None = None, after: str | None = None, before: str | None = None, limit: int = 20) -> DataFrame:
    """Newest sessions first, with their tags in namespace and rank order."""
    d = sessions.where(overlaps(after, before))
    if project:
        d = d.where(like_contains(F.col("project"), project))
    same_day = T.date10(F.col("first_ts")) == T.date10(F.col("last_ts"))
    end = F.when(same_day, F.substring(T.fmt_ts(F.col("last_ts")), 12, 5)).otherwise(T.fmt_ts(F.col("last_ts")))
    d = d.withColumn("span", F.concat(T.fmt_ts(F.col("first_ts")), F.lit("–"), end))
    d = d.orderBy(F.col("last_ts").desc_nulls_last(), "session_id")
    d = d.limit(limit) if limit >= 0 else d
    if tags is not None:
        d = d.join(_in_order(tags.join(d.select("session_id"), "session_id", "left_semi")), "session_id", "left")
    return d


def _in_order(tags: DataFrame) -> DataFrame:
    """(session_id, tags): tools, extensions, topics, each by rank. A session has some thirty tags at most."""
    place = F.when(F.col("ns") == "tool", 0).when(F.col("ns") == "ext", 1).otherwise(2)
    return tags.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "rank", "tag"))), lambda x: x["tag"]).alias("tags"))


def dump(turns: DataFrame, session_id: str, since: int = -1) -> DataFrame:
    """The turns of a session after ``since``, in order."""
    return turns.where((F.col("session_id") == session_id) & (F.col("seq") > since)).orderBy("seq").select("seq", "role", "text")


def dump_header(turns: DataFrame, tags: DataFrame, session_id: str) -> DataFrame:
    """(session_id, boundary, num_turns, tags) of a dump; no row for an unknown session."""
    one = turns.where(F.col("session_id") == session_id).groupBy("session_id").agg(F.max("seq").alias("boundary"), F.count(F.lit(1)).alias("num_turns"))
    return one.join(_in_order(tags.where(F.col("session_id") == session_id)), "session_id", "left")


def boundary(turns: DataFrame) -> DataFrame:
    """Last sequence number per session."""
    return turns.groupBy("session_id").agg(F.max("seq").alias("boundary"))


def resolve(sessions: DataFrame, given: str) -> DataFrame:
    """(status, session_id): exact, prefix, ambiguous (ten rows at most) or none."""
    exact = sessions.where(F.col("session_id") == given).select("session_id").limit(1).collect()
    if exact:
        rows = [("exact", given)]
    else:
        found = [r[0] for r in sessions.where(F.substring("session_id", 1, len(given)) == given).select("session_id").distinct().orderBy("session_id").limit(11).collect()] if given else []
        rows = [("none", None)] if not found else [("prefix", found[0])] if len(found) == 1 else [("ambiguous", x) for x in found[:10]]
    return sessions.sparkSession.createDataFrame(rows, "status string, session_id string")


_INJECTED = ("↪", "<")


def typed_prompt() -> Column:
    """A prompt somebody typed, for trails and cards."""
    t = F.col("text")
    bad = t.startswith(_INJECTED[0]) | t.startswith(_INJECTED[1]) | F.lower(t).startswith("[request interrupted") | F.lower(t).startswith("this session is being continued")
    return (F.col("role") == "user") & (F.coalesce(F.col("is_sidechain"), F.lit(0)) == 0) & ~bad


def timed_prompt() -> Column:
    """A prompt that counts as activity; interruptions do."""
    t = F.col("text")
    bad = t.startswith(_INJECTED[0]) | t.startswith(_INJECTED[1]) | t.startswith("This session is being continued")
    return (F.col("role") == "user") & (F.coalesce(F.col("is_sidechain"), F.lit(0)) == 0) & ~bad


def reply() -> Column:
    return (F.col("role") == "assistant") & (F.coalesce(F.col("is_sidechain"), F.lit(0)) == 0) & ~F.col("text").startswith("⚙")


def exchanges(turns: DataFrame) -> DataFrame:
    """Each typed prompt with the last reply before the next one; the reply is null where there is none."""
    d = turns.where(typed_prompt() | reply()).withColumn("_p", typed_prompt().cast("int"))
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_n", F.sum("_p").over(w)).where("_n > 0")
    last = F.max_by(F.when(F.col("_p") == 0, F.col("text")), F.when(F.col("_p") == 0, F.col("seq")))
    return d.groupBy("session_id", "_n").agg(
        F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"), F.min_by("text", "seq").alias("prompt"), last.alias("reply")
    ).drop("_n")


def card(turns: DataFrame, sessions: DataFrame, project: str, live: str | None = None, source: str = "startup") -> DataFrame:
    """First typed prompt and last reply of the newest other session of a project; nothing unless the session starts afresh."""
    if source not in ("startup", "clear"):
        return sessions.sparkSession.createDataFrame([], "session_id string, last_ts string, prompt string, reply string")
    mine = turns.join(sessions.where(F.col("project") == project).select("session_id", "last_ts"), "session_id")
    if live is not None:
        mine = mine.where(F.col("session_id") != live)
    per = mine.groupBy("session_id", "last_ts").agg(
        F.min_by(F.when(typed_prompt(), F.col("text")), F.when(typed_prompt(), F.col("seq"))).alias("prompt"),
        F.max_by(F.when(reply(), F.col("text")), F.when(reply(), F.col("seq"))).alias("reply"),
    )
    return per.where("prompt is not null").orderBy(F.col("last_ts").desc_nulls_last(), "session_id").limit(1)
