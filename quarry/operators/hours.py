"""Active time: stamps at most half an hour apart are one stretch of work.

The first stamp and each one after a longer pause is worth two minutes, the others the time since the one
before. Timelines, of a key or of all, are cut into days first: stamps are ordered inside (key, day), and the gaps over the
days' edges come from one row a day, so a busy key or the merged timeline is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IDLE_MS = 30 * 60 * 1000
CREDIT_MS = 2 * 60 * 1000


def millis(ts: Column) -> Column:
    """Milliseconds, rounded, of a timestamp with or without a zone (UTC)."""
    return F.round(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def credited(df: DataFrame, keys: list[str], ms: str = "ms") -> DataFrame:
    """(keys, n_stamps, active_ms); without keys one row, for all stamps on one timeline."""
    stamps = df.groupBy(*keys, F.col(ms).alias("_ms")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", F.floor(F.col("_ms") / 86_400_000))
    worth = lambda gap: F.when(gap <= IDLE_MS, gap).otherwise(F.lit(CREDIT_MS))
    gap = F.col("_ms") - F.lag("_ms").over(Window.partitionBy(*keys, "_day").orderBy("_ms"))
    inner = stamps.withColumn("_w", F.when(gap.isNull(), F.lit(0)).otherwise(worth(gap)))
    days = inner.groupBy(*keys, "_day").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.min("_ms").alias("_lo"), F.max("_ms").alias("_hi"))
    edge = F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_day"))
    return days.withColumn("_e", worth(edge)).groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_stamps"), F.coalesce(F.sum(F.col("_w") + F.col("_e")), F.lit(0)).cast("long").alias("active_ms")
    )


def merged(df: DataFrame, ms: str = "ms") -> DataFrame:
    """(n_stamps, active_ms) of all stamps on one timeline."""
    return credited(df, [], ms)


def in_month(ts: Column, month: str, tz: str = "UTC") -> Column:
    """Whether a time falls in a month (YYYY-MM) of a time zone."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), tz), "yyyy-MM") == month


def month_report(prompts: DataFrame, month: str, keys: list[str], tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Active time per key and merged, over the prompts of a month."""
    d = prompts.where(in_month(F.col("ts"), month, tz)).withColumn("ms", millis(F.col("ts")))
    return credited(d, keys), merged(d)
