"""Active time over a stream of stamps, by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE = "30 minutes"


def active_windows(stamps: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(keys, start, last, n_stamps, active_ms) per stretch of work; stamps later than ``late`` behind are dropped.

    A session window ends one idle time after its last stamp, so its length less that, plus two minutes, is the
    credited time, the same as the batch operator's.
    """
    d = stamps.withWatermark(ts, late) if stamps.isStreaming else stamps
    w = d.groupBy(*keys, F.session_window(ts, IDLE).alias("w")).agg(F.count(F.lit(1)).alias("n_stamps"))
    length = F.unix_millis(F.col("w.end")) - F.unix_millis(F.col("w.start")) - 30 * 60 * 1000
    return w.select(*keys, F.col("w.start").alias("start"), (F.col("w.end") - F.expr("interval 30 minutes")).alias("last"), "n_stamps", (length + 120_000).alias("active_ms"))
