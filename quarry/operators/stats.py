"""Dashboard aggregates over turns and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_DAYS = 3650
LEVELS = 7


def _real(turns: DataFrame) -> DataFrame:
    return turns.where(F.coalesce(F.col("is_meta"), F.lit(0)) == 0)


def overview(turns: DataFrame) -> DataFrame:
    return _real(turns).agg(
        F.count(F.lit(1)).alias("n_turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("project").alias("n_projects"), F.countDistinct("session_id").alias("n_sessions")
    )


def by_role(turns: DataFrame) -> DataFrame:
    return _real(turns).groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"))


def by_project(turns: DataFrame) -> DataFrame:
    """Turns, sessions and the commonest directory (shortest, then first, on a tie) per project."""
    d = _real(turns)
    per = d.groupBy("project").agg(F.count(F.lit(1)).alias("n_turns"), F.countDistinct("session_id").alias("n_sessions"))
    dirs = d.where("cwd is not null").groupBy("project", "cwd").agg(F.count(F.lit(1)).alias("n"))
    best = dirs.groupBy("project").agg(F.min_by("cwd", F.struct(-F.col("n"), F.length("cwd"), "cwd")).alias("cwd"))
    return per.join(best, "project", "left").orderBy(F.col("n_turns").desc(), "project")


def daily(turns: DataFrame) -> DataFrame:
    return _real(turns).where(F.length("ts") >= 10).groupBy(F.substring("ts", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n_turns"))


def zero_filled(days: DataFrame) -> DataFrame:
    """Every day from the first through the last, at most MAX_DAYS back from the last; ``n_turns`` 0 where there is none."""
    d = days.select(F.try_to_date("day").alias("day"), "n_turns").where("day is not null")
    ends = d.agg(F.max("day").alias("hi"), F.min("day").alias("lo")).where("hi is not null")
    span = ends.select(F.explode(F.sequence(F.greatest("lo", F.date_sub("hi", MAX_DAYS - 1)), "hi")).alias("day"))
    return span.join(d, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n_turns", F.lit(0)).alias("n_turns"))


def bucketed(series: DataFrame, k: int) -> DataFrame:
    """Sums over ``k`` equal runs of a daily series (MAX_DAYS rows at most); bin i holds positions i*n/k up to (i+1)*n/k."""
    d = series.withColumn("j", F.row_number().over(Window.orderBy("day")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    bin_of = F.floor(((F.col("j") + 1) * k - 1) / F.col("n"))
    return d.groupBy(bin_of.cast("int").alias("bin")).agg(F.sum("n_turns").alias("n_turns"))


def spark_levels(bins: DataFrame) -> DataFrame:
    """0 for nothing, else 1 to 7 in proportion to the largest."""
    top = F.max("n_turns").over(Window.partitionBy())
    level = F.when(F.col("n_turns") <= 0, F.lit(0)).otherwise(F.least(F.lit(LEVELS), 1 + F.round(F.col("n_turns") / top * (LEVELS - 1))))
    return bins.withColumn("level", level.cast("int"))


def shares(counts: DataFrame, name: str, top: int = 10) -> DataFrame:
    """The ``top`` names with their share of the total, and one row for the rest. ``counts`` has one row a name."""
    total = counts.agg(F.sum("n_turns").alias("total"))
    best = counts.orderBy(F.col("n_turns").desc(), name).limit(top)
    kept = best.agg(F.count(F.lit(1)).alias("k"), F.sum("n_turns").alias("s"))
    n_all = counts.agg(F.count(F.lit(1)).alias("m"))
    t = total.first()[0] or 0
    k, s = kept.first()
    m = n_all.first()[0]
    share = lambda c: F.round(c / F.lit(float(t or 1)), 6)
    out = best.select(F.col(name).cast("string").alias("name"), "n_turns", share(F.col("n_turns")).alias("share"))
    rest = counts.sparkSession.createDataFrame([(f"{m - k} more", int(t - (s or 0)))] if m > k else [], "name string, n_turns long")
    return out.union(rest.select("name", "n_turns", share(F.col("n_turns")).alias("share")))


def facts_by_status(facts: DataFrame) -> DataFrame:
    return facts.groupBy("status").agg(F.count(F.lit(1)).alias("n_facts"), F.sum(F.when(F.col("pinned") != 0, 1).otherwise(0)).alias("n_pinned"))


def facts_by_type(facts: DataFrame) -> DataFrame:
    return facts.groupBy("type").agg(F.count(F.lit(1)).alias("n_facts"))


def coverage(turns: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """(eligible, ranked, pending): turns with text, those with a vector of the model and width, and the others."""
    have = embeddings.where((F.col("model") == model) & (F.col("dim") == dim) & (F.size("vec") == dim)).select("turn_id").distinct()
    d = turns.where(F.coalesce(F.col("text"), F.lit("")) != "").select("turn_id")
    ranked = d.join(have, "turn_id", "left_semi").agg(F.count(F.lit(1)).alias("ranked"))
    return d.agg(F.count(F.lit(1)).alias("eligible")).join(ranked).select("eligible", "ranked", (F.col("eligible") - F.col("ranked")).alias("pending"))
