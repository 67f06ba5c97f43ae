"""The driver's tables as archive tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_folder as workspace  # noqa: F401  queries call it so


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns of eight projects, one session an hour and one turn a minute; some are meta or a side chain, some in a subdirectory."""
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    project = F.concat(F.lit("p"), (F.col("conv_id") % 8).cast("string"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", "text", project.alias("project"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), (F.col("turn") % 7 == 6).cast("int").alias("is_meta"), (F.col("turn") % 5 == 4).cast("int").alias("is_sidechain"),
        F.concat(F.lit("/home/me/work/team/"), project, F.when(F.col("turn") % 3 == 1, F.lit("/sub")).otherwise(F.lit(""))).alias("cwd"),
    )


TURNS_SQL = """turns AS (SELECT conv_id * 1000 + turn AS turn_id, conv_id::VARCHAR AS session_id, turn AS seq, role, text, 'p' || (conv_id % 8) AS project,
  strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, (turn % 7 = 6)::INT AS is_meta, (turn % 5 = 4)::INT AS is_sidechain,
  '/home/me/work/team/p' || (conv_id % 8) || CASE WHEN turn % 3 = 1 THEN '/sub' ELSE '' END AS cwd FROM conversations)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stamps: session is the user, project the type."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("project"), "ts", "event_id")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as curated facts: brand is the project, part type the hook, price the recency."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ("feedback", "user", "project", "reference", "note")))
    key = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("project"), F.concat(F.lit("part_"), key.cast("string"), F.lit(".md")).alias("leaf_path"), F.col("p_name").alias("title"), F.col("p_name").alias("name"), F.col("p_type").alias("hook"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"), F.get(kinds, (key % 5).cast("int")).alias("type"), key.alias("index_seq"), (key % 17 == 0).cast("int").alias("pinned"),
        F.when(key % 11 == 0, F.lit("archived")).otherwise(F.lit("active")).alias("status"), F.lit(None).cast("string").alias("superseded_at"), (key % 7).alias("hits"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("updated_at"),
    )


FACTS_SQL = """facts AS (SELECT p_brand AS project, 'part_' || p_partkey || '.md' AS leaf_path, p_name AS title, p_name AS name, p_type AS hook, p_name || ' ' || p_type AS description,
  (['feedback', 'user', 'project', 'reference', 'note'])[(p_partkey % 5) + 1] AS type, p_partkey AS index_seq, (p_partkey % 17 = 0)::INT AS pinned,
  CASE WHEN p_partkey % 11 = 0 THEN 'archived' ELSE 'active' END AS status, p_partkey % 7 AS hits, strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d') AS updated_at FROM part)"""
