"""The episode log and the registry of sessions, as tables that are only appended to."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPISODE = "uuid string, group_id string, name string, body string, source_description string, reference_time timestamp_ntz, created_at timestamp_ntz"
SESSION = "story_id string, group_id string, at timestamp_ntz, is_deleted boolean"


def first_present(rows: DataFrame, *names: str) -> Column:
    """The first of these columns that the table has and that isn't null."""
    have = [F.col(n).cast("string") for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def session_id(story_id: str, user_id: str = "") -> str:
    """The same for the same story and owner, on every run."""
    return f"session_{story_id}_{hashlib.sha256(f'{story_id}:{user_id}'.encode()).hexdigest()[:8]}"


def append_episodes(rows: DataFrame, path: str) -> None:
    """rows: group_id, reference_time and, under any of their names, id and body. What lacks an id gets one from its content."""
    body = F.coalesce(first_present(rows, "episode_body", "body", "fact"), F.lit(""))
    made = F.sha2(F.concat_ws("|", "group_id", F.col("reference_time").cast("string"), body), 256)
    optional = lambda n: F.col(n) if n in rows.columns else F.lit("")
    rows.select(F.coalesce(first_present(rows, "uuid", "id", "episode_id"), made).alias("uuid"), "group_id", optional("name").alias("name"), body.alias("body"), optional("source_description").alias("source_description"), F.col("reference_time").cast("timestamp_ntz").alias("reference_time"), F.col("reference_time").cast("timestamp_ntz").alias("created_at")).write.mode("append").parquet(path)


def read_episodes(spark: SparkSession, path: str, group_id: str | None = None, reference_time: str | None = None, last_n: int | None = None) -> DataFrame:
    """Episodes up to a time, the newest last_n of each group."""
    e = spark.read.schema(EPISODE).parquet(path)
    if group_id is not None:
        e = e.filter(F.col("group_id") == group_id)
    if reference_time is not None:
        e = e.filter(F.col("reference_time") <= F.lit(reference_time).cast("timestamp_ntz"))
    if last_n is None:
        return e
    w = Window.partitionBy("group_id").orderBy(F.desc("reference_time"), F.desc("uuid"))
    return e.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= last_n).drop("r")


def open_session(spark: SparkSession, path: str, story_id: str, at: str, user_id: str = "") -> str:
    group = session_id(story_id, user_id)
    spark.createDataFrame([(story_id, group)], "story_id string, group_id string").select("*", F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(False).alias("is_deleted")).write.mode("append").parquet(path)
    return group


def delete_story(spark: SparkSession, path: str, story_id: str, at: str) -> None:
    """A tombstone: the story's session is gone from `sessions`, its episodes stay in their log."""
    spark.createDataFrame([(story_id, None)], "story_id string, group_id string").select("*", F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(True).alias("is_deleted")).write.mode("append").parquet(path)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """story_id and group_id of every story whose last entry isn't a tombstone."""
    w = Window.partitionBy("story_id").orderBy(F.desc("at"), F.desc("is_deleted"))
    return spark.read.schema(SESSION).parquet(path).withColumn("r", F.row_number().over(w)).filter("r = 1 AND NOT is_deleted").select("story_id", "group_id")
