"""Alerts for users, each delivered once: a sink by user with a ledger of batches, and reading on from an offset.

Every batch is one directory, partitioned by user and written under its number, so that a batch that is run again replaces
itself. The ledger gets the number when the directory is whole; readers take only batches of the ledger. An alert's offset is
(batch, number within the batch and user), so a client that lost its connection reads on behind the last one it has.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ALERT = "event_id long, reason string, severity string, alert_type string, detected_at timestamp, seq int, batch long, user_id string"


class Inbox:
    """A folder with the users' alerts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], "batch long").write.mode("overwrite").parquet(f"{self.path}/ledger/part=-1")
        spark.createDataFrame([], ALERT).drop("batch").write.mode("overwrite").partitionBy("user_id").parquet(f"{self.path}/alerts/batch=-1")

    def deliver(self, alerts: DataFrame, batch: int) -> None:
        """alerts: user_id and the columns of ALERT; numbered by event id among a user's alerts of the batch. An alert that
        occurs twice in a batch, or stands in an earlier batch of the ledger, isn't delivered again."""
        own = [c.split()[0] for c in ALERT.split(", ")[:-3]]
        new = alerts.filter("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("user_id"), *own).dropDuplicates(["user_id", "event_id"])
        had = self._delivered(batch).select("user_id", "event_id")
        fresh = new.join(had, ["user_id", "event_id"], "left_anti")
        numbered = fresh.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
        numbered.repartition("user_id").write.mode("overwrite").partitionBy("user_id").parquet(f"{self.path}/alerts/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch long").write.mode("overwrite").parquet(f"{self.path}/ledger/part={batch}")

    def _delivered(self, before: int | None = None) -> DataFrame:
        done = self.spark.read.schema("batch long, part long").parquet(f"{self.path}/ledger").select("batch")
        done = done if before is None else done.filter(F.col("batch") < before)
        return self.spark.read.schema(ALERT).option("basePath", f"{self.path}/alerts").parquet(f"{self.path}/alerts").join(done, "batch", "left_semi")

    def follow(self, alerts: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """Delivers every micro-batch of a stream of enriched alerts."""
        return alerts.writeStream.foreachBatch(self.deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()

    def read(self, user_id: str, after: tuple[int, int] = (-1, 0)) -> DataFrame:
        """One user's alerts behind an offset, in order of offsets; other users' directories aren't opened."""
        batch, seq = after
        mine = self._delivered().filter(F.col("user_id") == user_id)
        return mine.filter((F.col("batch") > batch) | ((F.col("batch") == batch) & (F.col("seq") > seq))).orderBy("batch", "seq")
