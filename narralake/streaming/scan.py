"""Contradictions kept up to date: new rows are paired with each other and with the stored ones, never old with old.

Rows and pairs are Parquet tables under one folder, a directory for each batch. A batch is written under its number and reads
only smaller numbers, so a batch that is run again after a failure writes the same and counts once. Links are taken off
when findings are read: they may come before or after the rows that they join.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from narralake.operators.consistency import PAIR_RULES, PairRule

#: Rows of each source that rules pair.
SOURCES = {
    "statements": "character_id long, story_id int, knowledge_id string, content string, valid_from int, valid_to int, at long",
    "presences": "character_id long, story_id int, scene_id long, scene_order int, location_id int",
    "states": "story_id int, src long, dst long, type string, created_at int",
}


class IncrementalScan:
    """A folder of rows and pairs for some rules."""

    def __init__(self, spark: SparkSession, path: str, rules: dict[str, PairRule] = PAIR_RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules
        for kind, schema in SOURCES.items():
            empty = spark.createDataFrame([], schema)
            empty.write.mode("overwrite").parquet(self._at(kind, -1))
            for name, rule in self._of(kind).items():
                rule.pairs(empty, empty).write.mode("overwrite").parquet(self._at(f"pairs/{name}", -1))

    def _of(self, kind: str) -> dict[str, PairRule]:
        return {n: r for n, r in self.rules.items() if r.source.__name__ == kind}

    def _at(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def _rows(self, table: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def add(self, kind: str, rows: DataFrame, batch: int) -> None:
        """Takes a batch of one source's rows, numbered upwards within the source."""
        names = [f.split()[0] for f in SOURCES[kind].split(", ")]
        typed = rows.select(*[F.col(n).cast(t).alias(n) for n, t in (f.split() for f in SOURCES[kind].split(", "))])
        typed.write.mode("overwrite").parquet(self._at(kind, batch))
        new, old = self.spark.read.parquet(self._at(kind, batch)).select(names), self._rows(kind, batch).select(names)
        for name, rule in self._of(kind).items():
            pairs = rule.pairs(new, new).unionByName(rule.pairs(new, old)).unionByName(rule.pairs(old, new))
            pairs.write.mode("overwrite").parquet(self._at(f"pairs/{name}", batch))

    def follow(self, kind: str, stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """Adds every micro-batch of a stream."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.add(kind, rows, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()

    def findings(self, links: dict[str, DataFrame]) -> DataFrame:
        """What a scan of all rows finds. links: story table of links -> its rows."""
        found = None
        for name, rule in self.rules.items():
            own = rule.findings(name, self._rows(f"pairs/{name}"), links[rule.links])
            found = own if found is None else found.unionAll(own)
        return found
