"""Rows that change: a keyed table in a folder whose changes last, whose readers keep the version they opened, and whose
writers don't overwrite each other.

Rows lie in buckets by the hash of their first key, each a Parquet directory that is never changed. A version is a small file
that names the directory of every bucket. A change reads the buckets of its keys, writes them anew beside the old ones, and
then creates the next version's file; if another writer has created it first, the change is made again on what is there
now. So a change costs the buckets that it touches, and one that fails midway leaves nothing but unnamed directories.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.operators.records import rpg_delete, rpg_update, rpg_upsert

BUCKETS, TRIES = 64, 10


class LostRace(RuntimeError):
    """Another writer was first, again and again."""


class KeyedStore:
    """One kind of rows. schema: as DDL; keys: what tells rows apart, the first one (project_id) chooses the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, kind: str):
        self.spark, self.path, self.schema, self.kind = spark, path.rstrip("/"), schema, kind
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(hadoop.Path(f"{self.path}/versions"))

    def version(self) -> int:
        """The newest one; 0 before the first change."""
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/versions"))]
        return max((int(n) for n in found if n.isdigit()), default=0)

    def _buckets(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).collect()
        return json.loads(rows[0].value)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(list(self._buckets(self.version() if version is None else version).values()))

    def _publish(self, version: int, buckets: dict[str, str]) -> bool:
        """False if that version is there already."""
        target = self._path(f"{self.path}/versions/{version:012d}")
        draft = self._path(f"{self.path}/versions/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        taken = self._fs.exists(target) or not self._fs.rename(draft, target)
        if taken:
            self._fs.delete(draft, False)
        return not taken

    def change(self, projects: DataFrame, make: Callable[[DataFrame], DataFrame], before_publish: Callable[[], None] | None = None) -> int:
        """The rows of these projects (project_id), as `make` makes them of what is there; returns the new version."""
        bucket = F.pmod(F.xxhash64("project_id"), F.lit(BUCKETS)).cast("int")
        touched = sorted(str(r.b) for r in projects.select(bucket.alias("b")).distinct().collect())  # BUCKETS at most
        for _ in range(TRIES):
            seen = self.version()
            held = self._buckets(seen)
            folder = f"data-{uuid.uuid4().hex}"
            names = [f.split()[0] for f in self.schema.split(", ")]
            new = make(self._rows([held[b] for b in touched if b in held])).select(*names).withColumn("bucket", bucket)
            new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            made = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
            kept = {b: f for b, f in held.items() if b not in touched}
            kept |= {n.split("=")[1]: f"{folder}/{n}" for n in made if n.startswith("bucket=")}
            if before_publish:
                before_publish()
            if self._publish(seen + 1, kept):
                return seen + 1
        raise LostRace(f"{TRIES} changes of {self.path} came too late")

    def create(self, new: DataFrame) -> int:
        return self.change(new, lambda rows: rows.unionByName(new))

    def update(self, new: DataFrame) -> int:
        return self.change(new, lambda rows: rpg_update(rows, new, self.kind))

    def upsert(self, new: DataFrame) -> int:
        return self.change(new, lambda rows: rpg_upsert(rows, new, self.kind))

    def delete(self, project_id: str, *key: str) -> int:
        """A project's rows, or the one of a key."""
        one = self.spark.range(1).select(F.lit(project_id).alias("project_id"))
        return self.change(one, lambda rows: rpg_delete(rows, project_id, self.kind, *key))

    def replace(self, project_id: str, new: DataFrame) -> int:
        """All of one project's rows by the new ones."""
        one = self.spark.range(1).select(F.lit(project_id).alias("project_id"))
        return self.change(one, lambda rows: rpg_delete(rows, project_id).unionByName(new.filter(F.col("project_id") == project_id)))
