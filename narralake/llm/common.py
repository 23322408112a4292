"""Shared helpers: folders that the whole cluster sees, and Arrow batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = "16m"
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests), one of our own under /tmp/checkpoints."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        root = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_KEYS, HOT_ROWS = 1000, 10_000


def join_one(big: DataFrame, small: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join with `small`, which has one row for each key and in column `rows` how many of big's `total` rows have it.

    Keys with more than one in HOT_KEYS of all rows, so HOT_KEYS keys at most, don't go through the shuffle, where all
    their rows would meet in one task: their rows of small are broadcast.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = small.filter(F.col(rows) > bound)
    if hot.isEmpty():
        return big.join(small, on)
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(F.col(rows) <= bound), on)
    return big.join(F.broadcast(hot), on).unionByName(cold)


def bound_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that very long texts do not pile up in a Python worker.

    Python workers also get this package's folder on their path; on a cluster that doesn't share it, ship the package
    with --py-files.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    except Exception as error:  # the setting is only known to newer Spark versions
        if "CANNOT_MODIFY" not in str(error) and "not" not in str(error).lower():
            raise
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text column holds about `most` bytes, one row at least."""
    n = batch.num_rows
    if not n or batch.column(column).nbytes <= most:
        if n:
            yield batch
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i in range(n):
        if held and held + int(lengths[i]) > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(lengths[i])
    yield batch.slice(begin)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; other columns, whatever their names, never reach it."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def with_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and the whole row as one struct, so that further columns go along whatever their names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
