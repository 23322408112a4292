"""Operator 12: hard negatives by a Voronoi-partitioned distributed kNN join on inner products.

Components become the integers floor(scale * x). With an extra component sqrt(M - |x|^2) for candidates (M: the largest
squared length) and 0 for anchors, the largest inner products are the smallest distances, |a|^2 + M - 2 a.x, so that
distance bounds hold.

1. PIVOTS rows, the first by a hash of their id, are pivots; every candidate goes to the cell of its nearest one and keeps
   its distance to it. Anchors, each in the cell it lies nearest to, form groups of GROUP at most: neighbouring small cells
   together, large cells in parts.
2. Each group compares its own anchors with each other, which are rows like others: what an anchor finds there bounds the
   score that a better row must have, and so its distance D. A candidate of cell j can serve anchor a only if its distance
   to pivot j is d(a, j) - D at least; the least of these over a group is the group's bound for the cell.
3. A candidate is sent to the groups whose bound for its cell it reaches, and to no others; a group's candidates are dealt
   over slices, which get the group's anchors too. In a slice all scores are computed, in blocks, and the best kept; the
   best of all slices are merged. Where the bounds prune nothing this is a block join of the anchors with all rows.

It runs twice: for the positives (the same label), and, with their scores known, for the negatives (other labels, scores
in each positive's band). Both are exact: sums stay under 2^53 in doubles, else they are taken in 64-bit integers.

Rows with a null id, label or vector, with a null or non-finite component, or whose scaled vector's squared length isn't
under 2^62 (its scores need not fit a long) take no part. Shorter vectors count as if filled up with zeros. Of several rows of
one id the least by label and vector counts, so repeated rows count once. Ties go to the smaller id. An empty table, or
one without anchors, gives no rows. Texts play no part; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.llm.common import bound_arrow, materialize

PIVOTS, GROUP, SLICE, BLOCK, BOUNDS = 64, 4096, 1 << 14, 256, 200_000
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """id, label, x (integers), norm (squared length): one row for each id that takes part."""
    v = F.col(vector_col)
    odd = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~F.exists("v", odd))
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + F.floor(scale * e.cast("double")).cast("double") * F.floor(scale * e.cast("double")).cast("double"))
    fit = rows.withColumn("norm", norm).filter(F.col("norm") < float(1 << 62))
    whole = fit.select("id", "label", F.transform("v", lambda e: F.floor(scale * e.cast("double")).cast("int")).alias("x"), "norm")
    return whole.groupBy("id").agg(F.min(F.struct("label", "x", "norm")).alias("r")).select("id", "r.label", "r.x", "r.norm")


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(-1, dims)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact, as 64-bit integers."""
    most = max(((m.astype(np.float64) ** 2).sum(axis=1).max() if len(m) else 0.0) for m in (a, b))
    if most < float(1 << 52):
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, bands: np.ndarray, k: int) -> list[np.ndarray]:
    """For each band (lo, hi) the places of the first k allowed rows in it, the largest score first, then the smallest id."""
    inside = np.flatnonzero(allowed & (scores >= bands[:, 0].min()) & (scores <= bands[:, 1].max()))
    order = inside[np.lexsort((ids[inside], -scores[inside]))]
    found = -scores[order]
    return [order[(at := np.searchsorted(found, -hi)) : at + k][scores[order[at : at + k]] >= lo] for lo, hi in bands.tolist()]


class _Plan:
    """What the tasks need: pivots, the largest squared length, and whether the search wants the anchor's own label."""

    def __init__(self, pivots: np.ndarray, top: float, k: int, same: bool):
        self.pivots, self.top, self.k, self.same = pivots, top, k, same
        self.dims = pivots.shape[1] - 1

    def allowed(self, anchors: pd.DataFrame, i: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        own = labels == anchors["label"].iat[i]
        return (own if self.same else ~own) & (ids != anchors["id"].iat[i])

    def each(self, anchors: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(anchor's place, its scores, its bands, the best of each band)."""
        a = _matrix(anchors["x"].tolist(), self.dims)
        for begin in range(0, len(a), BLOCK):
            block = _scores(a[begin : begin + BLOCK], x)
            for i in range(len(block)):
                bands = np.stack([np.asarray(anchors["lo"].iat[begin + i], np.int64), np.asarray(anchors["hi"].iat[begin + i], np.int64)], axis=1)
                yield begin + i, block[i], bands, best(block[i], ids, self.allowed(anchors, begin + i, ids, labels), bands, self.k)

    def bounds(self, key: tuple, anchors: pd.DataFrame) -> pd.DataFrame:
        """The group's bound for every cell: the least distance to the pivot from which a candidate can serve an anchor."""
        a = _matrix(anchors["x"].tolist(), self.dims)
        reach = np.full(len(a), -np.inf)
        for i, scores, bands, found in self.each(anchors, anchors["id"].to_numpy(), anchors["label"].to_numpy(), a):
            least = [scores[f[-1]] if len(f) == self.k else lo for f, (lo, _) in zip(found, bands.tolist(), strict=True)]
            reach[i] = float(min(least))
        length = (a.astype(np.float64) ** 2).sum(axis=1)
        far = np.sqrt(np.maximum(length + self.top - 2 * reach, 0))
        to = np.sqrt(np.maximum(length[:, None] + self.top - 2 * (a @ self.pivots[:, :-1].T), 0))
        slack = 1e-6 * (1 + np.sqrt(self.top + length.max()))  # of rounding
        return pd.DataFrame({"group": key[0], "cell": np.arange(len(self.pivots), dtype=np.int32), "bound": (to - far[:, None]).min(axis=0) - slack})

    def join(self, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int]] = []
        if len(anchors) and len(rows):
            ids, own = rows["id"].to_numpy(), anchors["id"].to_numpy()
            for i, scores, bands, found in self.each(anchors, ids, rows["label"].to_numpy(), _matrix(rows["x"].tolist(), self.dims)):
                out += [(own[i], lo, hi, ids[p], scores[p]) for (lo, hi), places in zip(bands.tolist(), found, strict=True) for p in places]
        return pd.DataFrame(out, columns=["anchor_id", "lo", "hi", "id", "score"]).astype(np.int64)


def _cells(rows: DataFrame, pivots: np.ndarray, top: float, every: int) -> DataFrame:
    """id, label, x (bytes), anchor, cell and dist of the candidate, near: the cell that the row as an anchor lies nearest to."""
    dims = pivots.shape[1] - 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.zeros((b.num_rows, dims), "<i4")
            lists = b.column(2)
            lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            x[np.arange(dims)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            plain = x.astype(np.float64) @ pivots[:, :-1].T
            extra = np.sqrt(np.maximum(top - (x.astype(np.float64) ** 2).sum(axis=1), 0))
            square = np.maximum(2 * top - 2 * (plain + extra[:, None] * pivots[None, :, -1]), 0)
            cell = square.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(square[np.arange(len(cell)), cell])), pa.array(plain.argmax(axis=1).astype(np.int32))], ["id", "label", "x", "cell", "dist", "near"])

    return rows.select("id", "label", "x").mapInArrow(assign, "id long, label long, x binary, cell int, dist double, near int").withColumn("anchor", F.col("id") % every == 0)


def _groups(anchors: DataFrame, most: int) -> DataFrame:
    """Adds group: cells one after another until `most` anchors are together; a larger cell in parts by a hash of the id."""
    counts = sorted((r.near, r["count"]) for r in anchors.groupBy("near").count().collect())  # a row for each pivot at most
    plan, group, held = [], 0, 0
    for cell, n in counts:
        if held and held + n > most:
            group, held = group + 1, 0
        parts = -(-n // most)
        plan.append((cell, group, parts))
        group, held = (group + parts - 1, 0 if parts > 1 else held + n)
        group += parts > 1
    table = F.create_map(*[x for cell, first, parts in plan for x in (F.lit(cell), F.struct(F.lit(first).alias("first"), F.lit(parts).alias("parts")))])
    at = F.element_at(table, F.col("near"))
    return anchors.withColumn("group", (at["first"] + F.pmod(F.xxhash64("id"), at["parts"])).cast("int"))


def _search(anchors: DataFrame, rows: DataFrame, plan: _Plan, n_rows: int) -> DataFrame:
    """anchors: id, label, x, group, lo, hi (arrays: bands of scores) -> anchor_id, lo, hi, id, score, place: the first k of each band."""
    spark = rows.sparkSession
    bounds = materialize(anchors.groupBy("group").applyInPandas(lambda key, own: plan.bounds(key, own), "group int, cell int, bound double"), "bounds")
    slices = max(-(-n_rows // SLICE), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidates = rows.select("id", "label", "x", "cell", "dist", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"))
    if bounds.count() <= BOUNDS:
        sent = candidates.join(F.broadcast(bounds), "cell")
    else:
        salts = 32
        salted = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        sent = candidates.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(salts)).cast("int")).join(salted, ["cell", "salt"])
    sent = sent.filter(F.col("dist") >= F.col("bound")).select("group", "slice", "id", "label", "x")
    dealt = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("group", "slice", "id", "label", "x", "lo", "hi")
    found = dealt.groupBy("group", "slice").cogroup(sent.groupBy("group", "slice")).applyInPandas(lambda key, own, more: plan.join(own, more), "anchor_id long, lo long, hi long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "lo", "hi").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= plan.k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, pivots: int = PIVOTS, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: ids divisible by `every`. A negative
    has another label and low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    bound_arrow(spark)
    rows = materialize(scaled_rows(vectors, id_col, vector_col, label, scale), "scaled")
    top, dims, n_rows = rows.agg(F.max("norm"), F.max(F.size("x")), F.count("*")).first()
    if not n_rows:
        return spark.createDataFrame([], _RESULT)
    first = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("x").collect()  # `pivots` rows
    p = np.zeros((len(first), dims + 1))
    for i, r in enumerate(first):
        p[i, : len(r.x)] = r.x
    p[:, -1] = np.sqrt(np.maximum(top - (p**2).sum(axis=1), 0))
    rows = materialize(_cells(rows, p, float(top), every), "cells")
    anchors = rows.filter("anchor")
    if anchors.isEmpty():
        return spark.createDataFrame([], _RESULT)
    anchors = materialize(_groups(anchors.select("id", "label", "x", "near"), group).select("id", "label", "x", "group"), "anchors")
    all_ = lambda bound: F.array(F.lit(bound)).cast("array<bigint>")
    found = _search(anchors.select("*", all_(-(1 << 62)).alias("lo"), all_(1 << 62).alias("hi")), rows, _Plan(p, float(top), positives, True), n_rows)
    near = materialize(found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda percent, more: F.expr(f"(positive_score div 100) * {percent}L + ((positive_score % 100) * {percent}L + {more}L) div 100")
    near = near.withColumn("lo", share(low, 99)).withColumn("hi", share(high, 0))
    exact = near.filter("positive_score >= 0").select("anchor_id", "lo", "hi").distinct()
    bands = exact.groupBy("anchor_id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("b")).select(F.col("anchor_id").alias("id"), "b.lo", "b.hi")  # at most `positives` of an anchor
    wanted = materialize(anchors.join(bands, "id"), "bands")
    if wanted.isEmpty():
        return spark.createDataFrame([], _RESULT)
    kept = _search(wanted.select("id", "label", "x", "group", "lo", "hi"), rows, _Plan(p, float(top), negatives, False), n_rows)
    kept = kept.select("anchor_id", "lo", "hi", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
    return near.filter("positive_score >= 0").join(kept, ["anchor_id", "lo", "hi"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for op12's contract: all scores of the anchors, then both rankings.
SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, list_dot_product(a.x, b.x)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT own AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
