"""Operator 8: near-duplicates by MinHash bands, confirmed on whole shingle sets, joined to components.

1. Each text's distinct word shingles are hashed; HASHES universal functions give its minima. Texts with equal sets
   form one class, and only a class's least document goes on.
2. Every BAND of the first minima make a bucket key (BANDS of them). Of each bucket the member that lies in the most crowded
   buckets overall is the pivot; all members are compared with it on their whole sets. Most links of a group of copies
   come from that, one comparison a member. A pivot's members are dealt to groups of about MEMBERS, each of which gets
   the pivot's set once; crowded buckets are kept out of the joins' shuffles.
3. Buckets that still hold several components are compared for the rest: members outside the pivot's component against
   all others, in blocks, by the share of equal minima (ESTIMATE or more, in the first band that both share), and what
   passes on whole sets. Pairs inside one component are never formed.
4. Large-star and small-star give the components.
A pair of similarity 0.8 shares no band with a chance of 4.6e-8, and falls short of ESTIMATE with one of 1e-7 (HASHES
minima of 8 bits have a standard deviation of 0.0125, ESTIMATE lies 5.2 of them below); higher similarities are lost far
more rarely. Only the members of buckets that stay open get these sketches. The residual blocks grow with (members
outside the pivot's component) times (members), the price of
missing no link there.

Nulls: a null id takes no part and is its own component (null); texts without words are linked with nothing. Empty
tables give no rows; rows repeated under one id share its component. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralake.llm.common import bound_arrow, id_and_text, join_one, materialize, slices
from narralake.llm.components import components
from narralake.llm.shingles import shingle_sets

BANDS, BAND, HASHES, BLOCK, ESTIMATE, MEMBERS = 32, 4, 1024, 256, 0.735, 4096
_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(found: np.ndarray, bounds: np.ndarray, count: int = HASHES) -> np.ndarray:
    """The first `count` minima for each set that isn't empty, by multiply-add functions modulo 2**32."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(short * a + b, bounds) for a, b in zip(_A[:count], _B[:count], strict=True)], axis=1)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                found, bounds = shingle_sets(batch.column(1), k)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                keys, sigs = ([None] * len(sizes) for _ in range(2))
                if len(full):
                    table = minima(found, bounds[full], BANDS * BAND)
                    for row, d in enumerate(full):
                        keys[d] = hashlib.blake2b(found[bounds[d] : bounds[d + 1]].tobytes(), digest_size=16).digest()
                        sigs[d] = table[row].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=kind)

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, sig binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    kind = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                found, bounds = shingle_sets(batch.column(1), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], schema=kind)

    return docs.mapInArrow(sets, "id long, shingles binary")


def _sketches(sets: DataFrame) -> DataFrame:
    """The low bytes of all HASHES minima of each set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                rows = batch.column(1).to_pylist()
                bounds = np.concatenate([[0], np.cumsum([len(r) // 8 for r in rows])])
                table = minima(np.frombuffer(b"".join(rows), np.uint64), bounds[:-1]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in table], pa.binary())], ["id", "sketch"])

    return sets.select("id", "shingles").mapInArrow(sketch, "id long, sketch binary")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * common >= percent * union, of sorted distinct values."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike. b's set goes to a's group of its salt, of about MEMBERS, a's set once to each of these groups."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, salt, b, shingles) come sorted by group, a's own with b null first; one set of a is held at a time."""
        group, own = None, None
        for batch in batches:
            left, right = [], []
            for a, salt, b, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = np.frombuffer(held.as_buffer(), np.uint64)
                if b is None:
                    group, own = (a, salt), found.copy()
                elif group == (a, salt) and _alike(own, found, percent):
                    left.append(min(a, b))
                    right.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=kind)

    groups = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / MEMBERS).cast("int")), "groups")
    dealt = join_one(pairs, groups, ["a"], "n", pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "shingles")
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(confirm, "a long, b long").distinct()


def _compare_block(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, band: int, sketch: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block pair with enough equal minima, of different components, if this is the first band they share. Side 1 meets side 2, side 0 meets itself."""
    out = []
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    for i in left:
        others = right[(comp[right] != comp[i]) & ((side[right] == 2) | (ids[right] > ids[i]))]
        if not len(others):
            continue
        close = others[(sketch[others] == sketch[i]).sum(axis=1) >= ESTIMATE * HASHES]
        if len(close) and band:
            close = close[~(keys[close, :band] == keys[i, :band]).any(axis=1)]
        if len(close):
            other = ids[close]
            out.append((np.minimum(other, ids[i]), np.maximum(other, ids[i])))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, bucket, i, j, id, component, side, sketch, keys) come sorted by block pair; one block pair is held at a time."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[pa.RecordBatch] = []

    def groups() -> Iterator[pa.Table]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(4)):
                yield pa.Table.from_batches(held)
                held.clear()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                held.append(batch.slice(x, y - x))
                if y < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held.clear()
        if held:
            yield pa.Table.from_batches(held)

    for group in groups():
        if group.num_rows < 2:
            continue
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(group.num_rows, HASHES)
        keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, BANDS)
        out = _compare_block(*(group[c].to_numpy() for c in ("id", "component", "side")), group["band"][0].as_py(), sketch, keys)
        if out:
            yield pa.RecordBatch.from_arrays([np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])], schema=kind)


def near_components(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id; null ids are kept); one row for each row of docs."""
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = id_and_text(docs, id_col, text_col)
    signed = materialize(_signatures(texts, k), "signatures")
    some = signed.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes")
    least = classes.select("id").distinct()
    # A repeated id may have several texts: each class keeps its own signature, the id joins them.
    owned = some.join(classes.withColumnRenamed("id", "least"), "set_key").filter("doc_id = least").dropDuplicates(["set_key"])
    sigs = materialize(owned.select(F.col("doc_id").alias("id"), "sig"), "reps")
    bands = sigs.select("id", F.posexplode(F.array(*[F.xxhash64(F.substring("sig", 4 * BAND * b + 1, 4 * BAND), F.lit(b)) for b in range(BANDS)])).alias("band", "bucket"))
    crowd = materialize(bands.groupBy("band", "bucket").agg(F.count("*").alias("m")).filter("m > 1"), "crowd")
    banded = BANDS * sigs.count()
    members = materialize(join_one(bands, crowd, ["band", "bucket"], "m", banded), "members")
    weight = materialize(members.groupBy("id").agg(F.sum("m").alias("w")), "weight")
    pivots = materialize(members.join(weight, "id").groupBy("band", "bucket").agg(F.max(F.struct("w", (-F.col("id")).alias("minus"))).alias("top"), F.count("*").alias("n")).select("band", "bucket", (-F.col("top.minus")).alias("pivot"), "n"), "pivots")
    pairs = materialize(join_one(members, pivots, ["band", "bucket"], "n", banded).filter("id <> pivot").groupBy(F.least("id", "pivot").alias("lo"), F.greatest("id", "pivot").alias("hi")).agg(F.max("pivot").alias("a")).select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b")), "pairs")
    sets = materialize(_sets(texts.join(weight.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), k), "sets")
    links = materialize(_confirmed(pairs, sets, percent), "links")
    comps = materialize(components(links), "components")
    # What is left: buckets with several components.
    named = materialize(members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
    left = named.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band", "bucket")
    first = pivots.join(left, ["band", "bucket"], "left_semi").join(comps.withColumnRenamed("component", "main"), F.col("pivot") == F.col("id"), "left").select("band", "bucket", F.coalesce("main", "pivot").alias("main"), "n")
    first = materialize(first, "left")
    open_ = materialize(join_one(named, first, ["band", "bucket"], "n", banded).drop("n").withColumn("rest", F.col("component") != F.col("main")).drop("main"), "open")
    counts = materialize(open_.groupBy("band", "bucket").agg(F.ceil(F.sum(F.col("rest").cast("int")) / BLOCK).cast("int").alias("nr"), F.ceil(F.sum((~F.col("rest")).cast("int")) / BLOCK).cast("int").alias("nm"), F.count("*").alias("n")), "blocks")
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("rest"), F.col("nr")).otherwise(F.greatest("nm", F.lit(1)))).cast("int")
    # Rest blocks i <= j meet each other, and every rest block meets every main block. Side 1: the lesser rest block, 2: the other block, 0: both.
    own = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"), F.when(j == F.col("block"), 0).when(j > F.col("block"), 1).otherwise(2).alias("side")))
    with_main = F.when(F.col("nm") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("nm"), F.lit(1)) - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    as_main = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j"), F.lit(2).alias("side")))
    dealt = join_one(open_, counts, ["band", "bucket"], "n", banded).withColumn("block", block).select("band", "bucket", "id", "component", F.explode(F.when(F.col("rest"), F.concat(own, with_main)).otherwise(as_main)).alias("x")).select("band", "bucket", "id", "component", "x.i", "x.j", "x.side")
    block_pair = ["band", "bucket", "i", "j"]
    sketches = _sketches(sets.join(open_.select("id").distinct(), "id", "left_semi")).join(sigs, "id").select("id", "sketch", F.array(*[F.pmod(F.xxhash64(F.substring("sig", 4 * BAND * b + 1, 4 * BAND), F.lit(b)), F.lit((1 << 31) - 1)).cast("int") for b in range(BANDS)]).alias("keys"))
    close = dealt.join(sketches, "id").select(*block_pair, "id", "component", "side", "sketch", "keys").repartition(*block_pair).sortWithinPartitions(*block_pair).mapInArrow(_compare, "a long, b long")
    more = materialize(_confirmed(materialize(close.distinct(), "close"), sets, percent), "more")
    if not more.isEmpty():
        comps = materialize(components(links.unionAll(more)), "components")
    of_class = materialize(classes.join(comps, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id")), "of_class")
    joined = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
