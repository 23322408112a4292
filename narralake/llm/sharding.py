"""Operator 6 [native]: shards of nearly equal bytes by sampled splitters.

Order: (hash of the text, id, place in the input), so that equal texts lie side by side. Rows are sampled with a chance
in proportion to their size; quantiles of the sample split the order into ranges, RANGES of them and more where there
are more than RANGE_ROWS rows for each. Splitters are a table of one row, an array in blocks, which every task gets as a
scalar; a row finds its range by two short lookups in it, and the plan is the same for any number of ranges. A range that
holds more than OVERFULL mean sizes and more than one row is split again by quantiles of a denser sample of itself, denser
every round, so that in the end all its rows are in the sample, until none is left. Exact sizes of the ranges and a
running sum in each give every row its place in the order of all bytes.

Groups of equal texts of more than LARGE of a shard (24 / LARGE of them at most) are placed first, the largest first,
each whole on the shard with most room; only a group that no shard has room for is split, along its order, over the
shards with most room. The other rows fill what room the shards have left, in order: a row goes to the shard that the
middle of its bytes falls in, and a group that a border cuts goes whole to the shard of its middle.

Nulls: a null text has no bytes and counts as an empty text in groups; null ids sort first. Empty tables give no rows.
Rows repeated in every column are told apart by their place in the input. Very long texts are rows like others, however
much of a shard they fill. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.llm.common import id_and_text, materialize

RANGES, RANGE_ROWS, PER_RANGE, OVERFULL, LARGE = 1024, 1 << 20, 16, 4, 0.02
KEY = ("g", "d", "place")


def _long(x: int) -> str:
    return f"CAST('{x}' AS BIGINT)"


def _lookup(keys: DataFrame) -> DataFrame:
    """keys: the splitters -> one row, x: the last splitter of each block, and the blocks. As many splitters as ranges."""
    row = keys.agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("s")).select("s", F.size("s").alias("n"), F.greatest(F.floor(F.sqrt(F.size("s"))), F.lit(1)).cast("int").alias("step"))
    heads = F.when(F.col("n") >= F.col("step"), F.transform(F.sequence(F.col("step"), F.greatest("n", "step"), F.col("step")), lambda i: F.get("s", i - 1)))
    blocks = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1)), F.col("step")), lambda i: F.slice("s", i, F.col("step"))))
    return materialize(row.select(F.struct(F.filter(F.coalesce(heads, F.array()), lambda h: h.isNotNull()).alias("heads"), F.coalesce(blocks, F.array()).alias("blocks"), "step").alias("x")), "splitters")


def _ranged(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds range: how many splitters are not beyond the row's key."""
    key, x = F.struct(*KEY), F.col("lookup")
    held = rows.withColumn("lookup", lookup.scalar())
    block = held.withColumn("block", F.size(F.filter(x["heads"], lambda h: h <= key)))
    rest = F.coalesce(F.size(F.filter(F.get(x["blocks"], F.col("block")), lambda h: h <= key)), F.lit(0))
    return block.withColumn("range", (F.col("block") * x["step"] + rest).cast("int")).drop("lookup", "block")


def _sample(rows: DataFrame, rate: float, salt: int) -> DataFrame:
    chance = F.pmod(F.xxhash64(*KEY, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(chance < F.col("size") * rate)


def _quantiles(sample: DataFrame, parts: Column) -> DataFrame:
    """Of each range, the keys that cut its sample in `parts` parts; never its first one, which would cut nothing off."""
    own = Window.partitionBy("range")
    counted = sample.select(*KEY, "range", parts.alias("parts")).withColumn("i", F.row_number().over(own.orderBy(*KEY)) - 1).withColumn("n", F.count("*").over(own))
    step = lambda i: F.floor(i * F.col("parts") / F.col("n"))
    return counted.filter((F.col("i") > 0) & (step(F.col("i")) > step(F.col("i") - 1))).select(*KEY)


def _splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Lookup table of ranges none of which is overfull but those of a single row."""
    keys = materialize(_quantiles(_sample(rows, ranges * PER_RANGE / total, 0).withColumn("range", F.lit(0)), F.lit(ranges)), "keys")
    rate, round_ = 2 * ranges * PER_RANGE / total, 1
    while True:
        lookup = _lookup(keys)
        inside = _ranged(rows, lookup)
        over = materialize(inside.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > OVERFULL * total / ranges) & (F.col("n") > 1)), "overfull")
        if over.isEmpty():
            return lookup
        parts = F.greatest(F.ceil(F.col("bytes") * ranges / total), F.lit(2))
        more = _quantiles(_sample(inside.join(F.broadcast(over), "range"), rate, round_), parts)  # overfull: ranges / OVERFULL at most
        keys = materialize(keys.unionByName(more), "keys")
        rate, round_ = rate * 4, round_ + 1


def place_groups(groups: list[tuple[int, int]], room: list[float]) -> tuple[dict[int, list[tuple[float, int]]], list[float]]:
    """groups: (key, bytes) -> ({key: [(bytes of the group up to here, shard)]}, the room that is left).

    The largest first, each on the shard with most room; one that finds no room is split over the shards with most.
    """
    left, placed = list(room), {}
    for key, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        parts, at = [], 0.0
        while at < size:
            s = max(range(len(left)), key=lambda k: (left[k], -k))
            take = size - at if size - at <= left[s] or left[s] <= 0 else left[s]
            at += take
            left[s] -= take
            parts.append((at, s))
        placed[key] = parts
    return placed, left


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, g (text hash), range, shard, slot; law: nearly equal bytes."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = id_and_text(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("g"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("d"), F.monotonically_increasing_id().alias("place"))
    rows = materialize(keyed, "keys")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    own = ("doc_id", "size", "text_crc32", "g", "range", "shard", "slot")
    if not total:
        return rows.select("*", F.lit(0).alias("range"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).select(*own)
    capacity = total / shards
    lookup = _splitters(rows, total, max(ranges, -(-count // RANGE_ROWS)))
    large = [(r.g, r.bytes) for r in rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > LARGE * capacity) & (F.col("n") > 1)).collect()]
    groups, room = place_groups(large, [capacity] * shards)
    # One row for each large group: its shard, or null where it is split.
    listed = ",".join(f"({_long(g)},{parts[0][1] if len(parts) == 1 else 'NULL'},true)" for g, parts in groups.items()) or "(0L,0,false)"
    known = spark.sql(f"SELECT g, CAST(whole AS INT) AS whole, large FROM VALUES {listed} AS t(g, whole, large)").filter("large")
    marked = materialize(_ranged(rows, lookup).join(F.broadcast(known), "g", "left").withColumn("large", F.coalesce("large", F.lit(False))), "marked")
    of_rest = F.when(F.col("large"), 0).otherwise(F.col("size"))
    sums = materialize(marked.groupBy("range").agg(F.sum("size").alias("bytes"), F.sum(of_rest).alias("rest")), "sums")
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    starts = materialize(sums.select("range", (F.sum("bytes").over(so_far) - F.col("bytes")).alias("begin"), (F.sum("rest").over(so_far) - F.col("rest")).alias("begin_rest")), "starts")
    all_rest = sums.agg(F.sum("rest")).first()[0]
    upto = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    # Where each shard's room ends along the bytes of the other rows.
    ends, filled = [], 0.0
    for r in room:
        filled += max(r, 0.0)
        ends.append(filled)
    scale = all_rest / filled if filled else 1.0
    shard_of = lambda middle: F.least(F.size(F.filter(F.array(*[F.lit(e * scale) for e in ends[:-1]]), lambda e: e <= middle)), F.lit(shards - 1)).cast("int")
    placed = marked.withColumn("before_in", F.sum("size").over(upto) - F.col("size")).withColumn("rest_in", F.sum(of_rest).over(upto) - of_rest).join(F.broadcast(starts), "range")
    placed = materialize(placed.withColumn("before", F.col("begin") + F.col("before_in")).withColumn("before_rest", F.col("begin_rest") + F.col("rest_in")).drop("begin", "begin_rest", "before_in", "rest_in").withColumn("shard", F.when(F.col("large"), F.col("whole")).otherwise(shard_of(F.col("before_rest") + F.col("size") / 2))), "placed")
    split = {g: parts for g, parts in groups.items() if len(parts) > 1}
    if split:
        first = {r.g: r.a for r in placed.filter(F.col("g").isin(list(split))).groupBy("g").agg(F.min("before").alias("a")).collect()}
        where = F.col("shard")
        for g, parts in split.items():
            middle = F.col("before") - first[g] + F.col("size") / 2
            part = F.element_at(F.array(*[F.lit(s) for _, s in parts]), F.least(F.size(F.filter(F.array(*[F.lit(float(e)) for e, _ in parts[:-1]]), lambda e: e <= middle)) + 1, F.lit(len(parts))))
            where = F.when(F.col("g") == g, part).otherwise(where)
        placed = placed.withColumn("shard", where)
    # At most shards - 1 of the other groups lie across a border.
    rest = placed.filter("NOT large")
    edges = rest.groupBy("shard").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).collect()
    cut = sorted({g for e in edges for g in (e.lo, e.hi)})
    found = rest.filter(F.col("g").isin(cut)).groupBy("g").agg(F.min("before_rest").alias("a"), F.sum("size").alias("bytes"), F.countDistinct("shard").alias("n"), shard_of(F.min("before_rest") + F.sum("size") / 2).alias("to")).filter("n > 1").collect()
    if found:
        where = F.col("shard")
        for r in found:
            where = F.when(F.col("g") == r.g, F.lit(r.to)).otherwise(where)
        placed = placed.withColumn("shard", where)
    # A range lies in few shards, so this table is about as long as that of the ranges.
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    first = materialize(counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("first")), "first")
    inner = Window.partitionBy("range", "shard").orderBy(*KEY)
    return placed.withColumn("inner", F.row_number().over(inner) - 1).join(F.broadcast(first), ["range", "shard"]).withColumn("slot", (F.col("first") + F.col("inner")).cast("long")).select(*own)
