"""Joins that an equi join on one key would turn into all pairs of the key: by order in time, and by containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.plans.storage import written

SLOTS, LEAST_ROWS, MOST_CELLS, BUCKETS = 512, 2000, 1000, 1 << 20
#: Keys of a block, runs of a block, and runs of a table that is broadcast as runs (under 1 MB).
BLOCK, BLOCK_RUNS, MOST_RUNS = 1 << 16, 16, 20_000


def crowded(rows: DataFrame, keys: list[str], least: int = LEAST_ROWS) -> bool:
    """Whether some key may have more than `least` rows: rows are counted by a short hash of the key, so that this moves next
    to nothing. A chance meeting of keys, or more rows than BUCKETS can tell apart, says yes too."""
    counts = rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return not counts.filter(F.col("n") > least).isEmpty()


def among(rows: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Rows whose whole number `column` is a key of the table. Keys that follow each other are told as runs, cut at blocks and
    broadcast, so that the rows stay where they are; a table of too many runs is joined by its keys."""
    block = lambda x: F.expr(f"{x} div {BLOCK}")
    keys = table.select(F.col(key).alias("k")).filter("k IS NOT NULL").withColumn("block", block("k"))
    run = F.col("k") - F.dense_rank().over(Window.partitionBy("block").orderBy("k"))
    runs = written(keys.withColumn("run", run).groupBy("block", "run").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).drop("run"), "runs")
    most = runs.groupBy("block").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if most.most > BLOCK_RUNS or most.n > MOST_RUNS:
        return rows.join(table.select(F.col(key).alias(column)), column, "left_semi").select(rows.columns)
    own = rows.withColumn("block_of", block(column))
    return own.join(F.broadcast(runs), F.expr(f"block_of = block AND {column} BETWEEN lo AND hi"), "left_semi").select(rows.columns)


def _hot_keys(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, least: int) -> DataFrame:
    """Keys with more rows than a cell takes, MOST_CELLS at most: keys, lo, width, n_cells, cells (array by slot: first cell,
    parts). A key's time is cut in SLOTS slots of equal width; neighbouring slots form buckets of about `limit` rows, and
    a bucket of more, which holds one crowded slot, is dealt over several cells."""
    times = a.select(*keys, F.col(start).cast("double").alias("t")).unionByName(b.select(*keys, F.col(end).cast("double").alias("t")))
    sizes = times.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    limit = F.greatest(F.lit(least), F.floor(times.agg(F.count("*").alias("n")).scalar() / MOST_CELLS))
    hot = written(sizes.filter(F.col("n") > limit).select(*keys, "lo", F.greatest((F.col("hi") - F.col("lo")) / SLOTS, F.lit(1e-9)).alias("width"), limit.alias("limit")), "hot")
    if hot.isEmpty():
        return hot
    counts = times.join(F.broadcast(hot), keys).groupBy(*keys, _slot(F.col("t")).alias("slot")).agg(F.count("*").alias("n"))
    whole = F.broadcast(hot).select(*keys, "limit", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")).join(counts, [*keys, "slot"], "left").na.fill(0, ["n"])
    upto = Window.partitionBy(*keys).orderBy("slot")
    bucket = F.floor((F.sum("n").over(upto) - F.col("n")) / F.col("limit"))
    first = whole.withColumn("crowded", F.col("n") > F.col("limit")).withColumn("bucket", bucket)
    # A crowded slot stands alone: what comes before it in its bucket is another bucket.
    number = F.sum((F.coalesce(F.lag("bucket").over(upto) != F.col("bucket"), F.lit(True)) | F.col("crowded") | F.coalesce(F.lag("crowded").over(upto), F.lit(False))).cast("int")).over(upto)
    numbered = first.withColumn("number", number)
    own = Window.partitionBy(*keys, "number")
    sized = numbered.withColumn("parts", F.greatest(F.ceil(F.sum("n").over(own) / F.col("limit")), F.lit(1)).cast("int"))
    begins = sized.groupBy(*keys, "number").agg(F.first("parts").alias("parts"))
    begins = begins.withColumn("first", (F.sum("parts").over(Window.partitionBy(*keys).orderBy("number")) - F.col("parts")).cast("int")).drop("parts")
    placed = sized.join(begins, [*keys, "number"])
    cells = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "first", "parts"))).alias("cells"), F.max(F.col("first") + F.col("parts")).alias("n_cells"))
    return written(hot.join(cells, keys), "cells")


def _slot(t: Column) -> Column:
    return F.least(F.greatest(F.floor((t - F.col("lo")) / F.col("width")), F.lit(0)), F.lit(SLOTS - 1)).cast("int")


def dealt(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, least: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with cell_a and cell_b: every pair of a key whose a starts after its b ends has one (cell_a, cell_b) in common."""
    a, b = a.filter(F.col(start).isNotNull()), b.filter(F.col(end).isNotNull())
    hot = _hot_keys(a, b, keys, start, end, least)
    if hot.isEmpty():
        zero = [F.lit(0).alias("cell_a"), F.lit(0).alias("cell_b")]
        return a.select("*", *zero), b.select("*", *zero)
    hot = F.broadcast(hot)  # MOST_CELLS keys at most, of SLOTS slots

    def side(rows: DataFrame, time: str, own: str, other: str, later: bool) -> DataFrame:
        at = F.element_at("cells", _slot(F.col(time).cast("double")) + 1)
        cell = (at["first"] + F.pmod(F.xxhash64(*rows.columns), at["parts"])).cast("int")
        beyond = F.sequence(at["first"], F.col("n_cells") - 1) if later else F.sequence(F.lit(0), at["first"] + at["parts"] - 1)
        zero = F.lit(0)
        return rows.join(hot, keys, "left").select(*rows.columns, F.coalesce(cell, zero).alias(own), F.explode(F.coalesce(beyond, F.array(zero))).alias(other))

    return side(a, start, "cell_a", "cell_b", False), side(b, end, "cell_b", "cell_a", True)


def before_pairs(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, least: int = LEAST_ROWS) -> DataFrame:
    """All pairs of a key whose b had ended when a started; a and b share no column but the keys. Null times pair with
    nothing. A key's rows are dealt over cells in time, so that no task gets all of a hot key; cells that lie wholly before
    others need no comparison, and cells of the wrong order never meet."""
    left, right = dealt(a, b, keys, start, end, least)
    return left.join(right, [*keys, "cell_a", "cell_b"]).filter(F.col(start) > F.col(end)).drop("cell_a", "cell_b")


def _grams(x: Column, n: int) -> Column:
    return F.when(F.length(x) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, n)))


def containing(longs: DataFrame, shorts: DataFrame, n: int = 3) -> DataFrame:
    """(x, y) of two tables of strings, x and y, where x holds y. y is looked up by its rarest n-gram among the x, or, if it
    is shorter, by itself among the shorter grams; candidates are verified."""
    longs, shorts = longs.select("x").distinct(), shorts.select("y").distinct()
    all_grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("x"), k) for k in range(1, n + 1)]))
    index = written(longs.select("x", F.explode(all_grams).alias("gram")), "grams")
    own = F.when(F.length("y") < n, F.array("y")).otherwise(F.array_distinct(_grams(F.col("y"), n)))
    holders = index.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = shorts.select("y", F.explode(own).alias("gram")).join(holders, "gram").groupBy("y").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    return index.join(rarest, "gram").filter(F.col("x").contains(F.col("y"))).select("x", "y")
