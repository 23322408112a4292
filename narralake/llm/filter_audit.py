"""Operator 13: how filters of a corpus interact, over every order they could be applied in, by lattice-edge aggregation.

An order of filters is a path in the lattice of sets of filters already applied; its steps are edges (set, next filter).
Five filters have 120 orders of five steps, but only 80 edges. A document's part in an edge depends on nothing but which
filters it fails: it reaches the edge if it fails none of the set, and is removed there if it fails the next one. So

1. documents are reduced to the set of filters that they fail (a bit mask), their part and their marks, and counted;
2. every count contributes to all edges of its part, which are summed;
3. the summed edges are joined to the steps of all orders, a table of fixed size (n! times n rows for n filters).

A document fails the duplicate filter if a smaller id has its text, in any part. Texts are compared by two 64-bit hashes
and their length. A text's rows are first counted by part, marks and id, so that a text of any number of rows is a few
rows when its smallest id is sought.

Nulls: a null text is an empty one, a null part an empty string; a row without an id has no smaller id and is none, so it
neither fails the duplicate filter nor lets others fail. Rows repeated under one id each count; none is a duplicate of
another, for none has a smaller id. Null labels mark nothing; of several label rows of one id, one mark is enough. Very
long texts are tested whole. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name -> whether a text fails, from the columns text, w (its words) and distinct (how many different ones).
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.size("w") < 50,
    "B": lambda: 100 * F.col("distinct") < 65 * F.size("w"),
    "C": lambda: 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 5 * F.length("text"),
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
}
DUPLICATE = "E"


def _bit(k: int) -> int:
    return 1 << k


def patterns(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[], Column]] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (bit k: fails the k-th filter, the duplicate filter being the last), good, toxic, n: documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    two = one.select("id", "part", "text", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("w"))
    three = two.select("id", "part", "text", "w", F.size(F.array_distinct("w")).alias("distinct"))
    mask = reduce(lambda a, b: a + b, [F.when(fails(), _bit(k)).otherwise(0) for k, fails in enumerate(filters.values())])
    own = ("h1", "h2", "size", "part", "mask")
    slim = three.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("size"), "part", mask.alias("mask"))
    flag = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias("good" if name == "quality" else name)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(flag("quality"), flag("toxic"))
    marked = slim.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    by_id = marked.groupBy(*own, "good", "toxic", "id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*own, "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.min("least").over(Window.partitionBy("h1", "h2", "size"))
    free = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    found = by_text.withColumn("first", first).withColumn("free", free)
    last = _bit(len(filters))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("free").alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - F.col("free")).alias("n")))
    each = found.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(found: DataFrame, n_filters: int) -> DataFrame:
    """found: part, mask, good, toxic, n -> part, before (set of filters applied), next (filter), and the edge's counts."""
    every = [(before, k) for k in range(n_filters) for before in range(_bit(n_filters)) if not before & _bit(k)]
    pairs = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(k).alias("next"), F.lit(_bit(k)).alias("bit")) for b, k in every])
    each = found.select("*", F.explode(pairs).alias("e")).select("part", "mask", "good", "toxic", "n", "e.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda which, name: F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name)
    here = fails & ~gone
    return each.groupBy("part", "before", "next").agg(total(~fails & ~gone, "kept"), total(here, "removed"), total(fails & gone, "redundant"), total(F.col("mask") == F.col("bit"), "unique_fails"), total(here & (F.col("good") == 1), "good_lost"), total(here & (F.col("toxic") == 1), "toxic_lost"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[], Column]] = FILTERS, duplicate: str = DUPLICATE, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    step of each order in each part. shapley: what the step's filter removes, over all orders."""
    names = [*filters, duplicate]
    n = len(names)
    summed = edges(patterns(docs, labels, filters, id_col, text_col, part_col), n)
    ways = {k: factorial(k) * factorial(n - 1 - k) for k in range(n)}  # orders that take an edge from a set of k filters
    weight = F.element_at(F.array(*[F.lit(ways[k]) for k in range(n)]), F.bit_count("before").cast("int") + 1)
    whole = summed.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "next")))
    steps = [("".join(names[k] for k in order), s + 1, sum(_bit(k) for k in order[:s]), order[s]) for order in permutations(range(n)) for s in range(n)]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, next int")
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return whole.join(F.broadcast(paths), ["before", "next"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])


#: DuckDB SQL for the five filters: every order's steps straight from the counted patterns, without the lattice.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(f.doc_id > first, false) AS E FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
p AS (SELECT part, good, toxic, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS failed, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, substring(filter_order, step, 1) AS name, substring(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) y),
r AS (SELECT part, filter_order, step::INT AS step, name, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = name THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost FROM (SELECT *, contains(failed, name) AS hit, before <> '' AND regexp_matches(failed, concat('[', before, '_]')) AS gone FROM p, s) z GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM r
"""
