"""Ranked search inside groups: an inverted index of impact blocks, BM25, and the best k of every group.

A posting's impact is its share of a text's BM25 score, which depends on nothing but its group, so it is computed when the
index is built. Postings of a (group, term) are gathered in blocks of similar impact: the level is the impact in steps, and
a frequent term's level is dealt over several blocks of about BLOCK postings by a hash, so no list is sorted or held whole.

A search reads the summaries of the query's blocks first. In a group, the k-th best impact of any one term bounds the
k-th best score from below. Terms whose best impacts together stay under that bound can't bring a text among the best k
alone: they are only looked up, in the blocks that the other terms' texts fall in. Of the other terms, blocks whose largest
impact, with the best impacts of all other terms, stays under the bound aren't opened either: their texts aren't among the
best k, and every block of a text that is among them is opened or looked up, so its score is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralake.plans.storage import written

K1, B, BLOCK, STEPS, SLACK = 1.2, 0.75, 128, 4, 1e-9
NOT_WORD = r"[^\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("key"), parts).cast("int")


@dataclass
class Index:
    """blocks: group, term, level, part (of parts), n, top, low (largest and least impact), items (key, impact)."""

    blocks: DataFrame

    def save(self, path: str) -> None:
        """Sorted by term inside files, so that a query's terms prune row groups."""
        self.blocks.repartition("term", "group").sortWithinPartitions("term", "group").write.mode("error").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(path))


def build(rows: DataFrame, group: str, key: str, text: str) -> Index:
    """An index over rows; a group's texts are ranked among themselves. Null texts are empty, and count as texts."""
    cut = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("length", F.size("w"))
    sizes = cut.groupBy("group").agg(F.count("*").alias("texts"), F.avg("length").alias("usual"))
    uses = cut.select("group", "key", "length", F.explode("w").alias("term")).groupBy("group", "key", "length", "term").agg(F.count("*").alias("tf"))
    uses = written(uses, "uses")
    holders = uses.groupBy("group", "term").agg(F.count("*").alias("df"))
    rare = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = rare * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("usual")))
    known = holders.join(sizes, "group").select("group", "term", "texts", "usual", "df")
    scored = uses.join(known, ["group", "term"]).select("group", "term", "key", "df", impact.alias("impact"))
    placed = scored.withColumn("parts", F.ceil(F.col("df") / BLOCK).cast("int")).select("group", "term", "key", "impact", F.floor(F.col("impact") * STEPS).cast("int").alias("level"), "parts", _part(F.col("parts")).alias("part"))
    return Index(placed.groupBy("group", "term", "level", "part", "parts").agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.min("impact").alias("low"), F.collect_list(F.struct("key", "impact")).alias("items")))


def postings(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(query,) group, key, impact of what may count for the best k. terms: term and, if queries differ, query and group."""
    on = [c for c in ("group", "term") if c in terms.columns]
    by = [c for c in ("query",) if c in terms.columns] + ["group"]
    wanted = index.blocks.join(terms, on)
    # A term's blocks from the top down: once k postings are passed, the k-th best score is no less than the block's least.
    down = Window.partitionBy(*by, "term").orderBy(F.desc("low"), "level", "part")
    passed = wanted.select(*by, "term", "level", "part", "parts", "n", "top", "low").withColumn("reach", F.sum("n").over(down))
    of_term = passed.groupBy(*by, "term").agg(F.max("top").alias("best"), F.max("parts").alias("parts"), F.max(F.when(F.col("reach") >= k, F.col("low"))).alias("bound"))
    few = Window.partitionBy(*by)  # a row for each term of the query
    upwards = few.orderBy("best", "term").rowsBetween(Window.unboundedPreceding, 0)
    limits = of_term.withColumn("bound", F.coalesce(F.max("bound").over(few), F.lit(0.0))).withColumn("others", F.sum("best").over(few) - F.col("best"))
    limits = written(limits.withColumn("alone", F.sum("best").over(upwards) + SLACK >= F.col("bound")), "limits")
    posting = lambda blocks: blocks.select(*by, F.explode("items").alias("x")).select(*by, "x.key", "x.impact")
    opened = wanted.join(limits.filter("alone").select(*by, "term", "others", "bound"), [*by, "term"]).filter(F.col("top") + F.col("others") + SLACK >= F.col("bound"))
    found = written(posting(opened), "found")
    texts = found.select(*by, "key").distinct()
    sought = limits.filter("NOT alone").select(*by, "term", "parts").join(texts, by).select(*by, "term", _part(F.col("parts")).alias("part")).distinct()
    return found.unionByName(posting(wanted.join(sought, [*by, "term", "part"], "left_semi")).join(texts, [*by, "key"], "left_semi"))


def search(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(query,) group, key, score, place: the best k of each group, ties to the smaller key; scores to six places."""
    by = [c for c in ("query",) if c in terms.columns] + ["group"]
    hits = postings(index, terms, k).groupBy(*by, "key").agg(F.round(F.sum("impact"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))
    return hits.withColumn("place", place).filter(F.col("place") <= k)


def terms_of(spark: SparkSession, query: str) -> DataFrame:
    """The distinct words of a query."""
    return spark.range(1).select(F.explode(F.array_distinct(words_of(F.lit(query)))).alias("term"))


def queries_of(rows: DataFrame, query: str, group: str, text: str) -> DataFrame:
    """A query for each row: its distinct words, to be sought in the row's group."""
    return rows.select(F.col(query).alias("query"), F.col(group).alias("group"), F.explode(F.array_distinct(words_of(F.col(text)))).alias("term")).distinct()

