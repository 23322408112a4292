"""Operator 3 [native]: quality rules from a log-likelihood ratio of hashed n-grams, DataFrame functions only.

Tokens: runs of letters and digits, and runs of other characters that aren't white space, case kept. Features: tokens
and neighbouring pairs, hashed to BUCKETS. Two multinomials with PRIOR added to every bucket: the trusted target (the
texts of at most TRUSTED rows that the labels mark with quality 1, chosen by a hash of their id) and the raw corpus
(all texts). A text's score is the mean over its features of ln(target) - ln(raw); texts with a score under THRESHOLD
are rejected. The rules reject further texts of fewer than MIN_WORDS words, and those of which more than MAX_REPEATED
percent of the words lie in a three-word window that the text repeats.

Nulls: a null text is an empty one (rejected by the rules), null ids stay; null labels and ids of labels mark nothing.
Of conflicting label rows of one id, one with quality 1 is enough. Empty tables give no rows, and without trusted texts
the target is even over all buckets; repeated rows are counted and judged each for itself. Texts of any length are
judged whole. Extra columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralake.llm.common import materialize

BUCKETS, PRIOR, TRUSTED, THRESHOLD = 1 << 16, 1.0, 20_000, -0.15
MIN_WORDS, MAX_REPEATED = 50, 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def base_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to (doc_id, text) and the columns to carry along."""
    own = ("doc_id", "text", *carry)
    whole = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    one = docs.select(*own, words(whole).alias("w"), F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"), (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    at = lambda i: F.element_at("w", i)
    window = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    two = one.select(*own, F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), window.alias("h"), F.sort_array(window).alias("s"))
    repeated = F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (x == F.get("s", F.when(i > 0, i - 1).otherwise(0)))))
    three = two.select("*", repeated.alias("again"))
    # Few repeated windows: look each up. Many: sort windows with their places, so that the cost stays near linear.
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("again", x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    four = three.select("*", F.when(F.size("again") > 32, pairs).alias("p"))
    many = F.transform(F.filter("p", lambda x, k: ((k > 0) & (F.get("p", F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get("p", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
    places = F.when(F.size("again") == 0, F.array().cast("array<int>")).when(F.size("again") <= 32, few).otherwise(many)
    five = four.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", places.alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2)))))
    six = five.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    return six.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def features(text: Column) -> Column:
    """Buckets of the tokens and of neighbouring pairs."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _buckets(hashes: Column) -> Column:
    pairs = F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.transform(F.concat(hashes, F.filter(pairs, lambda x: x.isNotNull())), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def _counts(docs: DataFrame) -> DataFrame:
    hashed = docs.select(features(F.col("text")).alias("f"))
    return hashed.select(F.explode(_buckets(F.col("f"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: w, the log ratio of each of the BUCKETS buckets."""
    spark = docs.sparkSession
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    target = _counts(docs.join(F.broadcast(materialize(good, "trusted")), "doc_id", "left_semi"))
    raw = _counts(docs)
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(target.withColumnRenamed("n", "t"), "bucket", "left").join(raw.withColumnRenamed("n", "r"), "bucket", "left").na.fill(0)
    row = both.agg(F.sum("t").alias("nt"), F.sum("r").alias("nr"), F.transform(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))), lambda x: F.log(x["t"] + PRIOR) - F.log(x["r"] + PRIOR)).alias("w"))
    return row.select(F.transform("w", lambda x: x - F.log(F.col("nt") + PRIOR * BUCKETS) + F.log(F.col("nr") + PRIOR * BUCKETS)).alias("w"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text -> doc_id, the columns to carry along, the rules' columns, llr and kept."""
    table = materialize(weights(docs, labels), "weights")  # one row of fixed size
    ruled = base_rules(docs, carry).withColumn("f", features(F.col("text"))).drop("text")
    bucketed = ruled.withColumn("b", _buckets(F.col("f"))).drop("f").withColumn("w", table.scalar())
    total = F.aggregate("b", F.lit(0.0), lambda acc, x: acc + F.element_at("w", x + 1))
    scored = bucketed.withColumn("llr", F.when(F.size("b") > 0, total / F.size("b")).otherwise(0.0)).drop("b", "w")
    # rand() >= 0 is always true; it keeps a later filter on kept from being pushed below these projections, where it
    # would repeat their expressions many times over.
    return scored.withColumn("kept", (F.rand(0) >= 0) & ~F.col("base_failed") & (F.col("llr") >= threshold))
