"""Operator 2: repeated passages by hashing of lines and their sentences.

Units are the lines of a text, cut further behind sentence ends, so that a passage is found wherever in a line it
stands. A unit is normalised (lower case, runs of white space as one blank) and digested; digests are grouped over all
texts, so a line that stands elsewhere is a run of repeats. The occurrence with the least rank (doc_id, text hash, position) is kept, and
every other one is removed. With `stock_words`, which is off by default, a run of neighbouring repeats of fewer words
in all is taken for stock phrases and stays. Offsets are those of the original text, in characters.

Occurrences are written once and read by both steps. A digest that stands in a large share of all texts is kept out of
the join's shuffle.

Nulls: a null text stays null; null ids rank last. Empty tables give no rows. Rows repeated in both columns are one
occurrence, so all stay. Texts of any length are cut whole, one text at a time. Ties of rank don't occur but between
such rows. Further columns, whatever their names, are kept as they are by `repeat_rows` and not read by `repeats`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralake.llm.common import bound_arrow, id_and_text, join_one, materialize, slices

_END = re.compile(r"[.!?]+(?=\s)|\n")
LAST = (1 << 63) - 1


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of every unit that isn't blank; the white space behind a unit belongs to it."""
    out, start = [], 0
    for m in _END.finditer(text):
        if not text[start : m.end()].isspace():
            out.append((start, m.end()))
            start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def _digest(unit: str) -> tuple[bytes, int]:
    words = unit.lower().split()
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), len(words)


def text_key(text: str | None) -> int:
    value = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def runs(text: str, repeated: set[int], stock_words: int) -> list[tuple[int, int]]:
    """Offsets of the runs of repeated units that have stock_words words or more."""
    out, words, begin, end = [], 0, None, 0
    spans = units(text)
    for k, (a, b) in enumerate([*spans, (len(text), len(text))]):
        if k < len(spans) and k in repeated:
            if begin is None:
                begin, words = a, 0
            words += len(text[a:b].split())
            end = b
        elif begin is not None:
            if words >= stock_words:
                out.append((begin, end))
            begin = None
    return out


def _occurrences(texts: DataFrame) -> DataFrame:
    kind = pa.schema([("rank_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                columns: list[list[int]] = [[], [], [], [], []]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    key = text_key(text)
                    for pos, (a, b) in enumerate(units(text)):
                        digest, _ = _digest(text[a:b])
                        columns[0].append(LAST if doc_id is None else doc_id)
                        columns[1].append(key)
                        columns[2].append(pos)
                        columns[3].append(int.from_bytes(digest[:8], "little", signed=True))
                        columns[4].append(int.from_bytes(digest[8:], "little", signed=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return texts.mapInArrow(cut, "rank_id long, key long, pos int, hi long, lo long")


def repeat_rows(docs: DataFrame, stock_words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (all columns of docs), text (without repeats), removed (array of start, end in the original), n_removed (characters)."""
    bound_arrow(docs.sparkSession)
    found = materialize(_occurrences(id_and_text(docs, id_col, text_col)), "occurrences")
    rank = F.struct("rank_id", "key", "pos")
    first = materialize(found.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n")).filter("first <> last").select("hi", "lo", "first", "n"), "first")
    marks = join_one(found, first, ["hi", "lo"], "n", found.count()).filter(rank != F.col("first")).groupBy("rank_id", "key").agg(F.collect_list("pos").alias("again"))
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, sizes = [], [], []
            for text, again in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spans = runs(text, set(again), stock_words) if text and again else []
                if spans:
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                texts.append(text)
                removed.append([{"start": a, "end": b} for a, b in spans])
                sizes.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array(removed, spans_type), pa.array(sizes, pa.int64())], ["doc_id", "row", "text", "removed", "n_removed"])

    row = T.StructField("row", T.StructType([f for f in docs.schema if f.name != text_col]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{f.name}`") for f in row.dataType]).alias("row"))
    whole = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), row, T.StructField("rank_id", T.LongType()), T.StructField("key", T.LongType())])
    joined = rows.mapInArrow(_keyed, whole).join(marks, ["rank_id", "key"], "left").select("doc_id", "text", "row", "again")
    return joined.mapInArrow(remove, T.StructType([whole[0], row, whole[1], *T.StructType.fromDDL("removed array<struct<start:int,end:int>>, n_removed long")]))


def repeats(docs: DataFrame, stock_words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, removed, n_removed; only the two named columns are read."""
    return repeat_rows(docs.select(id_col, text_col), stock_words, id_col, text_col).drop("row")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        keys = pa.array([text_key(t) for t in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(2), ids.fill_null(LAST), keys], ["doc_id", "text", "row", "rank_id", "key"])
