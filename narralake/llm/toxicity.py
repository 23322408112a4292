"""Operator 1: toxicity by compression distance.

1. A text is normalised to a stream of word codes: every word (a run of letters, lower-cased) becomes CODE bytes of its
   hash, so that a word costs the same whatever its letters. As plain letters a short word costs about what zstandard pays
   for a reference into a dictionary, and so no dictionary shortens it.
2. Texts are parted into kinds (languages, styles) by compression: texts choose the dictionary that shortens them most,
   dictionaries are trained again on their texts, until none moves or ROUNDS are over. There are KINDS kinds, or fewer,
   where the sample has less than TOXIC_A_KIND toxic texts for each.
3. Of each kind zstandard trains two dictionaries by one rule: the ordinary one on all windows of its ordinary texts, in
   PARTS parts, the toxic one, smaller, on all windows of its toxic texts. No word is chosen or left out by hand or by set.
4. A text takes the kind whose dictionary shortens it most, and is cut into windows of WINDOW words, STEP apart. Each is
   compressed twice, with the ordinary dictionary, and with the toxic one behind it, so that what both hold costs the
   same; what the toxic dictionary saves is the window's evidence, in bytes.
5. A text's score is a logistic function of its windows' savings: mean, most, and how many (and what share) reach each
   of THRESHOLDS. Its weights are calibrated, for each kind with LEAST_TOXIC toxic texts, on texts that no dictionary
   of step 3 saw: FOLDS sets are trained, each without one part of the sample, and rate that part; the final set is
   trained on the whole sample.

Learning uses at most TRAINING labelled rows and SAMPLE_BYTES of text (the first by a hash of the id), none whose
crc32(id) mod 3 is 1, in one task of that bounded size; only the dictionaries and the weights come to the driver.
Nulls: a null text is an empty one; null labels and ids are not learned from. Conflicting label rows of one id count as
toxic if one does. Rows repeated under one id are each scored, and learned from once for each different text. Very long
texts are scored whole, in windows. Empty tables give no rows; without toxic or ordinary labels every score is 0. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralake.llm.common import bound_arrow, materialize, slices, with_row

TRAINING, SAMPLE_BYTES, FOLDS, CUT = 12_000, 64 << 20, 8, 0.7
CODE, WINDOW, STEP, LEVEL = 8, 16, 8, 6
#: Kinds of texts: how many at most, toxic texts for each, rounds, texts that they are found on, bytes of a kind's dictionary.
KINDS, TOXIC_A_KIND, ROUNDS, GROUPED, KIND_BYTES, LEAST_TOXIC = 6, 50, 8, 2000, 1 << 14, 4
#: A toxic dictionary has a TOXIC_PART-th of its texts' size, TOXIC_BYTES at most.
ORDINARY_BYTES, PARTS, TOXIC_BYTES, TOXIC_PART, SEGMENT, DMER = 1 << 18, 8, 1 << 13, 24, 8, 8
THRESHOLDS = (2, 4, 6, 8)
_WORD = re.compile(r"[^\W\d_]+")


class Codes(dict):
    """What stands between white space -> CODE bytes for each word in it; emptied when it holds more than `limit` of them."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        code = b"".join([xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass"))[:CODE] for w in _WORD.findall(piece)])
        if len(piece) <= 64:
            self[piece] = code
        return code

    def stream(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))


def _cut(stream: bytes, words: int, step: int) -> list[bytes]:
    """Windows of that many words, the last one shorter if need be; one window at least."""
    size, step = words * CODE, step * CODE
    return [stream] if len(stream) <= size else [stream[i : i + size] for i in range(0, len(stream) - size + step, step)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    whole = b"".join(samples)
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def kinds_of(streams: list[bytes], n: int) -> list[bytes]:
    """A dictionary for each of n kinds of these texts."""
    texts = [s for s in streams if len(s) >= 8 * CODE][:GROUPED]
    own = [i % n for i in range(len(texts))]
    found: list[bytes] = []
    for _ in range(ROUNDS):
        found = [_trained([w for s, o in zip(texts, own, strict=True) if o == kind for w in _cut(s, 32, 32)], KIND_BYTES) for kind in range(n)]
        compressors = [_compressor(d) for d in found]
        before, own = own, [nearest(s, compressors) for s in texts]
        if own == before:
            break
    return found


def nearest(stream: bytes, compressors: list) -> int:
    return int(np.argmin([len(c.compress(stream)) for c in compressors]))


def train(rows: list[tuple[int, bytes, int]], n: int) -> tuple[list[bytes], list[bytes]]:
    """The toxic and the ordinary dictionaries of n kinds, from (kind, word codes of a text, toxic)."""
    found: tuple[list[bytes], list[bytes]] = ([], [])
    for kind in range(n):
        toxic, ordinary = ([w for k, s, t in rows if k == kind and t == y for w in _cut(s, WINDOW, WINDOW) if w] for y in (1, 0))
        size = min(TOXIC_BYTES, sum(map(len, toxic)) // TOXIC_PART)
        parts = [_trained(ordinary[i::PARTS], ORDINARY_BYTES // PARTS) for i in range(PARTS)]
        found[0].append(_trained(toxic, max(size, 32 * CODE)))
        found[1].append(b"".join(parts))
    return found


def _compressor(content: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)


@dataclass
class Model:
    kinds: list[bytes]
    toxic: list[bytes]
    ordinary: list[bytes]
    weights: list[list[float]] = field(default_factory=list)

    def open(self) -> Model:
        self._kinds = [_compressor(d) for d in self.kinds]
        # What lies nearest to the data is the cheapest to refer to, so what both dictionaries hold is found in the ordinary one.
        self._pairs = [(_compressor(o), _compressor(t + o)) for t, o in zip(self.toxic, self.ordinary, strict=True)]
        return self

    def kind(self, stream: bytes) -> int:
        return nearest(stream, self._kinds)

    def savings(self, stream: bytes, kind: int) -> list[int]:
        """Bytes that the kind's toxic dictionary saves in each window."""
        ordinary, both = (c.compress for c in self._pairs[kind])
        return [len(ordinary(w)) - len(both(w)) for w in _cut(stream, WINDOW, STEP)]

    def evidence(self, stream: bytes, kind: int) -> list[float]:
        return self._summed(self.savings(stream, kind))

    def rated(self, streams: list[bytes]) -> list[tuple[int, list[float]]]:
        """Kind and evidence of each; one dictionary after the other, so that its tables stay in the processor's cache."""
        sizes = [[len(c.compress(s)) for s in streams] for c in self._kinds]
        kinds = np.argmin(np.array(sizes), axis=0).tolist() if streams else []
        found: list[list[float]] = [[]] * len(streams)
        for kind, pair in enumerate(self._pairs):
            own = [i for i, k in enumerate(kinds) if k == kind]
            ordinary, both = ([[len(c.compress(w)) for w in _cut(streams[i], WINDOW, STEP)] for i in own] for c in pair)
            for i, a, b in zip(own, ordinary, both, strict=True):
                found[i] = self._summed([x - y for x, y in zip(a, b, strict=True)])
        return list(zip(kinds, found, strict=True))

    def _summed(self, x: list[int]) -> list[float]:
        n, out = len(x), [1.0]
        for t in THRESHOLDS:
            hits = sum(s >= t for s in x)
            out += [np.log1p(hits), hits / n]
        mean = sum(x) / n
        return [*out, mean, mean * np.sqrt(n), float(max(x)), np.log(n)]

    def score(self, evidence: list[float], kind: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(evidence, self.weights[kind]), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic weights by Newton's method, on features scaled to unit deviation; the first one is constant."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], spread[0] = 0, 1
    z = (x - mean) / spread
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(len(w)), z.T @ (y - p) - 0.3 * w)
    out = w / spread
    out[0] -= (mean[1:] * out[1:]).sum()
    return out


def fit(rows: list[tuple[int, str, int]]) -> Model | None:
    """rows: (id hash, text, toxic) -> the model; None without both kinds of text."""
    if len({toxic for _, _, toxic in rows}) < 2:
        return None
    codes = Codes()
    streams = [(h // 3 % FOLDS, codes.stream(text), toxic) for h, text, toxic in rows]
    kinds = kinds_of([s for _, s, _ in streams], max(1, min(KINDS, sum(t for *_, t in streams) // TOXIC_A_KIND)))
    compressors = [_compressor(d) for d in kinds]
    dealt = [(f, nearest(s, compressors), s, t) for f, s, t in streams]
    seen: list[tuple[int, list[float], int]] = []
    for fold in range(FOLDS):
        own = [r for r in dealt if r[0] == fold]
        rest = [r[1:] for r in dealt if r[0] != fold]
        if own and len({t for *_, t in rest}) == 2:
            model = Model(kinds, *train(rest, len(kinds))).open()
            seen += [(k, model.evidence(s, k), t) for _, k, s, t in own]
    final = Model(kinds, *train([r[1:] for r in dealt], len(kinds))).open()
    if len({t for *_, t in seen}) < 2:  # too few rows for parts
        seen = [(k, final.evidence(s, k), t) for _, k, s, t in dealt]
    common = _logistic(np.array([x for _, x, _ in seen]), np.array([t for *_, t in seen], float)).tolist()
    for kind in range(len(kinds)):
        own = [(x, t) for k, x, t in seen if k == kind]
        enough = sum(t for _, t in own) >= LEAST_TOXIC and not all(t for _, t in own)
        final.weights.append(_logistic(np.array([x for x, _ in own]), np.array([t for _, t in own], float)).tolist() if enough else common)
    return final


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, trained by one task on a bounded sample of labelled rows."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", digest).filter("h % 3 <> 1")
    marked = materialize(marked.orderBy("h", "doc_id").limit(TRAINING), "marked")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))
    sized = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("size")).join(F.broadcast(marked), "doc_id").groupBy("doc_id", "key").agg(F.max("size").alias("size"), F.first("h").alias("h"), F.first("toxic").alias("toxic"))
    first = sized.orderBy("h", "doc_id", "key").limit(TRAINING)
    upto = Window.orderBy("h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    picked = materialize(first.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "key", "h", "toxic"), "picked")
    rows = keyed.join(F.broadcast(picked), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("h").alias("h"), F.first("toxic").alias("toxic"), F.first("text").alias("text"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        model = fit(sorted((h, t, int(y != 0)) for h, t, y in sample))
        if model:
            columns = [pa.array([model.kinds], pa.list_(pa.binary())), pa.array([model.toxic], pa.list_(pa.binary())), pa.array([model.ordinary], pa.list_(pa.binary())), pa.array([model.weights], pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, ["kinds", "toxic", "ordinary", "weights"])

    one = rows.select("h", "text", "toxic").repartition(1).mapInArrow(fitted, "kinds array<binary>, toxic array<binary>, ordinary array<binary>, weights array<array<double>>")
    found = materialize(one, "toxicity").first()
    return Model(*([bytes(d) for d in x] for x in (found.kinds, found.toxic, found.ordinary)), [list(w) for w in found.weights]) if found else None


def score_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, row (all columns of docs), held_out, score, predicted, n_windows (those with the middle threshold's savings)."""
    bound_arrow(docs.sparkSession)
    rows = with_row(docs, id_col, text_col)
    model = learn(rows.select("doc_id", "text"), labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, codes = model.open() if model else None, Codes()
        for whole in batches:
            for batch in slices(whole, 1):
                score, hits = [0.0] * batch.num_rows, [0] * batch.num_rows
                if opened:
                    found = opened.rated([codes.stream(text or "") for text in batch.column(1).to_pylist()])
                    score, hits = [opened.score(x, kind) for kind, x in found], [round(np.expm1(x[3])) for _, x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(score, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "row", "score", "n_windows"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", docs.schema), T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType())])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.mapInArrow(rate, schema).select("doc_id", "row", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_windows")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows; only the two named columns are read."""
    return score_rows(docs.select(id_col, text_col), labels, id_col, text_col, cut).drop("row")
