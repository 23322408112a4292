"""Operator 4: byte-level BPE encoding with reuse of content-defined chunks, and decoding.

1. A rolling hash over WINDOW bytes cuts every text where its low bits are zero (MEAN bytes apart on average, LEAST at
   least), so that equal passages get equal chunks wherever they stand. Only chunk digests leave this step.
2. A chunk that occurs more than once is encoded once, by the task that holds its first occurrence, and its ids go to
   every other occurrence. All else is encoded in place. Texts are shuffled once (compressed); both uses read it.
3. A chunk's ids are right inside it but not where it was cut. Around every cut the text from the last anchor before to
   the first anchor after it is encoded again and replaces the ids there. An anchor is a blank after a visible ASCII
   character: tokens never go on across it, whatever stands around, so both sides agree from there on. A chunk
   without an anchor is encoded again whole, with its neighbours up to their anchors.

Every worker function handles about SLICE bytes of text at a time, whatever the batches hold. Rows equal in id and text
are coded once, from one row with their number, and chunks go to texts by (chunk, salt), so neither a group of equal
rows nor a chunk of every text meets in one task.

Nulls: a null text is an empty one with no ids; null ids stay. Empty tables give no rows; repeated rows give equal rows.
Texts of any length are coded whole. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralake.llm.common import bound_arrow, id_and_text, materialize, slices
from narralake.llm.encoding import _byte_letters, encoder

WINDOW, MEAN, LEAST = 24, 1024, 128
SLICE, SALTS, MEMO = 2 << 20, 64, 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BACK)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text in UTF-8, at first bytes of characters; the last is its length."""
    n = len(data)
    if n <= LEAST + WINDOW:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], dtype=np.uint64)])
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * up[: n - WINDOW + 1]  # of the bytes before each place from WINDOW on
    rolled ^= rolled >> np.uint64(31)
    rolled *= _BASE
    places = np.flatnonzero(rolled >> np.uint64(54) == 0) + WINDOW if MEAN == 1024 else np.flatnonzero(rolled % np.uint64(MEAN) == 0) + WINDOW
    out, last = [], 0
    for p in places.tolist():
        while p < n and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= LEAST and p < n:
            out.append(p)
            last = p
    return [*out, n]


def _uid(doc_id: int | None, data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data + struct.pack("<?q", doc_id is None, doc_id or 0))


def _chunks(texts: DataFrame, with_text: bool) -> DataFrame:
    """uid, and the chunks' digests, or the compressed text."""
    fields = [("uid", pa.binary())] + ([("doc_id", pa.int64()), ("z", pa.binary())] if with_text else [("pos", pa.int32()), ("chunk", pa.binary())])
    kind = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for whole in batches:
            for batch in slices(whole, 1):
                columns: list[list] = [[] for _ in fields]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = (text or "").encode()
                    uid = _uid(doc_id, data)
                    if with_text:
                        for column, value in zip(columns, (uid, doc_id, press.compress(data)), strict=True):
                            column.append(value)
                        continue
                    ends = cuts(data)
                    for pos, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        for column, value in zip(columns, (uid, pos, xxhash.xxh3_128_digest(data[a:b])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return texts.mapInArrow(cut, "uid binary, doc_id long, z binary" if with_text else "uid binary, pos int, chunk binary")


def _anchor(data: bytes, a: int, b: int, last: bool) -> int | None:
    """The first or last blank in data[a:b] that follows a visible ASCII character of it."""
    p = data.rfind(b" ", a + 1, b) if last else data.find(b" ", a + 1, b)
    while p > a and not 0x21 <= data[p - 1] <= 0x7E:
        p = data.rfind(b" ", a + 1, p) if last else data.find(b" ", p + 1, b)
    return p if p > a else None


def _plan(data: bytes, bounds: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(the runs (segment, from, to) that stay as encoded, the windows (from, to) to encode again)."""
    runs, windows = [], []
    m, open_ = len(bounds), None
    for i, (a, b) in enumerate(bounds):
        head = a if i == 0 else _anchor(data, a, b, False)
        tail = b if i == m - 1 else _anchor(data, a, b, True)
        if i == 0 and tail is None:
            open_ = a
            continue
        if head is None:
            continue
        if open_ is not None:
            windows.append((open_, head))
        runs.append((i, head, tail if tail is not None else head))
        open_ = None if i == m - 1 else tail
    if open_ is not None:
        windows.append((open_, bounds[-1][1]))
    return runs, windows


def _table(tokenizer) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(bytes of each id: lengths, places, all of them)."""
    back = {c: b for b, c in enumerate(_byte_letters())}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    parts = [b""] * (max(vocab.values()) + 1)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    for token, i in vocab.items():
        parts[i] = token.encode() if token in special else bytes([back[c] for c in token])
    lengths = np.array([len(p) for p in parts], np.int64)
    return lengths, np.cumsum(lengths) - lengths, b"".join(parts)


_TABLES: dict[str, tuple] = {}


def _table_of(vocabulary: str, tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each id's bytes, their place, all bytes), once for each vocabulary and worker."""
    if vocabulary not in _TABLES:
        lengths, places, flat = _table(tokenizer)
        _TABLES[vocabulary] = lengths, places, np.frombuffer(flat, np.uint8)
    return _TABLES[vocabulary]


def _assemble(batch: pa.RecordBatch, given: list[dict[int, bytes]], tokens, lengths: np.ndarray) -> list[np.ndarray]:
    """ids of each text of (uid, doc_id, z) rows, with the ids of some of its chunks given by position."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    docs, asked = [], []  # asked: what is to be encoded as it stands
    for z, own in zip(batch.column("z").to_pylist(), given, strict=True):
        data = expand.decompress(z) if z else b""
        segments: list[tuple[int, int, int | bytes]] = []  # from, to, ids or a place in asked
        if own:
            ends = cuts(data)
            for pos, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                if pos in own:
                    segments.append((a, b, own[pos]))
                elif segments and isinstance(segments[-1][2], int):
                    segments[-1] = (segments[-1][0], b, segments[-1][2])
                else:
                    segments.append((a, b, -1))
        elif data:
            segments.append((0, len(data), -1))
        for k, (a, b, ids) in enumerate(segments):
            if isinstance(ids, int):
                segments[k] = (a, b, len(asked))
                asked.append(data[a:b].decode())
        runs, windows = _plan(data, [(a, b) for a, b, _ in segments]) if len(segments) > 1 else ([], [])
        docs.append((segments, runs, [(a, b, len(asked) + k) for k, (a, b) in enumerate(windows)]))
        asked += [data[a:b].decode() for a, b in windows]
    ids, bounds = tokens.encode(pa.array(asked, pa.string()))
    got = lambda k: ids[bounds[k] : bounds[k + 1]]
    out = []
    for segments, runs, windows in docs:
        if len(segments) < 2:
            out.append(np.zeros(0, np.uint16) if not segments else got(segments[0][2]) if isinstance(segments[0][2], int) else np.frombuffer(segments[0][2], np.uint16))
            continue
        pieces = [(a, got(k)) for a, _, k in windows]
        for i, a, b in runs:
            start, _, held = segments[i]
            own = got(held) if isinstance(held, int) else np.frombuffer(held, np.uint16)
            ends = np.concatenate([[0], np.cumsum(lengths[own])])
            x, y = np.searchsorted(ends, [a - start, b - start])
            if x == len(ends) or y == len(ends) or ends[x] != a - start or ends[y] != b - start:
                break
            pieces.append((a, own[x:y]))
        else:
            pieces.sort(key=lambda p: p[0])
            out.append(np.concatenate([p for _, p in pieces]))
            continue
        # A token lies across an anchor, so the pieces don't agree: the window is widened to the whole text.
        whole, _ = tokens.encode(pa.array([expand.decompress(batch.column("z")[len(out)].as_py()).decode()], pa.string()))
        out.append(whole)
    return out


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about SLICE bytes once expanded, one row at least."""
    import zstandard

    begin = held = 0
    for i, z in enumerate(batch.column("z")):
        size = zstandard.frame_content_size(z.as_py())
        if held and held + size > SLICE:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _texts(found: list[np.ndarray], lengths: np.ndarray, places: np.ndarray, raw: np.ndarray) -> list[str]:
    """The texts of ids; bytes that aren't UTF-8 become replacement characters."""
    out = []
    for own in found:
        size = lengths[own]
        ends = np.cumsum(size)
        at = np.repeat((places[own] - (ends - size)).astype(np.int32), size) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        out.append(raw[at].tobytes().decode("utf-8", "replace"))
    return out


def encode(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers); one row for each row of docs.

    decoded: adds the text of the ids, by the worker that has them.
    """
    bound_arrow(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    places = materialize(_chunks(texts, False).distinct().withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")), "chunks")
    # A chunk has SALTS rows at most here, however many texts hold it.
    salted = materialize(places.groupBy("chunk", "salt").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("first")), "salted")
    shared = materialize(salted.groupBy("chunk").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter("n > 1").select("chunk", "first"), "shared")
    holders = shared.groupBy("first.uid").agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "chunk")).alias("own"))
    # The one shuffle of texts; the filter, always true, and equal columns keep both uses alike.
    held = _chunks(texts, True).filter("uid IS NOT NULL").groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("z").alias("z"), F.count("*").alias("copies"))

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokens, expand = encoder(vocabulary, ranks, MEMO), zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in _sliced(whole):
                keys, parts = [], []
                for z, own in zip(batch.column("z"), batch.column("own").to_pylist(), strict=True):
                    data = expand.decompress(z.as_py())
                    ends = [0, *cuts(data)]
                    for x in own:
                        keys.append(x["chunk"])
                        parts.append(data[ends[x["pos"]] : ends[x["pos"] + 1]].decode())
                ids, bounds = tokens.encode(pa.array(parts, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["chunk", "ids"])

    coded = held.join(holders, "uid").select("doc_id", "copies", "z", "own").mapInArrow(encode_shared, "chunk binary, ids binary")
    given = salted.select("chunk", "salt").join(coded, "chunk")
    sent = places.join(given, ["chunk", "salt"]).groupBy("uid").agg(F.collect_list(F.struct("pos", "ids")).alias("given"))
    kind = pa.schema([("doc_id", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.string())] if decoded else [])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary, ranks, MEMO)
        lengths, places_, raw = _table_of(vocabulary, tokens.tokenizer)
        for whole in batches:
            for part in _sliced(whole):
                given = [{x["pos"]: x["ids"] for x in own or ()} for own in part.column("given").to_pylist()]
                found = _assemble(part, given, tokens, lengths)
                columns = [part.column("doc_id"), part.column("copies"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(_texts(found, lengths, places_, raw), pa.string())] if decoded else [])], schema=kind)

    out = held.join(sent, "uid", "left").select("doc_id", "copies", "z", "given").mapInArrow(finish, "doc_id long, copies long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds `decoded`, the text of `ids`; bytes that aren't UTF-8 become replacement characters."""
    bound_arrow(encoded.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table_of(vocabulary, encoder(vocabulary, None, MEMO).tokenizer)
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("ids"), SLICE):
                found = [np.frombuffer(ids or b"", "<u4") for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_texts(found, *table), pa.string())], [*batch.schema.names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(texts, schema)
