"""Operator 5: token ids in binary files, coded by patched frame of reference.

File: one segment after another, then a footer. A segment holds up to SEGMENT ids in blocks of BLOCK; of each block
the file stores the minimum, the bit width that PERCENT of its differences from the minimum need, those differences
as bit planes of that width, and the larger differences as an exception list (place, whole difference). The footer
is an Arrow stream of segments (byte start, ids before it, ids in it, and the start of each block in the segment)
and of documents (id, ids before it in the file, number of ids), followed by the footer's length and MAGIC.
Any id range can be read by seeking to its blocks; nothing else of the segments is touched. A file ends when it has
FILE_BYTES, so a writer holds the document index of that much at most.

Nulls: a null text is an empty one, a null id is kept and sorts first; an empty table gives no files; repeated ids
keep all their rows, in the order of a hash of their texts, over as many tasks as their number needs; of rows equal in
both, each is a document. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm.common import bound_arrow, id_and_text, scratch_path, slices
from narralake.llm.encoding import encoder

BLOCK, SEGMENT, PERCENT, MAGIC = 128, 1 << 18, 0.9, b"NLPFOR1\n"
FILE_BYTES = 256 << 20
_WIDTHS = np.array([0] + [i.bit_length() for i in range(1, 1 << 16)], np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(segment, start of each block's planes in it). ids: uint16, SEGMENT at most. Of a short last block the rest repeats the block's first id."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint16)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[(blocks - 1) * BLOCK]
    grid = full.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    at = int(np.ceil(BLOCK * PERCENT)) - 1
    width = _WIDTHS[np.partition(grid, at, axis=1)[:, at]]
    limit = (np.uint32(1) << width.astype(np.uint32))[:, None]
    row, place = np.nonzero(grid >= limit)
    counts = np.bincount(row, minlength=blocks).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    planes = np.empty(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            some = grid[which]
            bits = np.stack([np.packbits((some >> b) & 1, axis=1) for b in range(int(w))], axis=1).reshape(len(which), -1)
            planes[(starts[which][:, None] + np.arange(bits.shape[1])).ravel()] = bits.ravel()
    head = struct.pack("<III", n, len(row), len(planes))
    return head + low.tobytes() + width.tobytes() + counts.tobytes() + place.astype(np.uint8).tobytes() + grid[row, place].tobytes() + planes.tobytes(), starts[:-1]


def unpack(data: bytes) -> np.ndarray:
    n, extra, size = struct.unpack_from("<III", data)
    blocks = -(-n // BLOCK)
    at = 12

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, counts = take(np.uint16, blocks), take(np.uint8, blocks), take(np.uint8, blocks)
    place, values, planes = take(np.uint8, extra), take(np.uint16, extra), take(np.uint8, size)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    grid = np.zeros((blocks, BLOCK), np.uint16)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            step = BLOCK // 8
            bits = planes[(starts[which][:, None] + np.arange(int(w) * step)).ravel()].reshape(len(which), int(w), step)
            some = np.zeros((len(which), BLOCK), np.uint16)
            for b in range(int(w)):
                some |= np.unpackbits(bits[:, b], axis=1).astype(np.uint16) << b
            grid[which] = some
    grid[np.repeat(np.arange(blocks), counts), place] = values
    return (grid + low[:, None]).ravel()[:n]


class Writer:
    """Writes one file; ids may come in any portions."""

    def __init__(self, stream):
        self.stream, self.at, self.count, self.held, self.size = stream, 0, 0, [], 0
        self.segments: list[tuple[int, int, int, list[int]]] = []
        self.ids, self.sizes = [], []

    def add(self, ids: np.ndarray, doc_ids: pa.Array, sizes: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.ids.append(doc_ids)
        self.sizes.append(sizes)
        if self.size >= SEGMENT:
            whole = np.concatenate(self.held)
            end = len(whole) // SEGMENT * SEGMENT
            for i in range(0, end, SEGMENT):
                self._segment(whole[i : i + SEGMENT])
            self.held, self.size = [whole[end:].copy()], len(whole) - end

    def _segment(self, ids: np.ndarray) -> None:
        data, starts = pack(ids)
        self.segments.append((self.at, self.count, len(ids), starts))
        self.stream.write(data)
        self.at += len(data)
        self.count += len(ids)

    def close(self) -> None:
        if self.size:
            self._segment(np.concatenate(self.held))
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        segments = pa.table({"at": pa.array([s[0] for s in self.segments], pa.int64()), "before": pa.array([s[1] for s in self.segments], pa.int64()), "n": pa.array([s[2] for s in self.segments], pa.int64()), "blocks": pa.array([s[3] for s in self.segments], pa.list_(pa.int64()))})
        docs = pa.table({"doc_id": pa.chunked_array(self.ids, pa.int64()), "before": np.cumsum(sizes) - sizes, "n": sizes})
        for table in (segments, docs):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            part = sink.getvalue().to_pybytes()
            self.stream.write(part + struct.pack("<Q", len(part)))
        self.stream.write(MAGIC)


def _footer(file, size: int) -> tuple[pa.Table, pa.Table]:
    end = size - len(MAGIC)
    found = []
    file.seek(end)
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    for _ in range(2):
        file.seek(end - 8)
        (length,) = struct.unpack("<Q", file.read(8))
        file.seek(end - 8 - length)
        found.append(pa.ipc.open_stream(file.read(length)).read_all())
        end -= 8 + length
    return found[1], found[0]


def _fs(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, ranks: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode, append end_id to each document and write files in ascending id order.

    Returns the manifest (file, first_id, last_id, n_docs, n_tokens, n_bytes, start), one row for each file. A task that
    is run again writes files of other names; only files in the manifest count.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    schema = "file string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, out = encoder(vocabulary, ranks), None
        kind = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "n_docs", "n_tokens", "n_bytes"))])

        def listed() -> pa.RecordBatch:
            out.close()
            stream.close()
            return pa.RecordBatch.from_pylist([{"file": name, "first_id": first, "last_id": last, "n_docs": docs_in, "n_tokens": out.count, "n_bytes": out.at}], kind)

        for whole in batches:
            for batch in slices(whole, 1):
                if out is None:
                    fs, folder = _fs(path)
                    fs.create_dir(folder, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.nlpfor"
                    stream = fs.open_output_stream(f"{folder}/{name}")
                    out, first, docs_in = Writer(stream), batch.column(0)[0].as_py(), 0
                ids, bounds = tokens.encode(batch.column(1))
                sizes = np.diff(bounds) + 1
                ends = np.cumsum(sizes)
                held = np.full(int(ends[-1]), end_id, np.uint16)
                keep = np.ones(len(held), bool)
                keep[ends - 1] = False
                held[keep] = ids
                out.add(held, batch.column(0).cast(pa.int64()), sizes)
                docs_in, last = docs_in + batch.num_rows, batch.column(0)[-1].as_py()
                if out.at + 2 * out.size >= file_bytes:  # written, and held for the next segment
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    keyed = id_and_text(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")
    order = lambda x: (x is not None, x or 0)
    rows = sorted(ordered.mapInArrow(write, schema).collect(), key=lambda r: (order(r.first_id), order(r.last_id), r.file))
    start, manifest = 0, []
    for r in rows:
        manifest.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(manifest, f"{schema}, start long")


def read_tokens(manifest: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it, over all files), n_tokens and ids, or ids_crc32 in place of ids."""
    bound_arrow(manifest.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = fs.get_file_info(f"{folder}/{name}").size
                with fs.open_input_file(f"{folder}/{name}") as file:
                    segments, docs = _footer(file, size)
                    begin, count = docs["before"].to_numpy(), docs["n"].to_numpy()
                    ends = begin + count
                    doc, held, offset = 0, np.zeros(0, np.uint16), 0
                    at, n, before = (segments[c].to_numpy() for c in ("at", "n", "before"))
                    for s in range(len(at)):
                        stop = int(at[s + 1]) if s + 1 < len(at) else size
                        file.seek(int(at[s]))
                        held = np.concatenate([held, unpack(file.read(stop - int(at[s])))])
                        upto = int(np.searchsorted(ends, int(before[s] + n[s]), side="right"))
                        if upto > doc:
                            wide = held.astype("<u4")
                            parts = [wide[begin[d] - offset : ends[d] - offset] for d in range(doc, upto)]
                            last = [zlib.crc32(x) for x in parts] if digest else [x.astype(np.int32) for x in parts]
                            yield pa.RecordBatch.from_arrays([docs["doc_id"].slice(doc, upto - doc).combine_chunks(), pa.array(base + begin[doc:upto]), pa.array(count[doc:upto]), pa.array(last, kind.field(3).type)], schema=kind)
                            held = held[ends[upto - 1] - offset :]
                            offset, doc = int(ends[upto - 1]), upto

    width = max(1, manifest.count())
    tail = "ids_crc32 long" if digest else "ids array<int>"
    return manifest.select("file", "start").repartition(width, "file").mapInArrow(read, f"doc_id long, start long, n_tokens long, {tail}")


def _part(file, at: int, starts: list[int], first: int, last: int) -> np.ndarray:
    """The ids of the blocks first to last - 1 of the segment at `at`; starts: each block's planes in it."""
    file.seek(at)
    n, extra, size = struct.unpack("<III", file.read(12))
    blocks = len(starts)
    meta = file.read(4 * blocks)
    low, width, counts = np.frombuffer(meta, np.uint16, blocks), np.frombuffer(meta, np.uint8, blocks, 2 * blocks), np.frombuffer(meta, np.uint8, blocks, 3 * blocks)
    upto = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    x, y = int(upto[first]), int(upto[last])
    base = at + 12 + 4 * blocks

    def piece(begin: int, end: int) -> bytes:
        file.seek(begin)
        return file.read(end - begin)

    place, values = piece(base + x, base + y), piece(base + extra + 2 * x, base + extra + 2 * y)
    planes = piece(base + 3 * extra + starts[first], base + 3 * extra + (starts[last] if last < blocks else size))
    count = min(n, last * BLOCK) - first * BLOCK
    return unpack(struct.pack("<III", count, y - x, len(planes)) + low[first:last].tobytes() + width[first:last].tobytes() + counts[first:last].tobytes() + place + values + planes)


def read_range(manifest: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """(start, ids) of the ids first to last - 1 of all files together, a row for each segment that has some, by seeking to their blocks."""
    bound_arrow(manifest.sparkSession)
    kind = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = fs.get_file_info(f"{folder}/{name}").size
                with fs.open_input_file(f"{folder}/{name}") as file:
                    segments, _ = _footer(file, size)
                    for s in segments.to_pylist():
                        a, b = max(first - base - s["before"], 0), min(last - base - s["before"], s["n"])
                        if a < b:
                            block = a // BLOCK
                            ids = _part(file, s["at"], s["blocks"], block, -(-b // BLOCK))[a - block * BLOCK : b - block * BLOCK]
                            yield pa.RecordBatch.from_arrays([pa.array([base + s["before"] + a]), pa.array([ids.astype(np.int32)], kind.field(1).type)], schema=kind)

    some = manifest.filter((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    return some.select("file", "start").mapInArrow(read, "start long, ids array<int>")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, ranks: str | None = None, digest: bool = True) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    path = scratch_path(spark, "tokens")
    return read_tokens(write_tokens(docs, path, vocabulary, ranks), path, digest)
