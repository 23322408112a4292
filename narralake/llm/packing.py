"""Operator 9: pack token sequences into fixed-size windows, certified by lower bounds.

Pieces are dealt to partitions by a hash of (document, piece) and packed there by best-fit decreasing. For each
partition the largest of a family of dual-feasible-function bounds says how few windows its pieces need at least.
Windows that a bound cannot fault (full ones) are final. Of every partition, the LEAVE windows with most free room
(more if the partition misses its bound) give their pieces to an exchange: FAN partitions' leavings form one new
partition, which is packed and certified again, until one partition is left. A round moves windows, never all
pieces, so no task holds more than a partition or FAN * leavings, at any size of input.

Nulls: a null text is an empty one and still gets its end token; null ids stay, their pieces are told apart by number
and checksum only. Empty tables give no rows. Repeated rows are packed each for itself, and equal sizes in any order.
Only texts longer than a window are cut. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralake.llm.common import bound_arrow, id_and_text, materialize, slices
from narralake.llm.encoding import encoder

CAPACITY, PER_PART, FAN, LEAVE = 4096, 4_096, 8, 48
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", part int, sequence_id long, offset long, final boolean, bins long, bound long"


def bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest lower bound on the number of windows over two families of dual feasible functions."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    value = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * value).sum()) // capacity)
    # u0(e): sizes over capacity - e count as a whole window, those under e as nothing.
    upto, weight = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * value)])
    e = np.arange(1, capacity // 2 + 1)
    whole = upto[-1] - upto[capacity - e + 1]
    some = weight[capacity - e + 1] - weight[e]
    best = max(best, int((whole + -(-some // capacity)).max()))
    # u1(k): sizes are rounded down to multiples of 1/k of a window, where (k + 1) * size / capacity is not whole.
    for k in range(1, 65):
        scaled = (k + 1) * value
        units = np.where(scaled % capacity == 0, scaled // capacity * k, scaled // capacity * (k + 1))
        best = max(best, -(-int((counts * units).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window of each size, its place there, room left in each window); sizes must not be over the capacity."""
    order = np.argsort(-sizes, kind="stable")
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if some window has exactly r tokens left
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits and size:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, k = capacity, len(rooms)
            rooms.append(capacity)
        window[i], offset[i] = k, capacity - room
        rooms[k] = left = room - size
        by_room[left].append(k)
        mask |= 1 << left
    return window, offset, np.array(rooms, np.int64)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents, add the end id and cut those longer than `capacity`; one row for each piece."""
    bound_arrow(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, bounds = tokens.encode(batch.column(1))
                wide, rows = ids.astype("<u4"), []
                tail = np.array([end_id], "<u4")
                for d, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.concatenate([wide[a:b], tail])
                    rows += [(d, p, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity])) for p, s in enumerate(range(0, len(own), capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, _PIECES)


def _packer(level: int, last: bool, capacity: int):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        sizes = part["length"].to_numpy(np.int64)
        window, offset, rooms = best_fit_decreasing(sizes, capacity)
        least = bound(sizes, capacity)
        leave = 0 if last else LEAVE + 4 * (len(rooms) - least)
        open_ = np.argsort(-rooms, kind="stable")[:leave]
        open_ = open_[rooms[open_] > 0]
        final = np.ones(len(rooms), bool)
        final[open_] = False
        number = int(part["part"].iloc[0])
        return part.assign(sequence_id=(level << 56) + (number << 32) + window, offset=offset, final=final[window], bins=len(rooms), bound=least)

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PER_PART) -> DataFrame:
    """pieces: doc_id, piece, start, length, ids_crc32. Adds part, sequence_id, offset and the certificate (bins, bound) of the partition that placed a row."""
    stored = materialize(pieces, "pieces")
    n = max(1, -(-stored.count() // per_part))
    pool = stored.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    done, level = [], 0
    while True:
        placed = materialize(pool.groupBy("part").applyInPandas(_packer(level, n == 1, capacity), _PACKED), f"packed{level}")
        done.append(placed.filter("final"))
        if n == 1:
            break
        pool, n, level = placed.filter("NOT final").select(*[c.split()[0] for c in _PIECES.split(", ")], (F.col("part") / FAN).cast("int").alias("part")), -(-n // FAN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("final")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(token_pieces(docs, vocabulary, capacity, 1, id_col, text_col), capacity)
