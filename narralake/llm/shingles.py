"""Word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _ODD[0]
    x ^= x >> np.uint64(32)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, bounds of length n + 1). Words: runs of characters other than blank and tab to carriage return, with A-Z as a-z."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.split_pattern(pc.ascii_lower(pc.replace_substring_regex(texts, r"[\x09-\x0d]", " ")), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter(map(digest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    kept = np.concatenate([[0], np.cumsum(full)])
    return table[coded.indices.to_numpy(zero_copy_only=False)[full]], kept[bounds - bounds[0]]


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, text after text, bounds of length n + 1). A text with 1 to k - 1 words has one shingle, its whole sequence; without words none."""
    words, bounds = word_hashes(texts)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words) - k + 1
    found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        found = np.zeros(n, np.uint64)
        for i in range(k):
            found += words[i : i + n] * _ODD[i]
        inside = doc[:n] == doc[k - 1 :]
        found, owner = _mix(found[inside]), doc[:n][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(words[bounds[d] : bounds[d + 1]].tobytes(), seed=k) for d in short], np.uint64)
        found, owner = np.concatenate([found, whole]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        first = np.ones(len(found), bool)
        first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[first], owner[first]
    return found, np.searchsorted(owner, np.arange(len(sizes) + 1))
