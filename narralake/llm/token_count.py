"""Operator 7: token counts of a unigram vocabulary without building tokens.

A text is cut at blanks as by the tokenizers library's Metaspace (blank as U+2581, one put in front). Aho-Corasick lists
all vocabulary matches of a word by their ends, longest first; dynamic programming over ends carries the best score
and the number of pieces on that path. Ties: a later candidate must be strictly better, so of equal paths the one whose
last piece starts first wins; a character without a piece of its own is an unknown with the least score less 10, and
neighbouring unknowns count as one. These are the rules of the tokenizers library's Unigram model, whose counts the
results equal. A word's count is kept for later occurrences.

Nulls: a null or empty text has 0 tokens; null ids stay. Empty tables give no rows, repeated rows equal rows. Very long
texts are counted whole, one word of any length in one pass over its ends; counts of words of over 64 characters aren't
kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from narralake.llm.common import bound_arrow, id_and_text, slices

MARK, PENALTY = "▁", 10.0


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without its control and byte pieces; place 0 is the unknown."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0), *((model.id_to_piece(i), float(model.get_score(i))) for i in usual)]


class Counter(dict):
    """word (with its mark in front) -> number of pieces."""

    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = 500_000):
        import ahocorasick

        self.automaton, self.limit = ahocorasick.Automaton(), limit
        for piece, score in vocabulary[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - PENALTY

    def __missing__(self, word: str) -> int:
        found = self.count(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def count(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces, unknown, single = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        at = 0  # ends up to here are final
        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            while at < end - 1:
                at += 1
                self._unknown(at, best, pieces, unknown, single)
            start = end - length
            if length == 1:
                single[end] = True
            candidate = best[start] + score
            if best[end] is None or candidate > best[end]:
                best[end], pieces[end], unknown[end] = candidate, pieces[start] + 1, False
        while at < n:
            at += 1
            self._unknown(at, best, pieces, unknown, single)
        return pieces[n]

    def _unknown(self, end: int, best: list, pieces: list[int], unknown: list[bool], single: list[bool]) -> None:
        if single[end]:
            return
        candidate = best[end - 1] + self.unknown
        if best[end] is None or candidate > best[end]:
            best[end], pieces[end], unknown[end] = candidate, pieces[end - 1] + (not unknown[end - 1]), True

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), " ", MARK)
        marked = pc.if_else(pc.or_(pc.equal(texts, ""), pc.starts_with(texts, MARK)), texts, pc.binary_join_element_wise(pa.scalar(MARK), texts, ""))
        lists = pc.split_pattern(marked, MARK)  # what is before the first mark is empty
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if len(self) > self.limit:
            self.clear()
        table = np.fromiter((self[MARK + w] for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        each = table[coded.indices.to_numpy(zero_copy_only=False)]
        bounds = bounds - bounds[0]
        each[bounds[:-1]] = 0
        return np.add.reduceat(each, bounds[:-1]) if len(each) else np.zeros(len(texts), np.int64)


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens."""
    bound_arrow(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = Counter(unigram_vocabulary(model_path))
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(_COUNTERS[model_path].counts(batch.column(1)))], ["doc_id", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")
