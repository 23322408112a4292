"""Exact, memoised tokenizer calls on Arrow arrays.

A cut in front of a space that follows a character other than white space never changes the tokens: no token
pattern of these vocabularies goes on from such a character to white space, and none looks behind. Texts are
therefore split at spaces, every distinct piece is encoded once by the tokenizer itself, and the ids are gathered.
Texts with runs of white space around a space, or with a special token's string, take the tokenizer's plain path.
"""

from __future__ import annotations

import array
import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PLAIN = rf"{_SPACE} {_SPACE}|{_SPACE} $|<\|"
#: Letters whose lower case, normal form and class are one code point in every Unicode version.
_SIMPLE = re.compile(r"[\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z\xdf-\xf6\xf8-\xff0-9]+")


def _byte_letters() -> list[str]:
    """The usual printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


MEMO = 96 << 20


class Memo(dict):
    """piece -> ids as little-endian unsigned 16-bit integers; emptied when it holds more than about `limit` bytes."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.held = encode, limit, 0

    def __missing__(self, piece: str) -> bytes:
        ids = array.array("H", self.encode(piece)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
            self.held += 200 + 2 * len(piece) + len(ids)  # two objects with their heads, and the table's entry
        return ids

    def trim(self) -> None:
        if self.held > self.limit:
            self.clear()
            self.held = 0


class Encoder:
    """ids of whole texts, equal to the tokenizers library's with add_special_tokens=False.

    path: a tokenizer file; ranks: for a byte-level vocabulary, the same vocabulary as a rank file, which is only
    used to encode single pieces faster; memo: bytes that each table of pieces may hold.
    """

    def __init__(self, path: str, ranks: str | None = None, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("vocabularies of more than 65536 ids are not supported")
        if ranks:
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.spaces_count = True
            self.first, self.rest = Memo(fast.encode_ordinary, memo), Memo(lambda piece: fast.encode_ordinary(" " + piece), memo)
        else:
            self.spaces_count = False
            self.letters = _byte_letters()
            self.words = Memo(self._word, memo)
            self.first = self.rest = Memo(self._piece, memo)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        letters = self.letters
        return [t.id for t in self.tokenizer.model.tokenize("".join([letters[b] for b in word.encode()]))]

    def _piece(self, piece: str) -> list[int]:
        if "<|" in piece or not _SIMPLE.fullmatch(piece):
            return self.plain(piece)
        out = array.array("H")
        for word in _PIECES.findall(piece.lower()):
            out.frombytes(self.words[word])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint16, offsets of length n + 1); a null text is an empty one."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        for memo in {id(m): m for m in (self.first, self.rest, getattr(self, "words", self.first))}.values():
            memo.trim()
        if self.spaces_count:
            odd = pc.match_substring_regex(texts, _PLAIN).to_numpy(zero_copy_only=False)
        else:
            odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten()
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = list(map(self.rest.__getitem__, coded.dictionary.to_pylist()))
        if self.spaces_count:  # a text's first piece has no space in front
            heads = starts[:-1] - starts[0]
            firsts = pieces.take(pa.array(heads)).to_pylist()
            index[heads] = len(values) + np.arange(n)
            values += [self.first[p] for p in firsts]
        for i in np.flatnonzero(odd):
            index[starts[i] - starts[0]] = len(values)
            values.append(array.array("H", self.plain(texts[i].as_py())).tobytes())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 2
        flat = np.frombuffer(b"".join(values), np.uint16)
        where = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(values) else np.zeros(0, np.int64)
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat((where[index] - (ends - lengths)).astype(np.int32), lengths)
        ids = flat[shift + np.arange(total, dtype=np.int32)]
        bounds = np.concatenate([[0], ends])[starts - starts[0]]
        return ids, bounds


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None = None, memo: int = MEMO) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = (path, ranks, memo)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, ranks, memo)
    return _ENCODERS[key]
