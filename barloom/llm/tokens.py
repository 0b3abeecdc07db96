"""Token ids of texts by a public tokenizer file.

Every pre-token of ``word_bpe_49k.json`` lies between two white spaces and is a run of
letters, one digit or a run of other characters, so a block of texts is cut into pre-tokens
with NumPy. Its distinct ones are looked up in what the worker remembers, those that are new
go to the tokenizer's model, and the ids of the block follow by index. Inside a block
pre-tokens are told apart by 64 bits of hash and their length, between blocks by their bytes.

Runs between white space that hold an apostrophe (contractions), what may be a special
token, or anything beyond printable Latin go to the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textkernel import LOWER, SPACE, blocks, edges, mix64, span_hash

WORD_TOKENIZER = "word_bpe_49k.json"
#: Pre-tokens that a worker remembers: two generations of so many.
REMEMBER = 150_000
BLOCK_BYTES = 4 << 20
_OPEN: dict[str, "RunEncoder"] = {}

_NONE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)


def _kind(c: str) -> int:
    """How the tokenizer's pattern sees a character of printable Latin."""
    if c in "'İ":  # contractions; a lower case of two characters
        return _WHOLE
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _OTHER)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of single bytes, and of the UTF-8 pairs U+00A1 to U+024F by lead * 256 + trail."""
    one, two = np.full(256, _WHOLE, np.uint8), np.full(1 << 16, _WHOLE, np.uint8)
    one[SPACE] = _NONE
    for i in range(33, 127):
        one[i] = _kind(chr(i))
    for i in range(0xA1, 0x250):
        lead, trail = chr(i).encode()
        two[lead << 8 | trail] = _kind(chr(i))
    return one, two


_ONE, _TWO = _tables()
#: The characters that stand for bytes in the model: printable Latin-1 for itself, other bytes from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of a block's pre-tokens, whether each is a run to be encoded whole,
    and the block's bytes with A-Z lower-cased outside such runs."""
    kind = _ONE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    if len(lead):
        of = _TWO[(data[lead].astype(np.int64) << 8) | data[lead + 1]]
        kind[lead] = kind[lead + 1] = of
    kind[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = _WHOLE
    start, end = edges(data, at, SPACE)
    odd = np.flatnonzero(kind == _WHOLE)
    if len(odd):
        for run in np.unique(np.searchsorted(start, odd, side="right") - 1).tolist():
            kind[start[run] : end[run]] = _WHOLE
    opens = np.zeros(len(data), bool)
    opens[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _DIGIT) & ((data[1:] & 0xC0) != 0x80))
    opens[start] = True
    opens &= kind != _NONE
    first = np.flatnonzero(opens)
    opens[end[end < len(data)]] = True
    last = np.append(np.flatnonzero(opens), len(data))
    last = last[np.searchsorted(last, first, side="right")]
    return first, last, kind[first] == _WHOLE, np.where(kind == _WHOLE, data, LOWER[data])


class RunEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.width is np.uint16 else "I"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _known(self, keys: list[bytes], whole: list[bool]) -> list[bytes]:
        """Ids of distinct pre-tokens; those not used for a generation are forgotten."""
        found = list(map(self.young.get, keys))
        for i, ids in enumerate(found):
            if ids is None:
                key = keys[i]
                ids = self.old.pop(key, None)
                if ids is None:
                    ids = array(self.code, self._whole(key) if whole[i] else self._one(key)).tobytes()
                self.young[key] = found[i] = ids
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        return found

    def _one(self, part: bytes) -> list[int]:
        if part.isascii():
            chars = part.decode("ascii")
        else:
            chars = part.decode("utf-8").lower().encode("utf-8").decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(chars)]

    def _whole(self, run: bytes) -> list[int]:
        return self.tokenizer.encode(run.decode("utf-8"), add_special_tokens=False).ids

    def _looked_up(self, data: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of a block's distinct pre-tokens, which of them each pre-token is, and the rows' first ones."""
        start, end, whole, lower = parts(data, at)
        key = mix64(span_hash(lower, start, end) + (end - start).astype(np.uint64))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        raw = lower.tobytes()
        keys = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        return self._known(keys, whole[first].tolist()), which, np.searchsorted(start, at)

    def block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts, one after the other, and the n + 1 offsets of its rows in them."""
        found, which, ptr = self._looked_up(data, at)
        flat = np.frombuffer(b"".join(found), self.width)
        size = np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize
        begin = np.cumsum(size) - size
        size, begin = size[which], begin[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[ptr]

    def sizes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of ids of each row of a block."""
        found, which, ptr = self._looked_up(data, at)
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.width).itemsize
        return np.diff(np.concatenate([[0], np.cumsum(size[which])])[ptr])

    def encode(self, raw: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian integers of ``width``."""
        return self.block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()


def encoder(name: str = WORD_TOKENIZER) -> RunEncoder:
    """One per worker process; ``name`` is a file of the public tokenizers or a path."""
    if name not in _OPEN:
        import public_tokenizers

        _OPEN[name] = RunEncoder(name if os.path.sep in name else public_tokenizers.path(name))
    return _OPEN[name]


def encoded(column: pa.Array, enc: RunEncoder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows: their ids, and the n + 1 offsets of the rows in them; null counts as empty."""
    for _, _, data, at in blocks(column, BLOCK_BYTES):
        yield enc.block(data, at)


def token_counts(column: pa.Array, enc: RunEncoder) -> np.ndarray:
    """The number of ids of each row; null counts as empty."""
    return np.concatenate([np.zeros(0, np.int64), *(enc.sizes(data, at) for _, _, data, at in blocks(column, BLOCK_BYTES))])
