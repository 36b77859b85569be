"""Word splitting and word-window hashing over whole Arrow text batches.

Every delimiter of the two word classes is a single ASCII byte, so words are found on the UTF-8 bytes with NumPy
and no text is decoded. A word is known by a 64-bit hash of its bytes: each eight bytes are mixed with their place
before they are added up, so that no pattern of bytes cancels out. A window is known by a 64-bit hash of its words'
hashes. Two different words or windows share a hash with a chance of about 2**-64 a pair.

Nulls count as empty texts. A text of any length is handled whole: ``slices`` cuts a batch between texts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_BYTES = np.arange(256)
#: [^\x20\x09-\x0D]+
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z have been lower-cased
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)

_WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The first n bytes of eight, for n from 0 to 8.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, byte offsets of its rows) of runs of rows with at most ``limit`` bytes, or one longer row."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


@dataclass
class Words:
    """``starts``/``ends``: byte places of the words; ``first``: for each text its first word, and the end; ``hashes``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of the first ``k`` bytes, eight at most, of each word of more than ``k`` bytes."""
        long = np.flatnonzero(self.ends - self.starts > k)
        return mix((_eights(self.data)[self.starts[long]] & _MASKS[k]) * _ODD + np.uint64(k << 32)), self.text_of_word()[long]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; ``data`` has eight bytes more than its texts."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    eights = _eights(data)
    total = mix(eights[starts] & _MASKS[np.minimum(sizes, 8)])
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        to = np.cumsum(more)
        block = np.arange(to[-1]) - np.repeat(to - more, more) + 1
        left = np.minimum(np.repeat(sizes[long], more) - 8 * block, 8)
        place = mix(block.astype(np.uint64)) | np.uint64(1)
        mixed = mix((eights[np.repeat(starts[long], more) + 8 * block] & _MASKS[left]) * place + place)
        total[long] += np.add.reduceat(mixed, to - more)
    return mix(total + sizes.astype(np.uint64) * _ODD)


def split(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool) -> Words:
    """Words of texts that lie one after another in ``data``."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    inside = word_bytes[padded[:n]]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    at = offsets[(offsets < n)]
    begin[at] = inside[at]
    at = offsets[(offsets > 0)] - 1
    finish[at] = inside[at]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(padded, starts, ends, np.searchsorted(starts, offsets), _hashes(padded, starts, ends))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, text) of each run of ``k`` consecutive words within one text, in order."""
    h = words.hashes
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    total = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        total *= _WINDOW_BASE
        total += h[j : len(h) - k + 1 + j]
    text = words.text_of_word()[: len(total)]
    at = np.flatnonzero(np.arange(k, len(h) + 1) <= words.first[text + 1])
    return mix(total[at] + np.uint64(k)), at, text[at]


def covered(starts: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """For each word whether a run of ``k`` words from one of ``starts`` holds it."""
    edge = np.zeros(n_words + k + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:n_words]) > 0
