"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are
64-bit and depend on the bytes alone, so they agree across batches, tasks and
runs; where one stands for a value across many texts, the bytes are compared or a
second hash is kept beside it. Work runs in windows of some MB, so one very long text stays bounded by a
few times its own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Ranges longer than this go through a cryptographic hash, one by one.
LONG = 256
_BYTES_KEPT = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is no letter: for words without the marks around them.
LETTERS_ONLY = np.zeros(256, bool)
LETTERS_ONLY[:128] = True
LETTERS_ONLY[65:91] = LETTERS_ONLY[97:123] = False
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,!?;:%&*#$")] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of ``buf`` on, as one number each; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def _span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every ``buf[start:end]``, eight bytes a step, each step a bijection of what was before."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    lanes = _lanes(buf)
    at, left, rows = starts, size, None
    if len(size) and size.max() > LONG:
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        rows = np.flatnonzero(size <= LONG)
        at, left = starts[rows], size[rows]
    h = out if rows is None else out[rows]
    while len(h):
        h = mix((h ^ (lanes[at] & _BYTES_KEPT[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93))
        if rows is None:
            out = h
        else:
            out[rows] = h
        more = left > 8
        kept = np.flatnonzero(more)
        rows = kept if rows is None else rows[kept]
        h, at, left = h[kept], at[kept] + 8, left[kept] - 8
    return out


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each ``a_starts`` on equal those from ``b_starts`` on."""
    out = np.ones(len(size), bool)
    x, y = _lanes(a), _lanes(b)
    rows = np.flatnonzero(size > 0)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = a[a_starts[i] : a_starts[i] + size[i]].tobytes() == b[b_starts[i] : b_starts[i] + size[i]].tobytes()
    rows = rows[size[rows] <= LONG]
    done = 0
    while len(rows):
        off = (x[a_starts[rows] + done] ^ y[b_starts[rows] + done]) & _BYTES_KEPT[np.minimum(size[rows] - done, 8)]
        out[rows[off != 0]] = False
        done += 8
        rows = rows[(off == 0) & (size[rows] > done)]
    return out


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of ``column`` of about ``limit`` bytes; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(size):
        if i > first and held + n > limit:
            yield first, i - first
            first, held = i, 0
        held += int(n)
    if len(size) > first:
        yield first, len(size) - first


class Texts:
    """The bytes of some texts, one after another; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.n = len(column)
        self.offsets = at - at[0]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = whole[at[0] : at[-1]]

    def words(self, lower: bool = True, between: np.ndarray = _SPACE) -> "Words":
        buf, n = self.buf, len(self.buf)
        if not n:
            none = np.zeros(0, np.int64)
            return Words(self, none, none, np.zeros(0, np.uint64))
        inside = ~between[buf]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        del inside, before, after
        return Words(self, starts, ends, self.spans(starts, ends, lower))

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z in lower case, as an array of their own."""
        return _LOWER[self.buf]

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """Bytes of each text that the table ``wanted`` of 256 marks."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(wanted[self.buf], out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of every \\n-split line."""
        breaks = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
        per = np.bincount(np.searchsorted(self.offsets, breaks, "right") - 1, minlength=self.n) + 1
        return starts, ends, np.repeat(np.arange(self.n), per)

    def spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of ascending, disjoint byte ranges, window by window."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
            piece = self.buf[base : ends[j - 1]]
            out[i:j] = _span_hash(_LOWER[piece] if lower else piece, starts[i:j] - base, ends[i:j] - base)
            i = j
        return out


class Words:
    """Words of some texts: byte ranges, hashes, and where each text's words begin."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.texts, self.starts, self.ends, self.hashes = texts, starts, ends, hashes
        self.first = np.searchsorted(starts, texts.offsets)
        self.counts = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text's number, for every word."""
        return np.repeat(np.arange(self.texts.n), self.counts)

    def tails(self) -> np.ndarray:
        """Where words part into an ASCII letter and the marks after it that end them, ascending.

        Patterns that keep runs of letters apart from runs of marks part there too.
        The marks leave out the apostrophe and the brackets of special tokens.
        """
        if not len(self.starts):
            return self.starts
        buf = self.texts.buf
        kept = np.where(_TAIL[buf], 0, np.arange(len(buf)))
        body = np.maximum.accumulate(kept)[self.ends - 1] + 1
        parted = (body < self.ends) & (body > self.starts)
        parted[parted] = ~LETTERS_ONLY[buf[body[parted] - 1]] & (buf[body[parted] - 1] < 128)
        return body[parted]

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; runs past a text's end are for the caller to skip."""
        h = self.hashes
        m = max(0, len(h) - k + 1)
        out = np.full(m, k, np.uint64)
        for j in range(k):
            out = mix(out * np.uint64(3) + h[j : j + m])
        return out


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, ascending; fewer words make one shingle, none an empty set."""
    grams = words.grams(k)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(grams[a : a + n - k + 1]))
        elif n:
            h = np.full(1, n, np.uint64)
            for x in words.hashes[a : a + n]:
                h = mix(h * np.uint64(3) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bytes_table(of: str) -> np.ndarray:
    """A table of 256 that marks the ASCII characters in ``of``."""
    table = np.zeros(256, bool)
    table[list(of.encode())] = True
    return table


#: Bytes that begin a character other than ``[\x20\x09-\x0D]``: one for each code point in a word.
WORD_CHARACTER = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)
