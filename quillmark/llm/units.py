"""Token ids of texts by way of their distinct units: each unit is encoded once, then gathered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quillmark.llm.text import Texts, mix, same_bytes


class UnitIds:
    """Ids of byte ranges, found by a 64-bit hash and known by their bytes.

    ``encode`` turns the texts of new ranges into their ids, one after another, and
    the number of ids of each.

    Between calls it keeps what fits ``most`` units, LARGE ids and LARGE bytes, so a
    worker's memory is bounded.
    """

    LARGE = 12_000_000

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.uint8)
        self.from_ = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def look_up(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, spelt: np.ndarray | None = None) -> np.ndarray:
        """Row numbers of the ranges in ``at`` and ``size``; they hold until the next call.

        Ranges are the same unit if their bytes in ``spelt`` (the texts' own, if none) are.
        """
        spelt, length, hashes = texts.buf if spelt is None else spelt, ends - starts, hashes.copy()
        if len(self.hash) > self.most or max(len(self.flat), len(self.bytes)) > self.LARGE:
            self._clear()
        while True:
            distinct, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
            other = ~self._alike(spelt, starts, length, spelt, starts[first][kind], length[first][kind])
            at = np.searchsorted(self.hash, distinct)
            known = np.zeros(len(distinct), bool)
            inside = at < len(self.hash)
            known[inside] = self.hash[at[inside]] == distinct[inside]
            own, row = first[known], at[known]
            off = np.zeros(len(distinct), bool)
            off[known] = ~self._alike(spelt, starts[own], length[own], self.bytes, self.from_[row], self.length[row])
            other |= off[kind]
            if not other.any():
                break
            hashes[other] = mix(hashes[other] + np.uint64(0x9E3779B97F4A7C15))  # another unit has this hash
        if not known.all():
            own = first[~known]
            data = texts.buf.data
            made, size = self.encode([bytes(data[a:b]) for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            order = np.argsort(np.concatenate([self.hash, distinct[~known]]), kind="stable")
            self.hash = np.concatenate([self.hash, distinct[~known]])[order]
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.flat = np.concatenate([self.flat, made])
            self.from_ = np.concatenate([self.from_, len(self.bytes) + np.cumsum(length[own]) - length[own]])[order]
            self.length = np.concatenate([self.length, length[own]])[order]
            self.bytes = np.concatenate([self.bytes, gathered(spelt, starts[own], length[own])])
            at = np.searchsorted(self.hash, distinct)
        return at[kind]

    @staticmethod
    def _alike(a: np.ndarray, a_starts: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_size: np.ndarray) -> np.ndarray:
        out = a_size == b_size
        out[out] = same_bytes(a, a_starts[out], b, b_starts[out], a_size[out])
        return out

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after another."""
        return gathered(self.flat, self.at[rows], self.size[rows])


def gathered(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[at : at + size]`` of every row, one after another."""
    total = int(size.sum())
    shift = np.repeat(at - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(total)]
