"""Canonical length-limited Huffman codes, encoded and decoded with numpy.

``code_lengths`` finds the best code lengths under a limit by package-merge. ``Code`` holds the
canonical code of those lengths: the lengths alone rebuild it, so they are all a file has to keep.
Decoding looks up ``limit`` bits at a time in one table and runs many segments side by side: every
segment starts at a checkpoint, a bit offset stored for each ``EVERY`` ids of a document.
"""

from __future__ import annotations

import numpy as np

#: Bits of the longest code; the table of a decoder has 2 ** LIMIT entries.
LIMIT = 18
#: Ids between two checkpoints.
EVERY = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``limit`` (0 for a count of 0).

    Package-merge: of ``limit`` rows, each merges the symbols with the pairs of the row before;
    a symbol's length is the number of rows in which it is among the cheapest 2n - 2 in all.
    One symbol alone gets a code of one bit.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    rows, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        by = np.argsort(merged, kind="stable")
        rows.append(by < n)
        merged = merged[by]
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2)
        packages = pairs.sum(axis=1)
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_symbol in reversed(rows):
        chosen = is_symbol[:take]
        k = int(chosen.sum())
        depth[:k] += 1
        take = 2 * (len(chosen) - k)
    lengths[order] = depth
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths, self.limit = lengths.astype(np.int64), limit
        ids = np.flatnonzero(lengths)
        self.order = ids[np.lexsort((ids, self.lengths[ids]))]
        size = np.int64(1) << (limit - self.lengths[self.order])
        start = np.cumsum(size) - size  # of each code's span in the table
        self.codes = np.zeros(len(lengths), dtype=np.int64)
        self.codes[self.order] = start >> (limit - self.lengths[self.order])
        self._span = size
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, padded to bytes, and the bit offset of every ``EVERY``-th id."""
        length, code = self.lengths[ids], self.codes[ids]
        at = np.cumsum(length) - length
        total = int(at[-1] + length[-1]) if len(ids) else 0
        out = np.zeros(total // 8 + 5)
        first, word = at >> 3, code << (32 - length - (at & 7))
        for k in range(4):  # codes do not share bits, so sums of their bytes are the bytes
            part = (word >> (24 - 8 * k)) & 255
            out += np.bincount(first + k, weights=part, minlength=len(out))[: len(out)]
        return out[: (total + 7) // 8].astype(np.uint8).tobytes(), at[::EVERY].astype(np.int64)

    def _lookup(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            symbol = np.zeros(1 << self.limit, dtype=np.uint32)
            length = np.ones(1 << self.limit, dtype=np.uint8)
            filled = int(self._span.sum())
            symbol[:filled] = np.repeat(self.order, self._span)
            length[:filled] = np.repeat(self.lengths[self.order], self._span)
            self._table = symbol, length
        return self._table

    def decode(self, data: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of all segments in order; a segment starts at its checkpoint and has its size."""
        symbol, length = self._lookup()
        raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        place = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype="<u4")
        by = np.argsort(-sizes, kind="stable")  # the segments still running are a head of this
        at, to, left = checkpoints[by].copy(), place[by].copy(), sizes[by]
        ends = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), side="right")
        for running in ends.tolist():
            p = at[:running]
            key = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - self.limit)
            out[to[:running]] = symbol[key]
            at[:running] += length[key]
            to[:running] += 1
        return out
