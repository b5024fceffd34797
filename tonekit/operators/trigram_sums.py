"""Sums of trigram weights per text (N9), with numpy over Arrow batches.

A profile has few trigrams, whatever the number of texts and of different words: its table of weights is broadcast once, and
each text gets the number of its trigrams and the sum of their weights per language in the stage that reads it. No text, word
or trigram is shuffled for it.

Texts come as Spark made them: lower-cased words with one blank between them and around them, so a trigram is a letter with
what stands before and after it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql.functions import arrow_udf

# Ship this module's code with the task (pickle by value): executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Weights that are looked up at a time; a batch of texts is worked off in slices.
SLICE_CELLS = 1 << 19
#: Cells of the tables by letter pair and by pair and letter; beyond that a trigram is searched by bisection.
DIRECT_CELLS = 1 << 24
BLANK = 0x20


#: ``alphabet, keys, weights``. Letters are numbered from 1 by ``alphabet``; a trigram of letters a, b, c has the key
#: ``(a * base + b) * base + c`` and a row of weights. No class of this module: broadcasts are pickled by reference.
TrigramTable = tuple[np.ndarray, np.ndarray, np.ndarray]


def trigram_table(trigrams: list[str], weights: np.ndarray) -> TrigramTable:
    """``weights``: a row per trigram, a column per language. What is no trigram is left out: no text has it."""
    whole = [i for i, t in enumerate(trigrams) if t is not None and len(t) == 3 and t[1] != " "]
    points = np.frombuffer("".join(trigrams[i] for i in whole).encode("utf-32-le"), "<u4").reshape(-1, 3)
    alphabet, numbers = np.unique(points, return_inverse=True)
    a, b, c = (numbers.reshape(-1, 3) + 1).astype(np.int64).T
    base = len(alphabet) + 1
    keys = (a * base + b) * base + c
    order = np.argsort(keys)
    return alphabet, keys[order], np.vstack([weights[whole][order], np.zeros((1, weights.shape[1]))])


def _rows_of(alphabet: np.ndarray, keys: np.ndarray):
    """A function from code points to the rows of the weights of the trigrams around them; the last row is of those not in the profile."""
    base, n = len(alphabet) + 1, len(keys)
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(1, base)
    pairs = np.unique(keys // base)
    direct = base * base <= DIRECT_CELLS and (len(pairs) + 1) * base <= DIRECT_CELLS
    if direct:
        pair_at = np.zeros(base * base, np.int32)
        pair_at[pairs] = np.arange(1, len(pairs) + 1)
        row_at = np.full((len(pairs) + 1) * base, n, np.int32)
        row_at[pair_at[keys // base].astype(np.int64) * base + keys % base] = np.arange(n)

    def rows(points: np.ndarray) -> np.ndarray:
        x = number[points]
        out = np.full(len(points), n, np.int32)
        if direct:
            out[1:-1] = row_at[pair_at[x[:-2] * base + x[1:-1]] * base + x[2:]]
        elif n:
            x = x.astype(np.int64)
            key = (x[:-2] * base + x[1:-1]) * base + x[2:]
            at = np.minimum(np.searchsorted(keys, key), n - 1)
            out[1:-1] = np.where(keys[at] == key, at, n)
        return out

    return rows


def text_summer(table: TrigramTable):
    """A function from an Arrow array of texts to ``(number of trigrams, sums of weights)``, a row per text."""
    alphabet, keys, weights = table
    rows, n_langs = _rows_of(alphabet, keys), weights.shape[1]
    columns = [np.ascontiguousarray(w) for w in weights.T]
    step = max(1, SLICE_CELLS // max(1, n_langs))

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts, sums = np.zeros(len(texts), np.int64), np.zeros((n_langs, len(texts)))
        if not len(texts):
            return counts, sums
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = memoryview(data)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        octets, raw = np.frombuffer(data, np.uint8), bytes(data)
        low, last = 0, len(raw) - 1
        while low < last:
            # slices end at a blank, which the next one begins with: no trigram is cut, none counts twice
            high = raw.index(b" ", min(low + step, last))
            part = octets[low:high + 1]
            first, final = np.searchsorted(offsets, [low, high], "right") - 1
            begins = np.maximum(offsets[first:final + 1], low) - low
            if part.max() >= 0x80:
                begins = np.cumsum((part & 0xC0) != 0x80)[begins] - 1
                part = np.frombuffer(raw[low:high + 1].decode().encode("utf-32-le"), "<u4")
            at = rows(part)
            counts[first:final + 1] += np.add.reduceat(part != BLANK, begins, dtype=np.int64)
            for k, column in enumerate(columns):
                sums[k, first:final + 1] += np.add.reduceat(column[at], begins)
            low = high
        return counts, sums

    return run


def sums_udf(table: Broadcast, n_langs: int):
    """Arrow function: text -> ``n`` trigrams and ``s0, s1, ...``, the sums of their weights per language."""
    names = ["n", *[f"s{k}" for k in range(n_langs)]]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        summed = text_summer(table.value)
        for texts in batches:
            counts, sums = summed(texts)
            yield pa.StructArray.from_arrays([pa.array(counts), *[pa.array(s) for s in sums]], names)

    return arrow_udf(run, "n long" + "".join(f", s{k} double" for k in range(n_langs)))
