"""Operator 12: periodic runs of words, by the branching-tandem test on an enhanced suffix array.

Texts are taken in batches of about ``BATCH`` bytes, each a vectorised pass without tree nodes:

1. Words become numbers; suffixes are ordered by prefix doubling, document first, so that only repeats inside a
   document matter; only suffixes not yet alone are sorted again. The ranks of each level give the LCP table.
2. Every LCP entry names an interval (the nearest smaller entries left and right) and, by the nearest entries
   not greater, its children. Of each interval all children but the largest are listed; a suffix i of
   a listed child is tested for ISA[i + depth] and ISA[i - depth] inside the interval but outside the child: two equal
   stretches of that depth side by side that the next word parts, the last square of a run.
3. Squares are rotated left as far as the period holds and merged: of squares with one end, those that a run of a
   smaller period covers are powers of it.

A run is a maximal stretch with smallest period q and at least ``max(least, 2 * q)`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import WORD, n_words, table

#: Bytes of text in one vectorised pass (a longer text is a pass of its own), words of the shortest run.
BATCH, LEAST = 1 << 20, 12
STEPS = 16


def _ordered(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, inverse and the ranks by 1, 2, 4, ... words (one entry past the end, for steps that leave the text)."""
    n = len(codes)
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    sa = np.argsort(key, kind="stable")
    rank = np.full(n + 1, -1, np.int32)

    def number(slots: np.ndarray, suffixes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank suffixes by the first slot of their equals; slots and suffixes that are not alone."""
        new = np.empty(len(keys), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        rank[suffixes] = first
        alone = new & np.append(new[1:], True)
        return slots[~alone], suffixes[~alone]

    slots, suffixes = number(np.arange(n), sa, key[sa])
    levels, step = [rank.copy()], 1
    while len(slots):
        ahead = suffixes + step
        inside = ahead < n
        ahead[~inside] = n
        inside &= doc[np.minimum(ahead, n - 1)] == doc[suffixes]
        keys = rank[suffixes].astype(np.int64) * (n + 1) + np.where(inside, rank[ahead] + 1, 0)
        order = np.argsort(keys, kind="stable")
        suffixes = suffixes[order]
        sa[slots] = suffixes
        slots, suffixes = number(slots, suffixes, keys[order])
        levels.append(rank.copy())
        step *= 2
    isa = np.empty(n + 1, np.int64)
    isa[sa] = np.arange(n)
    isa[n] = -1
    return sa, isa, levels


def _lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """``lcp[k]``: words that the suffixes at k - 1 and k share; -1 at both ends."""
    n = len(sa)
    lcp = np.zeros(n + 1, np.int64)
    lcp[0] = lcp[n] = -1
    same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    x, y, length = sa[same].copy(), sa[same + 1].copy(), np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = np.flatnonzero(levels[k][np.minimum(x, n)] == levels[k][np.minimum(y, n)])
        for part in (x, y, length):
            part[equal] += 1 << k
    lcp[same + 1] = length
    return lcp


def _nearest(lcp: np.ndarray, at: np.ndarray, to: np.ndarray, strict: bool) -> np.ndarray:
    """From pointers ``to`` on, jump over entries above (``strict``: or equal to) one's own; ``to`` has an entry per slot."""
    while len(at):
        passed = lcp[to[at]] >= lcp[at] if strict else lcp[to[at]] > lcp[at]
        at = at[passed]
        to[at] = to[to[at]]
    return to


def squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandems: equal neighbours of ``period`` words that the next word parts."""
    n = len(sa)
    at = np.flatnonzero(lcp[:n] > 0)
    every = np.arange(n + 1)
    after = _nearest(lcp, at, np.minimum(every + 1, n), False)
    before = _nearest(lcp, at, np.maximum(every - 1, 0), False)
    high = _nearest(lcp, at, after.copy(), True)
    low = _nearest(lcp, at, before.copy(), True)
    # the interval of entry k is low[k] .. high[k] - 1; its first entry stands for it
    first = np.where(lcp[before] == lcp, before, every)
    while True:
        further = first[first[at]]
        if np.array_equal(further, first[at]):
            break
        first[at] = further
    head = at[first[at] == at]
    lo = np.concatenate([at, low[head]])
    hi = np.concatenate([after[at], head])
    owner = np.concatenate([first[at], head])
    size = hi - lo
    order = size * (len(lo) + 1) + np.arange(len(lo))
    largest = np.zeros(n + 1, np.int64)
    np.maximum.at(largest, owner, order)
    listed = np.flatnonzero(order != largest[owner])
    size = size[listed]
    child = np.repeat(listed, size)
    slot = lo[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)
    i, k = sa[slot], owner[child]
    depth, left, right, lo, hi = lcp[k], low[k], high[k], lo[child], hi[child]

    def other_child(j: np.ndarray) -> np.ndarray:
        p = isa[np.where((j >= 0) & (j < n), j, n)]
        return (p >= left) & (p < right) & ((p < lo) | (p >= hi))

    ahead, back = other_child(i + depth), other_child(i - depth)
    start = np.concatenate([i[ahead], (i - depth)[back]])
    period = np.concatenate([depth[ahead], depth[back]])
    both = np.unique(period * (n + 1) + start)
    return both % (n + 1), both // (n + 1)


def _rotated(codes: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Squares moved left while their period holds, not beyond ``begin`` of their document."""
    start = start.copy()
    moving = np.arange(len(start))
    for _ in range(STEPS):
        moving = moving[start[moving] > begin[moving]]
        left = start[moving] - 1
        moving = moving[codes[left] == codes[left + period[moving]]]
        start[moving] -= 1
    for m in moving:  # long runs: compare in stretches that double
        s, p, stop, width = int(start[m]), int(period[m]), int(begin[m]), 64
        while s > stop:
            low = max(stop, s - width)
            parted = np.flatnonzero(codes[low:s] != codes[low + p:s + p])
            if len(parted):
                s = low + int(parted[-1]) + 1
                break
            s, width = low, width * 2
        start[m] = s
    return start


def find_runs(codes: np.ndarray, doc: np.ndarray, begins: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Runs (start, end, period) of word numbers, ordered by start and period.

    ``doc`` has the document of each word, in order; ``begins`` the first word of each document.
    """
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none
    sa, isa, levels = _ordered(codes, doc)
    start, period = squares(sa, isa, _lcp(sa, levels))
    end = start + 2 * period
    order = np.lexsort((period, end))
    start, period, end = start[order], period[order], end[order]
    found = []
    while len(start):
        new = np.append(True, end[1:] != end[:-1])  # the smallest period of each end
        s = _rotated(codes, begins[doc[start[new]]], start[new], period[new])
        found.append((s, end[new], period[new]))
        left = ~new & (start < s[np.cumsum(new) - 1])  # not inside the run just found
        start, period, end = start[left], period[left], end[left]
    s, e, p = (np.concatenate(part) for part in zip(*found)) if found else (none, none, none)
    long = e - s >= np.maximum(least, 2 * p)
    s, e, p = s[long], e[long], p[long]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop
        at = stop


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(texts: pa.Array, least: int) -> list[pa.Array]:
    """Columns ``n_words, runs, collapsed`` of a batch of texts."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = parts.flatten()
    doc = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    words, doc = flat.filter(pa.array(filled)), doc[filled]
    counts = np.bincount(doc, minlength=len(texts))
    begins = np.cumsum(counts) - counts
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    s, e, p = find_runs(codes, doc, begins, least)
    of = doc[s] if len(s) else np.zeros(0, np.int64)
    runs = pa.StructArray.from_arrays([pa.array(v) for v in (s - begins[of], e - s, p)], fields=list(RUN))
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, s + p, 1)
    np.add.at(change, e, -1)
    keep = np.cumsum(change[:-1]) == 0

    def lists(values: pa.Array, per_doc: np.ndarray, kind=pa.LargeListArray) -> pa.Array:
        return kind.from_arrays(pa.array(np.append(0, np.cumsum(per_doc))), values)

    kept = lists(words.filter(pa.array(keep)), np.bincount(doc[keep], minlength=len(texts)))
    runs = lists(runs, np.bincount(of, minlength=len(texts))).cast(pa.list_(RUN))
    return [pa.array(counts.astype(np.int64)), runs, pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` of every row: its runs (word numbers) and its text with one period left of each.

    Null and empty texts have no words and no runs; repeated rows and null ids come back as they are; other columns
    play no part. A text is worked on whole, in one task, in memory of about 200 bytes a word.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in _slices(batch.column(1), BATCH):
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([part.column(0), *_batch(part.column(1), least)],
                                                 names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        work, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(text: Column, id_: Column) -> Column:
    """A tenth of the texts, by a hash of the id, with a repeated stretch from some word on; texts without id stay."""
    hashed = F.crc32(id_.cast("string"))
    g = F.floor(hashed / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = n_words(text)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    planted = F.concat(F.slice(words, F.lit(1), a.cast("int")), tail)
    return F.when((hashed % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, after a tenth of them got one planted: numbers, the longest, and digests of all."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"),
                                                                 (-r["period"]).alias("fine"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    found = found.select("*", longest.alias("top"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"),
                        F.col("top.length").alias("length"), (-F.col("top.fine")).alias("period"),
                        F.floor(F.col("top.length") * 1000 / -F.col("top.fine")).alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op12_runs": op12_runs}
ORACLES: dict[str, str] = {}
