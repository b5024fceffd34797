"""Operator 5: best-fit packing of tokenized documents into sequences.

Documents longer than a sequence are cut; every piece then is an item whose size is its number of
ids, so all that matters for the packing is how many pieces there are of each length: a table of at
most ``size`` rows, whatever the corpus. The driver packs that table, many equal bins at a time:

* full pieces are sequences of their own;
* Martello and Toth's dominance reduction goes through the lengths from the largest: where one
  set of at most three items that holds the largest provably dominates every other set with it,
  those bins are fixed for good;
* best fit (longest first) places all items that are left, each into the bin with the least room
  that holds it (bins of the reduction with room included), else into a new one.

Each kind of bin says how often it occurs and which lengths it holds. Pieces get a rank among those
of their length (counted by hash buckets, so that no length is sorted in one task), and a rank
selects a bin and a place in it. Nothing but the table of lengths reaches the driver.

Defined results: a null or empty text is one piece of the end id; equal rows are separate pieces;
an empty table gives no rows; other columns are ignored. Reruns give the same sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonekit.llm.common import staged, table
from tonekit.llm.encoder import encoder

SEQUENCE, END_ID = 1024, 2
#: Pieces of one length that one task may rank.
RANKED = 100_000
TEXTS = 256

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): texts as ids, cut where over ``size``.

    The first piece of a cut document takes what is over; the others are full.
    """
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = _PIECE + (", ids binary" if with_ids else "")
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[t]) for n, t in (c.split(" ") for c in schema.split(", "))])

    def run(batches):
        enc = encoder(path, False)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part, out = batch.slice(i, TEXTS), []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * a: 4 * b]
                        out.append((doc, k, a, b - a, zlib.crc32(own), own)[: len(arrow)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


class _Counts:
    """How many items there are of each length; finds the largest and smallest that are left."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: int(c) for w, c in counts.items() if c}
        self.lengths = sorted(self.n)

    def take(self, items: tuple[int, ...], times: int) -> None:
        for w in items:
            self.n[w] -= times
            if not self.n[w]:
                del self.n[w]
                self.lengths.pop(bisect_left(self.lengths, w))

    def add(self, w: int) -> None:
        if w not in self.n:
            insort(self.lengths, w)
        self.n[w] = self.n.get(w, 0) + 1

    def largest(self, most: int) -> int:
        """The largest length that is at most ``most`` (0: none)."""
        k = bisect_left(self.lengths, most + 1)
        return self.lengths[k - 1] if k else 0

    def smallest(self, two: bool) -> int:
        """The smallest length, or the sum of the two smallest items (0: there are none)."""
        if not self.lengths:
            return 0
        a = self.lengths[0]
        if not two:
            return a
        return 2 * a if self.n[a] > 1 else a + self.lengths[1] if len(self.lengths) > 1 else 0

    def smallest_above_least(self) -> float:
        """The sum of the two smallest items that are longer than the smallest length."""
        above = [w for w in self.lengths[1:3] for _ in range(min(2, self.n[w]))]
        return sum(above[:2]) if len(above) > 1 else float("inf")

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """Two items with the largest sum that fits."""
        best, i, j = None, 0, len(self.lengths) - 1
        while i <= j:
            a, b = self.lengths[i], self.lengths[j]
            if a + b > room:
                j -= 1
            else:
                if (a != b or self.n[a] > 1) and (best is None or a + b > sum(best)):
                    best = (b, a)
                i += 1
        return best


def _dominant(left: _Counts, w: int, size: int) -> tuple[int, ...] | None:
    """The set of items besides ``w`` (already taken out) whose bin dominates all others with ``w``.

    * nothing fits: the item alone;
    * no two items fit, or one fills the bin: the largest that fits - any other set with ``w``
      holds at most one item, which is no larger;
    * no three fit, and the best pair sums to no more than the largest that fits: that one, as
      its place elsewhere can take any pair;
    * no three fit, and every pair that fits has an item of the smallest length: that length with
      the largest that fits, if both fit, as each of them covers one item of any other set.
    """
    room = size - w
    one = left.largest(room)
    if not one:
        return ()
    pair_least = left.smallest(two=True)
    if one == room or not pair_least or pair_least > room:
        return (one,)
    least = left.smallest(two=False)
    if pair_least + least > room:  # at most two items fit beside w
        pair = left.best_pair(room)
        if pair is None or one >= sum(pair):
            return (one,)
        if pair == (one, least) and left.smallest_above_least() > room:
            return pair
    return None


def pack_lengths(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Bins for ``counts`` items of each length: pairs of a number of bins and the lengths in each."""
    counts = dict(counts)
    bins = [(counts.pop(size), (size,))] if counts.get(size) else []
    left = _Counts(counts)
    for w in left.lengths[::-1]:
        while w in left.n:
            left.take((w,), 1)
            others = _dominant(left, w, size)
            if others is None:  # nothing proven: items of this length stay
                left.add(w)
                break
            # equal bins as long as the same items are surely the answer
            times = max(1, min([left.n.get(w, 0) - 1] + [left.n[x] // (others.count(x) + (x == w)) - 1 for x in others]))
            left.take(others, times)
            if times > 1:
                left.take((w,), times - 1)
            bins.append((times, (w, *others)))
    return _best_fit(bins, left.n, size)


def _best_fit(bins: list[tuple[int, tuple[int, ...]]], items: dict[int, int], size: int):
    """Longest first, each into the bin with the least room that holds it."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []
    done = []

    def put(times: int, lengths: tuple[int, ...]) -> None:
        free = size - sum(lengths)
        if not free:
            done.append((times, lengths))
        elif free in room:
            room[free].append((times, lengths))
        else:
            room[free] = [(times, lengths)]
            insort(rooms, free)

    for b in bins:
        put(*b)
    for w in sorted(items, reverse=True):
        n = items[w]
        while n:
            k = bisect_left(rooms, w)
            if k == len(rooms):
                per = min(n, size // w)
                times = n // per
                put(times, (w,) * per)
                n -= times * per
                continue
            free = rooms[k]
            times, lengths = room[free].pop()
            if not room[free]:
                del room[free]
                rooms.pop(k)
            per = min(n, free // w)
            used = min(times, n // per)
            put(used, lengths + (w,) * per)
            if times > used:
                put(times - used, lengths)
            n -= used * per
    return done + [b for group in room.values() for b in group]


def _slots(bins: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """For each length, in which bin and where the pieces of a span of ranks go."""
    rows, seen, first = [], {}, 0
    for times, lengths in bins:
        at = 0
        for w in lengths:
            rows.append((w, seen.get(w, 0), first, at))
            seen[w] = seen.get(w, 0) + times
            at += w
        first += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def ranked(items: DataFrame) -> DataFrame:
    """``rank``: number of a piece, from 0, among those of its length."""
    most = items.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // RANKED))
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most ``size`` lengths times the buckets: a row for each RANKED pieces and length
    before = counts.select("length", "bucket", (F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return (keyed.withColumn("number", number).join(before, ["length", "bucket"])
                 .withColumn("rank", F.col("before") + F.col("number") - 1).drop("bucket", "before", "number"))


def pack(items: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces."""
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most size rows
    length, rank, first, at = _slots(pack_lengths(counts, size))
    schema = _PIECE + ", sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            w, r = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, (w << 44) + r, side="right") - 1
            cols = [batch.column(c.split(" ")[0]) for c in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(first[k] + r - rank[k]), pa.array(at[k])],
                [c.split(" ")[0] for c in schema.split(", ")])

    key = (length << 44) + rank
    return ranked(items).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack ``docs``: a row per piece with its sequence and place."""
    return pack(staged(pieces(docs, path, size, end_id), "pieces"), size)


def sequences(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``sequence_id, n_tokens, ids, parts``: the packed ids themselves, at most ``size`` a row."""
    items = staged(pieces(docs, path, size, end_id, with_ids=True), "pieces")
    placed = pack(items.drop("ids"), size)
    keys = ["doc_id", "piece", "ids_crc32"]
    # equal pieces have equal ids: one row of each is enough to look the ids up
    ids = items.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("ids").alias("ids"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = placed.join(ids, same).groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select(
        "sequence_id", F.aggregate("p.length", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"),
        F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.transform("p", lambda p: p.dropFields("ids")).alias("parts"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}  # SQL has no tokenizer: tests check the contract on whole tables
