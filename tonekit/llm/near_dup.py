"""Operator 4: near-duplicates with SetSketch registers, verified on full shingle sets.

Sets. A document's set holds its distinct shingles of five words, as 64-bit hashes. Documents with equal
sets (a 128-bit fingerprint of number and hashes) are one class, led by the smallest id; all that
follows works on classes, so a text copied a thousand times costs as much as one.

Sketch. ``M`` registers, of which the first ``BANDS * ROWS`` make band keys; register i holds floor(1 - log_b(least h_i over the set)), where h_i is an
exponentially spaced hash of rate a: a truncated minimum. Merging sets is taking the larger of
registers, and equal registers are as likely as the sets are alike. Bands of ``ROWS``
registers are bucket keys; 32 bands of 4 miss a pair at similarity 0.75 with probability 5e-6.

Candidates without all pairs of a bucket:

1. Every class of a bucket is paired with the bucket's centre: the class that meets the most others
   over all bands, so the middle of a group. Of its up to 32 centres, each class first takes
   the one it meets most often. Verified links make components.
2. Stars again, in all buckets that still hold more than one component: a class meets its bucket's
   centre, and a class chosen by a hash that differs from band to band, where they are in
   different components. Verified links join components.
3. What is left are pairs across components of a bucket. Classes come with their texts to cells of two blocks,
   bounded in classes and in shingles, so a bucket of any size spreads over tasks. A cell compares registers,
   then the full sets of plausible pairs (each in the first band that it shares), with no cap; pairs that links of the
   cell have joined meanwhile need no test. Only those links leave it: a spanning forest, never more than its classes.

Before a pair's sets are read, the registers are compared jointly: numbers of larger, smaller and equal
registers give the likelihood of every similarity. A pair goes on unless 0.75 and all above are
less likely than the best similarity by a factor of e^``DOUBT`` (a pair at 0.75 is refused with probability
4e-6, as seldom as the bands miss it). Then the shingle sets decide.

Defined results: null text or text without words: empty set, linked with nothing; fewer than five
words: the sequence as one shingle; rows with equal ids are one document of the union of their
links, each row is returned; null ids take part as rows of their own class, with a null component
only if no id is reachable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import staged, table

WORDS, PER_CENT = 5, 75
M, BANDS, ROWS = 256, 32, 4
B, A = 1.001, 20.0
DOUBT = 10.0
#: Rows of a few numbers up to which a stored table is broadcast; partners of a class per task; classes and
#: shingles of a bucket that make a block.
FEW_ROWS, MEMBERS, BLOCK, BLOCK_SHINGLES = 500_000, 500, 1024, 1 << 21

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, M, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time; powers of the base and of its inverse for them.
_SPAN = 1 << 18


def _powers(x: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n - 1, x, dtype=np.uint64))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    a, b, s = _MIX
    h = (h ^ (h >> s)) * a
    h = (h ^ (h >> s)) * b
    return h ^ (h >> s)


_TABLES: list[np.ndarray] = []


def _word_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, ASCII capitals lowered.

    A word's hash is a difference of running sums of byte x power, brought back to power 0: no
    loop over words. Texts longer than the tables go in spans that end between words.
    """
    if not _TABLES:
        _TABLES.extend((_powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN),
                        np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)))
        low = np.arange(256)
        low[65:91] += 32
        _TABLES[2] = _TABLES[2][low]
    power, back, value = _TABLES
    space = (text == 32) | ((text >= 9) & (text <= 13))
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _SPAN)
        if end < len(text):
            gaps = np.flatnonzero(space[at:end])
            if not len(gaps):  # one word longer than a span: by itself
                stop = np.flatnonzero(space[end:])
                end = end + int(stop[0]) if len(stop) else len(text)
                whole = text[at:end]
                parts = [_word_hashes(whole[i: i + _SPAN - 1]) for i in range(0, len(whole), _SPAN - 1)]
                h = np.uint64(len(whole))
                for p in np.concatenate(parts):
                    h = _mix(np.array([h * np.uint64(31) + p]))[0]
                out.append(np.array([h], dtype=np.uint64))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        part, gap = text[at:end], space[at:end]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(value[part] * power[: len(part)], out=sums[1:])
        out.append(_mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 bytes."""
    with np.errstate(over="ignore"):
        w = _word_hashes(text)
        n = len(w)
        if not n:
            return w
        k = min(n, WORDS)
        h = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = _mix(h * np.uint64(0x100000001B3) + w[i: n - k + 1 + i])
        return np.unique(h)


def sketch(s: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes."""
    if not len(s):
        return np.zeros(M, dtype=np.uint16)
    least = np.empty(M, dtype=np.uint64)
    with np.errstate(over="ignore"):
        step = max(1, (1 << 16) // len(s))
        for i in range(0, M, step):
            least[i: i + step] = (_MUL[i: i + step, None] * s[None, :] + _ADD[i: i + step, None]).min(axis=1)
    u = (least.astype(np.float64) + 1) / 2.0 ** 64
    h = -np.log1p(-np.minimum(u, 1 - 2.0 ** -53)) / A
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, 65535).astype(np.uint16)


def _fingerprint(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return (len(s).to_bytes(8, "little") + int(s.sum(dtype=np.uint64)).to_bytes(8, "little")
                + int(np.bitwise_xor.reduce(_mix(s * _MUL[0]))).to_bytes(8, "little"))


_SETS = "doc_id long, text_hash long, n_shingles long, print binary, registers binary"


def _of_batch(column: pa.Array) -> list[np.ndarray]:
    texts = column.cast(pa.large_binary()).fill_null(b"")
    return [shingles(np.frombuffer(t.as_buffer(), dtype=np.uint8)) for t in texts]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))


def sketches(source: DataFrame) -> DataFrame:
    """Set sizes, fingerprints and registers; the sets are not kept but made again from the texts that
    are compared, as a text is smaller than its hashes."""
    names = [c.split(" ")[0] for c in _SETS.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = _of_batch(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in found], pa.int64()),
                     pa.array([_fingerprint(s) if len(s) else b"" for s in found], pa.binary()),
                     pa.array([sketch(s).tobytes() if len(s) else b"" for s in found], pa.binary())], names)

    return source.mapInArrow(run, _SETS)


def _bands(classes: DataFrame) -> DataFrame:
    """``class, band, key``: ROWS registers of 16 bits are the key itself."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(n, M)
            keys = np.ascontiguousarray(registers[:, : BANDS * ROWS]).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                 pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys)], ["class", "band", "key"])

    return classes.select("class", "registers").mapInArrow(run, "class long, band int, key long")


def may_be_alike(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Which rows of registers leave a similarity of 0.75 or more possible, by joint likelihood."""
    more, less = (one > two).sum(axis=1), (one < two).sum(axis=1)
    equal = M - more - less
    share = (n_one / (n_one + n_two))[:, None]
    level = PER_CENT / 100
    grid = np.concatenate((np.linspace(0, level, 61), np.linspace(level, 1, 26)[1:]))[None, :]
    # of a similarity J with sizes u + v = 1: an equal part of J, and what only one set has
    only_one, only_two = (np.maximum(x - (1 - x) * grid, 1e-9) for x in (share, 1 - share))
    p_more, p_less = (-np.log1p(-x * (B - 1) / B) / np.log(B) for x in (only_one, only_two))
    p_equal = np.maximum(1 - p_more - p_less, 1e-9)
    likely = more[:, None] * np.log(p_more) + less[:, None] * np.log(p_less) + equal[:, None] * np.log(p_equal)
    possible = grid <= np.minimum(share, 1 - share) / np.maximum(share, 1 - share) + 1e-9
    likely = np.where(possible, likely, -np.inf)
    return likely[:, 60:].max(axis=1) >= likely.max(axis=1) - DOUBT


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes whose sizes and registers allow a link."""
    a, b = (classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
            for x in "ab")
    rows = pairs.join(a, "a").join(b, "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PER_CENT)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, M) for c in ("r_a", "r_b"))
                n_one, n_two = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
                keep = pa.array(may_be_alike(one, two, n_one, n_two))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return rows.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, broadcast if it is short; else joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def _pairs_of_cell(band: int, one: tuple, two: tuple | None):
    """``a, b``: plausible pairs across components between two blocks of a bucket (or within one).

    A block is ``classes, components, sizes, registers``. A pair counts in its first shared band only.
    """
    again = two is None
    two = one if again else two
    limit = PER_CENT / 100
    for at in range(0, len(one[0]), 16):
        ids, comps, sizes, registers = (x[at: at + 16] for x in one)
        wanted = comps[:, None] != two[1][None, :]
        if again:
            wanted &= ids[:, None] < two[0][None, :]
        small, large = (f(sizes[:, None], two[2][None, :]) for f in (np.minimum, np.maximum))
        wanted &= small >= limit * large
        used = np.flatnonzero(wanted.any(axis=0))
        if not len(used):
            continue
        head = registers[:, None, : BANDS * ROWS] == two[3][None, used, : BANDS * ROWS]
        first = head.reshape(len(ids), len(used), BANDS, ROWS).all(axis=3).argmax(axis=2)
        i, j = np.nonzero(wanted[:, used] & (first == band))
        j = used[j]
        if len(i):
            keep = may_be_alike(registers[i], two[3][j], sizes[i], two[2][j])
            a, b = ids[i[keep]], two[0][j[keep]]
            yield np.minimum(a, b), np.maximum(a, b)


def _alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets are linked: 100 x common >= 75 x all."""
    at = np.minimum(np.searchsorted(one, two), len(one) - 1)
    common = int((one[at] == two).sum())
    return 100 * common >= PER_CENT * (len(one) + len(two) - common)


def _forest_of_cell(band: int, one: tuple, two: tuple | None, texts: dict[int, bytes], comps: dict[int, int]):
    """``a, b``: verified links between the cell's classes that join components, none within one."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    sets: dict[int, np.ndarray] = {}

    def set_of(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingles(np.frombuffer(texts[x], dtype=np.uint8))
        return sets[x]

    for a, b in _pairs_of_cell(band, one, two):
        for x, y in zip(a.tolist(), b.tolist()):
            u, v = root(comps[x]), root(comps[y])
            if u != v and _alike(set_of(x), set_of(y)):
                above[max(u, v)] = min(u, v)
                yield x, y


_CELL = "band int, key long, low int, high int, block int, class long, comp long, n double"


def _by_cell(work):
    """Runs ``work(parts)`` on the rows of each cell; a part is the cell's numbers and a slice of a batch."""
    def run(batches):
        parts = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                key = tuple(keys[x].tolist())
                if parts and parts[0][0] != key:
                    yield work(parts)
                    parts = []
                parts.append((key, batch.slice(x, y - x)))
        if parts:
            yield work(parts)
    return run


def _sides(parts):
    """The two blocks of a cell (the second None if it is the first): classes, components, sizes, registers."""
    band, _, low, high = parts[0][0]
    block, ids, comps, n = (np.concatenate([p.column(k).to_numpy() for _, p in parts]) for k in range(4, 8))
    registers = np.frombuffer(b"".join(r for _, p in parts for r in p.column(8).to_pylist()), dtype="<u2").reshape(-1, M)
    one, two = ((ids[own], comps[own], n[own], registers[own]) for own in (block == low, block == high))
    return band, one, None if low == high else two


def _in_question(parts):
    """The rows of a cell whose class is part of a plausible pair of it."""
    found = list(_pairs_of_cell(*_sides(parts)))
    used = np.unique(np.concatenate([x for pair in found for x in pair])) if found else np.zeros(0, np.int64)
    rows = pa.Table.from_batches([p for _, p in parts]).drop_columns(["registers"])
    return rows.filter(pa.array(np.isin(rows.column("class").to_numpy(), used))).combine_chunks().to_batches(None)[0] if len(used) else (
        parts[0][1].slice(0, 0).drop_columns(["registers"]))


def _joined(parts):
    """The links of a cell, from the texts of its classes."""
    band, one, two = _sides(parts)
    numbers = [[p.column(k).to_pylist() for _, p in parts] for k in (5, 6)]
    texts = (t for _, p in parts for t in p.column(9).cast(pa.large_binary()).to_pylist())
    ids, comps = (sum(x, []) for x in numbers)
    links = list(_forest_of_cell(band, one, two, dict(zip(ids, texts)), dict(zip(ids, comps))))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _across(open_: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links ``a, b`` that join components of classes which share a bucket: a forest for each cell.

    The classes of a bucket are dealt into blocks of about ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles; each
    pair of blocks is a cell, which one task compares, so no task holds more than two blocks. Cells are gone through
    with registers alone first; only classes that have a plausible partner in a cell come to it again with their texts.
    """
    blocks = open_.join(classes.select("class", "n_shingles"), "class").groupBy("band", "key").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    rows = (open_.select("band", "key", "class", "comp").join(staged(blocks, "blocks"), ["band", "key"])
                 .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cell = ["band", "key", "low", "high"]
    rows = rows.select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                       "block", "class", "comp")
    own = classes.select("class", F.col("n_shingles").cast("double").alias("n"), "registers")
    rows = rows.join(own, "class").select(*cell, "block", "class", "comp", "n", "registers")
    dealt = rows.repartition(*cell).sortWithinPartitions(*cell, "block")
    wanted = staged(dealt.mapInArrow(_by_cell(_in_question), _CELL), "in_question")
    rows = wanted.join(own.drop("n"), "class").join(texts, "class").select(*cell, "block", "class", "comp", "n", "registers", "text")
    dealt = rows.repartition(*cell).sortWithinPartitions(*cell, "block")
    return dealt.mapInArrow(_by_cell(_joined), "a long, b long")


def _linked(tried: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are alike: 100 x common >= 75 x all.

    Texts meet at ``a``: its text is sent once for each ``MEMBERS`` of its partners (so a class with
    many partners spreads over tasks), theirs once each.
    """
    salts = tried.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("salts"))
    split = tried.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    own = salts.select(F.col("a").alias("class"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                       F.lit(None).cast("long").alias("b"))
    sides = staged(own.union(split.select(F.col("b").alias("class"), "a", "salt", "b")), f"sides{name}")
    rows = texts.join(_small(sides), "class").select("a", "salt", "b", "text")
    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        key, first = None, None
        for batch in batches:
            a, b = [], []
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                for x, salt, y, own in zip(*(part.column(k).to_pylist() for k in range(3)), _of_batch(part.column(3))):
                    if y is None:
                        key, first = (x, salt), own
                        continue
                    assert key == (x, salt), "a pair's first text is missing"
                    if _alike(first, own):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return staged(ordered.mapInArrow(run, "a long, b long"), f"links{name}")


def components(links: DataFrame) -> DataFrame:
    """``class, comp``: the smallest class reachable over links ``a, b``, for classes with links.

    Alternating stars: all larger neighbours of a node are tied to the smallest one around it, then
    all smaller ones, until nothing changes; some log2 of the longest chain rounds.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    k = 0
    while True:
        nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(
            edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
        if nodes.where("below > 1 OR (above > 0 AND below > 0)").isEmpty():
            break  # nothing but stars
        k += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        # now each node's neighbours below it: tie them and the node to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", "a", "b")
        new = (small.select(F.col("m").alias("a"), F.col("b")).union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
                    .distinct())
        edges = staged(new, f"edges{k}")
    roots = edges.select(F.col("a").alias("class")).distinct().select("class", F.col("class").alias("comp"))
    return edges.select(F.col("b").alias("class"), F.col("a").alias("comp")).union(roots).distinct()


def _with_comp(rows: DataFrame, comps: DataFrame, col: str, out: str) -> DataFrame:
    c = comps.select(F.col("class").alias(col), F.col("comp").alias(out))
    return rows.join(c, col, "left").withColumn(out, F.coalesce(out, col))


def class_links(classes: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of classes (``class, comp``) and the verified links ``a, b`` that made them."""
    bands = _bands(classes)
    met = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(bands.join(met, ["band", "key"]), "shared")
    # a class that meets many others stands in the middle of its group: it is the centre for the rest
    middle = staged(shared.groupBy("class").agg(F.sum("n").alias("meets")), "meets")
    ranked = shared.join(middle, "class")
    centre = ranked.groupBy("band", "key").agg(
        F.max(F.struct("meets", F.xxhash64("class").alias("h"), "class"))["class"].alias("centre"),
        F.min(F.struct(F.xxhash64("class", "band").alias("h"), "class"))["class"].alias("other"))
    buckets = staged(shared.drop("n").join(centre, ["band", "key"]), "buckets")
    wanted = buckets.select("class").distinct().join(classes, "class").select("class", F.col("least").alias("id"), "text_hash")
    wanted = staged(wanted, "wanted")
    same = source["doc_id"].eqNullSafe(F.col("id")) & (source["text_hash"] == F.col("w_hash"))
    texts = source.join(_small(wanted.withColumnRenamed("text_hash", "w_hash")), same).select("class", "text")
    texts = staged(texts, "texts")
    again = texts.groupBy("class").count().where("count > 1")
    if not again.isEmpty():  # rows that are equal in id and text
        texts = staged(texts.dropDuplicates(["class"]), "texts_once")

    stars = buckets.where("class <> centre").groupBy("class", "centre").agg(F.count(F.lit(1)).alias("n"))
    first = stars.groupBy("class").agg(F.max_by("centre", F.struct("n", F.xxhash64("centre"))).alias("centre"))
    # a: the centre, whose text is shared by its pairs; pairs are known by their smaller class first
    pairs = staged(first.select(F.col("centre").alias("a"), F.col("class").alias("b")), "pairs1")
    links = _linked(staged(_plausible(pairs, classes), "plausible1"), texts, "1")
    comps = staged(components(links), "components1")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tested = pairs.select(*ordered).distinct()

    # Stars with the other centres, then what a bucket still holds of pairs across components.
    for step in (2, 3):
        known = _with_comp(buckets, comps, "class", "comp")
        mixed = known.groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        mixed = staged(mixed.select("band", "key"), f"mixed{step}")
        open_ = staged(known.join(_small(mixed), ["band", "key"], "left_semi"), f"open{step}")
        if step == 2:
            # the middle of a bucket again, for those that took another's, and a class by chance
            spokes = open_.select("class", "comp", F.explode(F.array_distinct(F.array("centre", "other"))).alias("centre"))
            rows = _with_comp(spokes.where("class <> centre").distinct(), comps, "centre", "centre_comp").where("comp <> centre_comp")
            new = rows.select(F.col("centre").alias("a"), F.col("class").alias("b")).select(*ordered).distinct()
            new = staged(new.join(tested, ["a", "b"], "left_anti"), "pairs2")
            found = _linked(staged(_plausible(new, classes), "plausible2"), texts, "2")
        else:
            found = staged(_across(open_, classes, texts), "links3")
        if not found.isEmpty():
            links = links.union(found)
            comps = staged(components(links), f"components{step}")
    return comps, links


def _named(sets: DataFrame) -> DataFrame:
    """``sets`` with a name of its own for each fingerprint: where two have the same 64-bit name, both get another."""
    turn = 0
    while True:
        clash = (sets.where("class IS NOT NULL").groupBy("class").agg(F.min("print").alias("low"), F.max("print").alias("high"))
                     .where("low <> high").select("class", F.lit(True).alias("again")))
        if clash.isEmpty():
            return sets.drop("print")
        turn += 1
        other = F.xxhash64("print", F.lit(turn))
        sets = staged(sets.join(clash, "class", "left").withColumn("class", F.when(F.col("again"), other).otherwise(F.col("class")))
                          .select(*sets.columns), f"sets{turn}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    source = _source(docs, id_col, text_col)
    sets = _named(staged(sketches(source).withColumn("class", F.when(F.col("n_shingles") > 0, F.xxhash64("print"))), "sets"))
    member = sets.select("doc_id", "n_shingles", "class")
    full = sets.where("class IS NOT NULL")
    # one class per set; its first row by id (nulls last) lends it the text
    head = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    classes = full.groupBy("class").agg(F.min(head).alias("head"), F.max("n_shingles").alias("n_shingles"),
                                        F.max("registers").alias("registers"))
    classes = staged(classes.select("class", F.col("head.doc_id").alias("least"), F.col("head.text_hash").alias("text_hash"),
                                    "n_shingles", "registers"), "classes")
    comps, links = class_links(classes, source)
    again = (member.where("doc_id IS NOT NULL AND class IS NOT NULL").groupBy("doc_id")
                   .agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b"))
    if not again.isEmpty():  # ids that occur with several texts
        several = member.join(again.select("doc_id", "a"), "doc_id").where("class <> a").select("a", F.col("class").alias("b"))
        comps = staged(components(links.union(several)), "components")
    # components are numbered by class hashes; their smallest id is what is returned
    comp_of = _with_comp(classes.select("class", "least"), comps, "class", "comp")
    least = comp_of.groupBy("comp").agg(F.min("least").alias("component"))
    found = staged(comp_of.join(least, "comp").select("class", "component"), "found")
    rows = member.join(found, "class", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by all pairs of documents that share a shingle: for small tables.
_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, w[i:i + {WORDS - 1}] AS s FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
t AS (SELECT r, doc_id, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (r)),
k AS (SELECT r, dense_rank() OVER (ORDER BY s) AS s FROM s),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM k a JOIN k b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN t x ON x.r = a JOIN t y ON y.r = b WHERE 100 * c >= {PER_CENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
q(id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT q.id, e.b FROM q JOIN e ON q.reached = e.a),
g AS (SELECT id, min(reached) AS component_id FROM q GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM t JOIN g ON g.id = t.doc_id"""

QUERIES = {"op4_near_dup": op4_near_dup}
ORACLES: dict[str, str] = {"op4_near_dup": _SQL}
