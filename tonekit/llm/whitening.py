"""Operator 11: whitening of embeddings with a distributed Jacobi-Davidson eigensolver.

The covariance is never formed. The distinct vectors are written once as blocks of rows; every product of the
covariance with a few directions is one Spark pass in which tasks centre their blocks and return sums of the size
(dimensions x directions). On the driver live only such small matrices:

1. Rayleigh-Ritz on the search space gives the best pairs; those whose residual has reached double precision are
   locked, largest eigenvalue first, and everything later is kept orthogonal to them.
2. For all pairs still open, the projected correction equation
   (I - QQ')(V - e I)(I - QQ') t = -r is solved by MINRES, all equations side by side: a step of all is one pass.
3. The corrections widen the search space, which is cut back to its best vectors when it gets too wide.

Defined cases. Rows whose vector is null or holds null or non-finite entries take no part, nor do entries of 2**46 or
more in size (64 times that is no exact double), nor vectors of another length than the commonest among distinct ones
(ties: the longest). Repeated rows and rows of equal vectors all come back, counted once in the covariance; null ids
stay null. Components without variance (below ``d * 1e-14`` of the largest) do not come back, so one distinct vector or
an empty table gives no rows. Equal eigenvalues: any orthonormal basis of their space, the same for all rows.
A deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import staged, table

#: Vectors in a stored block, partial sums that the driver adds up itself.
BLOCK, PARTS = 2048, 64
#: Steps of MINRES per correction, rounds of corrections, and residuals taken as double precision.
INNER, ROUNDS, PRECISE = 6, 60, 64 * np.finfo(float).eps
SCALE, SHIFT = 64, 1_000_000


class Whitening(NamedTuple):
    """A fitted whitening of integer vectors less ``SHIFT``: mean, components (columns) and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def cells(rows: DataFrame, vec_col: str) -> DataFrame:
    """``rows`` with usable vectors, and those as ``_cells``: floor(64 * entry), exact longs."""
    usable = F.forall(vec_col, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(2.0 ** 46), F.lit(False)))
    return rows.where(F.col(vec_col).isNotNull() & usable & (F.size(vec_col) > 0)).withColumn(
        "_cells", F.transform(vec_col, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long")))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """Distinct vectors (``_cells``) as stored blocks ``dims, size, kind, sums, block``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        count = 0
        for batch in batches:
            for piece in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                rows = piece.column(0)
                dims = rows.value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(dims):
                    held.setdefault(int(d), []).append(_matrix(rows.filter(pa.array(dims == d))))
                count += len(rows)
                if count >= BLOCK:
                    yield from map(_packed, held.values())
                    held, count = {}, 0
        yield from map(_packed, held.values())

    return vectors.mapInArrow(pack, "dims int, size long, kind string, sums array<string>, block binary")


def _packed(parts: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(parts)
    top = max(abs(int(rows.min())), abs(int(rows.max())))
    kind = next(k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if top < most)
    exact = rows if top * len(rows) < 1 << 62 else rows.astype(object)
    return pa.RecordBatch.from_pydict({
        "dims": pa.array([rows.shape[1]], pa.int32()), "size": [len(rows)], "kind": [kind],
        "sums": [[str(s) for s in exact.sum(axis=0)]], "block": pa.array([rows.astype(kind).tobytes()], pa.binary())})


def _summed(blocks: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part`` over all blocks: per task first, beyond ``PARTS`` tasks per group of tasks, then here."""
    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("block")):
                rows = np.frombuffer(raw.as_buffer(), kind).reshape(-1, d).astype(float)
                total = part(rows) if total is None else total + part(rows)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("part"):
                more = np.frombuffer(raw.as_buffer())
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.select("kind", "block").mapInArrow(of_blocks, "part binary")
    if blocks.rdd.getNumPartitions() > PARTS:
        parts = parts.repartition(PARTS).mapInArrow(of_parts, "part binary")
    return np.sum([np.frombuffer(r["part"]) for r in parts.collect()], axis=0)


def _away(x: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """``x`` without its parts in orthonormal ``spaces``, twice for rounding."""
    for _ in range(2):
        for q in spaces:
            x = x - q @ (q.T @ x)
    return x


def _basis(x: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what ``x`` adds to ``spaces``."""
    x = _away(x, *spaces)
    size = np.linalg.norm(x, axis=0)
    x = x[:, size > 0] / size[size > 0]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return np.linalg.qr(_away(u[:, s > 1e-10 * max(1.0, s.max(initial=0.0))], *spaces))[0]


def corrections(product: Callable, locked: np.ndarray, ritz: np.ndarray, values: np.ndarray,
                residuals: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on the projected correction equation of every column, side by side: one product per step."""
    def project(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - locked @ (locked.T @ x)
            x = x - ritz * np.sum(ritz * x, axis=0)
        return x

    v_old = w_old = w = x = np.zeros_like(residuals)
    v = project(-residuals)
    gamma = np.linalg.norm(v, axis=0)
    eta, s_old, s, c_old, c = gamma.copy(), 0.0, 0.0, 1.0, 1.0
    alive = gamma > 0
    for _ in range(steps):
        v = np.where(alive, v / np.where(gamma > 0, gamma, 1.0), 0.0)
        image = project(product(v) - values * v)
        delta = np.sum(image * v, axis=0)
        v_new = image - delta * v - gamma * v_old
        gamma_new = np.linalg.norm(v_new, axis=0)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, gamma_new)
        alive = alive & (a1 > 0)
        a1 = np.where(a1 > 0, a1, 1.0)
        a2, a3 = s * delta + c_old * c * gamma, s_old * gamma
        c_old, c, s_old, s = c, a0 / a1, s, gamma_new / a1
        w_old, w = w, (v - a3 * w_old - a2 * w) / a1
        x = np.where(alive, x + c * eta * w, x)
        eta = -s * eta
        v_old, v, gamma = v, v_new, gamma_new
        alive = alive & (gamma_new > PRECISE * np.abs(values).max(initial=0.0))
        if not alive.any():
            break
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and unit eigenvectors of a symmetric operator, by block Jacobi-Davidson."""
    k = min(k, d)
    widest = min(d, 6 * k)
    search = np.linalg.qr(np.random.default_rng(11).standard_normal((d, min(d, 2 * k))))[0]
    image = product(search)
    locked, locked_values, best, stalled = np.zeros((d, 0)), np.zeros(0), np.inf, 0
    for _ in range(ROUNDS):
        small = search.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, search, image = values[order], search @ turn[:, order], image @ turn[:, order]
        open_ = k - locked.shape[1]
        top = np.abs(np.concatenate([values, locked_values])).max()
        residuals = image[:, :open_] - search[:, :open_] * values[:open_]
        sizes = np.linalg.norm(residuals, axis=0)
        worst = sizes.max() / top if top > 0 else 0.0
        stalled, best = (0, worst) if worst < best / 2 else (stalled + 1, best)
        whole = search.shape[1] + locked.shape[1] == d
        fine = sizes <= (1e3 * PRECISE if whole or stalled >= 4 else PRECISE) * top
        done = open_ if fine.all() else int(np.argmin(fine))
        if done:
            locked_values = np.concatenate([locked_values, values[:done]])
            locked = np.concatenate([locked, _away(search[:, :done], locked)], axis=1)
            locked /= np.linalg.norm(locked, axis=0)
            search, image, values = search[:, done:], image[:, done:], values[done:]
            best, stalled = np.inf, 0
        if done == open_:
            break
        if search.shape[1] + open_ - done + locked.shape[1] > min(d, widest + k):
            keep = min(search.shape[1], max(2 * k, 1))
            search, image = search[:, :keep], image[:, :keep]
        t = corrections(product, locked, search[:, :open_ - done], values[:open_ - done],
                        residuals[:, done:], INNER)
        more = _basis(np.concatenate([t, residuals[:, done:]], axis=1)[:, :max(1, t.shape[1])], locked, search)
        if not more.shape[1]:  # nothing new: any direction outside
            more = _basis(np.random.default_rng(search.shape[1]).standard_normal((d, k)), locked, search)
        search, image = np.concatenate([search, more], axis=1), np.concatenate([image, product(more)], axis=1)
    else:
        raise ArithmeticError(f"residuals stay at {best:g} of the largest eigenvalue after {ROUNDS} rounds")
    small = locked.T @ product(locked)  # a last Rayleigh-Ritz among the locked
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], locked @ turn[:, ::-1]


def fit(blocks: DataFrame, components: int) -> tuple[int, Whitening] | None:
    """Whitening of the blocks' commonest length and that length; None where nothing varies."""
    lengths = blocks.groupBy("dims").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), F.desc("dims")).head(1)
    if not lengths:
        return None
    d, n = lengths[0]["dims"], lengths[0]["n"]
    blocks = blocks.where(F.col("dims") == d)
    sums = (blocks.select(F.posexplode("sums").alias("dim", "s")).groupBy("dim")
                  .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect())
    sums = [int(r["s"]) for r in sums]
    mean = np.array([s / n for s in sums])

    def product(x: np.ndarray) -> np.ndarray:
        def part(rows: np.ndarray) -> np.ndarray:
            rows = rows - mean
            return rows.T @ (rows @ x)
        return _summed(blocks, d, part).reshape(d, -1) / n

    trace = float(_summed(blocks, d, lambda rows: np.array([np.square(rows - mean).sum()]))[0]) / n
    if not trace > 0:
        return None
    values, vectors = leading(product, d, components)
    kept = values > d * 1e-14 * values[0]
    values, vectors = values[kept], vectors[:, kept]
    matrix = vectors / np.sqrt(values)
    middle = _summed(blocks, d, lambda rows: ((rows - mean) @ matrix).sum(axis=0)) / n

    def spread(rows: np.ndarray) -> np.ndarray:
        white = (rows - mean) @ matrix - middle
        return white.T @ white
    white = _summed(blocks, d, spread).reshape(len(values), -1) / n
    return d, Whitening(n, sums, vectors, values, trace, float(np.abs(white - np.eye(len(values))).max()))


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * entry - sum)^2 per row; None where no long holds it."""
    most = max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0)))) * n + max(map(abs, sums))
    if most * most * len(sums) < 1 << 62:
        return np.square(rows * n - np.array(sums, np.int64)).sum(axis=1).tolist()
    rough = np.square(rows.astype(float) * n - np.array(sums, float)).sum(axis=1)
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) if r < 1e19 else 1 << 63 for row, r in zip(rows, rough))
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, d: int, w: Whitening, id_col: str) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of rows with ``_cells`` of length ``d``."""
    mean, matrix, k = w.mean, w.matrix, len(w.values)
    explained = w.values / w.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                cells_ = _matrix(piece.column(1))
                white = (cells_ - mean) @ matrix
                off = pa.array(deviations(cells_, w.n, w.sums), pa.int64())
                each = pa.array(np.repeat(np.arange(len(cells_)), k))
                size = len(each)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(cells_))),
                     pa.array(np.full(size, w.n)), off.take(each), pa.array(white.reshape(-1)),
                     pa.array(np.tile(explained, len(cells_))), pa.array(np.full(size, w.identity_error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.where(F.size("_cells") == d).select(id_col, "_cells").mapInArrow(
        project, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """Whitened leading components of every row of ``rows`` with a usable vector."""
    usable = cells(rows.select(F.col(id_col), F.col(vec_col)), vec_col)
    found = fit(staged(blocks_of(usable.select("_cells").distinct()), "blocks"), components)
    d, w = found or (0, Whitening(1, [0], np.zeros((1, 0)), np.zeros(0), 1.0, 0.0))
    return whiten(usable, d, w, id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of all embeddings; ``n * x - S`` does not change by the shift of all entries."""
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
