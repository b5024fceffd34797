"""Operator 7: exact top-k by inner product, with vector-approximation files.

Vectors become integers, ``floor(scale * x)``. Equal vectors are one class, with its k + 1 smallest
different ids and up to k rows of each: whichever id asks, the k smallest rows of other ids are among them, so a
vector that a third of all rows share costs as much as any other. Each class gets its approximation: a cell of ``BITS`` bits per dimension (equal widths
between the least and the largest component) and the length of what the cells' middles miss.

1. Scan: chunks of approximations meet blocks of queries (an equi-join on the block; a chunk goes once
   to each block). The middles' product plus and minus the smaller of two errors - half a cell times
   the query's components, or the query's length times the missed length - bounds the score. A chunk
   keeps for each query what can still be among the ``need`` best, given the best lower bounds in the chunk. As classes
   may hold nothing but the query's id, ``need`` is k and the most different vectors that a query id has.
2. The ``need``-th best lower bound over all chunks leaves few candidates a query. They are read in the order
   of their upper bounds: first ``FIRST`` of them (or ``need``) exactly, which gives a ``need``-th exact score, then
   all others whose upper bound reaches it. Then the result is certain.

Queries are all rows whose id is divisible by ``every``; candidates are all rows but the query's own.
Every step is a join or a window on keys that spread: nothing is collected.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors
of different lengths are not compared (empty ones score 0 with each other); equal scores go by the
smaller id; rows with equal ids are separate candidates of other queries and none of their own id's;
a query id that occurs twice is asked once per different vector; fewer candidates than k give
fewer rows; an empty table gives none. Vectors whose squared length in integers reaches 2**62 take no part: below that
every inner product is a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonekit.llm.common import staged, table

K, EVERY, SCALE = 5, 50, 256
BITS, CHUNK, BLOCK = 6, 4096, 1024
#: Candidates of a query that are read exactly before the others are tested again.
FIRST = 16


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components as integers; vectors that take no part are left out."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    length = F.aggregate(x, F.lit(0.0), lambda s, c: s + (F.abs(c) * scale + 1) * (F.abs(c) * scale + 1))
    return (vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(~F.coalesce(odd, F.lit(False)))
            .where(length < 2.0 ** 62)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column whose lists all have ``dim`` components."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row (the least, if there are fewer)."""
    k = min(k, values.shape[1])
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def _scan(low: int, width: int, need: int):
    """Bounds of a chunk's scores with a block's queries; rows are chunk and block side by side."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.array(row["classes"], dtype=np.int64)
                cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(len(ids), dim).astype(np.float64)
                middle = low + cells * width + (width - 1) / 2
                missed = np.array(row["missed"])
                names = np.array(row["query_classes"], dtype=np.int64)
                q = np.frombuffer(row["queries"], dtype="<i8").reshape(len(names), dim).astype(np.float64)
                middles = q @ middle.T
                error = np.minimum((np.abs(q).sum(axis=1) * (width - 1) / 2)[:, None],
                                   np.sqrt((q * q).sum(axis=1))[:, None] * missed[None, :])
                error = error + 1e-6 * (1 + np.abs(middles))  # of floating point
                lower, upper = middles - error, middles + error
                at, to = np.nonzero(upper >= _kth(lower, need)[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at]), pa.array(ids[to]), pa.array(lower[at, to]), pa.array(upper[at, to])],
                    ["query_class", "class", "lower", "upper"])

    return run


def _packed(rows: DataFrame, no: str, size: int, width: int | None, low: int) -> DataFrame:
    """Rows of one ``no`` (at most about ``size``) as matrices: cells if a width is given, else whole vectors."""
    schema = ("dim int, classes array<long>, cells binary, missed array<double>" if width
              else "dim int, block long, query_classes array<long>, queries binary")

    def run(key, data):
        dim, number = key[0].as_py(), key[1].as_py()
        ids = data.column("class")
        v = _matrix(data.column("v").combine_chunks(), dim)
        if not width:
            row = [[dim], [number], [ids.to_pylist()], [v.astype("<i8").tobytes()]]
            return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), (
                "query_classes", pa.list_(pa.int64())), ("queries", pa.binary())]))
        cells = (v - low) // width
        missed = np.sqrt(((v - (low + cells * width + (width - 1) / 2)) ** 2).sum(axis=1))
        row = [[dim], [ids.to_pylist()], [cells.astype(np.uint8).tobytes()], [missed.tolist()]]
        return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("classes", pa.list_(pa.int64())), (
            "cells", pa.binary()), ("missed", pa.list_(pa.float64()))]))

    return rows.select("dim", F.col(no), "class", "v").groupBy("dim", no).applyInArrow(run, schema)


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add ``score`` to pairs of classes, from the whole vectors."""
    q = vectors.select(F.col("class").alias("query_class"), F.col("v").alias("_q"))
    c = vectors.select("class", F.col("v").alias("_c"))
    score = F.aggregate(F.zip_with("_q", "_c", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    return pairs.join(q, "query_class").join(c, "class").withColumn("score", score).drop("_q", "_c")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every query."""
    rows = staged(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    # the k + 1 smallest ids of equal vectors: Spark limits each task's rows of a key before it sends them
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    kept = ids.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    members = staged(kept.withColumn("class", F.first("vec_id").over(Window.partitionBy("v").orderBy("vec_id"))), "members")
    heads = members.where("nth = 1").select("class", "v", F.size("v").alias("dim"))
    # an id may stand for several vectors: classes get numbers of their own
    heads = staged(heads.withColumn("class", F.xxhash64("class", "v")), "classes")
    members = members.select("vec_id", "copies", F.xxhash64("class", "v").alias("class"))
    ask = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    ask = staged(ask.join(heads, "v").select("query_id", "class"), "queries")
    # a query's id may be all that its classes hold
    need = k + (ask.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1)
    asked = heads.join(ask.select("class").distinct(), "class", "left_semi")

    span = heads.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.count(F.lit(1))).first()
    low, high, n = span[0] or 0, span[1] or 0, span[2]
    width = (high - low) // (1 << BITS) + 1
    n_asked = asked.count()
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-n_asked // BLOCK))
    cells = _packed(heads.withColumn("chunk", F.pmod("class", F.lit(chunks))), "chunk", CHUNK, width, low)
    queries = _packed(asked.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks))), "block", BLOCK, None, low)
    cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    bounds = (cells.join(queries, ["dim", "block"]).drop("block")
                   .mapInArrow(_scan(low, width, need), "query_class long, class long, lower double, upper double"))
    bounds = staged(bounds, "bounds")

    # the need-th best lower bound over all chunks; each task sends at most so many rows of a query
    best = Window.partitionBy("query_class").orderBy(F.col("lower").desc(), "class")
    limit = (bounds.withColumn("n", F.row_number().over(best)).where(F.col("n") <= need)
                   .groupBy("query_class").agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("limit")))
    limit = limit.select("query_class", F.when(F.col("n") >= need, F.col("limit")).alias("limit"))
    left = bounds.join(limit, "query_class").where(F.col("limit").isNull() | (F.col("upper") >= F.col("limit")))
    left = staged(left.select("query_class", "class", "upper"), "candidates")

    order = Window.partitionBy("query_class").orderBy(F.col("upper").desc(), "class")
    first = left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(FIRST, need)).select("query_class", "class")
    first = staged(_exact(first, heads), "first")
    by_score = Window.partitionBy("query_class").orderBy(F.col("score").desc(), "class")
    certain = (first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == need)
                    .select("query_class", F.col("score").alias("kth")))
    rest = (left.join(certain, "query_class", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
                .join(first.select("query_class", "class"), ["query_class", "class"], "left_anti")
                .select("query_class", "class"))
    scored = first.select("query_class", "class", "score").unionByName(
        _exact(rest, heads).select("query_class", "class", "score"))
    # the need best classes of a query class hold its k best rows and perhaps classes of the query's id alone; equal
    # scores are all kept, as ids decide among them
    near = Window.partitionBy("query_class").orderBy(F.col("score").desc())
    scored = scored.withColumn("r", F.rank().over(near)).where(F.col("r") <= need).drop("r")
    hits = (ask.join(scored, ask["class"] == scored["query_class"]).select("query_id", "query_class", scored["class"], "score")
               .join(members, "class").where(F.col("vec_id") != F.col("query_id"))
               .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))))
    final = Window.partitionBy("query_id", "query_class").orderBy(F.col("score").desc(), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each of the embeddings with an id divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_topk": op7_topk}
ORACLES = {"op7_topk": f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""}
