"""Operator 3: token ids as compressed binary blocks.

``write_tokens`` tokenizes documents, counts ids over all of them, makes one canonical
length-limited Huffman code of the counts (``huffman``) and writes the coded ids in ascending
id order; ``read_tokens`` gives the ids back.

File format, two Parquet tables below one folder (Spark's committer writes them, so a retried
task leaves no half file):

* ``code``: ``token``, ``bits`` - the code lengths, from which the canonical code follows;
* ``blocks``: ``range_no``, ``block_no``, ``first`` (ids of the range before the block), ``doc_id``
  and ``n_tokens`` (arrays, a document each), ``checkpoints`` (array: the bit offset of every
  128th id of each document, the first included) and ``payload``. A block is decoded by itself.

Order: the documents are parted into ranges of ids by quantiles of the ids; a range is
one shuffle partition, sorted and cut into blocks as it streams by. Ids of earlier ranges are
added from a table with a row per range (at most ``MAX_RANGES``).

Defined results: a null or empty text has the end id alone; rows with a null id come first;
rows with equal ids stand together, by number of ids and then by coded bytes; an empty
table gives empty tables. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonekit.llm.common import scratch, staged, table
from tonekit.llm.encoder import encoder
from tonekit.llm.huffman import EVERY, LIMIT, Code, code_lengths

END_ID = 1
#: Ids of a range, if there are not too many ranges, and ids after which a block is closed.
RANGE_IDS, MAX_RANGES, BLOCK_IDS = 8_000_000, 20_000, 1 << 19
#: Texts that are coded at a time, and bytes of text after which those tokenized at a time end.
TEXTS, TEXT_BYTES = 256, 1 << 23

_IDS = "doc_id long, n_tokens long, ids binary"
_COUNTED = _IDS + ", token array<long>, n array<long>"
_CODED = "range_no int, doc_id long, n_tokens long, bits binary, checkpoints array<long>"
_BLOCK = ("range_no int, block_no long, first long, doc_id array<long>, n_tokens array<long>, "
          "checkpoints array<long>, payload binary")
_READ = "doc_id long, start long, n_tokens long, ids binary"


def _arrow(schema: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, types[t]) for n, t in (c.split(" ") for c in schema.split(", "))])


def tokenize(docs: DataFrame, path: str, drops_space: bool, end_id: int, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: ids of each whole text and ``end_id``, as unsigned 32-bit integers."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_tokenizer(path, drops_space, end_id), _IDS)


def _tokenizer(path: str, drops_space: bool, end_id: int):
    tail, schema = np.array([end_id], dtype="<u4").tobytes(), _arrow(_IDS)

    def run(batches):
        enc = encoder(path, drops_space)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
            cuts = sorted({0, *(np.flatnonzero(np.diff(size // TEXT_BYTES)) + 1).tolist(), batch.num_rows})
            for a, b in zip(cuts, cuts[1:]):
                ids = enc.encode_array(batch.column(1).slice(a, b - a), tail)
                n = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, ids], schema=schema)

    return run


def _counted(docs: DataFrame, path: str, drops_space: bool, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_tokens, ids``, and after a task's last row one row with its counts: arrays ``token``, ``n``."""
    schema, tokenized = _arrow(_COUNTED), _tokenizer(path, drops_space, end_id)

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in tokenized(batches):
            new = np.bincount(np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4"))
            if len(new) > len(total):
                total, new = new.astype(np.int64), total
            total[: len(new)] += new
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, none, none], schema=schema)
        used = np.flatnonzero(total)
        row = [[None], [None], [None], [used], [total[used]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _COUNTED)


def _counts(counted: DataFrame) -> np.ndarray:
    """How often each id occurs: a row per id and task, then one per id (the vocabulary bounds them)."""
    rows = (counted.where("token IS NOT NULL").select(F.inline(F.arrays_zip("token", "n")))
                   .groupBy("token").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["token"].to_numpy(dtype=np.int64)] = rows["n"]
    return counts


def _bounds(ids: DataFrame, total: int) -> list[int]:
    """Ids that part the table into ranges of about equal numbers of documents."""
    n = min(MAX_RANGES, -(-total // RANGE_IDS))
    if n < 2:
        return []
    found = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"]
    return sorted(set(found or []))


def _coded(ids: DataFrame, lengths: np.ndarray, bounds: list[int]) -> DataFrame:
    schema = _arrow(_CODED)

    def run(batches):
        code, edges = Code(lengths), np.array(bounds, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                done = [code.encode(np.frombuffer(b, dtype="<u4")) for b in part.column(2).to_pylist()]
                low = np.iinfo(np.int64).min
                key = part.column(0).fill_null(low).to_numpy(zero_copy_only=False)
                no = np.searchsorted(edges, key, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(no), part.column(0), part.column(1), pa.array([b for b, _ in done], pa.binary()),
                     pa.array([c for _, c in done], pa.list_(pa.int64()))], schema=schema)

    return ids.mapInArrow(run, _CODED)


def _blocks(batches):
    """Rows of whole ranges, in order, to blocks."""
    schema = _arrow(_BLOCK)
    no, block, first, open_ids = None, 0, 0, 0
    docs, sizes, checks, bits, place = [], [], [], [], 0

    def closed():
        row = [[no], [block], [first], [docs], [sizes], [np.concatenate(checks)], [b"".join(bits)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for range_no, doc, n, coded, check in zip(*(c.to_pylist() for c in batch.columns)):
            if docs and (range_no != no or open_ids + n > BLOCK_IDS):
                yield closed()
                block, first = block + 1, first + open_ids
                docs, sizes, checks, bits, place, open_ids = [], [], [], [], 0, 0
            if range_no != no:
                no, block, first = range_no, 0, 0
            docs.append(doc)
            sizes.append(n)
            checks.append(np.array(check, dtype=np.int64) + 8 * place)
            bits.append(coded)
            place, open_ids = place + len(coded), open_ids + n
    if docs:
        yield closed()


def write_tokens(docs: DataFrame, folder: str, path: str, drops_space: bool, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize ``docs`` and write the files described above below ``folder``."""
    spark = docs.sparkSession
    counted = staged(_counted(docs, path, drops_space, end_id, id_col, text_col), "ids")
    counts, ids = _counts(counted), counted.where("token IS NULL").select("doc_id", "n_tokens", "ids")
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(t), int(lengths[t])) for t in used], "token long, bits int") \
         .coalesce(1).write.parquet(f"{folder}/code")
    bounds = _bounds(ids, int(counts.sum()))
    coded = _coded(ids, lengths, bounds)
    ordered = (coded.repartitionById(len(bounds) + 1, "range_no")  # a range per task
                    .sortWithinPartitions("range_no", F.col("doc_id").asc_nulls_first(), "n_tokens", "bits"))
    ordered.mapInArrow(_blocks, _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files below ``folder``."""
    rows = spark.read.parquet(f"{folder}/code").toPandas()  # a row per id of the vocabulary
    lengths = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 0, dtype=np.uint8)
    lengths[rows["token"].to_numpy(dtype=np.int64)] = rows["bits"]
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    # a row per range, at most MAX_RANGES: that bounds the broadcast
    sums = blocks.groupBy("range_no").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before = sums.select("range_no", (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(before), "range_no").select(
        (F.col("before") + F.col("first")).alias("start"), "doc_id", "n_tokens", "checkpoints", "payload")
    schema = _arrow(_READ)

    def run(batches):
        code = Code(lengths)
        for batch in batches:
            for start, doc, n, check, payload in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.array(n, dtype=np.int64)
                pieces = -(-n // EVERY)
                size = np.full(int(pieces.sum()), EVERY, dtype=np.int64)
                size[np.cumsum(pieces) - 1] = n - (pieces - 1) * EVERY
                ids = code.decode(payload, np.array(check, dtype=np.int64), size).tobytes()
                ends = np.cumsum(n)
                own = [ids[4 * a: 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(n), pa.array(own, pa.binary())],
                    schema=schema)

    return placed.mapInArrow(run, _READ)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the binary format and back: place, number and crc32 of its ids."""
    import public_tokenizers

    folder = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), True)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


assert LIMIT <= 25  # a code and its place in a byte fit into 32 bits

QUERIES = {"op3_token_output": op3_token_output}
ORACLES: dict[str, str] = {}  # SQL has no tokenizer: tests compare with one, whole text by whole text
