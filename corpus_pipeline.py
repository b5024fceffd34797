"""A training-data pipeline over ``documents``: each stage takes all that the one before has kept.

1. quality classifier: documents that it scores below 0.5 go;
2. near-duplicates: of each component the document with the smallest id stays;
3. secret scan: secrets in the texts give way to a mark;
4. mixing: documents are repeated or left out, so that sources come to their target weights;
5. packing: what is left as pieces of sequences of at most 1024 ids.

``run`` writes every stage's result as Parquet to the shared folder and reads it for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import fresh, staged, table
from tonekit.llm.mixing import mixed_documents
from tonekit.llm.near_dup import near_duplicates
from tonekit.llm.packing import pack_documents
from tonekit.llm.quality_model import model_of, score
from tonekit.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents among ``docs``, held-out thirds apart.

    Null and empty texts get a score like any other; rows that are equal are scored alike; ids without label only get a score.
    """
    out = fresh(docs, "score")
    return score(docs, model_of(spark, docs, sf_dir), out=out).where(F.col(out) >= 0.5).select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays. Rows that are equal in id and text stay one row; rows
    without an id go only where they are equal; documents without words are kept."""
    found = near_duplicates(docs)
    gone = staged(found.where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("id")).distinct(), "gone")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    left = rows.join(gone, F.col("row.doc_id") == F.col("id"), "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return left.dropDuplicates(["doc_id", "text"]) if _repeats(found) else left


def _repeats(found: DataFrame) -> bool:
    return not found.where("kept OR doc_id IS NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes: null and empty texts stay as they are, equal rows are redacted alike."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts have size 0, null is a source like any other; rows with one id and source are taken equally often."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are a piece with the end id alone; repeated rows are packed each."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dup", near_dup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # SQL has no compression or tokenizer: tests compare stage by stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k + 1 < len(STAGES):
            rows = staged(rows, f"stage_{name}")
    return rows
