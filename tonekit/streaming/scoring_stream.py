"""Structured Streaming: score documents as they arrive in a folder of Parquet files.

The sentence split and the inline lexicon scoring are stateless row operations (a projection and
two generators), so they run unchanged on a ``readStream`` DataFrame and the result can go to the
file sink in append mode, exactly once (the sink's commit log plus the source's offset log in the
checkpoint folder), with the same layout for any lexicon that a plan carries. A larger one needs aggregates; that path
runs per micro-batch through ``foreachBatch`` with an idempotent overwrite of
the batch's own output folder, so a retried batch replaces its earlier attempt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tonekit.operators.scoring import _plan_rows, score_sentences
from tonekit.operators.sentences import explode_sentences


def scored_stream(stream: DataFrame, lexicon: DataFrame, id_col: str, text_col: str,
                  sentence_level: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Streaming DataFrame of scored sentences (inline lexicon only: stateless)."""
    if _plan_rows(lexicon) is None:
        raise ValueError("lexicon too large to inline; use start_scoring_stream (foreachBatch path)")
    sents = explode_sentences(stream, id_col, text_col, sentence_level, keep)
    return score_sentences(sents, lexicon, strategy="inline")


def start_scoring_stream(spark: SparkSession, source: str, schema: StructType, lexicon: DataFrame,
                         sink: str, checkpoint: str, id_col: str, text_col: str,
                         sentence_level: int = 1, keep: Sequence[str] = (),
                         available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the scoring stream from Parquet files under ``source`` into Parquet under ``sink``.

    ``checkpoint`` must be on shared storage on a cluster (it holds offsets and commits).
    ``available_now`` processes what is there in bounded micro-batches and stops.
    ``source`` is a folder or a glob of files (a single file name is not a valid stream source).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    if _plan_rows(lexicon) is not None:
        out = scored_stream(stream, lexicon, id_col, text_col, sentence_level, keep)
        return (out.writeStream.format("parquet").option("path", sink)
                   .option("checkpointLocation", checkpoint).outputMode("append")
                   .trigger(**trigger).start())

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        sents = explode_sentences(batch, id_col, text_col, sentence_level, keep)
        scored = score_sentences(sents, lexicon)
        scored.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
                  .trigger(**trigger).start())
