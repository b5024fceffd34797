"""Operator 6: quality classifier by compression.

Two zstandard dictionaries are trained, one from texts labelled good and one from bad ones. A text is
compressed in pieces of ``PIECE`` bytes (so that a long text's own past does not stand in for the
dictionary), with either dictionary and with none. The normalised difference of the sizes, and the sizes
as shares of each other and of the text, are turned into a probability by a logistic curve that is
fitted on other labelled texts than the dictionaries, weighted to the classes' shares.

Labels are only used of rows that ``train`` selects, and as a bounded sample: per class and use at
most ``SAMPLE`` texts, those with the smallest hashes of their ids, of at most ``SAMPLE_CHARS``
characters each. Every text is scored whole. Language, source, id and labels are never inputs.

Defined results: a null or empty text is scored as one without bytes; without both classes among the
labelled rows every text gets the share of good ones (0.5 without labels); equal texts get equal
scores; rows with a null id are scored like others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm.common import table

SAMPLE, SAMPLE_CHARS = 1000, 50_000
DICTIONARY, LEVEL, PIECE = 32_768, 3, 512
#: Penalty of the logistic fit on standardised inputs.
RIDGE = 0.3

_SCORED = "doc_id long, score double"


def _pieces(text: bytes) -> list[bytes]:
    return [text[i: i + PIECE] for i in range(0, len(text), PIECE)] or [b""]


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [p for t in texts for p in _pieces(t) if p]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their bytes are the dictionary
        return b"".join(pieces)[-DICTIONARY:]


class Sizes:
    """Inputs of the curve: compressed sizes of a text with the dictionaries and without."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.with_ = [zstandard.ZstdCompressor(dict_data=self._ready(d), **plain) for d in (good, bad)]
        self.without = zstandard.ZstdCompressor(**plain)

    @staticmethod
    def _ready(data: bytes) -> zstandard.ZstdCompressionDict:
        found = zstandard.ZstdCompressionDict(data)
        found.precompute_compress(level=LEVEL)
        return found

    def __call__(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        pieces = _pieces(raw)
        by_good = [len(self.with_[0].compress(p)) for p in pieces]
        by_bad = [len(self.with_[1].compress(p)) for p in pieces]
        good, bad = sum(by_good), sum(by_bad)
        alone = sum(len(self.without.compress(p)) for p in pieces)
        worst = min((b - g) / max(1, len(p)) for g, b, p in zip(by_good, by_bad, pieces))
        return [(bad - good) / (bad + good), worst, (bad - good) / alone, alone / max(1, len(raw)),
                (len(raw) + 1) ** -0.5, bad / alone, good / alone]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    middle: list[float]
    spread: list[float]
    weights: list[float]  # the first one for the constant
    share: float  # of good labels, for want of a curve

    def scores(self, texts: list[str | None], sizes: Sizes | None) -> list[float]:
        if not self.weights:
            return [self.share] * len(texts)
        inputs = (np.array([sizes(t) for t in texts]) - self.middle) / self.spread
        line = np.clip(inputs @ np.array(self.weights[1:]) + self.weights[0], -35, 35)
        return (1 / (1 + np.exp(-line))).tolist()


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps; the constant is not penalised."""
    a = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [RIDGE] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> QualityModel:
    """Learn from the labelled rows given (1: good, 0: bad); other labels are passed over."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    known = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}  # two rows
    total = sum(known.values())
    share = known.get(1, 0) / total if total else 0.5
    nothing = QualityModel(b"", b"", [], [], [], share)
    texts = {}
    for y in (0, 1):  # a bounded sample
        short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
        some = ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(4 * SAMPLE).select("id").distinct()
        rows = short.join(F.broadcast(some), "id").orderBy(F.xxhash64("id"), "id", "text").limit(2 * SAMPLE).collect()
        texts[y] = [r["text"] for r in rows]
    if min(map(len, texts.values())) < 2:
        return nothing
    good, bad = (_dictionary([t.encode() for t in texts[y][::2]]) for y in (1, 0))
    sizes = Sizes(good, bad)
    rest = [(t, y) for y in (0, 1) for t in texts[y][1::2]]
    x = np.array([sizes(t) for t, _ in rest])
    y = np.array([float(k) for _, k in rest])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return QualityModel(good, bad, middle.tolist(), spread.tolist(), _fit((x - middle) / spread, y, weight).tolist(), share)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None,
          out: str = "score") -> DataFrame:
    """``keep`` columns (all) of ``docs`` and the score of each whole text as ``out``."""
    keep = list(docs.columns if keep is None else keep)
    at = keep.index(text_col) if text_col in keep else len(keep)  # the text goes to the tasks once
    rows = docs.select(*[F.col(f"`{c}`") for c in keep + [text_col] * (at == len(keep))])
    schema = type(rows.schema)(rows.schema.fields[:len(keep)]).add(out, "double")

    def run(batches):
        sizes = Sizes(model.good, model.bad) if model.weights else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(model.scores(texts, sizes) if texts else [], pa.float64())], [*keep, out])

    return rows.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Rows whose labels are not learnt from: a third of all ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def model_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    labels = table(spark, sf_dir, "labels")
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the labels of two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, model_of(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}  # SQL has no compression: tests measure the accuracy on held-out labels
