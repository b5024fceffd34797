"""Scorer C, trained variant (N8): an ordinal class 0..4 from a logistic model of word counts.

Words and runs of marks are hashed to counts (``FEATURES`` slots), and these are weighed by a logistic regression fitted by Spark ML over all labelled texts,
both labels with the same total weight; the model is one vector, applied in the JVM. The probability p of the good class is cut at 0.2, 0.4, 0.6 and 0.8.
Texts without words get the class of the model's intercept; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token: a run of letters, or of characters that are neither letters nor white space.
RX_TOKEN = r"\p{L}+|[^\p{L}\s]+"
FEATURES, CUTS = 1 << 16, (0.2, 0.4, 0.6, 0.8)


def _with_words(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(RX_TOKEN), F.lit(0)))


def train_ordinal(texts: DataFrame, text_col: str = "text", label_col: str = "label", features: int = FEATURES,
                  penalty: float = 0.001) -> PipelineModel | None:
    """The model fitted to all rows with label 0 or 1; None where one of them is missing."""
    rows = _with_words(texts.where(F.col(label_col).isin(0, 1)), text_col).select("_words", F.col(label_col).cast("double").alias("_label"))
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # two rows
    if len(sizes) < 2:
        return None
    rows = rows.withColumn("_weight", F.when(F.col("_label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values()))
    stages = [HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features), Normalizer(inputCol="_counts", outputCol="_features", p=2.0),
              LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_p", predictionCol="_says",
                                 rawPredictionCol="_raw", regParam=penalty, maxIter=40)]
    return Pipeline(stages=stages).fit(rows)


def ordinal_class(p: Column) -> Column:
    """Class 0..4 of a probability."""
    out = F.lit(0)
    for k, cut in enumerate(CUTS, 1):
        out = F.when(p >= cut, k).otherwise(out)
    return out


def score_trained(df: DataFrame, model: PipelineModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``probability`` and ``ordinal``."""
    rows = model.transform(_with_words(df, text_col))
    return rows.select(*df.columns, vector_to_array("_p")[1].alias("probability")).withColumn("ordinal", ordinal_class(F.col("probability")))
