"""Composite jobs: the data under the agreement figures (A21, A22) and the whole analysis run.

Each composite returns named DataFrames; the scored sentence table they share is materialized
once (reliable checkpoint to the cluster's checkpoint folder when one is configured), so the
several small aggregates that follow do not re-run the scoring and a lost executor does not send
them back to the raw corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonekit.operators import agreement as agr
from tonekit.operators import stats, windows
from tonekit.operators.clean import stack, union_all
from tonekit.functions.text import panel_title
from tonekit.operators.joins import broadcast_if_small
from tonekit.plans.sentiment import conversation_posts, sentiment_table
from tonekit.session import materialize


def comparative_figures(scored: DataFrame) -> dict[str, DataFrame]:
    """Classes and flags per sentence, agreement percentages per pair, and three crosstabs."""
    flags = agr.agreement_flags(scored)
    out = {"classes": flags, "agreement_pct": agr.agreement_pct(scored)}
    out.update(agr.class_crosstabs(scored))
    return out


def figure_rows(scored: DataFrame) -> DataFrame:
    """All tables of ``comparative_figures`` but the sentences' own classes, as ``(figure, row, col, n, share)``.

    One count per class combination and one per pair of rounded scores are what every figure derives from, so the
    scored sentences are read twice whatever the number of figures.
    """
    cells = agr.class_cells(scored)
    pairs = []
    for a, b in (("compound", "polarity"), ("compound", "ordinal"), ("polarity", "ordinal")):
        flag = agr.agreement(F.col(f"cat_{a}"), F.col(f"cat_{b}"))
        counts = cells.groupBy(flag.alias("col")).agg(F.sum("n").alias("n"))
        pairs.append(counts.select(F.lit("agreement").alias("figure"), F.lit(f"{a}_{b}").alias("row"), "col", "n"))
    for a in ("compound", "polarity"):
        known = cells.where(F.col("cat_ordinal").isNotNull() & F.col(f"cat_{a}").isNotNull())
        counts = known.groupBy(F.col("cat_ordinal").alias("row"), F.col(f"cat_{a}").alias("col")).agg(F.sum("n").alias("n"))
        pairs.append(counts.select(F.lit(f"ordinal_{a}").alias("figure"), "row", "col", "n"))
    rounded = agr.crosstab_rounded(scored, "compound", "polarity", 1)
    pairs.append(rounded.select(F.lit("rounded").alias("figure"), F.col("compound_round").cast("decimal(4,1)").cast("string").alias("row"),
                                F.col("polarity_round").cast("decimal(4,1)").cast("string").alias("col"), "n"))
    rows = union_all(pairs)
    total = F.sum("n").over(Window.partitionBy("figure", "row"))
    return rows.withColumn("share", F.col("n") / total)


def corr_info(scored: DataFrame) -> dict[str, DataFrame]:
    """Correlation matrix on non-zero pairs, disagreement-type crosstab, and the two looked-up
    values (r and the share of disagreements due to a zero score)."""
    return {"corr": agr.corr_matrix(scored), "disagreement_type": agr.disagreement_types(scored),
            "values": agr.corr_info(scored)}


def comparative_panels(scored: DataFrame, meta: DataFrame, order_cols: list[str], name_col: str,
                       year_col: str, value: str = "polarity", ncol: int = 3) -> dict[str, DataFrame]:
    """Data under the per-document panel chart (W1-W4, W7, A5, A19, T11), keyed by document id.

    ``scored``: sentence rows with ``id``, ``rank_sentence`` (contiguous) and score columns;
    ``meta``: one row per id with ``order_cols`` (first appearance order), ``name_col``, ``year_col``.
    Returns ``panels`` (id, panel, panel_row, panel_col, title), ``series`` (id, x, y, ma) and
    ``means`` (id, mean per scorer). Every table is joined by id, never matched by position.
    """
    wanted = list(dict.fromkeys(["id", *order_cols, name_col, year_col]))
    panels = windows.panel_index(meta.select(*wanted), "id", order_cols, ncol)
    panels = panels.select("id", "panel", "panel_row", "panel_col",
                           panel_title(F.col(name_col), F.col(year_col)).alias("title"))
    prog = windows.speech_progress(scored).select("id", "rank_sentence", "percentage", value)
    series = stats.series_by(windows.rolling_mean(prog, value, out="ma"), "id", "percentage", value, "ma")
    means = stats.scorer_means(scored, "id", ["compound", "polarity", "ordinal"])
    return {"panels": panels, "series": series, "means": means}


def analysis(documents: DataFrame, conversations: DataFrame, labels: DataFrame,
             lexicon: DataFrame) -> dict[str, DataFrame]:
    """The analysis run: score both corpora once, then every statistic of the study.

    ``documents(doc_id, text, lang, ...)`` in sentence mode, ``conversations`` in whole-text mode,
    ``labels(doc_id, quality)`` as the two-group split.
    """
    docs = materialize(sentiment_table(documents, "doc_id", "text", lexicon, 1, keep=["lang"]))
    posts = conversation_posts(conversations)
    convs = materialize(sentiment_table(posts, "post_id", "text", lexicon, 0, keep=["author"]))
    groups = labels.select(F.col("doc_id").alias("id"), "quality")
    labelled = docs.join(broadcast_if_small(groups), "id", "left")
    cols = ["id", "rank_sentence", "compound", "polarity", "ordinal"]
    both = stack([docs.select(*cols), convs.select(*cols)], ["documents", "conversations"])
    out: dict[str, DataFrame] = {
        "hist_compound": stats.histogram_pct(labelled.where(F.col("quality").isNotNull()), "compound", "quality"),
        "ordinal_share": stats.value_share(labelled, "ordinal", ["quality"]),
        "kde_compound": stats.kde(both, "compound", "corpus"),
        "group_share": stats.group_share(both, "ordinal", "corpus"),
        "progress": windows.speech_progress(docs),
        "evolution": stats.summary_by(docs, "id", "ordinal", "lang", "rank_sentence"),
        "median": stats.median_by(labelled, "quality", "compound"),
        "mann_whitney": stats.mann_whitney(labelled, "compound", "quality", 1, 0),
    }
    for name, scored in (("documents", docs), ("conversations", convs)):
        for key, df in comparative_figures(scored).items():
            out[f"{name}_{key}"] = df
        for key, df in corr_info(scored).items():
            out[f"{name}_{key}"] = df
    return out
