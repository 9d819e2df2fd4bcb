"""Scoring and score reports: M3 M4 A2 A3 A4 P9 P10, plus a fixed-weight scorer."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.operators.training import features

# Fixed score bands of the report (A3): [0,.3) [.3,.5) [.5,.7) [.7,.9) [.9,1.0).
# A score of exactly 1.0 falls in no band.
SCORE_BANDS = [(0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.0)]


def score(model: LogisticRegressionModel, df: DataFrame, embedding_columns: list[str] | tuple[str, ...]) -> DataFrame:
    """M3: positive-class probability as ``score`` (double); input columns kept."""
    cols = df.columns
    scored = model.transform(features(df, embedding_columns, out=model.getFeaturesCol()))
    return scored.select(*cols, vector_to_array(F.col(model.getProbabilityCol()))[1].alias("score"))


def linear_score(df: DataFrame, vector_col: str, weights: list[float], bias: float = 0.0) -> DataFrame:
    """Logistic score with fixed weights, in whole-stage code (no ML round trip):
    ``1 / (1 + exp(-(sum(x_i * w_i) + b)))``."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(
        F.zip_with(F.col(vector_col).cast("array<double>"), w, lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(float(bias))))))


def drop_embeddings(df: DataFrame, embedding_columns: list[str] | tuple[str, ...]) -> DataFrame:
    """P9."""
    return df.drop(*embedding_columns)


def recommended(df: DataFrame) -> DataFrame:
    """P10: rows with ``show = 1``; error if ``show`` is missing."""
    if "show" not in df.columns:
        raise ValueError("'show' column is missing; run the quota draw first")
    return df.where(F.col("show") == 1)


def display_projection(df: DataFrame) -> DataFrame:
    """P10 display columns."""
    return recommended(df).select("id", "title", "abstract", "score")


def shown_rate(df: DataFrame) -> DataFrame:
    """A2: shown count, total and percentage (0 when empty)."""
    return df.agg(
        F.coalesce(F.sum("show"), F.lit(0)).cast("bigint").alias("shown"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn(
        "pct", F.when(F.col("total") > 0, F.col("shown") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    )


def score_band(score_col: str = "score"):
    s = F.col(score_col)
    expr = None
    for lo, hi in SCORE_BANDS:
        cond = (s >= F.lit(lo)) & (s < F.lit(hi))
        label = F.lit(f"{lo:.1f}-{hi:.1f}")
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def score_bands(df: DataFrame, score_col: str = "score") -> DataFrame:
    """A3: per band shown/total/percent; empty bands are omitted, 1.0 is in no band."""
    return (
        df.withColumn("band", score_band(score_col))
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.sum("show").cast("bigint").alias("shown"), F.count(F.lit(1)).alias("total"))
        .withColumn("pct", F.col("shown") * 100.0 / F.col("total"))
    )


def score_summary(df: DataFrame, score_col: str = "score") -> DataFrame:
    """A4: min, max and mean score."""
    s = F.col(score_col)
    return df.agg(F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"))


def table_stats(df: DataFrame) -> DataFrame:
    """Row count and size of a table in one pass; the size is the length of
    each row written as JSON, summed (an engine-independent measure)."""
    row_json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(F.length(row_json)), F.lit(0)).cast("bigint").alias("json_chars"))
