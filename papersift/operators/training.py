"""Training set and model: P7 P8 P17 A1 A7 R1 U2 M1 M2."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papersift.operators.sampling import PURPOSE_NEGATIVES, uniform_draw


def with_label(rated: DataFrame, preference_col: str = "preference") -> DataFrame:
    """Like is 1, everything else (dislike, neutral, null) is 0."""
    return rated.withColumn("label", F.when(F.col(preference_col) == F.lit("like"), 1).otherwise(0))


def negative_quota(positives: int, bg_sample_rate: float) -> int:
    """A1: ``int(rate * positives)`` (truncation)."""
    return int(bg_sample_rate * positives)


def training_set(
    rated: DataFrame,
    unrated: DataFrame,
    embedding_columns: list[str] | tuple[str, ...],
    bg_sample_rate: float = 5.0,
    seed: int = 42,
    id_col: str = "id",
    clip: bool = False,
) -> DataFrame:
    """Rated rows plus ``int(rate * likes)`` pseudo-negatives drawn from ``unrated``.

    Output columns: id, label, origin ('rated' / 'pseudo'), embeddings.  The draw
    uses seed 42 and its own salt, independent of the later quota draw.
    """
    labelled = with_label(rated).select(id_col, "label", F.lit("rated").alias("origin"), *embedding_columns)
    positives = labelled.where(F.col("label") == 1).count()
    n_neg = negative_quota(positives, bg_sample_rate)
    negatives = uniform_draw(
        unrated.select(id_col, *embedding_columns), n_neg, seed=seed, id_col=id_col, purpose=PURPOSE_NEGATIVES, clip=clip
    ).select(id_col, F.lit(0).alias("label"), F.lit("pseudo").alias("origin"), *embedding_columns)
    return labelled.unionByName(negatives)


def training_keys(
    rated: DataFrame,
    unrated_ids: DataFrame,
    bg_sample_rate: float = 5.0,
    seed: int = 42,
    id_col: str = "id",
    clip: bool = False,
) -> DataFrame:
    """The rows of ``training_set`` as keys only: ``(id, label, origin)``.

    ``rated`` needs ``id, preference``; ``unrated_ids`` only ids.  The draw runs
    on ids alone, so the caller reads the (wide) embedding columns once, for the
    chosen rows, with one keyed join.
    """
    labelled = with_label(rated).select(id_col, "label", F.lit("rated").alias("origin"))
    positives = labelled.where(F.col("label") == 1).count()
    n_neg = negative_quota(positives, bg_sample_rate)
    negatives = uniform_draw(unrated_ids.select(id_col), n_neg, seed=seed, id_col=id_col,
                             purpose=PURPOSE_NEGATIVES, clip=clip)
    return labelled.unionByName(negatives.select(id_col, F.lit(0).alias("label"), F.lit("pseudo").alias("origin")))


def features(df: DataFrame, embedding_columns: list[str] | tuple[str, ...], out: str = "features") -> DataFrame:
    """M1: embedding columns side by side (config order) as one ML vector."""
    cols = [F.col(c) for c in embedding_columns]
    arr = cols[0] if len(cols) == 1 else F.concat(*cols)
    return df.withColumn(out, array_to_vector(arr.cast("array<double>")))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights ``n / (2 * n_class)`` per label."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # The window runs over the per-class counts (two rows), not over the data.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("weight", total / (F.lit(2.0) * F.col("n")))


def fit_logistic(
    train: DataFrame,
    embedding_columns: list[str] | tuple[str, ...],
    C: float = 1.0,
    max_iter: int = 1000,
    label_col: str = "label",
) -> LogisticRegressionModel:
    """M2: L2 logistic regression, class-balanced, unpenalised intercept.

    scikit-learn minimises ``0.5*|w|^2 + C * sum(s_i * loss_i)``; Spark minimises
    ``sum(s_i * loss_i) / sum(s_i) + regParam * 0.5*|w|^2``.  So
    ``regParam = 1 / (C * sum(s_i))`` and with balanced weights ``sum(s_i) = n``.
    Standardisation is off so the penalty acts on the raw coefficients.
    """
    counts = {r[label_col]: r["n"] for r in train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) == 0:
        raise ValueError(f"training needs both classes, got {counts}")
    n = sum(counts.values())
    w = {k: n / (2.0 * v) for k, v in counts.items()}
    weight = F.when(F.col(label_col) == 1, F.lit(w[1])).otherwise(F.lit(w[0]))
    data = features(train, embedding_columns).select(
        "features", F.col(label_col).cast("double").alias("label"), weight.alias("weight")
    )
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / (C * n),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        maxIter=max_iter,
        # Relative loss change; tighter values only hit the limits of double
        # precision in the line search.  The fit matches the exact optimum to ~1e-6.
        tol=1e-7,
    )
    return lr.fit(data)


def given_model(spark, weights: list[float], bias: float = 0.0) -> LogisticRegressionModel:
    """A model with known coefficients, as if fitted, for ``scoring.score``."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    values = gateway.new_array(jvm.double, len(weights))
    for k, w in enumerate(weights):
        values[k] = float(w)
    own = jvm.org.apache.spark.ml.classification.LogisticRegressionModel("given", jvm.org.apache.spark.ml.linalg.Vectors.dense(values), float(bias))
    return LogisticRegressionModel(own)
