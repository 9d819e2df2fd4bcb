import numpy as np
import pytest
from pyspark.sql import functions as F

from papersift.operators import scoring, training


def _newton_sklearn(x, y, C=1.0, iters=50):
    """Balanced-weight L2 logistic regression, scikit-learn's objective, by Newton steps."""
    n = len(y)
    w_cls = {c: n / (2.0 * (y == c).sum()) for c in (0, 1)}
    s = np.array([w_cls[v] for v in y])
    X = np.hstack([x, np.ones((n, 1))])
    beta = np.zeros(X.shape[1])
    reg = np.ones(X.shape[1]) / C
    reg[-1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-X @ beta))
        g = X.T @ (s * (p - y)) + reg * beta
        H = (X * (s * p * (1 - p))[:, None]).T @ X + np.diag(reg)
        beta -= np.linalg.solve(H, g)
    return beta


def test_fit_matches_sklearn_objective(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.8, size=300) > 0.7).astype(int)
    rows = [(str(i), int(y[i]), [float(v) for v in x[i, :2]], [float(v) for v in x[i, 2:]]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, label int, e1 array<float>, e2 array<float>")
    model = training.fit_logistic(df, ["e1", "e2"], C=1.0, max_iter=1000)
    beta = _newton_sklearn(np.array([r[2] + r[3] for r in rows], dtype=np.float32).astype(float), y)
    got = np.append(model.coefficients.toArray(), model.intercept)
    assert np.allclose(got, beta, atol=1e-5)
    scored = scoring.score(model, df, ["e1", "e2"]).select("score").collect()
    assert all(0 <= r.score <= 1 for r in scored)


def test_single_class_raises(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [2.0])], "id string, label int, e array<double>")
    with pytest.raises(ValueError):
        training.fit_logistic(df, ["e"])


def test_label_rule_and_training_set(spark):
    rated = spark.createDataFrame(
        [("1", "like", [1.0]), ("2", "dislike", [2.0]), ("3", "neutral", [3.0]), ("4", None, [4.0]), ("5", "like", [5.0])],
        "id string, preference string, e array<double>")
    unrated = spark.createDataFrame([(str(i), [float(i)]) for i in range(10, 30)], "id string, e array<double>")
    ts = training.training_set(rated, unrated, ["e"], bg_sample_rate=2.5, seed=42)
    rows = ts.collect()
    labels = {r.id: r.label for r in rows if r.origin == "rated"}
    assert labels == {"1": 1, "2": 0, "3": 0, "4": 0, "5": 1}
    assert sum(1 for r in rows if r.origin == "pseudo") == 5  # int(2.5 * 2)
    with pytest.raises(ValueError):
        training.training_set(rated, unrated, ["e"], bg_sample_rate=50.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    w = {r.label: r.weight for r in training.class_weights(df).collect()}
    assert w == {1: 2.0, 0: 4 / 6}


def test_linear_score_in_codegen(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    s = scoring.linear_score(df, "v", [0.5, -0.25], 0.0).first().score
    assert abs(s - 0.5) < 1e-12
    bands = scoring.score_bands(spark.createDataFrame([(0.1, 1), (1.0, 1), (0.95, 0)], "score double, show int"))
    got = {r.band: (r.shown, r.total) for r in bands.collect()}
    assert got == {"0.0-0.3": (1, 1), "0.9-1.0": (0, 1)}  # 1.0 is in no band
    assert F  # keep import


def test_table_stats(spark):
    df = spark.createDataFrame([("a", 1), ("bb", None)], "s string, n int")
    r = scoring.table_stats(df).first()
    assert r.rows == 2 and r.json_chars == len('{"s":"a","n":1}') + len('{"s":"bb"}')
    assert scoring.table_stats(df.limit(0)).first().json_chars == 0
