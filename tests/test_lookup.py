"""Model outputs looked up by cell equal transformed rows: predictions, permutation importance, path lengths."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from auditora.operators import lookup
from auditora.operators import models as ml

FEATS = ["g", "a", "h", "b"]


@pytest.fixture(scope="module")
def fitted(spark):
    r = random.Random(17)
    rows = [(i, r.choice("pqrs"), r.randrange(9), r.choice(["x", "y", None]), round(r.gauss(0, 1), 2)) for i in range(900)]
    rows = [(*x, str(int(r.random() < 0.2 + 0.06 * x[2] + 0.2 * (x[1] == "q")))) for x in rows]
    df = spark.createDataFrame(rows, "id long, g string, a int, h string, b double, label string").persist()
    models = ml.train_models(df, FEATS, "label", which=["random_forest"], trees=30, rf_depth=6)
    models["gradient_boosting"] = ml.build_pipeline(df, FEATS, "label", ml.estimators(900, 2)["gradient_boosting"].setMaxIter(8)).fit(df)
    models["three"] = ml.build_pipeline(df, FEATS, "third", DecisionTreeClassifier(featuresCol=ml.FEATURES, labelCol=ml.LABEL_IDX, maxDepth=5)).fit(
        df.withColumn("third", (F.col("a") % 3).cast("string")))
    return df, models


@pytest.fixture
def looked_up(monkeypatch):
    def on():
        monkeypatch.setattr(lookup, "LOOKUP_ROWS", 1)
        found = lookup.lookup_of
        # any number of rows is worth the table here; rows must not be transformed one by one
        monkeypatch.setattr(lookup, "lookup_of", lambda m, spark, rows: found(m, spark, 1 << 40) or pytest.fail("no table"))
    return on


def test_predictions_equal_transform(spark, fitted, looked_up):
    df, models = fitted
    other = df.withColumn("b", F.col("b") * 3).withColumn("g", F.when(F.col("id") % 50 == 0, "new").otherwise(F.col("g"))).withColumn(
        "label", F.when(F.col("id") % 2 == 0, "0").otherwise("1"))

    def rows(m):
        return {(r["model"], r["id"]): r for r in ml.predictions(m, other, "id", "label", keep=["h"]).collect()}

    two = {n: models[n] for n in ("random_forest", "gradient_boosting")}
    plain = rows(two)
    third = rows({"three": models["three"]})
    looked_up()
    fast, fast3 = rows(two), rows({"three": models["three"]})
    for want, got in ((plain, fast), (third, fast3)):
        assert want.keys() == got.keys()
        for k, w in want.items():
            assert (w["y"], w["prediction"], w["h"]) == (got[k]["y"], got[k]["prediction"], got[k]["h"]) and abs(w["score"] - got[k]["score"]) < 1e-12


def test_permutation_importance_equals_transform(spark, fitted, looked_up):
    df, models = fitted
    odd = df.withColumn("label", F.when(F.col("id") % 40 == 0, F.lit(None)).when(F.col("id") % 41 == 0, "never").otherwise(F.col("label")))

    def found():
        return [(n, r["feature"], r["rank"], pytest.approx(r["importance_mean"], abs=1e-12), pytest.approx(r["importance_std"], abs=1e-12))
                for n in ("random_forest", "gradient_boosting")
                for r in ml.permutation_importance(models[n], odd, ["b", "a", "g", "h"], "label", "id", repeats=4, buckets=2).collect()]

    plain = found()
    looked_up()
    fast = found()
    assert len(plain) == len(fast) == 8
    for p, f in zip(plain, fast):
        assert p[:3] == f[:3] and p[3].expected == f[3] and p[4].expected == f[4]


def test_path_lengths_equal_transform(spark, fitted, looked_up):
    df, models = fitted
    plain = {n: ml.avg_path_length(m, df).first() for n, m in models.items()}
    looked_up()
    for n, m in models.items():
        got = ml.avg_path_length(m, df).first()
        assert got["n_paths"] == plain[n]["n_paths"] and got["avg_decision_path_length"] == pytest.approx(plain[n]["avg_decision_path_length"], abs=1e-12)


def test_few_rows_and_many_cells_are_transformed(spark, fitted, monkeypatch):
    _, models = fitted
    assert lookup.lookup_of(models["random_forest"], spark, 900) is None
    monkeypatch.setattr(lookup, "LOOKUP_CELLS", 10)
    assert lookup.lookup_of(models["random_forest"], spark, 1 << 40) is None
