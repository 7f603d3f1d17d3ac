"""Distributed dictionaries, their use in training, local surrogates, Shapley errors, reports, the training gate."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from auditora.operators import explain as ex
from auditora.operators import models as ml


@pytest.mark.parametrize("chunks", [1, 7])
def test_codes_are_ranks_of_all_values(spark, chunks):
    rows = [(f"v{i % 900}é{i % 3}", random.Random(i).choice(["a", "B", "", "ß", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "x string, y string").repartition(5)
    got = {(r["feature"], r["value"]): r["code"] for r in ml.value_codes(df, ["x", "y"], chunks).collect()}
    for j, c in enumerate("xy"):
        values = sorted({r[j] for r in rows if r[j] is not None}, key=lambda v: v.encode())
        assert {v: k for (f, v), k in got.items() if f == c} == {v: i for i, v in enumerate(values)}


def test_encode_a_column_with_as_many_values_as_rows(spark, monkeypatch):
    rows = [(i, f"id-{(i * 7919) % 3000:05d}", None if i % 10 == 0 else "pqr"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, a string, `b.c` string")
    want = {i: (int(a[3:]), None if b is None else "pqr".index(b)) for i, a, b in rows}
    for bound in (1_000_000, 0):  # 0: no dictionary is broadcast
        monkeypatch.setattr(ml, "DICTIONARY_BROADCAST", bound)
        out = ml.encode(df, ["a", "b.c"])
        assert out.columns == ["k", "a", "b.c"]
        assert {r["k"]: (r["a"], r["b.c"]) for r in out.collect()} == want


def test_training_codes_wide_columns_without_indexing_them(spark):
    r = random.Random(3)
    rows = [(i, f"w{r.randrange(700):03d}", r.choice("xyz"), 0) for i in range(2000)]
    rows = [(i, w, s, str(int(int(w[1:]) > 350))) for i, w, s, _ in rows]
    df = spark.createDataFrame(rows, "id long, w string, s string, label string")
    models = ml.train_models(df, ["w", "s"], "label", which=["random_forest", "logistic_regression"], trees=10)
    for m in models.values():
        assert any(isinstance(s, ml.CodeModel) for s in m.stages)
        assert not any(s.__class__.__name__ == "StringIndexerModel" and s.getInputCol() == "w" for s in m.stages)
        assert ml._input_names(m) == ["w", "s"]
    acc = ml.compare_models(ml.predictions(models, df, "id", "label")).collect()
    assert {a["model"]: a["accuracy"] > 0.95 for a in acc}["random_forest"]
    new = spark.createDataFrame([(1, "never seen", "x", "0"), (2, None, "x", "0")], df.schema)
    assert [x["w"] for x in ml.encoded_view(models["random_forest"], new).collect()] == [len({w for _, w, _, _ in rows})] * 2


@pytest.fixture(scope="module")
def fitted(spark):
    r = random.Random(5)
    rows = [(i, r.gauss(0, 1), r.random() * 10, r.choice(["p", "q", "q", None])) for i in range(400)]
    rows = [(*x, str(int(x[1] + (1.5 if x[3] == "p" else 0) + 0.2 * r.gauss(0, 1) > 0.5))) for x in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, g string, label string")
    return df, ml.train_models(df, ["a", "b", "g"], "label", which=["random_forest"], trees=20, rf_depth=5)["random_forest"]


def test_surrogates_equal_a_plain_weighted_fit(spark, fitted, monkeypatch):
    df, model = fitted
    seen = {}
    transform = model.transform

    class Spy:
        stages = model.stages

        @staticmethod
        def transform(rows):
            seen["rows"] = rows
            return transform(rows)

    few = df.where("id < 6")
    got = {}
    for r in ml.local_surrogate(Spy, few, ["a", "b", "g"], "id", samples=40).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["weight"]
    own = {r["id"]: r for r in few.collect()}
    sd = few.agg(F.stddev_samp("a").alias("a"), F.stddev_samp("b").alias("b")).first()
    scored = transform(seen["rows"]).select("id", "a", "b", "g", vector_to_array("probability")[1].alias("y")).collect()
    assert {r["g"] for r in scored} <= {"p", "q", None} and len(scored) == 240
    for i, row in own.items():
        mine = [r for r in scored if r["id"] == i]
        z = np.array([[1, (r["a"] - row["a"]) / sd["a"], (r["b"] - row["b"]) / sd["b"], float(r["g"] == row["g"])] for r in mine])
        w = np.exp(-(z[:, 1] ** 2 + z[:, 2] ** 2 + 1 - z[:, 3]) / (0.75 * math.sqrt(3)) ** 2)
        beta = np.linalg.solve((z * w[:, None]).T @ z + 1e-3 * np.eye(4), (z * w[:, None]).T @ [r["y"] for r in mine])
        assert np.allclose([got[i][f] for f in ("_intercept", "a", "b", "g")], beta / [1, sd["a"], sd["b"], 1], atol=1e-8)


def test_surrogate_draws_follow_the_frequencies(spark, fitted):
    df, model = fitted
    seen = {}

    class Spy:
        stages = model.stages

        @staticmethod
        def transform(rows):
            seen["rows"] = rows
            return model.transform(rows)

    ml.local_surrogate(Spy, df, ["a", "g"] + ["b"], "id", samples=30)
    want = {r["g"]: r["count"] / 400 for r in df.groupBy("g").count().collect()}
    drawn = {r["g"]: r["count"] / 12000 for r in seen["rows"].groupBy("g").count().collect()}
    assert all(abs(drawn[g] - want[g]) < 0.03 for g in want)


def test_shapley_errors_shrink_with_permutations(spark, fitted):
    df, model = fitted
    few = df.where("id < 20")
    size = {}
    for n in (2, 16):
        rows = ml.shapley_sampling(model, few, df, ["a", "b", "g"], "id", permutations=n).collect()
        assert len(rows) == 60 and all(r["std_error"] >= 0 for r in rows)
        size[n] = np.mean([r["std_error"] for r in rows if r["feature"] == "a"])
    assert size[16] < size[2]
    assert all(r["std_error"] is None for r in ml.shapley_sampling(model, few, df, ["a", "b", "g"], "id", permutations=1).collect())


def test_report_and_path_length(spark, fitted):
    df, model = fitted
    depth = ml.avg_path_length(model, df).first()
    assert 2 <= depth["avg_decision_path_length"] <= 6 and depth["n_paths"] == 400 * 20
    inputs = ml.encoded_view(model, df)
    from auditora.operators import treeshap as ts
    rep = ml.explanation_report(ml.feature_importance(model, spark), ml.model_complexity(model, spark),
                                ex.high_correlation_pairs(ex.correlation_matrix(inputs, ["a", "b", "g"]), ["a", "b", "g"]),
                                ex.neighbor_mutual_information(inputs, ["a", "b"], "label"), ts.tree_shapley(model, df, "id"))
    got = {(r["section"], r["key"]): r["value"] for r in rep.collect()}
    assert got["interpretability", "score"] == pytest.approx(5 / 6) and got["complexity", "n_estimators"] == 20
    assert got["mean_abs_attribution", "a"] > got["mean_abs_attribution", "b"] and {k for s, k in got if s == "importance"} == {"a", "b", "g"}


def test_gate_and_coefficients(spark, fitted):
    df, _ = fitted
    with pytest.raises(ValueError, match="g="):
        ml.assert_complete(df)
    ml.assert_complete(df.na.fill("none"))
    lr = ml.train_models(df, ["a", "b"], "label", which=["logistic_regression"])["logistic_regression"]
    coef = ml.linear_model_coefficients(lr)
    assert set(coef) == {"a", "b"} and abs(coef["a"]) > abs(coef["b"])


def test_table_surrogates_equal_transformed_samples(spark, fitted, monkeypatch):
    from auditora.operators import treeshap as ts
    df, model = fitted
    # repeated and NULL ids share their sums; samples must not be transformed one by one
    rows = df.where("id < 40").unionByName(df.where("id < 5")).unionByName(df.where("id >= 395").withColumn("id", F.lit(None).cast("long")))

    def weights():
        return {(r["id"], r["feature"]): r["weight"] for r in ml.local_surrogate(model, rows, ["g", "b", "a"], "id", samples=40).collect()}

    transform = type(model).transform
    monkeypatch.setattr(type(model), "transform", lambda *_: pytest.fail("transformed"))
    fast = weights()
    monkeypatch.setattr(type(model), "transform", transform)
    monkeypatch.setattr(ts, "GRID_CELLS", 0)
    plain = weights()
    assert fast.keys() == plain.keys() and len(fast) == 41 * 4
    assert all(abs(fast[k] - plain[k]) < 1e-8 for k in plain)


def test_training_rows_are_spread_over_tasks(spark, fitted, monkeypatch):
    df, _ = fitted
    seen = []
    fit = ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: (seen.append((rows.rdd.getNumPartitions(), rows.count())), fit(self, rows))[1])
    monkeypatch.setattr(ml, "TRAIN_ROWS", 50)
    ml.train_models(df.coalesce(1), ["a", "b"], "label", which=["random_forest"], trees=2, rf_depth=2)
    assert seen == [(8, 400)]
