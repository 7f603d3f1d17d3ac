"""Correlations in one scan, neighbour mutual information, tree attributions, surrogates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditora.operators import explain as ex


def matrix(df, cols):
    return {(r["feature1"], r["feature2"]): r["r"] for r in ex.correlation_matrix(df, cols).collect()}


def test_correlations_of_200_columns_with_gaps(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 200))
    x[:, 1:] += x[:, :1] * r.uniform(-1, 1, 199)
    x[r.random(x.shape) < 0.1] = np.nan
    cols = [f"a.{i}" for i in range(200)]
    rows = [tuple(None if math.isnan(v) else float(v) for v in row) for row in x]
    got = matrix(spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(7), cols)
    import pandas as pd
    want = pd.DataFrame(x).corr().to_numpy()
    assert len(got) == 200 * 200
    assert all(abs(got[cols[i], cols[j]] - want[i, j]) < 1e-9 for i in range(200) for j in range(200))


def test_shifted_data_constants_and_odd_values(spark):
    r = random.Random(2)
    rows = [(1e9 + (u := r.random()), 1e9 - u + 1e-3 * r.random(), 0.1, float("nan") if i == 3 else u, None, u if i % 2 else None, None if i % 2 else u)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double").repartition(5)
    got = matrix(df, list("abcdefg"))
    x = np.array([[v[0] - 1e9, v[1] - 1e9] for v in rows])
    assert abs(got["a", "b"] - np.corrcoef(x.T)[0, 1]) < 1e-6 and got["a", "a"] == pytest.approx(1)
    assert got["a", "c"] is None and got["c", "c"] is None and got["a", "e"] is None and got["e", "e"] is None
    assert math.isnan(got["a", "d"]) and got["f", "g"] is None and got["a", "f"] == pytest.approx(1, abs=1e-6)
    assert all(v is None for v in matrix(df.limit(0), ["a", "b"]).values())


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain_mi(rows, k):
    """rows of (value, class)."""
    rows = [(x, y) for x, y in rows if x is not None and math.isfinite(x) and y is not None]
    size = {y: sum(c == y for _, c in rows) for _, y in rows}
    rows = [(x, y) for x, y in rows if size[y] > 1]
    if not rows:
        return None
    pk = pm = py = 0.0
    for i, (x, y) in enumerate(rows):
        own = sorted(abs(x - v) for j, (v, c) in enumerate(rows) if c == y and j != i)
        kk = min(k, len(own))
        d = np.nextafter(own[kk - 1], 0.0)
        pk, py = pk + digamma(kk), py + digamma(size[y])
        pm += digamma(sum(abs(x - v) <= d for v, _ in rows))
    n = len(rows)
    return max(0.0, digamma(n) + (pk - py - pm) / n)


@pytest.mark.parametrize("chunks", [1, 4, 30])
def test_neighbour_mutual_information_equals_the_plain_version(spark, chunks):
    r = random.Random(3)
    rows = []
    for _ in range(260):
        y = r.choice(["a", "a", "b", "c", None])
        rows.append((y, r.gauss({"a": 0, "b": 2}.get(y, 5), 1), float(r.randrange(4)), r.choice([7.0, 7.0, 7.0, r.random()]),
                     r.choice([None, float("nan"), r.random()]), None))
    rows += [("lonely", 1.0, 2.0, 3.0, 4.0, None), ("pair", 1.0, 2.0, 3.0, 4.0, None), ("pair", 1.5, 2.0, 9.0, 4.0, None)]
    cols = ["u", "ties", "hot", "gaps", "none"]
    df = spark.createDataFrame(rows, "y string, u double, ties double, hot double, gaps double, none double")
    got = {r["feature"]: r["mutual_information"] for r in ex.neighbor_mutual_information(df, cols, "y", 3, chunks).collect()}
    for j, c in enumerate(cols, 1):
        want = plain_mi([(row[j], row[0]) for row in rows], 3)
        assert got[c] is None if want is None else got[c] == pytest.approx(want, abs=1e-9), c
    assert got["u"] > 0.3


# ---------------------------------------------------------------- X8 tree attributions

def subset_value(nodes, x, known, boosted, cls):
    """Mean of a tree's output when only the features in ``known`` are given."""
    by = {n["id"]: n for n in nodes}
    cover = (lambda n: n["stats"][0]) if boosted else (lambda n: sum(n["stats"]))

    def walk(n):
        if n["left"] < 0:
            return n["prediction"] if boosted else n["stats"][cls] / cover(n)
        a, b = by[n["left"]], by[n["right"]]
        if n["feature"] in known:
            v = x[n["feature"]]
            left = v <= n["cut"][0] if n["categories"] < 0 else v in n["cut"]
            return walk(a if left else b)
        return (cover(a) * walk(a) + cover(b) * walk(b)) / cover(n)
    return walk(by[0])


def brute_shapley(nodes, x, width, boosted, cls):
    from itertools import combinations
    out = np.zeros(width)
    for j in range(width):
        rest = [k for k in range(width) if k != j]
        for size in range(width):
            w = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for s in combinations(rest, size):
                out[j] += w * (subset_value(nodes, x, {*s, j}, boosted, cls) - subset_value(nodes, x, set(s), boosted, cls))
    return out


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(8)
    rows = []
    for i in range(600):
        a, b, c, g = r.random(), float(r.randrange(5)), r.gauss(0, 1), r.choice("pqrs")
        rows.append((i, a, b, c, g, str(int(a + 0.3 * b * (g in "pr") + 0.4 * c + 0.3 * r.random() > 1))))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, g string, label string").repartition(3)


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_tree_attributions_equal_all_subsets_and_add_up(spark, table, kind, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    from auditora.operators import models as ml
    from auditora.operators import treeshap as ts
    est = {"tree": DecisionTreeClassifier(maxDepth=5, featuresCol="features", labelCol="label_idx"),
           "forest": RandomForestClassifier(numTrees=4, maxDepth=6, seed=3, featuresCol="features", labelCol="label_idx"),
           "boosted": GBTClassifier(maxIter=4, maxDepth=3, seed=3, featuresCol="features", labelCol="label_idx")}[kind]
    m = ml.build_pipeline(table, ["a", "b", "c", "g"], "label", est).fit(table)
    paths = ts.flatten(m, spark)
    got = {}
    for r in ts.tree_shapley(m, table, "id", paths).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["attribution"]
    out = "rawPrediction" if kind == "boosted" else "probability"
    scored = m.transform(table).select("id", vector_to_array(out)[1].alias("f"), vector_to_array("features").alias("x")).collect()
    mean = ts.mean_output(paths)
    assert len(got) == 600 and all(abs(sum(got[r["id"]].values()) + mean - r["f"]) < 1e-9 for r in scored)
    nodes = {}
    for n in ts.node_table(m.stages[-1], spark).collect():
        nodes.setdefault(n["tree"], []).append(n)
    weights = m.stages[-1].treeWeights if kind == "boosted" else [1 / len(nodes)] * len(nodes)
    for r in scored[:12]:
        want = sum(w * brute_shapley(nodes[t], r["x"], 4, kind == "boosted", 1) for t, w in enumerate(weights))
        assert np.allclose([got[r["id"]][f] for f in ("a", "b", "c", "g")], want, atol=1e-9)
    x = np.array([r["x"] for r in scored])
    looked_up = sum(p.attributions(x) for p in paths)
    monkeypatch.setattr(ts, "TABLE_TESTS", 0)
    monkeypatch.setattr(ts, "CELLS", 64)
    assert np.allclose(looked_up, sum(p.attributions(x) for p in paths), atol=1e-12)


def test_tree_attributions_refuse_other_models(spark, table):
    from auditora.operators import models as ml
    from auditora.operators import treeshap as ts
    m = ml.train_models(table, ["a", "b"], "label", which=["logistic_regression"])["logistic_regression"]
    with pytest.raises(ValueError):
        ts.flatten(m, spark)


def test_tree_attributions_look_rows_up(spark, table, monkeypatch):
    """Rows of a model with a small grid are not scored path by path, and large grids give the same."""
    from auditora.operators import models as ml
    from auditora.operators import treeshap as ts
    m = ml.train_models(table, ["a", "b", "c", "g"], "label", which=["random_forest"], trees=6, rf_depth=7)["random_forest"]

    def all_of():
        return {(r["id"], r["feature"]): r["attribution"] for r in ts.tree_shapley(m, table, "id").collect()}

    want = None
    for cells in (0, 1 << 22):
        monkeypatch.setattr(ts, "GRID_CELLS", cells)
        paths = ts.flatten(m, spark)
        grid = ts.grid_of(paths, 4, spark)
        assert (grid is None) == (cells == 0)
        got = all_of()
        assert want is None or (got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want))
        want = got
    x = np.array([[np.nan, 2.0, 0.1, 9.0], [0.5, -1.0, np.inf, -2.0], [-9.0, 0.0, 0.0, 3.0]])
    assert np.allclose(grid.attributions(x), sum(p.attributions(x) for p in paths), atol=1e-12)
