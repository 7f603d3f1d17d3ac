"""Trees grown on counted cells: equal to Spark ML's where nothing is drawn, bags that follow the rows, loaded models."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from auditora.operators import forest
from auditora.operators import models as ml

FEATS = ["a", "b", "g", "h"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(11)
    out = []
    for i in range(3000):
        a, b, g, h = r.randrange(12), round(r.gauss(0, 1), 1), r.choice("pqrst"), r.choice("xyz")
        p = 0.15 + 0.05 * a + 0.15 * (g in "ps") - 0.2 * (b > 0.5) * (h == "x")
        out.append((i, a, b, g, h, str(int(r.random() < p))))
    return spark.createDataFrame(out, "id long, a int, b double, g string, h string, label string").repartition(3).persist()


def structure(model):
    return model.toDebugString.split("\n", 1)[1]


def both(rows, monkeypatch, ests):
    """The same estimators fitted by Spark ML and on cells."""
    monkeypatch.setattr(ml, "estimators", lambda *_, **__: ests)
    plain = ml.train_models(rows, FEATS, "label")
    monkeypatch.setattr(ml, "CELL_ROWS", 1)
    monkeypatch.setattr(ml.Pipeline, "fit", only_encoders(ml.Pipeline.fit))
    return plain, ml.train_models(rows, FEATS, "label")


def only_encoders(fit):
    def checked(self, *args):
        assert not any(forest.supported(s) for s in self.getStages()), "trained by Spark ML"
        return fit(self, *args)
    return checked


def test_trees_without_draws_equal_spark_ml(spark, rows, monkeypatch):
    ests = {"one": RandomForestClassifier(featuresCol=ml.FEATURES, labelCol=ml.LABEL_IDX, numTrees=2, bootstrap=False, maxDepth=8,
                                          featureSubsetStrategy="all", seed=3),
            "boosted": ml.estimators(3000, 2)["gradient_boosting"].setMaxIter(12)}
    plain, cells = both(rows, monkeypatch, ests)
    assert structure(plain["one"].stages[-1]) == structure(cells["one"].stages[-1])
    assert np.allclose(plain["one"].stages[-1].featureImportances.toArray(), cells["one"].stages[-1].featureImportances.toArray(), atol=1e-12)
    for name in ests:
        p, c = (m[name].transform(rows).select("id", ml.vector_to_array("probability")[1].alias("p"), "prediction").orderBy("id").toPandas() for m in (plain, cells))
        assert np.allclose(p["p"], c["p"], atol=1e-9) and (p["prediction"] == c["prediction"]).all()
    assert cells["boosted"].stages[-1].treeWeights == plain["boosted"].stages[-1].treeWeights
    for m in ("leafCol",):
        assert not cells["one"].stages[-1].getOrDefault(m)


def test_forest_on_cells_is_like_spark_ml_and_reproducible(spark, rows, monkeypatch):
    ests = {"random_forest": ml.estimators(3000, 2, trees=60, rf_depth=6)["random_forest"]}
    plain, cells = both(rows, monkeypatch, ests)
    p, c = plain["random_forest"], cells["random_forest"]
    assert p.stages[-1].getNumTrees == c.stages[-1].getNumTrees == 60 and c.stages[-1].getOrDefault("maxDepth") == 6
    assert np.allclose(p.stages[-1].featureImportances.toArray(), c.stages[-1].featureImportances.toArray(), atol=0.04)
    x, y = (m.transform(rows).select("id", ml.vector_to_array("probability")[1].alias("p")).orderBy("id").toPandas()["p"] for m in (p, c))
    assert np.abs(x - y).mean() < 0.02
    again = ml.train_models(rows.repartition(7), FEATS, "label")["random_forest"]
    assert structure(again.stages[-1]) == structure(c.stages[-1])


def test_bags_follow_the_rows_of_a_cell():
    cells = forest.Cells(np.arange(4), [np.array([50, 0, 3, 0]), np.array([0, 40, 0, 7])], {0: np.array([0.5, 1.5, 2.5])}, {}, 1)
    rules = forest.Rules(False, 1, 1, 0.0, 1)
    drawn = np.array([forest.forest_tree(cells, rules, 42, t, True).stats[:, 0] for t in range(800)])
    assert np.allclose(drawn.mean(0), [53, 47], atol=1) and np.allclose(drawn.var(0), [53, 47], rtol=0.2)


def test_many_cells_are_left_to_spark_ml(spark, rows, monkeypatch):
    monkeypatch.setattr(ml, "CELL_ROWS", 1)
    monkeypatch.setattr(forest, "CELLS", 50)
    monkeypatch.setattr(forest, "fit", lambda *_: pytest.fail("grown on cells"))
    m = ml.train_models(rows, FEATS, "label", which=["random_forest"], trees=3, rf_depth=2)["random_forest"]
    assert m.stages[-1].getNumTrees == 3


def test_cells_count_every_row(spark, rows, monkeypatch):
    monkeypatch.setattr(forest, "COUNTED_ROWS", 100)
    enc, cols = ml.encoder_stages(rows, FEATS)
    x = ml.Pipeline(stages=[*enc, ml.StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), ml.VectorAssembler(inputCols=cols, outputCol="f")]).fit(rows).transform(rows)
    cells = forest.cell_table(x, "f", "y", {2: 6, 3: 4}, 4, 320)
    want = {(r["a"], r["b"], r["g"], r["h"]): (r["n0"], r["n1"]) for r in rows.groupBy("a", "b", "g", "h").agg(
        F.count_if(F.col("label") == "0").alias("n0"), F.count_if(F.col("label") == "1").alias("n1")).collect()}
    values = [sorted({k[i] for k in want}) for i in range(4)]
    got = {tuple(values[i][int(c[i])] for i in range(4)): (int(n0), int(n1)) for *c, n0, n1 in zip(*cells.bins, *cells.counts)}
    assert got == want
