"""Neighbour search: recall and cost of the forest, the exact way, SMOTE and Tomek links by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditora.operators import mitigate as mt
from auditora.operators import neighbors as nb

from .conftest import SF_SMALL


def brute(ids, x, k, group=None):
    """{id: [(neighbour, distance)]} by all distances, ties by id."""
    out = {}
    for i, a in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = sorted((d[j], b) for j, b in enumerate(ids) if j != i and (group is None or group[j] == group[i]))
        out[a] = [(b, v) for v, b in near[:k]]
    return out


def found(df, id_col="id"):
    out = {}
    for r in df.orderBy(id_col, "rank").collect():
        out.setdefault(r[id_col], []).append((r["nbr_id"], r["dist"]))
    return out


def recall(got, want):
    return np.mean([len({b for b, _ in got.get(a, ())} & {b for b, _ in near}) / len(near) for a, near in want.items() if near])


@pytest.fixture(scope="module")
def vectors(spark):
    def read(sf):
        e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        p = e.orderBy("vec_id").toPandas()
        return e, p["vec_id"].tolist(), np.array(p["embedding"].tolist(), float), p["label"].tolist()
    return read


def cost(e, **kw):
    cells, _ = nb.projection_cells(nb._base(e, "vec_id", "embedding", None), **kw)
    sizes = cells.groupBy(*nb.CELL_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum(F.col("n") * F.col("n")), F.max("n")).first()


def test_recall_and_cost_grow_with_the_rows(spark, vectors):
    pairs = {}
    for sf in ("sf0.001", "sf0.1"):  # 500 and 2000 rows
        e, ids, x, _ = vectors(sf)
        assert recall(found(nb.knn_graph(e, "vec_id", "embedding", 5), "vec_id"), brute(ids, x, 5)) >= 0.9
        pairs[sf], most = cost(e, cell_rows=64, trees=4, seed=7)
        assert most <= 128
    assert pairs["sf0.1"] <= 1.3 * 4 * pairs["sf0.001"] < 0.3 * 2000 * 2000


def test_exact_way(spark, vectors):
    e, ids, x, labels = vectors("sf0.001")
    for group, own in ((None, None), ("label", labels)):
        got, want = found(nb.exact_knn(e, "vec_id", "embedding", 5, group=group), "vec_id"), brute(ids, x, 5, own)
        assert got.keys() == want.keys()
        for a in want:
            assert [b for b, _ in got[a]] == [b for b, _ in want[a]]
            assert np.allclose([d for _, d in got[a]], [d for _, d in want[a]])


def test_copies_are_split_and_small_groups_exact(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, "hot", [1.0, 2.0, 3.0]) for i in range(700)] + [(1000 + i, "rare", r.normal(size=3).tolist()) for i in range(4)]
    rows += [(2000 + i, "mid", r.normal(size=3).tolist()) for i in range(200)] + [(5000, "alone", [0.0, 0.0, 1.0]), (5001, None, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    cells, parted = nb.projection_cells(nb._base(df, "id", "v", "g"), 64, 3, 1)
    assert parted and cells.groupBy(*nb.CELL_KEYS).count().agg(F.max("count")).first()[0] <= 160
    got = found(nb.knn_graph(df, "id", "v", 5, group="g", cell_rows=64, trees=6, refine=1))
    assert all(len(got[i]) == 5 and all(d == 0 for _, d in got[i]) for i in range(700))
    rare = [x for x in rows if x[1] == "rare"]
    assert {a: [b for b, _ in got[a]] for a in got if 1000 <= a < 2000} == {
        a: [b for b, _ in near] for a, near in brute([x[0] for x in rare], np.array([x[2] for x in rare]), 5).items()}
    mid = [x for x in rows if x[1] == "mid"]
    want = brute([x[0] for x in mid], np.array([x[2] for x in mid]), 5)
    assert recall({a: got[a] for a in want}, want) >= 0.9
    assert 5000 not in got and 5001 not in got


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, g string, v array<double>")
    assert nb.knn_graph(df, "id", "v", 5).count() == 0


def test_tomek_links_are_those_of_brute_force(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (120, 4)), r.normal(1, 1, (60, 4))])
    labels = ["a"] * 120 + ["b"] * 60
    df = spark.createDataFrame([(f"r{i:03d}", labels[i], x[i].tolist()) for i in range(180)], "key string, y string, v array<double>")
    ids = [f"r{i:03d}" for i in range(180)]
    near = {a: b[0][0] for a, b in brute(ids, x, 1).items()}
    lab = dict(zip(ids, labels))
    want = {(a, b) for a, b in near.items() if near[b] == a and lab[a] != lab[b]}
    assert len(want) >= 6
    for exact in (False, True):
        assert {(p["a"], p["b"]) for p in mt.tomek_links(df, "key", "v", "y", exact).collect()} == want


def test_smote_tomek_drops_exactly_the_links(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").where("label < 3")
    whole = mt.smote(e, "vec_id", "embedding", "label", k=3).checkpoint(eager=True)
    links = mt.tomek_links(whole, "syn_key", "embedding", "label").collect()
    left = {r["syn_key"] for r in mt.smote_tomek(e, "vec_id", "embedding", "label", k=3).select("syn_key").collect()}
    assert left == {r["syn_key"] for r in whole.select("syn_key").collect()} - {p[c] for p in links for c in "ab"}


def test_smote_neighbours_are_of_the_class(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    label = {r["vec_id"]: r["label"] for r in e.collect()}
    near = {a: {b for b, _ in v} for a, v in found(nb.knn_graph(e, "vec_id", "embedding", 3, group="label"), "vec_id").items()}
    for r in mt.smote(e, "vec_id", "embedding", "label", k=3).where("synthetic = 1").collect():
        a, b, _ = map(int, r["syn_key"].split(":"))
        assert label[a] == label[b] == r["label"] and b in near[a]
