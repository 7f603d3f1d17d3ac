"""Exact Shapley attributions of tree models (X8) from root-to-leaf paths.

A path with value v meets every feature it tests once: o_j says whether the row passes all its tests of
feature j, z_j is the share of training rows (cover) that pass them.  Its expectation given the features in a
set S is v prod_S o prod_not-S z, so feature j's Shapley value is

    v (o_j - z_j) integral_0^1 prod_{k != j} (t o_k + (1 - t) z_k) dt,

a polynomial in t that a Gauss-Legendre rule with half as many nodes as features integrates exactly.  Features
the path does not test have o = z = 1 and change nothing.  Attributions of a row add up to the model's
output minus its mean over the training rows.

The fitted model is written to the scratch folder and read back as a table of nodes, flattened to
arrays of paths (bounded by the size of the model) and sent to the tasks once.

Trees see of a feature only which of the model's cut points or categories a value falls between.  When the
product over the features of (bins + 1) is at most ``GRID_CELLS``, the expectations of all feature sets are one table
with a bin or "not given" for each feature: every path is a product of one vector a feature, so a tree's table is one
matrix product, and the tables of the trees add up.  Rows then look their values up.  Models with more cells are
scored path by path in vectorised batches, rows x paths x tests at a time within a bound.
"""

from __future__ import annotations

import itertools
import math
import operator
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .models import FEATURES, _final, _input_names, label_values

CELLS = 1 << 20  # rows x paths x tests held at a time
TABLE_TESTS = 7  # trees with at most so many tests on a path are looked up by pattern
GRID_CELLS = 1 << 22  # cells of a model's table of expectations (8 bytes each)


def node_table(model, spark) -> DataFrame:
    """(tree, id, left, right, feature, cut, categories, stats, prediction): the nodes of a fitted tree model."""
    folder = getattr(model, "saved_at", None)
    if folder is None:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
        model.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = nodes.withColumn("tree", F.lit(0))
    return nodes.select("tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
                        F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("categories"),
                        F.col("impurityStats").alias("stats"), "prediction")


class Paths:
    """The root-to-leaf paths of one tree as arrays over (path, test)."""

    def __init__(self, nodes: list, weight: float, class_index: int | None, width: int):
        by_id = {n["id"]: n for n in nodes}
        boosted = class_index is None

        def cover(n) -> float:
            return n["stats"][0] if boosted else sum(n["stats"])

        found = []
        todo = [(by_id[0], {})]
        while todo:
            n, tests = todo.pop()
            if n["left"] < 0:
                value = n["prediction"] if boosted else n["stats"][class_index] / (cover(n) or 1.0)
                found.append((weight * value, tests))
                continue
            f, cut, wide = n["feature"], n["cut"], n["categories"]
            for side, child in (("left", by_id[n["left"]]), ("right", by_id[n["right"]])):
                lo, hi, ok, z = tests.get(f, (-np.inf, np.inf, None, 1.0))
                if wide < 0:
                    lo, hi = (lo, min(hi, cut[0])) if side == "left" else (max(lo, cut[0]), hi)
                else:
                    own = np.zeros(wide, bool)
                    own[np.array(cut, int)] = True
                    own = own if side == "left" else ~own
                    ok = own if ok is None else ok & own
                todo.append((child, {**tests, f: (lo, hi, ok, z * cover(child) / (cover(n) or 1.0))}))
        self.value = np.array([v for v, _ in found])
        tests = max([1, *[len(t) for _, t in found]])
        shape = (len(found), tests)
        self.feature, self.z = np.zeros(shape, np.int64), np.ones(shape)
        self.lo, self.hi = np.full(shape, -np.inf), np.full(shape, np.inf)
        sets: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.set_of = np.full(shape, -1)
        for p, (_, own) in enumerate(found):
            for m, (f, (lo, hi, ok, z)) in enumerate(own.items()):
                self.feature[p, m], self.lo[p, m], self.hi[p, m], self.z[p, m] = f, lo, hi, z
                if ok is not None:
                    key = ok.tobytes()
                    if key not in sets:
                        sets[key] = len(self.sets)
                        self.sets.append(ok)
                    self.set_of[p, m] = sets[key]
        self.mean = float((self.value * self.z.prod(1)).sum())
        self.to_feature = np.zeros((shape[0] * shape[1], width))
        self.to_feature[np.arange(shape[0] * shape[1]), self.feature.ravel()] = 1.0
        self.t, self.w = np.polynomial.legendre.leggauss((tests + 1) // 2)
        self.t, self.w = (self.t + 1) / 2, self.w / 2

    def passes(self, x: np.ndarray) -> np.ndarray:
        """Whether every row passes every test (rows, paths, tests)."""
        v = x[:, self.feature]
        ok = ((v <= self.hi) | np.isinf(self.hi)) & ~(v <= self.lo)
        for k, allowed in enumerate(self.sets):
            at = self.set_of == k
            code = v[:, at].astype(np.int64)
            ok[:, at] = np.where((code >= 0) & (code < len(allowed)), allowed[np.clip(code, 0, len(allowed) - 1)], False)
        return ok

    def shares(self, o: np.ndarray) -> np.ndarray:
        """Shapley values of the paths for passed tests ``o`` (.., paths, tests)."""
        total = np.zeros(o.shape)
        for t, w in zip(self.t, self.w):
            factor = t * o + (1 - t) * self.z
            total += w * factor.prod(-1, keepdims=True) / factor
        return total * (o - self.z) * self.value[:, None]

    def attributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.to_feature.shape[1]))
        paths, tests = self.feature.shape
        step = max(1, CELLS // (paths * tests))
        if tests > TABLE_TESTS or len(x) < 1 << tests:
            for lo in range(0, len(x), step):
                o = self.passes(x[lo:lo + step])
                out[lo:lo + step] = self.shares(o.astype(float)).reshape(len(o), -1) @ self.to_feature
            return out
        patterns = (np.arange(1 << tests)[:, None] >> np.arange(tests)) & 1
        table = self.shares(np.repeat(patterns[:, None, :], paths, 1).astype(float)) if (paths << tests) * tests <= 8 * CELLS else None
        for lo in range(0, len(x), step):
            o = self.passes(x[lo:lo + step])
            if table is None:
                shares = self.shares(o.astype(float))
            else:
                shares = table[o @ (1 << np.arange(tests)), np.arange(paths)]
            out[lo:lo + step] = shares.reshape(len(o), -1) @ self.to_feature
        return out


class Grid:
    """Expected output of a model given any set of its features, by the bins of their values; 0 stands for not given."""

    def __init__(self, paths: list[Paths], width: int):
        self.width = width
        cuts: dict[int, list] = {}
        codes: dict[int, int] = {}
        for p in paths:
            for f in range(width):
                at = p.feature == f
                cuts.setdefault(f, []).append(np.unique(np.concatenate([p.lo[at], p.hi[at]])))
                for k in np.unique(p.set_of[at]):
                    if k >= 0:
                        codes[f] = len(p.sets[k])
        found = {f: np.unique(np.concatenate(c)) for f, c in cuts.items()}
        self.cuts = {f: c[np.isfinite(c)] for f, c in found.items()}
        self.codes = codes
        # one bin more for codes outside the categories; features without tests are left out
        bins = {f: codes[f] + 1 if f in codes else len(self.cuts[f]) + 1 for f in range(width) if f in codes or len(self.cuts.get(f, ()))}
        self.features = sorted(bins, key=lambda f: (bins[f], f))
        self.shape = tuple(bins[f] + 1 for f in self.features)
        self.cells = math.prod(self.shape)
        self.strides = [math.prod(self.shape[i + 1:]) for i in range(len(self.shape))]
        self.table: np.ndarray | None = None

    def bins(self, f: int, v: np.ndarray) -> np.ndarray:
        """Bins of the values of a feature, from 1."""
        if f in self.codes:
            n = self.codes[f]
            code = np.where(np.isfinite(v), v, -1).astype(np.int64)
            return np.where((code >= 0) & (code < n), code, n) + 1
        return np.searchsorted(self.cuts[f], v, "left") + 1

    def factor(self, p: Paths, f: int, size: int, part: slice) -> np.ndarray:
        """(paths, size): whether a bin passes a path's tests of a feature; first the share that passes them."""
        out = np.ones((len(p.value[part]), size))
        cells = np.arange(size - 1)
        for m in range(p.feature.shape[1]):
            at = np.flatnonzero(p.feature[part, m] == f)
            if not len(at):
                continue
            lo, hi, z, own = p.lo[part, m][at], p.hi[part, m][at], p.z[part, m][at], p.set_of[part, m][at]
            out[at, 0] *= z
            if f not in self.codes:
                least, last = np.searchsorted(self.cuts[f], lo, "right"), np.searchsorted(self.cuts[f], hi, "left")
                out[at, 1:] *= (cells >= least[:, None]) & (cells <= last[:, None])
                continue
            for k in np.unique(own):
                if k >= 0:
                    out[at[own == k], 1:] *= np.append(p.sets[k], False)
        return out

    def tree(self, p: Paths) -> np.ndarray:
        """One tree's table: sum over its paths of the value times the factors of all features."""
        *left, last = self.features
        wide = self.cells // self.shape[-1]
        out = np.zeros((wide, self.shape[-1]))
        step = max(1, CELLS // (wide + self.shape[-1]))
        for lo in range(0, len(p.value), step):
            part = slice(lo, lo + step)
            a = p.value[part][:, None]
            for f, size in zip(left, self.shape):
                a = (a[:, :, None] * self.factor(p, f, size, part)[:, None, :]).reshape(len(a), -1)
            out += a.T @ self.factor(p, last, self.shape[-1], part)
        return out.ravel()

    def filled(self, paths: list[Paths], spark) -> Grid:
        """This grid with its table, made by tasks over the trees."""
        if not self.features:
            self.table = np.array([sum(p.mean for p in paths)])
            return self
        sc, empty = spark.sparkContext, self
        held = sc.broadcast(paths)
        tasks = min(len(paths), max(1, sc.defaultParallelism))

        def tables(numbers):
            total = np.zeros(empty.cells)
            for t in numbers:
                total += empty.tree(held.value[t])
            yield total

        self.table = sc.parallelize(range(len(paths)), tasks).mapPartitions(tables).treeReduce(operator.add)
        return self

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """The model's outputs for rows of all features (.., width)."""
        at = np.zeros(x.shape[:-1], np.int64)
        for f, stride in zip(self.features, self.strides):
            at += self.bins(f, x[..., f]) * stride
        return self.table[at]

    def attributions(self, x: np.ndarray) -> np.ndarray:
        n = len(self.features)
        sets = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        size = sets.sum(1, keepdims=True)
        fact = [float(math.factorial(k)) for k in range(n + 1)]
        gain = np.array([fact[k - 1] * fact[n - k] / fact[n] if k else 0.0 for k in range(n + 1)])
        loss = np.array([fact[k] * fact[n - k - 1] / fact[n] if k < n else 0.0 for k in range(n + 1)])
        weights = np.where(sets == 1, gain[size], -loss[size])
        out = np.zeros((len(x), self.width))
        step = max(1, CELLS >> n)
        for lo in range(0, len(x), step):
            rows = x[lo:lo + step]
            at = np.zeros((len(rows), 1 << n), np.int64)
            for i, f in enumerate(self.features):
                at += (self.bins(f, rows[:, f]) * self.strides[i])[:, None] * sets[:, i]
            out[lo:lo + step, self.features] = self.table[at] @ weights
        return out


def grid_of(paths: list[Paths], width: int, spark) -> Grid | None:
    """The filled grid of a model, or None where it would have more than ``GRID_CELLS`` cells."""
    grid = Grid(paths, width)
    return grid.filled(paths, spark) if grid.cells <= GRID_CELLS else None


def flatten(model: PipelineModel, spark, class_index: int | None = None) -> list[Paths]:
    """Paths of every tree; values are scaled so that they add up to the model's output.

    Forests and single trees give the probability of a class (the last label by default), boosted trees the margin
    (``rawPrediction`` of the last label).
    """
    m = _final(model)
    if isinstance(m, GBTClassificationModel):
        weights, class_index = list(m.treeWeights), None
    elif isinstance(m, RandomForestClassificationModel):
        weights = [1.0 / m.getNumTrees] * m.getNumTrees
    elif isinstance(m, DecisionTreeClassificationModel):
        weights = [1.0]
    else:
        raise ValueError("tree model required")
    if not isinstance(m, GBTClassificationModel) and class_index is None:
        class_index = len(label_values(model)) - 1
    # the driver holds the rows of a few trees at a time
    nodes = node_table(m, spark).orderBy("tree").toLocalIterator()
    return [Paths(list(own), weights[t], class_index, m.numFeatures) for t, own in itertools.groupby(nodes, operator.itemgetter("tree"))]


def mean_output(paths: list[Paths]) -> float:
    """Mean output of the model over its training rows: what attributions are counted from."""
    return sum(p.mean for p in paths)


def tree_shapley(model: PipelineModel, df: DataFrame, id_col: str, paths: list[Paths] | None = None) -> DataFrame:
    """(id, feature, attribution) of every row of ``df``, exact for the fitted trees.

    A forest's rows add up to its probability of the last label minus ``mean_output``; boosted trees to the margin.
    """
    spark = df.sparkSession
    names = _input_names(model)
    paths = paths if paths is not None else flatten(model, spark)
    grid = grid_of(paths, len(names), spark)
    held = spark.sparkContext.broadcast([grid] if grid is not None else paths)

    def score(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        total = np.zeros(rows.shape)
        for p in held.value:
            total += p.attributions(rows)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names)), pa.array(total.ravel()))

    scored = PipelineModel(model.stages[:-1]).transform(df).select(F.col(id_col), vector_to_array(FEATURES).alias("_x"))
    given = scored.select(id_col, F.arrow_udf(score, "array<double>")("_x").alias("_a"))
    items = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_a").alias("attribution"))
    return given.select(id_col, F.inline(items).alias("feature", "attribution"))
