"""Forests and boosted trees for two classes, trained on counted cells of binned rows.

Tree estimators see of a row only the bins of its features: categories, or at most ``maxBins`` ranges of a number.  Rows
with the same bins are one cell with a count per class, so training data of any length is a table bounded by the bins.
Tasks over the trees hold that table and grow whole trees from it, level by level, with Spark ML's rules: Gini gain or
variance, categories ordered by their centroid, leaves where nothing is gained, siblings of one prediction merged.  A
forest's bag gives every row a Poisson(1) weight; a cell's weights add up to Poisson(count), drawn by tree from a
seeded generator in the order of the cells, so partitioning has no influence.  Boosting has no draws.

The nodes are written in the format of Spark ML's models and loaded as such.  Training data of more than ``CELLS``
cells has no such table (``cell_table`` returns None) and is left to Spark ML's estimators.
"""

from __future__ import annotations

import json
import math
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CELLS = 1 << 22  # cells of the training rows (26 bytes each with five features)
COUNTED_ROWS = 1 << 20  # cell numbers a task holds before it counts them
TREES_A_TASK = 4
EPSILON = 2.0 ** -52
NODES = "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, " \
        "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
TREE_PARAMS = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
               "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed"}


class Cells:
    """Bins by feature, and rows by class, of every cell that holds training rows."""

    def __init__(self, numbers: np.ndarray, counts: list[np.ndarray], cuts: dict[int, np.ndarray], categories: dict[int, int], width: int):
        self.cuts, self.categories, self.width = cuts, categories, width
        self.sizes = sizes_of(cuts, categories, width)
        self.counts = counts
        self.bins: list[np.ndarray] = []
        for size in reversed(self.sizes):
            numbers, own = np.divmod(numbers, size)
            self.bins.insert(0, own.astype(np.uint16))


def sizes_of(cuts: dict[int, np.ndarray], categories: dict[int, int], width: int) -> list[int]:
    return [categories[f] if f in categories else len(cuts[f]) + 1 for f in range(width)]


def candidate_cuts(x: DataFrame, numeric: list[int], max_bins: int) -> dict[int, np.ndarray]:
    """Cut points of the numeric features: between all values where they fit the bins, else quantiles of all rows."""
    if not numeric:
        return {}
    probs = [i / max_bins for i in range(1, max_bins)]
    item = {f: F.get("_x", F.lit(f)) for f in numeric}
    seen = x.agg(*[F.approx_count_distinct(item[f]).alias(f"n{f}") for f in numeric],
                 *[F.percentile_approx(item[f], probs, max(1_000, 10 * max_bins)).alias(f"q{f}") for f in numeric],
                 *[F.max(item[f]).alias(f"m{f}") for f in numeric]).first()
    few = [f for f in numeric if seen[f"n{f}"] <= 2 * max_bins]
    values = x.agg(*[F.collect_set(item[f]).alias(f"v{f}") for f in few]).first() if few else None
    cuts = {}
    for f in numeric:
        v = np.unique(values[f"v{f}"]) if f in few else None
        if v is not None and len(v) <= max_bins:
            cuts[f] = (v[:-1] + v[1:]) / 2
        else:
            q = np.unique(seen[f"q{f}"])
            cuts[f] = q[q < seen[f"m{f}"]]
    return cuts


def cell_table(rows: DataFrame, features: str, label: str, categories: dict[int, int], width: int, max_bins: int) -> Cells | None:
    """The cells of assembled rows with labels 0 and 1, or None where there are more than ``CELLS``."""
    x = rows.select(vector_to_array(features).alias("_x"), F.col(label).cast("int").alias("_y"))
    cuts = candidate_cuts(x, [f for f in range(width) if f not in categories], max_bins)
    sizes = sizes_of(cuts, categories, width)
    if max(sizes) > 1 << 16 or 2 * math.prod(sizes) >= 1 << 62:
        return None

    def numbered(batch: pa.RecordBatch) -> np.ndarray:
        values = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        at = np.zeros(len(values), np.int64)
        for f, size in enumerate(sizes):
            at = at * size + (values[:, f].astype(np.int64) if f in categories else np.searchsorted(cuts[f], values[:, f], "left"))
        return at * 2 + batch.column("_y").to_numpy(zero_copy_only=False)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found >> 1), pa.array(np.where(found & 1, 0, n)), pa.array(np.where(found & 1, n, 0))], ["cell", "n0", "n1"])

    def count(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(numbered(batch))
            if sum(map(len, held)) >= COUNTED_ROWS:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    found = x.mapInArrow(count, "cell long, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    try:
        if found.count() > CELLS:
            return None
        got = found.toArrow()  # bounded by CELLS
    finally:
        found.unpersist()
    cell, n0, n1 = (got.column(c).to_numpy() for c in ("cell", "n0", "n1"))
    order = np.argsort(cell)
    return Cells(cell[order], [n0[order], n1[order]], cuts, categories, width)


# ------------------------------------------------------------------ one tree
def gini(s: np.ndarray) -> np.ndarray:
    n = s[0] + s[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = s[0] / n, s[1] / n
    return np.where(n > 0, 1.0 - a * a - b * b, 0.0)


def variance(s: np.ndarray) -> np.ndarray:
    """Of (count, sum, sum of squares)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[0] > 0, (s[2] - s[1] * s[1] / s[0]) / s[0], 0.0)


class Rules:
    """What a tree is grown by; stats are (class 0, class 1) of a forest, (count, sum, sum of squares) of boosting."""

    def __init__(self, boosted: bool, depth: int, min_rows: int, min_gain: float, subset: int):
        self.boosted, self.depth, self.min_rows, self.min_gain, self.subset = boosted, depth, min_rows, min_gain, subset
        self.impurity = variance if boosted else gini

    def rows(self, s: np.ndarray) -> np.ndarray:
        return s[0] if self.boosted else s[0] + s[1]

    def predict(self, s: np.ndarray) -> np.ndarray:
        if not self.boosted:
            return (s[1] > s[0]).astype(float)
        return s[1] / np.where(s[0] > 0, s[0], 1.0)

    def centroid(self, s: np.ndarray) -> np.ndarray:
        """Order of categories; those without rows come last."""
        return np.where(self.rows(s) > 0, self.predict(s) if self.boosted else s[1], np.inf)


class Tree:
    """A grown tree: arrays over its nodes, level by level; ``at`` is the leaf of every cell (-1 without weight)."""

    def __init__(self, cells: Cells, stats: list[np.ndarray], rules: Rules, rng: np.random.Generator | None):
        self.cells, self.rules = cells, rules
        weight = rules.rows(stats)
        rows = np.flatnonzero(weight > 0)
        whole = len(rows) == len(weight)
        own = stats if whole else [s[rows] for s in stats]
        bins = cells.bins if whole else [b[rows] for b in cells.bins]
        self.at = np.where(weight > 0, 0, -1).astype(np.int32)
        node = np.zeros(len(rows), np.int32)  # of the cells still split, numbered inside the level
        root = np.array([[s.sum()] for s in own], float)
        self.stats, self.impurity = root, rules.impurity(root)
        self.level = np.zeros(1, np.int32)
        self.feature, self.cut = np.full(1, -1, np.int32), np.zeros(1, np.int32)
        self.gain, self.left = np.full(1, -1.0), np.full(1, -1, np.int32)  # the right child follows the left one
        self.allowed: dict[int, np.ndarray] = {}  # categories of left children, in order of their centroids
        active = np.zeros(1, np.int64)
        for depth in range(rules.depth):
            best = self.best_splits(bins, own, node, active, rng)
            gain, feature, cut, left, ranks = best
            split = gain > 0
            if not split.any():
                break
            parents = active[split]
            first = len(self.gain) + 2 * np.arange(len(parents))
            self.gain[parents], self.feature[parents], self.cut[parents], self.left[parents] = gain[split], feature[split], cut[split], first
            child = np.empty((len(self.stats), 2 * len(parents)))
            child[:, 0::2], child[:, 1::2] = left[:, split], self.stats[:, parents] - left[:, split]
            impurity = rules.impurity(child)
            n = child.shape[1]
            self.stats, self.impurity = np.concatenate([self.stats, child], 1), np.concatenate([self.impurity, impurity])
            self.level = np.concatenate([self.level, np.full(n, depth + 1, np.int32)])
            self.feature, self.cut = np.concatenate([self.feature, np.full(n, -1, np.int32)]), np.concatenate([self.cut, np.zeros(n, np.int32)])
            self.gain, self.left = np.concatenate([self.gain, np.full(n, -1.0)]), np.concatenate([self.left, np.full(n, -1, np.int32)])
            # cells of split nodes go to their child, the others stay in leaves
            keep = split[node]
            if not keep.all():
                rows, node, bins, own = rows[keep], node[keep], [b[keep] for b in bins], [s[keep] for s in own]
            of, right = feature[node], np.zeros(len(node), bool)
            for f in np.unique(of):
                here = of == f
                bin_of = bins[f][here]
                place = ranks[f][0][ranks[f][1][node[here]], bin_of] if f in ranks else bin_of
                right[here] = place > cut[node[here]]
            for f, (rank, local) in ranks.items():
                for a in np.flatnonzero(split & (feature == f)):
                    self.allowed[int(active[a])] = np.argsort(rank[local[a]], kind="stable")[:cut[a] + 1]
            number = np.cumsum(split) - 1
            number = (2 * number[node] + right).astype(np.int32)
            self.at[rows] = first[0] + number
            goes_on = np.abs(impurity) >= EPSILON
            if depth + 1 == rules.depth or not goes_on.any():
                break
            active = first[0] + np.flatnonzero(goes_on)
            keep = goes_on[number]
            node = (np.cumsum(goes_on) - 1)[number].astype(np.int32)
            if not keep.all():
                rows, node, bins, own = rows[keep], node[keep], [b[keep] for b in bins], [s[keep] for s in own]

    def best_splits(self, bins, own, node, active, rng):
        """Per active node: gain, feature, last bin (or rank) that goes left, left stats; ranks of categories by feature."""
        rules, cells, m = self.rules, self.cells, len(active)
        gain, feature, cut = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, np.int64)
        left = np.zeros((len(own), m))
        ranks: dict[int, tuple] = {}
        asked = np.ones((m, cells.width), bool)
        if rules.subset < cells.width:
            asked = np.argsort(np.argsort(rng.random((m, cells.width)), 1), 1) < rules.subset
        impurity = self.impurity[active]
        for f, size in enumerate(cells.sizes):
            nodes = np.flatnonzero(asked[:, f])
            if size < 2 or not len(nodes):
                continue
            if len(nodes) == m:
                key, weights, local = node.astype(np.int64) * size + bins[f], own, np.arange(m)
            else:
                local = np.full(m, -1)
                local[nodes] = np.arange(len(nodes))
                here = np.flatnonzero(asked[node, f])
                key, weights = local[node[here]] * size + bins[f][here], [s[here] for s in own]
            h = np.stack([np.bincount(key, s, len(nodes) * size).reshape(len(nodes), size) for s in weights])
            if f in cells.categories:
                order = np.argsort(rules.centroid(h), 1, kind="stable")
                h = np.take_along_axis(h, order[None], 2)
                ranks[f] = np.argsort(order, 1, kind="stable"), local
            low = np.cumsum(h, 2)
            high = low[:, :, -1:] - low[:, :, :-1]
            low = low[:, :, :-1]
            a, b = rules.rows(low), rules.rows(high)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = impurity[nodes][:, None] - a / (a + b) * rules.impurity(low) - b / (a + b) * rules.impurity(high)
            g = np.where((a >= rules.min_rows) & (b >= rules.min_rows) & (g >= rules.min_gain), g, -np.inf)
            k = np.argmax(g, 1)
            g = g[np.arange(len(nodes)), k]
            better = g > gain[nodes]
            who = nodes[better]
            gain[who], feature[who], cut[who] = g[better], f, k[better]
            left[:, who] = low[:, better, k[better]]
        return gain, feature, cut, left, ranks

    def nodes(self) -> pa.StructArray:
        """The nodes as Spark ML saves them: depth first, siblings of one prediction merged."""
        prediction, left, cells = self.rules.predict(self.stats), self.left.copy(), self.cells
        size = np.ones(len(left), np.int64)
        for depth in range(int(self.level.max()) - 1, -1, -1):
            inner = np.flatnonzero((self.level == depth) & (left >= 0))
            a, b = left[inner], left[inner] + 1
            same = (left[a] < 0) & (left[b] < 0) & (prediction[a] == prediction[b])
            prediction[inner[same]] = prediction[a[same]]
            left[inner[same]] = -1
            size[inner] = np.where(same, 1, 1 + size[a] + size[b])
        number = np.full(len(left), -1, np.int64)
        number[0] = 0
        for depth in range(int(self.level.max())):
            inner = np.flatnonzero((self.level == depth) & (left >= 0) & (number >= 0))
            a = left[inner]
            number[a] = number[inner] + 1
            number[a + 1] = number[inner] + 1 + size[a]
        order = np.flatnonzero(number >= 0)
        order = order[np.argsort(number[order])]
        inner = left[order] >= 0
        child = np.where(inner, left[order], 0)
        feature = np.where(inner, self.feature[order], -1)
        cuts, wide = [], np.full(len(order), -1)
        for i, n in enumerate(order):
            f = int(feature[i])
            if f < 0:
                cuts.append([])
            elif f in cells.categories:
                wide[i] = cells.categories[f]
                cuts.append([float(c) for c in self.allowed[int(n)]])
            else:
                cuts.append([float(cells.cuts[f][self.cut[n]])])
        stats = self.stats[:, order].T
        split = pa.StructArray.from_arrays([pa.array(feature, pa.int32()), pa.array(cuts, pa.list_(pa.float64())), pa.array(wide, pa.int32())],
                                           ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        offsets = pa.array(np.arange(len(order) + 1, dtype=np.int32) * stats.shape[1])
        return pa.StructArray.from_arrays(
            [pa.array(number[order], pa.int32()), pa.array(prediction[order]), pa.array(self.impurity[order]), pa.ListArray.from_arrays(offsets, pa.array(stats.ravel())),
             pa.array(self.rules.rows(self.stats[:, order]).astype(np.int64)), pa.array(np.where(inner, self.gain[order], -1.0)),
             pa.array(np.where(inner, number[child], -1), pa.int32()), pa.array(np.where(inner, number[np.minimum(child + 1, len(number) - 1)], -1), pa.int32()), split],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])


def forest_tree(cells: Cells, rules: Rules, seed: int, number: int, bootstrap: bool) -> Tree:
    rng = np.random.default_rng([seed & 0xFFFFFFFF, number])
    weights = [rng.poisson(n) if bootstrap else n for n in cells.counts]
    return Tree(cells, [w.astype(float) for w in weights], rules, rng)


def boosted_trees(cells: Cells, rules: Rules, rounds: int, step: float):
    """The trees of logistic boosting one after the other: residuals 4y / (1 + exp(2yF)) of labels -1 and 1."""
    n0, n1 = (n.astype(float) for n in cells.counts)
    margin = np.zeros(len(n0))
    for t in range(rounds):
        r0, r1 = (-np.ones(len(n0)), np.ones(len(n0))) if t == 0 else (-4.0 / (1.0 + np.exp(-2.0 * margin)), 4.0 / (1.0 + np.exp(2.0 * margin)))
        tree = Tree(cells, [n0 + n1, n0 * r0 + n1 * r1, n0 * r0 * r0 + n1 * r1 * r1], rules, None)
        margin += (1.0 if t == 0 else step) * rules.predict(tree.stats)[tree.at]
        yield tree


# ------------------------------------------------------------------ estimators
def supported(est) -> bool:
    """Whether the settings of an estimator are those the trees here are grown by."""
    if not isinstance(est, (RandomForestClassifier, GBTClassifier)) or est.isDefined("thresholds") or est.isSet("weightCol"):
        return False
    if est.getSubsamplingRate() != 1.0 or est.getMinWeightFractionPerNode() != 0.0:
        return False
    if isinstance(est, GBTClassifier):
        return est.getFeatureSubsetStrategy() == "all" and est.getLossType() == "logistic" and not est.isSet("validationIndicatorCol") and est.getImpurity() == "variance"
    return est.getFeatureSubsetStrategy() in ("auto", "all", "sqrt") and est.getImpurity() == "gini"


def fit(est, cells: Cells, spark):
    """The fitted model of a supported estimator."""
    boosted = isinstance(est, GBTClassifier)
    trees = est.getMaxIter() if boosted else est.getNumTrees()
    strategy = "all" if boosted else est.getFeatureSubsetStrategy()
    narrow = strategy == "sqrt" or strategy == "auto" and trees > 1
    rules = Rules(boosted, est.getMaxDepth(), est.getMinInstancesPerNode(), est.getMinInfoGain(), math.ceil(math.sqrt(cells.width)) if narrow else cells.width)
    seed, bootstrap, step = est.getSeed(), not boosted and est.getBootstrap(), est.getStepSize() if boosted else 1.0
    held = spark.sparkContext.broadcast(cells)

    def grow(batches):
        for batch in batches:
            for t in batch.column("id").to_pylist():
                grown = boosted_trees(held.value, rules, trees, step) if boosted else [forest_tree(held.value, rules, seed, t, bootstrap)]
                for k, tree in enumerate(grown):
                    nodes = tree.nodes()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t + k, np.int32)), nodes], ["treeID", "nodeData"])

    numbers = spark.range(0, 1, 1, 1) if boosted else spark.range(0, trees, 1, -(-trees // TREES_A_TASK))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    numbers.mapInArrow(grow, NODES).write.parquet(f"{folder}/data")
    held.destroy()
    weights = [1.0] + [step] * (trees - 1) if boosted else [1.0] * trees
    tree_class = "regression.DecisionTreeRegressionModel" if boosted else "classification.DecisionTreeClassificationModel"
    own_params = TREE_PARAMS if boosted else TREE_PARAMS | {"probabilityCol", "rawPredictionCol"}
    metadata = [(t, _metadata(est, spark, tree_class, f"tree_{uuid.uuid4().hex[:12]}", own_params, {}), w) for t, w in enumerate(weights)]
    spark.createDataFrame(metadata, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    more = {"numFeatures": cells.width, "numTrees": trees} | ({} if boosted else {"numClasses": 2})
    kind = GBTClassificationModel if boosted else RandomForestClassificationModel
    text = _metadata(est, spark, f"classification.{kind.__name__}", est.uid, None, more)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    model = kind.load(folder)
    model.saved_at = folder  # ``treeshap.node_table`` reads the nodes from there
    return model


def _metadata(est, spark, name: str, uid: str, params: set | None, more: dict) -> str:
    def own(values):
        return {p.name: v for p, v in values.items() if params is None or p.name in params}
    return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                       "paramMap": own(est._paramMap), "defaultParamMap": own(est._defaultParamMap), **more})
