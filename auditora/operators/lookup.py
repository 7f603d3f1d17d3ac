"""Outputs of a fitted tree model by the bins its trees distinguish (X6, X14, scoring).

A model's cut points and categories divide its inputs into cells inside which every tree takes one path.  Where there are
at most ``LOOKUP_CELLS`` of them and more rows to score, tasks over ranges of cells send one row a cell down all
trees, adding the votes in the order Spark ML adds them, and rows look their prediction, probability of the last
label and path length up by the number of their cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUP_ROWS = 1_000_000  # fewer rows are transformed one by one
LOOKUP_CELLS = 1 << 22
BLOCK = 1 << 15  # cells sent down the trees at a time


class Nodes:
    """The nodes of all trees as arrays, a tree after the other; left children follow their parents."""

    def __init__(self, table: pa.Table, width: int, weights: list[float] | None):
        tree = table.column("tree").to_numpy()
        self.starts = np.flatnonzero(np.diff(tree, prepend=-1))
        offset = np.repeat(self.starts, np.diff(np.append(self.starts, len(tree))))
        inner = table.column("left").to_numpy() >= 0
        self.right = np.where(inner, table.column("right").to_numpy() + offset, 0).astype(np.int32)
        self.feature = np.where(inner, table.column("feature").to_numpy(), -1).astype(np.int32)
        wide = table.column("categories").to_numpy()
        number_like = inner & (wide < 0)
        cut = np.where(number_like, table.column("first").to_numpy(zero_copy_only=False), 0.0)
        self.cuts = {f: np.unique(cut[number_like & (self.feature == f)]) for f in range(width)}
        by_category = np.flatnonzero(inner & (wide >= 0))
        self.categories = {int(f): int(wide[by_category][self.feature[by_category] == f].max()) for f in np.unique(self.feature[by_category])}
        self.place = np.full(len(tree), -1, np.int32)  # row of the node's categories in ``goes_left``
        self.place[by_category] = np.arange(len(by_category))
        self.goes_left = np.zeros((max(1, len(by_category)), max([1, *self.categories.values()])), bool)
        codes = table.column("codes").combine_chunks()
        many = np.diff(np.asarray(codes.offsets))[by_category]
        self.goes_left[np.repeat(np.arange(len(by_category)), many), codes.values.to_numpy().astype(int)] = True
        self.last_left = np.zeros(len(tree), np.int32)
        for f in range(width):
            at = number_like & (self.feature == f)
            self.last_left[at] = np.searchsorted(self.cuts[f], cut[at], "left")
        self.weights = weights
        if weights is None:
            stats = table.column("stats").combine_chunks().values.to_numpy().reshape(len(tree), -1)
            if len(self.starts) > 1:  # a forest's trees vote with shares, a single tree with its counts
                total = stats.sum(1, keepdims=True)
                stats = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
            self.votes = stats
        else:
            self.votes = table.column("prediction").to_numpy()[:, None]
        self.sizes = [self.categories.get(f, len(self.cuts[f]) + 1) for f in range(width)]

    def outputs(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prediction, probability of the last label, nodes on the paths of all trees) of cells by number."""
        bins, rest = [], cells
        for size in reversed(self.sizes):
            rest, own = np.divmod(rest, size)
            bins.insert(0, own)
        bins = np.array(bins, np.int32)
        votes, steps = np.zeros((len(cells), self.votes.shape[1])), np.zeros(len(cells), np.int64)
        for t, start in enumerate(self.starts):
            node = np.full(len(cells), start)
            open_ = np.arange(len(cells))
            while True:
                steps[open_] += 1
                own = node[open_]
                f = self.feature[own]
                goes_on = f >= 0
                if not goes_on.all():
                    open_, own, f = open_[goes_on], own[goes_on], f[goes_on]
                    if not len(open_):
                        break
                at, place = bins[f, open_], self.place[own]
                left = at <= self.last_left[own]
                named = place >= 0
                if named.any():
                    left[named] = self.goes_left[place[named], at[named]]
                node[open_] = np.where(left, own + 1, self.right[own])
            votes += self.votes[node] * (1.0 if self.weights is None else self.weights[t])
        if self.weights is not None:
            margin = votes[:, 0]
            return (margin > 0).astype(np.int32), 1.0 / (1.0 + np.exp(-2.0 * margin)), steps
        total = votes[:, 0].copy()
        for k in range(1, votes.shape[1]):
            total += votes[:, k]
        share = np.divide(votes[:, -1], total, out=votes[:, -1].copy(), where=total != 0)
        return np.argmax(votes, 1).astype(np.int32), share, steps


class Lookup:
    """Cells of a model's inputs and their outputs."""

    def __init__(self, nodes: Nodes, trees: int):
        self.cuts, self.categories, self.sizes, self.trees = nodes.cuts, nodes.categories, nodes.sizes, trees
        self.cells = math.prod(self.sizes)
        self.strides = [math.prod(self.sizes[i + 1:]) for i in range(len(self.sizes))]
        self._held = None

    def filled(self, nodes: Nodes, spark) -> Lookup:
        held, cells = spark.sparkContext.broadcast(nodes), self.cells

        def fill(batches):
            for batch in batches:
                for block in batch.column("id").to_pylist():
                    own = np.arange(block * BLOCK, min(cells, (block + 1) * BLOCK))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, *held.value.outputs(own))], ["cell", "prediction", "score", "steps"])

        blocks = -(-cells // BLOCK)
        found = spark.range(0, blocks, 1, blocks).mapInArrow(fill, "cell long, prediction int, score double, steps long").toArrow()  # bounded by LOOKUP_CELLS
        held.destroy()
        order = np.argsort(found.column("cell").to_numpy())
        self.prediction, self.score, self.steps = (found.column(c).to_numpy()[order] for c in ("prediction", "score", "steps"))
        return self

    def held(self, spark):
        """This table as sent to the tasks, once."""
        if self._held is None:
            self._held = spark.sparkContext.broadcast(self)
        return self._held

    def __getstate__(self):
        return {**self.__dict__, "_held": None}

    def numbers(self, x: pa.Array) -> np.ndarray:
        """Cells of rows given as lists of the model's inputs."""
        values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(self.sizes))
        at = np.zeros(len(values), np.int64)
        for f, stride in enumerate(self.strides):
            if f in self.categories:
                own = values[:, f].astype(np.int64)
                if len(own) and (own.min() < 0 or own.max() >= self.sizes[f]):
                    raise ValueError("a category the model does not know")
            else:
                own = np.searchsorted(self.cuts[f], values[:, f], "left")
            at += own * stride
        return at


def lookup_of(model, spark, rows: int) -> Lookup | None:
    """The filled table of a tree model, or None where ``rows`` rows are sooner transformed one by one."""
    from . import treeshap
    from .models import _final
    if rows < LOOKUP_ROWS or not isinstance(model, PipelineModel):
        return None
    m = _final(model)
    if not isinstance(m, (DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel)) or m.isDefined("thresholds"):
        return None
    table = treeshap.node_table(m, spark).select(
        "tree", "left", "right", "feature", "categories", "prediction", "stats", F.get("cut", F.lit(0)).alias("first"),
        F.when((F.col("left") >= 0) & (F.col("categories") >= 0), F.col("cut")).otherwise(F.array().cast("array<double>")).alias("codes"), "id",
    ).orderBy("tree", "id").toArrow()  # bounded by the model
    nodes = Nodes(table, m.numFeatures, list(m.treeWeights) if isinstance(m, GBTClassificationModel) else None)
    del table
    pa.default_memory_pool().release_unused()
    found = Lookup(nodes, len(nodes.starts))
    return found.filled(nodes, spark) if found.cells <= min(LOOKUP_CELLS, rows) else None


def inputs(model: PipelineModel, df: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with the stages before the estimator, and their inputs as a list."""
    from .models import FEATURES
    return PipelineModel(model.stages[:-1]).transform(df), vector_to_array(FEATURES)


def outputs(model: PipelineModel, table: Lookup, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction`` and ``_score``, the probability of the last label, looked up."""
    held = table.held(df.sparkSession)

    def score(x: pa.Array) -> pa.Array:
        at = held.value.numbers(x)
        both = np.column_stack([held.value.prediction[at].astype(float), held.value.score[at]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 2), pa.array(both.ravel()))

    rows, x = inputs(model, df)
    scored = rows.withColumn("_out", F.arrow_udf(score, "array<double>")(x))
    return scored.withColumns({"prediction": F.get("_out", F.lit(0)), "_score": F.get("_out", F.lit(1))}).drop("_out")


def path_nodes(model: PipelineModel, table: Lookup, df: DataFrame) -> DataFrame:
    """(n_nodes, n_rows) partial sums over the rows: nodes on the paths of all trees."""
    held = table.held(df.sparkSession)

    def add(batches):
        for batch in batches:
            at = held.value.numbers(batch.column("_x"))
            yield pa.RecordBatch.from_arrays([pa.array([int(held.value.steps[at].sum())]), pa.array([len(at)])], ["n_nodes", "n_rows"])

    rows, x = inputs(model, df)
    return rows.select(x.alias("_x")).mapInArrow(add, "n_nodes long, n_rows long")


def cell_numbers(model: PipelineModel, table: Lookup, df: DataFrame, keep: list[Column]) -> DataFrame:
    """(``keep``.., _at): the cell of every row."""
    held = table.held(df.sparkSession)
    rows, x = inputs(model, df)
    return rows.select(*keep, F.arrow_udf(lambda v: pa.array(held.value.numbers(v)), "long")(x).cast("int").alias("_at"))


def permuted_hits(table: Lookup, pairs: DataFrame, own: list[int]) -> DataFrame:
    """(f, rep, hits, n) partial counts of rows ``_at`` with label ``_y`` whose input f comes from row ``_donor``; f = -1
    for the rows as they are.  Rows without a label are not counted.  ``own``: the model's inputs by number f."""
    held = table.held(pairs.sparkSession)

    def count(batches):
        for batch in batches:
            held_ = held.value
            known = batch.column("_y").is_valid().to_numpy(zero_copy_only=False)
            at, donor, rep, y = (batch.column(c).to_numpy(zero_copy_only=False)[known].astype(np.int64) for c in ("_at", "_donor", "rep", "_y"))
            if not len(at):
                continue
            n = np.bincount(rep)
            reps = np.flatnonzero(n)
            for f in [-1, *range(len(own))]:
                cell = at
                if f >= 0:
                    stride, size = held_.strides[own[f]], held_.sizes[own[f]]
                    cell = at + (donor // stride % size - at // stride % size) * stride
                hits = np.bincount(rep[held_.prediction[cell] == y], minlength=len(n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), f)), pa.array(reps), pa.array(hits[reps]), pa.array(n[reps])], ["f", "rep", "hits", "n"])

    return pairs.mapInArrow(count, "f long, rep long, hits long, n long").groupBy("f", "rep").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
