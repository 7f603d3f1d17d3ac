"""Model training, comparison and model-based explanations.

Training uses ``pyspark.ml`` pipelines (label indexing, feature assembly, estimator);
scoring and every attribution method are batch ``transform`` jobs over exploded
variants of the rows, aggregated with group-bys.  Randomness comes from hashes of
(row id, seed, ...) so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, GBTClassificationModel, GBTClassifier,
                                       LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import bounded_broadcast, broadcast_if, is_string, long_aggregate, named, unpivot
from ..functions.ranges import ROWS_PER_CHUNK, default_chunks, hash_rank
from . import forest, lookup

FEATURES = "features"
LABEL_IDX = "label_idx"
# Categorical splits are searched per category up to this many; beyond it codes are ordinals.
MAX_CATEGORIES = 256
DICTIONARY_BROADCAST = 1_000_000
SURROGATE_VALUES = 1_000_000
# Training rows of one task: tree estimators keep about 2 KB a row (bag counts and node numbers of 100 trees).
TRAIN_ROWS = 250_000
SURROGATE_BATCH = 2_000  # rows whose perturbations are held at a time
CELL_ROWS = 1_000_000  # training rows from which trees for two classes are grown on counted cells (``forest``)


# ------------------------------------------------------------------ L1
def completeness_gate(df: DataFrame) -> DataFrame:
    """L1: columns that still hold NULLs (count and %); empty when training may proceed."""
    counts = long_aggregate(df, {c: F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns})
    n = df.agg(F.count(F.lit(1)).alias("n"))
    missing = counts.where(F.col("value") > 0).select(F.col("name").alias("feature"), F.col("value").alias("missing_count"))
    return missing.withColumn("missing_pct", F.col("missing_count") * 100.0 / n.select("n").scalar())


def assert_complete(df: DataFrame) -> None:
    """L1: refuse to train while any NULL remains (reads the small per-column report)."""
    bad = completeness_gate(df).collect()
    if bad:
        raise ValueError("missing values remain: " + ", ".join(f"{r['feature']}={r['missing_count']}" for r in bad))


# ------------------------------------------------------------------ L2
def value_codes(df: DataFrame, cols: Sequence[str], chunks: int | None = None) -> DataFrame:
    """L2: (feature, value, code): the distinct values of string columns with codes 0, 1, .. in sorted order.

    Values are cut into ranges over the executors; a value's code is its rank inside its range plus the values
    in the ranges before, so no value list passes the driver or a single task.
    """
    values = unpivot(df, list(cols)).where("value IS NOT NULL").distinct()
    values = values.checkpoint(eager=True)
    n = chunks or default_chunks(values)
    ranged = values.repartitionByRange(n, "feature", "value").withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
    sizes = ranged.groupBy("feature", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("feature", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("feature", "part").orderBy("value")) - 1
    return ranged.withColumn("rank", rank).join(bounded_broadcast(offsets, 1_000_000), ["feature", "part"]).select(
        "feature", "value", (F.col("before") + F.col("rank")).alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, out: dict[str, str], unseen: dict[str, int] | None = None) -> DataFrame:
    """Adds ``out[c]``, the code of column c's value; NULL and unknown values get ``unseen[c]`` (else NULL).

    Each dictionary is joined by value, broadcast only when it is counted to be small.
    """
    for i, (c, name) in enumerate(out.items()):
        own = codes.where(F.col("feature") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        df = df.join(bounded_broadcast(own, DICTIONARY_BROADCAST), named(c) == F.col(f"_v{i}"), "left")
        code = F.col(f"_c{i}") if unseen is None else F.coalesce(F.col(f"_c{i}"), F.lit(unseen[c]))
        kept = [x for x in df.columns if x not in (name, f"_v{i}", f"_c{i}")]
        df = df.select(*[named(x) for x in kept], code.alias(name))
    return df


class CodeModel(Model):
    """Fitted dictionaries as a pipeline stage: adds ``<column>__code`` (double) for every column."""

    def __init__(self, codes: DataFrame, sizes: dict[str, int]):
        super().__init__()
        self.codes, self.sizes = codes, sizes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = with_codes(dataset, self.codes, {c: f"{c}__code" for c in self.sizes}, self.sizes)
        return out.withColumns({f"{c}__code": named(f"{c}__code").cast("double") for c in self.sizes})


class CodeEncoder(Estimator):
    """Pipeline stage that learns ``value_codes`` of columns with many values; unknown values get the next code."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> CodeModel:
        codes = value_codes(dataset, self.columns).checkpoint(eager=True)
        sizes = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
        return CodeModel(codes, {c: sizes.get(c, 0) for c in self.columns})


def encoder_stages(df: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    """L2: encoders with codes in sorted value order for the string features; returns (stages, model input column names).

    Features of at most about ``MAX_CATEGORIES`` values are indexed as nominal; those with more get the
    distributed dictionary and count as ordinals, so their values never reach the driver.
    """
    strings = [c for c in features if is_string(df.schema[c].dataType)]
    wide: list[str] = []
    if strings:
        sizes = df.agg(*[F.approx_count_distinct(named(c), 0.02).alias(f"n{i}") for i, c in enumerate(strings)]).first()
        wide = [c for i, c in enumerate(strings) if sizes[f"n{i}"] * 1.1 + 2 > MAX_CATEGORIES]
    stages: list = [CodeEncoder(wide)] if wide else []
    cols = []
    for c in features:
        if c in strings and c not in wide:
            stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc", handleInvalid="keep"))
        cols.append(f"{c}__code" if c in wide else f"{c}__idx" if c in strings else c)
    return stages, cols


def encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L2: label-encode string columns in place (codes in sorted value order, NULL stays NULL)."""
    strings = [c for c in cols if is_string(df.schema[c].dataType)]
    if not strings:
        return df
    codes = value_codes(df, strings).checkpoint(eager=True)
    out = with_codes(df, codes, {c: f"{c}__code" for c in strings})
    return out.select(*[named(f"{c}__code").cast("int").alias(c) if c in strings else named(c) for c in df.columns])


# ------------------------------------------------------------------ L3 / L4
def _unit_hash(*cols: Column, seed: int) -> Column:
    """Deterministic uniform [0, 1) from a hash of the given columns and the seed."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (F.pmod(h, F.lit(1 << 40)).cast("double")) / float(1 << 40)


def split(df: DataFrame, y: str, id_col: str, test: float = 0.2, seed: int = 42, buckets: int | None = None,
          stratify: bool = True) -> DataFrame:
    """L3: add ``split`` in {train, test}; per class exactly round(test * n_class) rows go to
    test, chosen by a seeded hash of the id (stratified when every class has >= 2 rows).

    Ranks inside a class come from ``hash_rank``: counts per (class, hash bucket) give
    offsets and a window ranks rows within one bucket, so a large class is never one task.
    """
    cls = F.col(y).cast("string") if stratify else F.lit("all")
    base = df.withColumn("_cls", cls)
    if stratify:
        smallest = base.groupBy("_cls").count().agg(F.min("count")).first()[0]
        if smallest is not None and smallest < 2:
            return split(df, y, id_col, test, seed, buckets, stratify=False)
    ranked = hash_rank(base, ["_cls"], [id_col], seed, buckets=buckets, out="_rk", total="_n")
    out = ranked.withColumn("split", F.when(F.col("_rk") < F.round(F.col("_n") * test), "test").otherwise("train"))
    return out.drop("_cls", "_rk", "_n")


def split_report(df: DataFrame, y: str) -> DataFrame:
    """L4: rows per (split, class)."""
    return df.groupBy("split", F.col(y).cast("string").alias("class")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ L5-L7 training
def model_kind(model) -> str:
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(m, LogisticRegressionModel):
        return "linear"
    if isinstance(m, RandomForestClassificationModel):
        return "forest"
    if isinstance(m, GBTClassificationModel):
        return "gbt"
    if isinstance(m, OneVsRestModel):
        return model_kind(m.models[0])
    if isinstance(m, DecisionTreeClassificationModel):
        return "tree"
    return "other"


def estimators(n_train: int, n_classes: int, seed: int = 42, rf_depth: int = 12, trees: int = 100) -> dict:
    """The three estimators with the application's settings.

    Random forest 100 trees (depth bounded, Spark requires it); logistic regression with
    max 1000 iterations and an L2 penalty equal to sklearn's C=1 (regParam = 1/n, no
    standardisation); gradient boosting 100 rounds, step 0.1, depth 3 (one-vs-rest for
    more than two classes).
    """
    # larger node-statistics budget and cached node ids: fewer passes over the data per level
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL_IDX, numTrees=trees, seed=seed, maxDepth=rf_depth,
                                maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL_IDX, maxIter=1000, regParam=1.0 / max(n_train, 1),
                            elasticNetParam=0.0, standardization=False)
    gbt = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL_IDX, maxIter=100, stepSize=0.1, maxDepth=3, seed=seed,
                        cacheNodeIds=True, checkpointInterval=10)
    if n_classes > 2:
        gbt = OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol=LABEL_IDX)
    return {"random_forest": rf, "logistic_regression": lr, "gradient_boosting": gbt}


def build_pipeline(df: DataFrame, features: Sequence[str], label: str, estimator) -> Pipeline:
    """Encoding, label index, assembly and estimator.

    Tree estimators treat an indexed string as nominal, which needs as many bins as values; ``maxBins`` follows.
    A feature with more than ``MAX_CATEGORIES`` values is coded by a distributed dictionary, as an ordinal.
    """
    enc, cols = encoder_stages(df, features)
    if any(c.endswith("__idx") for c in cols) and estimator.__class__ is not LogisticRegression:
        tree = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
        tree.setMaxBins(MAX_CATEGORIES + 64)
    lab = StringIndexer(inputCol=label, outputCol=LABEL_IDX, stringOrderType="alphabetAsc")
    asm = VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="error")
    return Pipeline(stages=[*enc, lab, asm, estimator])


def train_models(df: DataFrame, features: Sequence[str], label: str, which: Sequence[str] | None = None,
                 seed: int = 42, **kw) -> dict[str, PipelineModel]:
    """Fit the selected estimators on the ``train`` split (rows where split = 'train')."""
    train = df.where(F.col("split") == "train") if "split" in df.columns else df
    # estimators read their input several times (metadata, split candidates, passes); keep the
    # prepared rows instead of recomputing the split each time (recomputed if a block is lost)
    train = train.persist()
    try:
        stats = train.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).first()
        ests = estimators(stats["n"], stats["k"], seed, **kw)
        names = list(which) if which else list(ests)
        models = _fit_on_cells(train, features, label, {n: ests[n] for n in names}, stats["n"]) if stats["n"] >= CELL_ROWS and stats["k"] == 2 else {}
        rest = [n for n in names if n not in models]
        parts = -(-stats["n"] // TRAIN_ROWS)
        if rest and parts > train.rdd.getNumPartitions():
            # estimators work in the partitions given, which are sized for the few bytes of a plain row
            spread = train.repartition(parts).persist()
            spread.count()
            train.unpersist()
            train = spread
        models.update({n: build_pipeline(train, features, label, ests[n]).fit(train) for n in rest})
        return {n: models[n] for n in names}
    finally:
        train.unpersist()


def _fit_on_cells(train: DataFrame, features: Sequence[str], label: str, ests: dict, n: int) -> dict[str, PipelineModel]:
    """The models of ``ests`` on one set of encoders, trees grown on one table of counted cells; trees whose table
    does not fit are left out."""
    tree = next((e for e in ests.values() if forest.supported(e)), None)
    if tree is None:
        return {}
    stages = build_pipeline(train, features, label, tree).getStages()
    prepared = Pipeline(stages=stages[:-1]).fit(train)
    rows = prepared.transform(train)
    asked = prepared.stages[-1].getInputCols()
    indexed = {s.getOutputCol(): len(s.labels) + 1 for s in prepared.stages if s.__class__.__name__ == "StringIndexerModel"}  # and one for the others
    categories = {f: indexed[c] for f, c in enumerate(asked) if c in indexed}
    models, tables = {}, {}
    for name, est in ests.items():
        if forest.supported(est):
            if categories:
                est.setMaxBins(tree.getMaxBins())
            max_bins = min(est.getMaxBins(), n)
            if max_bins not in tables:
                tables[max_bins] = forest.cell_table(rows, FEATURES, LABEL_IDX, categories, len(asked), max_bins)
            if tables[max_bins] is None:
                continue
            last = forest.fit(est, tables[max_bins], train.sparkSession)
        elif isinstance(est, LogisticRegression):
            last = est.fit(rows)
        else:
            continue
        models[name] = PipelineModel([*prepared.stages, last])
    return models


def label_values(model: PipelineModel) -> list[str]:
    idx = [s for s in model.stages if getattr(s, "getOutputCol", lambda: None)() == LABEL_IDX][0]
    return list(idx.labels)


def predictions(models: dict[str, PipelineModel], df: DataFrame, id_col: str, label: str,
                keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions (model, id, label, prediction, score, keep...) for the test split.

    ``prediction`` is mapped back to the original label value (as string); ``score`` is the
    probability of the last label value (the positive class for two labels), when available.
    """
    test = df.where(F.col("split") == "test") if "split" in df.columns else df
    parts = []
    n_rows = test.count()
    for name, m in models.items():
        labels = label_values(m)
        lab_arr = F.array(*[F.lit(v) for v in labels])
        table = lookup.lookup_of(m, df.sparkSession, n_rows)
        if table is not None:
            t = lookup.outputs(m, table, test)
            parts.append(t.select(F.lit(name).alias("model"), F.col(id_col), F.col(label).cast("string").alias("y"),
                                  F.element_at(lab_arr, F.col("prediction").cast("int") + 1).alias("prediction"), F.col("_score").alias("score"), *keep))
            continue
        t = m.transform(test)
        score = (vector_to_array("probability")[len(labels) - 1] if "probability" in t.columns
                 else F.lit(None).cast("double"))
        parts.append(t.select(F.lit(name).alias("model"), F.col(id_col), F.col(label).cast("string").alias("y"),
                              F.element_at(lab_arr, F.col("prediction").cast("int") + 1).alias("prediction"),
                              score.alias("score"), *keep))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ L8
def compare_models(preds: DataFrame) -> DataFrame:
    """Accuracy per model, single-class warning, rank (accuracy desc, name) and best flag."""
    a = preds.groupBy("model").agg(F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("accuracy"),
                                   F.count_distinct("prediction").alias("n_predicted_classes"),
                                   F.count("*").alias("n"))
    w = Window.orderBy(F.desc("accuracy"), "model")  # one row per model
    return a.withColumn("single_class_warning", (F.col("n_predicted_classes") == 1).cast("int")).withColumn(
        "rank", F.row_number().over(w)).withColumn("best", (F.col("rank") == 1).cast("int"))


# ------------------------------------------------------------------ X4 / X5 / X13
def _final(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def _input_names(model: PipelineModel) -> list[str]:
    asm = [s for s in model.stages if s.__class__.__name__ == "VectorAssembler"][0]
    return [c[:-5] if c.endswith("__idx") else c[:-6] if c.endswith("__code") else c for c in asm.getInputCols()]


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Built-in importances (trees) or |coefficients| (linear), ranked."""
    m = _final(model)
    names = _input_names(model)
    if isinstance(m, (RandomForestClassificationModel, GBTClassificationModel, DecisionTreeClassificationModel)):
        vals, method = m.featureImportances.toArray(), "model_builtin"
    elif isinstance(m, LogisticRegressionModel):
        coef = m.coefficientMatrix.toArray()
        vals, method = np.abs(coef[0] if coef.shape[0] == 1 else coef).reshape(-1)[: len(names)], "coefficient_magnitude"
        if coef.shape[0] > 1:
            vals = np.abs(coef).mean(axis=0)
    elif isinstance(m, OneVsRestModel):
        vals = np.mean([sub.featureImportances.toArray() for sub in m.models], axis=0)
        method = "model_builtin"
    else:
        raise ValueError("model has no built-in importance")
    rows = [(n, float(v), method) for n, v in zip(names, vals)]
    imp = spark.createDataFrame(rows, "feature string, importance double, method string")
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def model_complexity(model: PipelineModel, spark) -> DataFrame:
    """Parameter or feature count, number of estimators and maximum depth (1 row)."""
    m = _final(model)
    n_params = n_features = n_est = depth = None
    if isinstance(m, LogisticRegressionModel):
        n_params = int(m.coefficientMatrix.numRows * m.coefficientMatrix.numCols)
    elif isinstance(m, RandomForestClassificationModel):
        n_features, n_est, depth = m.numFeatures, m.getNumTrees, m.getOrDefault("maxDepth")
    elif isinstance(m, GBTClassificationModel):
        n_features, n_est, depth = m.numFeatures, m.getNumTrees, m.getOrDefault("maxDepth")
    elif isinstance(m, OneVsRestModel):
        sub = m.models[0]
        n_features, n_est, depth = sub.numFeatures, sub.getNumTrees, sub.getOrDefault("maxDepth")
    elif isinstance(m, DecisionTreeClassificationModel):
        n_features, depth = m.numFeatures, m.depth
    return spark.createDataFrame([(model_kind(model), n_params, n_features, n_est, depth)],
                                 "model_kind string, n_parameters int, n_features int, n_estimators int, max_depth int")


# ------------------------------------------------------------------ X14 decision path length
def leaf_depths(model) -> list[list[int]]:
    """Per tree, the depths of its leaves in the order ``leafCol`` numbers them (depth first,
    left before right), read from the model's debug string in one call: each level of
    the printed tree is indented by one more space and ``If`` precedes ``Else``."""
    trees: list[list[int]] = []
    base = None
    for line in model.toDebugString.splitlines():
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if body.startswith("Tree "):
            trees.append([])
            base = None
            continue
        if body.startswith(("If ", "Else ", "Predict")):
            if not trees:
                trees.append([])
            if base is None:
                base = indent
            if body.startswith("Predict"):
                trees[-1].append(indent - base)
    return trees


def avg_path_length(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Mean number of nodes on each row's decision path (depth of its leaf + 1), averaged
    over the trees of a forest; one scoring pass with ``leafCol``."""
    m = _final(model)
    if not isinstance(m, (DecisionTreeClassificationModel, RandomForestClassificationModel, GBTClassificationModel)):
        raise ValueError("decision paths exist for tree models only")
    table = lookup.lookup_of(model, df.sparkSession, df.count())
    if table is not None:
        total = lookup.path_nodes(model, table, df).agg(F.sum("n_nodes").alias("nodes"), (F.sum("n_rows") * table.trees).alias("n_paths"))
        return total.select((F.col("nodes") / F.col("n_paths")).alias("avg_decision_path_length"), "n_paths")
    m.setLeafCol("_leaves")
    depth_rows = [(t, i, d + 1) for t, depths in enumerate(leaf_depths(m)) for i, d in enumerate(depths)]
    spark = df.sparkSession
    depths = spark.createDataFrame(depth_rows, "tree int, leaf int, path_len int")  # bounded by the model size
    scored = model.transform(df)
    leaves = F.col("_leaves")
    lt = scored.schema["_leaves"].dataType
    arr = (leaves if isinstance(lt, T.ArrayType) else F.array(leaves) if isinstance(lt, T.NumericType)
           else vector_to_array(leaves))
    long = scored.select(F.posexplode(arr).alias("tree", "leaf")).select(F.col("tree").cast("int"), F.col("leaf").cast("int"))
    m.setLeafCol("")
    j = long.join(broadcast_if(depths, len(depth_rows)), ["tree", "leaf"])  # one row per leaf of the model
    return j.agg(F.avg("path_len").alias("avg_decision_path_length"), F.count("*").alias("n_paths"))


# ------------------------------------------------------------------ X6 permutation importance
def _positive_prob(model: PipelineModel, df: DataFrame) -> Column:
    return vector_to_array("probability")[len(label_values(model)) - 1]


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, id_col: str,
                           repeats: int = 10, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Mean and std of the accuracy drop when one feature's values are permuted.

    One seeded permutation per repeat serves all features: each row is paired with the row of
    the same rank under a second hash order, inside buckets of about ROWS_PER_CHUNK rows (one
    bucket for all rows of a smaller table).  The pairs are exploded to one variant per feature
    without another shuffle, scored in one ``transform``, and aggregated.  Where a tree model's outputs fit a table
    (``lookup``), rows travel as the numbers of their cells and variants are looked up.
    """
    feats = list(features)
    labels = label_values(model)
    lab_arr = F.array(*[F.lit(v) for v in labels])
    base = df.select(id_col, label, *feats)
    n_rows = base.count()
    if buckets is None:  # each (feature, repeat, bucket) window holds about ROWS_PER_CHUNK rows
        buckets = max(1, -(-n_rows // ROWS_PER_CHUNK))
    table = lookup.lookup_of(model, df.sparkSession, n_rows * repeats * len(feats))
    row = F.struct(*feats)
    if table is not None:
        y = F.array_position(lab_arr, F.col(label).cast("string")).cast("int") - 1
        base = lookup.cell_numbers(model, table, base, [F.col(id_col), y.alias("_y")]).checkpoint(eager=True)
        row = F.col("_at")
    ex = base.select("*", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("rep"))
    ex = ex.withColumn("_bk", F.pmod(F.xxhash64(F.col(id_col), "rep", F.lit(seed)), F.lit(buckets)))
    w1 = Window.partitionBy("rep", "_bk").orderBy(F.xxhash64(F.col(id_col), "rep", F.lit(seed + 1)), id_col)
    w2 = Window.partitionBy("rep", "_bk").orderBy(F.xxhash64(F.col(id_col), "rep", F.lit(seed + 2)), id_col)
    recv = ex.withColumn("_pos", F.row_number().over(w1))
    donor = ex.select("rep", "_bk", F.row_number().over(w2).alias("_pos"), row.alias("_donor"))
    if table is not None:
        names = _input_names(model)
        pairs = recv.drop(id_col).join(donor, ["rep", "_bk", "_pos"]).select("rep", "_at", "_donor", "_y")
        hits = lookup.permuted_hits(table, pairs, [names.index(f) for f in feats]).checkpoint(eager=True)  # one row per feature and repeat
        acc = hits.where("f >= 0").select(F.get(F.array(*[F.lit(f) for f in feats]), F.col("f").cast("int")).alias("pf"), "rep", (F.col("hits") / F.col("n")).alias("acc"))
        b = hits.where("f < 0").agg((F.sum("hits") / F.sum("n")).alias("b"))
    else:
        j = recv.join(donor, ["rep", "_bk", "_pos"]).select("*", F.explode(F.array(*[F.lit(f) for f in feats])).alias("pf"))
        permuted = j.select(id_col, label, "pf", "rep", *[
            F.when(F.col("pf") == f, F.col("_donor")[f]).otherwise(F.col(f)).alias(f) for f in feats])
        scored = model.transform(permuted)
        pred = F.element_at(lab_arr, F.col("prediction").cast("int") + 1)
        acc = scored.groupBy("pf", "rep").agg(F.avg((pred == F.col(label).cast("string")).cast("double")).alias("acc"))
        b = model.transform(base).agg(F.avg((pred == F.col(label).cast("string")).cast("double")).alias("b"))
    drops = acc.withColumn("drop", b.select("b").scalar() - F.col("acc"))
    out = drops.groupBy(F.col("pf").alias("feature")).agg(F.avg("drop").alias("importance_mean"),
                                                          F.stddev_pop("drop").alias("importance_std"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance_mean"), "feature")))


# ------------------------------------------------------------------ X7 linear attributions
def linear_attributions(df: DataFrame, coefficients: dict[str, float], id_col: str) -> DataFrame:
    """Closed-form attributions of a linear model, coef_j * (x_j - mean(x_j)), for every
    row; means are one aggregate (scalar subqueries).  Long output (id, feature, attribution)."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in coefficients])
    items = F.array(*[F.struct(F.lit(c).alias("feature"),
                               (F.lit(float(w)) * (F.col(c).cast("double") - means.select(c).scalar())).alias("attribution"))
                      for c, w in coefficients.items()])
    return df.select(id_col, F.inline(items))


def linear_model_coefficients(model: PipelineModel) -> dict[str, float]:
    m = _final(model)
    if not isinstance(m, LogisticRegressionModel):
        raise ValueError("linear model required")
    return dict(zip(_input_names(model), m.coefficientMatrix.toArray()[-1].tolist()))


def encoded_view(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The model's numeric input columns (string features replaced by their codes)."""
    out = df
    for s in model.stages:
        if isinstance(s, CodeModel):
            out = s.transform(out)
            for c in s.sizes:
                out = out.withColumn(c, named(f"{c}__code")).drop(f"{c}__code")
        elif s.__class__.__name__ == "StringIndexerModel" and s.getOutputCol() != LABEL_IDX:
            out = s.transform(out)
            out = out.withColumn(s.getInputCol(), F.col(s.getOutputCol())).drop(s.getOutputCol())
    return out


# ------------------------------------------------------------------ X8 Monte-Carlo Shapley
def shapley_sampling(model: PipelineModel, df: DataFrame, background: DataFrame, features: Sequence[str],
                     id_col: str, permutations: int = 8, seed: int = 42) -> DataFrame:
    """Monte-Carlo Shapley values of the positive-class probability for every row.

    For each row and permutation p (seeded, shared by all rows) a background row is chosen
    by hash; F+1 hybrid rows switch features one at a time from the background to the row
    along the permutation; one ``transform`` scores all hybrids, and the difference of
    consecutive scores is the feature's marginal contribution.  Per row the values add
    up to f(x) - mean_p f(b_p).  The background may have any size: rows meet it by an equi-join
    on its number, broadcast when it is small.  A hybrid's score counts for the feature just
    added and against the next one, so contributions are summed without ordering the hybrids.
    """
    feats = list(features)
    nb = background.count()
    if nb == 0:
        raise ValueError("background must hold rows")
    rng = np.random.default_rng(seed)
    perms = [list(rng.permutation(len(feats))) for _ in range(permutations)]
    # numbers 0 .. nb - 1 by a distributed hash rank; equal rows are interchangeable
    bg = hash_rank(background.select(*feats), [], feats, seed, out="_bi", total="_bn")
    bg = bounded_broadcast(bg.select("_bi", *[F.col(f).alias(f"_b_{f}") for f in feats]), 100_000)
    steps = []
    for p, order in enumerate(perms):
        for k in range(len(feats) + 1):
            on = {feats[i] for i in order[:k]}
            added = feats[order[k - 1]] if k > 0 else None
            following = feats[order[k]] if k < len(feats) else None
            steps.append(F.struct(F.lit(p).alias("_p"), F.lit(added).cast("string").alias("_f"), F.lit(following).cast("string").alias("_g"),
                                  F.array(*[F.lit(f in on) for f in feats]).alias("_on")))
    rows = df.select(id_col, *feats).withColumn("_s", F.explode(F.array(*steps))).select(id_col, *feats, "_s.*")
    rows = rows.withColumn("_bi", F.pmod(F.xxhash64(F.col(id_col), F.col("_p"), F.lit(seed)), F.lit(nb)))
    j = rows.join(bg, "_bi")
    hybrid = j.select(id_col, "_p", "_f", "_g", *[
        F.when(F.col("_on")[i], F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f) for i, f in enumerate(feats)])
    scored = model.transform(hybrid).select(id_col, "_p", "_f", "_g", _positive_prob(model, hybrid).alias("_fx"))
    signed = scored.select(id_col, "_p", F.inline(F.array(F.struct(F.col("_f").alias("feature"), F.col("_fx").alias("_d")),
                                                          F.struct(F.col("_g").alias("feature"), (-F.col("_fx")).alias("_d")))))
    # one exchange by row serves both sums
    one = signed.where(F.col("feature").isNotNull()).repartition(F.col(id_col)).groupBy(id_col, "feature", "_p").agg(F.sum("_d").alias("_d"))
    return one.groupBy(id_col, "feature").agg(F.avg("_d").alias("attribution"), (F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)))).alias("std_error"))


# ------------------------------------------------------------------ X12 local surrogate
def local_surrogate(model: PipelineModel, df: DataFrame, features: Sequence[str], id_col: str, samples: int = 64,
                    kernel_width: float | None = None, ridge: float = 1e-3, seed: int = 42) -> DataFrame:
    """Per-row weighted linear surrogate of the positive-class probability (batch LIME).

    Numeric features are perturbed with Gaussian noise scaled by each feature's standard deviation; string
    features are drawn from their column's frequencies, and the surrogate sees whether the draw is
    the row's own value (NULL is a value).  All draws come from hashes of the row, sample and feature.  The kernel weight is
    exp(-d^2 / w^2) on the standardised distance, a changed string counting 1.  Weighted normal equations
    are summed per row with one group-by, and the small (F+1)x(F+1) systems are solved in Arrow batches.
    Forests and trees whose table of outputs fits (``treeshap.Grid``) score the samples where they are drawn, a batch of
    rows at a time, and only the sums of each row leave the task; other models score one exploded row a sample.
    Returns (id, feature, weight) plus the intercept as feature '_intercept'.  Frequencies are held by the tasks,
    so a string feature may have at most ``SURROGATE_VALUES`` values.
    """
    feats = list(features)
    nf = len(feats)
    width = kernel_width or 0.75 * np.sqrt(nf)
    strings = [f for f in feats if is_string(df.schema[f].dataType)]
    numeric = [f for f in feats if f not in strings]
    sds = {f: 1.0 for f in feats}
    if numeric:
        sd = df.agg(*[F.stddev_samp(named(f).cast("double")).alias(f"s{i}") for i, f in enumerate(numeric)]).first()
        sds.update({f: sd[f"s{i}"] or 1.0 for i, f in enumerate(numeric)})
    tables = {}
    for f in strings:
        freq = df.groupBy(named(f).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("v")).limit(SURROGATE_VALUES + 1).collect()
        if len(freq) > SURROGATE_VALUES:
            raise ValueError(f"{f} has more than {SURROGATE_VALUES} values")
        cum = np.cumsum([r["n"] for r in freq], dtype=float)
        tables[f] = (cum / cum[-1] if len(cum) else cum, [r["v"] for r in freq])
    grid = _surrogate_grid(model, df.sparkSession)
    if grid is not None:
        ne = _grid_sums(model, grid, df, feats, strings, id_col, sds, tables, samples, width, seed)
        return _solved_surrogates(ne, feats, sds, ridge, id_col, df.schema[id_col].dataType.simpleString())
    held = df.sparkSession.sparkContext.broadcast(tables)

    def drawn(f: str):
        def pick(u: pd.Series) -> pd.Series:
            cum, values = held.value[f]
            at = np.minimum(np.searchsorted(cum, u.to_numpy(), "right"), len(values) - 1)
            return pd.Series([values[i] for i in at], dtype=object)
        return F.pandas_udf(pick, "string")

    idx = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_s")
    base = df.select(id_col, *[(named(f) if f in strings else named(f).cast("double")).alias(f) for f in feats]).select("*", idx)

    def unit(f_i: int, part: int) -> Column:
        return _unit_hash(F.col(id_col), F.col("_s"), F.lit(f_i), F.lit(part), seed=seed)

    def normal(f_i: int) -> Column:  # Box-Muller from two hash uniforms
        return F.sqrt(-2 * F.log(unit(f_i, 1) + 1e-12)) * F.cos(2 * np.pi * unit(f_i, 2))

    own = F.col("_s") == 0  # the first sample is the row itself
    shift = {f: F.when(own, F.lit(0.0)).otherwise(normal(i)) for i, f in enumerate(feats) if f in numeric}
    draws = base.select(id_col, "_s", *[F.when(own, named(f)).otherwise(drawn(f)(unit(i, 1))).alias(f) if f in strings
                                        else (named(f) + shift[f] * sds[f]).alias(f) for i, f in enumerate(feats)],
                        *[named(f).alias(f"_own_{f}") if f in strings else shift[f].alias(f"_z_{f}") for f in feats])
    pert = draws.select(id_col, *[named(f) for f in feats], *[named(f).eqNullSafe(named(f"_own_{f}")).cast("double").alias(f"_z_{f}") if f in strings
                                                              else named(f"_z_{f}") for f in feats])
    scored = model.transform(pert).select(id_col, *[named(f"_z_{f}") for f in feats], _positive_prob(model, pert).alias("_y"))
    d2 = sum(((1 - named(f"_z_{f}")) if f in strings else named(f"_z_{f}") * named(f"_z_{f}") for f in feats), F.lit(0.0))
    wgt = F.exp(-d2 / (width * width))
    xs = [F.lit(1.0)] + [named(f"_z_{f}") for f in feats]
    sums = [F.sum(wgt * xs[a] * xs[b]).alias(f"a_{a}_{b}") for a in range(nf + 1) for b in range(a, nf + 1)]
    sums += [F.sum(wgt * xs[a] * F.col("_y")).alias(f"b_{a}") for a in range(nf + 1)]
    ne = scored.groupBy(id_col).agg(*sums)
    return _solved_surrogates(ne, feats, sds, ridge, id_col, df.schema[id_col].dataType.simpleString())


def _surrogate_grid(model, spark):
    """The table of a forest's or tree's positive-class probability, or None where the samples must be transformed."""
    from . import treeshap
    if not isinstance(model, PipelineModel) or any(isinstance(s, CodeModel) for s in model.stages):
        return None
    m = _final(model)
    if not isinstance(m, (RandomForestClassificationModel, DecisionTreeClassificationModel)):
        return None
    return treeshap.grid_of(treeshap.flatten(model, spark), m.numFeatures, spark)


def _grid_sums(model: PipelineModel, grid, df: DataFrame, feats: list[str], strings: list[str], id_col: str, sds: dict, tables: dict,
               samples: int, width: float, seed: int) -> DataFrame:
    """(id, a_i_j.., b_i..): the surrogates' weighted normal equations, samples drawn and scored in batches of rows."""
    nf = len(feats)
    coded = {}  # string feature -> model code of each value of its table
    for s in model.stages:
        if s.__class__.__name__ == "StringIndexerModel" and s.getInputCol() in strings:
            known = {v: float(i) for i, v in enumerate(s.labels)}
            coded[s.getInputCol()] = np.array([known.get(v, float(len(known))) for v in tables[s.getInputCol()][1]])
    order = [feats.index(f) for f in _input_names(model)]
    held = df.sparkSession.sparkContext.broadcast((grid, {f: (tables[f][0], {v: i for i, v in enumerate(tables[f][1])}, coded[f]) for f in strings}))

    def units(f_i: int, part: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: _unit_hash(F.col("_id"), s, F.lit(f_i), F.lit(part), seed=seed))

    base = df.select(named(id_col).alias("_id"), *[(named(f) if f in strings else named(f).cast("double")).alias(f"_x{i}") for i, f in enumerate(feats)])
    parts = {i: (1,) if f in strings else (1, 2) for i, f in enumerate(feats)}
    asked = base.select("*", *[units(i, part).alias(f"_u{i}_{part}") for i, own in parts.items() for part in own])
    pairs = [(a, b) for a in range(nf + 1) for b in range(a, nf + 1)]

    def batch_sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        lookup, texts = held.value
        n = batch.num_rows

        def drawn(i: int, part: int) -> np.ndarray:
            return batch.column(f"_u{i}_{part}").flatten().to_numpy(zero_copy_only=False).reshape(n, samples)

        x, z, far = np.empty((n, samples, nf)), np.ones((n, samples, nf + 1)), np.zeros((n, samples))
        for i, f in enumerate(feats):
            if f in strings:
                cum, number, codes = texts[f]
                own = np.array([number[v] for v in batch.column(f"_x{i}").to_pylist()])
                at = np.minimum(np.searchsorted(cum, drawn(i, 1), "right"), len(cum) - 1)
                at[:, 0] = own  # the first sample is the row itself
                x[:, :, i], z[:, :, i + 1] = codes[at], at == own[:, None]
                far += 1 - z[:, :, i + 1]
            else:
                shift = np.sqrt(-2 * np.log(drawn(i, 1) + 1e-12)) * np.cos(2 * np.pi * drawn(i, 2))
                shift[:, 0] = 0.0
                own = batch.column(f"_x{i}").to_numpy(zero_copy_only=False)
                if np.isnan(own).any():
                    raise ValueError(f"{f} holds NULL or NaN")
                x[:, :, i], z[:, :, i + 1] = own[:, None] + shift * sds[f], shift
                far += shift * shift
        y = lookup.outputs(x[:, :, order])
        weighted = z * np.exp(-far / (width * width))[:, :, None]
        left = np.matmul(weighted.transpose(0, 2, 1), z)
        right = np.matmul(weighted.transpose(0, 2, 1), y[:, :, None])[:, :, 0]
        return pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(left[:, a, b]) for a, b in pairs], *[pa.array(right[:, a]) for a in range(nf + 1)]],
                                          ["_id", *[f"a_{a}_{b}" for a, b in pairs], *[f"b_{a}" for a in range(nf + 1)]])

    def sums(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SURROGATE_BATCH):
                yield batch_sums(batch.slice(lo, SURROGATE_BATCH))

    cols = [f"a_{a}_{b}" for a, b in pairs] + [f"b_{a}" for a in range(nf + 1)]
    per_row = asked.mapInArrow(sums, T.StructType([T.StructField("_id", df.schema[id_col].dataType), *[T.StructField(c, T.DoubleType()) for c in cols]]))
    return per_row.groupBy(F.col("_id").alias(id_col)).agg(*[F.sum(c).alias(c) for c in cols])


def _solved_surrogates(ne: DataFrame, feats: list[str], sds: dict, ridge: float, id_col: str, id_type: str) -> DataFrame:
    """(id, feature, weight) from summed normal equations."""
    nf = len(feats)
    names = ["_intercept"] + feats

    def solve(batches):
        for pdf in batches:
            m = len(pdf)
            A = np.zeros((m, nf + 1, nf + 1))
            for a in range(nf + 1):
                for b in range(a, nf + 1):
                    A[:, a, b] = A[:, b, a] = pdf[f"a_{a}_{b}"].to_numpy()
            A += ridge * np.eye(nf + 1)[None, :, :]
            rhs = np.stack([pdf[f"b_{a}"].to_numpy() for a in range(nf + 1)], axis=1)
            beta = np.linalg.solve(A, rhs[:, :, None])[:, :, 0]
            # coefficients per standardised unit -> per original unit
            scale = np.array([1.0] + [sds[f] for f in feats])
            beta = beta / scale
            yield pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy(), nf + 1),
                                "feature": np.tile(names, m), "weight": beta.reshape(-1)})

    return ne.mapInPandas(solve, f"{id_col} {id_type}, feature string, weight double")


# ------------------------------------------------------------------ X16
def explanation_report(importance: DataFrame, complexity: DataFrame, corr_pairs: DataFrame,
                       mutual_info: DataFrame | None = None, attributions: DataFrame | None = None,
                       permutation: DataFrame | None = None) -> DataFrame:
    """One long frame (section, key, value) gathering importances, complexity, correlated
    pairs, mutual information, attribution and permutation importance and the interpretability score."""
    from .explain import interpretability_scores
    parts = [importance.select(F.lit("importance").alias("section"), F.col("feature").alias("key"),
                               F.col("importance").cast("double").alias("value"))]
    comp = complexity.first()
    for k in ("n_parameters", "n_features", "n_estimators", "max_depth"):
        if comp[k] is not None:
            parts.append(complexity.select(F.lit("complexity").alias("section"), F.lit(k).alias("key"),
                                           F.col(k).cast("double").alias("value")))
    parts.append(corr_pairs.select(F.lit("high_correlation").alias("section"),
                                   F.concat_ws("~", "feature1", "feature2").alias("key"),
                                   F.col("correlation").cast("double").alias("value")))
    if mutual_info is not None:
        parts.append(mutual_info.select(F.lit("mutual_information").alias("section"), F.col("feature").alias("key"),
                                        F.col("mutual_information").alias("value")))
    if attributions is not None:
        parts.append(attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("v")).select(
            F.lit("mean_abs_attribution").alias("section"), F.col("feature").alias("key"), F.col("v").alias("value")))
    if permutation is not None:
        parts.append(permutation.select(F.lit("permutation_importance").alias("section"), F.col("feature").alias("key"),
                                        F.col("importance_mean").alias("value")))
    scored = interpretability_scores(complexity, corr_pairs.count())
    parts.append(scored.select(F.lit("interpretability").alias("section"), F.lit("score").alias("key"), F.col("interpretability_score").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

