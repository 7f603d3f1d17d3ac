"""Fairness mitigation (M1-M4): SMOTE oversampling, Tomek-link cleaning, demographic-parity
constrained training (exponentiated gradient) and per-group threshold optimisation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast, broadcast_if, stack_columns
from ..functions.ranges import default_chunks, hash_rank, quantile_splits, with_buckets
from .models import FEATURES, LABEL_IDX, _unit_hash, build_pipeline, label_values
from .neighbors import exact_knn, knn_graph

MAX_GROUPS = 10_000  # groups of a sensitive attribute in constrained training (one multiplier pair each)


# ------------------------------------------------------------------ M1 SMOTE
def smote(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5, seed: int = 42, exact: bool = False) -> DataFrame:
    """M1: oversample every class to the size of the largest one.

    Synthetic points lie on segments between a row and one of its k nearest same-class
    neighbours (``neighbors.knn_graph``; ``exact`` takes ``exact_knn``): x + u (nn - x) with u a
    seeded uniform.  The n_max - n_c new points of class c are spread over the n_c * k
    (row, neighbour) pairs: each pair gets floor(new / pairs) points and the first
    ``remainder`` pairs of a seeded hash order one more, so classes end exactly balanced.
    Output: id (original id, or NULL), ``synthetic`` flag, ``syn_key``, label, vector.
    """
    sizes = df.groupBy(F.col(label).alias("_lab")).agg(F.count("*").alias("_nc"))
    stats = sizes.agg(F.max("_nc").alias("m"), F.count("*").alias("k")).first()
    n_max, n_classes = stats["m"], stats["k"]
    orig = df.select(F.col(id_col), F.lit(0).alias("synthetic"), F.col(id_col).cast("string").alias("syn_key"),
                     F.col(label), F.transform(F.col(vec), lambda x: x.cast("double")).alias(vec))
    nn = (exact_knn if exact else knn_graph)(df, id_col, vec, k, group=label)
    x = df.select(F.col(id_col), F.col(label).alias("_lab"), F.transform(F.col(vec), lambda v: v.cast("double")).alias("_x"))
    nx = df.select(F.col(id_col).alias("nbr_id"), F.transform(F.col(vec), lambda v: v.cast("double")).alias("_nx"))
    pairs = nn.join(x, id_col).join(nx, "nbr_id").join(broadcast_if(sizes, n_classes), "_lab")  # one row per class
    pairs = pairs.withColumn("_need", F.lit(n_max) - F.col("_nc")).where(F.col("_need") > 0)
    pairs = hash_rank(pairs, ["_lab"], [id_col, "nbr_id"], seed, out="_pr", total="_np")
    per = F.floor(F.col("_need") / F.col("_np")) + F.when(F.col("_pr") < F.col("_need") % F.col("_np"), 1).otherwise(0)
    gen = pairs.withColumn("_cnt", per.cast("int")).where(F.col("_cnt") > 0)
    gen = gen.select("*", F.explode(F.sequence(F.lit(1), F.col("_cnt"))).alias("_t"))
    u = _unit_hash(F.col(id_col), F.col("nbr_id"), F.col("_t"), seed=seed)
    new_vec = F.zip_with("_x", "_nx", lambda a, b: a + (b - a) * u)
    syn = gen.select(F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), F.lit(1).alias("synthetic"),
                     F.concat_ws(":", F.col(id_col).cast("string"), F.col("nbr_id").cast("string"),
                                 F.col("_t").cast("string")).alias("syn_key"),
                     F.col("_lab").alias(label), new_vec.alias(vec))
    return orig.unionByName(syn)


# ------------------------------------------------------------------ M2 SMOTE + Tomek
def tomek_links(df: DataFrame, key: str, vec: str, label: str, exact: bool = False) -> DataFrame:
    """Pairs (a, b) of mutual nearest neighbours with different labels."""
    nn = (exact_knn if exact else knn_graph)(df, key, vec, 1).select(F.col(key).alias("a"), F.col("nbr_id").alias("b"))
    mutual = nn.join(nn.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    lab = df.select(F.col(key), F.col(label))
    la = lab.select(F.col(key).alias("a"), F.col(label).alias("la"))
    lb = lab.select(F.col(key).alias("b"), F.col(label).alias("lb"))
    return mutual.join(la, "a").join(lb, "b").where(F.col("la") != F.col("lb")).select("a", "b")


def smote_tomek(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5, seed: int = 42, exact: bool = False) -> DataFrame:
    """M2: SMOTE, then drop both members of every Tomek link (anti join)."""
    # the neighbour search reads its input several times: cut the SMOTE lineage once
    # (reliable checkpoint in spark.checkpoint.dir) instead of recomputing it per pass
    s = smote(df, id_col, vec, label, k, seed, exact).checkpoint(eager=True)
    links = tomek_links(s, "syn_key", vec, label, exact)
    drop = links.select(F.col("a").alias("syn_key")).union(links.select(F.col("b").alias("syn_key"))).distinct()
    return s.join(drop, "syn_key", "left_anti")


# ------------------------------------------------------------------ M3 exponentiated gradient
class FairModel:
    """A randomised classifier: the round models with their probabilities, and how far it is from the optimum.

    ``gap`` is the duality gap over the classifiers met (error plus ``bound`` times violation); ``history`` has
    one (round, gap, error, violation) entry a round.
    """

    def __init__(self, models: list[PipelineModel], weights: np.ndarray, gap: float, history: list[tuple[int, float, float, float]]):
        self.models, self.weights, self.gap, self.history = models, weights, gap, history


def _saddle(errors: np.ndarray, excess: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(classifier probabilities, multipliers, value) at the saddle point of the game on known classifiers.

    The row player mixes classifiers (least error + multipliers x excess), the column player puts ``bound`` on
    one constraint or none.  The matrix game is a linear program of classifiers x constraints numbers, solved by
    the simplex method with Bland's rule.
    """
    pay = errors[:, None] + bound * np.concatenate((excess, np.zeros((len(errors), 1))), 1)  # last: no multiplier
    low = float(pay.min()) - 1.0
    k, c = pay.shape
    # most sum(x) with pay' x <= 1: x / sum(x) mixes the classifiers, the slacks' prices are the multipliers
    table = np.zeros((c + 1, k + c + 1))
    table[:c, :k], table[:c, k:k + c], table[:c, -1], table[c, :k] = pay.T - low, np.eye(c), 1.0, -1.0
    basis = np.arange(k, k + c)
    while (table[c, :-1] < -1e-10).any():
        enter = int(np.argmax(table[c, :-1] < -1e-10))
        rising = table[:c, enter] > 1e-12
        ratio = np.where(rising, table[:c, -1] / np.where(rising, table[:c, enter], 1.0), np.inf)
        tied = np.flatnonzero(ratio <= ratio.min() + 1e-12)
        leave = int(tied[np.argmin(basis[tied])])
        table[leave] /= table[leave, enter]
        others = np.arange(c + 1) != leave
        table[others] -= table[others, enter][:, None] * table[leave]
        basis[leave] = enter
    total = table[c, -1]
    x = np.zeros(k + c)
    x[basis] = table[:c, -1]
    prices = np.maximum(table[c, k:k + c], 0.0)
    return x[:k] / x[:k].sum(), bound * prices[:-1] / total, 1.0 / total + low


def fair_train(df: DataFrame, features: Sequence[str], label: str, sensitive: str, rounds: int = 30, eta: float = 2.0,
               bound: float = 20.0, eps: float = 0.01, gap: float | None = None) -> FairModel:
    """M3: demographic-parity constrained training as a saddle point of error and constraint violations.

    A constraint (a, +-) says that group a's selection rate differs from the overall one by at most ``eps``.  The
    learner answers multipliers with a weighted logistic regression (every row relabelled and weighted by its
    cost difference).  Each round it answers the multipliers of exponentiated gradient, which its answer's
    rates move, and those that the classifiers met so far meet worst: the game on these is solved, and
    gives their probabilities.  The duality gap is what the learner's answer to the worst multipliers still gains;
    training stops when it is at most ``gap`` (default 2 / sqrt(rows), at least 0.002).  ``label`` must
    be 0/1; rows of a NULL group or label are not used.
    """
    data = df.select(*features, F.col(label).cast("int").alias("_y"), F.col(sensitive).cast("string").alias("_a"))
    data = data.where(F.col("_a").isNotNull() & F.col("_y").isNotNull()).checkpoint(eager=True)  # read by every round
    stats = data.groupBy("_a").agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if not stats or len(stats) > MAX_GROUPS:
        raise ValueError(f"the sensitive attribute needs 1 to {MAX_GROUPS} groups")
    size = {r["_a"]: r["n"] for r in stats}
    n, groups = sum(size.values()), sorted(size)
    share = np.array([size[g] / n for g in groups])
    stop = max(0.002, 2 / math.sqrt(n)) if gap is None else gap
    models, errors, excess, history = [], [], [], []

    def answer(multipliers: np.ndarray) -> int:
        """Number of the classifier that the learner gives for multipliers of (a, +) and (a, -)."""
        net = multipliers[:len(groups)] - multipliers[len(groups):]
        shift = F.create_map(*[x for g, v in zip(groups, net / share - net.sum()) for x in (F.lit(g), F.lit(float(v)))])
        c0 = F.col("_y").cast("double")
        c1 = (1 - F.col("_y")).cast("double") + F.element_at(shift, F.col("_a"))
        step = data.withColumn("_ry", (c0 > c1).cast("int").cast("string")).withColumn("_w", F.abs(c0 - c1))
        lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL_IDX, weightCol="_w", maxIter=100)
        models.append(build_pipeline(step, features, "_ry", lr).fit(step))
        seen = {r["_a"]: r for r in _predict01(models[-1], data).groupBy("_a").agg(
            F.avg("_h").alias("s"), F.sum((F.col("_h") != F.col("_y")).cast("int")).alias("e")).collect()}
        rate = np.array([seen[g]["s"] for g in groups])
        off = rate - share @ rate
        errors.append(sum(r["e"] for r in seen.values()) / n)
        excess.append(np.concatenate((off - eps, -off - eps)))
        return len(models) - 1

    theta = np.zeros(2 * len(groups))
    weights, reached = np.ones(1), math.inf
    for turn in range(rounds):
        top = max(0.0, theta.max())
        ex = np.exp(theta - top)
        theta = theta + eta * excess[answer(bound * ex / (math.exp(-top) + ex.sum()))]
        mixed, worst, value = _saddle(np.array(errors), np.array(excess), bound)
        error, violation = float(mixed @ errors), max(0.0, float((mixed @ np.array(excess)).max()))
        k = answer(worst)
        here = max(0.0, value - float(errors[k] + excess[k] @ worst))
        history.append((turn + 1, here, error, violation))
        if here < reached:
            weights, reached = mixed, here
        if reached <= stop:
            break
    weights = np.concatenate((weights, np.zeros(len(models) - len(weights))))
    used = np.flatnonzero(weights > 1e-4)
    return FairModel([models[i] for i in used], weights[used] / weights[used].sum(), reached, history)


def _predict01(model: PipelineModel, df: DataFrame) -> DataFrame:
    labels = label_values(model)
    lab_arr = F.array(*[F.lit(v) for v in labels])
    t = model.transform(df)
    return t.withColumn("_h", F.element_at(lab_arr, F.col("prediction").cast("int") + 1).cast("int")).drop(
        *[c for c in t.columns if c not in df.columns and c != "_h"])


def fair_predict(model: FairModel, df: DataFrame, out: str = "fair_pred", id_col: str | None = None, seed: int = 42) -> DataFrame:
    """M3: adds ``out``.  With ``id_col`` each row's label is drawn: a hash of its id picks one of the classifiers by
    their probabilities (the randomised prediction, whose rates meet the constraint).  Without it ``out`` is the
    probability of label 1 under that draw."""
    acc, below, cur = F.lit(0.0), 0.0, df
    if id_col is not None:
        cur = cur.withColumn("_u", _unit_hash(F.col(id_col), seed=seed))
    for i, (m, w) in enumerate(zip(model.models, model.weights.tolist())):
        lab_arr = F.array(*[F.lit(v) for v in label_values(m)])
        t = m.transform(cur)
        cur = t.select(*cur.columns, F.element_at(lab_arr, F.col("prediction").cast("int") + 1).cast("double").alias(f"_h{i}"))
        if id_col is None:
            acc = acc + F.lit(w) * F.col(f"_h{i}")
        else:
            last = i == len(model.models) - 1
            acc = F.when((F.col("_u") >= below) & (F.lit(True) if last else F.col("_u") < below + w), F.col(f"_h{i}")).otherwise(acc)
        below += w
    cur = cur.withColumn(out, acc if id_col is None else acc.cast("int"))
    return cur.drop("_u", *[f"_h{i}" for i in range(len(model.models))])


# ------------------------------------------------------------------ M4 threshold optimisation
def selection_curve(scored: DataFrame, y: str, score: str, sensitive: Sequence[str], chunks: int | None = None) -> DataFrame:
    """(feature, grp, threshold, sel, correct, n_g): for every distinct score of a group the rows selected at score >=
    threshold and the right decisions, and one point that selects nobody (threshold infinity).

    Equal scores of a group are one row with counts; ranges of the score and per-range offsets make the running
    counts, so no window holds a whole group.
    """
    s = F.col(score).cast("double")
    long = scored.select(F.col(y).cast("int").alias("_y"), s.alias("s"), F.inline(stack_columns(list(sensitive), "string", "feature", "grp")))
    long = long.where("grp IS NOT NULL AND s IS NOT NULL AND _y IS NOT NULL AND NOT isnan(s)")
    points = long.groupBy("feature", "grp", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).checkpoint(eager=True)
    count = chunks or default_chunks(points)
    points = with_buckets(points, {"s": F.col("s")}, quantile_splits(points, {"s": F.col("s")}, count), {"s": "c"})
    group = Window.partitionBy("feature", "grp")
    per = points.groupBy("feature", "grp", "c").agg(F.sum("n").alias("cn"), F.sum("pos").alias("cp"))
    above = group.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("feature", "grp", "c", F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("ap"),
                     F.sum("cn").over(group).alias("n_g"), F.sum("cp").over(group).alias("pos_g")).checkpoint(eager=True)
    inside = Window.partitionBy("feature", "grp", "c").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = points.select("feature", "grp", "c", "s", F.sum("n").over(inside).alias("rn"), F.sum("pos").over(inside).alias("rp")).join(
        broadcast_if(per, per.count()), ["feature", "grp", "c"])
    sel, tp = F.col("an") + F.col("rn"), F.col("ap") + F.col("rp")
    curve = run.select("feature", "grp", F.col("s").alias("threshold"), sel.alias("sel"), (2 * tp - sel + F.col("n_g") - F.col("pos_g")).alias("correct"), "n_g", "c")
    none = per.select("feature", "grp", F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("sel"),
                      (F.col("n_g") - F.col("pos_g")).alias("correct"), "n_g", F.lit(count).alias("c")).distinct()
    return curve.unionByName(none)


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corners of the upper hull of (sel, correct); whole-number products, so straight runs keep only their ends."""
    pdf = pdf.sort_values(["sel", "correct"]).drop_duplicates("sel", keep="last")
    corners: list[tuple[int, int, int]] = []
    for i, (x, y) in enumerate(zip(pdf["sel"].tolist(), pdf["correct"].tolist())):
        while len(corners) > 1:
            (x0, y0, _), (x1, y1, _) = corners[-2], corners[-1]
            if (y1 - y0) * (x - x1) > (y - y1) * (x1 - x0):
                break
            corners.pop()
        corners.append((x, y, i))
    return pdf.iloc[[i for _, _, i in corners]]


def selection_hull(scored: DataFrame, y: str, score: str, sensitive: Sequence[str], chunks: int | None = None) -> DataFrame:
    """(feature, grp, threshold, sel, correct, n_g): corners of each group's upper hull of accuracy over selection rate.

    Hulls of the score ranges first, then of their corners, so a task holds one range or the few corners of a group.
    """
    schema = "feature string, grp string, threshold double, sel bigint, correct bigint, n_g bigint"
    part = selection_curve(scored, y, score, sensitive, chunks).groupBy("feature", "grp", "c").applyInPandas(
        lambda pdf: _hull(pdf).drop(columns="c"), schema)
    return part.groupBy("feature", "grp").applyInPandas(lambda pdf: _hull(pdf), schema)


def optimize_thresholds(scored: DataFrame, y: str, score: str, sensitive: Sequence[str], chunks: int | None = None) -> DataFrame:
    """M4: randomised per-group thresholds of highest accuracy under demographic parity.

    All groups get one selection rate.  A group reaches any rate by mixing the thresholds at the two corners of
    its hull around the rate: ``threshold_high`` with probability ``weight_high``, else ``threshold_low`` (a row is
    selected if its score is at least the threshold).  Overall accuracy as a function of the rate is a
    sum of concave broken lines, so it is highest at a corner of some group; of equally good rates the least
    is taken.  Returns (feature, grp, threshold_low, threshold_high, weight_high, selection_rate, target_rate,
    accuracy).  Rows of a NULL group, score or label are not used.
    """
    hull = selection_hull(scored, y, score, sensitive, chunks).withColumn("r", F.col("sel") / F.col("n_g")).checkpoint(eager=True)
    along = Window.partitionBy("feature", "grp").orderBy("r")
    part = hull.withColumns({"r1": F.lead("r").over(along), "y1": F.lead("correct").over(along), "t1": F.lead("threshold").over(along)})
    part = part.withColumn("slope", (F.col("y1") - F.col("correct")) / (F.col("r1") - F.col("r")))
    # right decisions at a rate: those at rate 0 plus, for each step between corners, the sum of the slopes there
    turns = part.select("feature", "r", F.coalesce("slope", F.lit(0.0)).alias("d")).unionByName(
        part.where("slope IS NOT NULL").select("feature", F.col("r1").alias("r"), (-F.col("slope")).alias("d")))
    turns = turns.groupBy("feature", "r").agg(F.sum("d").alias("d"))
    by_rate = Window.partitionBy("feature").orderBy("r")  # corners of all groups
    steps = turns.withColumn("slope", F.sum("d").over(by_rate.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("gain", F.coalesce(F.lag("slope").over(by_rate) * (F.col("r") - F.lag("r").over(by_rate)), F.lit(0.0)))
    base = hull.groupBy("feature").agg(F.sum(F.when(F.col("sel") == 0, F.col("correct"))).alias("y0"),
                                       F.sum(F.when(F.col("sel") == 0, F.col("n_g"))).alias("rows"))
    value = (F.col("y0") + F.sum("gain").over(by_rate.rowsBetween(Window.unboundedPreceding, 0))) / F.col("rows")
    rated = steps.join(base, "feature").select("feature", "r", value.alias("accuracy"))
    best = Window.partitionBy("feature").orderBy(F.desc(F.round("accuracy", 9)), "r")
    best = rated.withColumn("k", F.row_number().over(best)).where("k = 1").select("feature", F.col("r").alias("target_rate"), "accuracy")
    mix = part.join(broadcast_if(best, len(list(sensitive))), "feature").where(
        (F.col("r") <= F.col("target_rate")) & ((F.col("target_rate") < F.col("r1")) | F.col("r1").isNull()))
    high = F.coalesce((F.col("r1") - F.col("target_rate")) / (F.col("r1") - F.col("r")), F.lit(1.0))
    sel = high * F.col("r") + (1 - high) * F.coalesce("r1", "r")
    return mix.select("feature", "grp", F.when(high == 1, F.col("threshold")).otherwise(F.col("t1")).alias("threshold_low"),
                      F.col("threshold").alias("threshold_high"), high.alias("weight_high"), sel.alias("selection_rate"), "target_rate", "accuracy")


def apply_thresholds(scored: DataFrame, thresholds: DataFrame, feature: str, score: str, id_col: str, out: str = "selected",
                     seed: int = 42) -> DataFrame:
    """M4: 0/1 decisions under the mixed thresholds of one sensitive attribute; a hash of the row's id draws the threshold."""
    own = bounded_broadcast(thresholds.where(F.col("feature") == feature).select(
        F.col("grp").alias("_grp"), "threshold_low", "threshold_high", "weight_high"), 1_000_000)
    cut = F.when(_unit_hash(F.col(id_col), seed=seed) < F.col("weight_high"), F.col("threshold_high")).otherwise(F.col("threshold_low"))
    j = scored.join(own, F.col(feature).cast("string") == F.col("_grp"), "left")
    return j.select(*[F.col(c) for c in scored.columns], (F.col(score).cast("double") >= cut).cast("int").alias(out))
