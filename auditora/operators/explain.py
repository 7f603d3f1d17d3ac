"""Explainability statistics (X1-X3, X9-X11, X15) that need no fitted model.

Model-based attributions (importances, permutation, Shapley sampling, surrogates,
complexity) live in ``operators.models``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.common import bounded_broadcast, long_aggregate, materialize, named
from ..functions.ranges import default_chunks

# ------------------------------------------------------------------ X1 / X2 correlations
MOMENTS = ("n", "ma", "mb", "caa", "cbb", "cab", "odd")


class PairMoments:
    """Counts, means and centred products of all column pairs over pairwise-complete rows, batch by batch.

    [i, j] of ``mean`` and ``square`` belongs to column i on the rows where column j is present too.
    """

    def __init__(self, width: int):
        self.n = np.zeros((width, width))
        self.mean = np.zeros((width, width))
        self.square = np.zeros((width, width))
        self.product = np.zeros((width, width))
        self.odd = np.zeros((width, width))  # values that are no finite numbers

    def add(self, x: np.ndarray, present: np.ndarray) -> None:
        finite = np.isfinite(x)
        w = present.astype(float)
        # sums are taken around a value of the batch, so large offsets cancel before they are squared
        usable = present & finite
        at = usable.argmax(0)
        centre = np.where(usable.any(0), x[at, np.arange(x.shape[1])], 0.0)
        d = np.where(usable, x - centre, 0.0)
        n = w.T @ w
        safe = np.maximum(n, 1)
        sums = d.T @ w
        mean = sums / safe
        square = (d * d).T @ w - sums * mean
        product = d.T @ d - sums * mean.T
        self.odd += (present & ~finite).astype(float).T @ w
        mean += centre[:, None]
        both = self.n + n
        share = np.where(both > 0, n / np.maximum(both, 1), 0.0)
        step = np.where(self.n > 0, mean - self.mean, 0.0)
        self.square += square + step * step * self.n * share
        self.product += product + step * step.T * self.n * share
        self.mean = np.where(self.n > 0, self.mean + step * share, mean)
        self.n = both

    def rows(self) -> pa.RecordBatch:
        a, b = np.triu_indices(len(self.n))
        cols = [self.n[a, b], self.mean[a, b], self.mean[b, a], self.square[a, b], self.square[b, a], self.product[a, b], self.odd[a, b] + self.odd[b, a]]
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, cols)], names=["a", "b", *MOMENTS])


def _moments(width: int):
    """mapInArrow: rows of ``width`` doubles -> one row of moments for each pair of columns."""
    def run(batches):
        held = PairMoments(width)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
                held.add(x, np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1))
        yield held.rows()
    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every ordered pair (diagonal included) on pairwise-complete rows.

    One scan for any number of columns: a task keeps counts, means and centred products of all pairs
    (columns x columns numbers) and gives one row a pair; these are added up by pair, first to a common
    reference, then around it, so that neither large offsets nor many rows cancel.  A constant column
    gives NULL (never a division error); a pair that meets NaN or infinity gives NaN.
    """
    cols = list(cols)
    num = df.select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    schema = "a int, b int, " + ", ".join(f"{m} double" for m in MOMENTS)
    parts = materialize(num.mapInArrow(_moments(len(cols)), schema).where("n > 0"))  # partitions x pairs rows
    base = parts.groupBy("a", "b").agg(F.min("ma").alias("ra"), F.min("mb").alias("rb"))
    n, da, db = F.col("n"), F.col("ma") - F.col("ra"), F.col("mb") - F.col("rb")
    sums = parts.join(base, ["a", "b"]).groupBy("a", "b").agg(
        F.sum(n).alias("n"), F.sum(n * da).alias("sa"), F.sum(n * db).alias("sb"), F.sum("odd").alias("odd"),
        F.sum(F.col("caa") + n * da * da).alias("caa"), F.sum(F.col("cbb") + n * db * db).alias("cbb"), F.sum(F.col("cab") + n * da * db).alias("cab"))
    aa, bb, ab = (F.col(c) - F.col(x) * F.col(y) / n for c, x, y in (("caa", "sa", "sa"), ("cbb", "sb", "sb"), ("cab", "sa", "sb")))
    den = F.sqrt(F.greatest(aa, F.lit(0.0))) * F.sqrt(F.greatest(bb, F.lit(0.0)))
    r = F.when(F.col("odd") > 0, F.lit(float("nan"))).when(den > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), ab / den)))
    names = F.array(*[F.lit(c) for c in cols])
    found = sums.select("a", "b", r.alias("r"))
    # pairs without a common row have no moments
    at = F.sequence(F.lit(0), F.lit(len(cols) - 1))
    every = num.sparkSession.range(1).select(F.explode(at).alias("i")).select("i", F.explode(at).alias("j"))
    known = every.join(found, (F.least("i", "j") == F.col("a")) & (F.greatest("i", "j") == F.col("b")), "left")
    return known.select(F.element_at(names, F.col("i") + 1).alias("feature1"), F.element_at(names, F.col("j") + 1).alias("feature2"), "r")


def high_correlation_pairs(corr: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs (i < j in column order) with |r| > threshold."""
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return corr.where((F.element_at(order, F.col("feature1")) < F.element_at(order, F.col("feature2"))) &
                      (F.abs(F.col("r")) > threshold)).select("feature1", "feature2", F.col("r").alias("correlation"))


# ------------------------------------------------------------------ X3 mutual information
def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 32) -> DataFrame:
    """X3 (re-aimed): mutual information (nats) between each feature, discretised into
    ``bins`` equal-width bins over its range, and the label; rows with a NULL feature or
    label are skipped for that feature.  One job for the ranges, one aggregation for the joint
    counts of all features.
    """
    cols = list(cols)
    named = {}
    for i, c in enumerate(cols):
        named[f"a{i}"] = F.min(F.col(c).cast("double"))
        named[f"b{i}"] = F.max(F.col(c).cast("double"))
    rng = {r["name"]: r["value"] for r in long_aggregate(df, named, value_type="double").collect()}  # 2 per column
    items = []
    for i, c in enumerate(cols):
        lo, hi = rng[f"a{i}"], rng[f"b{i}"]
        x = F.col(c).cast("double")
        if lo is None:
            b = F.lit(None).cast("int")
        elif hi == lo:
            b = F.when(x.isNotNull(), F.lit(0))
        else:
            b = F.least(F.lit(bins - 1), F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int"))
        items.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    long = (df.select(F.col(label).cast("string").alias("_y"), F.inline(F.array(*items)))
              .where(F.col("bin").isNotNull() & F.col("_y").isNotNull()))
    # features x bins x classes cells, read four times below
    joint = materialize(long.groupBy("feature", "bin", "_y").agg(F.count("*").alias("nxy")))
    nx = joint.groupBy("feature", "bin").agg(F.sum("nxy").alias("nx"))
    ny = joint.groupBy("feature", "_y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = joint.join(nx, ["feature", "bin"]).join(ny, ["feature", "_y"]).join(n, "feature")
    nxy, nn, nx_, ny_ = (F.col(c).cast("double") for c in ("nxy", "n", "nx", "ny"))  # no long overflow
    term = (nxy / nn) * F.log(nxy * nn / (nx_ * ny_))
    return j.groupBy("feature").agg(F.sum(term).alias("mutual_information"))


def _digamma(n: Column) -> Column:
    """psi of a positive whole number: the asymptotic series at n + 8, stepped back."""
    x = n.cast("double") + 8
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    for i in range(8):
        series = series - 1 / (n.cast("double") + i)
    return series


def _kth_radius(near: pa.Array, value: pa.Array, k: pa.Array) -> pa.Array:
    """(lo, hi): the interval of values nearer than the k-th neighbour of ``value`` inside its class.

    ``near`` lists the class's values around (own value included) with their counts, in order.
    """
    lo, hi = [], []
    for rows, v, need in zip(near.to_pylist(), value.to_pylist(), k.to_pylist()):
        dist = np.array([abs(r["x"] - v) for r in rows])
        order = np.argsort(dist, kind="stable")
        have = np.cumsum([rows[i]["n"] for i in order]) - 1  # the row itself is no neighbour
        reach = np.nextafter(dist[order[int(np.argmax(have >= need))]], 0.0)
        a, b = v - reach, v + reach
        while v - a > reach:  # rounding of the sums
            a = np.nextafter(a, v)
        while b - v > reach:
            b = np.nextafter(b, v)
        lo.append(float(a))
        hi.append(float(b))
    return pa.StructArray.from_arrays([pa.array(lo, pa.float64()), pa.array(hi, pa.float64())], names=["lo", "hi"])


def neighbor_mutual_information(df: DataFrame, cols: Sequence[str], label: str, k: int = 3, chunks: int | None = None) -> DataFrame:
    """Mutual information (nats) of every numeric feature with a discrete label by nearest neighbours.

    With d the distance to a row's k-th neighbour of its own class and m the rows of any class nearer than d
    (itself included), the estimate is psi(N) + <psi(k)> - <psi(class size)> - <psi(m)>, at least 0; classes of
    one row are left out, smaller ones use their size less one as k.  Rows with a NULL or non-finite feature or
    a NULL label are skipped for that feature; features without two rows of a class give NULL.

    Equal values of a class are one row with a count.  The k-th neighbour is an order statistic among the k
    values on either side, found by windows over value ranges (``chunks``) with the k values before
    and after each range handed over; m is a difference of two ranks, found by prefix sums over the same
    ranges.  No window holds a whole feature, and the result does not depend on the ranges.
    """
    cols = list(cols)
    items = F.array(*[F.struct(F.lit(c).alias("feature"), named(c).cast("double").alias("x")) for c in cols])
    long = df.select(named(label).cast("string").alias("y"), F.inline(items)).where("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")
    points = long.select("feature", "y", (F.col("x") + 0.0).alias("x")).groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    sizes = points.groupBy("feature", "y").agg(F.sum("n").alias("size")).where("size > 1")
    points = points.join(bounded_broadcast(sizes, 100_000), ["feature", "y"]).withColumn("k", F.least(F.lit(k).cast("bigint"), F.col("size") - 1))
    points = points.checkpoint(eager=True)
    count = chunks or default_chunks(points)
    # ranges of each feature's own quantiles
    per = {r["feature"]: r["q"] for r in points.groupBy("feature").agg(
        F.percentile_approx("x", [i / count for i in range(1, count)] or [0.5], max(10_000, 10 * count)).alias("q")).collect()}  # one row a feature
    cuts = F.create_map(*[x for f, q in per.items() for x in (F.lit(f), F.array(*[F.lit(float(v)) for v in sorted(set(q))]))]) if per else None
    if cuts is None:
        return df.sparkSession.createDataFrame([(c, None) for c in cols], "feature string, mutual_information double")

    def chunk(x: Column) -> Column:
        """Number of cuts below a value, by halving."""
        own = F.element_at(cuts, F.col("feature"))
        lo, hi = F.lit(0), F.size(own)
        start = F.struct(lo.alias("lo"), hi.alias("hi"))
        steps = F.sequence(F.lit(1), F.lit(max(1, int(np.ceil(np.log2(count + 1))) + 1)))

        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            right = (s["lo"] < s["hi"]) & (F.get(own, mid) < x)
            return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(steps, start, step)["lo"]

    placed = points.withColumn("c", chunk(F.col("x"))).checkpoint(eager=True)
    # the k values at either end of a class's range, handed to the next and the last range that has any
    inside = Window.partitionBy("feature", "y", "c")
    ends = placed.select("feature", "y", "c", "x", "n", F.row_number().over(inside.orderBy("x")).alias("up"), F.row_number().over(inside.orderBy(F.desc("x"))).alias("down"))
    edge = ends.groupBy("feature", "y", "c").agg(*[F.sort_array(F.collect_list(F.when(F.col(r) <= k, F.struct("x", "n")))).alias(a) for r, a in (("up", "first"), ("down", "last"))])
    # a range may hold fewer than k values: hand over the ends of up to k ranges
    along = Window.partitionBy("feature", "y").orderBy("c")
    halo = edge.select("feature", "y", "c", F.flatten(F.collect_list("last").over(along.rowsBetween(-k, -1))).alias("before"),
                       F.flatten(F.collect_list("first").over(along.rowsBetween(1, k))).alias("after"))
    body = placed.join(halo, ["feature", "y", "c"])
    row = F.struct("x", "n")
    by_x = inside.orderBy("x")
    near = F.concat(F.slice("before", F.greatest(F.size("before") - k + 1, F.lit(1)), k), F.collect_list(row).over(by_x.rowsBetween(-k, k)), F.slice("after", 1, k))
    reach = F.arrow_udf(_kth_radius, "lo double, hi double")
    asked = body.select("feature", "x", "n", "k", "size", F.array_sort(F.array_distinct(near)).alias("near")).select(
        "feature", "x", "n", "k", "size", reach("near", "x", "k").alias("r")).select("feature", "x", "n", "k", "size", "r.lo", "r.hi").checkpoint(eager=True)
    # rank differences: rows of any class in [lo, hi]
    values = points.groupBy("feature", "x").agg(F.sum("n").alias("n")).select("feature", F.col("x").alias("v"), F.lit(1).alias("kind"), F.col("n").cast("bigint").alias("n"))
    asks = asked.select("feature", "lo", "hi").distinct().select("feature", F.inline(F.array(
        F.struct(F.col("lo").alias("v"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("v"), F.lit(2).alias("kind"))))).distinct()
    events = values.unionByName(asks.withColumn("n", F.lit(0).cast("bigint"))).withColumn("c", chunk(F.col("v")))
    per_chunk = events.groupBy("feature", "c").agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("feature").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_chunk.select("feature", "c", before.alias("off"))
    upto = F.sum("n").over(Window.partitionBy("feature", "c").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = events.withColumn("in_chunk", upto).where("kind <> 1").join(bounded_broadcast(offsets, 1_000_000), ["feature", "c"]).select(
        "feature", "v", "kind", (F.col("in_chunk") + F.col("off")).alias("rank")).checkpoint(eager=True)
    low = ranks.where("kind = 0").select("feature", F.col("v").alias("lo"), F.col("rank").alias("below"))
    high = ranks.where("kind = 2").select("feature", F.col("v").alias("hi"), F.col("rank").alias("upto"))
    m = asked.join(low, ["feature", "lo"]).join(high, ["feature", "hi"])
    w = F.col("n")
    parts = m.groupBy("feature").agg(F.sum(w).alias("all"), *[F.sum(w * _digamma(e)).alias(a) for e, a in (
        (F.col("k"), "pk"), (F.col("size"), "py"), (F.col("upto") - F.col("below"), "pm"))])
    mi = _digamma(F.col("all")) + (F.col("pk") - F.col("py") - F.col("pm")) / F.col("all")
    found = parts.select("feature", F.greatest(F.lit(0.0), mi).alias("mutual_information"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(found, "feature", "left")


# ------------------------------------------------------------------ X9-X11 importance reports
def rank_importance(imp: DataFrame, value: str = "importance", by: Sequence[str] = ()) -> DataFrame:
    """Rank features by importance (desc, name asc as tiebreak) within ``by``."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), "feature")
    return imp.withColumn("rank", F.row_number().over(w))


def attribution_importance(attr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean |attribution| per feature (long attributions: ..., feature, attribution), ranked."""
    imp = attr.groupBy(*by, "feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    return rank_importance(imp, "importance", by)


def importance_concentration(imp: DataFrame, top: int = 5, value: str = "importance",
                             by: Sequence[str] = ()) -> DataFrame:
    """Share (%) of total importance in the top-5 features; > 80 high, < 40 distributed,
    else balanced; plus the top-3 feature names."""
    r = rank_importance(imp, value, by)
    a = r.groupBy(*by).agg(
        F.sum(F.when(F.col("rank") <= top, F.col(value))).alias("_top"), F.sum(value).alias("_all"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "feature")))).alias("_t3"))
    share = F.when(F.col("_all") > 0, F.col("_top") * 100.0 / F.col("_all"))
    return a.select(*by, share.alias("top_share_pct"),
                    F.when(share > 80, "high").when(share < 40, "distributed").otherwise("balanced").alias("concentration"),
                    F.array_join(F.transform("_t3", lambda s: s["feature"]), ",").alias("top3"))


def sensitive_in_top(imp: DataFrame, n: int = 10, value: str = "importance", by: Sequence[str] = ()) -> DataFrame:
    """X11: features among the top ``n`` whose name contains a sensitive word."""
    r = rank_importance(imp, value, by)
    low = F.lower(F.col("feature"))
    cond = F.lit(False)
    for k in rules.SENSITIVE_IMPORTANCE_KEYWORDS:
        cond = cond | low.contains(k)
    return r.where((F.col("rank") <= n) & cond).select(*by, "feature", "rank", value)


# ------------------------------------------------------------------ X15 interpretability score
def interpretability_scores(complexity: DataFrame, n_high_corr_pairs: int | None) -> DataFrame:
    """Adds (type points + size points + interaction point) / 6 to ``model_complexity`` rows.

    type: linear 3, tree/forest 2, gradient boosting 1; size: < 10 -> 2, < 50 -> 1 using the
    parameter count for linear models, else the feature count; fewer than 3 correlated pairs -> 1.
    """
    kind = F.col("model_kind")
    type_pts = (F.when(kind == "linear", 3).when(kind.isin("tree", "forest"), 2).when(kind == "gbt", 1).otherwise(0))
    size = F.coalesce(F.col("n_parameters"), F.col("n_features"))
    size_pts = F.when(size.isNull(), 0).when(size < 10, 2).when(size < 50, 1).otherwise(0)
    pair_pts = F.lit(1 if n_high_corr_pairs is not None and n_high_corr_pairs < 3 else 0)
    score = F.least((type_pts + size_pts + pair_pts) / 6.0, F.lit(1.0))
    return complexity.withColumn("interpretability_score", score)
