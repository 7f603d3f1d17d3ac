"""Missing-value imputation.

Statistics are computed distributed and exactly:

* mean: one aggregate;
* median: an exact, distributed rank selection (values are bucketed by approximate
  quantile splits and collapsed to (value, count) so a hot value cannot skew a task;
  bucket offsets come from a table with one row per (column, bucket)).  A global
  ``percentile`` aggregate would merge every distinct value into a single buffer;
* mode: group-by (column, value) counts, then a min over (-count, value), so ties go
  to the smallest value.

Forward/backward fill runs in two phases so that neither a global order nor a hot
partition key forces all rows through one task (see ``_directional_fill``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast, broadcast_if, is_numeric, is_string, long_aggregate, named, unpivot
from ..functions.ranges import default_chunks, order_chunks, per_column_buckets

PATTERN_BROADCAST = 100_000  # pairs of missingness patterns that are broadcast


def _cols_with_gaps(df: DataFrame, cols: Sequence[str]) -> list[str]:
    if not cols:
        return []
    counts = {r["name"]: r["value"] for r in long_aggregate(df, {c: F.count_if(F.col(f"`{c}`").isNull()) for c in cols}).collect()}
    return [c for c in cols if counts[c] > 0]  # one row per column


# ------------------------------------------------------------------ statistics
def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value) mean of each numeric column, one aggregate."""
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, value double")
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("value"))
                                          for i, c in enumerate(cols)])))


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5, chunks: int | None = None) -> DataFrame:
    """(feature, value): exact quantile with linear interpolation (pandas/numpy default) per column.

    rank position h = (n - 1) * q; value = v[floor(h)] + (h - floor(h)) * (v[ceil(h)] - v[floor(h)]).
    Values are bucketed between approximate quantile splits, collapsed to (value, count)
    (map-side, so a hot value is one row), bucket offsets come from a table of
    columns x buckets rows, and ranks are running sums inside each bucket.
    """
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "feature string, value double")
    nb = chunks or default_chunks(df)
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    b = per_column_buckets(num, cols, nb)
    long = b.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"_b_{c}").alias("bucket")) for c in cols
    ]))).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "bucket", "value").agg(F.count("*").alias("c"))
    # bucket totals straight from the rows: map-side partial counts make this shuffle tiny,
    # instead of re-running the (value, count) shuffle for a second consumer
    per_b = long.groupBy("feature", "bucket").agg(F.count("*").alias("bc"))
    wf = Window.partitionBy("feature").orderBy("bucket")
    offsets = per_b.select(
        "feature", "bucket",
        F.coalesce(F.sum("bc").over(wf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"),
        F.sum("bc").over(Window.partitionBy("feature")).alias("n"))
    # offsets has at most columns x (buckets + 1) rows, known before the job runs
    joined = counts.join(broadcast_if(offsets, len(cols) * (nb + 2)), ["feature", "bucket"])
    wl = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = joined.withColumn("hi", F.col("off") + F.sum("c").over(wl)).withColumn("lo", F.col("hi") - F.col("c"))
    h = (F.col("n") - 1) * F.lit(float(q))
    k1, k2 = F.floor(h), F.ceil(h)
    picked = ranks.select(
        "feature", h.alias("h"), k1.alias("k1"),
        F.when((F.col("lo") <= k1) & (k1 < F.col("hi")), F.col("value")).alias("v1"),
        F.when((F.col("lo") <= k2) & (k2 < F.col("hi")), F.col("value")).alias("v2"),
    ).where(F.col("v1").isNotNull() | F.col("v2").isNotNull())
    agg = picked.groupBy("feature").agg(F.max("v1").alias("v1"), F.max("v2").alias("v2"),
                                         F.first("h").alias("h"), F.first("k1").alias("k1"))
    frac = F.col("h") - F.col("k1")
    val = F.when(frac == 0, F.col("v1")).otherwise(F.col("v1") + frac * (F.col("v2") - F.col("v1")))
    return agg.select("feature", val.alias("value"))


def column_medians(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """(feature, value) median per column; ``method='approx'`` uses percentile_approx."""
    if method == "exact":
        return exact_quantiles(df, cols, 0.5)
    if method == "approx":
        wide = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(f"m{i}")
                        for i, c in enumerate(cols)])
        return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("value"))
                                              for i, c in enumerate(cols)])))
    raise ValueError("method must be 'exact' or 'approx'")


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, freq): most frequent non-NULL value per column, ties -> smallest value."""
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, value string, freq long")
    long = unpivot(df, cols, value_type="string", value_col="value").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("freq"))
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("freq")).alias("nf"), F.col("value"))).alias("b"))
    return best.select("feature", F.col("b.value").alias("value"), (-F.col("b.nf")).alias("freq"))


# ------------------------------------------------------------------ I1-I4 fill
def impute_values(df: DataFrame, numeric: str | None = "median", categorical: str | None = "mode",
                  columns: Sequence[str] | None = None, median_method: str = "exact") -> DataFrame:
    """The fill value per column with gaps: (feature, kind, strategy, value as string)."""
    cols = list(columns) if columns is not None else df.columns
    gaps = _cols_with_gaps(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in gaps if is_numeric(types[c])]
    cat = [c for c in gaps if is_string(types[c])]
    parts = []
    if numeric == "median":
        parts.append(column_medians(df, num, median_method).select("feature", F.lit("median").alias("strategy"),
                                                                     F.col("value").cast("string").alias("value")))
    elif numeric == "mean":
        parts.append(column_means(df, num).select("feature", F.lit("mean").alias("strategy"),
                                                  F.col("value").cast("string").alias("value")))
    elif numeric is not None:
        raise ValueError("numeric must be 'median', 'mean' or None")
    if categorical == "mode":
        parts.append(column_modes(df, cat).select("feature", F.lit("mode").alias("strategy"), "value"))
    elif categorical is not None:
        raise ValueError("categorical must be 'mode' or None")
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, strategy string, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impute(df: DataFrame, numeric: str | None = "median", categorical: str | None = "mode",
           columns: Sequence[str] | None = None, median_method: str = "exact") -> DataFrame:
    """Fill numeric gaps with the median (or mean) and string gaps with the mode.

    'smart' in the application is ``numeric='median', categorical='mode'``.  Numeric
    columns that receive a fill value become double, as they would in pandas.  Columns
    that are entirely NULL have no statistic and stay NULL.  The fill table has one row
    per column and is read on the driver.
    """
    fills = {r["feature"]: r["value"] for r in impute_values(df, numeric, categorical, columns, median_method).collect()}
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in fills and fills[c] is not None:
            if is_numeric(types[c]):
                out.append(F.coalesce(F.col(c).cast("double"), F.lit(float(fills[c]))).alias(c))
            else:
                out.append(F.coalesce(F.col(c), F.lit(fills[c])).alias(c))
        elif c in fills and is_numeric(types[c]):
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------------------ C13
def clean(df: DataFrame, drop_sparse_pct: float | None = 70.0, numeric: str | None = "median",
          categorical: str | None = "mode") -> DataFrame:
    """Drop empty rows, de-duplicate, drop sparse columns, then fill the gaps.

    ``drop_sparse_pct=None`` keeps all columns; ``numeric`` / ``categorical`` are the strategies of
    ``impute`` (None leaves those gaps).  The de-duplicated table is checkpointed once: profile,
    gap counts, medians, modes and the final read all use it, and the whole-row shuffle runs once.
    """
    from .profile import drop_duplicate_rows, drop_empty_rows, drop_sparse_columns
    step = drop_duplicate_rows(drop_empty_rows(df))
    if df.sparkSession.sparkContext.getCheckpointDir():
        step = step.checkpoint(eager=True)
    if drop_sparse_pct is not None:
        step = drop_sparse_columns(step, drop_sparse_pct)
    return impute(step, numeric, categorical)


# ------------------------------------------------------------------ I6 / I7 directional fill
def _directional_fill(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str],
                      columns: Sequence[str] | None, forward: bool, chunks: int | None) -> DataFrame:
    """Fill each gap from the nearest earlier (forward) or later (backward) non-NULL value.

    Phase 1: rows are cut into chunks = (partition key, range of the order keys, of any
    types), so neither a global order nor a hot key becomes one task; each chunk is filled
    with a window.  Phase 2: a carry table with one row per chunk holds its last (first)
    non-NULL value; a window over that table gives the value entering every chunk, which
    is joined back.  Chunk ids are a function of the key, so both phases agree.
    """
    part, order = list(partition_by), list(order_by)
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in part + order]
    cols = _cols_with_gaps(df, cols)
    if not cols:
        return df
    nb = chunks or default_chunks(df)
    chunked = order_chunks(df, order, nb, "_chunk")
    # a running frame (unbounded preceding .. current row) is linear; a backward fill uses it
    # over the descending order instead of an (current row .. unbounded following) frame
    keys = [F.col(o).asc_nulls_first() for o in order] if forward else [F.col(o).desc_nulls_last() for o in order]
    frame = Window.partitionBy("_chunk", *part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = {c: F.last(c, ignorenulls=True).over(frame) for c in cols}
    filled = chunked.withColumns({f"_l_{c}": e for c, e in local.items()})

    okey = F.struct(*[F.col(o) for o in order])
    pick = F.max_by if forward else F.min_by
    edge = chunked.groupBy("_chunk", *part).agg(*[
        pick(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_e_{c}") for c in cols])
    wc = Window.partitionBy(*part).orderBy("_chunk")
    if forward:
        cf = wc.rowsBetween(Window.unboundedPreceding, -1)
        carry_exprs = [F.last(f"_e_{c}", ignorenulls=True).over(cf).alias(f"_c_{c}") for c in cols]
    else:
        cf = wc.rowsBetween(1, Window.unboundedFollowing)
        carry_exprs = [F.first(f"_e_{c}", ignorenulls=True).over(cf).alias(f"_c_{c}") for c in cols]
    carry = edge.select("_chunk", *part, *carry_exprs)
    # NULL is a partition key like any other
    carry = carry.select(*[F.col(c).alias(f"_k_{c}") for c in ["_chunk", *part]], *[F.col(f"_c_{c}") for c in cols])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ["_chunk", *part]]
    j = filled.join(broadcast_if(carry, nb + 2) if not part else carry, same, "left")
    out = [F.coalesce(F.col(f"_l_{c}"), F.col(f"_c_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    return j.select(*out)


def forward_fill(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                 columns: Sequence[str] | None = None, chunks: int | None = None) -> DataFrame:
    """Forward fill every column with gaps along ``order_by`` (optionally per key)."""
    return _directional_fill(df, order_by, partition_by, columns, True, chunks)


def backward_fill(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                  columns: Sequence[str] | None = None, chunks: int | None = None) -> DataFrame:
    """Backward fill every column with gaps along ``order_by`` (optionally per key)."""
    return _directional_fill(df, order_by, partition_by, columns, False, chunks)


def fill_report(after: DataFrame) -> DataFrame:
    """Remaining NULLs per column after a fill (the application's final verification)."""
    return after.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in after.columns]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_left")) for c in after.columns])))



# ------------------------------------------------------------------ I5 KNN imputation
def impute_knn(df: DataFrame, id_col: str, columns: Sequence[str] | None = None, k: int = 5,
               categorical: str | None = "mode") -> DataFrame:
    """Fill numeric gaps with the mean of the k nearest donors that have the value.

    Distance is NaN-aware Euclidean over ``columns`` (default: numeric columns with gaps):
    sqrt(n / m * sum over the m coordinates present in both rows), as a nan-euclidean
    KNN imputer computes it; donors sharing no coordinate are skipped, a row without any
    such donor gets the column mean; ties go to the smaller donor id.  String gaps get the
    mode.

    Exact and without all-pairs joins: rows are grouped by missingness pattern; inside
    one (receiver pattern, donor pattern) pair the distance is plain Euclidean on the
    shared coordinates, so ``neighbors.bipartite_knn`` (projection-band search) finds the
    exact k nearest donors per pattern pair and the best k over all pairs are kept.
    """
    from .neighbors import bipartite_knn

    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else _cols_with_gaps(df, [c for c in df.columns if is_numeric(types[c]) and c != id_col])
    n = len(cols)
    if n == 0:
        return impute(df, None, categorical)
    vals = F.array(*[F.col(c).cast("double") for c in cols])
    if n > 62:
        raise ValueError("at most 62 columns with gaps")
    pat = sum((F.when(named(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(cols)), F.lit(0).cast("bigint"))
    base = df.select(F.col(id_col).alias("_id"), vals.alias("_v"), pat.alias("_pat"))

    def bit(mask: Column, i: Column) -> Column:
        return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("bigint"))

    # the lattice as a table: a receiver pattern meets every donor pattern that holds what it lacks
    patterns = base.select("_pat").distinct().checkpoint(eager=True)
    places = F.sequence(F.lit(0), F.lit(n - 1))
    lacks = patterns.select(F.col("_pat").alias("_px"), F.explode(F.filter(places, lambda i: bit(F.col("_pat"), i) == 0)).alias("_j"))
    holds = patterns.select(F.col("_pat").alias("_py"), F.explode(F.filter(places, lambda i: bit(F.col("_pat"), i) == 1)).alias("_j"))
    shared = lacks.join(holds, "_j").withColumn("_m", F.col("_px").bitwiseAND(F.col("_py"))).where("_m <> 0")
    size = F.bit_count("_m")
    groups = shared.select(F.concat_ws("|", "_j", "_px", "_py").alias("_g"), "_j", "_px", "_py", F.transform(places, lambda i: bit(F.col("_m"), i).cast("double")).alias("_w"),
                           (F.lit(float(n)) / size).alias("_s2"), (F.sqrt(F.lit(float(n)) / size) / F.sqrt(size.cast("double"))).alias("_pscale")).checkpoint(eager=True)
    fills = None
    if not groups.isEmpty():
        hinted = bounded_broadcast(groups, PATTERN_BROADCAST)

        def side(key: str, pattern: str) -> DataFrame:
            # shared coordinates only; distance = sqrt(n/m * |x - y|^2), projection on the
            # group's unit diagonal scaled the same way
            rows = base.join(hinted.withColumnRenamed(pattern, "_pat"), "_pat").select(F.col("_id").alias(key), "_g", "_v", "_w", "_s2", "_pscale")
            x = F.zip_with("_v", "_w", lambda v, w: F.coalesce(v, F.lit(0.0)) * w)
            return rows.withColumn("_x", x).withColumn("_p", F.aggregate("_x", F.lit(0.0), lambda a, b: a + b) * F.col("_pscale"))

        queries, points = side("_qid", "_px"), side("_pid", "_py")
        # of donors at the very same place only the k least ids can be among the k nearest (ties go
        # to the smaller id), so the others need not be searched; exact, and crowded values stay small
        same = Window.partitionBy("_g", "_x").orderBy("_pid")
        points = points.withColumn("_t", F.row_number().over(same)).where(F.col("_t") <= k).drop("_t")
        nn = bipartite_knn(queries, points, k)
        nn = nn.withColumn("_j", F.split("_g", r"\|")[0].cast("int"))
        best = nn.withColumn("_r", F.row_number().over(Window.partitionBy("_qid", "_j").orderBy("dist", "_pid"))).where(
            F.col("_r") <= k)
        donor_vals = base.select(F.col("_id").alias("_pid"), F.col("_v").alias("_dv"))
        fills = (best.join(donor_vals, "_pid").groupBy("_qid", "_j")
                     .agg(F.avg(F.element_at("_dv", F.col("_j") + 1)).alias("_fill")))
        fills = fills.groupBy(F.col("_qid").alias("_id")).agg(
            F.map_from_entries(F.collect_list(F.struct("_j", "_fill"))).alias("_fills"))  # <= len(cols) per row
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    out_df = df if fills is None else df.join(fills, df[id_col] == fills["_id"], "left").drop("_id")
    out_cols = []
    for c in df.columns:
        if c in cols:
            j = cols.index(c)
            knn = F.element_at(F.col("_fills"), F.lit(j)) if fills is not None else F.lit(None).cast("double")
            out_cols.append(F.coalesce(F.col(c).cast("double"), knn, F.lit(means[c])).alias(c))
        else:
            out_cols.append(F.col(c))
    filled = out_df.select(*out_cols)
    return impute(filled, None, categorical) if categorical else filled
