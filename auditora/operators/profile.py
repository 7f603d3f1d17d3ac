"""Dataset and column profiling, quality checks and row/column cleaning.

``column_profile`` is the shared building block: one scan computes row count, null count
and distinct count for every column, and the missing report, severity, warnings, target
and privacy heuristics are cheap expressions over its one-row-per-column result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.common import AGG_CHUNK, dtype_name, is_numeric, is_string, long_aggregate, materialize, named

# Many exact distinct counts in one aggregate are expanded once per column by the
# optimizer; beyond this many columns the profile is computed in column chunks.
DISTINCT_CHUNK = 4


# ------------------------------------------------------------------ C1-C3 row cleaning
def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every column is NULL."""
    return df.na.drop(how="all")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (NULLs compare equal)."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """C2 report: rows before, distinct rows after and the number removed, in one aggregate."""
    row = F.struct(*[F.col(c) for c in df.columns])
    a = df.agg(F.count("*").alias("rows_before"), F.count_distinct(row).alias("rows_after"))
    return a.withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after"))


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL."""
    return df.na.drop(how="any")


# ------------------------------------------------------------------ C4 summary
def dataset_summary(df: DataFrame) -> DataFrame:
    """C4: rows, columns, missing cells, missing % and completeness % (one aggregate; wide
    tables sum per-column null counts computed in chunks)."""
    ncols = len(df.columns)
    if ncols <= AGG_CHUNK:
        missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
        a = df.agg(F.count("*").alias("rows"), missing.cast("long").alias("missing_cells"))
    else:  # wide table: per-column null counts in chunks, then summed
        per = long_aggregate(df, {c: F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns})
        a = df.agg(F.count("*").alias("rows")).withColumn("missing_cells", per.agg(F.sum("value")).scalar().cast("long"))
    pct = F.when(F.col("rows") * ncols > 0, F.col("missing_cells") * 100.0 / (F.col("rows") * ncols))
    return a.select("rows", F.lit(ncols).cast("long").alias("columns"), "missing_cells",
                    pct.alias("missing_pct"), (F.lit(100.0) - pct).alias("completeness_pct"))


# ------------------------------------------------------------------ C5 column profile
def _identity(c: Column, dt) -> Column:
    """A value's stand-in of at most 32 bytes: itself, or the SHA-256 of a longer string."""
    if not is_string(dt):
        return c
    return F.when(F.octet_length(c) > 32, F.unhex(F.sha2(c, 256))).otherwise(c.cast("binary"))


SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)  # relative standard error of a distinct count


def profile_sketch(df: DataFrame, run_id: str) -> DataFrame:
    """C5, mergeable: one row per column of one run: run_id, position, feature, dtype, rows, non_null and a
    HyperLogLog sketch of its values (about ``SKETCH_ERROR`` off).  One scan; write the rows and merge any runs later."""
    fields = list(df.schema.fields)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = named(f.name)
        aggs += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(c if is_string(f.dataType) else c.cast("string"), SKETCH_BITS).alias(f"s{i}")]
    items = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("feature"), F.lit(dtype_name(f.dataType)).alias("dtype"),
                               F.col(f"n{i}").alias("non_null"), F.col(f"s{i}").alias("sketch")) for i, f in enumerate(fields)])
    return df.agg(*aggs).select(F.lit(run_id).alias("run_id"), "rows", F.inline(items))


def merge_profiles(sketches: DataFrame) -> DataFrame:
    """C5 of all runs together: position, feature, dtype, runs, rows, non_null, null_count, n_distinct (estimated)."""
    a = sketches.groupBy("feature", "dtype").agg(F.min("position").alias("position"), F.count_distinct("run_id").alias("runs"), F.sum("rows").alias("rows"),
                                                 F.sum("non_null").alias("non_null"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
    return a.select("position", "feature", "dtype", "runs", "rows", "non_null", (F.col("rows") - F.col("non_null")).alias("null_count"), "n_distinct")


def column_profile(df: DataFrame, approx: bool = False, rsd: float = 0.01, materialized: bool = True) -> DataFrame:
    """One row per column: position, feature, dtype, rows, non_null, null_count, distinct.

    distinct excludes NULLs; strings beyond 32 bytes are counted by their SHA-256, so text bodies never
    leave their task.  ``approx=True`` uses HyperLogLog++ (no value shuffle) for
    very large inputs; ``profile_sketch`` keeps sketches that merge over runs.  All counts for a chunk of columns come from one aggregate.  The
    profile (one row per column) is materialised once, because reports, risk scores and
    target checks all read it and would otherwise repeat the distinct-count scans.
    """
    fields = list(df.schema.fields)
    parts = []
    for start in range(0, len(fields), DISTINCT_CHUNK):
        chunk = fields[start:start + DISTINCT_CHUNK]
        aggs = [F.count("*").alias("_rows")]
        for i, f in enumerate(chunk):
            c = F.col(f"`{f.name}`")
            aggs.append(F.count(c).alias(f"nn{i}"))
            aggs.append((F.approx_count_distinct(c, rsd) if approx else F.count_distinct(_identity(c, f.dataType))).alias(f"d{i}"))
        wide = df.agg(*aggs)
        items = F.array(*[
            F.struct(F.lit(start + i).alias("position"), F.lit(f.name).alias("feature"),
                     F.lit(dtype_name(f.dataType)).alias("dtype"),
                     F.lit(bool(is_numeric(f.dataType))).alias("is_numeric"),
                     F.lit(bool(is_string(f.dataType))).alias("is_string"),
                     F.col(f"nn{i}").alias("non_null"), F.col(f"d{i}").cast("long").alias("n_distinct"))
            for i, f in enumerate(chunk)])
        parts.append(wide.select(F.col("_rows").alias("rows"), F.inline(items)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    prof = out.select("position", "feature", "dtype", "is_numeric", "is_string", "rows", "non_null",
                      (F.col("rows") - F.col("non_null")).alias("null_count"), "n_distinct")
    return materialize(prof) if materialized else prof


def _pct(num, den):
    return F.when(den > 0, num * 100.0 / den)


# ------------------------------------------------------------------ C6-C8 reports over the profile
def missing_report(profile: DataFrame) -> DataFrame:
    """Columns with gaps: missing count and %, dtype, non-missing, distinct; by % desc."""
    p = profile.where(F.col("null_count") > 0)
    return p.select("feature", F.col("null_count").alias("missing_count"),
                    _pct(F.col("null_count"), F.col("rows")).alias("missing_pct"), "dtype",
                    F.col("non_null").alias("non_missing"), "n_distinct").orderBy(F.desc("missing_pct"), "feature")


def missing_severity(profile: DataFrame) -> DataFrame:
    """Cumulative flags (>=70 critical, >=50 high, >=20 moderate) and an exclusive badge."""
    m = missing_report(profile)
    pct = F.col("missing_pct")
    return m.select("feature", "missing_pct",
                    (pct >= rules.MISSING_CRITICAL).cast("int").alias("is_critical"),
                    (pct >= rules.MISSING_HIGH).cast("int").alias("is_high"),
                    (pct >= rules.MISSING_MODERATE).cast("int").alias("is_moderate"),
                    F.when(pct >= rules.MISSING_CRITICAL, "critical").when(pct >= rules.MISSING_HIGH, "high")
                     .when(pct >= rules.MISSING_MODERATE, "moderate").otherwise("low").alias("badge"))


def quality_warnings(profile: DataFrame) -> DataFrame:
    """Column > 50 % missing; column with exactly one distinct value."""
    pct = _pct(F.col("null_count"), F.col("rows"))
    hi = profile.where(pct > 50).select("feature", F.lit("high_missing").alias("code"), pct.alias("value"))
    one = profile.where(F.col("n_distinct") == 1).select("feature", F.lit("single_value").alias("code"),
                                                        F.col("n_distinct").cast("double").alias("value"))
    return hi.unionByName(one)


# ------------------------------------------------------------------ C9 column dropping
def sparse_columns(profile: DataFrame, threshold: float | None = rules.MISSING_CRITICAL,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """C9 plan: per column the action (drop/keep) under the policy and whether it stays a
    candidate target (2-10 distinct values) after the drop."""
    pct = F.coalesce(_pct(F.col("null_count"), F.col("rows")), F.lit(0.0))
    if columns is not None:
        drop = F.col("feature").isin(list(columns))
    elif threshold is None:
        drop = F.lit(False)
    else:
        drop = (pct >= threshold) & (F.col("null_count") > 0)
    return profile.select(
        "position", "feature", pct.alias("missing_pct"),
        F.when(drop, "drop").otherwise("keep").alias("action"),
        ((~drop) & F.col("n_distinct").between(2, 10)).cast("int").alias("candidate_target"))


def drop_sparse_columns(df: DataFrame, threshold: float | None = rules.MISSING_CRITICAL,
                        columns: Sequence[str] | None = None, profile: DataFrame | None = None) -> DataFrame:
    """Drop columns by missing policy (>= threshold %, or an explicit list).

    The drop list is schema: it is read from the (small, one row per column) plan.
    """
    if columns is None and threshold is not None:
        plan = sparse_columns(profile if profile is not None else column_profile(df), threshold)
        columns = [r["feature"] for r in plan.where(F.col("action") == "drop").select("feature").collect()]
    return df.drop(*(columns or []))


# ------------------------------------------------------------------ C10 before/after
def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """The C4 summary of the input and of the cleaned table, side by side (long form)."""
    b = dataset_summary(before).withColumn("stage", F.lit("before"))
    a = dataset_summary(after).withColumn("stage", F.lit("after"))
    return b.unionByName(a).select("stage", "rows", "columns", "missing_cells", "missing_pct", "completeness_pct")


# ------------------------------------------------------------------ C11, C12
def split_columns(df: DataFrame) -> dict[str, list[str]]:
    """C11: numeric / categorical (string) / other columns, from the schema only."""
    out = {"numeric": [], "categorical": [], "other": []}
    for f in df.schema.fields:
        key = "numeric" if is_numeric(f.dataType) else "categorical" if is_string(f.dataType) else "other"
        out[key].append(f.name)
    return out


def sample_rows(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows under an explicit order (a distributed top-k)."""
    keys = list(order_by) if order_by else df.columns
    return df.orderBy(*keys).limit(n)
