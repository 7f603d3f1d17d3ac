"""Profile, cleaning and imputation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import impute as im
from ..operators import profile as pr
from ..session import ensure_checkpoint_dir, table
from ..sources.io import write_table
from . import fixtures as fx
from .catalog import register

# Fixed schemas of the driver tables (dtype as Spark names it), used to write the SQL twins.
SCHEMAS = {
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "gaps": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
             ("value", "double"), ("bonus", "double")],
    "empty_dup": [("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
                  ("p_retailprice", "double")],
    "numeric": [("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                ("l_qty_lin", "double"), ("l_const", "double")],
}
NUMERIC = {"bigint", "int", "double"}


def profile_sql(src: str, schema) -> str:
    """SQL twin of ``column_profile``: one branch per column."""
    parts = []
    for i, (c, t) in enumerate(schema):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS feature, '{t}' AS dtype, {str(t in NUMERIC).upper()} AS is_numeric, "
            f"{str(t == 'string').upper()} AS is_string, count(*) AS rows, count({c}) AS non_null, "
            f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_distinct FROM {src}")
    return "\nUNION ALL\n".join(parts)


_GAPS = f"src AS ({fx.GAPS_SQL})"
_ED = f"src AS ({fx.EMPTY_DUP_SQL})"
_NUM = f"src AS ({fx.NUMERIC_SQL})"


def _all_null(schema):
    return " AND ".join(f"{c} IS NULL" for c, _ in schema)


def _cols(schema):
    return ", ".join(c for c, _ in schema)


# ---------------------------------------------------------------- C1-C3
@register("drop_empty_rows", sql=f"WITH {_ED} SELECT * FROM src WHERE NOT ({_all_null(SCHEMAS['empty_dup'])})")
def drop_empty_rows(spark, sf_dir):
    """Rows that are not entirely NULL."""
    return pr.drop_empty_rows(fx.empty_dup(spark, sf_dir))


@register("drop_duplicate_rows", sql=f"WITH {_ED} SELECT DISTINCT * FROM src")
def drop_duplicate_rows(spark, sf_dir):
    """Exact duplicates removed (NULL rows compare equal)."""
    return pr.drop_duplicate_rows(fx.empty_dup(spark, sf_dir))


@register("duplicate_report", sql=f"""WITH {_ED}
SELECT (SELECT count(*) FROM src) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS rows_after,
       (SELECT count(*) FROM src) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS duplicates_removed""")
def duplicate_report(spark, sf_dir):
    """C2 report: rows before/after de-duplication and the number removed."""
    return pr.duplicate_report(fx.empty_dup(spark, sf_dir))


@register("drop_incomplete_rows", sql=f"""WITH {_GAPS}
SELECT event_id, user_id, event_type, value, bonus FROM src
WHERE event_type IS NOT NULL AND value IS NOT NULL AND bonus IS NOT NULL""")
def drop_incomplete_rows(spark, sf_dir):
    """Rows without any NULL."""
    return pr.drop_incomplete_rows(fx.gaps(spark, sf_dir)).drop("ts")


# ---------------------------------------------------------------- C4-C8
def _summary_sql(src: str, schema) -> str:
    n = len(schema)
    miss = " + ".join(f"count_if({c} IS NULL)" for c, _ in schema)
    return f"""SELECT rows, {n}::BIGINT AS columns, missing_cells,
       ROUND(CASE WHEN rows * {n} > 0 THEN missing_cells * 100.0 / (rows * {n}) END, 6) AS missing_pct,
       ROUND(100.0 - CASE WHEN rows * {n} > 0 THEN missing_cells * 100.0 / (rows * {n}) END, 6) AS completeness_pct
FROM (SELECT count(*) AS rows, CAST({miss} AS BIGINT) AS missing_cells FROM {src})"""


@register("dataset_summary", sql=f"WITH {_GAPS} {_summary_sql('src', SCHEMAS['gaps'])}", headline=True)
def dataset_summary(spark, sf_dir):
    """C4: rows, columns, missing cells and completeness of the gap fixture."""
    return pr.dataset_summary(fx.gaps(spark, sf_dir))


@register("column_profile_lineitem", sql=profile_sql("lineitem", SCHEMAS["lineitem"]), headline=True)
def column_profile_lineitem(spark, sf_dir):
    """Exact per-column non-null / null / distinct counts over all of lineitem."""
    return pr.column_profile(table(spark, sf_dir, "lineitem"))


@register("column_profile_gaps", sql=f"WITH {_GAPS} {profile_sql('src', SCHEMAS['gaps'])}")
def column_profile_gaps(spark, sf_dir):
    """C5 on a table with gaps."""
    return pr.column_profile(fx.gaps(spark, sf_dir))


@register("profile_merged_runs", sql=f"""WITH {_GAPS}, prof AS ({profile_sql('src', SCHEMAS['gaps'])})
SELECT position, feature, dtype, 2 AS runs, rows, non_null, null_count, 1 AS distinct_ok FROM prof""")
def profile_merged_runs(spark, sf_dir):
    """C5 over two stored runs (even and odd events): their sketches are written, read back and merged; counts of all
    rows, and whether each distinct count lies within four standard errors of the exact one."""
    g = fx.gaps(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}"
    for run, odd in (("even", 0), ("odd", 1)):
        write_table(pr.profile_sketch(g.where(F.col("event_id") % 2 == odd), run).drop("run_id"), folder, mode="append", run_id=run)
    merged = pr.merge_profiles(spark.read.parquet(folder))
    exact = pr.column_profile(g).select("feature", F.col("n_distinct").alias("exact"))
    off = F.abs(F.col("n_distinct") - F.col("exact")) <= 1 + 4 * pr.SKETCH_ERROR * F.col("exact")
    return merged.join(exact, "feature").select("position", "feature", "dtype", F.col("runs").cast("int").alias("runs"), "rows", "non_null", "null_count",
                                                off.cast("int").alias("distinct_ok"))


_PROF_GAPS = f"{_GAPS}, prof AS ({profile_sql('src', SCHEMAS['gaps'])})"


@register("missing_report", sql=f"""WITH {_PROF_GAPS}
SELECT feature, null_count AS missing_count, ROUND(null_count * 100.0 / rows, 6) AS missing_pct, dtype,
       non_null AS non_missing, n_distinct FROM prof WHERE null_count > 0""")
def missing_report(spark, sf_dir):
    """Columns with gaps, their missing count / % and distinct values."""
    return pr.missing_report(pr.column_profile(fx.gaps(spark, sf_dir)))


@register("missing_severity", sql=f"""WITH {_PROF_GAPS}, m AS (SELECT feature, null_count * 100.0 / rows AS pct FROM prof WHERE null_count > 0)
SELECT feature, ROUND(pct, 6) AS missing_pct, CAST(pct >= 70 AS INTEGER) AS is_critical, CAST(pct >= 50 AS INTEGER) AS is_high,
       CAST(pct >= 20 AS INTEGER) AS is_moderate,
       CASE WHEN pct >= 70 THEN 'critical' WHEN pct >= 50 THEN 'high' WHEN pct >= 20 THEN 'moderate' ELSE 'low' END AS badge
FROM m""")
def missing_severity(spark, sf_dir):
    """Cumulative severity flags and exclusive badge per column with gaps."""
    return pr.missing_severity(pr.column_profile(fx.gaps(spark, sf_dir)))


def _warn_sql(prof: str) -> str:
    return f"""SELECT feature, 'high_missing' AS code, ROUND(null_count * 100.0 / rows, 6) AS value FROM {prof}
WHERE rows > 0 AND null_count * 100.0 / rows > 50
UNION ALL SELECT feature, 'single_value', CAST(n_distinct AS DOUBLE) FROM {prof} WHERE n_distinct = 1"""


@register("quality_warnings", sql=f"WITH {_PROF_GAPS} {_warn_sql('prof')}")
def quality_warnings(spark, sf_dir):
    """> 50 % missing and single-valued columns (gap fixture)."""
    return pr.quality_warnings(pr.column_profile(fx.gaps(spark, sf_dir)))


@register("quality_warnings_numeric",
          sql=f"WITH {_NUM}, prof AS ({profile_sql('src', SCHEMAS['numeric'])}) {_warn_sql('prof')}")
def quality_warnings_numeric(spark, sf_dir):
    """C8 on lineitem measures with a constant column."""
    return pr.quality_warnings(pr.column_profile(fx.numeric(spark, sf_dir)))


@register("drop_sparse_plan", sql=f"""WITH {_PROF_GAPS}, m AS (SELECT *, coalesce(null_count * 100.0 / rows, 0.0) AS pct,
     (null_count * 100.0 / rows >= 70 AND null_count > 0) AS d FROM prof)
SELECT position, feature, ROUND(pct, 6) AS missing_pct, CASE WHEN d THEN 'drop' ELSE 'keep' END AS action,
       CAST(NOT d AND n_distinct BETWEEN 2 AND 10 AS INTEGER) AS candidate_target FROM m""")
def drop_sparse_plan(spark, sf_dir):
    """Which columns the >= 70 % policy drops and which candidate targets survive."""
    return pr.sparse_columns(pr.column_profile(fx.gaps(spark, sf_dir)), 70.0)


@register("sample_rows", sql="SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def sample_rows(spark, sf_dir):
    """First 10 customers by key (a top-k, the feature itself)."""
    return pr.sample_rows(table(spark, sf_dir, "customer"), 10, ["c_custkey"])


# ---------------------------------------------------------------- I1-I4
_NUMCOLS = ["value", "bonus"]


@register("impute_medians", sql=f"""WITH {_GAPS}
SELECT 'value' AS feature, ROUND(median(value), 6) AS value FROM src
UNION ALL SELECT 'bonus', ROUND(median(bonus), 6) FROM src""")
def impute_medians(spark, sf_dir):
    """Exact interpolated medians of the numeric columns with gaps."""
    return im.column_medians(fx.gaps(spark, sf_dir), _NUMCOLS)


@register("median_lineitem", sql="""
SELECT 'l_quantity' AS feature, ROUND(median(l_quantity), 6) AS value FROM lineitem
UNION ALL SELECT 'l_extendedprice', ROUND(median(l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_discount', ROUND(median(l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_partkey', ROUND(median(l_partkey), 6) FROM lineitem""", headline=True)
def median_lineitem(spark, sf_dir):
    """I1 statistic at scale: exact medians of four lineitem columns by distributed rank selection."""
    return im.column_medians(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"])


@register("impute_means", sql=f"""WITH {_GAPS}
SELECT 'value' AS feature, ROUND(avg(value), 6) AS value FROM src
UNION ALL SELECT 'bonus', ROUND(avg(bonus), 6) FROM src""")
def impute_means(spark, sf_dir):
    """Means of the numeric columns with gaps."""
    return im.column_means(fx.gaps(spark, sf_dir), _NUMCOLS)


@register("impute_modes", sql="""
WITH c AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS value, count(*) AS freq FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2
           UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY freq DESC, value) AS rn FROM c WHERE value IS NOT NULL)
SELECT feature, value, freq FROM r WHERE rn = 1""")
def impute_modes(spark, sf_dir):
    """Most frequent value (ties -> smallest) of three categorical order attributes."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return im.column_modes(j, ["o_orderpriority", "o_orderstatus", "c_mktsegment"])


_MODE_ET = "(SELECT event_type FROM src WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)"


@register("impute_smart", sql=f"""WITH {_GAPS}
SELECT event_id, user_id, coalesce(event_type, {_MODE_ET}) AS event_type,
       ROUND(coalesce(value, (SELECT median(value) FROM src)), 6) AS value,
       ROUND(coalesce(bonus, (SELECT median(bonus) FROM src)), 6) AS bonus
FROM src""")
def impute_smart(spark, sf_dir):
    """I4: median fill for numeric and mode fill for string columns (all rows)."""
    return im.impute(fx.gaps(spark, sf_dir), "median", "mode").drop("ts")


@register("impute_mean_mode", sql=f"""WITH {_GAPS}
SELECT event_id, user_id, coalesce(event_type, {_MODE_ET}) AS event_type,
       ROUND(coalesce(value, (SELECT avg(value) FROM src)), 6) AS value,
       ROUND(coalesce(bonus, (SELECT avg(bonus) FROM src)), 6) AS bonus
FROM src""")
def impute_mean_mode(spark, sf_dir):
    """I2+I3: mean fill for numeric and mode fill for string columns."""
    return im.impute(fx.gaps(spark, sf_dir), "mean", "mode").drop("ts")


# ---------------------------------------------------------------- I6, I7
@register("forward_fill", sql=f"""WITH {_GAPS}
SELECT event_id, user_id,
  last_value(event_type IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type,
  ROUND(last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value,
  ROUND(last_value(bonus IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS bonus
FROM src""", headline=True)
def forward_fill(spark, sf_dir):
    """Forward fill along event time over the whole table (two-phase, no single task)."""
    return im.forward_fill(fx.gaps(spark, sf_dir), ["ts"]).drop("ts")


@register("backward_fill", sql=f"""WITH {_GAPS}
SELECT event_id, user_id,
  first_value(event_type IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS event_type,
  ROUND(first_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value,
  ROUND(first_value(bonus IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bonus
FROM src""")
def backward_fill(spark, sf_dir):
    """Backward fill along event time over the whole table."""
    return im.backward_fill(fx.gaps(spark, sf_dir), ["ts"]).drop("ts")


@register("forward_fill_by_user", sql=f"""WITH {_GAPS}
SELECT event_id, user_id,
  last_value(event_type IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type,
  ROUND(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value,
  ROUND(last_value(bonus IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS bonus
FROM src""")
def forward_fill_by_user(spark, sf_dir):
    """I6 per user: forward fill within each user's event sequence (hot users split by range)."""
    return im.forward_fill(fx.gaps(spark, sf_dir), ["ts", "event_id"], ["user_id"]).drop("ts")


# ---------------------------------------------------------------- C10, C13
def _clean(spark, sf_dir):
    g = fx.gaps(spark, sf_dir)
    return g, im.clean(g, 70.0, "median", "mode")


@register("clean_pipeline", sql=f"""WITH {_GAPS}, s AS (SELECT DISTINCT * FROM src)
SELECT event_id, ts, user_id,
       coalesce(event_type, (SELECT event_type FROM s WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
       ROUND(coalesce(value, (SELECT median(value) FROM s)), 6) AS value
FROM s""")
def clean_pipeline(spark, sf_dir):
    """Drop empty rows, de-duplicate, drop >= 70 % missing columns, smart imputation."""
    return _clean(spark, sf_dir)[1]


@register("cleaning_summary", sql=f"""WITH {_GAPS}, s AS (SELECT DISTINCT * FROM src),
a AS (SELECT event_id, ts, user_id,
       coalesce(event_type, (SELECT event_type FROM s WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
       coalesce(value, (SELECT median(value) FROM s)) AS value FROM s)
SELECT 'before' AS stage, * FROM ({_summary_sql('src', SCHEMAS['gaps'])})
UNION ALL
SELECT 'after', * FROM ({_summary_sql('a', SCHEMAS['gaps'][:5])})""")
def cleaning_summary(spark, sf_dir):
    """Dataset summary before and after the cleaning pipeline."""
    before, after = _clean(spark, sf_dir)
    return pr.cleaning_summary(before, after)


@register("fill_check", sql=f"""WITH {_GAPS}, s AS (SELECT DISTINCT * FROM src),
a AS (SELECT event_id, ts, user_id,
       coalesce(event_type, (SELECT event_type FROM s WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
       coalesce(value, (SELECT median(value) FROM s)) AS value FROM s)
SELECT 'event_id' AS feature, count_if(event_id IS NULL) AS missing_left FROM a
UNION ALL SELECT 'ts', count_if(ts IS NULL) FROM a UNION ALL SELECT 'user_id', count_if(user_id IS NULL) FROM a
UNION ALL SELECT 'event_type', count_if(event_type IS NULL) FROM a UNION ALL SELECT 'value', count_if(value IS NULL) FROM a""")
def fill_check(spark, sf_dir):
    """Remaining NULLs per column after the cleaning pipeline (all zero when the fill worked)."""
    return im.fill_report(_clean(spark, sf_dir)[1])


# ---------------------------------------------------------------- I5
def knn_gaps(spark, sf_dir):
    """Customers with gaps in balance (key % 6 = 0) and nation (key % 9 = 0)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("a"),
                    F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("c_nationkey").cast("double")).alias("b"))


_KNN_SRC = """src AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS a,
                     CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS b FROM customer)"""


def _knn_fill_sql(target: str, other: str) -> str:
    # receivers miss `target`; only `other` can be shared, so m = 1 and n = 2
    return f"""(SELECT r.c_custkey, avg(d.{target}) AS v FROM (
      SELECT r.c_custkey, d.{target}, row_number() OVER (PARTITION BY r.c_custkey
             ORDER BY sqrt(2.0 * (r.{other} - d.{other}) * (r.{other} - d.{other})), d.c_custkey) AS rk
      FROM src r JOIN src d ON r.{target} IS NULL AND d.{target} IS NOT NULL AND r.{other} IS NOT NULL AND d.{other} IS NOT NULL
    ) d JOIN src r ON r.c_custkey = d.c_custkey WHERE rk <= 5 GROUP BY r.c_custkey)"""


@register("impute_knn", headline=True, sql=f"""WITH {_KNN_SRC}, fa AS {_knn_fill_sql('a', 'b')}, fb AS {_knn_fill_sql('b', 'a')}
SELECT s.c_custkey, ROUND(coalesce(s.a, fa.v, (SELECT avg(a) FROM src)), 6) AS a,
       ROUND(coalesce(s.b, fb.v, (SELECT avg(b) FROM src)), 6) AS b
FROM src s LEFT JOIN fa ON s.c_custkey = fa.c_custkey LEFT JOIN fb ON s.c_custkey = fb.c_custkey""")
def impute_knn(spark, sf_dir):
    """Exact 5-nearest-donor imputation (NaN-aware distance) of customer balance and nation."""
    return im.impute_knn(knn_gaps(spark, sf_dir), "c_custkey", k=5)
