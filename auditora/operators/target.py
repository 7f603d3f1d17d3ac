"""Target analysis and association tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.common import materialize, stack_columns
from .profile import column_profile


# ------------------------------------------------------------------ T1 / T2
def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Value, count (NULLs not listed) and % of *all* rows rounded to 2, by value.

    The row total is a scalar subquery (no join, no single-partition window).
    """
    total = df.select(F.count("*")).scalar()
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("value")).agg(F.count("*").alias("count"))
    return counts.select("value", "count", F.round(F.col("count") * 100.0 / total, 2).alias("percentage")).orderBy("value")


def target_kind(df: DataFrame, target: str) -> DataFrame:
    """Number of classes, task kind (binary / multi_class / many_class), smallest class %
    and the imbalance flag (binary and smallest class < 10 %)."""
    dist = target_distribution(df, target)
    a = dist.agg(F.count("*").alias("n_classes"), F.min("percentage").alias("min_class_pct"))
    kind = (F.when(F.col("n_classes") == 2, "binary").when(F.col("n_classes") > 10, "many_class")
             .otherwise("multi_class"))
    return a.select("n_classes", kind.alias("kind"), "min_class_pct",
                    ((F.col("n_classes") == 2) & (F.col("min_class_pct") < 10)).cast("int").alias("imbalanced"))


# ------------------------------------------------------------------ T3 / T4 / T6
def _name_match(col, keywords: Sequence[str]):
    low = F.lower(col)
    cond = F.lit(False)
    for k in keywords:
        cond = cond | low.contains(k)
    return cond


def candidate_targets(df: DataFrame, profile: DataFrame | None = None, top: int = 3) -> DataFrame:
    """Columns with 2..10 distinct values, their top-``top`` values as ``v(count)``
    (count desc, value asc) and whether the name looks like an outcome.

    The candidate list is read from the one-row-per-column profile; value counts of the
    candidates are one aggregation over an unpivoted view.
    """
    prof = profile if profile is not None else column_profile(df)
    cands = [r["feature"] for r in prof.where(F.col("n_distinct").between(2, 10)).orderBy("position")
             .select("feature").collect()]
    info = prof.select("position", "feature", "n_distinct",
                       _name_match(F.col("feature"), rules.TARGET_KEYWORDS).cast("int").alias("name_match"))
    if not cands:
        return info.where(F.lit(False)).withColumn("sample_values", F.lit(None).cast("string"))
    long = df.select(F.inline(stack_columns(cands, "string", "feature", "value"))).where(F.col("value").isNotNull())
    vc = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")  # at most 10 rows per column
    topk = vc.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top)
    agg = topk.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("rk", "value", "n"))).alias("t"))
    txt = F.array_join(F.transform("t", lambda s: F.concat(s["value"], F.lit("("), s["n"].cast("string"), F.lit(")"))), ", ")
    return info.join(agg.select("feature", txt.alias("sample_values")), "feature").select(
        "position", "feature", "n_distinct", "name_match", "sample_values")


def likely_targets(profile: DataFrame) -> DataFrame:
    """T4: columns whose lower-cased name contains an outcome word."""
    return profile.where(_name_match(F.col("feature"), rules.TARGET_KEYWORDS)).select("position", "feature")


def loan_targets(profile: DataFrame) -> DataFrame:
    """T4, loan tables: (position, feature, n_distinct) of the outcome columns of a table that has a
    column named after loans; no rows for other tables."""
    about = profile.where(F.contains(F.lower("feature"), F.lit("loan"))).agg(F.count(F.lit(1)).alias("n"))
    hits = profile.where(_name_match(F.col("feature"), rules.LOAN_TARGET_KEYWORDS))
    return hits.where(about.select("n").scalar() > 0).select("position", "feature", "n_distinct")


# ------------------------------------------------------------------ T5 / T6
def validate_target(df: DataFrame, target: str, profile: DataFrame | None = None, n_alternatives: int = 5) -> DataFrame:
    """One row: distinct count, numeric flag, status and up to 5 alternatives.

    status: reject_too_few (< 2), reject_too_many (> 20), reject_continuous (numeric and > 10),
    warn_many_classes (11..20 non-numeric), ok.
    """
    prof = profile if profile is not None else column_profile(df)
    t = prof.where(F.col("feature") == target)
    alts = (prof.where(F.col("n_distinct").between(2, 10) & (F.col("feature") != target))
                .agg(F.slice(F.sort_array(F.collect_list(F.struct("position", "feature"))), 1, n_alternatives)
                     .alias("a")))
    alt_names = F.transform(F.col("a"), lambda s: s["feature"])
    k = F.col("n_distinct")
    status = (F.when(k < 2, "reject_too_few").when(k > 20, "reject_too_many")
               .when(F.col("is_numeric") & (k > 10), "reject_continuous").when(k > 10, "warn_many_classes")
               .otherwise("ok"))
    joined = t.withColumn("a", alts.select("a").scalar())
    return joined.select("feature", k.alias("n_classes"), F.col("is_numeric").cast("int").alias("is_numeric"),
                         status.alias("status"), F.array_join(alt_names, ",").alias("alternatives"))


# ------------------------------------------------------------------ T7
def suggest_sensitive(df: DataFrame, max_fallback: int = 2) -> list[str]:
    """Default sensitive columns (string columns whose name contains a demographic word;
    else at most two with gender/sex/race/ethnicity).  Schema only."""
    from ..functions.common import string_columns
    cats = string_columns(df)
    first = [c for c in cats if any(k in c.lower() for k in rules.SENSITIVE_DEFAULT_KEYWORDS)]
    if first:
        return first
    return [c for c in cats if any(k in c.lower() for k in rules.SENSITIVE_FALLBACK_KEYWORDS)][:max_fallback]


# ------------------------------------------------------------------ T8 / T9
def contingency(df: DataFrame, groups: Sequence[str], target: str) -> DataFrame:
    """Observed counts per (feature, group, target value); rows with a NULL key dropped."""
    long = (df.select(F.col(target).cast("string").alias("t"), F.inline(stack_columns(list(groups), "string", "feature", "grp")))
              .where(F.col("grp").isNotNull() & F.col("t").isNotNull()))
    return long.groupBy("feature", "grp", "t").agg(F.count("*").alias("o"))


def crosstab(df: DataFrame, groups: Sequence[str], target: str) -> DataFrame:
    """P(target | group) per feature in long form (feature, grp, value, n, share)."""
    o = contingency(df, groups, target)
    w = Window.partitionBy("feature", "grp")
    return o.select("feature", "grp", F.col("t").alias("value"), F.col("o").alias("n"),
                    (F.col("o") / F.sum("o").over(w)).alias("share"))


def chi_square(df: DataFrame, groups: Sequence[str], target: str) -> DataFrame:
    """T9 statistic: per feature chi2, dof and N; Yates' correction when dof = 1.

    chi2 = N (sum O^2/(R C) - 1) over observed cells; for 2x2 tables every |O - E| equals
    d, so the corrected statistic is (d - min(0.5, d))^2 * N * (sum 1/R) * (sum 1/C).
    """
    o = materialize(contingency(df, groups, target))  # groups x classes cells, read three times
    rows_m = o.groupBy("feature", "grp").agg(F.sum("o").alias("r"))
    cols_m = o.groupBy("feature", "t").agg(F.sum("o").alias("c"))
    cells = o.join(rows_m, ["feature", "grp"]).join(cols_m, ["feature", "t"])
    rs = rows_m.groupBy("feature").agg(F.count("*").alias("nr"), F.sum("r").alias("n"), F.sum(1.0 / F.col("r")).alias("inv_r"))
    cs = cols_m.groupBy("feature").agg(F.count("*").alias("nc"), F.sum(1.0 / F.col("c")).alias("inv_c"))
    n = rs.select("feature", F.col("n").cast("double").alias("_n"))
    o_, r_, c_ = (F.col(x).cast("double") for x in ("o", "r", "c"))  # products overflow longs at scale
    d = F.abs(o_ - r_ * c_ / F.col("_n"))
    s = cells.join(n, "feature").groupBy("feature").agg(F.sum(o_ * o_ / (r_ * c_)).alias("q"), F.max(d).alias("d"))
    j = s.join(rs, "feature").join(cs, "feature")
    nn = F.col("n").cast("double")
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    plain = nn * (F.col("q") - 1)
    yates = F.pow(F.col("d") - F.least(F.lit(0.5), F.col("d")), 2) * nn * F.col("inv_r") * F.col("inv_c")
    stat = F.when(dof == 0, F.lit(0.0)).when(dof == 1, yates).otherwise(plain)
    return j.select("feature", stat.alias("chi2"), dof.cast("long").alias("dof"), F.col("n").alias("n"))


def _gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x) (series below a+1, continued fraction above)."""
    out = np.empty_like(x, dtype=float)
    for i, (ai, xi) in enumerate(zip(a, x)):
        if not (ai > 0) or xi is None or math.isnan(xi):
            out[i] = float("nan")
            continue
        if xi <= 0:
            out[i] = 1.0
            continue
        lg = math.lgamma(ai)
        if xi < ai + 1:
            term = 1.0 / ai
            total = term
            ap = ai
            for _ in range(10000):
                ap += 1
                term *= xi / ap
                total += term
                if abs(term) < abs(total) * 1e-15:
                    break
            out[i] = 1.0 - total * math.exp(-xi + ai * math.log(xi) - lg)
        else:
            tiny = 1e-300
            b = xi + 1 - ai
            c = 1 / tiny
            dd = 1 / b
            h = dd
            for k in range(1, 10000):
                an = -k * (k - ai)
                b += 2
                dd = an * dd + b
                dd = tiny if abs(dd) < tiny else dd
                c = b + an / c
                c = tiny if abs(c) < tiny else c
                dd = 1 / dd
                delta = dd * c
                h *= delta
                if abs(delta - 1) < 1e-15:
                    break
            out[i] = math.exp(-xi + ai * math.log(xi) - lg) * h
    return out


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Survival function of the chi-square distribution (Arrow batch, one row per feature)."""
    p = _gammaincc(dof.to_numpy(dtype=float) / 2.0, stat.to_numpy(dtype=float) / 2.0)
    p = np.where(dof.to_numpy() == 0, 1.0, p)
    return pd.Series(p)


def chi_square_test(df: DataFrame, groups: Sequence[str], target: str, alpha: float = 0.05) -> DataFrame:
    """chi2, dof, p-value and the p < alpha association flag per feature."""
    s = chi_square(df, groups, target)
    return s.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof"))).withColumn(
        "significant", (F.col("p_value") < alpha).cast("int"))
