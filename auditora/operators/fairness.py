"""Group and intersectional fairness metrics (F1-F16).

All metrics are one hash aggregation over a long (feature, group) view of the rows:
the sensitive columns are unpivoted with a narrow ``inline`` generator, so several
features cost one scan and one shuffle of *partial aggregates* (map-side combine keeps a
hot group from landing on one task), and the per-feature summaries are a second, tiny
aggregation over the group table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.common import safe_div, stack_columns


# ---------------------------------------------------------------- F1 / F2 labels
def binarize(df: DataFrame, y: str, pred: str | None = None, pos_label=None,
             out_y: str = "y", out_pred: str = "p") -> DataFrame:
    """0/1 labels.  Two distinct values that are not {0,1}: the larger one is positive.

    Values already in {0,1} (or with a count other than two) pass through as integers.
    ``pos_label`` overrides the rule.  The distinct-value probe is one small aggregate.
    """
    if pos_label is None:
        stats = df.agg(F.count_distinct(y).alias("k"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        if stats["k"] == 2 and {stats["lo"], stats["hi"]} != {0, 1}:
            pos_label = stats["hi"]
    cols = [c for c in df.columns if c not in (out_y, out_pred)]
    if pos_label is None:
        exprs = [F.col(y).cast("int").alias(out_y)]
        if pred is not None:
            exprs.append(F.col(pred).cast("int").alias(out_pred))
    else:
        exprs = [(F.col(y) == F.lit(pos_label)).cast("int").alias(out_y)]
        if pred is not None:
            exprs.append((F.col(pred) == F.lit(pos_label)).cast("int").alias(out_pred))
    return df.select(*cols, *exprs)


def positive_label(df: DataFrame, y: str) -> DataFrame:
    """the application's positive label rule as a one-row frame (n_classes, pos_label).

    {0,1} -> 1, {-1,1} -> 1, two other values -> the larger, more than two -> the largest.
    """
    vals = df.where(F.col(y).isNotNull()).select(F.col(y).alias("v")).distinct()
    agg = vals.agg(F.count("*").alias("n_classes"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return agg.select("n_classes", F.col("hi").cast("string").alias("pos_label"))


# ---------------------------------------------------------------- F3 group metrics
def _long_groups(df: DataFrame, sensitive: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return (df.select(*keep, F.inline(stack_columns(list(sensitive), "string", "feature", "grp")))
              .where(F.col("grp").isNotNull()))


def group_counts(df: DataFrame, y: str, pred: str, sensitive: Sequence[str],
                 by: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """Confusion counts per (by..., feature, group) for 0/1 columns ``y`` and ``pred``.

    One aggregation for every sensitive feature: rows are unpivoted in place (no shuffle),
    then partially aggregated before the exchange.  Rows with a NULL group are dropped
    (as a pandas group-by does).
    """
    long = _long_groups(df, sensitive, [*by, F.col(y).cast("int").alias("_y"), F.col(pred).cast("int").alias("_p")])
    aggs = [
        F.count("*").alias("n"),
        F.count_if((F.col("_y") == 1) & (F.col("_p") == 1)).alias("tp"),
        F.count_if((F.col("_y") == 0) & (F.col("_p") == 1)).alias("fp"),
        F.count_if((F.col("_y") == 0) & (F.col("_p") == 0)).alias("tn"),
        F.count_if((F.col("_y") == 1) & (F.col("_p") == 0)).alias("fn"),
        F.sum("_p").alias("n_pred_pos"),
        F.count("_p").alias("n_pred"),
    ]
    for name, col in (extra or {}).items():
        aggs.append(col.alias(name))
    return long.groupBy(*by, "feature", "grp").agg(*aggs)


def _rates(counts: DataFrame, single_class: str) -> DataFrame:
    pos = F.col("tp") + F.col("fn")
    neg = F.col("fp") + F.col("tn")
    both = (pos > 0) & (neg > 0)
    tpr = safe_div(F.col("tp"), pos)
    fpr = safe_div(F.col("fp"), neg)
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    if single_class == "zero":
        tpr, fpr, prec = (F.when(both, e).otherwise(F.lit(0.0)) for e in (tpr, fpr, prec))
    elif single_class != "natural":
        raise ValueError("single_class must be 'zero' or 'natural'")
    return counts.withColumns({
        "tpr": tpr,
        "fpr": fpr,
        "precision": prec,
        "selection_rate": safe_div(F.col("n_pred_pos"), F.col("n_pred"), None),
    })


def group_metrics(df: DataFrame, y: str, pred: str, sensitive: Sequence[str], by: Sequence[str] = (),
                  single_class: str = "zero", extra: dict[str, Column] | None = None) -> DataFrame:
    """Per-group tp, fp, tn, fn, TPR, FPR, precision, selection rate and n.

    ``single_class='zero'``: a group holding one class only gets TPR = FPR = precision = 0
    (library rule); ``'natural'``: rates are computed with 0 only for empty denominators.
    ``by`` adds keys such as ``model``.  ``extra`` maps names to aggregate Columns over the
    long view's ``_y``/``_p`` columns (custom metrics hook).
    """
    counts = group_counts(df, y, pred, sensitive, by, extra)
    out = _rates(counts, single_class)
    return out.select(*by, "feature", "grp", "n", "tp", "fp", "tn", "fn", "tpr", "fpr", "precision",
                      "selection_rate", *list(extra or {}))


# ---------------------------------------------------------------- F4-F7, F9 summaries
def fairness_summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F4/F5/F6/F7/F9 per (by..., feature) from a ``group_counts`` frame.

    * ``demographic_parity``: max - min selection rate
    * ``equalized_odds``: max - min TPR, TPR zero for single-class groups (library rule)
    * ``equalized_odds_std``: max(TPR gap, FPR gap) with natural rates
    * ``equal_opportunity``: min TPR / max TPR (1 when max is 0), library rule
    * ``dp_high`` / ``eo_high``: the > 0.1 acceptability flags
    Features with fewer than two groups are omitted.
    """
    z = _rates(counts.select(*by, "feature", "grp", "tp", "fp", "tn", "fn", "n_pred_pos", "n_pred"), "zero")
    pos = F.col("tp") + F.col("fn")
    neg = F.col("fp") + F.col("tn")
    z = z.withColumns({"tpr_nat": safe_div(F.col("tp"), pos), "fpr_nat": safe_div(F.col("fp"), neg)})
    s = z.groupBy(*by, "feature").agg(
        F.count("*").alias("n_groups"),
        (F.max("selection_rate") - F.min("selection_rate")).alias("demographic_parity"),
        (F.max("tpr") - F.min("tpr")).alias("equalized_odds"),
        F.greatest(F.max("tpr_nat") - F.min("tpr_nat"), F.max("fpr_nat") - F.min("fpr_nat")).alias("equalized_odds_std"),
        F.when(F.max("tpr") > 0, F.min("tpr") / F.max("tpr")).otherwise(F.lit(1.0)).alias("equal_opportunity"),
    ).where(F.col("n_groups") >= 2)
    return s.withColumns({
        "dp_high": (F.col("demographic_parity") > rules.BIAS_MEDIUM).cast("int"),
        "eo_high": (F.col("equalized_odds") > rules.BIAS_MEDIUM).cast("int"),
    })


def app_group_table(df: DataFrame, y: str, pred: str, sensitive: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """F8: the application's per-group table: accuracy, positive rate, TPR (0 when the group
    has no positives) and count, per (model, feature, group)."""
    c = group_counts(df, y, pred, sensitive, by)
    return c.select(*by, "feature", "grp", "n",
                    safe_div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                    safe_div(F.col("n_pred_pos"), F.col("n_pred")).alias("positive_rate"),
                    safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"))


def severity_expr(dp: Column, eo: Column) -> Column:
    return (F.when((dp > rules.BIAS_HIGH) | (eo > rules.BIAS_HIGH), F.lit("High"))
             .when((dp > rules.BIAS_MEDIUM) | (eo > rules.BIAS_MEDIUM), F.lit("Medium"))
             .otherwise(F.lit("Low")))


def bias_report(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """severity per feature (High if DP or EO > 0.2, Medium if > 0.1, else Low)."""
    return summary.select(*by, "feature", "demographic_parity", "equalized_odds",
                          severity_expr(F.col("demographic_parity"), F.col("equalized_odds")).alias("severity"))


def bias_findings(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """one finding row per feature and exceeded metric (DP > 0.1, EO > 0.1)."""
    dp, eo = F.col("demographic_parity"), F.col("equalized_odds")
    items = F.array_compact(F.array(
        F.when(dp > rules.BIAS_MEDIUM, F.struct(
            F.lit(1).alias("priority"), F.lit("high_demographic_parity").alias("code"),
            F.format_string("%s: High demographic parity difference (%.3f). Consider pre-processing interventions "
                            "or demographic parity constraints.", F.col("feature"), dp).alias("message"))),
        F.when(eo > rules.BIAS_MEDIUM, F.struct(
            F.lit(2).alias("priority"), F.lit("high_equalized_odds").alias("code"),
            F.format_string("%s: High equalized odds difference (%.3f). Consider post-processing threshold "
                            "optimization.", F.col("feature"), eo).alias("message"))),
    ))
    return summary.select(*by, "feature", F.inline(items))


def mitigation_plan(report: DataFrame) -> DataFrame:
    """pre/in/post-processing suggestions for Medium and High severity features."""
    f = F.col("feature")
    dp, eo = F.col("demographic_parity"), F.col("equalized_odds")

    def item(stage, pos, text, cond=None):
        s = F.struct(F.lit(stage).alias("stage"), F.lit(pos).alias("position"), text.alias("strategy"))
        return s if cond is None else F.when(cond, s)

    items = F.array_compact(F.array(
        item("pre_processing", 1, F.concat(F.lit("Resampling techniques for "), f)),
        item("pre_processing", 2, F.concat(F.lit("Synthetic data generation for underrepresented groups in "), f)),
        item("pre_processing", 3, F.concat(F.lit("Feature selection to reduce correlation with "), f)),
        item("in_processing", 1, F.concat(F.lit("Demographic parity constraint during training for "), f),
             dp > rules.BIAS_MEDIUM),
        item("in_processing", 2, F.concat(F.lit("Equalized odds constraint during training for "), f),
             eo > rules.BIAS_MEDIUM),
        item("post_processing", 1, F.concat(F.lit("Threshold optimization for "), f)),
        item("post_processing", 2, F.concat(F.lit("Calibration techniques for "), f, F.lit(" groups"))),
    ))
    return report.where(F.col("severity").isin("Medium", "High")).select("feature", F.inline(items))


# ---------------------------------------------------------------- F13 intersectional (predictions)
def _pair_structs(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"),
                 F.col(a).cast("string").alias("v1"), F.col(b).cast("string").alias("v2"))
        for a, b in pairs
    ])


def feature_pairs(sensitive: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(list(sensitive), 2))


def intersectional_metrics(df: DataFrame, y: str, pred: str, sensitive: Sequence[str],
                           min_count: int = rules.INTERSECTIONAL_MIN_COUNT) -> DataFrame:
    """for each ordered feature pair, groups ``v1_v2`` with n > min_count and both classes.

    accuracy = mean(y == pred); ``tpr`` = mean(pred) among rows with y == 1 (the
    application labels it precision).  One Generate + one aggregation for all pairs.
    Rows where either value is NULL are excluded.
    """
    pairs = feature_pairs(sensitive)
    if not pairs:
        raise ValueError("need at least two sensitive features")
    long = (df.select(F.col(y).alias("_y"), F.col(pred).alias("_p"), F.inline(_pair_structs(pairs)))
              .where(F.col("v1").isNotNull() & F.col("v2").isNotNull())
              .withColumn("grp", F.concat_ws("_", "v1", "v2")))
    g = long.groupBy("feature1", "feature2", "grp").agg(
        F.count("*").alias("n"),
        F.count_distinct("_y").alias("_classes"),
        F.avg((F.col("_y") == F.col("_p")).cast("double")).alias("accuracy"),
        F.avg(F.when(F.col("_y") == 1, F.col("_p").cast("double"))).alias("_tpr"),
    )
    return (g.where((F.col("n") > min_count) & (F.col("_classes") > 1))
             .select("feature1", "feature2", "grp", "n", "accuracy",
                     F.coalesce(F.col("_tpr"), F.lit(0.0)).alias("tpr")))


# ---------------------------------------------------------------- F14-F16 label-based
def label_group_rates(df: DataFrame, target: str, sensitive: Sequence[str]) -> DataFrame:
    """Mean target per (feature, group), NULL groups excluded."""
    long = _long_groups(df, sensitive, [F.col(target).cast("double").alias("_t")])
    return long.groupBy("feature", "grp").agg(F.count("*").alias("n"), F.avg("_t").alias("rate"))


def label_parity(df: DataFrame, target: str, sensitive: Sequence[str]) -> DataFrame:
    """Label-based demographic parity per feature and its verdict band.

    demographic_parity = max - min of the group means (0 with fewer than two groups);
    verdict: < 0.1 good, < 0.2 moderate, else high.
    """
    rates = label_group_rates(df, target, sensitive)
    s = rates.groupBy("feature").agg(F.count("*").alias("n_groups"),
                                      (F.max("rate") - F.min("rate")).alias("_gap"))
    dp = F.when(F.col("n_groups") >= 2, F.col("_gap")).otherwise(F.lit(0.0))
    return s.select("feature", "n_groups", dp.alias("demographic_parity")).withColumn(
        "verdict", label_verdict(F.col("demographic_parity")))


def label_verdict(dp: Column) -> Column:
    a = F.abs(dp)
    return F.when(a < rules.BIAS_MEDIUM, F.lit("good")).when(a < rules.BIAS_HIGH, F.lit("moderate")).otherwise(F.lit("high"))


def label_intersectional_rates(df: DataFrame, target: str, sensitive: Sequence[str],
                               min_count: int = rules.INTERSECTIONAL_MIN_COUNT) -> DataFrame:
    """F15 (groups): mean target per pair cell with more than ``min_count`` rows, non-NULL keys."""
    pairs = feature_pairs(sensitive)
    long = (df.select(F.col(target).cast("double").alias("_t"), F.inline(_pair_structs(pairs)))
              .where(F.col("v1").isNotNull() & F.col("v2").isNotNull()))
    g = long.groupBy("feature1", "feature2", "v1", "v2").agg(F.count("*").alias("n"), F.avg("_t").alias("rate"))
    return g.where(F.col("n") > min_count)


def label_intersectional(df: DataFrame, target: str, sensitive: Sequence[str],
                         min_count: int = rules.INTERSECTIONAL_MIN_COUNT) -> DataFrame:
    """Per feature pair the gap between the highest and lowest cell rate (pairs with
    more than one qualifying cell), plus ``max_bias`` over all pairs and the > 0.2 alert."""
    r = label_intersectional_rates(df, target, sensitive, min_count)
    p = (r.groupBy("feature1", "feature2")
          .agg(F.count("*").alias("n_groups"), (F.max("rate") - F.min("rate")).alias("bias_difference"))
          .where(F.col("n_groups") > 1))
    from pyspark.sql import Window
    w = Window.partitionBy()  # tiny: one row per feature pair
    return p.withColumns({
        "max_bias": F.greatest(F.max("bias_difference").over(w), F.lit(0.0)),
    }).withColumn("alert", (F.col("max_bias") > rules.BIAS_HIGH).cast("int"))
