"""Fairness queries (F1-F16) over the decision fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as fa
from ..session import table
from . import fixtures as fx
from .catalog import register, union_long

SENS = ["s1", "s2", "s3"]
_D = f"d AS ({fx.DECISIONS_SQL})"
_LONG = f"lg AS ({union_long('d', SENS, 'y, p')})"
_COUNTS = """g AS (
  SELECT feature, grp, count(*) AS n,
         count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 1) AS fp,
         count_if(y = 0 AND p = 0) AS tn, count_if(y = 1 AND p = 0) AS fn,
         avg(p) AS sel
  FROM lg WHERE grp IS NOT NULL GROUP BY feature, grp)"""
_ZERO = """m AS (
  SELECT *, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS tpr,
            CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0.0 END AS fpr,
            CASE WHEN tp + fn > 0 AND fp + tn > 0 AND tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS prec,
            CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS tpr_nat,
            CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0.0 END AS fpr_nat
  FROM g)"""
_SUMMARY = """s AS (
  SELECT feature, count(*) AS n_groups, max(sel) - min(sel) AS dp, max(tpr) - min(tpr) AS eo,
         greatest(max(tpr_nat) - min(tpr_nat), max(fpr_nat) - min(fpr_nat)) AS eo_std,
         CASE WHEN max(tpr) > 0 THEN min(tpr) / max(tpr) ELSE 1.0 END AS eq_opp
  FROM m GROUP BY feature HAVING count(*) >= 2)"""


def _decisions(spark, sf_dir):
    return fx.decisions(spark, sf_dir)


@register("fair_group_metrics", sql=f"""
WITH {_D}, {_LONG}, {_COUNTS}, {_ZERO}
SELECT feature, grp, n, tp, fp, tn, fn, ROUND(tpr, 6) AS tpr, ROUND(fpr, 6) AS fpr, ROUND(prec, 6) AS precision,
       ROUND(sel, 6) AS selection_rate
FROM m""", headline=True)
def fair_group_metrics(spark, sf_dir):
    """confusion counts and rates per (feature, group) for three sensitive attributes."""
    return fa.group_metrics(_decisions(spark, sf_dir), "y", "p", SENS, single_class="zero")


@register("fair_summary", sql=f"""
WITH {_D}, {_LONG}, {_COUNTS}, {_ZERO}, {_SUMMARY}
SELECT feature, n_groups, ROUND(dp, 6) AS demographic_parity, ROUND(eo, 6) AS equalized_odds,
       ROUND(eo_std, 6) AS equalized_odds_std, ROUND(eq_opp, 6) AS equal_opportunity,
       CAST(dp > 0.1 AS INTEGER) AS dp_high, CAST(eo > 0.1 AS INTEGER) AS eo_high
FROM s""", headline=True)
def fair_summary(spark, sf_dir):
    """Demographic parity, equalized odds (two modes), equal opportunity, flags."""
    c = fa.group_counts(_decisions(spark, sf_dir), "y", "p", SENS)
    return fa.fairness_summary(c)


_SEV = "CASE WHEN dp > 0.2 OR eo > 0.2 THEN 'High' WHEN dp > 0.1 OR eo > 0.1 THEN 'Medium' ELSE 'Low' END"


@register("fair_bias_report", sql=f"""
WITH {_D}, {_LONG}, {_COUNTS}, {_ZERO}, {_SUMMARY}
SELECT feature, ROUND(dp, 6) AS demographic_parity, ROUND(eo, 6) AS equalized_odds, {_SEV} AS severity FROM s""")
def fair_bias_report(spark, sf_dir):
    """bias severity per sensitive feature."""
    c = fa.group_counts(_decisions(spark, sf_dir), "y", "p", SENS)
    return fa.bias_report(fa.fairness_summary(c))


# The doc-label fixture has small groups, so findings and mitigation rows actually appear.
_DL = f"d AS ({fx.DOC_LABELS_SQL})"
_DL_LONG = f"lg AS ({union_long('d', ['lang', 'source'], 'y, p')})"


@register("fair_findings", sql=f"""
WITH {_DL}, {_DL_LONG}, {_COUNTS}, {_ZERO}, {_SUMMARY},
f AS (
  SELECT feature, 1 AS priority, 'high_demographic_parity' AS code,
         printf('%s: High demographic parity difference (%.3f). Consider pre-processing interventions or demographic parity constraints.', feature, dp) AS message
  FROM s WHERE dp > 0.1
  UNION ALL
  SELECT feature, 2, 'high_equalized_odds',
         printf('%s: High equalized odds difference (%.3f). Consider post-processing threshold optimization.', feature, eo)
  FROM s WHERE eo > 0.1)
SELECT * FROM f""")
def fair_findings(spark, sf_dir):
    """bias recommendations per feature on labelled documents (lang, source)."""
    c = fa.group_counts(fx.doc_labels(spark, sf_dir), "y", "p", ["lang", "source"])
    return fa.bias_findings(fa.fairness_summary(c))


@register("fair_mitigation", sql=f"""
WITH {_DL}, {_DL_LONG}, {_COUNTS}, {_ZERO}, {_SUMMARY},
r AS (SELECT feature, dp, eo FROM s WHERE ({_SEV}) IN ('Medium', 'High'))
SELECT feature, 'pre_processing' AS stage, 1 AS position, 'Resampling techniques for ' || feature AS strategy FROM r
UNION ALL SELECT feature, 'pre_processing', 2, 'Synthetic data generation for underrepresented groups in ' || feature FROM r
UNION ALL SELECT feature, 'pre_processing', 3, 'Feature selection to reduce correlation with ' || feature FROM r
UNION ALL SELECT feature, 'in_processing', 1, 'Demographic parity constraint during training for ' || feature FROM r WHERE dp > 0.1
UNION ALL SELECT feature, 'in_processing', 2, 'Equalized odds constraint during training for ' || feature FROM r WHERE eo > 0.1
UNION ALL SELECT feature, 'post_processing', 1, 'Threshold optimization for ' || feature FROM r
UNION ALL SELECT feature, 'post_processing', 2, 'Calibration techniques for ' || feature || ' groups' FROM r""")
def fair_mitigation(spark, sf_dir):
    """mitigation strategies for Medium/High severity features on labelled documents."""
    c = fa.group_counts(fx.doc_labels(spark, sf_dir), "y", "p", ["lang", "source"])
    return fa.mitigation_plan(fa.bias_report(fa.fairness_summary(c)))


@register("fair_app_table", sql=f"""
WITH {_D}, {_LONG}, {_COUNTS}
SELECT feature, grp, n, ROUND(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy, ROUND(sel, 6) AS positive_rate,
       ROUND(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 6) AS tpr
FROM g""")
def fair_app_table(spark, sf_dir):
    """F8: the application's per-group accuracy / positive rate / TPR table."""
    return fa.app_group_table(_decisions(spark, sf_dir), "y", "p", SENS, by=())


def _pairs_sql(src: str, cols: list[str], keep: str) -> str:
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            parts.append(f"SELECT {keep}, '{a}' AS feature1, '{b}' AS feature2, CAST({a} AS VARCHAR) AS v1, "
                         f"CAST({b} AS VARCHAR) AS v2 FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("fair_intersectional", sql=f"""
WITH {_DL}, pr AS ({_pairs_sql('d', ['lang', 'source'], 'y, p')}),
g AS (SELECT feature1, feature2, v1 || '_' || v2 AS grp, count(*) AS n, count(DISTINCT y) AS k,
             avg(CAST(y = p AS INTEGER)) AS accuracy, avg(CASE WHEN y = 1 THEN CAST(p AS DOUBLE) END) AS tpr
      FROM pr WHERE v1 IS NOT NULL AND v2 IS NOT NULL GROUP BY feature1, feature2, v1 || '_' || v2)
SELECT feature1, feature2, grp, n, ROUND(accuracy, 6) AS accuracy, ROUND(coalesce(tpr, 0.0), 6) AS tpr
FROM g WHERE n > 10 AND k > 1""")
def fair_intersectional(spark, sf_dir):
    """intersectional accuracy/TPR for lang x source cells with more than 10 documents."""
    return fa.intersectional_metrics(fx.doc_labels(spark, sf_dir), "y", "p", ["lang", "source"])


@register("fair_intersectional_orders", sql=f"""
WITH {_D}, pr AS ({_pairs_sql('d', SENS, 'y, p')}),
g AS (SELECT feature1, feature2, v1 || '_' || v2 AS grp, count(*) AS n, count(DISTINCT y) AS k,
             avg(CAST(y = p AS INTEGER)) AS accuracy, avg(CASE WHEN y = 1 THEN CAST(p AS DOUBLE) END) AS tpr
      FROM pr WHERE v1 IS NOT NULL AND v2 IS NOT NULL GROUP BY feature1, feature2, v1 || '_' || v2)
SELECT feature1, feature2, grp, n, ROUND(accuracy, 6) AS accuracy, ROUND(coalesce(tpr, 0.0), 6) AS tpr
FROM g WHERE n > 10 AND k > 1""")
def fair_intersectional_orders(spark, sf_dir):
    """F13 on orders: every pair of segment, priority and region."""
    return fa.intersectional_metrics(_decisions(spark, sf_dir), "y", "p", SENS)


_VERDICT = "CASE WHEN abs(dp) < 0.1 THEN 'good' WHEN abs(dp) < 0.2 THEN 'moderate' ELSE 'high' END"


@register("label_parity", sql=f"""
WITH {_D}, {_LONG},
r AS (SELECT feature, grp, avg(CAST(y AS DOUBLE)) AS rate FROM lg WHERE grp IS NOT NULL GROUP BY feature, grp),
s AS (SELECT feature, count(*) AS n_groups, CASE WHEN count(*) >= 2 THEN max(rate) - min(rate) ELSE 0.0 END AS dp
      FROM r GROUP BY feature)
SELECT feature, n_groups, ROUND(dp, 6) AS demographic_parity, {_VERDICT} AS verdict FROM s""")
def label_parity(spark, sf_dir):
    """Label-based demographic parity (order fulfilled rate) by segment/priority/region."""
    return fa.label_parity(_decisions(spark, sf_dir), "y", SENS)


@register("label_parity_docs", sql=f"""
WITH {_DL}, {_DL_LONG},
r AS (SELECT feature, grp, avg(CAST(y AS DOUBLE)) AS rate FROM lg WHERE grp IS NOT NULL GROUP BY feature, grp),
s AS (SELECT feature, count(*) AS n_groups, CASE WHEN count(*) >= 2 THEN max(rate) - min(rate) ELSE 0.0 END AS dp
      FROM r GROUP BY feature)
SELECT feature, n_groups, ROUND(dp, 6) AS demographic_parity, {_VERDICT} AS verdict FROM s""")
def label_parity_docs(spark, sf_dir):
    """F14/F16 on labelled documents: quality rate by language and source."""
    return fa.label_parity(fx.doc_labels(spark, sf_dir), "y", ["lang", "source"])


@register("label_intersectional", sql=f"""
WITH {_D}, pr AS ({_pairs_sql('d', SENS, 'y')}),
c AS (SELECT feature1, feature2, v1, v2, count(*) AS n, avg(CAST(y AS DOUBLE)) AS rate
      FROM pr WHERE v1 IS NOT NULL AND v2 IS NOT NULL GROUP BY ALL HAVING count(*) > 10),
p AS (SELECT feature1, feature2, count(*) AS n_groups, max(rate) - min(rate) AS bias FROM c
      GROUP BY feature1, feature2 HAVING count(*) > 1)
SELECT feature1, feature2, n_groups, ROUND(bias, 6) AS bias_difference,
       ROUND(greatest(max(bias) OVER (), 0.0), 6) AS max_bias,
       CAST(greatest(max(bias) OVER (), 0.0) > 0.2 AS INTEGER) AS alert
FROM p""")
def label_intersectional(spark, sf_dir):
    """Label-based intersectional gaps for every attribute pair and the max gap."""
    return fa.label_intersectional(_decisions(spark, sf_dir), "y", SENS)


@register("positive_label", sql="""
SELECT count(*) AS n_classes, CAST(max(v) AS VARCHAR) AS pos_label
FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus IS NOT NULL)""")
def positive_label(spark, sf_dir):
    """positive label of the order status outcome."""
    return fa.positive_label(table(spark, sf_dir, "orders"), "o_orderstatus")


@register("binarize_counts", sql="""
WITH b AS (SELECT l_returnflag, CAST(l_linestatus = (SELECT max(l_linestatus) FROM lineitem) AS INTEGER) AS y FROM lineitem)
SELECT l_returnflag, y, count(*) AS n FROM b GROUP BY l_returnflag, y""")
def binarize_counts(spark, sf_dir):
    """binarise the two-valued line status (larger value positive) and count per flag."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    b = fa.binarize(li, "l_linestatus", out_y="y")
    return b.groupBy("l_returnflag", "y").agg(F.count("*").alias("n"))
