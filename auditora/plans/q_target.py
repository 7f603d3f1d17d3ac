"""Target analysis and association queries."""

from __future__ import annotations

from ..functions import rules
from ..operators import target as tg
from ..operators.profile import column_profile
from ..session import table
from . import fixtures as fx
from .catalog import register, union_long
from .q_profile import SCHEMAS, profile_sql


@register("target_distribution", sql="""
SELECT o_orderstatus AS value, count(*) AS count,
       ROUND(ROUND(count(*) * 100.0 / (SELECT count(*) FROM orders), 2), 6) AS percentage
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def target_distribution(spark, sf_dir):
    """Order status distribution (% of all orders)."""
    return tg.target_distribution(table(spark, sf_dir, "orders"), "o_orderstatus")


def _kind_sql(tbl: str, col: str) -> str:
    return f"""WITH dist AS (SELECT {col} AS value, ROUND(count(*) * 100.0 / (SELECT count(*) FROM {tbl}), 2) AS pct
                  FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_classes,
       CASE WHEN count(*) = 2 THEN 'binary' WHEN count(*) > 10 THEN 'many_class' ELSE 'multi_class' END AS kind,
       ROUND(min(pct), 6) AS min_class_pct, CAST(count(*) = 2 AND min(pct) < 10 AS INTEGER) AS imbalanced FROM dist"""


@register("target_kind_status", sql=_kind_sql("orders", "o_orderstatus"))
def target_kind_status(spark, sf_dir):
    """Task kind of the order status target."""
    return tg.target_kind(table(spark, sf_dir, "orders"), "o_orderstatus")


@register("target_kind_linestatus", sql=_kind_sql("lineitem", "l_linestatus"))
def target_kind_linestatus(spark, sf_dir):
    """Task kind of the (binary) line status target."""
    return tg.target_kind(table(spark, sf_dir, "lineitem"), "l_linestatus")


def _name_match_sql(col: str, kws) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{k}')" for k in kws) + ")"


def _cand_sql(tbl: str, schema) -> str:
    tops = []
    for c, _ in schema:
        tops.append(f"""SELECT '{c}' AS feature, string_agg(v || '(' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rk) AS sample_values
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rk
      FROM {tbl} WHERE {c} IS NOT NULL GROUP BY 1) WHERE rk <= 3""")
    return f"""WITH prof AS ({profile_sql(tbl, schema)}), tops AS ({' UNION ALL '.join(tops)})
SELECT p.position, p.feature, p.n_distinct, CAST({_name_match_sql('p.feature', rules.TARGET_KEYWORDS)} AS INTEGER) AS name_match,
       t.sample_values
FROM prof p JOIN tops t ON p.feature = t.feature WHERE p.n_distinct BETWEEN 2 AND 10"""


@register("candidate_targets", sql=_cand_sql("lineitem", SCHEMAS["lineitem"]))
def candidate_targets(spark, sf_dir):
    """Lineitem columns usable as targets with their top-3 values and name match."""
    return tg.candidate_targets(table(spark, sf_dir, "lineitem"))


@register("validate_target", sql=f"""WITH prof AS ({profile_sql('lineitem', SCHEMAS['lineitem'])}),
alts AS (SELECT string_agg(feature, ',' ORDER BY position) AS a FROM
         (SELECT * FROM prof WHERE n_distinct BETWEEN 2 AND 10 AND feature <> 'l_discount' ORDER BY position LIMIT 5))
SELECT feature, n_distinct AS n_classes, CAST(is_numeric AS INTEGER) AS is_numeric,
       CASE WHEN n_distinct < 2 THEN 'reject_too_few' WHEN n_distinct > 20 THEN 'reject_too_many'
            WHEN is_numeric AND n_distinct > 10 THEN 'reject_continuous' WHEN n_distinct > 10 THEN 'warn_many_classes'
            ELSE 'ok' END AS status, (SELECT a FROM alts) AS alternatives
FROM prof WHERE feature = 'l_discount'""")
def validate_target(spark, sf_dir):
    """Validate l_discount as a target (numeric, 11 values) and list alternatives."""
    return tg.validate_target(table(spark, sf_dir, "lineitem"), "l_discount")


_D = f"d AS ({fx.DECISIONS_SQL})"


@register("crosstab", sql=f"""WITH {_D}, lg AS ({union_long('d', ['s1', 's2', 's3'], 'status')}),
o AS (SELECT feature, grp, status AS value, count(*) AS n FROM lg WHERE grp IS NOT NULL AND status IS NOT NULL GROUP BY ALL)
SELECT feature, grp, value, n, ROUND(n * 1.0 / sum(n) OVER (PARTITION BY feature, grp), 6) AS share FROM o""")
def crosstab(spark, sf_dir):
    """P(order status | segment / priority / region)."""
    return tg.crosstab(fx.decisions(spark, sf_dir), ["s1", "s2", "s3"], "status")


_CHI_FEATS = ["s1", "s2", "s3", "p"]


@register("chi_square", headline=True, sql=f"""WITH {_D}, lg AS ({union_long('d', _CHI_FEATS, 'y')}),
o AS (SELECT feature, grp, CAST(y AS VARCHAR) AS t, count(*) AS o FROM lg WHERE grp IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
r AS (SELECT feature, grp, sum(o) AS r FROM o GROUP BY ALL),
c AS (SELECT feature, t, sum(o) AS c FROM o GROUP BY ALL),
rs AS (SELECT feature, count(*) AS nr, sum(r) AS n, sum(1.0 / r) AS inv_r FROM r GROUP BY feature),
cs AS (SELECT feature, count(*) AS nc, sum(1.0 / c) AS inv_c FROM c GROUP BY feature),
s AS (SELECT o.feature, sum(CAST(o.o AS DOUBLE) * o.o / (CAST(r.r AS DOUBLE) * c.c)) AS q,
             max(abs(o.o - CAST(r.r AS DOUBLE) * c.c / rs.n)) AS d
      FROM o JOIN r USING (feature, grp) JOIN c USING (feature, t) JOIN rs USING (feature) GROUP BY o.feature)
SELECT feature,
       ROUND(CASE WHEN (nr - 1) * (nc - 1) = 0 THEN 0.0
                  WHEN (nr - 1) * (nc - 1) = 1 THEN pow(d - least(0.5, d), 2) * n * inv_r * inv_c
                  ELSE n * (q - 1) END, 6) AS chi2,
       CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n
FROM s JOIN rs USING (feature) JOIN cs USING (feature)""")
def chi_square(spark, sf_dir):
    """Chi-square statistic (Yates for 2x2) of fulfilment vs segment, priority, region and decision."""
    return tg.chi_square(fx.decisions(spark, sf_dir), _CHI_FEATS, "y")


@register("chi_square_test")
def chi_square_test(spark, sf_dir):
    """Chi-square with p-values (regularised incomplete gamma) and the p < 0.05 flag."""
    return tg.chi_square_test(fx.decisions(spark, sf_dir), _CHI_FEATS, "y")


@register("column_profile_customer", sql=profile_sql("customer", SCHEMAS["customer"]))
def column_profile_customer(spark, sf_dir):
    """C5 on customer."""
    return column_profile(table(spark, sf_dir, "customer"))

