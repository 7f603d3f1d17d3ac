"""Privacy queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.common import is_numeric
from ..operators import explain as ex
from ..operators import privacy as pv
from ..operators.profile import column_profile
from ..session import table
from . import fixtures as fx
from .catalog import register
from .q_profile import SCHEMAS, profile_sql

# The licence-plate pattern with \b spelled as explicit Unicode word boundaries, because
# DuckDB's RE2 \b is ASCII-only while Python's and Java's (?U) \b are Unicode-aware.
ORACLE_PATTERNS = dict(rules.PII_PATTERNS)
ORACLE_PATTERNS["license_plate"] = r"(?:^|[^\p{L}\p{N}_])[A-Z0-9]{2,3}[-\s]?[A-Z0-9]{3,4}(?:$|[^\p{L}\p{N}_])"

TEXT_SCHEMAS = {
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
}


def _pii_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for cat, pat in ORACLE_PATTERNS.items():
        for c in cols:
            parts.append(f"SELECT '{cat}' AS category, '{c}' AS column, count_if(coalesce(regexp_matches({c}, '{pat}'), false)) "
                         f"AS matches, ROUND(count_if(coalesce(regexp_matches({c}, '{pat}'), false)) * 100.0 / count(*), 6) "
                         f"AS percentage FROM {tbl}")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE matches > 0"


def _strings(schema):
    return [c for c, t in schema if t == "string"]


@register("pii_scan_documents", sql=_pii_sql("documents", _strings(TEXT_SCHEMAS["documents"])), headline=True)
def pii_scan_documents(spark, sf_dir):
    """Six personal-data patterns over every string column of documents (whole texts)."""
    return pv.scan_pii(table(spark, sf_dir, "documents"))


@register("pii_scan_pages", sql=_pii_sql("pages", _strings(TEXT_SCHEMAS["pages"])))
def pii_scan_pages(spark, sf_dir):
    """P1 over raw web pages (url, html)."""
    return pv.scan_pii(table(spark, sf_dir, "pages"))


@register("pii_scan_conversations", sql=_pii_sql("conversations", _strings(TEXT_SCHEMAS["conversations"])))
def pii_scan_conversations(spark, sf_dir):
    """P1 over conversation turns."""
    return pv.scan_pii(table(spark, sf_dir, "conversations"))


@register("pii_scan_orders", sql=_pii_sql("orders", _strings(SCHEMAS["orders"])))
def pii_scan_orders(spark, sf_dir):
    """P1 over the order status / priority strings."""
    return pv.scan_pii(table(spark, sf_dir, "orders"))


# ---------------------------------------------------------------- P2/P6 privacy risk
def _contains_sql(col: str, kws) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{k.lower()}')" for k in kws) + ")"


def _risk_sql(tbl: str, schema) -> str:
    cats = " + ".join(f"CASE WHEN {_contains_sql('feature', kws)} THEN 2 ELSE 0 END" for kws in rules.BASIC_KEYWORDS.values())
    ident = f"CASE WHEN {_contains_sql('feature', rules.IDENTIFIER_KEYWORDS)} THEN 3 ELSE 0 END"
    labels = "[" + ", ".join(f"'{x}'" for x in rules.RISK_LABELS) + "]"
    return f"""WITH prof AS ({profile_sql(tbl, schema)}),
s AS (SELECT position, feature, CASE WHEN rows > 0 THEN n_distinct * 1.0 / rows ELSE 0.0 END AS u FROM prof),
r AS (SELECT *, least((CASE WHEN u > 0.9 THEN 3 WHEN u > 0.5 THEN 2 WHEN u > 0.1 THEN 1 ELSE 0 END) + {cats} + {ident}, 5) AS risk FROM s)
SELECT position, feature, ROUND(u, 6) AS uniqueness, CAST(risk AS INTEGER) AS risk, ({labels})[risk + 1] AS risk_level FROM r"""


@register("privacy_risk_customer", sql=_risk_sql("customer", SCHEMAS["customer"]), headline=True)
def privacy_risk_customer(spark, sf_dir):
    """Privacy risk score and level per customer column."""
    return pv.privacy_risk(column_profile(table(spark, sf_dir, "customer")))


@register("privacy_risk_documents", sql=_risk_sql("documents", TEXT_SCHEMAS["documents"]))
def privacy_risk_documents(spark, sf_dir):
    """P2/P6 on documents."""
    return pv.privacy_risk(column_profile(table(spark, sf_dir, "documents")))


def _basic_cats_sql(tbl: str, schema) -> str:
    parts = []
    for cat, kws in rules.BASIC_KEYWORDS.items():
        parts.append(f"SELECT position, feature, '{cat}' AS category FROM prof WHERE {_contains_sql('feature', kws)}")
    return f"WITH prof AS ({profile_sql(tbl, schema)}) " + " UNION ALL ".join(parts)


@register("sensitive_names_basic", sql=_basic_cats_sql("events", TEXT_SCHEMAS["events"]))
def sensitive_names_basic(spark, sf_dir):
    """Basic sensitive categories matched by event column names (over its profile)."""
    return pv.name_categories(column_profile(table(spark, sf_dir, "events")), "basic")


@register("privacy_risk_events", sql=_risk_sql("events", TEXT_SCHEMAS["events"]))
def privacy_risk_events(spark, sf_dir):
    """P2/P6 on events."""
    return pv.privacy_risk(column_profile(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------- P3-P5 sensitive features
def _sensitive_sql(tbl: str, schema) -> str:
    name_parts, content_parts = [], []
    strings = [c for c, t in schema if t == "string"]
    for cat, kws in rules.EXTENDED_KEYWORDS.items():
        name_parts.append(f"SELECT '{cat}' AS category, feature, score, 'name' AS reason FROM ps WHERE {_contains_sql('feature', kws)}")
        for c in strings:
            hits = " + ".join(f"CAST(coalesce(bool_or(contains(lower({c}), '{k}')), false) AS INTEGER)" for k in kws)
            content_parts.append(f"SELECT '{cat}' AS category, '{c}' AS feature, ({hits}) / {float(len(kws))} AS score, "
                                 f"'content' AS reason FROM {tbl}")
    score = ("least(least(CASE WHEN rows > 0 THEN n_distinct * 3.0 / rows ELSE 0.0 END, 3.0) + "
             "CASE WHEN is_string THEN 1.0 ELSE 0.0 END + "
             "CASE WHEN rows > 0 AND null_count * 1.0 / rows > 0.1 THEN 1.0 ELSE 0.0 END, 5.0)")
    return f"""WITH prof AS ({profile_sql(tbl, schema)}), ps AS (SELECT feature, {score} AS score FROM prof),
nm AS ({' UNION ALL '.join(name_parts)}),
ct AS ({' UNION ALL '.join(content_parts)})
SELECT category, feature, ROUND(score, 6) AS score, reason FROM nm
UNION ALL
SELECT category, feature, ROUND(score, 6), reason FROM ct
WHERE score > 0.1 AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.feature = ct.feature AND nm.category = ct.category)"""


@register("sensitive_features_documents", sql=_sensitive_sql("documents", TEXT_SCHEMAS["documents"]))
def sensitive_features_documents(spark, sf_dir):
    """Sensitive columns of documents by name rules and by keyword content."""
    return pv.sensitive_features(table(spark, sf_dir, "documents"))


@register("sensitive_features_events", sql=_sensitive_sql("events", TEXT_SCHEMAS["events"]))
def sensitive_features_events(spark, sf_dir):
    """P3/P4/P5 over events (behavioural keywords occur in the event type values)."""
    return pv.sensitive_features(table(spark, sf_dir, "events"))


@register("sensitivity_scores_customer", sql=f"""WITH prof AS ({profile_sql('customer', SCHEMAS['customer'])})
SELECT position, feature, ROUND(least(least(n_distinct * 3.0 / rows, 3.0) + CASE WHEN is_string THEN 1.0 ELSE 0.0 END
       + CASE WHEN null_count * 1.0 / rows > 0.1 THEN 1.0 ELSE 0.0 END, 5.0), 6) AS sensitivity_score FROM prof""")
def sensitivity_scores_customer(spark, sf_dir):
    """P5: sensitivity score of every customer column."""
    return pv.sensitivity_scores(column_profile(table(spark, sf_dir, "customer")))


# ---------------------------------------------------------------- P7 / P8
def _qi_sql(tbl: str, schema) -> str:
    return f"""WITH prof AS ({profile_sql(tbl, schema)})
SELECT position, feature, ROUND(n_distinct * 1.0 / rows, 6) AS uniqueness FROM prof
WHERE (is_numeric OR is_string) AND rows > 0 AND n_distinct * 1.0 / rows > 0.01 AND n_distinct * 1.0 / rows < 0.9"""


@register("quasi_identifiers_orders", sql=_qi_sql("orders", SCHEMAS["orders"]))
def quasi_identifiers_orders(spark, sf_dir):
    """Order columns whose uniqueness lies strictly between 0.01 and 0.9."""
    return pv.quasi_identifiers(column_profile(table(spark, sf_dir, "orders")))


def _kanon_sql(src: str, qis: list[str], with_clause: str = "") -> str:
    parts = []
    for size in range(2, min(len(qis), 4) + 1):
        for combo in combinations(qis, size):
            cols = ", ".join(combo)
            nn = " AND ".join(f"{c} IS NOT NULL" for c in combo)
            parts.append(f"SELECT '{'+'.join(combo)}' AS combo, {size} AS size, min(n) AS k, count(*) AS n_groups "
                         f"FROM (SELECT {cols}, count(*) AS n FROM {src} WHERE {nn} GROUP BY {cols})")
    body = "\nUNION ALL\n".join(parts)
    return f"""{with_clause} SELECT combo, size, k, n_groups,
       CASE WHEN k IS NULL THEN NULL WHEN k = 1 THEN 'Critical' WHEN k < 3 THEN 'High' WHEN k < 5 THEN 'Medium' ELSE 'Low' END
       AS risk_level FROM ({body})"""


@register("k_anonymity_part", sql=_kanon_sql("part", ["p_brand", "p_type", "p_size"]), headline=True)
def k_anonymity_part(spark, sf_dir):
    """K-anonymity of every 2- and 3-combination of brand, type and size."""
    return pv.k_anonymity(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@register("k_anonymity_decisions",
          sql=_kanon_sql("d", ["s1", "s2", "s3", "o_month", "y"], f"WITH d AS ({fx.DECISIONS_SQL})"))
def k_anonymity_decisions(spark, sf_dir):
    """K-anonymity over 2..4-combinations of five order attributes (26 combinations)."""
    return pv.k_anonymity(fx.decisions(spark, sf_dir), ["s1", "s2", "s3", "o_month", "y"])


# ---------------------------------------------------------------- P9 generalisation
def _gen_sql(tbl: str, col: str, key: str) -> str:
    return f"""WITH st AS (SELECT min({col}) AS lo, max({col}) AS hi, greatest(3, count(DISTINCT {col}) // 3) AS bins,
                   count(DISTINCT {col}) * 1.0 / count(*) AS u FROM {tbl}),
edges AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = bins THEN hi ELSE i * ((hi - lo) / bins) + lo END AS e
          FROM st, range(0, st.bins + 1) r(i)),
codes AS (SELECT t.{key}, count(*) - 1 AS code FROM {tbl} t JOIN edges ON edges.e < t.{col} GROUP BY t.{key})
SELECT '{col}' AS feature, CAST((SELECT bins FROM st) AS INTEGER) AS bins, CAST(code AS INTEGER) AS code, count(*) AS n
FROM codes WHERE (SELECT u FROM st) > 0.1 AND (SELECT u FROM st) < 0.9 GROUP BY code"""


def _gen_hist(df, col):
    plan = pv.generalize_plan(df, 3)
    g = pv.anonymize_generalize(df, 3, plan)
    hist = g.groupBy(F.lit(col).alias("feature"), F.col(col).alias("code")).agg(F.count("*").alias("n")).where(
        F.col("code").isNotNull())
    # only a generalised column has codes: inner join with its plan row (one row at most)
    return hist.join(plan.select("feature", "bins"), "feature").select("feature", "bins", F.col("code").cast("int"), "n")


@register("generalize_part", sql=_gen_sql("part", "p_retailprice", "p_partkey"))
def generalize_part(spark, sf_dir):
    """Equal-width generalisation of part prices (uniqueness 0.1-0.9), code histogram."""
    return _gen_hist(table(spark, sf_dir, "part"), "p_retailprice")


@register("generalize_events", sql=_gen_sql("events", "value", "event_id"))
def generalize_events(spark, sf_dir):
    """Equal-width generalisation of event values, code histogram."""
    return _gen_hist(table(spark, sf_dir, "events"), "value")


@register("generalize_plan_events", sql="""
WITH s AS (SELECT 'value' AS feature, count(DISTINCT value) * 1.0 / count(*) AS u, greatest(3, count(DISTINCT value) // 3) AS bins,
                  min(value) AS lo, max(value) AS hi FROM events
           UNION ALL SELECT 'event_id', count(DISTINCT event_id) * 1.0 / count(*), greatest(3, count(DISTINCT event_id) // 3),
                  min(event_id), max(event_id) FROM events
           UNION ALL SELECT 'user_id', count(DISTINCT user_id) * 1.0 / count(*), greatest(3, count(DISTINCT user_id) // 3),
                  min(user_id), max(user_id) FROM events)
SELECT feature, CAST(bins AS INTEGER) AS bins, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi FROM s WHERE u > 0.1 AND u < 0.9""")
def generalize_plan_events(spark, sf_dir):
    """P9 plan: which numeric event columns are generalised and into how many bins."""
    return pv.generalize_plan(table(spark, sf_dir, "events"), 3)


def _edges_sql(name: str, col: str, bins: int) -> str:
    return f"""{name} AS (SELECT CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = {bins} THEN hi ELSE i * ((hi - lo) / {bins}) + lo END AS e
  FROM (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM part) st, range(0, {bins + 1}) r(i))"""


@register("generalization_check", sql=f"""WITH {_edges_sql('e1', 'p_retailprice', 4)}, {_edges_sql('e2', 'p_size', 5)},
c AS (SELECT p_retailprice AS a, p_size AS b, (SELECT count(*) FROM e1 WHERE e < p_retailprice) AS ca,
             (SELECT count(*) FROM e2 WHERE e < p_size) AS cb FROM part)
SELECT 'p_retailprice+p_size' AS combo, 2 AS size, (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY a, b)) AS k_before,
       (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY ca, cb)) AS k_after""")
def generalization_check(spark, sf_dir):
    """K-anonymity of part price and size before and after cutting them into 4 and 5 bins of equal width."""
    p = table(spark, sf_dir, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.lit(n).alias("bins"))
                     for c, n in (("p_retailprice", 4), ("p_size", 5))])
    return pv.generalization_check(p, plan=p.agg(rows.alias("r")).select(F.inline("r")))


# ---------------------------------------------------------------- P10 Laplace
_NOISED = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("laplace_noise_stats", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, 1 AS mean_ok, 1 AS variance_ok, 1 AS sign_ok FROM lineitem" for c in _NOISED))
def laplace_noise_stats(spark, sf_dir):
    """P10: Laplace(0, 1) noise on every numeric column of lineitem but the row key, in one pass; rows per column and
    whether mean, variance (2) and share of positive noise lie within five standard errors of the distribution's."""
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    cols = [f.name for f in li.schema.fields if is_numeric(f.dataType) and f.name not in keys]
    both = li.select(*keys, *cols, *[F.col(c).cast("double").alias(f"was_{c}") for c in cols])
    noisy = pv.anonymize_laplace(both, columns=cols, seed=42, keys=keys)
    items = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col(f"was_{c}")).alias("noise")) for c in cols])
    a = noisy.select(F.inline(items)).groupBy("feature").agg(F.count("*").alias("n"), F.avg("noise").alias("m"), F.var_samp("noise").alias("v"),
                                                            F.avg((F.col("noise") > 0).cast("double")).alias("p"))
    error = 5 / F.sqrt("n")  # fourth moment 24: the variance's standard error is sqrt(20 / n)
    return a.select("feature", "n", (F.abs("m") < error * 2 ** 0.5).cast("int").alias("mean_ok"),
                    (F.abs(F.col("v") - 2) < error * 20 ** 0.5).cast("int").alias("variance_ok"), (F.abs(F.col("p") - 0.5) < error * 0.5).cast("int").alias("sign_ok"))


# ---------------------------------------------------------------- P11-P14 compliance
NUMERIC_COLS = [c for c, _ in SCHEMAS["numeric"]]


def corr_sql(src: str, cols: list[str]) -> str:
    parts = []
    pairs = list(combinations(cols, 2)) + [(c, c) for c in cols]
    for a, b in pairs:
        raw = (f"covar_samp(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END)"
               f" / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")
        expr = f"CASE WHEN ({raw}) IS NULL THEN NULL ELSE least(1.0, greatest(-1.0, {raw})) END"
        parts.append(f"SELECT '{a}' AS feature1, '{b}' AS feature2, {expr} AS r FROM {src}")
        if a != b:
            parts.append(f"SELECT '{b}' AS feature1, '{a}' AS feature2, {expr} AS r FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _compliance_sql(framework: str) -> str:
    reqs = rules.COMPLIANCE_FRAMEWORKS[framework]
    req_rows = " UNION ALL ".join(f"SELECT {i + 1} AS position, '{r}' AS requirement" for i, r in enumerate(reqs))
    n = len(NUMERIC_COLS)
    if framework == "GDPR":
        checks = f"""SELECT 'Data minimization' AS requirement, CASE WHEN hc < {n} * 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
       CASE WHEN hc < {n} * 0.1 THEN 'Compliant' ELSE 'Non-compliant' END AS status,
       CASE WHEN hc < {n} * 0.1 THEN 'Low correlation between features suggests data minimization'
            ELSE 'High correlation suggests potential redundant features' END AS detail
FROM (SELECT count_if(abs(r) > 0.9) - {n} AS hc FROM cm)
UNION ALL
SELECT 'Accuracy', CASE WHEN rate < 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN rate < 0.05 THEN 'Compliant' ELSE 'Non-compliant' END,
       CASE WHEN rate < 0.05 THEN 'Low missing data rate indicates good accuracy' ELSE printf('High missing data rate: %.2f%%', rate * 100) END
FROM (SELECT ({' + '.join(f'count_if({c} IS NULL)' for c in NUMERIC_COLS)}) * 1.0 / (count(*) * {n}) AS rate FROM src)"""
    else:
        checks = "SELECT NULL::VARCHAR AS requirement, NULL::DOUBLE AS score, NULL::VARCHAR AS status, NULL::VARCHAR AS detail WHERE false"
    return f"""WITH src AS ({fx.NUMERIC_SQL}), cm AS ({corr_sql('src', NUMERIC_COLS)}), ck AS ({checks}),
rq AS ({req_rows}),
j AS (SELECT '{framework}' AS framework, rq.position, rq.requirement, coalesce(ck.score, 0.0) AS score,
             coalesce(ck.status, 'not_assessed') AS status, ck.detail FROM rq LEFT JOIN ck ON rq.requirement = ck.requirement)
SELECT *, ROUND(avg(score) OVER (), 6) AS compliance_score FROM j"""


@register("compliance_gdpr", sql=_compliance_sql("GDPR"))
def compliance_gdpr(spark, sf_dir):
    """GDPR requirement assessment of lineitem measures (minimisation, accuracy)."""
    return pv.compliance_report(fx.numeric(spark, sf_dir), "GDPR")


@register("compliance_ccpa", sql=_compliance_sql("CCPA"))
def compliance_ccpa(spark, sf_dir):
    """CCPA requirements (none is assessable, all score 0)."""
    return pv.compliance_report(fx.numeric(spark, sf_dir), "CCPA")


_GEN = " UNION ALL ".join(f"SELECT {100 + i} AS priority, '{r}' AS recommendation"
                          for i, r in enumerate(rules.COMPLIANCE_GENERAL_RECOMMENDATIONS))


@register("compliance_recommendations", sql=f"""WITH rep AS ({_compliance_sql('GDPR')}),
m AS ({' UNION ALL '.join(f"SELECT '{k}' AS requirement, '{v}' AS rec" for k, v in rules.COMPLIANCE_REQUIREMENT_RECOMMENDATIONS.items())})
SELECT rep.position AS priority, m.rec AS recommendation FROM rep JOIN m ON rep.requirement = m.requirement WHERE rep.score < 1
UNION ALL {_GEN}""")
def compliance_recommendations(spark, sf_dir):
    """GDPR recommendations for requirements that are not met, then the general ones."""
    return pv.compliance_recommendations(pv.compliance_report(fx.numeric(spark, sf_dir), "GDPR"))


# ---------------------------------------------------------------- X1 / X2 / X3
@register("correlation_matrix", sql=f"WITH src AS ({fx.NUMERIC_SQL}) SELECT feature1, feature2, ROUND(r, 6) AS r FROM ({corr_sql('src', NUMERIC_COLS)})",
          headline=True)
def correlation_matrix(spark, sf_dir):
    """Pairwise-complete Pearson matrix of lineitem measures (constant column -> NULL)."""
    return ex.correlation_matrix(fx.numeric(spark, sf_dir), NUMERIC_COLS)


def _hi_pairs_sql() -> str:
    order = {c: i for i, c in enumerate(NUMERIC_COLS)}
    case = "CASE " + " ".join(f"WHEN {{f}} = '{c}' THEN {i}" for c, i in order.items()) + " END"
    return f"""WITH src AS ({fx.NUMERIC_SQL}), cm AS ({corr_sql('src', NUMERIC_COLS)})
SELECT feature1, feature2, ROUND(r, 6) AS correlation FROM cm
WHERE {case.format(f='feature1')} < {case.format(f='feature2')} AND abs(r) > 0.7"""


@register("high_correlation_pairs", sql=_hi_pairs_sql())
def high_correlation_pairs(spark, sf_dir):
    """Upper-triangle pairs with |r| > 0.7."""
    return ex.high_correlation_pairs(ex.correlation_matrix(fx.numeric(spark, sf_dir), NUMERIC_COLS), NUMERIC_COLS)


_MI_COLS = ["score", "c_acctbal", "o_month"]


def _mi_sql() -> str:
    items = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(y AS VARCHAR) AS yy, CASE WHEN (SELECT max({c}) FROM d) = (SELECT min({c}) FROM d) THEN 0 "
        f"ELSE least(31, CAST(floor(({c} - (SELECT min({c}) FROM d)) / (((SELECT max({c}) FROM d) - (SELECT min({c}) FROM d)) / 32.0)) AS INTEGER)) END AS bin "
        f"FROM d WHERE {c} IS NOT NULL AND y IS NOT NULL" for c in _MI_COLS)
    return f"""WITH d AS ({fx.DECISIONS_SQL}), lg AS ({items}),
j AS (SELECT feature, bin, yy, count(*) AS nxy FROM lg GROUP BY ALL),
nx AS (SELECT feature, bin, sum(nxy) AS nx FROM j GROUP BY ALL), ny AS (SELECT feature, yy, sum(nxy) AS ny FROM j GROUP BY ALL),
n AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY ALL)
SELECT feature, ROUND(sum((nxy * 1.0 / n) * ln(nxy * n * 1.0 / (nx * ny))), 6) AS mutual_information
FROM j JOIN nx USING (feature, bin) JOIN ny USING (feature, yy) JOIN n USING (feature) GROUP BY feature"""


@register("mutual_information", sql=_mi_sql())
def mutual_information(spark, sf_dir):
    """Binned mutual information of score, account balance and month with fulfilment."""
    return ex.mutual_information(fx.decisions(spark, sf_dir), _MI_COLS, "y", bins=32)
