"""Governance report queries (R1-R10) over the events and customer tables."""

from __future__ import annotations

from ..functions import rules
from ..operators import privacy as pv
from ..operators import report as rp
from ..operators.profile import column_profile, dataset_summary
from ..session import table
from .catalog import register
from .q_privacy import TEXT_SCHEMAS, _basic_cats_sql, _risk_sql
from .q_profile import SCHEMAS, profile_sql

EV = TEXT_SCHEMAS["events"]


def _ctx(spark, sf_dir, name="events"):
    df = table(spark, sf_dir, name)
    prof = column_profile(df)
    return df, prof, pv.privacy_risk(prof), pv.name_categories(prof, "basic"), dataset_summary(df)


_RISK = f"risk AS ({_risk_sql('events', EV)})"
_CATS = f"cats AS ({_basic_cats_sql('events', EV)})"


def _names_sql(cond: str) -> str:
    return f"coalesce(string_agg(feature, ', ' ORDER BY position) FILTER (WHERE {cond}), '')"


@register("risk_overview", sql=f"""WITH {_RISK},
a AS (SELECT count(*) AS n_features, count_if(risk <= 2) AS n_low, count_if(risk >= 3) AS n_high,
             count_if(risk >= 4) AS n_critical,
             list(feature ORDER BY position) FILTER (WHERE risk >= 4) AS c, list(feature ORDER BY position) FILTER (WHERE risk >= 3) AS h
      FROM risk)
SELECT n_features, n_low, n_high, n_critical,
       CASE WHEN n_critical > 0 THEN 'critical' WHEN n_high > 0 THEN 'high' ELSE 'none' END AS alert,
       coalesce(array_to_string(CASE WHEN n_critical > 0 THEN c[1:3] ELSE h[1:3] END, ', '), '') AS top_features,
       CASE WHEN (SELECT count(*) FROM events) < 1000 THEN 'small' WHEN (SELECT count(*) FROM events) > 100000 THEN 'large'
            ELSE 'medium' END AS size_band
FROM a""")
def risk_overview(spark, sf_dir):
    """Executive privacy summary of the events table."""
    _, _, risk, _, summ = _ctx(spark, sf_dir)
    return rp.risk_overview(risk, summ)


@register("risky_features", sql=f"""WITH {_RISK}
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY risk DESC, position) AS INTEGER) AS rank, feature, risk, risk_level
               FROM risk WHERE risk >= 2) WHERE rank <= 10""")
def risky_features(spark, sf_dir):
    """R2: the columns needing privacy attention (risk >= 2), highest first."""
    _, _, risk, _, _ = _ctx(spark, sf_dir)
    return rp.risky_features(risk, 10)


def _dom_sql(tbl: str, schema) -> str:
    parts = []
    for i, (code, kws) in enumerate(rp.DOMAIN_RULES):
        cond = " OR ".join(f"contains(lower(feature), '{k}')" for k in kws)
        parts.append(f"SELECT {i + 1} AS priority, '{code}' AS code FROM prof HAVING bool_or({cond})")
    return f"WITH prof AS ({profile_sql(tbl, schema)}) " + " UNION ALL ".join(parts)


@register("domain_insights", sql=_dom_sql("customer", SCHEMAS["customer"]))
def domain_insights(spark, sf_dir):
    """Domain insights from customer column names (over its profile)."""
    return rp.domain_insights(column_profile(table(spark, sf_dir, "customer")))


_GEN = " UNION ALL ".join(f"SELECT {4 + i} AS priority, '{c}' AS code, '{m}' AS message"
                          for i, (c, m) in enumerate(rules.PRIVACY_GENERAL_RECOMMENDATIONS))


@register("privacy_recommendations", sql=f"""WITH {_RISK}, {_CATS},
h AS (SELECT {_names_sql('risk >= 3')} AS high FROM risk)
SELECT 1 AS priority, 'anonymize_high_risk' AS code, 'Consider anonymizing or removing high-risk features: ' || high AS message
FROM h WHERE high <> ''
UNION ALL SELECT 2, 'gender_fairness', 'Gender detected - ensure compliance with anti-discrimination laws'
FROM cats HAVING coalesce(bool_or(category = 'gender' AND contains(lower(feature), 'gender')), false)
UNION ALL SELECT 3, 'age_discrimination', 'Age-related features detected - verify ADEA compliance'
FROM cats HAVING coalesce(bool_or(category = 'age' AND contains(lower(feature), 'age')), false)
UNION ALL {_GEN}""")
def privacy_recommendations(spark, sf_dir):
    """Basic privacy recommendations for the events table."""
    _, _, risk, cats, _ = _ctx(spark, sf_dir)
    return rp.privacy_recommendations(risk, cats)


@register("overview", sql=f"""WITH {_RISK},
a AS (SELECT count_if(risk >= 4) AS n_crit, count_if(risk = 3) AS n_high3, count_if(risk <= 2) AS safe_count,
             count_if(risk > 2) AS risky_count, {_names_sql('risk >= 4')} AS crit, {_names_sql('risk = 3')} AS high3 FROM risk)
SELECT CASE WHEN n_crit > 0 THEN 'critical' WHEN n_high3 > 0 THEN 'some_concerns' ELSE 'good' END AS privacy_level,
       CASE WHEN n_crit > 0 THEN crit WHEN n_high3 > 0 THEN high3 ELSE '' END AS flagged_features, safe_count, risky_count,
       'event_type, user_id' AS monitored,
       CASE WHEN n_crit > 0 THEN 'Remove or anonymize: ' || crit WHEN n_high3 > 0 THEN 'Review and protect: ' || high3
            ELSE 'Maintain current privacy practices' END AS privacy_action,
       'Monitor bias levels for: event_type, user_id' AS bias_action
FROM a""")
def overview(spark, sf_dir):
    """Plain-language overview for events with two monitored attributes."""
    _, _, risk, _, _ = _ctx(spark, sf_dir)
    return rp.overview(risk, ["event_type", "user_id"])


def _recs_sql(forest_line: bool = True) -> str:
    dom = rp.DOMAIN_WORDS
    dom_sql = ", ".join("coalesce(bool_or(" + " OR ".join(f"contains(lower(feature), '{k}')" for k in kws) + f"), false) AS {name}"
                        for name, kws in dom.items())
    n = len(EV)
    miss = " + ".join(f"count_if({c} IS NULL)" for c, _ in EV)
    return f"""WITH {_RISK}, {_CATS}, prof AS ({profile_sql('events', EV)}),
rk AS (SELECT {_names_sql('risk >= 4')} AS crit, {_names_sql('risk >= 3')} AS high FROM risk),
cl AS (SELECT category, string_agg(feature, ', ' ORDER BY position) AS cols FROM cats GROUP BY category),
ctx AS (SELECT rk.*, (SELECT count(*) FROM cl) AS n_cats,
               (SELECT count(*) FROM events) AS rows, (SELECT ({miss}) * 100.0 / (count(*) * {n}) FROM events) AS missing_pct,
               (SELECT cols FROM cl WHERE category = 'personal_id') AS pid,
               (SELECT cols FROM cl WHERE category = 'location') AS loc,
               (SELECT cols FROM cl WHERE category = 'financial') AS fin, d.* FROM rk, (SELECT {dom_sql} FROM prof) d)
SELECT 1 AS priority, 'critical_privacy_risk' AS code,
       'risk >= 4: ' || crit AS message FROM ctx WHERE crit <> ''
UNION ALL SELECT 1, 'high_privacy_priority', 'risk >= 3: ' || high FROM ctx WHERE crit = '' AND high <> ''
UNION ALL SELECT 1, 'privacy_ok', 'risk >= 3: none' FROM ctx WHERE crit = '' AND high = ''
UNION ALL SELECT 2, 'identity_protection', 'category personal_id: ' || pid FROM ctx WHERE coalesce(pid, '') <> ''
UNION ALL SELECT 3, 'location_privacy', 'category location: ' || loc FROM ctx WHERE coalesce(loc, '') <> ''
UNION ALL SELECT 4, 'financial_data', 'category financial: ' || fin FROM ctx WHERE coalesce(fin, '') <> ''
UNION ALL SELECT 5, 'gender_bias', 'sensitive attribute: gender' FROM ctx WHERE EXISTS (SELECT 1 FROM cl WHERE category = 'gender')
UNION ALL SELECT 6, 'racial_fairness', 'sensitive attribute: race' FROM ctx WHERE EXISTS (SELECT 1 FROM cl WHERE category = 'race')
UNION ALL SELECT 7, 'age_discrimination', 'sensitive attribute: age' FROM ctx WHERE EXISTS (SELECT 1 FROM cl WHERE category = 'age')
UNION ALL SELECT 8, 'small_sample', printf('rows: %d < 1000', rows) FROM ctx WHERE rows < 1000
UNION ALL SELECT 8, 'large_dataset', printf('rows: %d > 100000', rows) FROM ctx WHERE rows > 100000
UNION ALL SELECT 9, 'data_quality', printf('missing: %.1f%% > 10%%', missing_pct) FROM ctx WHERE missing_pct > 10
UNION ALL SELECT 10, 'financial_services', 'column names: {', '.join(dom['loan'])}' FROM ctx WHERE loan
UNION ALL SELECT 11, 'healthcare', 'column names: {', '.join(dom['health'])}' FROM ctx WHERE health
UNION ALL SELECT 12, 'employment', 'column names: {', '.join(dom['employ'])}' FROM ctx WHERE employ
UNION ALL SELECT 13, 'forest_monitoring', 'model kind: forest' FROM ctx WHERE {str(forest_line).upper()}
UNION ALL SELECT 14, 'documentation', 'always' FROM ctx
UNION ALL SELECT 15, 'continuous_monitoring', 'always' FROM ctx
UNION ALL SELECT 16, 'team_training', printf('sensitive categories: %d > 3', n_cats) FROM ctx WHERE n_cats > 3
UNION ALL SELECT 16, 'basic_training', printf('sensitive categories: %d <= 3', n_cats) FROM ctx WHERE n_cats <= 3"""


@register("recommendations", sql=_recs_sql())
def recommendations(spark, sf_dir):
    """Data-specific governance recommendations for events (monitoring event_type)."""
    _, prof, risk, cats, summ = _ctx(spark, sf_dir)
    return rp.recommendations(risk, cats, summ, prof, ["event_type"], model_kind="forest")


def _governance_sql() -> str:
    n = len(EV)
    miss = " + ".join(f"count_if({c} IS NULL)" for c, _ in EV)
    check = ["## Compliance Checklist", "- Data inventory completed", "- Privacy risk assessment conducted",
             "- Sensitive features identified", "- Bias analysis performed", "- Model training required", "## Next Steps",
             "1. Address critical privacy risks immediately", "2. Complete model training and bias assessment",
             "3. Set up continuous monitoring", "4. Document model cards for compliance"]
    check_sql = " UNION ALL ".join(f"SELECT {6000 + i}, '{t}'" for i, t in enumerate(check))
    recs = _recs_sql(forest_line=False).replace("WITH ", "", 1)
    return f"""WITH recs AS (WITH {recs}),
cl AS (SELECT category, count(*) AS n FROM ({_basic_cats_sql('events', EV)}) GROUP BY category),
r2 AS ({_risk_sql('events', EV)}),
summ AS (SELECT count(*) AS rows, ({miss}) AS miss FROM events),
lines AS (
  SELECT 1000 AS line_no, '# AI Model Governance Report' AS text UNION ALL SELECT 1001, '## Dataset Overview'
  UNION ALL SELECT 1002, '- Total Records: ' || format('{{:,}}', rows) FROM summ
  UNION ALL SELECT 1003, '- Total Features: {n}'
  UNION ALL SELECT 1004, '- Missing Values: ' || CAST(miss AS VARCHAR) FROM summ
  UNION ALL SELECT 2000, '## Privacy Assessment' UNION ALL SELECT 2001, '### High-Risk Features:'
  UNION ALL SELECT 2100 + position, '- ' || feature FROM r2 WHERE risk >= 3
  UNION ALL SELECT 2500 + position, '- ' || feature || ': Requires immediate anonymization or removal' FROM r2 WHERE risk >= 4
  UNION ALL SELECT 3000, '### Sensitive Data Categories Identified:'
  UNION ALL SELECT 3100 + row_number() OVER (ORDER BY category),
                   '- ' || array_to_string(list_transform(string_split(category, '_'), lambda x: upper(x[1]) || lower(x[2:])), '_')
                   || ': ' || CAST(n AS VARCHAR) || ' features' FROM cl
  UNION ALL SELECT 4000, '## Model Performance & Bias Analysis'
  UNION ALL SELECT 4001, '- event_type: Requires fairness monitoring for equal treatment'
  UNION ALL SELECT 5000, '## Data-Specific Recommendations'
  UNION ALL SELECT 5100 + row_number() OVER (ORDER BY priority, code), code || ': ' || message FROM recs
  UNION ALL {check_sql})
SELECT string_agg(text, chr(10) ORDER BY line_no) AS report FROM lines"""


@register("governance_report", sql=_governance_sql())
def governance_report(spark, sf_dir):
    """The governance report text for events, built from the audit tables."""
    _, prof, risk, cats, summ = _ctx(spark, sf_dir)
    recs = rp.recommendations(risk, cats, summ, prof, ["event_type"])
    return rp.lines_to_text(rp.governance_lines(summ, risk, cats, recs, ["event_type"]))


def _privacy_report_sql() -> str:
    from . import fixtures as fx
    from .q_privacy import _compliance_sql, _kanon_sql, _pii_sql, _strings
    cats = list(rules.PII_PATTERNS)
    cat_pos = "CASE " + " ".join(f"WHEN category = '{c}' THEN {i}" for i, c in enumerate(cats)) + " END"
    cat_title = "CASE " + " ".join(f"WHEN category = '{c}' THEN '{c.title()}'" for c in cats) + " END"
    gen = " UNION ALL ".join(f"SELECT {100 + i} AS priority, '{r}' AS recommendation"
                             for i, r in enumerate(rules.COMPLIANCE_GENERAL_RECOMMENDATIONS))
    req = " UNION ALL ".join(f"SELECT '{k}' AS requirement, '{v}' AS rec" for k, v in rules.COMPLIANCE_REQUIREMENT_RECOMMENDATIONS.items())
    return f"""WITH pii AS ({_pii_sql('documents', _strings(TEXT_SCHEMAS['documents']))}),
kan AS ({_kanon_sql('part', ['p_brand', 'p_type', 'p_size'])}),
comp AS ({_compliance_sql('GDPR')}),
recs AS (SELECT comp.position AS priority, m.rec AS recommendation FROM comp JOIN ({req}) m ON comp.requirement = m.requirement
         WHERE comp.score < 1 UNION ALL {gen}),
lines AS (
  SELECT 0 AS line_no, '# Privacy Analysis Report' AS text UNION ALL SELECT 1, '## Pattern Detection Results'
  UNION ALL SELECT DISTINCT 100 + ({cat_pos}) * 100, '### ' || ({cat_title}) || ' Patterns' FROM pii
  UNION ALL SELECT 100 + ({cat_pos}) * 100 + 1 + row_number() OVER (PARTITION BY category ORDER BY "column"),
                   printf('- %s: %d matches (%.1f%%)', "column", matches, percentage) FROM pii
  UNION ALL SELECT 10000, '## Re-identification Risk Assessment'
  UNION ALL SELECT 10001 + row_number() OVER (ORDER BY size, combo),
                   printf('- Combo_%s: K-anonymity = %s (%s risk)', combo, CAST(k AS VARCHAR), risk_level) FROM kan
  UNION ALL SELECT 20000, '## ' || any_value(framework) || ' Compliance Assessment' FROM comp
  UNION ALL SELECT 20001, printf('Overall Score: %.2f/1.0', any_value(compliance_score)) FROM comp
  UNION ALL SELECT 20010 + position, '- ' || requirement || ': ' || status FROM comp
  UNION ALL SELECT 30000, '## Recommendations'
  UNION ALL SELECT 30001 + row_number() OVER (ORDER BY priority), '- ' || recommendation FROM recs)
SELECT string_agg(text, chr(10) ORDER BY line_no) AS report FROM lines"""


@register("privacy_report", sql=_privacy_report_sql())
def privacy_report(spark, sf_dir):
    """Privacy report text: PII hits in documents, k-anonymity of part, GDPR status."""
    from . import fixtures as fx
    pii = pv.scan_pii(table(spark, sf_dir, "documents"))
    kan = pv.k_anonymity(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])
    comp = pv.compliance_report(fx.numeric(spark, sf_dir), "GDPR")
    recs = pv.compliance_recommendations(comp)
    return rp.lines_to_text(rp.privacy_report_lines(pii, kan, comp, recs))
