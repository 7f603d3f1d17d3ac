"""Governance findings and reports (R1-R10, F16 texts).

Every rule reads small audit results (one row per column / feature / requirement), so a
report is a handful of tiny aggregates over tables that Spark already computed on the
full data.  Findings are rows ``(priority, code, message)``; report texts are ordered
lines joined with ``concat_ws``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def _names(cond: Column, col: str = "feature") -> Column:
    """Comma-joined names (in column position order) of rows satisfying ``cond``."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("position", col)))),
                                    lambda s: s[col]), ", ")


def _contains_any(col: Column, kws: Sequence[str]) -> Column:
    low = F.lower(col)
    out = F.lit(False)
    for k in kws:
        out = out | low.contains(k)
    return out


def title_case(c: Column) -> Column:
    """Python ``str.title`` for snake_case words: every letter after '_' is capitalised too."""
    return F.regexp_replace(F.initcap(F.regexp_replace(c, "_", " ")), " ", "_")


def _line(no: int, text: Column) -> Column:
    return F.struct(F.lit(no).cast("long").alias("line_no"), text.alias("text"))


def _rows_from_items(ctx: DataFrame, items: list[Column]) -> DataFrame:
    return ctx.select(F.inline(F.array_compact(F.array(*items))))


def _item(priority: int, code: str, message: Column, cond: Column | None = None) -> Column:
    s = F.struct(F.lit(priority).alias("priority"), F.lit(code).alias("code"), message.alias("message"))
    return s if cond is None else F.when(cond, s)


# ------------------------------------------------------------------ R1 / R4
def size_band(rows: Column) -> Column:
    return F.when(rows < 1000, "small").when(rows > 100000, "large").otherwise("medium")


def risk_overview(risk: DataFrame, summary: DataFrame) -> DataFrame:
    """Counts of low (<= 2), high (>= 3) and critical (>= 4) risk columns, the first
    three critical (else high) columns and the dataset size band."""
    r = F.col("risk")
    a = risk.agg(F.count("*").alias("n_features"), F.count_if(r <= 2).alias("n_low"),
                 F.count_if(r >= 3).alias("n_high"), F.count_if(r >= 4).alias("n_critical"),
                 F.sort_array(F.collect_list(F.when(r >= 4, F.struct("position", "feature")))).alias("_c"),
                 F.sort_array(F.collect_list(F.when(r >= 3, F.struct("position", "feature")))).alias("_h"))
    top = F.when(F.size("_c") > 0, F.slice("_c", 1, 3)).otherwise(F.slice("_h", 1, 3))
    rows = summary.select("rows").scalar()
    return a.select("n_features", "n_low", "n_high", "n_critical",
                    F.when(F.col("n_critical") > 0, "critical").when(F.col("n_high") > 0, "high").otherwise("none").alias("alert"),
                    F.array_join(F.transform(top, lambda s: s["feature"]), ", ").alias("top_features"),
                    size_band(rows).alias("size_band"))


# ------------------------------------------------------------------ R2
def risky_features(risk: DataFrame, n: int = 10, min_risk: int = 2) -> DataFrame:
    """R2: columns with risk >= 2, the ``n`` highest (ties by column position)."""
    w = Window.orderBy(F.desc("risk"), "position")  # input has one row per column
    return (risk.where(F.col("risk") >= min_risk).withColumn("rank", F.row_number().over(w))
                .where(F.col("rank") <= n).select("rank", "feature", "risk", "risk_level"))


# ------------------------------------------------------------------ R3
DOMAIN_RULES = [
    # FIXED VALUES: domain insight name fragments.
    ("financial_services", ["loan", "credit"]),
    ("personal_demographics", ["person", "gender"]),
    ("financial_information", ["income", "salary"]),
    ("age_information", ["age"]),
]


def domain_insights(profile: DataFrame) -> DataFrame:
    """Domain rules matched by any column name (one boolean aggregate per rule)."""
    a = profile.agg(*[F.bool_or(_contains_any(F.col("feature"), kws)).alias(code) for code, kws in DOMAIN_RULES])
    items = [F.when(F.col(code), F.struct(F.lit(i + 1).alias("priority"), F.lit(code).alias("code")))
             for i, (code, _) in enumerate(DOMAIN_RULES)]
    return a.select(F.inline(F.array_compact(F.array(*items))))


# ------------------------------------------------------------------ R5
# Words in column names that tell a domain.
DOMAIN_WORDS = {"loan": ("loan", "credit"), "health": ("medical", "health"), "employ": ("employ", "hire", "job")}


def recommendations(risk: DataFrame, categories: DataFrame, summary: DataFrame, profile: DataFrame,
                    sensitive: Sequence[str] = (), model_kind: str | None = None) -> DataFrame:
    """Data-specific recommendations in the application's order.

    ``risk`` = P6 output, ``categories`` = P2 (basic) output, ``summary`` = C4 output,
    ``profile`` = C5 output (column names for domain rules).
    """
    r = F.col("risk")
    rk = risk.agg(_names(r >= 4).alias("crit"), _names(r >= 3).alias("high"))
    cat_lists = categories.groupBy("category").agg(_names(F.lit(True)).alias("cols"))
    cats = cat_lists.agg(F.map_from_entries(F.collect_list(F.struct("category", "cols"))).alias("m"),
                         F.count("*").alias("n_cats"))
    dom = profile.agg(*[F.bool_or(_contains_any(F.col("feature"), kws)).alias(code) for code, kws in DOMAIN_WORDS.items()])
    ctx = (rk.withColumn("m", cats.select("m").scalar()).withColumn("n_cats", cats.select("n_cats").scalar())
             .withColumn("rows", summary.select("rows").scalar())
             .withColumn("missing_pct", summary.select("missing_pct").scalar())
             .withColumn("loan", dom.select("loan").scalar()).withColumn("health", dom.select("health").scalar())
             .withColumn("employ", dom.select("employ").scalar()))
    m = F.col("m")
    sens = ",".join(sensitive).lower()
    has = lambda c: F.coalesce(F.element_at(m, F.lit(c)), F.lit("")) != ""
    def because(what: str, found: Column) -> Column:
        """A message is the rule's own condition and what met it."""
        return F.concat(F.lit(f"{what}: "), found)

    items = [
        _item(1, "critical_privacy_risk", because("risk >= 4", F.col("crit")), F.col("crit") != ""),
        _item(1, "high_privacy_priority", because("risk >= 3", F.col("high")), (F.col("crit") == "") & (F.col("high") != "")),
        _item(1, "privacy_ok", F.lit("risk >= 3: none"), (F.col("crit") == "") & (F.col("high") == "")),
    ]
    for n, (code, category) in enumerate((("identity_protection", "personal_id"), ("location_privacy", "location"), ("financial_data", "financial")), 2):
        items.append(_item(n, code, because(f"category {category}", F.element_at(m, F.lit(category))), has(category)))
    if sensitive:
        for n, (code, group) in enumerate((("gender_bias", "gender"), ("racial_fairness", "race"), ("age_discrimination", "age")), 5):
            items.append(_item(n, code, F.lit(f"sensitive attribute: {group}"), F.lit(group in sens) | has(group)))
    else:
        items.append(_item(5, "bias_analysis_missing", F.lit("sensitive attributes: none")))
    items += [
        _item(8, "small_sample", F.format_string("rows: %d < 1000", F.col("rows")), F.col("rows") < 1000),
        _item(8, "large_dataset", F.format_string("rows: %d > 100000", F.col("rows")), F.col("rows") > 100000),
        _item(9, "data_quality", F.format_string("missing: %.1f%% > 10%%", F.col("missing_pct")), F.col("missing_pct") > 10),
    ]
    for n, (code, domain) in enumerate((("financial_services", "loan"), ("healthcare", "health"), ("employment", "employ")), 10):
        items.append(_item(n, code, F.lit(f"column names: {', '.join(DOMAIN_WORDS[domain])}"), F.col(domain)))
    model_codes = {"forest": "forest_monitoring", "gbt": "gbt_oversight", "linear": "linear_transparency"}
    if model_kind in model_codes:
        items.append(_item(13, model_codes[model_kind], F.lit(f"model kind: {model_kind}")))
    items += [
        _item(14, "documentation", F.lit("always")),
        _item(15, "continuous_monitoring", F.lit("always")),
        _item(16, "team_training", F.format_string("sensitive categories: %d > 3", F.col("n_cats")), F.col("n_cats") > 3),
        _item(16, "basic_training", F.format_string("sensitive categories: %d <= 3", F.coalesce(F.col("n_cats"), F.lit(0))),
              F.coalesce(F.col("n_cats"), F.lit(0)) <= 3),
    ]
    return _rows_from_items(ctx, items)


# ------------------------------------------------------------------ R6
def privacy_recommendations(risk: DataFrame, categories: DataFrame) -> DataFrame:
    """Anonymise high-risk columns (risk >= 3), gender / age notices, then the five
    general recommendations."""
    rk = risk.agg(_names(F.col("risk") >= 3).alias("high"))
    g = categories.agg(
        F.bool_or((F.col("category") == "gender") & F.lower("feature").contains("gender")).alias("g"),
        F.bool_or((F.col("category") == "age") & F.lower("feature").contains("age")).alias("a"))
    ctx = rk.withColumn("g", F.coalesce(g.select("g").scalar(), F.lit(False))).withColumn(
        "a", F.coalesce(g.select("a").scalar(), F.lit(False)))
    items = [
        _item(1, "anonymize_high_risk", F.concat(F.lit("Consider anonymizing or removing high-risk features: "), F.col("high")),
              F.col("high") != ""),
        _item(2, "gender_fairness", F.lit("Gender detected - ensure compliance with anti-discrimination laws"), F.col("g")),
        _item(3, "age_discrimination", F.lit("Age-related features detected - verify ADEA compliance"), F.col("a")),
    ]
    items += [_item(4 + i, code, F.lit(msg)) for i, (code, msg) in enumerate(rules.PRIVACY_GENERAL_RECOMMENDATIONS)]
    return _rows_from_items(ctx, items)


# ------------------------------------------------------------------ R7
def overview(risk: DataFrame, sensitive: Sequence[str] = (), fairness: DataFrame | None = None) -> DataFrame:
    """Plain-language overview: privacy level, flagged columns, safe/risky counts, up to
    three monitored attributes and the two key actions."""
    r = F.col("risk")
    a = risk.agg(F.count_if(r >= 4).alias("n_crit"), F.count_if(r == 3).alias("n_high3"),
                 F.count_if(r <= 2).alias("safe_count"), F.count_if(r > 2).alias("risky_count"),
                 _names(r >= 4).alias("crit"), _names(r == 3).alias("high3"))
    level = F.when(F.col("n_crit") > 0, "critical").when(F.col("n_high3") > 0, "some_concerns").otherwise("good")
    flagged = F.when(F.col("n_crit") > 0, F.col("crit")).when(F.col("n_high3") > 0, F.col("high3")).otherwise(F.lit(""))
    privacy_action = (F.when(F.col("n_crit") > 0, F.concat(F.lit("Remove or anonymize: "), F.col("crit")))
                       .when(F.col("n_high3") > 0, F.concat(F.lit("Review and protect: "), F.col("high3")))
                       .otherwise(F.lit("Maintain current privacy practices")))
    first2 = ", ".join(list(sensitive)[:2])
    if not sensitive:
        bias_action = F.lit("Identify sensitive attributes for fairness monitoring")
    elif fairness is None:
        bias_action = F.lit(f"Monitor bias levels for: {first2}")
    else:
        dp = fairness.select(F.max("demographic_parity")).scalar()
        bias_action = F.when(dp > rules.BIAS_MEDIUM, F.lit(f"Implement bias mitigation for: {first2}")).otherwise(
            F.lit(f"Continue monitoring fairness for: {first2}"))
    return a.select(level.alias("privacy_level"), flagged.alias("flagged_features"), "safe_count", "risky_count",
                    F.lit(", ".join(list(sensitive)[:3])).alias("monitored"), privacy_action.alias("privacy_action"),
                    bias_action.alias("bias_action"))


# ------------------------------------------------------------------ R8 / R10 texts
BLOCK = 1_000_000_000  # line numbers of one block of a report; no list of lines is longer


def _at(block: int) -> int:
    """First line number of a block."""
    return block * BLOCK


def lines_to_text(lines: DataFrame) -> DataFrame:
    """Join ordered (line_no, text) rows into one document (bounded by the report length)."""
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))),
                                              lambda s: s["text"]), "\n").alias("report"))


def governance_lines(summary: DataFrame, risk: DataFrame, categories: DataFrame, recs: DataFrame,
                     sensitive: Sequence[str] = (), model_trained: bool = False) -> DataFrame:
    """The governance report as ordered lines (dataset, privacy, categories, bias,
    recommendations, checklist, next steps)."""
    spark = risk.sparkSession

    def const(block: int, texts: list[str]) -> DataFrame:
        return spark.createDataFrame([(_at(block * 10) + i, t) for i, t in enumerate(texts)], "line_no long, text string")

    head = summary.select(F.inline(F.array(
        _line(_at(10), F.lit("# AI Model Governance Report")), _line(_at(10) + 1, F.lit("## Dataset Overview")),
        _line(_at(10) + 2, F.format_string("- Total Records: %,d", F.col("rows"))),
        _line(_at(10) + 3, F.format_string("- Total Features: %d", F.col("columns"))),
        _line(_at(10) + 4, F.format_string("- Missing Values: %d", F.col("missing_cells"))))))
    priv = risk.where(F.col("risk") >= 3).select((_at(21) + F.col("position")).cast("long").alias("line_no"),
                                                 F.concat(F.lit("- "), F.col("feature")).alias("text"))
    crit = risk.where(F.col("risk") >= 4).select(
        (_at(22) + F.col("position")).cast("long").alias("line_no"),
        F.concat(F.lit("- "), F.col("feature"), F.lit(": Requires immediate anonymization or removal")).alias("text"))
    cat = categories.groupBy("category").agg(F.count("*").alias("n")).select(
        (_at(31) + F.row_number().over(Window.orderBy("category"))).cast("long").alias("line_no"),
        F.format_string("- %s: %d features", title_case(F.col("category")), F.col("n")).alias("text"))
    bias = [f"- {s}: Requires fairness monitoring for equal treatment" for s in sensitive] or [
        "- Bias Analysis: model training required for quantitative bias assessment"]
    rec = recs.select((_at(51) + F.row_number().over(Window.orderBy("priority", "code"))).cast("long").alias("line_no"),
        F.concat(F.col("code"), F.lit(": "), F.col("message")).alias("text"))
    check = ["## Compliance Checklist", "- Data inventory completed", "- Privacy risk assessment conducted",
             "- Sensitive features identified",
             "- Bias analysis performed" if sensitive else "- Bias analysis pending",
             "- Model explainability provided" if model_trained else "- Model training required",
             "## Next Steps", "1. Address critical privacy risks immediately",
             "2. Implement fairness constraints" if model_trained else "2. Complete model training and bias assessment",
             "3. Set up continuous monitoring", "4. Document model cards for compliance"]
    parts = [head, const(2, ["## Privacy Assessment", "### High-Risk Features:"]), priv, crit,
             const(3, ["### Sensitive Data Categories Identified:"]), cat,
             const(4, ["## Model Performance & Bias Analysis", *bias]), const(5, ["## Data-Specific Recommendations"]), rec,
             const(6, check)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def privacy_report_lines(pii: DataFrame, kanon: DataFrame, compliance: DataFrame, recs: DataFrame) -> DataFrame:
    """Privacy report lines: pattern hits per category, k-anonymity per combination,
    compliance status per requirement with the overall score, recommendations."""
    spark = pii.sparkSession
    cat_order = F.create_map(*[x for i, c in enumerate(rules.PII_PATTERNS) for x in (F.lit(c), F.lit(i))])
    head = spark.createDataFrame([(_at(0), "# Privacy Analysis Report"), (_at(0) + 1, "## Pattern Detection Results")],
                                 "line_no long, text string")
    cats = pii.groupBy("category").agg(F.count("*").alias("_n")).select(
        ((100 + F.element_at(cat_order, F.col("category")).cast("long")) * F.lit(BLOCK)).cast("long").alias("line_no"),
        F.concat(F.lit("### "), title_case(F.col("category")), F.lit(" Patterns")).alias("text"))
    hits = pii.select(
        ((100 + F.element_at(cat_order, F.col("category")).cast("long")) * F.lit(BLOCK) + 1 +
         F.row_number().over(Window.partitionBy("category").orderBy("column"))).cast("long").alias("line_no"),
        F.format_string("- %s: %d matches (%.1f%%)", F.col("column"), F.col("matches"), F.col("percentage")).alias("text"))
    kh = spark.createDataFrame([(_at(1000), "## Re-identification Risk Assessment")], "line_no long, text string")
    kl = kanon.select((_at(1000) + 1 + F.row_number().over(Window.orderBy("size", "combo"))).cast("long").alias("line_no"),
                      F.format_string("- Combo_%s: K-anonymity = %s (%s risk)", F.col("combo"), F.col("k").cast("string"),
                                      F.col("risk_level")).alias("text"))
    fw = compliance.agg(F.first("framework").alias("f"), F.first("compliance_score").alias("s")).select(F.inline(F.array(
        _line(_at(2000), F.concat(F.lit("## "), F.col("f"), F.lit(" Compliance Assessment"))),
        _line(_at(2000) + 1, F.format_string("Overall Score: %.2f/1.0", F.col("s"))))))
    cl = compliance.select((_at(2000) + 10 + F.col("position")).cast("long").alias("line_no"),
                           F.concat(F.lit("- "), F.col("requirement"), F.lit(": "), F.col("status")).alias("text"))
    rh = spark.createDataFrame([(_at(3000), "## Recommendations")], "line_no long, text string")
    rl = recs.select((_at(3000) + 1 + F.row_number().over(Window.orderBy("priority"))).cast("long").alias("line_no"),
                     F.concat(F.lit("- "), F.col("recommendation")).alias("text"))
    out = head
    for p in [cats, hits, kh, kl, fw, cl, rh, rl]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ R9
# What to look at, by model kind: operators of this library, or a property to watch.
INTERPRETABILITY_ADVICE = {
    "forest": ["feature_importance", "permutation_importance", "tree_shapley"],
    "gbt": ["feature_importance", "n_estimators", "tree_shapley"],
    "linear": ["coefficient_importance", "linear_attributions", "high_correlation_pairs"],
}
GENERAL_ADVICE = ["importance_concentration", "sensitive_in_top", "local_surrogate"]


def interpretability_advice(model_kind: str) -> list[str]:
    """What to look at for a model kind, then what holds for every kind."""
    return [*INTERPRETABILITY_ADVICE.get(model_kind, []), *GENERAL_ADVICE]
