"""Model training, explanation and mitigation queries (L1-L8, X4-X16, M1-M4, F8 by model).

Queries that train models or draw seeded samples have no SQL; their operators are tested in ``tests/`` against
plain versions and by their properties.  The ones with a closed form have DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import explain as ex
from ..operators import fairness as fa
from ..operators import mitigate as mt
from ..operators import models as ml
from ..operators import treeshap as ts
from ..session import table
from . import fixtures as fx
from .catalog import register, union_long

FEATS = ["s1", "s2", "s3", "c_acctbal", "o_month"]
NUM_FEATS = ["c_acctbal", "o_month", "score"]


def _frame(spark, sf_dir):
    d = fx.decisions(spark, sf_dir).select("row_id", *FEATS, "score", F.col("y").cast("string").alias("label"))
    # training, scoring and attribution passes all read the split table: write it once
    # (checkpoint in spark.checkpoint.dir) instead of re-running the orders/customer join
    return ml.split(d, "label", "row_id", test=0.2, seed=42).checkpoint(eager=True)


def _train(spark, sf_dir, which, feats=FEATS):
    f = _frame(spark, sf_dir)
    return f, ml.train_models(f, feats, "label", which=which)


# ---------------------------------------------------------------- L1-L4
@register("completeness_gate", sql=f"""WITH src AS ({fx.GAPS_SQL})
SELECT * FROM (SELECT 'event_type' AS feature, count_if(event_type IS NULL) AS missing_count,
                      ROUND(count_if(event_type IS NULL) * 100.0 / count(*), 6) AS missing_pct FROM src
               UNION ALL SELECT 'value', count_if(value IS NULL), ROUND(count_if(value IS NULL) * 100.0 / count(*), 6) FROM src
               UNION ALL SELECT 'bonus', count_if(bonus IS NULL), ROUND(count_if(bonus IS NULL) * 100.0 / count(*), 6) FROM src
               UNION ALL SELECT 'event_id', count_if(event_id IS NULL), 0.0 FROM src) WHERE missing_count > 0""")
def completeness_gate(spark, sf_dir):
    """L1: columns blocking training because they still hold NULLs."""
    return ml.completeness_gate(fx.gaps(spark, sf_dir))


@register("label_encode", sql=f"""WITH d AS ({fx.DECISIONS_SQL})
SELECT row_id, CAST(dense_rank() OVER (ORDER BY s1) - 1 AS INTEGER) AS s1, CAST(dense_rank() OVER (ORDER BY s2) - 1 AS INTEGER) AS s2,
       CAST(dense_rank() OVER (ORDER BY s3) - 1 AS INTEGER) AS s3 FROM d""")
def label_encode(spark, sf_dir):
    """L2: string attributes replaced by codes in sorted value order."""
    d = fx.decisions(spark, sf_dir).select("row_id", "s1", "s2", "s3")
    return ml.encode(d, ["s1", "s2", "s3"])


@register("split_report", sql=f"""WITH d AS ({fx.DECISIONS_SQL}),
c AS (SELECT CAST(y AS VARCHAR) AS class, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS t FROM d GROUP BY 1)
SELECT 'test' AS split, class, t AS n FROM c UNION ALL SELECT 'train', class, n - t FROM c""")
def split_report(spark, sf_dir):
    """L3/L4: stratified 80/20 split (seed 42) and its class distribution per side."""
    return ml.split_report(_frame(spark, sf_dir), "label")


# ---------------------------------------------------------------- L5-L8
@register("train_compare")
def train_compare(spark, sf_dir):
    """Random forest, logistic regression and gradient boosting on the split; accuracy ranking."""
    f, models = _train(spark, sf_dir, None)
    return ml.compare_models(ml.predictions(models, f, "row_id", "label"))


def _rule_predictions(d):
    """Three fixed decision rules scored like models (price, priority, region rules)."""
    rules_ = {
        "price_rule": F.col("p"),
        "priority_rule": F.col("s2").isin("1-URGENT", "2-HIGH").cast("int"),
        "balance_rule": (F.col("c_acctbal") > 4500).cast("int"),
    }
    items = F.array(*[F.struct(F.lit(k).alias("model"), v.cast("string").alias("prediction")) for k, v in rules_.items()])
    return d.select("row_id", F.col("y").cast("string").alias("y"), "s1", "s2", "s3", F.inline(items))


_RULES_SQL = f"""d AS ({fx.DECISIONS_SQL}),
pr AS (SELECT row_id, CAST(y AS VARCHAR) AS y, s1, s2, s3, 'price_rule' AS model, CAST(p AS VARCHAR) AS prediction FROM d
       UNION ALL SELECT row_id, CAST(y AS VARCHAR), s1, s2, s3, 'priority_rule', CAST(CAST(s2 IN ('1-URGENT', '2-HIGH') AS INTEGER) AS VARCHAR) FROM d
       UNION ALL SELECT row_id, CAST(y AS VARCHAR), s1, s2, s3, 'balance_rule', CAST(CAST(c_acctbal > 4500 AS INTEGER) AS VARCHAR) FROM d)"""


@register("compare_rules", sql=f"""WITH {_RULES_SQL},
a AS (SELECT model, avg(CAST(y = prediction AS DOUBLE)) AS accuracy, count(DISTINCT prediction) AS n_predicted_classes,
             count(*) AS n FROM pr GROUP BY model)
SELECT model, ROUND(accuracy, 6) AS accuracy, n_predicted_classes, n, CAST(n_predicted_classes = 1 AS INTEGER) AS single_class_warning,
       CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS INTEGER) AS rank,
       CAST(row_number() OVER (ORDER BY accuracy DESC, model) = 1 AS INTEGER) AS best FROM a""")
def compare_rules(spark, sf_dir):
    """Accuracy ranking of three decision rules over all orders."""
    return ml.compare_models(_rule_predictions(fx.decisions(spark, sf_dir)))


@register("fairness_by_model", sql=f"""WITH {_RULES_SQL},
lg AS ({union_long('pr', ['s1', 's3'], 'model, CAST(y AS INTEGER) AS y, CAST(prediction AS INTEGER) AS p')}),
g AS (SELECT model, feature, grp, count(*) AS n, count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 0) AS tn,
             count_if(y = 1 AND p = 0) AS fn, avg(p) AS sel FROM lg WHERE grp IS NOT NULL GROUP BY ALL)
SELECT model, feature, grp, n, ROUND(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy, ROUND(sel, 6) AS positive_rate,
       ROUND(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 6) AS tpr FROM g""")
def fairness_by_model(spark, sf_dir):
    """F8: per-model, per-group accuracy / positive rate / TPR for the three decision rules."""
    pr = _rule_predictions(fx.decisions(spark, sf_dir)).withColumn("p", F.col("prediction").cast("int")).withColumn(
        "yy", F.col("y").cast("int"))
    return fa.app_group_table(pr, "yy", "p", ["s1", "s3"], by=("model",))


@register("trained_fairness")
def trained_fairness(spark, sf_dir):
    """F3-F7 on trained models: fairness summary per model and sensitive attribute (test split)."""
    f, models = _train(spark, sf_dir, None)
    pr = ml.predictions(models, f, "row_id", "label", keep=["s1", "s3"])
    pr = pr.withColumn("p", F.col("prediction").cast("int")).withColumn("yy", F.col("y").cast("int"))
    return fa.fairness_summary(fa.group_counts(pr, "yy", "p", ["s1", "s3"], by=["model"]), by=["model"])


# ---------------------------------------------------------------- X4-X16
@register("feature_importance_rf")
def feature_importance_rf(spark, sf_dir):
    """Built-in importances of the random forest, ranked."""
    _, models = _train(spark, sf_dir, ["random_forest"])
    return ml.feature_importance(models["random_forest"], spark)


@register("coefficient_importance_lr")
def coefficient_importance_lr(spark, sf_dir):
    """|coefficient| importance of the logistic regression, ranked."""
    _, models = _train(spark, sf_dir, ["logistic_regression"])
    return ml.feature_importance(models["logistic_regression"], spark)


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Permutation importance (10 seeded repeats) of the random forest on the test split."""
    f, models = _train(spark, sf_dir, ["random_forest"])
    test = f.where(F.col("split") == "test")
    return ml.permutation_importance(models["random_forest"], test, FEATS, "label", "row_id", repeats=10)


_COEFS = {"score": 0.5, "c_acctbal": 0.001, "o_month": -0.1}


def _lin_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS feature, {w} * (CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM d)) AS attribution FROM d"
        for c, w in _COEFS.items())
    return f"d AS ({fx.DECISIONS_SQL}), att AS ({parts})"


@register("linear_attributions", sql=f"WITH {_lin_sql()} SELECT row_id, feature, ROUND(attribution, 6) AS attribution FROM att")
def linear_attributions(spark, sf_dir):
    """Closed-form linear attributions for every order (fixed coefficients)."""
    return ml.linear_attributions(fx.decisions(spark, sf_dir), _COEFS, "row_id")


@register("attribution_importance", sql=f"""WITH {_lin_sql()},
i AS (SELECT feature, avg(abs(attribution)) AS importance FROM att GROUP BY feature)
SELECT feature, ROUND(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
FROM i""")
def attribution_importance(spark, sf_dir):
    """Mean |attribution| per feature, ranked."""
    return ex.attribution_importance(ml.linear_attributions(fx.decisions(spark, sf_dir), _COEFS, "row_id"))


# eight inputs of a line item; quantities are named as an age to have a sensitive name among them
_LINE_COEFS = {"l_quantity_age": 0.5, "l_extendedprice": 0.0002, "l_discount": 30.0, "l_tax": 25.0, "l_partkey": 0.004, "l_suppkey": 0.03,
               "l_linenumber": 1.5, "l_race_number": 0.7}


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber",
                     F.col("l_quantity").alias("l_quantity_age"), (F.col("l_linenumber") % 3).alias("l_race_number"))


def _line_importance_sql() -> str:
    source = {"l_quantity_age": "l_quantity", "l_race_number": "(l_linenumber % 3)"}
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {w} * (CAST({source.get(c, c)} AS DOUBLE) - (SELECT avg(CAST({source.get(c, c)} AS DOUBLE)) FROM lineitem)) AS attribution FROM lineitem"
        for c, w in _LINE_COEFS.items())
    return f"att AS ({parts}), i AS (SELECT feature, avg(abs(attribution)) AS importance FROM att GROUP BY feature)"


@register("importance_concentration", sql=f"""WITH {_line_importance_sql()},
r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM i),
a AS (SELECT sum(importance) FILTER (WHERE rank <= 5) * 100.0 / sum(importance) AS share,
             string_agg(feature, ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS top3 FROM r)
SELECT ROUND(share, 6) AS top_share_pct,
       CASE WHEN share > 80 THEN 'high' WHEN share < 40 THEN 'distributed' ELSE 'balanced' END AS concentration, top3 FROM a""")
def importance_concentration(spark, sf_dir):
    """Share of importance in the top five of eight line-item inputs and the top three names."""
    imp = ex.attribution_importance(ml.linear_attributions(_lines(spark, sf_dir), _LINE_COEFS, "l_orderkey")).drop("rank")
    return ex.importance_concentration(imp)


@register("sensitive_in_top", sql=f"""WITH {_line_importance_sql()},
r AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM i)
SELECT feature, rank, ROUND(importance, 6) AS importance FROM r
WHERE rank <= 10 AND ({' OR '.join(f"contains(lower(feature), '{k}')" for k in rules.SENSITIVE_IMPORTANCE_KEYWORDS)})""")
def sensitive_in_top(spark, sf_dir):
    """X11: sensitive-looking names among the ten most important of eight line-item inputs (two are named so)."""
    imp = ex.attribution_importance(ml.linear_attributions(_lines(spark, sf_dir), _LINE_COEFS, "l_orderkey")).drop("rank")
    return ex.sensitive_in_top(imp)


@register("model_linear_attributions")
def model_linear_attributions(spark, sf_dir):
    """X7 on the fitted logistic regression (coefficients on the encoded inputs), all test rows."""
    f, models = _train(spark, sf_dir, ["logistic_regression"])
    m = models["logistic_regression"]
    enc = ml.encoded_view(m, f.where(F.col("split") == "test"))
    return ex.attribution_importance(ml.linear_attributions(enc, ml.linear_model_coefficients(m), "row_id"))


@register("shapley_sampling")
def shapley_sampling(spark, sf_dir):
    """Monte-Carlo Shapley values of the logistic regression's probability for every test row against the whole
    training split; mean |attribution| and mean standard error per feature."""
    f, models = _train(spark, sf_dir, ["logistic_regression"])
    att = ml.shapley_sampling(models["logistic_regression"], f.where(F.col("split") == "test"), f.where(F.col("split") == "train"), FEATS, "row_id")
    att = att.checkpoint(eager=True)
    error = att.groupBy("feature").agg(F.avg("std_error").alias("mean_std_error"))
    return ex.attribution_importance(att).join(error, "feature")


@register("tree_shapley")
def tree_shapley(spark, sf_dir):
    """Exact Shapley values of the random forest's probability for every test row; mean |attribution| per feature."""
    f, models = _train(spark, sf_dir, ["random_forest"])
    return ex.attribution_importance(ts.tree_shapley(models["random_forest"], f.where(F.col("split") == "test"), "row_id"))


@register("local_surrogate")
def local_surrogate(spark, sf_dir):
    """Batch local linear surrogates (64 perturbations each) for every test row; mean |weight| per feature."""
    f, models = _train(spark, sf_dir, ["random_forest"])
    sur = ml.local_surrogate(models["random_forest"], f.where(F.col("split") == "test"), FEATS, "row_id")
    return sur.groupBy("feature").agg(F.count("*").alias("n_rows"), F.avg(F.abs("weight")).alias("mean_abs_weight"))


_TRAIN_CODES = f"""d AS ({fx.DECISIONS_SQL}),
enc AS (SELECT y, dense_rank() OVER (ORDER BY s1) - 1 AS s1, dense_rank() OVER (ORDER BY s2) - 1 AS s2, dense_rank() OVER (ORDER BY s3) - 1 AS s3,
               c_acctbal, o_month FROM d)"""


@register("model_complexity", sql=f"""WITH {_TRAIN_CODES},
cr AS ({' UNION ALL '.join(f"SELECT corr({a}, {b}) AS r FROM enc" for i, a in enumerate(FEATS) for b in FEATS[i + 1:])}),
pt AS (SELECT CASE WHEN count_if(abs(r) > 0.7) < 3 THEN 1 ELSE 0 END AS p FROM cr),
m(model, model_kind, n_parameters, n_features, n_estimators, max_depth, pts) AS (VALUES
  ('random_forest', 'forest', NULL, 5, 100, 12, 4), ('logistic_regression', 'linear', 5, NULL, NULL, NULL, 5), ('gradient_boosting', 'gbt', NULL, 5, 100, 3, 3))
SELECT m.* EXCLUDE (pts), ROUND(least((pts + p) / 6.0, 1.0), 6) AS interpretability_score FROM m, pt""")
def model_complexity(spark, sf_dir):
    """Complexity of the three models and their interpretability scores; correlated pairs are counted over
    all encoded inputs of the models."""
    f, models = _train(spark, sf_dir, None)
    rows = None
    for name, m in models.items():
        c = ml.model_complexity(m, spark).withColumn("model", F.lit(name))
        rows = c if rows is None else rows.unionByName(c)
    inputs = ml.encoded_view(models["random_forest"], f)
    n_pairs = ex.high_correlation_pairs(ex.correlation_matrix(inputs, FEATS), FEATS).count()
    return ex.interpretability_scores(rows, n_pairs)


@register("neighbor_mutual_information")
def neighbor_mutual_information(spark, sf_dir):
    """Nearest-neighbour mutual information of the numeric decision inputs with the outcome, over all orders."""
    d = fx.decisions(spark, sf_dir).select(*NUM_FEATS, F.col("y").cast("string").alias("label"))
    return ex.neighbor_mutual_information(d, NUM_FEATS, "label")


@register("decision_path_length")
def decision_path_length(spark, sf_dir):
    """Mean decision-path length of the forest over every test row."""
    f, models = _train(spark, sf_dir, ["random_forest"])
    return ml.avg_path_length(models["random_forest"], f.where(F.col("split") == "test"))


@register("explanation_report")
def explanation_report(spark, sf_dir):
    """Importances (built-in, permutation, exact Shapley), complexity, correlated pairs, mutual information
    and the interpretability score of the random forest on all inputs."""
    f, models = _train(spark, sf_dir, ["random_forest"])
    m = models["random_forest"]
    train, test = f.where(F.col("split") == "train"), f.where(F.col("split") == "test")
    inputs = ml.encoded_view(m, train).checkpoint(eager=True)
    return ml.explanation_report(ml.feature_importance(m, spark), ml.model_complexity(m, spark),
                                 ex.high_correlation_pairs(ex.correlation_matrix(inputs, FEATS), FEATS),
                                 ex.neighbor_mutual_information(inputs, FEATS, "label"),
                                 ts.tree_shapley(m, test, "row_id"),
                                 ml.permutation_importance(m, test, FEATS, "label", "row_id"))


# ---------------------------------------------------------------- M1-M4
@register("smote_balance", sql="""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, (SELECT max(n) FROM c) AS n, CAST((SELECT max(n) FROM c) - n AS BIGINT) AS n_synthetic FROM c""")
def smote_balance(spark, sf_dir):
    """M1: SMOTE on the embeddings (k=5, exact neighbours): rows and synthetic rows per label."""
    e = table(spark, sf_dir, "embeddings")
    s = mt.smote(e, "vec_id", "embedding", "label", k=5, seed=42)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.sum("synthetic").alias("n_synthetic"))


@register("smote_tomek_balance")
def smote_tomek_balance(spark, sf_dir):
    """M2: SMOTE followed by Tomek-link removal on the embeddings: rows per label."""
    e = table(spark, sf_dir, "embeddings")
    s = mt.smote_tomek(e, "vec_id", "embedding", "label", k=5, seed=42)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.sum("synthetic").alias("n_synthetic"))


@register("fair_training")
def fair_training(spark, sf_dir):
    """M3: demographic-parity constrained training; parity before vs after on the test split."""
    f = _frame(spark, sf_dir).withColumn("y", F.col("label").cast("int"))
    train, test = f.where(F.col("split") == "train"), f.where(F.col("split") == "test")
    base = ml.train_models(train, NUM_FEATS, "label", which=["logistic_regression"])["logistic_regression"]
    before = ml.predictions({"unconstrained": base}, test, "row_id", "label", keep=["s3"]).withColumn(
        "p", F.col("prediction").cast("int")).withColumn("yy", F.col("y").cast("int"))
    model = mt.fair_train(train, NUM_FEATS, "y", "s3")
    after = mt.fair_predict(model, test, id_col="row_id").select(F.lit("constrained").alias("model"), "row_id", F.col("y").alias("yy"),
                                                                 F.col("fair_pred").alias("p"), "s3")
    both = before.select("model", "row_id", "yy", "p", "s3").unionByName(after)
    return fa.fairness_summary(fa.group_counts(both, "yy", "p", ["s3"], by=["model"]), by=["model"])


@register("optimize_thresholds", sql=f"""WITH d AS ({fx.DECISIONS_SQL}),
h AS (SELECT s1 AS grp, score AS s, count(*) AS n, sum(y) AS pos FROM d WHERE s1 IS NOT NULL GROUP BY ALL),
tot AS (SELECT grp, sum(n) AS n_g, sum(pos) AS pos_g FROM h GROUP BY grp),
c AS (SELECT grp, s AS threshold, sum(n) OVER w AS sel, 2 * sum(pos) OVER w - sum(n) OVER w + n_g - pos_g AS correct, n_g FROM h JOIN tot USING (grp)
      WINDOW w AS (PARTITION BY grp ORDER BY s DESC)
      UNION ALL SELECT grp, 'infinity'::DOUBLE, 0, n_g - pos_g, n_g FROM tot),
v AS (SELECT a.grp, a.threshold, a.sel::DOUBLE AS sel, a.correct::DOUBLE AS correct, a.n_g::DOUBLE AS n_g,
             min(CASE WHEN b.sel < a.sel THEN (a.correct - b.correct)::DOUBLE / (a.sel - b.sel)::DOUBLE END) AS before,
             max(CASE WHEN b.sel > a.sel THEN (b.correct - a.correct)::DOUBLE / (b.sel - a.sel)::DOUBLE END) AS after
      FROM c a JOIN c b USING (grp) GROUP BY ALL),
hull AS (SELECT grp, threshold, sel / n_g AS r, correct, n_g FROM v WHERE before IS NULL OR after IS NULL OR before > after),
seg AS (SELECT *, lead(r) OVER w AS r1, lead(correct) OVER w AS y1, lead(threshold) OVER w AS t1 FROM hull WINDOW w AS (PARTITION BY grp ORDER BY r)),
acc AS (SELECT q.r, sum(seg.correct + CASE WHEN seg.r1 IS NULL THEN 0 ELSE (seg.y1 - seg.correct) * (q.r - seg.r) / (seg.r1 - seg.r) END) / sum(seg.n_g) AS accuracy
        FROM (SELECT DISTINCT r FROM hull) q JOIN seg ON seg.r <= q.r AND (q.r < seg.r1 OR seg.r1 IS NULL) GROUP BY q.r),
best AS (SELECT * FROM acc ORDER BY round(accuracy, 9) DESC, r LIMIT 1)
SELECT 's1' AS feature, grp, ROUND(CASE WHEN b.r = seg.r OR r1 IS NULL THEN threshold ELSE t1 END, 6) AS threshold_low, ROUND(threshold, 6) AS threshold_high,
       ROUND(coalesce((r1 - b.r) / (r1 - seg.r), 1.0), 6) AS weight_high, ROUND(b.r, 6) AS selection_rate, ROUND(b.r, 6) AS target_rate,
       ROUND(b.accuracy, 6) AS accuracy
FROM seg, best b WHERE seg.r <= b.r AND (b.r < r1 OR r1 IS NULL)""")
def optimize_thresholds(spark, sf_dir):
    """M4: per-segment randomised thresholds with equal selection rates and the best accuracy, over all scores."""
    return mt.optimize_thresholds(fx.decisions(spark, sf_dir), "y", "score", ["s1"])
