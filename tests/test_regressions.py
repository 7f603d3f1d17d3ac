"""Answers that must not depend on table size, NULL keys, file count or list lengths."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditora.functions.ranges import hash_rank
from auditora.operators import fairness as fa
from auditora.operators import impute, models, report
from auditora.sources import io
from auditora.streaming import monitor

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunks", [1, 2, 8])
@pytest.mark.parametrize("forward", [True, False])
def test_fill_with_null_partition_key(spark, chunks, forward):
    rows = [(i, None if i % 2 else "a", float(i) if i in (0, 1, 198, 199) else None) for i in range(200)]
    df = spark.createDataFrame(rows, "t bigint, k string, v double")
    fill = impute.forward_fill if forward else impute.backward_fill
    got = {r.t: r.v for r in fill(df, ["t"], ["k"], chunks=chunks).collect()}
    for i in range(200):
        want = (i % 2 if i < 198 else i) if forward else (198 + i % 2 if i > 1 else i)
        assert got[i] == want


def test_hash_rank_keeps_null_parts(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") % 10 != 0, F.col("id") % 3))
    got = hash_rank(df, ["c"], ["id"], 7, buckets=5).collect()
    assert len(got) == 1000
    ranks = sorted(r["_hrank"] for r in got if r.c is None)
    assert ranks == list(range(100)) and {r["_hn"] for r in got if r.c is None} == {100}
    assert models.split(df.withColumn("y", F.col("c").cast("string")), "y", "id").count() == 1000


def test_permutation_importance_of_a_small_table(spark):
    df = spark.range(200).select("id", ((F.col("id") * 37) % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("y", (F.col("x") >= 50).cast("string"))
    m = models.train_models(df, ["x", "z"], "y", ["logistic_regression"])["logistic_regression"]
    got = {r.feature: r for r in models.permutation_importance(m, df, ["x", "z"], "y", "id", repeats=6).collect()}
    assert 0.4 < got["x"].importance_mean < 0.6  # half the rows change side under a free permutation
    assert abs(got["z"].importance_mean) < 0.05


def test_shapley_values_add_up_for_any_background(spark):
    df = spark.range(60).select("id", (F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"))
    df = df.withColumn("y", ((F.col("x") + F.col("z")) > 7).cast("string"))
    m = models.train_models(df, ["x", "z"], "y", ["logistic_regression"])["logistic_regression"]
    background = df.crossJoin(spark.range(250).select(F.lit(1).alias("w")))  # 15 000 rows
    got = models.shapley_sampling(m, df, background, ["x", "z"], "id", permutations=4).collect()
    assert len(got) == 120
    one = models.shapley_sampling(m, df, df.limit(1), ["x", "z"], "id", permutations=2)
    total = {r["id"]: r["s"] for r in one.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    from pyspark.ml.functions import vector_to_array
    p = {r["id"]: r["p"] for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    base = m.transform(df.limit(1)).select(vector_to_array("probability")[1].alias("p")).first()["p"]
    assert all(abs(total[i] - (p[i] - base)) < 1e-9 for i in p)


def test_trees_train_on_many_categories(spark):
    df = spark.range(600).select("id", F.concat(F.lit("c"), F.col("id") % 60).alias("a"), F.concat(F.lit("u"), F.col("id") % 400).alias("b"))
    df = df.withColumn("y", (F.col("id") % 60 < 30).cast("string"))
    ms = models.train_models(df, ["a", "b"], "y", ["random_forest", "gradient_boosting"], trees=5, rf_depth=4)
    for m in ms.values():
        imp = {r.feature: r.importance for r in models.feature_importance(m, spark).collect()}
        assert set(imp) == {"a", "b"} and imp["a"] > imp["b"]


def test_long_reports_keep_their_order(spark):
    risk = spark.createDataFrame([(f"f{i}", i, 4) for i in range(1200)], "feature string, position int, risk int")
    summary = spark.createDataFrame([(10, 1200, 0)], "rows bigint, columns int, missing_cells bigint")
    cats = spark.createDataFrame([("email", "f1")], "category string, feature string")
    recs = spark.createDataFrame([(1, "c", "m")], "priority int, code string, message string")
    text = report.lines_to_text(report.governance_lines(summary, risk, cats, recs)).first()["report"].split("\n")
    at = [n for n, line in enumerate(text) if line.startswith("#")]
    assert [text[n] for n in at] == ["# AI Model Governance Report", "## Dataset Overview", "## Privacy Assessment", "### High-Risk Features:",
                                     "### Sensitive Data Categories Identified:", "## Model Performance & Bias Analysis",
                                     "## Data-Specific Recommendations", "## Compliance Checklist", "## Next Steps"]
    first = text.index("- f0")
    assert text[first:first + 1200] == [f"- f{i}" for i in range(1200)]


def test_csv_types_follow_the_written_form(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("i,l,d,code,b,day,ts,mix\n")
        f.write("1,9223372036854775807,1.5,12D,true,2024-01-02,2024-01-02 03:04:05,1\n")
        f.write("-2,-9223372036854775808,2e3,34F,FALSE,2024-02-29,2024-01-02T03:04:05.250,x\n")
        f.write(",,,,,,,\n")
    got = io.read_table(spark, path)
    assert dict(got.dtypes) == {"i": "int", "l": "bigint", "d": "double", "code": "string", "b": "boolean", "day": "date", "ts": "timestamp", "mix": "string"}
    rows = got.orderBy("i").collect()
    assert rows[1].l == -2 ** 63 and rows[2].l == 2 ** 63 - 1 and rows[2].code == "12D" and rows[1].day == dt.date(2024, 2, 29)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_counts_every_row(spark, tmp_path, files):
    base = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("s"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") > 150000).cast("int").alias("p"))
    base.repartition(files).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = []
    q = monitor.start_monitor(stream, "ts", "y", "p", ["s"], lambda b, e: batches.append((b.columns, b.collect())),
                              str(tmp_path / "ckpt"), window="30 days", trigger={"availableNow": True})
    q.awaitTermination()
    assert len(batches) == files
    by = base.select(F.window("ts", "30 days")["start"].alias("window_start"), "y", "p", "s")
    want = fa.bias_report(fa.fairness_summary(fa.group_counts(by, "y", "p", ["s"], by=["window_start"]), by=["window_start"]), by=["window_start"])
    columns, last = batches[-1]
    assert sorted(columns) == sorted(want.columns)
    key = lambda rows: sorted(str([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in want.columns]) for r in rows)
    assert key(last) == key(want.collect())


def test_loan_tables_name_their_outcomes(spark):
    from auditora.operators import profile as pr
    from auditora.operators import target as tg
    df = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("LoanId"), F.col("o_orderstatus").alias("loan_status"),
                                                           (F.col("o_totalprice") > 1e5).cast("int").alias("Defaulted"))
    got = tg.loan_targets(pr.column_profile(df)).orderBy("position").collect()
    assert [(r.feature, r.n_distinct) for r in got] == [("loan_status", df.select("loan_status").distinct().count()), ("Defaulted", 2)]
    assert tg.loan_targets(pr.column_profile(df.withColumnRenamed("LoanId", "id").withColumnRenamed("loan_status", "status"))).count() == 0
