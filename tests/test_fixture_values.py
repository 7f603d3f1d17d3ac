"""Expected values recorded in FIXTURES.md (sf0.01)."""

from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def test_decisions_by_segment(spark):
    q = E.queries()
    rows = {r["grp"]: r for r in q["fair_group_metrics"](spark, SF).where(F.col("feature") == "s1").collect()}
    expect = {"AUTOMOBILE": (2932, 492, 976), "BUILDING": (2958, 487, 1001), "FURNITURE": (2983, 478, 994),
              "HOUSEHOLD": (3042, 507, 1032), "MACHINERY": (3085, 523, 1058)}
    assert {k: (v["n"], v["tp"], v["fp"]) for k, v in rows.items()} == expect
    s1 = [r for r in q["fair_summary"](spark, SF).collect() if r["feature"] == "s1"][0]
    assert abs(s1["demographic_parity"] - 0.019017) < 1e-6 and abs(s1["equalized_odds"] - 0.029623) < 1e-6
    fpr = [r["fpr"] for r in rows.values()]
    assert abs((max(fpr) - min(fpr)) - 0.015657) < 2e-6


def test_k_anonymity_part(spark):
    got = {r["combo"]: (r["k"], r["n_groups"]) for r in E.queries()["k_anonymity_part"](spark, SF).collect()}
    assert got == {"p_brand+p_type": (4, 150), "p_brand+p_size": (1, 988), "p_type+p_size": (1, 299),
                   "p_brand+p_type+p_size": (1, 1745)}


def test_pii_hits(spark):
    got = {r["category"]: r["matches"] for r in E.queries()["pii_scan_documents"](spark, SF).collect()
           if r["column"] == "text"}
    assert got == {"email": 11, "phone": 18, "credit_card": 24, "ip_address": 25, "license_plate": 60}
    pages = {r["category"]: r["matches"] for r in E.queries()["pii_scan_pages"](spark, SF).collect()
             if r["column"] == "html"}
    assert pages.get("license_plate") is not None
