"""Stand-in inputs built from the driver tables (FIXTURES.md, part B).

Each builder only reshapes the given tables into the schema an audit expects (a decision
table, a table with gaps, ...); none of them does an operator's work.  Every builder has
an SQL twin with the same rows so that the DuckDB oracle sees identical input.
Gap injection uses fixed, data-driven rules (documented per fixture), never row caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from ..session import table

# nation and region are dimension tables of fixed size; the bound is still checked.
DIMENSION_BROADCAST_ROWS = 100_000


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_decisions: one decision per order with three candidate sensitive attributes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                               "o_orderpriority", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = bounded_broadcast(n.join(bounded_broadcast(r, DIMENSION_BROADCAST_ROWS), n.n_regionkey == r.r_regionkey)
                            .select("n_nationkey", "r_name"), DIMENSION_BROADCAST_ROWS)
    cust = c.join(geo, c.c_nationkey == geo.n_nationkey)
    d = o.join(cust, o.o_custkey == cust.c_custkey)
    return d.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_mktsegment").alias("s1"),
        F.col("o_orderpriority").alias("s2"),
        F.col("r_name").alias("s3"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") > 250000).cast("int").alias("p"),
        (F.col("o_totalprice") / 500000.0).alias("score"),
        F.col("c_acctbal"),
        F.month("o_orderdate").alias("o_month"),
        F.col("o_orderstatus").alias("status"),
    )


DECISIONS_SQL = """
SELECT o.o_orderkey AS row_id, c.c_mktsegment AS s1, o.o_orderpriority AS s2, r.r_name AS s3,
       CAST(o.o_orderstatus = 'F' AS INTEGER) AS y, CAST(o.o_totalprice > 250000 AS INTEGER) AS p,
       o.o_totalprice / 500000.0 AS score, c.c_acctbal AS c_acctbal, month(o.o_orderdate) AS o_month,
       o.o_orderstatus AS status
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_doc_labels: labelled documents; quality is the outcome, "not toxic" the decision."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", "lang", "source", F.col("quality").alias("y"),
                    (1 - F.col("toxic")).alias("p"), "n_chars")


DOC_LABELS_SQL = """
SELECT l.doc_id AS doc_id, d.lang AS lang, d.source AS source, l.quality AS y, 1 - l.toxic AS p, d.n_chars AS n_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_gaps: events with deterministic gaps.

    value NULL when event_id % 7 = 0, event_type NULL when event_id % 11 = 0 and a
    derived numeric column ``bonus`` present only when event_id % 4 = 0 (75 % missing).
    """
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(eid % 4 == 0, F.col("value") * 2).otherwise(F.lit(None)).alias("bonus"),
    )


GAPS_SQL = """
SELECT event_id, ts, user_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 4 = 0 THEN value * 2 ELSE NULL END AS bonus
FROM events
"""


def empty_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_empty_dup: part without its key; rows of size 1 blanked out entirely, rows of size
    2..5 present twice (exact duplicates)."""
    p = table(spark, sf_dir, "part")
    blank = F.col("p_size") == 1
    cols = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    base = p.select(*[F.when(blank, F.lit(None)).otherwise(F.col(c)).cast(p.schema[c].dataType).alias(c) for c in cols])
    dups = p.where(F.col("p_size").between(2, 5)).select(*cols)
    return base.unionByName(dups)


EMPTY_DUP_SQL = """
SELECT CASE WHEN p_size = 1 THEN NULL ELSE p_name END AS p_name,
       CASE WHEN p_size = 1 THEN NULL ELSE p_brand END AS p_brand,
       CASE WHEN p_size = 1 THEN NULL ELSE p_type END AS p_type,
       CASE WHEN p_size = 1 THEN NULL ELSE p_size END AS p_size,
       CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice END AS p_retailprice
FROM part
UNION ALL
SELECT p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size BETWEEN 2 AND 5
"""


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_numeric: lineitem measures plus a linear copy and a constant column."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     (F.col("l_quantity") * 2 + 1).alias("l_qty_lin"), F.lit(1.0).alias("l_const"))


NUMERIC_SQL = """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + 1 AS l_qty_lin, 1.0::DOUBLE AS l_const
FROM lineitem
"""
