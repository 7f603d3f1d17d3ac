"""Registered audit queries over the driver tables, each with its DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame`` that runs library operators on the
whole input tables; floating results are rounded to 6 places at this boundary only
(the library itself returns full precision).  ``SQL`` holds the equivalent ANSI SQL
for DuckDB over views named like the tables; queries without SQL (random or model
based operators) are checked by property tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.common import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HEADLINE: list[str] = []


def bigint_count_if(sql: str) -> str:
    """DuckDB types count_if as HUGEINT; Spark's count_if is BIGINT.  Wrap every call in a
    BIGINT cast so both sides report the same schema."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = bigint_count_if(sql)
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def union_long(src: str, cols: list[str], keep: str, name_col: str = "feature", value_col: str = "grp") -> str:
    """SQL unpivot: one UNION ALL branch per column."""
    parts = [f"SELECT {keep}, '{c}' AS {name_col}, CAST({c} AS VARCHAR) AS {value_col} FROM {src}" for c in cols]
    return "\nUNION ALL\n".join(parts)


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_fairness, q_profile  # noqa: F401
    from . import q_misc, q_ml, q_privacy, q_report, q_target  # noqa: F401
