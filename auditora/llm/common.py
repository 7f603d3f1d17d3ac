"""Helpers shared by the training-data operators (column access, bindings, bounds)."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space: space and \t \n \v \f \r.
WHITE = "[\\x20\\x09-\\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def named(name: str) -> Column:
    """Column by its exact name (dots and backticks in the name are no syntax)."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for NULL or blank text."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE_CHARS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE + "+")))


def unused(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have (case-insensitively)."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name += "_"
    return name


def default_parallelism(df: DataFrame) -> int:
    """Shuffle partitions of the session: the least number of pieces worth making."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """``make()`` once per Python worker process.

    The library's functions travel to the workers by value, so module globals start anew in every
    task; what is worth keeping (compiled vocabularies) hangs on a module of the process instead.
    Workers serve one stage after another, so objects of another kind (the key's first part) go.
    """
    name = "_kept_by_worker"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("objects", {})
    for other in [k for k in store if k[0] != key[0]]:
        del store[other]
    if key not in store:
        store[key] = make()
    return store[key]


def release_kept() -> None:
    """Lets go of what earlier stages kept in this worker process; for stages that keep nothing themselves."""
    per_worker(("nothing",), lambda: None)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


ARROW_ROWS = 2000
ARROW_BYTES = 2 << 20


def small_arrow_batches(spark: SparkSession) -> None:
    """Sets the session to batches of at most ``ARROW_ROWS`` rows, and of ``ARROW_BYTES`` and a row, between Spark and Python.

    Rows of these operators are whole texts: Spark's 10 000 rows a batch would hold tens of megabytes in the executor
    and again in each Python worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def settled(df: DataFrame, rows_per_partition: int = 250_000) -> DataFrame:
    """Checkpointed rows in as many partitions as their number asks for.

    Small intermediate tables come out of a shuffle in many near-empty partitions; every later job
    over them would pay for each.
    """
    done = df.checkpoint(eager=True)
    return done.coalesce(max(1, -(-done.count() // rows_per_partition)))
