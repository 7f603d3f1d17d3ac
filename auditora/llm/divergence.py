"""Source divergence audit: which sources of a language differ, and by which terms.

Every (language, source) group and every language gives each kept term a share
p = 1 + floor(10^9 (count + 1) / (N + V)); f(p, q) = floor((p - q)^2 / q) scores how far a group's share
lies from another.  All arithmetic is on whole numbers.

Count-cell ranking.  Terms of equal counts have equal scores, so terms are grouped into cells (group
count, language count), f is evaluated once a cell, cells of one value are merged, and values are
ranked by the cumulative number of terms before them; only the cells that reach the top are
expanded into terms again, in UTF-8 order.  Pairs of sources use the same idea with wider cells: terms
of equal shares in all sources are one row with a multiplicity, and a task adds up f over its rows
for all source pairs of the language, so no pair is ever a row before it is a sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from .common import named, scratch_folder

SCALE = 10**9
HELD_TERMS = 300_000  # counted terms a task keeps before it reports them
PIECE = 4 << 20  # bytes of a text split at a time
CELL_BROADCAST = 1_000_000
PROFILE_ROWS = 20_000  # cells of all sources that one task adds up
SLAB = 1 << 20  # table cells held at a time while adding up

# letters A-Z become a-z; every other byte below 0x80 that is no letter becomes a blank
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded length."""
    folded, lo = text.translate(FOLD), 0
    while len(folded) - lo > PIECE:
        cut = folded.rfind(b" ", lo, lo + PIECE)
        cut = cut if cut >= lo else folded.find(b" ", lo + PIECE)
        if cut < 0:
            break
        yield folded[lo:cut].split()
        lo = cut + 1
    yield folded[lo:].split() if lo else folded.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (lang, source, text) -> (lang, source, term, n, docs), summed over many texts."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def report():
        for (lang, source), (n, docs) in held.items():
            names = list(n)
            yield pa.record_batch([pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()),
                                   pa.array(names, pa.binary()).cast(pa.string()), pa.array([n[t] for t in names], pa.int64()),
                                   pa.array([docs[t] for t in names], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for some in terms(text.as_py()):
                n.update(some)
                own.update(some)
            docs.update(own)
            if sum(len(x) for x, _ in held.values()) > HELD_TERMS:
                yield from report()
                held.clear()
    yield from report()


def div(a: Column, b: Column) -> Column:
    """Whole-number quotient (SQL ``div``) as bigint."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)); the product is a decimal, as it may pass 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return div(top, (total + kept).cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """f(p, q); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return div((p - q) * (p - q), q)


def kept_terms(docs: DataFrame, lang: str, source: str, text: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n, lang_n) of the kept terms, (lang, source, at, total, lang_total, kept) of every group)."""
    rows = docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")  # a row for each source of the language at most
    folder = scratch_folder(docs.sparkSession, "divergence")
    counts.withColumns({"lang_n": F.sum("n").over(same), "lang_docs": F.sum("docs").over(same), "head": F.min("source").over(same) == F.col("source")}) \
        .filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "head").write.parquet(folder)
    kept = docs.sparkSession.read.parquet(folder)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("head").cast("bigint")).alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"),
                           *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "lang_total", "kept")])
    return kept, groups.checkpoint(eager=True)


def term_ranks(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms a group has more of than its language, best ``top``."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m"))
    cells = cells.join(bounded_broadcast(groups, CELL_BROADCAST), ["lang", "source"])
    cells = cells.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    cells = cells.filter("p > q").select("lang", "source", "n", "lang_n", "m", gap(F.col("p"), F.col("q")).alias("value")).checkpoint(eager=True)
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # every value holds a term, so a value beyond the first ``top`` cannot start at a rank up to it
    values = values.withColumn("place", F.row_number().over(down)).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value")
    reach = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    named_terms = kept.join(bounded_broadcast(reach, CELL_BROADCAST), ["lang", "source", "n", "lang_n"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = named_terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _add_up(cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of m f(p of a, p of b) over some cells of a language, for all its sources a and b."""
    if not len(cells) or not len(sources):
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []}).astype({"lang": str, "a": "int32", "b": "int32", "value": "int64"})
    base = np.zeros(len(sources), np.int64)
    base[sources["at"].to_numpy()] = sources["p0"].to_numpy()
    s = len(base)
    sums = np.zeros((s, s), np.int64)
    step = max(1, SLAB // s)
    for lo in range(0, len(cells), step):
        part = cells.iloc[lo:lo + step]
        table = np.repeat(base[None, :], len(part), 0)
        rows = np.repeat(np.arange(len(part)), part["ats"].map(len).to_numpy())
        table[rows, np.concatenate(part["ats"].to_list())] = np.concatenate(part["ps"].to_list())
        m = part["m"].to_numpy()[:, None]
        for a in range(s):
            d = table[:, a:a + 1] - table
            sums[a] += (m * (d * d // table)).sum(0)
    a, b = np.nonzero(~np.eye(s, dtype=bool))
    return pd.DataFrame({"lang": cells["lang"].iloc[0], "a": a.astype(np.int32), "b": b.astype(np.int32), "value": sums[a, b]})


def pair_ranks(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of every ordered pair of a language's sources."""
    shares = kept.join(bounded_broadcast(groups, CELL_BROADCAST), ["lang", "source"])
    shares = shares.select("lang", "term", F.struct("at", share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).alias("x"))
    cells = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list("x")).alias("x"))  # at most the sources of a language
    cells = cells.groupBy("lang", F.col("x.at").alias("ats"), F.col("x.p").alias("ps")).agg(F.count(F.lit(1)).alias("m"))
    live = groups.filter("kept > 0")
    parts = live.groupBy("lang").agg(F.ceil(F.max("kept") / F.greatest(F.lit(PROFILE_ROWS), 20 * F.count(F.lit(1)))).cast("int").alias("parts"))
    parts = bounded_broadcast(parts, CELL_BROADCAST)
    left = cells.join(parts, "lang").withColumn("part", F.pmod(F.xxhash64("ats", "ps"), F.col("parts")).cast("int")).drop("parts")
    right = live.join(parts, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "at",
                                            share(F.lit(0), F.col("total"), F.col("kept")).alias("p0"))
    sums = left.groupBy("lang", "part").cogroup(right.groupBy("lang", "part")).applyInPandas(_add_up, "lang string, a int, b int, value bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = bounded_broadcast(groups.select("lang", "at", "source"), CELL_BROADCAST)
    scored = sums.join(names.withColumnRenamed("at", "a"), ["lang", "a"]).join(
        names.withColumnRenamed("at", "b").withColumnRenamed("source", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    bare = groups.filter("kept = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return scored.unionByName(bare).withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows rank a group's distance to each other source
    of its language, ``term`` rows the ``top`` terms it has more of than its language.

    Terms are runs of letters A-Z (lower-cased) and characters from U+0080 on; a language keeps the terms
    that at least ``min_docs`` of its rows hold.  Defined cases: NULL language, source or text count as
    empty; repeated rows are rows; groups without terms have count 0 of every kept term; a language without
    kept terms has value 0 for all pairs and no term rows; ties go to the item of smaller UTF-8 bytes; a
    language with one source has no pair; an empty table gives no rows; other columns are ignored.
    """
    kept, groups = kept_terms(docs, lang, source, text, min_docs)
    parts = [(pair_ranks(kept, groups), "pair"), (term_ranks(kept, groups, top), "term")]
    a, b = [f.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for f, name in parts]
    return a.unionByName(b)
