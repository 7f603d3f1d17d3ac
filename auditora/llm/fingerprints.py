"""Document fingerprints by one-permutation MinHash (DataFrame expressions only).

Every 5-word shingle is hashed once; the top bits of the hash name one of 128 bins and each bin
keeps its least hash.  Empty bins are filled by optimal densification: every empty bin walks its
own pseudo-random order of all bins and copies the first non-empty one, which equals taking the
non-empty bin of least priority hash(empty bin, bin).  The 8 low-order bits of each bin are packed
as hex.  Agreement of two fingerprints is corrected for the 2^-8 chance of equal low-order bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import key_as_double, with_buckets
from .common import default_parallelism, let, named, words_of

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
DIGITS = LOW_BITS // 4
WIDTH = 5
EMPTY = ""
# Rows of one window partition when neighbouring documents are paired.
ROWS_PER_CHUNK = 65_536
# Hash ranges that the rows of one repeated or NULL key are cut into.
TIE_BITS = 6


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Sorted distinct-or-not hashes of the word shingles; a shorter text is one shingle."""
    def build(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width),
                           lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(width)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
            F.size(w) < width, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(each)
    return F.sort_array(let(words, build))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def minima(sorted_hashes: Column) -> Column:
    """First (least) hash of every non-empty bin of a sorted hash array."""
    return let(sorted_hashes, lambda s: F.filter(
        s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.coalesce(F.get(s, i - 1), h)))))


def densified(mins: Column) -> Column:
    """Low-order bits of all bins as one hex string; empty for no hashes at all."""
    def low(h: Column) -> Column:
        return F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))), DIGITS, "0")

    def fill(m: Column) -> Column:
        have = F.map_from_arrays(F.transform(m, bin_of), m)

        def borrowed(b: Column) -> Column:
            return F.array_min(F.transform(m, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("p"), h.alias("h"))))["h"]

        return let(have, lambda have_: F.array_join(F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)),
            lambda b: low(F.coalesce(F.element_at(have_, b), borrowed(b)))), ""))

    return let(mins, lambda m: F.when(F.size(m) == 0, F.lit(EMPTY)).otherwise(fill(m)))


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """Packed fingerprint of a text: 256 hex digits, '' for a text without words."""
    return densified(minima(shingle_hashes(words_of(text), width)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints in [0, 1]; two empty ones are alike."""
    chance = 1.0 / (1 << LOW_BITS)

    def agreed() -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda acc, i: acc + F.when(
            F.substr(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, i * DIGITS + 1, F.lit(DIGITS)), 1).otherwise(0))

    corrected = (agreed() / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).when(
        (a == EMPTY) | (b == EMPTY), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), corrected))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) for every row; NULL text counts as empty."""
    return docs.select(named(key), fingerprint(named(text).cast("string")).alias("fingerprint"))


def _chunked(rows: DataFrame, n_rows: int) -> DataFrame:
    """Add (chunk, tie): monotone ranges of (key, text hash) small enough for one sort.

    Chunks are quantile ranges of the key.  A key that fills several quantiles, and the NULL key
    (chunk -1), is cut further by ranges of the text hash.
    """
    n = max(default_parallelism(rows), -(-n_rows // ROWS_PER_CHUNK))
    as_double = key_as_double(rows.schema["key"].dataType, F.col("key"))
    if as_double is None:
        raise TypeError("the document key must be numeric, a date or a timestamp")
    got = sorted(rows.agg(F.percentile_approx(as_double, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or [0.0])
    splits = sorted(set(got))
    hot = sorted({a for a, b in zip(got, got[1:]) if a == b})  # keys that fill several quantiles
    inf = float("inf")
    out = with_buckets(rows, {"key": as_double}, {"key": [-inf, *splits, inf]}, {"key": "chunk"})
    crowded = F.col("key").isNull() | (as_double.isin(hot) if hot else F.lit(False))
    # a crowded key is the least of its chunk; the rest of the chunk sorts after all its ties
    tie = F.when(crowded, F.shiftright(F.col("h"), 64 - TIE_BITS)).otherwise(F.lit(1 << TIE_BITS))
    return out.withColumn("tie", tie.cast("int"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, fp, next_text, next_fp): each document beside the one after it.

    Order: ascending key (NULL first), then text hash, then text; after the last comes the first.
    The first row of every chunk is added to the chunk before it as a guard, so one range-like
    exchange pairs all rows and no task sees the whole order.
    """
    base = docs.select(named(key).alias("key"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    ids = docs.select(named(key).alias("key"))
    rows = _chunked(base.withColumn("h", F.xxhash64("text")), ids.count())
    place = F.struct("key", "h", "text")
    firsts = rows.groupBy("chunk", "tie").agg(F.min(place).alias("f"))
    # one row per chunk: the chunk before it in the order, around the end
    keys = firsts.select("chunk", "tie")
    w = Window.orderBy("chunk", "tie")
    last = keys.agg(F.max(F.struct("chunk", "tie")).alias("last"))
    before = keys.withColumn("prev", F.lag(F.struct("chunk", "tie")).over(w))
    before = before.join(F.broadcast(last)).select(
        F.col("chunk").alias("c"), F.col("tie").alias("t"), F.coalesce("prev", "last").alias("prev"))
    guards = firsts.join(before, (F.col("chunk") == F.col("c")) & (F.col("tie") == F.col("t"))).select(
        F.col("f.key").alias("key"), F.col("f.text").alias("text"), F.col("f.h").alias("h"),
        F.col("prev.chunk").alias("chunk"), F.col("prev.tie").alias("tie"), F.lit(1).alias("guard"))
    both = rows.select("key", "text", "h", "chunk", "tie", F.lit(0).alias("guard")).unionByName(guards)
    both = both.withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("chunk", "tie").orderBy("guard", F.col("key").asc_nulls_first(), "h", "text")
    paired = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
    return paired.filter(F.col("guard") == 0).drop("guard", "chunk", "tie", "h")


def edit_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their estimated likeness.

    The edited text replaces the last floor(n/4) code points by the first as many (or all) of the
    next document.  Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Defined cases: NULL text is empty; texts without words have the empty
    fingerprint; a lone document is its own next; repeated rows follow each other and each gets a
    row; an empty table gives no rows; a key that is no number, date or timestamp raises ``TypeError``.
    """
    paired = with_next(docs, key, text)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - k), F.substr(F.col("next_text"), F.lit(1), k))
    rows = paired.select("key", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = rows.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp",
                       fingerprint(F.col("edited")).alias("efp"))
    return rows.select(F.col("key").alias(key), "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"),
                       F.col("efp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
