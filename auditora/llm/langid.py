"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text under byte-trigram models, the
declared language (markup or a column), the address suffix (top-level domain and a language-like first path
segment), and a prior of the host.  The likelihood of declarations and suffixes and the host priors
are learnt without labels from the text posteriors of all rows, by grouped aggregation; a host's prior
is smoothed towards its domain's, the domain's towards the corpus', and leaves the row's own count out.
The trigram models are trained on a bounded sample of labelled rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from .common import let, named, release_kept, scratch_folder
from .textnum import buffers, in_spans

UNKNOWN = "und"
BITS = 16
DENSE_CELLS = 1 << 24  # a table of up to so many slots x languages is held whole (64 MB)
HELD_LANGUAGES = 64  # languages whose trigrams a task counts before it hands them on
ROWS_PER_LANGUAGE = 2000  # bound of the training sample, different texts (documented parameter)
TEMPER = 0.2  # trigrams overlap and are no independent evidence
HOST_WEIGHT, DOMAIN_WEIGHT = 4.0, 20.0  # pseudo-counts of the parent level
EVIDENCE_SMOOTHING = 1.0
DECLARED_TRUST = 10.0
UNKNOWN_PRIOR = 1e-3
MIN_CONFIDENCE = 0.5
BROADCAST_HOSTS = 100_000
PIECE = 1 << 18

# Letters and non-ASCII bytes are kept (A-Z lower-cased), all other bytes are blanks.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
BLANK3 = int((32 * 0x9E35 + 32 * 0x85EB + 32 * 0xC2B3) & ((1 << BITS) - 1))


def trigrams(data: np.ndarray) -> np.ndarray:
    """Table row of every byte trigram."""
    b = FOLD[data].astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E35) + b[1:-1] * np.uint32(0x85EB) + b[2:] * np.uint32(0xC2B3)) & np.uint32((1 << BITS) - 1)).astype(np.int32)


def visible(html: str) -> str:
    """Text of a page: scripts, styles, comments and tags are blanks."""
    import re
    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
    return re.sub(r"<[^>]*>|&[#\w]+;", " ", html)


@dataclass
class TextModel:
    """languages and the log probability of every trigram slot in each ('und' comes last).

    Only slots seen in a language are kept: those of slot i are first[i]:first[i + 1] of ``lang`` and of ``more``, the
    log probability above the language's ``floor``.
    """

    languages: list[str]
    floor: np.ndarray  # languages + 1 log probabilities of an unseen slot
    first: np.ndarray
    lang: np.ndarray
    more: np.ndarray

    @cached_property
    def table(self) -> np.ndarray:
        """slots x (languages + 1), float32."""
        out = np.tile(self.floor.astype(np.float32), (1 << BITS, 1))
        out[np.repeat(np.arange(1 << BITS), np.diff(self.first)), self.lang] += self.more
        return out

    def sums(self, t: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Sums of the log probabilities of the trigrams ``t``, a row for each piece starting at ``cuts``."""
        k, sizes = len(self.floor), np.diff(np.append(cuts, len(t)))
        start, n = self.first[t], self.first[t + 1] - self.first[t]
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        piece = np.repeat(np.repeat(np.arange(len(cuts)), sizes), n)
        more = np.bincount(piece * k + self.lang[at], weights=self.more[at], minlength=len(cuts) * k)
        return more.reshape(len(cuts), k) + sizes[:, None] * self.floor[None]

    def log_likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood per text and language, trigrams with a letter per text); shorter texts have none."""
        n, k = len(offsets) - 1, len(self.floor)
        total, count = np.zeros((n, k)), np.zeros(n, np.int64)
        table = self.table if k << BITS <= DENSE_CELLS else None
        piece = max(1, min(PIECE, (PIECE << 3) // k))  # a piece has up to k numbers a trigram
        for lo in range(0, max(0, len(data) - 2), piece):
            hi = min(len(data) - 2, lo + piece)
            t = trigrams(data[lo:hi + 2])
            at = np.arange(lo, hi)
            first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
            inner = offsets[first:last + 1]
            use = t != BLANK3
            ends = inner[(inner > lo) & (inner <= hi + 1)]
            for j in (1, 2):  # trigrams that cross the end of a text
                cross = ends - j
                cross = cross[(cross >= lo) & (cross < hi)]
                use[cross - lo] = False
            at, t = at[use], t[use]
            if not len(t):
                continue
            doc = np.searchsorted(offsets, at, "right") - 1
            cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            total[doc[cuts]] += self.sums(t, cuts) if table is None else np.add.reduceat(table[t], cuts, axis=0)
            count[doc[cuts]] += np.diff(np.append(cuts, len(t)))
        return total, count


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> TextModel:
    """Trigram models of all labelled languages.

    Each language is learnt from ``rows`` of its different texts, the first by hash, or from all where there
    are fewer; copies of a text count once.  NULL and empty labels teach nothing.  Without labels only
    'und' is known.
    """
    good = docs.select(named(lang).cast("string").alias("g"), F.coalesce(named(text).cast("string"), F.lit("")).alias("t"))
    good = good.filter(F.col("g").isNotNull() & (F.col("g") != "") & (F.col("g") != UNKNOWN))
    good = good.withColumn("h", F.shiftrightunsigned(F.xxhash64("t", F.lit(17)), 1))
    texts = good.select("g", "h").distinct().checkpoint(eager=True)
    # twice the rows wanted of a large language, so that its window holds few rows and enough of them
    share = F.least(F.lit(1.0), F.lit(2.0 * rows + 200) / F.count(F.lit(1)))
    sizes = texts.groupBy("g").agg((share * float(1 << 63)).alias("below"))
    some = texts.join(bounded_broadcast(sizes, BROADCAST_HOSTS), "g").filter(F.col("h").cast("double") <= F.col("below"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    last = some.withColumn("n", place).filter(F.col("n") <= rows).groupBy("g").agg(F.max("h").alias("last")).collect()
    names = sorted(r["g"] for r in last)
    uniform = -BITS * np.log(2.0)
    if not names:
        return TextModel([], np.array([uniform]), np.zeros((1 << BITS) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    index = {g: i for i, g in enumerate(names)}
    # a list of rows would pass through a second kind of Python workers, whose daemons stay in the executors
    told = json.dumps([{"g": r["g"], "i": index[r["g"]], "last": r["last"]} for r in last])
    lasts = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<g: string, i: int, last: bigint>>")))
    picked = good.join(F.broadcast(lasts), "g").filter(F.col("h") <= F.col("last")).groupBy("i", "h").agg(F.min("t").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def counted() -> pa.RecordBatch:
            slots = [np.flatnonzero(x) for x in held.values()]
            g = np.repeat(np.array(list(held), np.int32), [len(x) for x in slots])
            slot = np.concatenate([*slots, np.zeros(0, int)]).astype(np.int32)
            n = np.concatenate([*(x[at] for x, at in zip(held.values(), slots)), np.zeros(0, np.int64)])
            held.clear()
            return pa.record_batch([pa.array(g), pa.array(slot), pa.array(n)], names=["g", "slot", "n"])

        release_kept()
        for b in batches:
            data, offsets = buffers(b.column(1))
            for g, lo, hi in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                if g not in held and len(held) == HELD_LANGUAGES:
                    yield counted()
                sums = held.setdefault(g, np.zeros(0, np.int64))
                if hi - lo > 2:
                    sums = sums if len(sums) else np.zeros(1 << BITS, np.int64)
                    for at in range(lo, hi - 2, PIECE):
                        sums += np.bincount(trigrams(data[at:min(hi, at + PIECE + 2)]), minlength=1 << BITS)
                    held[g] = sums
        yield counted()

    counts = picked.select("i", "t").mapInArrow(count, "g int, slot int, n bigint").groupBy("g", "slot").agg(F.sum("n").alias("n"))
    seen = counts.filter(F.col("slot") != BLANK3).toArrow()  # one row per language and slot seen in its sample
    slot, g, n = (seen[c].to_numpy().astype(t) for c, t in (("slot", int), ("g", int), ("n", float)))
    order = np.argsort(slot * len(names) + g)
    slot, g, n = slot[order], g[order], n[order]
    whole = np.bincount(g, weights=n, minlength=len(names)) + 0.01 * (1 << BITS)
    first = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=1 << BITS))))
    return TextModel(names, np.append(np.log(0.01 / whole), uniform), first, g.astype(np.int32), np.log1p(n / 0.01).astype(np.float32))


def text_evidence(spark, model: TextModel, text: Column, markup: bool = False) -> Column:
    """Tempered log likelihoods (array, 'und' last) of a text column; NULL array without any letter."""
    held = spark.sparkContext.broadcast(model)

    def evidence(t: pa.Array) -> pa.Array:
        release_kept()
        if markup:
            t = pa.array([visible(x or "") for x in t.to_pylist()], pa.string())
        data, offsets = buffers(t)
        total, _ = held.value.log_likelihoods(data, offsets)
        letters = np.concatenate(([0], np.cumsum(FOLD[data] != 32)))
        count = letters[offsets[1:]] - letters[offsets[:-1]]
        scaled = (total - total.max(axis=1, keepdims=True)) * TEMPER if total.shape[1] else total
        k = total.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * k), pa.array(scaled.ravel()),
                                        mask=pa.array(count == 0))

    return F.arrow_udf(in_spans(evidence), "array<double>")(F.coalesce(text.cast("string"), F.lit("")))


def normal(logs: Column) -> Column:
    """Array of log weights -> array of probabilities."""
    shifted = let(logs, lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))
    return let(shifted, lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(a, lambda x: x / total)))


def _sums(k: int, values: Column) -> Column:
    return F.array(*[F.sum(F.coalesce(F.get(values, F.lit(i)), F.lit(0.0))) for i in range(k)])


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds (language, confidence) to rows with (_ll, _declared, _suffix, _host, _domain).

    Any evidence may be NULL and then says nothing.  All other columns are kept.
    """
    k = len(languages) + 1
    prior = np.array([(1 - UNKNOWN_PRIOR) / max(1, k - 1)] * (k - 1) + [UNKNOWN_PRIOR if k > 1 else 1.0])
    flat = F.array(*[F.lit(float(p)) for p in prior])
    none = F.array(*[F.lit(0.0)] * k)
    # text alone, under a flat prior: the soft label of every row
    soft = normal(F.zip_with("_ll", flat, lambda a, p: a + F.log(p)))
    seen = rows.select("_host", "_domain", "_declared", "_suffix", soft.alias("_soft")).filter("_soft IS NOT NULL")
    per = seen.groupBy("_host", "_domain", "_declared", "_suffix").agg(_sums(k, F.col("_soft")).alias("s"))
    per = per.checkpoint(eager=True)  # one row per combination; every table below is a sum of it

    def table(*by: str) -> DataFrame:
        return per.groupBy(*by).agg(_sums(k, F.col("s")).alias("s"))

    all_sum = per.agg(_sums(k, F.col("s")).alias("s")).first()["s"]
    total = np.array([x or 0.0 for x in all_sum]) if all_sum else np.zeros(k)
    corpus = (total + prior * 10) / (total.sum() + 10)
    langs_total = F.array(*[F.lit(float(x)) for x in total])
    corpus_lit = F.array(*[F.lit(float(x)) for x in corpus])

    def smoothed(sums: Column, parent: Column, weight: float) -> Column:
        return let(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x), lambda n: F.zip_with(
            sums, parent, lambda x, p: (x + F.lit(weight) * p) / (n + F.lit(weight))))

    domains = table("_domain").filter("_domain IS NOT NULL").select(
        F.col("_domain").alias("d"), smoothed(F.col("s"), corpus_lit, DOMAIN_WEIGHT).alias("dp"))
    hosts = table("_host", "_domain").filter("_host IS NOT NULL").groupBy("_host").agg(
        F.min("_domain").alias("_domain"), _sums(k, F.col("s")).alias("s"))
    hosts = hosts.join(domains, F.col("_domain") == F.col("d"), "left").select(
        F.col("_host").alias("h"), F.col("s").alias("hs"), F.coalesce("dp", corpus_lit).alias("dp"))

    def likelihood(by: str, name: str, trust: float = 0.0) -> DataFrame:
        """log P(value | language), add-one smoothed over the values of the corpus; a value that is a
        language's own name has ``trust`` counts from the start."""
        every = rows.select(by).filter(F.col(by).isNotNull()).distinct()
        t = every.join(table(by).select(F.col(by).alias("_v"), "s"), F.col(by) == F.col("_v"), "left")
        values = max(1, t.count())
        head = F.array(*[F.when(F.col(by) == g, F.lit(trust)).otherwise(F.lit(0.0)) for g in [*languages, UNKNOWN]])
        counts = F.zip_with(F.coalesce("s", none), head, lambda x, h: x + h)
        return t.select(F.col(by).alias(name + "_v"), F.zip_with(counts, langs_total, lambda x, n: F.log(
            (x + EVIDENCE_SMOOTHING) / (n + trust + EVIDENCE_SMOOTHING * (values + 1)))).alias(name))

    out = rows.withColumn("_soft", soft)
    for right, mine, theirs in ((hosts, "_host", "h"), (likelihood("_declared", "ld", DECLARED_TRUST), "_declared", "ld_v"),
                                (likelihood("_suffix", "ls"), "_suffix", "ls_v")):
        out = out.join(bounded_broadcast(right, BROADCAST_HOSTS), F.col(mine) == F.col(theirs), "left").drop(theirs)
    own = F.coalesce("_soft", none)
    others = F.zip_with(F.coalesce("hs", own), own, lambda a, b: F.greatest(F.lit(0.0), a - b))
    host_prior = smoothed(others, F.coalesce("dp", corpus_lit), HOST_WEIGHT)
    logs = F.transform(host_prior, lambda p: F.log(p + F.lit(1e-12)))
    for e in ("_ll", "ld", "ls"):
        logs = F.zip_with(logs, F.coalesce(e, none), lambda a, b: a + b)
    probs = normal(logs)
    named_langs = F.array(*[F.lit(g) for g in [*languages, UNKNOWN]])
    best = let(probs, lambda p: let(F.array_max(p), lambda m: F.struct(
        m.alias("p"), F.element_at(named_langs, F.array_position(p, m).cast("int")).alias("g"))))
    out = out.withColumn("_best", F.when(F.col("_ll").isNotNull(), best))
    out = out.withColumn("language", F.coalesce(F.col("_best.g"), F.lit(UNKNOWN)))
    out = out.withColumn("confidence", F.coalesce(F.col("_best.p"), F.lit(0.0)))
    return out.drop("_soft", "_best", "hs", "dp", "ld", "ls")


def page_parts(url: Column, html: Column) -> dict[str, Column]:
    """Host, domain, address suffix and declared language of a page (NULL where there is none)."""
    def some(c: Column) -> Column:
        return F.when(c != "", c)
    host = some(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    labels = F.split(host, "\\.")
    domain = F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(host)
    segment = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:[/?#]|$)", 1))
    suffix = F.when(host.isNotNull(), F.concat_ws("/", F.element_at(labels, -1), some(segment)))
    declared = some(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)))
    return {"_host": host, "_domain": domain, "_suffix": suffix, "_declared": declared}


def identify_pages(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, declared, language, confidence, rejected) of every page.

    Defined cases: a page without letters is 'und' with confidence 0; NULL addresses, hosts and
    declarations are no evidence; repeated rows are judged alike; rejected means 'und' or a confidence
    below ``MIN_CONFIDENCE``.  An empty table gives no rows.
    """
    parts = page_parts(named(url), named(html))
    rows = pages.select(named(key).alias("_key"), *[c.alias(n) for n, c in parts.items()],
                        text_evidence(pages.sparkSession, model, named(html), markup=True).alias("_ll")).checkpoint(eager=True)
    out = fuse(rows, model.languages)
    return out.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_declared").alias("declared"), "language",
                      "confidence", ((F.col("language") == UNKNOWN) | (F.col("confidence") < MIN_CONFIDENCE)).alias("rejected"))


def keep_identified(docs: DataFrame, model: TextModel, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """Rows of ``docs`` whose language is identified, all columns kept (``declared`` and ``host`` are evidence).

    A document is rejected if it has no letters, fits no known language better than chance, or its best
    language has a confidence below ``MIN_CONFIDENCE``.
    """
    plain = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
                        text_evidence(docs.sparkSession, model, named(text)).alias("_ll"),
                        F.lower(named(declared).cast("string")).alias("_declared"), named(host).cast("string").alias("_host"),
                        F.lit(None).cast("string").alias("_domain"), F.lit(None).cast("string").alias("_suffix"))
    # the evidence is read for the sums and again for the answer: score the texts once
    folder = scratch_folder(docs.sparkSession, "evidence")
    plain.write.parquet(folder)
    judged = fuse(docs.sparkSession.read.schema(plain.schema).parquet(folder), model.languages)
    kept = judged.filter((F.col("language") != UNKNOWN) & (F.col("confidence") >= MIN_CONFIDENCE))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
