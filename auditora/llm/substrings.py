"""Substring de-duplication over a compacted De Bruijn graph of words.

Edges are windows of ``size`` consecutive words of one document, named by the BLAKE2b digest of their
words; an edge that occurs more than once is repeated, and every occurrence but the first (in the order of
documents, then of places) repeats an earlier one.  Repeated edges that follow one another, at both
ends of the repetition, form a path, which a join of neighbours compacts into one row: place, earlier place,
length.  A path breaks where the graph branches, as the next edge then comes from another place.  At last
the words at both coordinates of every path are read again and compared by digest; only verified
paths take words away.

Three things keep the work near the size of what is repeated.  Whole texts that equal an earlier one are
set aside first.  Of every window only its minimizer, the least of the hashes of its short word grams, is
exchanged to find out where anything may repeat: equal windows have equal minimizers, so a window
whose minimizer is nowhere else is unique.  And each task reports an edge once, by its first place
there; its further places are settled by the task, so a very common edge costs a row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bounded_broadcast
from .common import named, scratch_folder, unused
from .textnum import PIECE, buffers, give_back, mix, ranges, small_batches, span_hashes, spans as spans_of, word_bounds

GRAM = 8  # words of a gram from which minimizers are taken
BLOCK = 1 << 19  # windows whose minimizers are found at a time
SEGMENT = 1_000_000  # windows a task holds before it settles them
GRAM_BROADCAST = 2_000_000  # repeated minimizers (8 bytes each) that are broadcast
SIDE_BYTES = 32 << 20  # places of all documents that are broadcast beside the texts


class Words:
    """The words of some texts: where they stand, and for every window its minimizer.

    Words are numbered through all texts; ``first[i]`` is the first of text i.  All arrays are over the words of one
    batch of bounded text (or of one longer text), filled a block at a time.
    """

    def __init__(self, column, size: int, gram: int):
        self.data, offsets = buffers(column)
        self.starts, self.ends = word_bounds(self.data, offsets) if len(self.data) else (np.zeros(0, np.int64),) * 2
        self.first = np.searchsorted(self.starts, offsets)
        self.size, self.gram = size, gram

    def grams(self) -> np.ndarray:
        """64-bit hash of every run of ``gram`` words (runs over the end of a text mean nothing)."""
        words, lo = np.empty(len(self.starts), np.uint64), 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + PIECE, "right")))
            a, b = int(self.starts[lo]), int(self.ends[hi - 1])
            words[lo:hi] = span_hashes(self.data[a:b], self.starts[lo:hi] - a, self.ends[lo:hi] - a, 5)
            lo = hi
        n = max(0, len(words) - self.gram + 1)
        acc = np.zeros(n, np.uint64)
        for j in range(self.gram):
            acc = (acc ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j) + np.uint64(j + 1)
            acc ^= acc >> np.uint64(29)
        return mix(acc, 6)

    def windows(self) -> np.ndarray:
        """First words of all windows that lie in one text."""
        n = len(self.starts) - self.size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        inside = np.ones(n, bool)
        for at in self.first[1:-1].tolist():  # no window goes over the start of a text
            inside[max(0, at - self.size + 1):at] = False
        return np.flatnonzero(inside)

    def minimizers(self, grams: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For every window the number of its least gram (the first of equal ones)."""
        out = np.empty(len(windows), np.int64)
        for lo in range(0, len(windows), BLOCK):
            at = windows[lo:lo + BLOCK]
            best, where = grams[at], at.copy()
            for j in range(1, self.size - self.gram + 1):
                other = grams[at + j]
                less = other < best
                best = np.where(less, other, best)
                where[less] = at[less] + j
            out[lo:lo + BLOCK] = where
        return out

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, "right") - 1

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(all words joined by single blanks, start and end of every word in it)."""
        length = self.ends - self.starts
        ends = np.cumsum(length + 1) - 1
        flat = np.append(self.data, np.uint8(32))[ranges(self.starts, length + 1)]
        flat[ends] = 32
        return flat.tobytes(), ends - length, ends


def digest(raw: bytes | memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _sampler(size: int, gram: int):
    """mapInArrow: (row, text) -> (row, gram hash, place) of every minimizer of the text's windows."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            words = Words(batch.column(1), size, gram)
            grams = words.grams()
            at = np.unique(words.minimizers(grams, words.windows()))
            owner = words.text_of(at)
            rows = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            yield pa.record_batch([pa.array(rows), pa.array(grams[at].view(np.int64)), pa.array((at - words.first[owner]).astype(np.int32))],
                                  names=["row", "gram", "place"])
    return sample


EDGES = "e1 bigint, e2 bigint, id {id}, row bigint, place int, from_row bigint, from_place int, windows int"


def _edger(size: int, gram: int):
    """mapInArrow: (row, id, text, places of repeated minimizers) -> edges that may be repeated.

    An edge's first place of a segment of rows comes with no source.  Its further places have that first place as
    their source and need no exchange; neighbours among them come as one run of windows.
    """
    def settle(held: list) -> pa.RecordBatch:
        digests = np.concatenate([h[0] for h in held])
        owner = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        place = np.concatenate([h[1] for h in held])
        rank = np.empty(len(held), np.int64)  # of the documents in the order of (id, row), NULL ids last
        rank[sorted(range(len(held)), key=lambda i: (True, held[i][2]) if held[i][3] is None else (False, held[i][3], held[i][2]))] = np.arange(len(held))
        order = np.lexsort((place, rank[owner], digests[:, 1], digests[:, 0]))
        sorted_digests = digests[order]
        head = np.ones(len(order), bool)
        head[1:] = (sorted_digests[1:] != sorted_digests[:-1]).any(1)
        first = np.empty(len(order), np.int64)
        first[order] = order[head][np.cumsum(head) - 1]
        own = first == np.arange(len(order))
        rows = np.array([h[2] for h in held], np.int64)
        again = np.flatnonzero(~own)  # by row and place already
        runs = np.ones(len(again), bool)
        runs[1:] = (np.diff(owner[again]) != 0) | (np.diff(place[again]) != 1) | (np.diff(owner[first[again]]) != 0) | (np.diff(place[first[again]]) != 1)
        at = np.concatenate((np.flatnonzero(own), again[runs]))
        settled = np.arange(len(at)) >= own.sum()
        windows = np.concatenate((np.ones(own.sum(), np.int64), np.diff(np.append(np.flatnonzero(runs), len(again)))))
        # a settled run needs no name and no id
        e1, e2 = (pa.array(digests[at, k], mask=settled) for k in (0, 1))
        ids = pa.array([h[3] for h in held], held[0][4]).take(pa.array(owner[at], pa.int64(), mask=settled))
        return pa.record_batch([e1, e2, ids, pa.array(rows[owner[at]]), pa.array(place[at]), pa.array(rows[owner[first[at]]], mask=~settled),
                                pa.array(place[first[at]], mask=~settled), pa.array(windows.astype(np.int32))],
                               names=["e1", "e2", "id", "row", "place", "from_row", "from_place", "windows"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in small_batches(batches, 2):
            words = Words(batch.column(2), size, gram)
            marked = np.zeros(max(1, len(words.starts)), bool)
            places = batch.column(3)
            flat = places.flatten().to_numpy(zero_copy_only=False)
            marked[flat + np.repeat(words.first[:-1], pc.list_value_length(places).to_numpy(zero_copy_only=False))] = True
            windows = words.windows()
            windows = windows[marked[words.minimizers(words.grams(), windows)]]
            text, begin, end = words.joined()
            raw = memoryview(text)
            made = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(begin[windows].tolist(), end[windows + size - 1].tolist())]), np.int64).reshape(-1, 2)
            cuts = np.searchsorted(windows, words.first)
            rows, ids, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.schema.field(1).type
            for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if lo < hi:
                    held.append((made[lo:hi], (windows[lo:hi] - words.first[i]).astype(np.int32), rows[i], ids[i], kind))
                    n += hi - lo
            if n >= SEGMENT:
                yield settle(held)
                held, n = [], 0
        if held:
            yield settle(held)
        give_back()
    return make


def _digest_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (row, text, spans as place and words) -> (row, place, words, digest of the span's words)."""
    for batch in small_batches(batches, 1):
        words, out = Words(batch.column(1), 1, 1), []
        text, begin, end = words.joined()
        raw = memoryview(text)
        for row, first, spans in zip(batch.column(0).to_pylist(), words.first.tolist(), batch.column(2).to_pylist()):
            out += [(row, s["place"], s["words"], digest(raw[begin[first + s["place"]]:end[first + s["place"] + s["words"] - 1]])) for s in spans]
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                              names=["row", "place", "words", "digest"])


def _result(kept: bytes, as_hash: bool) -> str:
    return hashlib.sha256(kept).hexdigest() if as_hash else kept.decode("utf-8", "replace")


def _plain_results(texts: pa.Array, again: pa.Array, open_: pa.Array, size: int, as_hash: bool) -> pa.Array:
    """(n_words, n_removed, kept) of texts that no path can touch; a repeated text of ``size`` words or more goes whole."""
    out = []
    data, offsets = buffers(texts)
    raw = memoryview(np.ascontiguousarray(data))
    for a, b, copy, later in zip(offsets[:-1].tolist(), offsets[1:].tolist(), again.to_pylist(), open_.to_pylist()):
        words = [] if later else bytes(raw[a:b]).split()
        gone = copy and len(words) >= size
        out.append((len(words), len(words) if gone else 0, None if later else _result(b"" if gone else b" ".join(words), as_hash)))
    give_back()
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                      names=["n_words", "n_removed", "kept"])


CUT = "n_words bigint, n_removed bigint, kept string, unproved bigint"


def _cutter(texts: pa.Array, spans: pa.Array, as_hash: bool) -> pa.Array:
    """What is left of every text outside its spans; a span takes words away only if its words have the source's digest."""
    out = []
    for lo, n in spans_of(texts):
        words = Words(texts.slice(lo, n), 1, 1)
        text, begin, end = words.joined()
        raw = memoryview(text)
        for i, own in enumerate(spans.slice(lo, n).to_pylist()):
            a, b = int(words.first[i]), int(words.first[i + 1])
            keep, unproved = np.ones(b - a, bool), 0
            for s in own or ():
                if digest(raw[begin[a + s["place"]]:end[a + s["place"] + s["words"] - 1]]) == s["digest"]:
                    keep[s["place"]:s["place"] + s["words"]] = False
                else:
                    unproved += 1
            left = np.flatnonzero(keep)
            edge = np.flatnonzero(np.diff(left, prepend=-2, append=-2) != 1)  # runs of kept words
            runs = [bytes(raw[begin[a + left[x]]:end[a + left[y - 1]]]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
            out.append((b - a, b - a - len(left), _result(b" ".join(runs), as_hash), unproved))
    give_back()
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))],
                                      names=["n_words", "n_removed", "kept", "unproved"])


class Repeats:
    """State of one run: documents named by their rows, and the repeated paths found.

    The texts are joined with what was found about them once.  That join writes ``self.rows``: the results of
    documents that hold no repeated minimizer, and the texts of the others, which all later steps read.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, size: int, as_hash: bool = False):
        self.spark, self.size, self.gram, self.as_hash = docs.sparkSession, size, min(GRAM, size), as_hash
        body = F.coalesce(named(text).cast("string"), F.lit(""))
        # a document is named by a hash of its key and text; equal rows are one document
        rows = docs.select(named(key).alias("id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("same"))
        self.docs = rows.withColumn("row", F.xxhash64(F.col("id"), F.col("id").isNull(), F.col("same")))
        self.kind = self.docs.schema["id"].dataType.simpleString()
        named_rows = self.docs.select("same", "id", "row").withColumn("place", F.struct(F.col("id").isNull().alias("last"), "id", "row"))
        firsts = named_rows.groupBy("same").agg(F.min("place").alias("m"), F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("d")).filter("n > 1")
        self.copies = firsts.select("same", F.col("m.row").alias("first"), (F.col("n") > F.col("d")).alias("twins")).checkpoint(eager=True)
        self.twins = not self.copies.filter("twins").isEmpty()  # some rows are equal in key and text
        self.rows = self.joined()

    def beside(self, small: DataFrame, size: Column) -> DataFrame:
        """``small`` hinted for broadcast if its rows and bytes are counted and few."""
        got = small.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
        return F.broadcast(small) if got["n"] <= GRAM_BROADCAST and (got["b"] or 0) <= SIDE_BYTES else small

    def texts(self) -> DataFrame:
        """(row, id, text, again): ``again`` says that the text equals an earlier document's."""
        copies = bounded_broadcast(self.copies.select("same", "first"), GRAM_BROADCAST // 8)
        return self.docs.join(copies, "same", "left").select("row", "id", "text", (F.col("first").isNotNull() & (F.col("first") != F.col("row"))).alias("again"))

    def joined(self) -> DataFrame:
        """(row, id, n_words, n_removed, kept, text, places): results, or text and places of repeated minimizers."""
        texts = self.texts()
        marks = texts.filter(~F.col("again")).select("row", "text").mapInArrow(_sampler(self.size, self.gram), "row bigint, gram bigint, place int")
        if self.twins:
            marks = marks.dropDuplicates(["row", "place"])
        twice = marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram").checkpoint(eager=True)
        places = marks.join(self.beside(twice, F.lit(8)), "gram").groupBy("row").agg(F.collect_list("place").alias("places")).checkpoint(eager=True)
        size, as_hash = self.size, self.as_hash

        def results(t: pa.Array, again: pa.Array, open_: pa.Array) -> pa.Array:
            return _plain_results(t, again, open_, size, as_hash)

        open_ = F.col("places").isNotNull()
        made = F.arrow_udf(results, "n_words bigint, n_removed bigint, kept string")("text", "again", open_)
        told = texts.join(self.beside(places, F.size("places") * 4 + 16), "row", "left")
        folder = scratch_folder(self.spark, "texts")
        told.select("row", "id", made.alias("r"), F.when(open_, F.col("text")).alias("text"), "places").select(
            "row", "id", "r.*", "text", "places").write.parquet(folder)
        return self.spark.read.parquet(folder)

    def open_texts(self, *columns: str) -> DataFrame:
        """Different texts that hold a repeated minimizer."""
        rows = self.rows.filter("places IS NOT NULL").select(*columns)
        return rows.dropDuplicates(["row"]) if self.twins else rows

    def paths(self) -> DataFrame:
        """(row, place, words, from_row, from_place): maximal runs of words that repeat an earlier run."""
        folder = scratch_folder(self.spark, "edges")
        self.open_texts("row", "id", "text", "places").mapInArrow(_edger(self.size, self.gram), EDGES.format(id=self.kind)).write.parquet(folder)
        edges = self.spark.read.parquet(folder)
        here = F.struct(F.col("id").isNull().alias("last"), "id", "row", "place")
        met = edges.filter("from_row IS NULL").select("e1", "e2", "id", "row", "place").withColumn("first", F.min(here).over(Window.partitionBy("e1", "e2")))
        met = met.filter((F.col("first.row") != F.col("row")) | (F.col("first.place") != F.col("place")))
        met = met.select("row", "place", F.col("first.row").alias("from_row"), F.col("first.place").alias("from_place"))
        # neighbours at both ends: one path
        along = Window.partitionBy("row").orderBy("place")
        same = (F.lag("place").over(along) == F.col("place") - 1) & (F.lag("from_row").over(along) == F.col("from_row")) & (
            F.lag("from_place").over(along) == F.col("from_place") - 1)
        runs = met.withColumn("head", F.when(same, 0).otherwise(1)).withColumn("path", F.sum("head").over(along))
        runs = runs.groupBy("row", "path").agg(F.min(F.struct("place", "from_row", "from_place")).alias("s"), F.count(F.lit(1)).cast("int").alias("windows"))
        runs = runs.select("row", "s.*", "windows").unionByName(edges.filter("from_row IS NOT NULL").select("row", "place", "from_row", "from_place", "windows"))
        return runs.select("row", "place", (F.col("windows") + self.size - 1).alias("words"), "from_row", "from_place").checkpoint(eager=True)

    def proved(self, paths: DataFrame) -> DataFrame:
        """(row, spans of place, words and the digest of the words at the earlier place)."""
        asked = paths.select(F.col("from_row").alias("row"), F.struct(F.col("from_place").alias("place"), "words").alias("span")).distinct()
        asked = asked.groupBy("row").agg(F.collect_list("span").alias("spans")).checkpoint(eager=True)
        read = self.open_texts("row", "text").join(asked, "row").select("row", "text", "spans")
        told = read.mapInArrow(_digest_spans, "row bigint, place int, words int, digest binary")
        told = told.select(F.col("row").alias("from_row"), F.col("place").alias("from_place"), "words", "digest")
        both = paths.join(told, ["from_row", "from_place", "words"], "left")
        return both.groupBy("row").agg(F.collect_list(F.struct("place", "words", "digest")).alias("spans")).checkpoint(eager=True)

    def cut(self) -> DataFrame:
        """(id, n_words, n_removed, kept, unproved) of every row."""
        spans, as_hash = self.proved(self.paths()), self.as_hash
        left = self.rows.filter("places IS NOT NULL").select("row", "id", "text").join(spans, "row", "left")

        def cutter(t: pa.Array, own: pa.Array) -> pa.Array:
            return _cutter(t, own, as_hash)

        cut = left.select("id", F.arrow_udf(cutter, CUT)("text", "spans").alias("c")).select("id", "c.*")
        done = self.rows.filter("places IS NULL").select("id", "n_words", "n_removed", "kept", F.lit(0).cast("bigint").alias("unproved"))
        return done.unionByName(cut)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20, as_hash: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row: words covered by a window of ``size`` words whose sequence
    also starts earlier (in a document of smaller key, or earlier in the same) are removed; ``kept`` are the others,
    joined by single blanks (``as_hash``: their SHA-256).

    Words stand between ASCII white space and are compared as they are.  Windows are judged on the
    input.  Defined cases: NULL text has no words; a text shorter than a window loses nothing; NULL keys
    come after all others; different texts under one key are ordered by a hash; rows equal in key and text
    are one document, get one result each, and are no repetitions of one another; an empty table gives no rows;
    other columns are ignored.
    """
    out = Repeats(docs, key, text, size, as_hash).cut()
    return out.select(F.col("id").alias(key), "n_words", "n_removed", "kept")


def repeated_paths(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """(key, place, words, from_key, from_place): compacted paths of repeated windows among different texts.

    The source is an earlier place of the same words: the first one of all, or of a task's segment of rows.
    """
    run = Repeats(docs, key, text, size)
    names = run.rows.select("row", "id").dropDuplicates(["row"])
    found = run.paths().join(names, "row").withColumnRenamed("id", unused(docs, "_own"))
    own = found.columns[-1]
    found = found.join(names.select(F.col("row").alias("from_row"), F.col("id").alias("from_key")), "from_row")
    return found.select(F.col(own).alias(key), "place", "words", "from_key", "from_place")
