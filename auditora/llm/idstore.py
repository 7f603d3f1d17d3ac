"""Token-id store: raw id payloads in shards, found by a minimal perfect hash index.

Layout of a store folder:

* ``shard-SSSSS.bin``  token ids of the shard's documents in ascending key order, raw little-endian
  integers of ``width`` bytes, nothing between documents;
* ``shard-SSSSS.off``  n + 1 unsigned 64-bit offsets (in ids) of the shard's documents;
* ``index-BBBBB.mph``  a bucket of the key index (see ``KeyIndex``);
* ``entries``          Parquet rows (shard, ordinal, key, n_tokens), the input of the index.

Shards are key ranges written by the tasks of one range-partitioned job; a task writes to a name of
its own attempt and moves the finished file into place, so a repeated task leaves the same files.
Files are reached through ``pyarrow.fs`` by URI, so the folder may be in any shared file system.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import broadcast_if
from .common import default_parallelism, named, per_worker
from .textnum import SpanTable, Strings, buffers, mix, ranges

DOCS_PER_SHARD = 1 << 14
KEYS_PER_BUCKET = 1 << 16
END_ID = 2
MAX_LEVELS = 40
GAMMA = 2


# ---------------------------------------------------------------- encoding

class BatchEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer, each distinct piece encoded once.

    A text is cut before single blanks between two non-blank characters, around single line ends, and
    between ASCII letters and marks (not after an apostrophe).  The tokenizer's pattern never matches
    across such a place and looks at nothing before it, and special strings are never cut, so the
    pieces' ids joined are the text's ids.  Ids of pieces are kept for later batches, up to
    ``KEPT_PIECES``.
    """

    KEPT_PIECES = 1_000_000
    KEPT_BYTES = 32 << 20
    GROUP = 1 << 22
    LETTER = np.zeros(256, bool)
    LETTER[[*range(65, 91), *range(97, 123)]] = True
    MARK = np.zeros(256, bool)
    MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(model)
        self.tok.no_truncation()
        self.tok.no_padding()
        top = max(self.tok.get_vocab(with_added_tokens=True).values())
        self.width = 2 if top < 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        spec = json.loads(model)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                     and not spec.get("normalizer")
                     and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                                 for t in spec.get("added_tokens", ())))
        self.special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        self.forget()

    def forget(self) -> None:
        self.pieces, self.ids = SpanTable(22), Strings(self.dtype)  # bytes -> number of the kept piece -> its ids

    def piece_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte starts of the pieces; every text's start is one."""
        n = len(data)
        blank = (data <= 0x20) | (data == 0x7F)
        # lead bytes of the Unicode blanks and of the blocks around them: no cut beside these
        for lead, second in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
            at = np.flatnonzero(data[:-1] == lead) if n > 1 else np.zeros(0, np.int64)
            at = at[np.isin(data[at + 1], second)]
            for j in range(3 if lead > 0xDF else 2):
                blank[np.minimum(at + j, n - 1)] = True
        cut = np.zeros(n + 1, bool)
        if n > 2:
            cut[1:n - 1] = (data[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        cut[inner - 1] = False  # a blank that ends a text
        if n > 2:
            letter, mark, line = self.LETTER[data], self.MARK[data], data == 0x0A
            cut[1:n] |= letter[:-1] & mark[1:] | mark[:-1] & (data[:-1] != 0x27) & letter[1:] | line[1:] & ~blank[:-1]
            cut[2:n] |= line[1:-1] & ~blank[:-2] & ~blank[2:]  # one line end between two other characters
            raw = data.tobytes()
            for content in self.special:
                at = raw.find(content)
                while at >= 0:
                    cut[at + 1:at + len(content)] = False
                    at = raw.find(content, at + 1)
        cut[offsets[offsets < n]] = True
        cut[n] = False
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text), worked off in groups of about ``GROUP`` bytes."""
        ids, counts, lo = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + self.GROUP, "right")) - 1)
            i, n = self.group(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            ids.append(i.astype(self.dtype))
            counts.append(n)
            lo = hi
        return np.concatenate(ids), np.concatenate(counts)

    def group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        starts = self.piece_starts(data, offsets) if self.cuts else offsets[:-1][np.diff(offsets) > 0]
        ends = np.concatenate((starts[1:], [len(data)]))
        if len(self.pieces) > self.KEPT_PIECES or self.pieces.held_bytes() > self.KEPT_BYTES:
            self.forget()
        spot, new = self.pieces.look_up(data, starts, ends)
        if len(new):
            self.learn(data, starts[new], ends[new])
        ids, per = self.ids.get(spot)
        text_of = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(text_of, per, n_texts).astype(np.int64)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new pieces and keep their ids."""
        raw = memoryview(np.ascontiguousarray(data))
        texts = [str(raw[a:b], "utf-8") for a, b in zip(starts.tolist(), ends.tolist())]
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        self.ids.add(np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths)


def encoder_of(model: str) -> BatchEncoder:
    return per_worker(("byte-bpe", hash(model)), lambda: BatchEncoder(model))


# ---------------------------------------------------------------- files

def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put(uri: str, name: str, blobs: Iterator[bytes]) -> None:
    """Write a file under a name of this attempt and move it into place."""
    files, root = located(uri)
    files.create_dir(root, recursive=True)
    temp = f"{root}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temp) as out:
        for blob in blobs:
            out.write(blob)
    files.move(temp, f"{root}/{name}")


def get(uri: str, name: str) -> bytes:
    files, root = located(uri)
    with files.open_input_file(f"{root}/{name}") as f:
        return f.read()


def shard_writer(uri: str, model: str, end_id: int | None):
    """mapInArrow function: (key, text) of one sorted partition -> one shard and its entry rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(model)
        shard = TaskContext.get().partitionId()
        files, root = located(uri)
        files.create_dir(root, recursive=True)
        temp = f"{root}/.shard-{shard:05d}.{uuid.uuid4().hex}"
        done, totals = 0, [np.zeros(1, np.uint64)]
        with files.open_output_stream(temp) as out:
            for batch in batches:
                ids, counts = enc.encode(*buffers(batch.column(1)))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                out.write(ids.astype(enc.dtype).tobytes())
                totals.append(totals[-1][-1] + np.cumsum(counts).astype(np.uint64))
                yield pa.record_batch([pa.array(np.full(len(counts), shard, np.int32)), pa.array(np.arange(done, done + len(counts))),
                                       batch.column(0), pa.array(counts)], names=["shard", "ordinal", "key", "n_tokens"])
                done += len(counts)
        if done:
            put(uri, f"shard-{shard:05d}.off", iter([np.concatenate(totals).astype("<u8").tobytes()]))
            files.move(temp, f"{root}/shard-{shard:05d}.bin")
        else:
            files.delete_file(temp)

    return write


class ShardReader:
    """Documents of one shard by ordinal; every read is two constant-size look-ups and one range."""

    def __init__(self, uri: str, shard: int, width: int):
        files, root = located(uri)
        self.off = np.frombuffer(get(uri, f"shard-{shard:05d}.off"), "<u8").astype(np.int64)
        self.file = files.open_input_file(f"{root}/shard-{shard:05d}.bin")
        self.width = width

    def ids(self, ordinal: int) -> np.ndarray:
        a, b = int(self.off[ordinal]), int(self.off[ordinal + 1])
        raw = self.file.read_at((b - a) * self.width, a * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


# ---------------------------------------------------------------- index

class KeyIndex:
    """Minimal perfect hash of 64-bit keys by levels of bit arrays, with stored fingerprints.

    Level i sets the bits that exactly one of its keys hashes to; the other keys go on to level
    i + 1.  A key's slot is the number of set bits before its own.  A slot stores the key's 32-bit
    fingerprint, shard, first ordinal and number of documents.  Keys still colliding after
    ``MAX_LEVELS`` (equal hashes) are kept in full in an overflow list.
    """

    def __init__(self, sizes, bits, table, overflow):
        self.sizes, self.bits, self.table, self.overflow = sizes, bits, table, overflow
        self.ranks = np.concatenate(([0], np.cumsum(bits)))[:-1] if len(bits) else np.zeros(0, np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    ENTRY = np.dtype([("print", "<u4"), ("shard", "<i4"), ("ordinal", "<i8"), ("rows", "<i8")])
    SPILL = np.dtype([("key", "<u8"), ("print", "<u4"), ("shard", "<i4"), ("ordinal", "<i8"), ("rows", "<i8")])

    @classmethod
    def build(cls, keys: np.ndarray, shard: np.ndarray, ordinal: np.ndarray, rows: np.ndarray) -> "KeyIndex":
        sizes, bits, left = [], [], np.arange(len(keys))
        slots = np.full(len(keys), -1, np.int64)
        base = 0
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            spot = (mix(keys[left], 100 + level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            hit = alone[spot]
            slots[left[hit]] = base + spot[hit]
            sizes.append(size)
            bits.append(alone)
            base += size
            left = left[~hit]
        bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        rank = np.concatenate(([0], np.cumsum(bits)))
        table = np.zeros(int(rank[-1]), cls.ENTRY)
        set_ = slots >= 0
        at = rank[slots[set_]]
        for name, col in (("print", cls.prints(keys)), ("shard", shard), ("ordinal", ordinal), ("rows", rows)):
            table[name][at] = col[set_]
        spill = np.zeros(len(left), cls.SPILL)
        for name, col in (("key", keys), ("print", cls.prints(keys)), ("shard", shard), ("ordinal", ordinal), ("rows", rows)):
            spill[name] = col[left]
        return cls(np.array(sizes, np.int64), bits, table, spill)

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 77) >> np.uint64(32)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of the keys; rows = 0 where a key is not in the index."""
        out = np.zeros(len(keys), self.ENTRY)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            spot = (mix(keys[left], 100 + level) % np.uint64(size)).astype(np.int64) + self.begins[level]
            hit = self.bits[spot]
            out[left[hit]] = self.table[self.ranks[spot[hit]]]
            left = left[~hit]
        wrong = out["print"] != self.prints(keys)
        out[wrong] = 0
        for e in self.overflow:
            same = keys == e["key"]
            for name in self.ENTRY.names:
                out[name][same] = e[name]
        return out

    def blob(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.table), len(self.overflow)], "<i8")
        return b"".join((b"KIX1", head.tobytes(), self.sizes.astype("<i8").tobytes(), np.packbits(self.bits).tobytes(),
                         self.table.tobytes(), self.overflow.tobytes()))

    @classmethod
    def load(cls, raw: bytes) -> "KeyIndex":
        if raw[:4] != b"KIX1":
            raise ValueError("not a key index")
        levels, n_bits, n, spilled = np.frombuffer(raw, "<i8", 4, 4).tolist()
        at = 36
        sizes = np.frombuffer(raw, "<i8", levels, at)
        at += 8 * levels
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_bits // 8), at), count=n_bits).astype(bool)
        at += -(-n_bits // 8)
        table = np.frombuffer(raw, cls.ENTRY, n, at)
        return cls(sizes, bits, table, np.frombuffer(raw, cls.SPILL, spilled, at + table.nbytes))


# ---------------------------------------------------------------- jobs

def hashed_key(key, run):
    """64-bit index key of (document key as text, run); NULL is a key of its own."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("~")), run.cast("bigint"))


def write_store(docs: DataFrame, folder: str, model_path: str, key: str = "doc_id", text: str = "text",
                end_id: int | None = END_ID, docs_per_shard: int = DOCS_PER_SHARD) -> None:
    """Encode every text and write shards and entries below ``folder`` (a shared URI or path).

    One exchange: a range partitioning by (key, text hash), NULL keys first; a key with very many
    rows may span shards.  Texts are encoded in the tasks that write them.
    """
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    shards = max(default_parallelism(docs), -(-docs.count() // docs_per_shard))
    rows = docs.select(named(key).alias("key"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, F.col("key").asc_nulls_first(), F.col("h")).sortWithinPartitions(
        F.col("key").asc_nulls_first(), "h", "text").select("key", "text")
    held = spark.sparkContext.broadcast(model)
    key_type = rows.schema["key"].dataType.simpleString()

    def write(batches):
        return shard_writer(folder, held.value, end_id)(batches)

    entries = dealt.mapInArrow(write, f"shard int, ordinal bigint, key {key_type}, n_tokens bigint")
    entries.write.mode("overwrite").parquet(f"{folder}/entries")


def key_runs(entries: DataFrame) -> DataFrame:
    """(key, run, shard, ordinal, rows, hash): where each key's rows begin, a run per shard it is in."""
    runs = entries.groupBy("key", "shard").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("rows"))
    runs = runs.withColumn("run", F.row_number().over(Window.partitionBy("key").orderBy("shard")) - 1)
    return runs.withColumn("hash", hashed_key(F.col("key"), F.col("run")))


def index_store(spark: SparkSession, folder: str, keys_per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Build the key index from the entries; returns the number of buckets (files)."""
    entries = spark.read.parquet(f"{folder}/entries")
    buckets = max(1, -(-entries.count() // keys_per_bucket))
    runs = key_runs(entries).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))

    def build(pdf):
        keys = pdf["hash"].to_numpy().astype(np.int64).view(np.uint64)
        index = KeyIndex.build(keys, pdf["shard"].to_numpy(), pdf["ordinal"].to_numpy(), pdf["rows"].to_numpy())
        put(folder, f"index-{int(pdf['bucket'].iloc[0]):05d}.mph", iter([index.blob()]))
        return pdf[["bucket"]].iloc[:1]

    built = runs.select("bucket", "hash", "shard", "ordinal", "rows").groupBy("bucket").applyInPandas(build, "bucket int")
    made = {r["bucket"] for r in built.collect()}  # one number per bucket file
    nothing = np.zeros(0, np.int64)
    for b in set(range(buckets)) - made:
        put(folder, f"index-{b:05d}.mph", iter([KeyIndex.build(nothing.view(np.uint64), nothing, nothing, nothing).blob()]))
    return buckets


def look_up(folder: str, buckets: int, keys: DataFrame) -> DataFrame:
    """(key, shard, ordinal, rows) of (key, run) rows, through the index files; absent keys give no row."""
    hashed = keys.select("key", hashed_key(F.col("key"), F.col("run")).alias("hash"))
    hashed = hashed.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    key_type = hashed.schema["key"].dataType.simpleString()

    def find(pdf):
        index = KeyIndex.load(get(folder, f"index-{int(pdf['bucket'].iloc[0]):05d}.mph"))
        e = index.find(pdf["hash"].to_numpy().astype(np.int64).view(np.uint64))
        return pdf[["key"]].assign(shard=e["shard"], ordinal=e["ordinal"], rows=e["rows"])[e["rows"] > 0]

    return hashed.groupBy("bucket").applyInPandas(find, f"key {key_type}, shard int, ordinal bigint, rows bigint")


def read_documents(folder: str, places: DataFrame, width: int) -> DataFrame:
    """(key, shard, ordinal, at, ids) of the documents at the places; ``at`` counts the shard's ids before."""
    key_type = places.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, shard int, ordinal bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    lanes = max(default_parallelism(places), 1)

    def read(batches):
        reader, shard = None, None
        for batch in batches:
            keys, shards, ordinals, rows = (batch.column(i) for i in range(4))
            out = {"i": [], "shard": [], "ordinal": [], "at": [], "n": [], "crc": []}
            for i, (s, o, r) in enumerate(zip(shards.to_pylist(), ordinals.to_pylist(), rows.to_pylist())):
                if s != shard:
                    reader, shard = ShardReader(folder, s, width), s
                for k in range(o, o + r):
                    ids = reader.ids(k)
                    for name, v in (("i", i), ("shard", s), ("ordinal", k), ("at", int(reader.off[k])), ("n", len(ids)),
                                    ("crc", zlib.crc32(ids.tobytes()))):
                        out[name].append(v)
                    if len(out["i"]) >= 8192:
                        yield _doc_batch(keys, out)
                        out = {name: [] for name in out}
            yield _doc_batch(keys, out)

    dealt = places.select("key", "shard", "ordinal", "rows").repartition(lanes, "shard").sortWithinPartitions("shard", "ordinal")
    return dealt.mapInArrow(read, schema)


def _doc_batch(keys: pa.Array, out: dict) -> pa.RecordBatch:
    picked = keys.take(pa.array(out["i"], pa.int64()))
    cols = [pa.array(out["shard"], pa.int32())] + [pa.array(out[n], pa.int64()) for n in ("ordinal", "at", "n", "crc")]
    return pa.record_batch([picked, *cols], names=["key", "shard", "ordinal", "at", "n_tokens", "ids_crc32"])


def stored_digest(spark: SparkSession, folder: str, model_path: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every stored document, read back through the index.

    ``start`` counts the ids of all documents before it: ids of earlier shards plus ids before it in
    its own.  Defined cases: NULL and empty texts hold the end id alone; NULL keys come first and
    are found under a key of their own; repeated keys are one entry with a row count per shard and
    come back as rows of their own; an empty table gives no rows.
    """
    entries = spark.read.parquet(f"{folder}/entries")
    with open(model_path, encoding="utf-8") as f:
        width = encoder_of(f.read()).width
    places = look_up(folder, buckets, key_runs(entries).select("key", "run"))
    per_shard = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_shard.select(F.col("shard").alias("b_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = read_documents(folder, places, width)
    joined = found.join(broadcast_if(bases, per_shard.count()), F.col("shard") == F.col("b_shard"))
    return joined.select(F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, folder: str, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the store, index it and return ``stored_digest`` of it."""
    write_store(docs, folder, model_path, key, text)
    buckets = index_store(docs.sparkSession, folder)
    return stored_digest(docs.sparkSession, folder, model_path, buckets, key)
