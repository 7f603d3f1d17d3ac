"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``CHUNK`` bytes is encoded in overlapping chunks; token offsets are the running
sum of the tokens' byte lengths.  Two neighbouring chunks are spliced at the end of a token that both
encodings hold at the same place (same start, end and id).  That is a proof, not a guess: in BPE
with one rank per piece a token sequence is the encoding of its text exactly if every two
neighbours in it encode to themselves; left of the splice all neighbours stand so in the left
chunk, right of it, the spliced pair included, in the right chunk.  If an overlap holds no common token,
the left chunk is extended and its overlap doubled, up to the end of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, per_worker
from .textnum import buffers

CHUNK = 1 << 14
OVERLAP = 1 << 8
BATCH_BYTES = 1 << 20  # texts given to the encoder at once


class PieceCounter:
    """Encoder of one serialised sentencepiece BPE model with byte offsets of its tokens."""

    def __init__(self, proto: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        from sentencepiece import SentencePieceProcessor
        self.sp = SentencePieceProcessor(model_proto=proto)
        self.chunk, self.overlap = chunk, max(1, overlap)
        self.widened = 0
        self.lengths = np.array([1 if self.sp.IsByte(i) else len(self.sp.IdToPiece(i).replace("▁", " ").encode())
                                 for i in range(self.sp.GetPieceSize())], np.int64)

    def tokens(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte end of every token); the leading blank the model adds ends at byte 0."""
        ids = np.asarray(self.sp.encode(raw, return_type="numpy"))
        ends = np.cumsum(self.lengths[ids]) - 1
        if len(ends) and ends[-1] == len(raw):
            return ids, ends
        # pieces that do not spell the text byte by byte (a literal blank mark): the library's offsets
        text = raw.decode("utf-8")
        got = self.sp.encode(text, return_type="offset_mapping")
        at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
        return np.array(got["ids"], np.int32), at[np.array([e for _, e in got["offsets"]], np.int64)]

    def count_long(self, raw: bytes) -> int:
        """Tokens of one long text, spliced from chunks; memory holds two chunks."""
        n, total = len(raw), 0
        lo, hi = 0, self.cut(raw, self.chunk)
        ids, ends = self.tokens(raw[lo:hi])
        ends = ends + lo
        begun = 0  # tokens of the current chunk that an earlier splice has counted
        joint = None  # (start, end, id) of the token at that splice
        while hi < n:
            overlap = self.overlap
            while True:
                start = self.cut(raw, hi - overlap, back=True)
                stop = self.cut(raw, max(start + self.chunk, hi + self.chunk // 2))
                next_ids, next_ends = self.tokens(raw[start:stop])
                next_ends = next_ends + start
                splice = self.common(ids, ends, begun, next_ids, next_ends, hi)
                if splice:
                    break
                self.widened += 1
                overlap *= 2
                hi = self.cut(raw, hi + overlap)
                ids, ends = self.tokens(raw[lo:hi])
                ends = ends + lo
                if joint is not None:
                    begun = int(np.searchsorted(ends, joint[1], "right"))
                    if not begun or self.token_at(ids, ends, begun - 1) != joint:
                        return len(self.tokens(raw)[0])  # the earlier splice no longer stands: encode whole
                if hi >= n:
                    return total + len(ids) - begun
            left, right = splice
            total += left - begun
            joint = self.token_at(next_ids, next_ends, right - 1)
            lo, hi, ids, ends, begun = start, stop, next_ids, next_ends, right
        return total + len(ids) - begun

    @staticmethod
    def token_at(ids: np.ndarray, ends: np.ndarray, i: int) -> tuple[int, int, int]:
        return (int(ends[i - 1]) if i else -1, int(ends[i]), int(ids[i]))

    @staticmethod
    def common(ids, ends, begun, next_ids, next_ends, hi) -> tuple[int, int] | None:
        """(tokens up to the splice on the left, on the right) or None."""
        starts = np.concatenate(([-1], ends[:-1]))
        next_starts = np.concatenate(([-1], next_ends[:-1]))
        first = max(begun, int(np.searchsorted(ends, next_ends[0])) if len(next_ends) else begun)
        last = int(np.searchsorted(next_ends, hi, "right"))
        left = starts[first:] * (1 << 16) + ids[first:]
        right = next_starts[1:last] * (1 << 16) + next_ids[1:last]
        _, a, b = np.intersect1d(left, right, return_indices=True)
        same = ends[first:][a] == next_ends[1:last][b]
        a, b = a[same] + first, b[same] + 1
        whole = (ends[a] - starts[a]) > 0
        a, b = a[whole], b[whole]
        if not len(a):
            return None
        mid = len(a) // 2
        return int(a[mid]) + 1, int(b[mid]) + 1

    @staticmethod
    def cut(raw: bytes, at: int, back: bool = False) -> int:
        """A character's first byte at or after (before) ``at``."""
        at = min(max(at, 0), len(raw))
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += -1 if back else 1
        return at

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text of an Arrow batch."""
        out = np.zeros(len(offsets) - 1, np.int64)
        lengths = np.diff(offsets)
        raw = memoryview(data)
        short = np.flatnonzero((lengths > 0) & (lengths <= self.chunk))
        group = np.cumsum(lengths[short]) // BATCH_BYTES
        for g in np.unique(group):
            pick = short[group == g]
            texts = [bytes(raw[offsets[i]:offsets[i + 1]]) for i in pick]
            out[pick] = [len(x) for x in self.sp.encode(texts, return_type=int, num_threads=1)]
        for i in np.flatnonzero(lengths > self.chunk):
            out[i] = self.count_long(bytes(raw[offsets[i]:offsets[i + 1]]))
        return out


def counter_of(proto: bytes, chunk: int, overlap: int) -> PieceCounter:
    """One encoder per Python worker and model."""
    return per_worker(("pieces", hash(proto), chunk, overlap), lambda: PieceCounter(proto, chunk, overlap))


def token_count_column(spark, text: Column, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Token count of a text column; the model file is read on the driver and broadcast (0.5 MB)."""
    with open(model_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def count(t: pa.Array) -> pa.Array:
        return pa.array(counter_of(held.value, chunk, overlap).count(*buffers(t)), pa.int64())

    return F.arrow_udf(count, "bigint")(F.coalesce(text.cast("string"), F.lit("")))


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row, as the model's own encoder counts.

    No begin, end or other special tokens are added; strings that look like them are plain text.
    Defined cases: NULL and empty texts have 0 bytes and tokens; keys may be NULL or repeated; a
    text without any common token in its overlaps is encoded whole.  One scan, no shuffle.
    """
    rows = docs.select(named(key).alias("k"), F.octet_length(F.coalesce(named(text).cast("string"), F.lit(""))).cast("bigint").alias("b"),
                       token_count_column(docs.sparkSession, named(text), model_path, chunk, overlap).alias("n"))
    return rows.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"),
                       (F.col("n") > limit).alias("over_limit"))
