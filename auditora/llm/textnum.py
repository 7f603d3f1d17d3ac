"""Vectorised word hashing of Arrow string batches (numpy, used inside tasks).

A word's hash takes its bytes eight at a time, each block mixed into the state before it (a polynomial
modulo 2^64 would give Thue-Morse words and their complements one hash, whatever its base); words beyond
``LONG`` bytes are hashed by BLAKE2b.  Words are runs of bytes other than ASCII white space, with A-Z
lower-cased.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release_kept

PIECE = 1 << 20  # bytes hashed at a time; a longer word makes a longer piece
LONG = 256  # bytes of a span beyond which it is hashed by itself

SLICE_BYTES = 1 << 20  # text of a batch worked on at a time

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    h = h + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` on (zeros behind its end), a row for each place."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)


def block_at(rows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first min(8, left) bytes from every place as a little-endian number."""
    whole = rows[at].view("<u8").ravel()
    return whole & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of every span, which is not empty."""
    size = ends - starts
    rows = blocks(data)
    h = mix(block_at(rows, starts, size) ^ mix(size.astype(np.uint64), salt), salt)
    left = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(left):
        h[left] = mix(h[left] + block_at(rows, starts[left] + at, size[left] - at) * np.uint64(0x9E3779B97F4A7C15), salt)
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        long = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, key=salt.to_bytes(4, "little")).digest()
        h[i] = np.frombuffer(long, "<u8")[0]
    return h


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``a`` and of ``b`` from given places on are equal, for every pair of places."""
    a_rows, b_rows = blocks(a), blocks(b)
    ok = np.ones(len(size), bool)
    left, at = np.flatnonzero(size > 0), 0
    while len(left):
        x, y, n = a_at[left] + at, b_at[left] + at, size[left] - at
        same = block_at(a_rows, x, n) == block_at(b_rows, y, n)
        ok[left[~same]] = False
        at += 8
        left = left[same & (n > 8)]
        if len(left) < 64 and len(left):  # few long ones: compare them whole
            for i in left.tolist():
                lo, hi = at, int(size[i])
                ok[i] = bool((a[a_at[i] + lo:a_at[i] + hi] == b[b_at[i] + lo:b_at[i] + hi]).all())
            break
    return ok


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(column, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """(start, rows) of runs of rows that hold about ``limit`` bytes of text; a longer text is its own run."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo = [], 0
    while lo < len(ends):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        out.append((lo, hi - lo))
        lo = hi
    return out


def give_back() -> None:
    """Return freed heap to the system: idle workers would keep their largest batch's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(batches, column: int):
    """The rows of record batches in batches of bounded text, so that work arrays stay small."""
    release_kept()
    for batch in batches:
        for lo, n in spans(batch.column(column)):
            yield batch.slice(lo, n)
        give_back()


def in_spans(make):
    """An array function applied to runs of rows of bounded text, the results joined."""
    def run(column):
        out = pa.concat_arrays([make(column.slice(lo, n)) for lo, n in spans(column)]) if len(column) else make(column)
        give_back()
        return out
    return run


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a text's end ends a word."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, head: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hash of every word, words per text, hash of every word's first ``head`` bytes or None)."""
    n_texts = len(offsets) - 1
    hashes, heads, counts = [], [], np.zeros(n_texts, np.int64)
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        if hi < len(data):  # cut after white space; without any, take the whole word
            back = np.flatnonzero(SPACE[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:
                while hi < len(data):
                    ahead = np.flatnonzero(SPACE[data[hi:hi + PIECE]])
                    hi = hi + int(ahead[0]) + 1 if len(ahead) else min(len(data), hi + PIECE)
                    if len(ahead):
                        break
        part = LOWER[data[lo:hi]]
        inner = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, "right")] - lo
        starts, ends = word_bounds(part, np.concatenate(([0], inner, [len(part)])))
        hashes.append(span_hashes(part, starts, ends, 1))
        if head:
            heads.append(span_hashes(part, starts, np.minimum(ends, starts + head), 2))
        counts += np.bincount(np.searchsorted(offsets, starts + lo, "right") - 1, minlength=n_texts)[:n_texts]
        lo = hi
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(hashes) if hashes else empty, counts,
            (np.concatenate(heads) if heads else empty) if head else None)


class HashTable:
    """64-bit hash -> small number, open addressing over numpy arrays; nothing is ever removed."""

    PROBES = 6

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.hashes = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def slot(self, h: np.ndarray, probe: int) -> np.ndarray:
        step = (h >> np.uint64(40)) | np.uint64(1)
        return ((h + step * np.uint64(probe)) & self.mask).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of every hash, or -1."""
        s = self.slot(h, 0)
        out = self.values[s]
        other = np.flatnonzero((out >= 0) & (self.hashes[s] != h))
        out[other] = -1
        for probe in range(1, self.PROBES):
            if not len(other):
                break
            s = self.slot(h[other], probe)
            v, same = self.values[s], self.hashes[s] == h[other]
            hit = (v >= 0) & same
            out[other[hit]] = v[hit]
            other = other[(v >= 0) & ~same]
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """Distinct new hashes; one that finds no free slot is not kept."""
        left = np.arange(len(h))
        for probe in range(self.PROBES):
            if not len(left):
                return
            s = self.slot(h[left], probe)
            free = np.flatnonzero(self.values[s] < 0)
            at, first = np.unique(s[free], return_index=True)
            put = left[free[first]]
            self.hashes[at], self.values[at] = h[put], v[put]
            gone = np.zeros(len(left), bool)
            gone[free[first]] = True
            left = left[~gone]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges start .. start + length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return out + np.arange(total)


class Strings:
    """Growing table of numbered runs of numbers in one flat array."""

    def __init__(self, dtype):
        self.flat, self.at, self.size = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))
        self.at, self.size = np.concatenate((self.at, begin)), np.concatenate((self.size, sizes.astype(np.int32)))

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs of these numbers one after the other, their sizes)."""
        size = self.size[numbers].astype(np.int64)
        return self.flat[ranges(self.at[numbers], size)], size


class SpanTable:
    """Numbers byte spans; equal numbers mean equal bytes, which are kept and compared at every hit."""

    def __init__(self, bits: int):
        self.table, self.spans = HashTable(bits), Strings(np.uint8)
        self.odd: dict[bytes, int] = {}  # spans whose hash belongs to another span

    def __len__(self) -> int:
        return len(self.spans.at)

    def held_bytes(self) -> int:
        return len(self.spans.flat)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of every span, the spans that got new numbers, in the order of these)."""
        size = ends - starts
        h = span_hashes(data, starts, ends, 9)
        spot = self.table.find(h)
        fresh, hit = np.flatnonzero(spot < 0), np.flatnonzero(spot >= 0)
        held = spot[hit]
        same = self.spans.size[held] == size[hit]
        check = np.flatnonzero(same)
        same[check] = same_spans(data, starts[hit[check]], self.spans.flat, self.spans.at[held[check]], size[hit[check]])
        wrong, new = hit[~same], np.zeros(0, np.int64)
        if len(fresh):
            names, first, which = np.unique(h[fresh], return_index=True, return_inverse=True)
            new = fresh[first]
            model = new[which]
            same = size[fresh] == size[model]
            check = np.flatnonzero(same)
            same[check] = same_spans(data, starts[fresh[check]], data, starts[model[check]], size[fresh[check]])
            wrong = np.concatenate((wrong, fresh[~same]))
            spot[fresh] = len(self) + which
            self.table.add(names, np.arange(len(self), len(self) + len(new), dtype=np.int32))
            self._keep(data, starts[new], size[new])
        for i in wrong.tolist():
            raw = data[starts[i]:ends[i]].tobytes()
            if raw not in self.odd:
                self.odd[raw] = len(self)
                self._keep(data, starts[i:i + 1], size[i:i + 1])
                new = np.append(new, i)
            spot[i] = self.odd[raw]
        return spot, new

    def _keep(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        self.spans.add(data[ranges(starts, size)], size)
