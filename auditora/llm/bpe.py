"""BPE encoding and decoding by a tokenization automaton.

The automaton accepts exactly the token sequences that are BPE encodings; its arcs are labelled
with tokens.  It starts as one state with an arc per base symbol and is changed by one gadget per
merge (u, v) -> w, in order: the state behind u is copied without its arc v and u leads to the copy;
beside every arc u comes an arc w, which leads where v led from the old state.

Tables.  All arcs with one label lead to one state, so each token has one state behind it, and tokens whose
states were never parted share it.  Transitions are a table (state, token) -> state, or no arc; its rows are
far too many to write out (states x tokens), so an entry is closed when it is first asked for, as in
a lazily built automaton, and kept.  Closing looks at the gadgets: going back in time, token b has its arc
unless a gadget took it, or the arc of the part it was made of, from the state as it was then.  Encoding a word walks a
trie from every symbol (the arcs), and goes from left to right through the states by the table; one arc
at most into each place leaves the state before it, so the path is unique and found without search.
Decoding emits the labels of the arcs.  All steps run on numpy arrays over the distinct words of a batch.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, per_worker
from .textnum import HashTable, SpanTable, Strings, give_back, in_spans, mix

NEVER = np.int64(1) << 40
LONG_WORD = 96  # symbols; longer words are walked one by one
SLICE = 1 << 17  # symbols handled at a time
TABLE_BITS = 20  # transitions kept: at most half of 2 ^ TABLE_BITS


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of every byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in set(keep)):
        table[chr(256 + n)] = b
    return table


class Automaton:
    """States and arcs after all merge gadgets; symbols are 0-255 and, ending a word, 256-511."""

    def __init__(self, base: dict[int, int], merges: list[tuple[int, int, int]], n_tokens: int):
        """``base``: token -> symbol; ``merges``: (left, right, joined) in order."""
        self.left = np.arange(n_tokens, dtype=np.int64)
        self.right = np.arange(n_tokens, dtype=np.int64)
        self.born = np.full(n_tokens, -1, np.int64)
        n = len(merges)
        # one gadget per merge: the state behind u is copied without arc v, and u leads to the copy; state 0 is
        # the first one, state k + 1 the copy of merge k
        behind = np.zeros(n_tokens, np.int64)
        spelled: dict[int, tuple[int, ...]] = {t: (s,) for t, s in base.items()}
        for k, (u, v, w) in enumerate(merges):
            after_v = behind[v]
            behind[u] = k + 1
            if self.born[w] < 0 and w not in base:
                behind[w] = after_v  # arc w leads where v led
                self.left[w], self.right[w], self.born[w] = u, v, k
                spelled[w] = spelled[u] + spelled[v]
        # states numbered without gaps; a token that leads to each
        states, self.any_token, self.state = np.unique(behind, return_index=True, return_inverse=True)
        self.n_states = len(states)
        self.table = HashTable(TABLE_BITS)
        self.closed = 0
        self.n_tokens = n_tokens
        pairs = np.array([u * n_tokens + v for u, v, _ in merges], np.int64)
        self.keys, first = np.unique(pairs, return_index=True)
        self.times = first.astype(np.int64)
        self.spelled = spelled
        # arcs that no gadget could add: their parts never stand side by side when the merge comes
        made = np.flatnonzero(self.born >= 0)
        ok = self.may_follow(self.left[made], self.right[made], self.born[made])
        self.live = np.zeros(n_tokens, bool)
        self.live[list(base)] = True
        good = dict(zip(made.tolist(), ok.tolist()))
        for t in made[np.argsort(self.born[made])]:
            self.live[t] = good[int(t)] and self.live[self.left[t]] and self.live[self.right[t]]
        self._trie()

    def taken_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Time at which a gadget took arc b from the state behind a, or NEVER."""
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a * self.n_tokens + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.times[at], NEVER)

    def may_follow(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the state behind a has arc b (looking at gadgets before a time only); closes table entries."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            clash = self.taken_at(x, y) < lim
            ok[live[clash]] = False
            bx, by = self.born[x], self.born[y]
            later = bx > by
            a[live] = np.where(later, self.right[x], x)
            b[live] = np.where(later, y, self.left[y])
            # a merge at the very time b was made only matters if it joins two equal tokens
            limit[live] = np.where(later, bx, by + 1)
            live = live[~clash & (np.maximum(bx, by) >= 0)]
        return ok

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """State behind the arc ``token`` of every state, or -1 where it has none."""
        key = mix(state.astype(np.uint64) * np.uint64(self.n_tokens) + token.astype(np.uint64), 13)  # one to one
        found = self.table.find(key)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            names, first, which = np.unique(key[fresh], return_index=True, return_inverse=True)
            first = fresh[first]
            arcs = self.may_follow(self.any_token[state[first]], token[first])
            value = np.where(arcs, self.state[token[first]] + 1, 0).astype(np.int32)
            if self.closed + len(names) > 1 << (TABLE_BITS - 1):
                self.table, self.closed = HashTable(TABLE_BITS), 0
            self.table.add(names, value)
            self.closed += len(names)
            found[fresh] = value[which]
        return found.astype(np.int64) - 1

    def _trie(self) -> None:
        """Forward trie of the live tokens: a row of 256 for nodes with children, a sorted list for ends."""
        child: dict[tuple[int, int], int] = {}
        label, n = [-1], 1
        ends: dict[int, int] = {}
        for t in np.flatnonzero(self.live):
            node, symbols = 0, self.spelled[int(t)]
            for s in symbols[:-1] if symbols[-1] >= 256 else symbols:
                nxt = child.get((node, s))
                if nxt is None:
                    nxt = child[node, s] = n
                    label.append(-1)
                    n += 1
                node = nxt
            if symbols[-1] >= 256:
                ends[node * 256 + symbols[-1] - 256] = int(t)
            else:
                label[node] = int(t)
        inner = sorted({a for a, _ in child})
        self.row = np.full(n, -1, np.int32)
        self.row[inner] = np.arange(len(inner))
        self.next = np.full((len(inner), 256), -1, np.int32)
        for (a, s), b in child.items():
            self.next[self.row[a], s] = b
        self.label = np.array(label, np.int64)
        self.end_keys = np.array(sorted(ends), np.int64)
        self.end_tokens = np.array([ends[k] for k in self.end_keys], np.int64)

    def encode_words(self, data: np.ndarray, lengths: np.ndarray, marked: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word); ``marked``: a word's last symbol is an end symbol."""
        out, counts, lo, at = [], np.zeros(len(lengths), np.int64), 0, 0
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(bounds, at + SLICE, "right")) - 1)
            ids, n = self._slice(data[bounds[lo]:bounds[hi]], lengths[lo:hi], marked)
            out.append(ids)
            counts[lo:hi] = n
            lo, at = hi, int(bounds[hi])
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), counts

    def _slice(self, data: np.ndarray, lengths: np.ndarray, marked: bool) -> tuple[np.ndarray, np.ndarray]:
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        word_of = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(data)) - first[word_of]
        stop = (first + lengths)[word_of]
        last_token, begin = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        state = np.zeros(len(data), np.int64)
        long_words = lengths > LONG_WORD
        # arcs: from every symbol along the trie
        pos = np.flatnonzero(~long_words[word_of]) if long_words.any() else np.arange(len(data))
        start, node = pos, np.zeros(len(pos), np.int64)
        arcs = []
        while len(pos):
            final = pos == stop[start] - 1 if marked else np.zeros(len(pos), bool)
            if final.any() and len(self.end_keys):
                key = node[final] * 256 + data[pos[final]]
                spot = np.minimum(np.searchsorted(self.end_keys, key), len(self.end_keys) - 1)
                hit = self.end_keys[spot] == key
                arcs.append((start[final][hit], pos[final][hit], self.end_tokens[spot[hit]]))
            row = self.row[node]
            nxt = np.where(row >= 0, self.next[row, data[pos]], -1)
            go = (nxt >= 0) & ~final
            start, pos, node = start[go], pos[go], nxt[go].astype(np.int64)
            token = self.label[node]
            hit = token >= 0
            arcs.append((start[hit], pos[hit], token[hit]))
            pos = pos + 1
            inside = pos < stop[start]
            start, pos, node = start[inside], pos[inside], node[inside]
        if arcs:
            a_from, a_to, a_tok = (np.concatenate(x) for x in zip(*arcs))
            order = np.argsort(place[a_from].astype(np.uint8), kind="stable")
            a_from, a_to, a_tok = a_from[order], a_to[order], a_tok[order]
            cuts = np.searchsorted(place[a_from], np.arange(int(place[a_from].max()) + 2 if len(a_from) else 1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                f, t, k = a_from[lo:hi], a_to[lo:hi], a_tok[lo:hi]
                if lo:
                    ok = self.step(state[f - 1], k) >= 0
                    f, t, k = f[ok], t[ok], k[ok]
                last_token[t], begin[t], state[t] = k, f, self.state[k]
        for w in np.flatnonzero(long_words):
            self._walk(data, int(first[w]), int(first[w] + lengths[w]), marked, last_token, begin)
        # back along the path, all words at once
        counts = np.zeros(len(lengths), np.int64)
        words, at = np.flatnonzero(lengths > 0), (first + lengths - 1)[lengths > 0]
        found = []
        while len(words):
            found.append((words, at, last_token[at]))
            counts[words] += 1
            at = begin[at] - 1
            more = at >= first[words]
            words, at = words[more], at[more]
        if not found:
            return np.zeros(0, np.int64), counts
        _, spots, tokens = (np.concatenate(x) for x in zip(*found))
        return tokens[np.argsort(spots)], counts

    def _walk(self, data, lo: int, hi: int, marked: bool, last_token, begin) -> None:
        """The same walk for one long word (bounded work per symbol)."""
        seen: dict[tuple[int, int], bool] = {}
        for p in range(lo, hi):
            node, before = 0, int(last_token[p - 1]) if p > lo else -1
            for q in range(p, hi):
                s = int(data[q])
                final = marked and q == hi - 1
                token = -1
                if final:
                    spot = int(np.searchsorted(self.end_keys, node * 256 + s))
                    if spot < len(self.end_keys) and self.end_keys[spot] == node * 256 + s:
                        token = int(self.end_tokens[spot])
                else:
                    node = int(self.next[self.row[node], s]) if self.row[node] >= 0 else -1
                    if node < 0:
                        break
                    token = int(self.label[node])
                if token < 0:
                    continue
                pair = (before, token)
                if before >= 0 and pair not in seen:
                    seen[pair] = bool(self.step(self.state[[before]], np.array([token]))[0] >= 0)
                if before < 0 or seen[pair]:
                    last_token[q], begin[q] = token, p


# White space of Unicode (fixed values).
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """0 blank, 1 letter, 2 number, 3 other, for every code point."""
    if not _classes:
        kinds = {"L": 1, "N": 2}
        t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)), np.uint8, 0x110000)
        t[list(BLANKS)] = 0
        _classes.append(t)
    return _classes[0]


class WordBpe:
    """Encoder and decoder of a lower-casing word BPE vocabulary with an end-of-word mark.

    Text is normalised (NFC, lower case), split into letter runs, single numbers, runs of other
    characters and the English contractions after an apostrophe; white space is dropped.  Special
    strings of the vocabulary found in a text become their ids.
    """

    KEPT_WORDS = 150_000
    KEPT_BYTES = 8 << 20  # of kept words (four a character)

    def __init__(self, model: str):
        spec = json.loads(model)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())]
        if kinds != ["NFC", "Replace", "Lowercase"] or not suffix or spec.get("decoder"):
            raise ValueError("not a lower-casing word BPE vocabulary")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        joined = {u + v for u, v in merges}
        alphabet = byte_alphabet()
        base = {}
        for s, t in vocab.items():
            if s not in joined:
                mark = 256 if s.endswith(suffix) and len(s) > len(suffix) else 0
                core = s[:-len(suffix)] if mark else s
                if len(core) == 1 and core in alphabet:
                    base[t] = alphabet[core] + mark
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.auto = Automaton(base, [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], n)
        del self.auto.spelled, spec, merges, joined  # only the construction reads them
        give_back()
        labels = [b""] * n
        for s, t in [*vocab.items(), *self.special.items()]:
            labels[t] = s.encode() + b" "
        self.labels = Strings(np.uint8)
        self.labels.add(np.frombuffer(b"".join(labels), np.uint8), np.fromiter(map(len, labels), np.int64, n))
        found = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.special_re = re.compile("(" + "|".join(found) + ")") if found else None
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.text = SpanTable(19), Strings(np.uint32), Strings(np.uint8)

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: characters are lowered one by one
        return text.lower()

    def words(self, cps: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word of texts that stand between ``edges``."""
        kind = classes()[cps]
        start = kind > 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start[edges[edges < len(cps)]] = kind[edges[edges < len(cps)]] > 0
        quote = np.flatnonzero((cps == 0x27) & start)
        quote = quote[quote + 1 < len(cps)]
        quote = quote[kind[quote + 1] == 1]
        if len(quote):
            a = cps[quote + 1]
            b = np.where(quote + 2 < len(cps), cps[np.minimum(quote + 2, len(cps) - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            taken = np.where(one, 1, np.where(two, 2, 0))
            for n in (1, 2):
                q = quote[taken == n]
                start[q + 1] = False
                rest = q + n + 1
                rest = rest[rest < len(cps)]
                start[rest[kind[rest] == 1]] = True
        starts = np.flatnonzero(start)
        breaks = np.flatnonzero(start | (kind == 0))
        nxt = np.searchsorted(breaks, starts, "right")
        return starts, np.append(breaks, len(cps))[nxt]

    def learn(self, texts: list[bytes]) -> None:
        """Ids and decoded bytes (a blank behind every label) of new words."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ids, counts = self.auto.encode_words(np.frombuffer(b"".join(texts), np.uint8), lengths, True)
        self.ids.add(ids, counts)
        flat, size = self.labels.get(ids)
        ends = np.cumsum(counts)
        total = np.concatenate(([0], np.cumsum(size)))
        self.text.add(flat, total[ends] - total[ends - counts])

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of every word among the kept words, words per text) of plain texts."""
        norm = [self.normal(t) for t in texts]
        joined = "\n".join(norm)
        edges = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in norm), np.int64, len(norm)))))
        del norm
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        starts, ends = self.words(raw.view(np.uint32), edges)
        counts = np.bincount(np.searchsorted(edges, starts, "right") - 1, minlength=len(texts))[:len(texts)]
        if len(self.known) > self.KEPT_WORDS or self.known.held_bytes() > self.KEPT_BYTES:
            self.forget()
        spot, new = self.known.look_up(raw, starts * 4, ends * 4)
        if len(new):
            self.learn([joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        return spot, counts

    def encode_texts(self, texts: list[str], group: int = 1 << 19):
        """Per text (ids as little-endian 32-bit bytes, decoded bytes), about ``group`` characters at a time."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= group):
                size += len(texts[hi])
                hi += 1
            yield from self._group(texts[lo:hi])
            lo = hi

    def _group(self, texts: list[str]):
        parts, plan = [], []
        for t in texts:
            pieces = self.special_re.split(t) if self.special_re is not None and "|>" in t else [t]
            if len(pieces) == 1:
                plan.append(None)
                parts.append(t)
            else:
                plan.append(pieces)
                parts += pieces[::2]
        spots, counts = self.look_up(parts)
        made = []
        for table in (self.ids, self.text):
            flat, size = table.get(spots)
            ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)].tolist()
            made.append((flat, [0, *ends]))
        (ids, id_at), (text, text_at) = made

        def part(k: int) -> tuple[bytes, bytes]:
            return ids[id_at[k]:id_at[k + 1]].astype("<u4").tobytes(), text[text_at[k]:max(text_at[k], text_at[k + 1] - 1)].tobytes()

        k = 0
        for pieces in plan:
            if pieces is None:
                yield part(k)
                k += 1
                continue
            all_ids, all_text = [], []
            for n, piece in enumerate(pieces):
                if n % 2:
                    all_ids.append(np.array([self.special[piece]], "<u4").tobytes())
                    all_text.append(piece.encode())
                else:
                    own = part(k)
                    k += 1
                    all_ids.append(own[0])
                    all_text += [own[1]] if own[0] else []
            yield b"".join(all_ids), b" ".join(all_text)

    def decode(self, ids: np.ndarray) -> bytes:
        """Labels of the arcs in order; this vocabulary joins them by blanks."""
        return self.labels.get(ids)[0].tobytes()[:-1]


def bpe_of(model: str) -> WordBpe:
    return per_worker(("word-bpe", hash(model)), lambda: WordBpe(model))


def _model(spark, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _plain(t: pa.Array) -> list[str]:
    return [x or "" for x in t.to_pylist()]


def encode_column(spark, text: Column, model_path: str) -> Column:
    """Token ids (array of int) of a text column; NULL counts as empty."""
    held = _model(spark, model_path)

    def encode(t: pa.Array) -> pa.Array:
        rows = [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in bpe_of(held.value).encode_texts(_plain(t))]
        cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))

    return F.arrow_udf(in_spans(encode), "array<int>")(text.cast("string"))


def decode_column(spark, ids: Column, model_path: str) -> Column:
    """Decoded text of an id-array column; NULL and empty arrays give the empty text."""
    held = _model(spark, model_path)

    def decode(a: pa.Array) -> pa.Array:
        bpe = bpe_of(held.value)
        return pa.array([bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in a.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def round_trip(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded.

    Defined cases: NULL and empty texts have no ids and decode to the empty text; special strings
    in a text become their ids; keys may be NULL or repeated; other columns are ignored.  One scan,
    no shuffle; the automaton is compiled once per Python worker from the broadcast vocabulary.
    """
    held = _model(docs.sparkSession, model_path)

    def digest(t: pa.Array) -> pa.Array:
        n, a, b = [], [], []
        for ids, decoded in bpe_of(held.value).encode_texts(_plain(t)):
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(decoded).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                          names=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.arrow_udf(in_spans(digest), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    rows = docs.select(named(key).alias(key), made(F.coalesce(named(text).cast("string"), F.lit(""))).alias("_d"))
    return rows.select(named(key), "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")
