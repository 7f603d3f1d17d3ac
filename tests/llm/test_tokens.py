"""Token counting, the BPE automaton and the id store against the tokenizer libraries."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditora.llm import bpe, idstore, queries, textnum, tokencount
from auditora.llm.textnum import HashTable, buffers

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
PIECES, WORDS, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
CLASH = "doc_id bigint, text string, k string, b string, n int, key string, h int, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, "c", 2, 3) for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def words():
    with open(WORDS, encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def odd_texts(n, seed=5):
    random.seed(seed)
    parts = ["a", "B", "'", "'s", "'re", "'ll", "'x", "\n", " ", "  ", ".", ",", "<|endoftext|>", "<|startoftext|>", "<|", "É", "é", "́",
             " ", "12", "½", "\t", "日本", "Σ", "ΑΣ", "İ", "ß", "-", "_", "’", "\r\n", "Don't", "Ⅷ", "😀", "​", "\x1c", "ẞ", "aaaa", "!!!!"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(n)]


# ---------------------------------------------------------------- counts

@pytest.mark.parametrize("chunk,overlap", [(1 << 14, 256), (300, 8), (64, 1)])
def test_spliced_counts_equal_whole_ones(chunk, overlap):
    with open(PIECES, "rb") as f:
        c = tokencount.PieceCounter(f.read(), chunk, overlap)
    random.seed(3)
    texts = ["", "a" * 20_000, "ab" * 9000, "日龘😀" * 3000, " " * 20_000, "▁x " * 4000, "<s> </s>" * 2000,
             "".join(random.choice("abcde fgé▁龘") for _ in range(30_000)), *odd_texts(300)]
    got = c.count(*buffers(pa.array(texts)))
    assert got.tolist() == [len(x) for x in c.sp.encode(texts, return_type=int)]
    assert c.widened or overlap > 8  # small overlaps had to be widened


def test_count_defined_cases(spark):
    rows = [(1, None), (1, ""), (None, "hello <s>"), (2, "hello"), (2, "hello"), (3, "word " * 30_000)]
    got = tokencount.count_tokens(frame(spark, rows), PIECES).collect()
    by = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got))
    assert by[1:3] == [(1, 0, 0, False)] * 2 and by[0][1] == 9 and by[-1][3] and by[3] == by[4]
    assert tokencount.count_tokens(frame(spark, rows).limit(0), PIECES).count() == 0


# ---------------------------------------------------------------- automaton

def explicit(base, merges):
    """The automaton built literally: arcs per state, copies made by every gadget."""
    arcs = {0: {t: 0 for t in base}}
    for u, v, w in merges:
        new = {}
        for state in list(arcs):  # states that arc u leads to and that have arc v
            if v in arcs[state] and any(a.get(u) == state for a in arcs.values()):
                new[state] = max(arcs) + 1 + len(new)
        old = {s: dict(a) for s, a in arcs.items()}
        for state, copy in new.items():
            arcs[copy] = {t: x for t, x in old[state].items() if t != v}
        for a in arcs.values():
            p = a.get(u)
            if p in new:
                target = old[p][v]
                a[u] = new[p]
                if not (u == v and a is arcs[new[p]]):
                    a[w] = new.get(target, target) if w == u else target
    return arcs


def plain_bpe(symbols, merges):
    rank = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
    while True:
        found = [(rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        if not found:
            return symbols
        _, i = min(found)
        symbols = symbols[:i] + [rank[symbols[i], symbols[i + 1]][1]] + symbols[i + 2:]


@pytest.mark.parametrize("seed", range(12))
def test_automaton_of_random_merges(seed):
    random.seed(seed)
    base = {0: 97, 1: 98, 2: 99}
    merges, known = [], [0, 1, 2]
    while len(merges) < 12:
        u, v = random.choice(known), random.choice(known)
        if (u, v) not in {m[:2] for m in merges}:
            merges.append((u, v, 3 + len(merges)))
            known.append(merges[-1][2])
    # one derivation per string, as in trained vocabularies
    spelled = {0: "a", 1: "b", 2: "c"}
    keep = []
    for u, v, w in merges:
        s = spelled.get(u, "") + spelled.get(v, "")
        if u in spelled and v in spelled and s not in spelled.values():
            spelled[w] = s
            keep.append((u, v, w))
    auto = bpe.Automaton(base, keep, 3 + len(merges))
    texts = ["".join(random.choice("abc") for _ in range(random.randint(1, 14))) for _ in range(400)] + ["a" * 150, "abc" * 60]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, counts = auto.encode_words(data, np.array([len(t) for t in texts]), False)
    at = np.concatenate(([0], np.cumsum(counts)))
    arcs = explicit(base, keep)
    for t, a, b in zip(texts, at[:-1], at[1:]):
        want = plain_bpe([ord(c) - 97 for c in t], keep)
        assert ids[a:b].tolist() == want
        state = 0
        for token in want:  # the literal automaton accepts the path
            state = arcs[state][token]


def test_words_like_the_library(words):
    tok = library(WORDS)
    texts = [*odd_texts(4000), "a" * 5000, "!?" * 3000, "ab" * 500 + " x", "é" * 3000, ""]
    for t, (ids, decoded) in zip(texts, words.encode_texts(texts)):
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == tok.decode(want, skip_special_tokens=False)
        assert words.decode(np.array(want, np.int64)) == decoded


def test_forgetting_known_words_changes_nothing(words):
    texts = odd_texts(500, 9)
    want = list(words.encode_texts(texts))
    small = type("Small", (bpe.WordBpe,), {"KEPT_WORDS": 50}).__new__(bpe.WordBpe)
    small.__dict__.update(words.__dict__)
    small.KEPT_WORDS = 50
    small.forget()
    assert list(small.encode_texts(texts, group=200)) == want


def test_round_trip_query_and_cases(spark):
    tok = library(WORDS)
    rows = [(1, None), (1, ""), (None, "Hello, World's <|endoftext|> end"), (2, "x y"), (2, "x y")]
    got = bpe.round_trip(frame(spark, rows), WORDS).collect()
    for (i, t), r in zip(rows, got):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    two = frame(spark, rows).select(bpe.encode_column(spark, F.col("text"), WORDS).alias("ids"))
    back = two.select("ids", bpe.decode_column(spark, F.col("ids"), WORDS).alias("t")).collect()
    assert back[0].ids == [] and back[0].t == "" and back[2].t == tok.decode(back[2].ids, skip_special_tokens=False)
    assert bpe.round_trip(frame(spark, rows).limit(0), WORDS).count() == 0


# ---------------------------------------------------------------- store

def test_pieces_encode_like_whole_texts():
    with open(BYTES, encoding="utf-8") as f:
        enc = idstore.BatchEncoder(f.read())
    assert enc.cuts and enc.width == 2
    tok, texts = library(BYTES), odd_texts(5000, 7)
    ids, counts = enc.encode(*buffers(pa.array(texts)))
    at = np.concatenate(([0], np.cumsum(counts)))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_hash_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    t = HashTable(10)
    t.add(h, np.arange(len(h), dtype=np.int32))
    got = t.find(h)
    assert ((got == np.arange(len(h))) | (got == -1)).all() and (got >= 0).mean() > 0.9
    assert (t.find(rng.integers(1 << 63, 1 << 64, 1000, dtype=np.uint64)) == -1).all()


def test_key_index_is_minimal_and_rejects_other_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    n = len(keys)
    idx = idstore.KeyIndex.build(np.append(keys, keys[:2]), np.arange(n + 2) % 7, np.arange(n + 2), np.ones(n + 2, np.int64))
    assert len(idx.table) == n - 2 and len(idx.overflow) == 4  # equal keys can't be told apart by hashing
    again = idstore.KeyIndex.load(idx.blob())
    e = again.find(keys[2:])
    assert (e["ordinal"] == np.arange(2, n)).all() and (e["shard"] == np.arange(2, n) % 7).all()
    other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (again.find(other)["rows"] > 0).sum() <= 1
    empty = idstore.KeyIndex.load(idstore.KeyIndex.build(keys[:0], keys[:0], keys[:0], keys[:0]).blob())
    assert (empty.find(keys[:5])["rows"] == 0).all()


def test_store_query(spark):
    tok = library(BYTES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op10_id_store"](spark, SF).collect()))
    start = 0
    for (i, t), (key, at, n, crc) in zip(sorted((r.doc_id, r.text) for r in docs.collect()), got):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (key, at, n, crc) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += n


def test_store_defined_cases(spark, tmp_path):
    rows = [(None, "null one"), (None, None), (4, ""), (2, "two"), (2, "two"), (2, "other two"), (9, "long " * 20_000)] + [(50, f"t {n}") for n in range(60)]
    tok = library(BYTES)
    folder = str(tmp_path / "store")
    idstore.write_store(frame(spark, rows), folder, BYTES, docs_per_shard=10)
    buckets = idstore.index_store(spark, folder, keys_per_bucket=2)
    got = idstore.stored_digest(spark, folder, BYTES, buckets).collect()
    assert len(got) == len(rows)
    want = sorted((i is not None, i or 0, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate(([0], np.cumsum([r.n_tokens for r in order])))[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((i is not None, i or 0) for i, _ in rows)
    absent = spark.createDataFrame([(777, 0)], "key bigint, run int")
    assert idstore.look_up(folder, buckets, absent).count() == 0
    none = str(tmp_path / "empty")
    assert idstore.store_and_read(frame(spark, rows).limit(0), none, BYTES).count() == 0


# ---------------------------------------------------------------- words whose polynomial hashes collide

def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_thue_morse_words_keep_their_own_ids(spark):
    words = [thue_morse(n, *ab) for n in (1024, 2048, 4096, 8192) for ab in ("ab", "ba")]
    rows = [(i, w) for i, w in enumerate([*words, *[f"x {w} y" for w in words]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in bpe.round_trip(df, public_tokenizers.path("word_bpe_49k.json")).collect()}
    for i, text in rows:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    enc = idstore.BatchEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = [t.encode() for _, t in rows]
    ids, n = enc.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))
    at = np.concatenate(([0], np.cumsum(n)))
    for k, (_, text) in enumerate(rows):
        assert ids[at[k]:at[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_span_table_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(textnum, "span_hashes", lambda data, starts, ends, salt=0: (ends - starts).astype(np.uint64) % np.uint64(3))
    table, seen = textnum.SpanTable(8), {}
    r = np.random.default_rng(3)
    for _ in range(5):
        words = [bytes(r.integers(97, 100, r.integers(1, 30)).astype(np.uint8)) for _ in range(200)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        before = len(table)
        spot, new = table.look_up(data, ends - [len(w) for w in words], ends)
        assert len(table) - before == len(new)
        for w, s in zip(words, spot.tolist()):
            flat, _ = table.spans.get(np.array([s]))
            assert flat.tobytes() == w
            seen.setdefault(w, s)
        assert [words[i] for i in new.tolist()] == [table.spans.get(np.array([before + k]))[0].tobytes() for k in range(len(new))]


def random_merges(seed, symbols=4, merges=40):
    r = random.Random(seed)
    base = {i: i for i in range(symbols)}
    tokens, out, made = list(base), [], {}
    for _ in range(merges):
        u, v = r.choice(tokens), r.choice(tokens)
        if (u, v) in made:
            continue
        made[u, v] = len(tokens)
        out.append((u, v, len(tokens)))
        tokens.append(len(tokens))
    return base, out, len(tokens)


@pytest.mark.parametrize("seed", range(6))
def test_transition_table_agrees_with_undone_merges(seed, monkeypatch):
    base, merges, n = random_merges(seed)
    auto = bpe.Automaton(base, merges, n)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    follows = auto.may_follow(a, b).reshape(n, n)
    for s in range(auto.n_states):  # tokens of one state have the same arcs
        rows = follows[auto.state == s]
        assert (rows == rows[0]).all()
    for _ in range(2):  # closed, then looked up
        got = auto.step(auto.state[a], b)
        assert ((got >= 0) == follows.ravel()).all() and (got[got >= 0] == auto.state[b][got >= 0]).all()
    # the table alone is read once its entries are closed
    monkeypatch.setattr(auto, "may_follow", None)
    data = np.random.default_rng(seed).integers(0, 4, 3000).astype(np.uint8)
    ids, counts = auto.encode_words(data, np.full(30, 100), False)
    ranks = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
    want = []
    for word in data.reshape(30, 100).tolist():
        while True:
            best = min(((ranks[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks), default=None)
            if best is None:
                break
            u, v, w = merges[best[0]]
            out, i = [], 0
            while i < len(word):
                if i + 1 < len(word) and (word[i], word[i + 1]) == (u, v):
                    out.append(w)
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            word = out
        want += word
    assert ids.tolist() == want


def test_a_small_transition_table_is_filled_again(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_BITS", 5)
    base, merges, n = random_merges(11)
    auto = bpe.Automaton(base, merges, n)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    for lo in range(0, len(a), 10):
        got = auto.step(auto.state[a[lo:lo + 10]], b[lo:lo + 10])
        assert ((got >= 0) == auto.may_follow(a[lo:lo + 10], b[lo:lo + 10])).all()
