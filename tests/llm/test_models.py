"""Toxicity, language identification, top-k, near-copy components and the pipeline."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from auditora.llm import langid, ngramjoin, topk, toxicity
from auditora.llm.common import ARROW_BYTES, small_arrow_batches
from auditora.llm.components import components

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, t string, k string, s double, language string, node int, comp int, _text_hash int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 0, "a", "b", 1.0, "c", 1, 2, 3) for i, t, g, s in rows], CLASH)


# ---------------------------------------------------------------- toxicity

@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_MORE}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_MORE}/labels.parquet")


@pytest.fixture(scope="module")
def model(docs, labels):
    return toxicity.fit(docs, labels)


def test_toxicity_learns_and_keeps_folds_apart(docs, labels, model):
    got = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "flag").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    right = np.mean([r.predicted == r.toxic for r in held])
    assert len(held) > 50 and right > 0.9
    clean = [r for r in got if r.toxic == 0]
    assert np.mean([r.flag for r in clean]) < 0.03


def test_toxicity_score_is_the_plain_network(docs, model):
    """Pieces and batches change nothing: the score of a text alone, computed window by window."""
    import pyarrow as pa
    texts = [r.text for r in docs.orderBy("doc_id").limit(20).collect()] + ["", "idiot", "a b", None, "loser " * 200_000]
    idx, counts = toxicity.features(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    got = model.logits(idx, counts)
    for n in [*range(24)]:
        rows = np.vstack([idx[at[n]:at[n + 1]], np.full((2, 3), toxicity.TABLE)])
        x = model.embed(rows)
        best = np.zeros(model.conv.shape[2])
        for p in range(at[n + 1] - at[n]):
            best = np.maximum(best, sum(x[p + j] @ model.conv[j] for j in range(3)) + model.conv_bias)
        assert abs(best @ model.out + model.out_bias - got[n]) < 1e-3


def test_toxicity_defined_cases(spark, docs, labels, model):
    rows = [(None, None, None, "x"), (1, "", "en", "x"), (1, "", "en", "x"), (2, "loser idiot scum trash", "xx", "x"), (3, "w " * 300_000, "de", "x")]
    got = toxicity.score_toxicity(frame(spark, rows), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 5 and by[None][0].score == by[1][0].score == by[1][1].score and not by[None][0].held_out
    assert by[2][0].lang_threshold == model.threshold
    kept = toxicity.drop_toxic(frame(spark, rows), model)
    assert kept.columns == CLASH.replace(" bigint", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ")
    assert toxicity.score_toxicity(frame(spark, rows).limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert none.rate == 0.0 and toxicity.score_toxicity(docs.limit(3), none).select("score").distinct().collect()[0][0] == 0.0
    one = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert one.rate == 1.0


# ---------------------------------------------------------------- language

def test_language_of_texts_alone(spark, docs):
    m = langid.fit(docs.filter("doc_id % 2 = 0"))
    rows = docs.filter("doc_id % 2 = 1").select("doc_id", "text", F.col("lang").alias("truth"))
    bare = rows.select("*", langid.text_evidence(spark, m, F.col("text")).alias("_ll"), *[F.lit(None).cast("string").alias(c) for c in (
        "_declared", "_suffix", "_host", "_domain")])
    got = langid.fuse(bare, m.languages).collect()
    assert np.mean([r.language == r.truth for r in got]) > 0.97


def test_text_model_adds_up_trigrams_of_each_text(docs):
    import pyarrow as pa
    from auditora.llm.textnum import buffers
    m = langid.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(10).collect()] + ["", "ab", "éa", "123 .. 4", "x" * 2_500_000]
    total, count = m.log_likelihoods(*buffers(pa.array(texts)))
    for n, t in enumerate(texts):
        rows = langid.trigrams(np.frombuffer(t.encode(), np.uint8)) if len(t.encode()) > 2 else np.zeros(0, int)
        rows = rows[rows != langid.BLANK3]
        assert count[n] == len(rows)
        assert np.allclose(total[n], m.table[rows].astype(float).sum(axis=0), rtol=1e-3, atol=1e-6)


def test_pages_use_all_evidence(spark, docs):
    m = langid.fit(docs)
    text = {r.lang: r.text for r in docs.filter("n_chars > 500 and n_chars < 3000").collect()}
    rows = [(n, f"https://www.h{n % 5}.example.de/de/{n}", f'<html lang="de"><script>the of and</script><p>{text["de"][:300]}</p>') for n in range(30)]
    rows += [(100, "https://www.h1.example.de/de/100", "<p>x</p>"), (101, None, None), (102, "not an address", ""), (103, "http://a.b.org", "<html lang=fr>" + text["fr"]),
             (103, "http://a.b.org", "<html lang=fr>" + text["fr"]), (None, "http://x.org/", text["en"])]
    pages = spark.createDataFrame([(*r, "e", "f") for r in rows], "page_id bigint, url string, html string, host string, confidence string")
    got = {r.page_id: r for r in langid.identify_pages(pages, m).collect()}
    assert all(got[n].language == "de" and not got[n].rejected for n in range(30))
    assert got[100].language == "de"  # one letter of text: host and suffix decide
    assert got[101].language == got[102].language == "und" and got[101].rejected
    assert got[103].language == "fr" and got[None].language == "en"
    assert langid.identify_pages(pages, m).count() == len(rows)
    assert langid.identify_pages(pages.limit(0), m).count() == 0


def test_keep_identified_cases(spark, docs):
    m = langid.fit(docs)
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "1234 %%%", "en", "s"), (4, "A.", "en", "s"), (5, docs.first().text, None, None), (5, docs.first().text, None, None)]
    kept = langid.keep_identified(frame(spark, rows), m)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 5]
    none = langid.fit(docs.limit(0))
    assert none.languages == [] and langid.keep_identified(frame(spark, rows), none).count() == 0


def made_up_languages(n, texts):
    """(label, text): languages of 12 words of their own, the first ones with more texts."""
    rng = np.random.default_rng(7)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        out += [(f"l{i:03d}", " ".join(rng.choice(words, 40))) for _ in range(texts + (i < 64))]
    return out


@pytest.mark.parametrize("dense", [1 << 24, 0])
def test_every_labelled_language_has_a_model(spark, monkeypatch, dense):
    import pyarrow as pa
    from auditora.llm.textnum import buffers
    rows = made_up_languages(90, 4)
    docs = frame(spark, [(n, t, g, f"s{n % 3}") for n, (g, t) in enumerate(rows)])
    m = langid.fit(docs)
    monkeypatch.setattr(langid, "DENSE_CELLS", dense)
    assert m.languages == sorted({g for g, _ in rows})
    total, _ = m.log_likelihoods(*buffers(pa.array([t for _, t in rows])))
    assert [m.languages[i] for i in total.argmax(axis=1)] == [g for g, _ in rows]
    for n, (_, t) in enumerate(rows[::50]):
        at = langid.trigrams(np.frombuffer(t.encode(), np.uint8))
        assert np.allclose(total[50 * n], m.table[at[at != langid.BLANK3]].astype(float).sum(axis=0), rtol=1e-4)
    if dense:
        assert langid.keep_identified(docs, m).count() == len(rows)


def test_training_sample_is_of_different_texts(spark):
    """Copies of a text change no model; few texts are all learnt, of many just ``rows``."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    once = [("aa", f"{words[i]} {words[i + 1]}") for i in range(300)] + [("bb", words[350]), ("bb", words[351])]
    copies = [("aa", once[n][1]) for n in range(0, 300, 30) for _ in range(200)] + [("bb", words[350])] * 900

    def learn(rows):
        return langid.fit(frame(spark, [(n, t, g, "s") for n, (g, t) in enumerate(rows)]), rows=20)

    a, b = learn(once), learn(once + copies)
    assert a.languages == b.languages == ["aa", "bb"] and np.array_equal(a.table, b.table)
    slots = {g: set(a.first.searchsorted(np.flatnonzero(a.lang == i), "right") - 1) for i, g in enumerate(a.languages)}
    grams = {t: set(langid.trigrams(np.frombuffer(t.encode(), np.uint8))) for _, t in once}
    assert slots["bb"] == grams[words[350]] | grams[words[351]]
    assert sum(grams[t] <= slots["aa"] for g, t in once if g == "aa") == 20


# ---------------------------------------------------------------- top-k

def brute_topk(vectors, k, every):
    out = []
    ids = sorted(vectors)
    for q in ids:
        if q % every == 0:
            s = sorted(((-int(np.dot(vectors[q], vectors[x])), x) for x in ids if x != q))[:k]
            out += [(q, n + 1, x, -v) for n, (v, x) in enumerate(s)]
    return out


@pytest.mark.parametrize("blocks,groups,pivots", [(8192, 2048, 256), (37, 5, 16), (50, 1000, 1)])
def test_topk_is_exact(spark, blocks, groups, pivots):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(150, 6)), rng.normal(size=(60, 6)) * 0.05 + 2, np.tile(rng.normal(size=6), (90, 1))])
    x = (x / 2).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(c) for c in v], "x", 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, id string, cell int")
    got = topk.top_products(rows, F.col("id") % 10 == 0, k=7, rows_per_block=blocks, queries_per_group=groups, max_pivots=pivots)
    want = brute_topk({i: np.floor(64 * v.astype(float)).astype(int) for i, v in enumerate(x)}, 7, 10)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_defined_cases(spark):
    schema = "vec_id bigint, embedding array<double>"
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
            (None, [1.0, 1.0]), (6, [2.0]), (7, []), (1, [0.25, 9.0])]
    got = topk.top_products(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 6, 8192), (0, 2, 1, 1024), (0, 3, 7, 0)]
    assert topk.top_products(spark.createDataFrame([], schema), F.col("id") % 20 == 0).count() == 0
    assert topk.top_products(spark.createDataFrame([(3, [1.0])], schema), F.col("id") % 20 == 0).count() == 0
    assert topk.top_products(spark.createDataFrame([(20, [1.0])], schema), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("blocks,pivots", [(8192, 256), (23, 9)])
def test_topk_repeated_ids_match_the_sql(spark, tmp_path, blocks, pivots):
    from auditora.llm.sql import TOPK_SQL
    import duckdb
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.integers(0, 60, 300), rng.normal(size=(300, 4)))]
    rows += [(20, [float(c) for c in v]) for v in rng.normal(size=(90, 4)) * 0.05 + 1] + [(7, [3.0, 3.0, 3.0, 3.0])] * 3
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    table.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    got = topk.top_products(table, F.col("id") % 20 == 0, rows_per_block=blocks, max_pivots=pivots, repeated=True).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(TOPK_SQL).fetchall())


# ---------------------------------------------------------------- components

def plain_components(rows, width, percent):
    """(set sizes, component ids) by comparing all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    members = {}
    for i, (k, _) in enumerate(rows):
        members.setdefault(root(i), []).append(k)
    return [len(s) for s in sets], [min((k for k in members[root(i)] if k is not None), default=None) for i in range(len(rows))]


def compare(spark, rows, width, percent):
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    got = ngramjoin.jaccard_components(docs, width=width, percent=percent).collect()
    sizes, comps = plain_components(rows, width, percent)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(zip([i for i, _ in rows], sizes, comps), key=key)


def test_components_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(spark, rows, 3, 90)


@pytest.mark.parametrize("seed,percent,local", [(1, 90, 3), (2, 80, 3), (3, 90, 1), (4, 60, 2)])
def test_components_of_crowded_near_copies(spark, monkeypatch, seed, percent, local):
    """Chains and stars of edited copies whose pairs lie on both sides of the threshold."""
    import random
    monkeypatch.setattr(ngramjoin, "LOCAL_MIN", local)
    monkeypatch.setattr(ngramjoin, "HUBS", 2)
    random.seed(seed)
    vocab = [f"w{n}" for n in range(60)]
    rows = []
    for base in range(4):
        text = [random.choice(vocab) for _ in range(random.choice([30, 45, 80]))]
        for _ in range(35):
            copy = list(text)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(vocab)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
            if random.random() < 0.3:
                text = copy
    compare(spark, rows, 3, percent)


def test_components_defined_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "a b"), (4, "A  B"), (None, "a b"), (None, "solo text here"), (5, "x y z w"), (5, "other words in here"),
            (6, "x y z w"), (9, "long " * 30_000), (7, "long " * 30_001)]
    compare(spark, rows, 3, 90)
    kept = ngramjoin.keep_one_per_component(frame(spark, [(i, t, "en", "s") for i, t in rows]))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in kept.collect()) == [(0, "solo"), (1, ""), (2, ""), (2, ""), (3, "a b"), (5, "othe"), (5, "x y "), (7, "long")]
    assert ngramjoin.jaccard_components(frame(spark, [])).count() == 0
    twice = [(1, "same words again", "en", "s")] * 3 + [(2, "same words again", "en", "s")]
    assert ngramjoin.keep_one_per_component(frame(spark, twice)).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_finds_components(spark, seed):
    rng = np.random.default_rng(seed)
    chain = [(i, i + 1) for i in range(200)]
    other = [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 300, (180, 2)) if a != b]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in chain + other:
        up[root(a)] = root(b)
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain + other, "a bigint, b bigint")).collect()}
    assert set(got) == set(up)
    assert len({(root(x), got[x]) for x in up}) == len({root(x) for x in up}) == len(set(got.values()))
    more = components(spark.createDataFrame([(0, 1000 + other[0][0] - 1000), (7, 5000)], "a bigint, b bigint"),
                      spark.createDataFrame(list(got.items()), "node bigint, comp bigint"))
    again = {r.node: r.comp for r in more.collect()}
    assert again[0] == again[200] == again[other[0][0]] == again[5000]


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_MORE)
        if name != "tokenize":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept[name] = docs.collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept["toxicity"]}
    clean = [i for i, t in labels.items() if t == 0]
    assert len(ids & set(clean)) >= 0.97 * len(clean)
    assert len(ids - set(clean) & set(labels)) < len(labels) - len(clean)
    assert {r.doc_id for r in kept["language"]} <= ids
    rows = [(r.doc_id, r.text) for r in kept["language"]]
    comps = plain_components(rows, 5, 80)[1]
    assert sorted(r.doc_id for r in kept["near_copies"]) == sorted(set(comps))
    # the copies of every document, drawn again from its stated distribution
    sizes = {}
    for r in kept["near_copies"]:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    total, weight = sum(sizes.values()), sum(n ** 0.5 for n in sizes.values())
    got = {}
    for r in kept["mix"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    for r in kept["near_copies"]:
        mean = total * sizes[r.source] ** 0.5 / weight / sizes[r.source]
        u = int(hashlib.md5(f"mix-1:n:1:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2 ** 48
        n, p = 0, math.exp(-mean)
        c = p
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        assert mean < 64 and got.get(r.doc_id, 0) == n
    assert sorted(r.doc_id for r in kept["tokenize"]) == sorted(r.doc_id for r in kept["mix"])
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tok = Tokenizer.from_str(f.read())
    text = {r.doc_id: r.text for r in kept["mix"]}
    for r in kept["tokenize"][:200]:
        ids = np.array(tok.encode(text[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50


def test_thue_morse_words_do_not_link(spark):
    """Words whose polynomial hashes modulo 2^64 are equal are different words."""
    def word(n, a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(n))
    rows = [(2 * k + j, f"{w} x y", "en", "s") for k, n in enumerate((1024, 2048, 4096, 8192)) for j, w in enumerate((word(n, "a", "b"), word(n, "b", "a")))]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: i for i in range(8)}


def test_crowded_tokens_are_joined_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40] + [f"u{i}x{j}" for j in range(1 + i % 3)] + base[40:]), "en", "s") for i in range(60)]
    want = sorted(map(tuple, ngramjoin.jaccard_components(frame(spark, rows), percent=80).collect()))
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngramjoin, "HUB_ROUNDS", 0)
    assert sorted(map(tuple, ngramjoin.jaccard_components(frame(spark, rows), percent=80).collect())) == want


# ---------------------------------------------------------------- the whole fusion by plain loops

def plain_fusion(rows, languages):
    """rows: (ll or None, declared, suffix, host, domain) -> [(language, confidence)]."""
    k = len(languages) + 1
    prior = [(1 - langid.UNKNOWN_PRIOR) / (k - 1)] * (k - 1) + [langid.UNKNOWN_PRIOR]

    def norm(logs):
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        return [x / sum(e) for x in e]

    def add(table, key, s):
        if key is not None:
            table[key] = [a + b for a, b in zip(table.get(key, [0.0] * k), s)]

    soft = [None if ll is None else norm([a + math.log(p) for a, p in zip(ll, prior)]) for ll, *_ in rows]
    total, by = [0.0] * k, [{}, {}, {}, {}]
    domain_of = {}
    for s, (_, declared, suffix, host, domain) in zip(soft, rows):
        if s is not None:
            total = [a + b for a, b in zip(total, s)]
            for table, key in zip(by, (declared, suffix, host, domain)):
                add(table, key, s)
            if host is not None and domain is not None:
                domain_of[host] = min(domain, domain_of.get(host, domain))
    corpus = [(t + 10 * p) / (sum(total) + 10) for t, p in zip(total, prior)]

    def smooth(s, parent, weight):
        return [(x + weight * p) / (sum(s) + weight) for x, p in zip(s, parent)]

    def evidence(column, table, value, trust):
        if value is None:
            return [0.0] * k
        values = len({r[column] for r in rows if r[column] is not None})
        head = [trust if value == g else 0.0 for g in [*languages, langid.UNKNOWN]]
        s = table.get(value, [0.0] * k)
        return [math.log((x + h + langid.EVIDENCE_SMOOTHING) / (n + trust + langid.EVIDENCE_SMOOTHING * (values + 1))) for x, h, n in zip(s, head, total)]

    out = []
    for s, (ll, declared, suffix, host, domain) in zip(soft, rows):
        if ll is None:
            out.append((langid.UNKNOWN, 0.0))
            continue
        parent = smooth(by[3][domain_of[host]], corpus, langid.DOMAIN_WEIGHT) if host in domain_of else corpus
        hosts = by[2].get(host, s) if host is not None else s
        prior_of_host = smooth([max(0.0, a - b) for a, b in zip(hosts, s)], parent, langid.HOST_WEIGHT)
        logs = [math.log(p + 1e-12) + a + b + c for p, a, b, c in zip(prior_of_host, ll, evidence(1, by[0], declared, langid.DECLARED_TRUST),
                                                                   evidence(2, by[1], suffix, 0.0))]
        p = norm(logs)
        best = max(range(k), key=lambda i: (p[i], -i))
        out.append(([*languages, langid.UNKNOWN][best], p[best]))
    return out


def test_fusion_equals_plain_loops_on_pages_and_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = [(-1, None, None), (-2, "http://lone.example.fr/x", ""), (-3, "nonsense", "<html lang='de'><p>wort"), (-4, "https://a.b.es/en/q", "<html lang=EN>12 34")]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema))
    parts = langid.page_parts(F.col("url"), F.col("html"))
    rows = pages.select("page_id", langid.text_evidence(spark, model, F.col("html"), markup=True).alias("ll"), *[c.alias(n) for n, c in parts.items()]).collect()
    want = dict(zip([r["page_id"] for r in rows], plain_fusion([(r["ll"], r["_declared"], r["_suffix"], r["_host"], r["_domain"]) for r in rows], model.languages)))
    got = {r["page_id"]: (r["language"], r["confidence"]) for r in langid.identify_pages(pages, model).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in got)
    rows = docs.select("doc_id", langid.text_evidence(spark, model, F.col("text")).alias("ll"), F.lower("lang").alias("d"), "source").collect()
    want = plain_fusion([(r["ll"], r["d"], None, r["source"], None) for r in rows], model.languages)
    stay = {r["doc_id"] for r, (g, p) in zip(rows, want) if g != langid.UNKNOWN and p >= langid.MIN_CONFIDENCE}
    assert {r["doc_id"] for r in langid.keep_identified(docs, model).select("doc_id").collect()} == stay


def test_toxicity_learns_from_every_row(spark, docs, labels, model, monkeypatch):
    """Rows outside the first sample change the network, every calibration row counts, and tasks' order does not."""
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "lang", "toxic")
    truth = labels.join(docs.select("doc_id"), "doc_id").selectExpr("toxic", "pmod(crc32(cast(doc_id as string)), 5) r").filter("r > 0").groupBy(
        F.when(F.col("r") == 1, 1).otherwise(0).alias("fold"), F.col("toxic").alias("y")).count()
    assert {tuple(r) for r in rows.groupBy("fold", "y").count().collect()} == {tuple(r) for r in truth.collect()}
    seen = []
    calibrate = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda m, logits, y, n, langs: (seen.append(n.sum()), calibrate(m, logits, y, n, langs)))
    some = [toxicity.fit(docs, labels, per_class=15, epochs=8) for _ in range(2)]
    assert seen == [rows.filter("fold = 1").count()] * 2
    monkeypatch.setattr(toxicity, "learn_all", lambda m, *_: m)
    start = toxicity.fit(docs, labels, per_class=15, epochs=8)
    assert np.allclose(some[0].table, some[1].table) and np.allclose(some[0].conv, some[1].conv)
    moved = (some[0].table != start.table).any(axis=1).sum()
    assert moved > 100

    def right(m):
        got = toxicity.score_toxicity(docs, m).withColumnRenamed("toxic", "flag").join(labels, "doc_id").filter("held_out").collect()
        return np.mean([r.predicted == r.toxic for r in got])

    assert right(some[0]) >= right(start) - 0.02


@pytest.fixture
def batch_conf(spark):
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    yield keys
    for k in keys:
        spark.conf.unset(k)


def test_training_takes_one_worker_a_task(docs, labels):
    """A chain of two Python functions would need two workers for every task of an executor."""
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "lang", "toxic").filter("fold = 0")
    m, sums = toxicity.fresh(np.random.default_rng(1))
    plan = toxicity.task_changes(m, sums, rows, {0: 1, 1: 1})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_training_does_not_depend_on_batches(spark, docs, labels, batch_conf):
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "lang", "toxic").filter("fold = 0").coalesce(1)
    found = []
    for size in (7, 2000):
        spark.conf.set(batch_conf[0], str(size))
        found.append(toxicity.learn_all(*toxicity.fresh(np.random.default_rng(1)), rows, {0: 3, 1: 1}))
    assert (found[0].table == found[1].table).all() and (found[0].conv == found[1].conv).all() and found[0].out_bias == found[1].out_bias


def test_batches_to_python_are_bounded_in_bytes(spark, batch_conf):
    import pyarrow as pa
    small_arrow_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "b"])

    got = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("abcdefgh "), 5000).alias("t")).mapInArrow(sizes, "n long, b long").collect()
    assert sum(r.n for r in got) == 300 and max(r.b for r in got) < ARROW_BYTES + 200_000


def test_language_fit_starts_no_workers_for_rdds(docs, monkeypatch):
    """Rows of a Python list pass through a Python RDD, whose workers have a daemon of their own in every executor."""
    from pyspark import RDD

    def refused(*_, **__):
        raise AssertionError("a Python RDD")
    monkeypatch.setattr(RDD, "mapPartitionsWithIndex", refused)
    assert len(langid.fit(docs).languages) > 2


def test_sample_reaches_the_driver_in_parts(docs, labels, monkeypatch):
    """The sample's words are read in several jobs, not as one result, and are the same however they are cut."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "lang", "toxic")
    parts, plain = [], Classic.toLocalIterator
    monkeypatch.setattr(Classic, "toLocalIterator", lambda df, *a: (parts.append(df._jdf.rdd().getNumPartitions()), plain(df, *a))[1])
    found = []
    for size in (10, 1 << 20):
        monkeypatch.setattr(toxicity, "SAMPLE_FILE_ROWS", size)
        found.append(toxicity.first_sample(rows, 100))
    assert parts[0] > 1 and len(found[0]) > 100
    assert [(y, w.tolist()) for y, w in found[0]] == [(y, w.tolist()) for y, w in found[1]]
