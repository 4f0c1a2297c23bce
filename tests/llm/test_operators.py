"""The corpus operators against brute force, on small tables with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, differences
from tidewire.llm import bpe, common, html_extract, line_dedup, ngram_join, packing, quality, queries, sharding, substring, topk, url_filter, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = queries.vocabulary()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, shard string"


def corpus(n=160, seed=3):
    """Invented texts: random ones, copies, near copies, shared passages; then the edge cases."""
    rng = random.Random(seed)
    pool = [f"w{rng.randrange(4000)}" for _ in range(4000)]
    passage = " ".join(rng.choices(pool, k=40))
    texts = []
    for i in range(n):
        t = rng.choices(pool, k=rng.choice([3, 8, 40, 90]))
        if i % 4 == 1:
            t = texts[-1].split(" ")[:]
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                t[rng.randrange(len(t))] = rng.choice(pool)
        if i % 7 == 2:
            t[rng.randrange(len(t)) : 0] = passage.split(" ")
        texts.append(" ".join(t))
    texts = [t.replace(" ", "\n", 9) if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [None, "", " \t\n", "one", "one", "ONE", "a b c d", "A b c d", "é ü ß 日本 🙂", "x " * 3000, passage, "a\nb\nc\nd", "a\nb\nc", "e\na\nb\nc\nd", "same line\n" * 9]
    return [(i * 3, t) for i, t in enumerate(texts)]


def docs_of(spark, rows, partitions=3):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", None, "y") for i, t in rows], SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def words_of(text):
    return WORD.findall(text or "")


# --- word hashing ---
def test_word_slices():
    texts = [t for _, t in corpus()]
    got = []
    for part in words.slices(pa.array(texts, pa.string()), most_bytes=500):
        h = part.hashes(lower=True)
        got += [h[a:b].tolist() for a, b in zip(part.row_start, part.row_start[1:])]
    assert [len(g) for g in got] == [len(words_of(t)) for t in texts]
    seen = {}
    for g, t in zip(got, texts):
        for h, w in zip(g, words_of(t)):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def balanced(doublings=11):
    """Two words of 2**doublings letters that collide under sums of powers modulo 2**64."""
    flip, word = str.maketrans("ab", "ba"), "a"
    for _ in range(doublings):
        word += word.translate(flip)
    return word, word.translate(flip)


def test_word_hashes_of_balanced_and_long_words(spark):
    a, b = balanced()
    for seed in (0, 1):
        spans = [w for n in (1, 7, 8, 9, 16, 255, 256, 257, 5000) for w in ("x" * n, "x" * (n - 1) + "y", "y" + "x" * (n - 1))] + [a, b]
        part = next(words.slices(pa.array([" ".join(spans)])))
        assert len(set(part.hashes(seed=seed).tolist())) == len(set(spans))
    tail = " ".join(f"w{i}" for i in range(12))
    got = {r.doc_id: r.n_removed for r in substring.removal_digest(docs_of(spark, [(1, f"{a} {tail}"), (2, f"{b} {tail}")])).collect()}
    assert got == {1: 0, 2: 0}
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(docs_of(spark, [(1, f"{a} x y z q"), (2, f"{b} x y z q")])).collect()}
    assert got == {1: 1, 2: 2}
    assert quality.score(docs_of(spark, [(1, f"{a}\n{b}")]), None).first().n_dup_lines == 0


# --- 1 sharding ---
def test_sharding(spark, docs, empty):
    rows = sharding.shard_documents(docs).collect()
    text = dict(corpus())
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots = {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0
    copies = docs_of(spark, [(i, "copy " * 50) for i in range(900)] + [(None, "z"), (None, "z")])
    sizes = sharding.shard_documents(copies, n_shards=4).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(sizes) == 4 and sizes.max() <= 1.1 * sizes.min()


def test_placing():
    rng = np.random.default_rng(1)
    v = np.stack([rng.integers(10, 5000, 3000), rng.integers(1, 900, 3000), rng.integers(1, 9, 3000)], 1)
    shard = sharding.place(v, 24)
    for column, near in ((0, 1.001), (1, 1.1), (2, 1.1)):
        load = np.bincount(shard, v[:, column], 24)
        assert load.max() <= near * load.mean()


# --- 2 similarity join ---
def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_similarity_join(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    assert got == brute_components(corpus())
    assert ngram_join.similar_components(empty).count() == 0


def test_similarity_join_of_many_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(spark, rows + [rows[5]])).collect()}
    assert got == brute_components(rows)
    with_null = ngram_join.similar_components(docs_of(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert {(r.doc_id, r.component_id) for r in with_null} == {(None, None), (1, 1)}


def test_prefix_tree_walk():
    """Sets that come in order, as paths of their tree, against one of them; shingles of one set alone only count in n."""
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(5000, 300, replace=False).astype(np.uint64))
    others = []
    for share in np.linspace(0.5, 1, 40):
        keep = rng.random(300) < share
        others.append(np.unique(np.r_[x[keep], rng.choice(9000, rng.integers(1, 60)).astype(np.uint64)]))
    others.sort(key=lambda y: y.astype(">u8").tobytes())
    for extra in (0, 9):
        want = []
        for y in others:
            both = len(np.intersect1d(x, y))
            want.append(100 * both >= 80 * (len(x) + extra + len(y) - both))
        walk = ngram_join.Walk(x, len(x) + extra)
        assert [walk.reaches(y, len(y)) for y in others] == want and any(want) and not all(want)


def test_similarity_join_of_texts_made_of_common_passages(spark):
    """Prefixes of very common shingles, pairs below and above the bound, cut into chunks of few documents."""
    rng = random.Random(5)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(14)]
    parts = [rng.sample(range(14), rng.choice([6, 9, 11, 12])) for _ in range(120)]
    rows = [(i, " ".join(passages[k] for k in (sorted(p) if i % 3 else p))) for i, p in enumerate(parts)] + [(500, passages[0]), (501, passages[0] + " end")]
    before = ngram_join.HUB_CHUNK, ngram_join.PAIR_CHUNK
    ngram_join.HUB_CHUNK, ngram_join.PAIR_CHUNK = 3, 3
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(spark, rows)).collect()}
    finally:
        ngram_join.HUB_CHUNK, ngram_join.PAIR_CHUNK = before
    want = brute_components(rows)
    assert got == want and 20 < len({c for _, c in want.values()}) < 115


def test_similarity_join_of_texts_under_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(spark, [(5, a), (5, b), (7, a), (6, b + " x"), (9, "z " * 9), (5, a)])).collect()}
    assert got == {(5, 26, 5), (7, 26, 5), (6, 27, 5), (9, 1, 9)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (9, 9), (5, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 7: 3}


# --- 3 line dedup ---
def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark, docs, empty):
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_removed_lines"]
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(corpus())
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    twice = line_dedup.drop_repeated_lines(docs_of(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in twice) == [(0, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]


# --- 4 search ---
def brute_topk(rows, k):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("size,scale", [(64, 1.0), (3, 1.0), (4, 1e7)])
def test_topk(spark, size, scale):
    rng = np.random.default_rng(size)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=size) * scale]) for i in range(300)]
    rows[40] = (40, rows[41][1])
    rows += [(1000, None), (1020, [float("nan")] * size), (1040, [None] * size), (1060, [1.0]), (None, [1.0] * size), rows[7], (1080, []), (1081, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, query_block=7, block=64, group=2)
    assert {tuple(r) for r in got.collect()} == brute_topk(list(dict.fromkeys((i, tuple(v) if v is not None else v) for i, v in rows)), 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def best_of_block(q, ids, x, k):
    return {(i, -s, j) for i in range(len(q)) for s, j in sorted((-sum(a * b for a, b in zip(q[i].tolist(), x[j].tolist())), j) for j in range(len(x)) if j != ids[i])[:k]}


@pytest.mark.parametrize("dim,high", [(40, 2**18), (40, 2**25), (3, 2**40)])
def test_topk_stops_on_skewed_vectors(dim, high):
    """Few candidates have large components, at the head of two lists: a small part of the lists is read. Sums below and above 2**53, and beyond 64 bits."""
    rng = np.random.default_rng(dim)
    x = rng.integers(-1, 2, (4000, dim))
    x[:60, :2] = rng.integers(high // 2, high, (60, 2))
    x = x[rng.permutation(4000)]
    q, ids = x[:5].copy(), np.arange(4000)
    q[:, :2] = rng.integers(high // 2, high, (5, 2)) * np.array([[1], [1], [1], [-1], [1]])
    q[3], q[4, 1] = -q[3], high // 3
    search = topk.Search(q, ids[:5], 5)
    for i in range(0, 4000, 1000):
        search.add(x[i : i + 1000], ids[i : i + 1000])
    assert set(zip(*(v.tolist() for v in (search.of, search.scores, search.ids)))) == best_of_block(q, ids, x, 5)
    assert search.stopped >= 15 and search.entries < 0.35 * 5 * 4000 * dim


def test_topk_reads_to_the_end_where_nothing_can_stop():
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (900, 24))
    search = topk.Search(x[:7].copy(), np.arange(7), 5)
    search.add(x, np.arange(900))
    assert set(zip(*(v.tolist() for v in (search.of, search.scores, search.ids)))) == best_of_block(x[:7], np.arange(7), x, 5)
    assert (search.stopped, search.entries) == (0, 7 * 900 * 24)


# --- 5 encoding, 6 packing ---
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_library(library):
    rng = random.Random(2)
    pool = [chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x250), rng.randrange(0x300, 0x2100), rng.randrange(0x2100, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(3000)]
    cases = [t for _, t in corpus()] + ["I'VE don't", "a<|endoftext|>b<|x", "ΣΑΣ İ ß", "x\u0085y\x1cz", "a" * 5000, "ab" * 3000 + "!" * 99, "\x00\x7f", "ﬁ Å"]
    cases += ["".join(rng.choices(pool, k=rng.randrange(1, 50))) for _ in range(500)]
    cases += ["".join(rng.choices([chr(i) for i in range(256)], k=rng.randrange(1, 50))) for _ in range(500)]
    tok = bpe.Tokenizer(VOCABULARY)
    for text in cases:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert tok.encode(text).tolist() == ids
        assert tok.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_long_words(library):
    rng = random.Random(7)
    tok = bpe.Tokenizer(VOCABULARY)
    cases = ["a" * 3001, "ab" * 2000 + "a", "".join(rng.choices("abcdefgh", k=5000)), "".join(rng.choices("etaoinsrhld", k=20_000)), "the" * 1500, "é" * 1300, "".join(rng.choices("aé日ß", k=2000)), "!" * 2500, "".join(rng.choices("#$%&*", k=3000))]
    for text in cases:
        assert tok.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for k in range(300):  # the same words by the long way only
        word = "".join(rng.choices(rng.choice(["ab", "etaoin", "lethos", "é日ab"]), k=rng.randrange(2, 60)))
        assert tok._merge_long(word.encode()).tolist() == library.encode(word, add_special_tokens=False).ids


def test_bpe_digest(docs, empty, library):
    text = dict(corpus())
    for r in bpe.encode_digest(docs, VOCABULARY).collect():
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digest(empty, VOCABULARY).count() == 0
    assert bpe.encode(docs, VOCABULARY).count() == len(text)


def test_packing(docs, empty, library):
    rows = packing.pack(docs, VOCABULARY).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(dict(corpus()))
    for i, text in corpus():
        ids, at = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # a power of two: no padding
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.choice([30, 200, 900, 3000, 9000]) for _ in range(400)]
    placed, sizes = packing.assign(lengths)
    assert sum(sizes) == sum(lengths) and [sum(p[1] for p in d) for d in placed] == lengths
    cost = Counter()
    for d in placed:
        for _, n, s, _ in d:
            cost[s] += n * n
    assert len(sizes) - 12 <= sum(lengths) // 4096
    assert sum(len(d) for d in placed) < 2.2 * len(lengths)


# --- 7 URL lists ---
def test_url_filter(spark):
    entries = spark.createDataFrame(
        [("bad.org", "add", 10), ("bad.org", "remove", 20), ("bad.org", "add", 30), ("x.com/de", "add", 5), ("both.net", "add", 7), ("both.net", "remove", 7), (None, "add", 1), ("a.b", None, 1), ("a.b", "other", 1)],
        "key string, action string, at int",
    )
    cases = [(1, "http://bad.org/", 9), (2, "http://bad.org/", 10), (3, "http://www.BAD.org:80/x", 19), (4, "https://u@bad.org./", 20), (5, "http://bad.org", 99), (6, "http://x.com/de/1", 6), (7, "http://x.com/en", 6),
             (8, "http://both.net", 8), (9, None, 9), (10, "nonsense", 9), (11, "http://bad.org/", None), (2, "http://bad.org/", 10), (12, "http://notbad.org", 15)]
    captures = spark.createDataFrame(cases, "page_id long, url string, fetched int").withColumn("kept", F.lit("x"))
    rows = url_filter.filter_captures(captures, entries).collect()
    assert len(rows) == len(cases)
    assert {r.page_id: r.matched_key for r in rows if not r.kept} == {2: "bad.org", 3: "bad.org", 5: "bad.org", 6: "x.com/de"}
    assert url_filter.filter_captures(captures, entries.limit(0)).where("kept").count() == len(cases)
    assert url_filter.filter_captures(captures.limit(0), entries).count() == 0


# --- 8 quality ---
def brute_counts(text):
    w, lines, seen, dup = words_of(text), (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(docs, empty):
    text = dict(corpus())
    for r in quality.score(docs, None).collect():
        n = brute_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and r.kept == (not r.base_failed)
    assert quality.score(empty, None).count() == 0


def test_quality_model_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        junk = i % 5 == 0
        w = ["".join(rng.choices("etaoinsr", k=5)) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(x + "$$$" if junk and rng.random() < 0.7 else x for x in w)))
        labels.append((i, 0 if junk else 1))
    docs = docs_of(spark, rows)
    known = spark.createDataFrame(labels[:200] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, known)
    got = {r.doc_id: r.kept for r in quality.score(docs, model).collect()}
    held = [(got[i], q == 1) for i, q in labels[200:]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    twice = quality.train(docs.unionByName(docs), known)  # repeated rows change nothing
    assert (twice.weights == model.weights).all() and (twice.slope, twice.offset) == (model.slope, model.offset)
    assert quality.train(docs, known.where("quality = 1")) is None and quality.train(docs, known.limit(0)) is None


# --- 9 substrings ---
def brute_substrings(rows):
    low = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings(docs, empty, batches):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digest(docs, batches).collect()}
    want = brute_substrings(corpus())
    assert got == want and sum(w[1] for w in want.values()) > 100
    assert substring.removal_digest(empty, batches).count() == 0


def test_substrings_texts_and_repeats(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (1, a), (None, a), (2, f"x\n{a} y"), (3, b), (3, b + " c"), (4, None)]
    out = substring.drop_repeated(docs_of(spark, rows))
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str) == sorted([(1, a), (1, a), (0, a), (2, "x y"), (3, b), (3, b + " c"), (4, None)], key=str)


def test_substrings_repeated_later_rows(spark):
    a = " ".join(f"a{i}" for i in range(20))
    out = substring.drop_repeated(docs_of(spark, [(1, a), (2, a), (2, a), (2, a + " z"), (3, f"{a} y")]), n_batches=3)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (2, ""), (2, ""), (2, "z"), (3, "y")]


def test_substring_blocks():
    rng = np.random.default_rng(4)
    who = np.stack([rng.integers(-5, 40, 3000), rng.integers(0, 2, 3000)], 1)
    pos = rng.integers(0, 1 << 18, 3000)
    for n in (1, 7):
        rows = [dict(zip(substring._ARROW.names, r)) for r in substring._by_block(who, pos, n)]
        assert len(rows) == len({r["bucket"] for r in rows}) <= n
        got_who, got_pos = substring._windows(rows)
        got = list(zip(map(tuple, got_who.tolist()), got_pos.tolist()))
        assert len(got) == len(set(got)) and set(got) == set(zip(map(tuple, who.tolist()), pos.tolist()))
    assert substring._by_block(who[:0], pos[:0], 3) == [] and len(substring._windows([])[1]) == 0


def test_substring_matches_need_hash_and_check():
    h, c = np.array([5, 5, 9], np.uint64), np.array([1, 3, 2], np.uint16)
    assert substring._in_run(h, c, np.array([5, 5, 9, 4], np.uint64), np.array([3, 2, 2, 1], np.uint16)).tolist() == [True, False, True, False]


def test_substring_index_stays_in_its_folder(spark, tmp_path):
    """Five calls, each with an index opened anew, give what one call over all documents gives; compaction runs between."""
    rows = [r for r in corpus() if r[1]]
    folder, parts = f"file://{tmp_path}/index", []
    docs = docs_of(spark, rows).selectExpr("doc_id", "xxhash64(text) as text_key", "text")
    bounds = [-1, 100, 200, 300, 400, 10**6]
    runs = []
    for a, b in zip(bounds, bounds[1:]):
        index = substring.FingerprintIndex(spark, folder, n_buckets=3, fanout=2)
        parts.append(index.add(docs.where(f"doc_id > {a} and doc_id <= {b}")).groupBy("bucket").applyInArrow(substring._by_document, substring._FOUND).collect())
        runs.append(index.runs())
    assert runs == [[(0, 0)], [(0, 0), (1, 1)], [(0, 1), (2, 2)], [(0, 2), (3, 3)], [(0, 3), (4, 4)]]
    found = {r.doc_id: bytes(r.stretches) for part in parts for r in part}
    for i, t in rows:
        n, gone, kept = substring.keep_words(t.encode(), found.get(i))
        assert (n, gone, hashlib.sha256(kept).hexdigest()) == brute_substrings(rows)[i]


def test_substring_index_goes_on_with_later_documents(spark, tmp_path):
    rows = sorted({i: (i, t) for i, t in corpus()}.values())
    folder, want = f"file://{tmp_path}/index", brute_substrings(rows)
    for part in (rows[:60], rows[60:61], rows[61:]):  # a later part repeats windows of the last batch of an earlier one
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digest(docs_of(spark, part), 2, folder).collect()}
        assert got == {i: want[i] for i, _ in part}


def test_substrings_of_repetitive_and_long_texts(spark):
    rows = [(1, "x " * 500), (2, "y " * 40 + "x " * 30 + "y " * 40), (3, "y " * 300), (4, " ".join(f"q{i % 29}" for i in range(4000))), (5, " ".join(f"q{i % 29}" for i in range(7, 3000)) + " end")]
    rows += [(6, "z" * 300_000 + " " + " ".join(f"q{i}" for i in range(29)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digest(docs_of(spark, rows), 2).collect()}
    assert got == brute_substrings(rows)


# --- 10 HTML ---
def test_html_on_held_out_layouts():
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("etaoinsrlm", k=rng.randint(2, 9))) for _ in range(200)) for _ in range(40)]
    trees = html_extract.fit(texts)
    good = 0
    for _ in range(150):
        html = html_extract.compose(rng, texts)
        page = html_extract.parse(html)
        want = html_extract.text_of(page, np.array([bool(re.search(r"(^|\s)keep(\s|$)", a)) for a in page.attributes]))
        good += html_extract.extract_batch([html.replace(" keep", "")], trees) == [want]
    assert good >= 132


S = "Heavy rain fell over the northern valleys on Tuesday, and the river rose by two metres before noon. Farmers moved their cattle to higher ground, while the town closed both bridges until further notice. "
#: Pages in layouts that no training page has: (html, main text).
BY_HAND = [
    (f"<table width=100%><tr><td class=leftcol><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td><td valign=top><h2>Flood in the valleys</h2><p>{S}<p>{S}</td></tr><tr><td colspan=2><font size=1>Copyright 1999 The Valley Post</font></td></tr></table>", f"Flood in the valleys {S}{S}"),
    (f'<div id="wrapper"><div class="navbar-top"><a href="/">Start</a> <a href="/a">Archive</a></div><div class="hentry"><h1>Flood</h1><div class="body-copy"><p>{S}</p><p>See the <a href="/m">map</a> of the valley. {S}</p></div></div><div class="widget-area"><h3>Related</h3><ul><li><a href="/1">Drought</a></li><li><a href="/2">Storm</a></li></ul></div></div>', f"Flood {S}See the map of the valley. {S}"),
    (f'<main><section><h1>Flood</h1><section><p>{S}</p></section><aside class="pullquote-box"><p>Advertisement</p></aside><section><h2>What now?</h2><p>{S}</p><blockquote>We have never seen this, said the mayor.</blockquote></section></section></main><footer><p>All rights reserved.</p></footer>', f"Flood {S}What now? {S}We have never seen this, said the mayor."),
    (f'<div role="dialog" class="cookie-consent-wall"><p>We use cookies. Accept all?</p><button>OK</button></div><div role="main"><h1>Flood</h1><p>{S}</p><p>{S}</p></div><ol class="commentlist"><li><p>First!</p></li><li><p>Thanks for this, stay safe.</p></li></ol>', f"Flood {S}{S}"),
    (f"<p>{S}</p><p>{S}</p><p>{S}</p>", f"{S}{S}{S}"),
    (f'<header><a href="/"><img src=logo.png></a><form action=/q><input name=q><button>Search</button></form></header><div class="story"><h1>Flood</h1><p>{S}</p><ul><li>Both bridges are closed until Friday.</li><li>The school stays shut this week.</li></ul><p>{S}</p><div class="share-bar"><a href=#>Share</a> <a href=#>Print</a></div></div><div id="footer-links"><a href=/i>Imprint</a> <a href=/p>Privacy</a></div>', f"Flood {S}Both bridges are closed until Friday. The school stays shut this week. {S}"),
    (f'<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p><p>{S}</p><p>&nbsp;</p><p>{S}</p></article><nav><a href=/>Home</a></nav>', f"Energy is E=m here. {S}{S}"),
]


#: Lists with links, bold titles, table layouts and bare bodies as main text.
STONES = "".join(f'<li><a href=/{i}>Stone {i}</a> is grey and old.</li>' for i in range(10))
STONES_TEXT = " ".join(f"Stone {i} is grey and old." for i in range(10))
LISTS_AND_TABLES = [
    (f"<main><h1>Ten stones</h1><ol>{STONES}</ol></main>", f"Ten stones {STONES_TEXT}"),
    (f"<article><h1>Ten stones</h1><p>{S}</p><ol>{STONES}</ol></article>", f"Ten stones {S} {STONES_TEXT}"),
    ("<p>a</p>","a"),
    (f"<b>Flood in the valleys</b><br><br>{S}<br><br>{S}", f"Flood in the valleys {S} {S}"),
    (f"<div><a href=/>Home</a> | <a href=/n>News</a></div><b>Flood in the valleys</b><br><br>{S}<br><br>{S}<hr><small>Copyright 2001 The Post</small>", f"Flood in the valleys {S} {S}"),
    (f'<body><nav><ul><li><a href=/>Home</a></li><li><a href=/w>World</a></li><li><a href=/c>Culture</a></li></ul></nav><main><h1>Flood</h1><p>{S}</p><table><tr><th>Bridge</th><th>State</th></tr><tr><td>North</td><td>closed</td></tr><tr><td>South</td><td>open</td></tr></table><p>{S}</p></main><footer>Imprint</footer>', f"Flood {S} Bridge State North closed South open {S}"),
    (f'<div class="page"><div class="masthead">The Post</div><div id="story"><h1>Flood</h1><p>{S}</p><p>What to read:</p><ul><li><a href=/1>The storm of 1953</a></li><li><a href=/2>How dams are built</a></li></ul><p>{S}</p></div><div class="comments"><h3>2 comments</h3><p>I was there.</p><p>So was I, it was bad.</p></div></div>', f"Flood {S} What to read: The storm of 1953 How dams are built {S}"),
    (f'<center><table><tr><td colspan=2><a href=/>The Valley Post</a></td></tr><tr><td><a href=/a>Local</a><p><a href=/b>Weather</a><p><a href=/c>Letters</a></td><td><b>Flood</b><br><br>{S}<br><br>{S}</td></tr><tr><td colspan=2>Copyright 1998</td></tr></table></center>', f"Flood {S} {S}"),
    (f'<section class="hero"><h1>Flood in the valleys</h1></section><section><p>{S}</p><p>{S}</p></section><section class="newsletter"><p>Get our letter every week</p><form><input><button>Go</button></form></section>', f"Flood in the valleys {S} {S}"),
    (f'<article><h2>Flood</h2><dl><dt>Where</dt><dd>The northern valleys</dd><dt>When</dt><dd>On Tuesday before noon</dd></dl><p>{S}</p></article><aside><h4>More</h4><ul><li><a href=/x>Storm</a></li></ul></aside>', f"Flood Where The northern valleys When On Tuesday before noon {S}"),
]


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(4)
    return html_extract.fit([" ".join("".join(rng.choices("etaoinsrlm", k=rng.randint(2, 9))) for _ in range(200)) for _ in range(60)])


@pytest.mark.parametrize("pages", [BY_HAND, LISTS_AND_TABLES], ids=["articles", "lists and tables"])
def test_html_on_pages_written_by_hand(trees, pages):
    hit = found = wanted = 0
    for (_, want), got in zip(pages, html_extract.extract_batch([h for h, _ in pages], trees)):
        got, want = Counter(got.split()), Counter(want.split())
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    assert hit >= 0.95 * wanted and hit >= 0.95 * found, (hit / wanted, hit / found)


def test_html_query_on_the_pages_table(spark):
    """The table's pages keep their main text in one article without boilerplate: a plain cut gives the same."""
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.QUERIES["op10_html_extraction"](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id] or "", re.S)
        blocks = re.sub(r"<(?!/?b>)[^>]*>", "\n\n", inner[1] if inner else "").replace("<b>", "").replace("</b>", "").split("\n\n")
        assert r.text == " ".join(w for b in blocks for w in unescape(b).split()) and r.n_chars == len(r.text)


def test_html_edges(spark, trees):
    page = "<p>a &amp; b&nbsp;c<br>d<b>e</b>f<!-- x --><script>var a = '<p>no</p>';</script><p>g < h <i>i</p><p>&nbsp;</p><li>j<li>k<table><tr><td>l<tr><td>m</table>1 < 2"
    parsed = html_extract.parse(page)
    assert html_extract.text_of(parsed, np.ones(len(parsed.tag), bool)) == "a & b c def g < h i j k l m 1 < 2"
    deep = "<div>" * 3000 + "<p>x" + "</div>" * 10
    parsed = html_extract.parse(deep)
    assert html_extract.text_of(parsed, np.ones(len(parsed.tag), bool)) == "x"
    schema = "page_id long, url string, html string, n_chars int, text string"
    pages = spark.createDataFrame([(1, "u", None, 5, "t"), (2, None, "", 6, "t"), (3, "u", deep, 7, None), (3, "u", deep, 7, None), (None, None, "<p>y", 1, "t")], schema)
    got = html_extract.extract(pages, trees).collect()
    assert [(r.page_id, r.n_chars == len(r.text)) for r in sorted(got, key=lambda r: r.page_id or 9)] == [(1, True), (2, True), (3, True), (3, True), (None, True)]
    assert {r.text for r in got if r.page_id and r.page_id < 3} == {""}
    assert html_extract.extract(pages.limit(0), html_extract.train(pages.limit(0))).count() == 0


@pytest.mark.parametrize("unit", ["<a ", "<a '>'", "<![CDATA[>", "<svg>", "<select>", "</b>", "<i>", "<i></b>", "<!x", "<div><p>", '<a href="x', "&amp;", "<tr><td>", "<script></script", "<title></title", "<select></select"])
def test_html_time_grows_with_length(unit):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.node_features(html_extract.parse("<b><div>" + unit * n))
        return time.process_time() - began

    seconds(2000)
    assert seconds(40_000) < 0.2 + 20 * max(seconds(4000), 0.01)


# --- registered queries, pipeline ---
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name]) == []


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as p

    start = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = start
    plain = None
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        rows = {r.doc_id: r.text for r in before.collect()}
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(rows)
            continue
        assert docs.columns == start.columns
        plain = {r.doc_id: r.text for r in docs.collect()}
        if name == "line_dedup":
            assert plain == brute_lines(list(rows.items()))
        elif name == "ngram_join":
            assert set(plain) == {i for i, (_, c) in brute_components(sorted(rows.items())).items() if i == c}
        elif name == "substring_dedup":
            want = brute_substrings(list(rows.items()))
            assert all(hashlib.sha256(" ".join(words_of(t)).encode()).hexdigest() == want[i][2] for i, t in plain.items())
        else:
            failed = {i for i, t in rows.items() if (n := brute_counts(t))[0] < 10 or 100 * n[4] > 20 * n[0]}
            assert set(plain) <= set(rows) - failed and all(rows[i] == t for i, t in plain.items())
    assert docs.count() > 0


def test_pipeline_computes_every_stage_once(spark, monkeypatch):
    import corpus_pipeline as p

    made = {}

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            made[name] = spark.sparkContext.accumulator(0)

            def count(batches, seen=made[name]):
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return out.mapInArrow(count, out.schema)

        return run

    monkeypatch.setattr(p, "STAGES", [(name, counted(name, stage)) for name, stage in p.STAGES])
    p.run(spark, DATA).write.format("noop").mode("overwrite").save()
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(made) == 5 and all(0 < a.value <= n for a in list(made.values())[:-1])


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, columns with clashing names."""
    import corpus_pipeline as p

    good = " ".join(f"word{i}" for i in range(60))
    lines = "\n".join(f"line {i} of some text here" for i in range(6))
    long_word = "z" * 120_000
    rows = [(1, good), (2, good + " more"), (2, good + " more"), (3, None), (None, good), (None, None), (4, ""), (5, lines), (6, lines + "\nlast"), (7, f"{long_word} {good}"), (8, "a b c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed_lines string, component_id string, kept string, _x int"
    clashing = ["_gone", "_gone_id", "_gone_key", "_found", "_found_id", "_found_key", "_n_removed_lines", "_doc_id", "_text_key", "_removed", "_stretches", "_Stretches_", "removed", "stretches", "text_key", "bucket"]
    schema += "".join(f", `{c}` int" for c in clashing)
    table = spark.createDataFrame([(i, t, None, None, None, "own", "c", "k", None, *range(len(clashing))) for i, t in rows], schema)
    want = {
        "quality_rules": [(1, good), (2, good + " more"), (2, good + " more"), (None, good), (7, f"{long_word} {good}")],
        "line_dedup": [(i, "last" if i == 6 else t) for i, t in rows],
        "ngram_join": [(i, t) for i, t in rows if i not in (2, 6, 7)],
        "substring_dedup": [(i, {2: "more", 6: "last", 7: long_word}.get(i, t)) for i, t in rows],
    }
    for name, stage in p.STAGES:
        if name == "packing":
            pieces = stage(spark, table, DATA).groupBy("doc_id").sum("length").collect()
            assert {r.doc_id for r in pieces} == {i for i, _ in rows}
            assert stage(spark, table.limit(0), DATA).count() == 0
            continue
        function = stage if name != "quality_rules" else (lambda spark, docs, sf_dir: p.quality.keep_good(docs, None))
        out = function(spark, table, DATA)
        assert out.columns == table.columns
        got = out.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want[name], key=str), name
        assert {(r.n_removed_lines, r.component_id, r.kept, *r[9:]) for r in got} == {("own", "c", "k", *range(len(clashing)))}
        assert function(spark, table.limit(0), DATA).count() == 0
