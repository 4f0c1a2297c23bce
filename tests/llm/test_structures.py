"""Periodic runs, neighbours and turn repair against brute force, on odd and on given tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, differences
from tidewire.llm import periodic, projections, queries, turns, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11 periodic runs ---
def brute_runs(s, least=12):
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def brute_tail(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def brute_digest(doc_id, text):
    w = brute_tail(doc_id, text)
    runs = brute_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repetitive_texts(n=250, seed=5):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        size = rng.choice([1, 5, 11, 12, 13, 24, 40, 150])
        w = [f"w{rng.randrange(rng.choice([1, 2, 3, 8, 200]))}" for _ in range(size)]
        if rng.random() < 0.6:
            a, p = rng.randrange(size), rng.randrange(1, 20)
            w = [x if i < a else w[a + (i - a) % min(p, size - a)] for i, x in enumerate(w)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    return texts + [None, "", " \t\n", "one", "é " * 40, "x" * 5000, "x " * 3000, " ".join("ab"[i.bit_count() % 2] for i in range(600))]


def test_maximal_runs_of_small_words():
    for n in range(1, 11):
        for s in itertools.product(range(2), repeat=n):
            assert sorted(zip(*(x.tolist() for x in periodic.maximal_runs(np.array(s))))) == brute_runs(s, 2)
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 80))]
        assert sorted(zip(*(x.tolist() for x in periodic.maximal_runs(np.array(s))))) == brute_runs(s, 2)


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(100):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        order, place, common = periodic.suffix_array(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        assert place[order].tolist() == list(range(len(s)))
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_runs_of_words_with_colliding_hashes():
    text = "a b " * 10 + "a c b c c a b d " * 3
    part = next(words.slices(pa.array([text])))
    want = brute_runs(text.split())
    for h in (None, np.zeros(len(text.split()), np.uint64)):
        assert list(zip(*(x.tolist() for x in periodic.runs_of(part, h)))) == want


def test_periodic_runs(spark):
    rows = [(i * 7, t, 1, "a", "b") for i, t in enumerate(repetitive_texts())]
    rows += [rows[3], rows[3], (None, "a b " * 20, 1, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, longest string, collapsed string").repartition(3)
    got = sorted((tuple(r) for r in periodic.run_digest(periodic.repeat_tails(docs)).collect()), key=str)
    assert got == sorted((brute_digest(r[0], r[1]) for r in rows), key=str)
    assert any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)
    assert periodic.run_digest(docs.limit(0)).count() == 0
    plain = {r.doc_id: r for r in periodic.detect_runs(docs).where("doc_id is not null").collect()}
    for i, t, *_ in rows:
        if i is not None:
            assert [tuple(x) for x in plain[i].runs] == brute_runs(WORD.findall(t or "")) and plain[i].n_words == len(WORD.findall(t or ""))


def test_periodic_query_on_the_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r.text or "") < 8000}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(got[i] == brute_digest(i, t) for i, t in rows.items()) and len(rows) > 100


@pytest.mark.parametrize("text", ["x " * 200_000, " ".join(str(i % 997) for i in range(200_000)), " ".join("ab"[i.bit_count() % 2] for i in range(200_000))], ids=["one", "997", "no cubes"])
def test_runs_of_very_long_texts(text):
    out = next(periodic._detect(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])]))).to_pylist()[0]
    w = text.split()
    for r in out["runs"][:50]:
        a, n, q = r["start"], r["length"], r["period"]
        assert n >= max(12, 2 * q) and all(w[i] == w[i + q] for i in range(a, a + n - q))
        assert (a == 0 or w[a - 1] != w[a - 1 + q]) and (a + n == len(w) or w[a + n] != w[a + n - q])
    if len(set(w)) in (1, 997):
        assert [tuple(r.values()) for r in out["runs"]] == [(0, len(w), len(set(w)))]


# --- 12 neighbours ---
def brute_neighbours(rows, k, every):
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            for i, y in good:
                if i != q and len(x) == len(y):
                    a, b = projections.scaled(np.array([x], float))[0], projections.scaled(np.array([y], float))[0]
                    s = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
                    out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, -2))
    return {q: sorted(((-s, i) for i, s in c.items()))[:k] for q, c in out.items()}


def test_chi_square():
    assert abs(projections.chi2_quantile(0.95, 8) - 15.507313) < 1e-5 and abs(projections.chi2_quantile(0.5, 2) - 1.386294) < 1e-5
    assert abs(projections.chi2_cdf(projections.chi2_quantile(0.97, 12), 12) - 0.97) < 1e-12


def test_neighbours_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 6)).astype(np.float32))]
    rows += [(300 + i, [0.5, 0.25, -1.0, 0.0, 2.0, 1.0]) for i in range(120)]  # a hot vector
    rows += [(500, [1.0] * 6), (501, [2.0] * 6), (502, [-1.0] * 6), (550, [1e38] * 6), (551, [1e-40] * 6), (600, None), (601, []), (650, [0.0] * 6), (651, [1.0, None] * 3)]
    rows += [(652, [float("nan")] * 6), (653, [float("inf")] * 6), (None, [1.0] * 6), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (750, [3.0]), (750, [1.0] * 6), (50, rows[50][1]), (7, rows[8][1])]
    frame = spark.createDataFrame([(i, v, "x", 1.0, 9) for i, v in rows], "vec_id long, embedding array<float>, id string, score double, rank int").repartition(3)
    found = projections.neighbours(frame, F.col("vec_id") % 50 == 0, k=5, certainty=0.9999, block=64, query_block=2).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute_neighbours(rows, 5, 50)
    assert set(got) == {q for q in want if want[q]}
    assert all(sorted(r.rank for r in found if r.query_id == q) == list(range(1, 1 + len(want[q]))) for q in got)
    for q, w in want.items():
        assert [i for _, i in got[q]] == [i for _, i in w] or np.allclose([s for s, _ in got[q]], [s for s, _ in w], atol=1e-12), q
    assert [i for _, i in got[300]] == [301, 302, 303, 304, 305] and [i for _, i in got[350]] == [300, 301, 302, 303, 304]
    assert projections.neighbours(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, folder):
    path = DATA.replace("sf0.001", folder)
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    cosine = x @ x.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))
    got = {}
    for r in queries.op12_neighbours(spark, path).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        best = [ids[j] for j in np.lexsort((ids, -cosine[at])) if j != at][:5]
        own = sorted(got[ids[at]])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and [s for *_, s in own] == sorted((s for *_, s in own), reverse=True)
        assert all(abs(s - cosine[at, np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, s in own)
        hits, total = hits + len({i for _, i, _ in own} & set(best)), total + 5
    assert hits >= 0.9 * total


def test_block_stops_early_where_neighbours_are_near():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((64, 32))
    x = centres[rng.integers(0, 64, 4096)] + 0.05 * rng.standard_normal((4096, 32))
    p = projections.unit(x) @ projections.directions(32, 8)
    block = projections.Block(np.arange(4096), x, p)
    for i in range(50):
        block.search(x[i], p[i], 6, -2.0, projections.chi2_quantile(0.97, 8))
    assert block.verified < 0.06 * 50 * 4096


# --- 13 turn repair ---
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAMES = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """conv_id -> the contract's columns, by trying every edit at every place."""
    of = {}
    for c, t, r, x in rows:
        own = of.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 and x is not None else x
        own += [] if h == 0 else [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    out = {}
    for c, own in of.items():
        own.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or "", q[2] is not None, hashlib.sha256((q[2] or "").encode()).hexdigest()))
        faults, seen = [], set()
        for _, r, x in own:
            y = (x or "").rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
            seen.add((r, x))
        initials = [(r or "")[:1] for _, r, _ in own]
        known = [t for t, _, _ in own if t is not None]
        later = {0: (0, "", ()), 1: (4, "II", ("user:", "assistant:")), 2: (2, "I", ("assistant:",)), 3: (0, "", ())}
        for (_, r, x), fault, initial in reversed(list(zip(own, faults, initials))):
            now = {}
            for s in range(4):
                options = [(3 + later[s][0], "D" + later[s][1], later[s][2])]
                if fault not in ("blank", "duplicate"):
                    forced = "a" if s == 2 else "u"
                    for letter, cost, kind, role in (("K", 0, initial, r), ("R", 2, forced, NAMES[forced])):
                        if (s, kind) in NEXT:
                            n, a, lines = later[NEXT[s, kind]]
                            options.append((n + cost + (fault == "truncated"), letter + a, (f"{role}:{x}", *lines)))
                now[s] = min(options)
            for _ in range(4):
                for s in range(4):
                    forced = "a" if s == 2 else "u"
                    n, a, lines = now[NEXT[s, forced]]
                    now[s] = min(now[s], (n + 2, "I" + a, (NAMES[forced] + ":", *lines)))
            later = now
        cost, audit, lines = later[0]
        out[c] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def odd_turns(seed=2):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "Assistant", ""]
    rows = []
    for c in [*range(150), None]:
        for t in range(rng.choice([1, 2, 3, 6, 9, 40])):
            text = rng.choice(["Hi there.", "what", "ok!", " ", "", None, "Yes?", "no. \n", "tail"]) if rng.random() < 0.5 else f"text {rng.random()}."
            rows.append((c, rng.choice([t, t, t, t, t + 1, None]), rng.choice(roles), text))
    rows += [(777, t, rng.choice(roles[:2]), rng.choice([f"q{t}.", f"q{t}", "same.", "long. " * 5000])) for t in range(400)]  # a hot conversation
    return rows + [(778, 4, "user", "again.")] * 500 + [(779, None, "user", "again.")] * 3


@pytest.mark.parametrize("block", [4096, 7])
def test_turn_repair(spark, block):
    rows = odd_turns()
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, text_key string, part int, block int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair_digest(frame, block).collect()}
    assert got == brute_repair(rows)
    assert turns.repair_digest(frame.limit(0), block).count() == 0


def test_turn_repair_where_no_row_is_left(spark):
    gone = [(c, t) for c in range(40) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    frame = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in gone], "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in turns.repair_digest(frame).collect()}
    assert got == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, _ in gone} and gone


def test_edits_of_the_operator(spark):
    rows = [(1, 1, "assistant", "Yes."), (1, 2, "user", "Why?"), (1, 3, "user", "Why"), (2, 1, "user", "Hm."), (2, 1, "user", "Hm."), (2, 2, "assistant", "Ah.")]
    edits, figures = turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    order = sorted(edits.collect(), key=lambda r: (r.conv_id, r.part, r.block, r.step))
    assert [(r.conv_id, r.edit, r.times, r.role, r.text) for r in order] == [
        (1, "I", 1, "user", ""), (1, "K", 1, "assistant", "Yes."), (1, "K", 1, "user", "Why?"), (1, "R", 1, "assistant", "Why"),
        (2, "K", 1, "user", "Hm."), (2, "D", 1, None, None), (2, "K", 1, "assistant", "Ah."),
    ]
    assert {r.conv_id: r.cost for r in figures.collect()} == {1: 5, 2: 3}


def test_query_equals_sql(spark, tmp_path):
    name = "op13_turn_repair"
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name]) == []
    odd = [r for r in odd_turns(9) if r[0] is None or r[0] < 60]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], str(tmp_path)) == []
