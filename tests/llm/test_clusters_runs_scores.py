"""Operators 11 to 13 against SQL, brute force and edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import centroid_clusters, lm_score, periodic_runs, queries
from tests.conftest import SF


def plain_clusters(rows, k=16, rounds=3, scale=64):
    """rows: (id, whole numbers); by Python's own arithmetic."""
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), centroid_clusters.wide_planes(v), v) for i, v in rows)
    means = [v for _, _, v in hashed[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(means)) for _, v in rows]
    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, n) in zip(rows, assign(), strict=True):
            own[n].append(v)
        means = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else m for n, m in enumerate(means)]
    return assign(), means


def test_clusters_equal_sql(same):
    assert same(queries.op11_centroid_clusters, queries.oracle_sql()["op11_centroid_clusters"]) > 0


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for size in (1, 2**5, 2**20, 2**25, 2**40, 2**61):
        v = np.floor(rng.uniform(-size, size, (20, 64)))
        v[0] = 0
        planes = [np.frombuffer(p, "<u8") for p in centroid_clusters.planes_of(v)]
        whole = [[int(x) for x in row] for row in v]
        assert [centroid_clusters.numbers_of(p.tobytes()) for p in planes] == whole
        assert [p.tobytes() for p in planes] == [centroid_clusters.wide_planes(row) for row in whole]
        for a, x in zip(planes, whole, strict=True):
            for b, y in zip(planes, whole, strict=True):
                assert int(centroid_clusters.dot(a[None], b)[0]) == sum(p * q for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("most", [0.5, 1e30])
def test_clusters_equal_brute_force(spark, most):
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 0.3, (9, 64))
    rows = [(i, (centers[rng.integers(9)] + rng.normal(0, 0.1, 64)).tolist()) for i in range(160)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (900, [most] + [0.0] * 63), (901, [-most] + [0.25] * 63), (902, [0.0] * 64)]
    bad = [(1000, None), (1001, [0.5] * 63), (1002, [0.5] * 63 + [None]), (1003, [float("nan")] * 64), (1004, [float("-inf")] * 64), (1005, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cluster", "distance", "id", "planes", "inertia", "k", "n")})
    got = centroid_clusters.centroid_clusters(df).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    found, means = plain_clusters(whole)
    by = Counter()
    for d, n in found:
        by[n] += d
    long = lambda x: min(x, 2**63 - 1)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    want = [(i, n, long(d), long(by[n]), long(sum(by.values())), digest[n]) for (i, _), (d, n) in zip(whole, found, strict=True)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_cluster_edges(spark):
    df = spark.createDataFrame([(3, [1.0] * 64), (4, [1.0] * 64), (5, [-1.0] * 64)], "vec_id long, embedding array<float>")
    rows = {r.vec_id: r for r in centroid_clusters.centroid_clusters(df).collect()}
    assert rows[3].cluster == rows[4].cluster != rows[5].cluster and {r.distance for r in rows.values()} == {0}
    assert centroid_clusters.centroid_clusters(df.limit(0)).count() == 0
    assert centroid_clusters.centroid_clusters(df.filter("vec_id = 5")).count() == 1
    far = spark.createDataFrame([(1, [1.7e308] * 64), (2, [-1.7e308, 0.5] + [0.0] * 62)], "vec_id long, embedding array<double>")
    assert [r.distance for r in centroid_clusters.centroid_clusters(far, k=1, rounds=0).orderBy("distance").collect()] == [0, 2**63 - 1]


def plain_runs(w):
    """Every period, every stretch; a period that a smaller one divides is no smallest period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and all(any(w[x] != w[x + d] for x in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(s, falling):
    t = [-v for v in s] if falling else s
    return [max(e - i for e in range(i + 1, len(t) + 1) if all(t[i:e] < t[k:e] for k in range(i + 1, e))) for i in range(len(t))]


def repetitive(rnd, most):
    s = []
    while len(s) < most:
        unit = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 7))]
        s += (unit * rnd.randint(1, 9))[: rnd.randint(1, 45)]
    return s


def test_grouping_gives_lyndon_arrays():
    rnd = random.Random(4)
    for _ in range(300):
        s = [rnd.randint(0, rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 16))]
        for falling in (False, True):
            lengths, word = periodic_runs.grouped(s, falling)
            assert lengths == plain_lyndon(s, falling)
            alike = {(tuple(s[i : i + n]), g) for i, (n, g) in enumerate(zip(lengths, word, strict=True))}
            assert len(alike) == len({w for w, _ in alike}) == len({g for _, g in alike})


def test_runs_equal_brute_force(monkeypatch):
    rnd = random.Random(9)
    for k in range(1500):
        s = repetitive(rnd, rnd.randint(0, 70)) + [f"n{i}" for i in range(rnd.choice([0, 9]))] + repetitive(rnd, rnd.choice([0, 20]))
        monkeypatch.setattr(periodic_runs, "PASSES", k % 3)
        assert periodic_runs.runs_of_words(s) == plain_runs(s), s


def plain_op12(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n < 1500 else None
    return words, runs


def test_runs_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seen = 0
    for r in queries.op12_periodic_runs(spark, SF).collect():
        words, runs = plain_op12(r.doc_id, texts[r.doc_id])
        if runs is None:
            runs = periodic_runs.runs_of_words(words)
        seen += len(runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert seen > 10


def test_run_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x " * 6), (4, "x " * 6), (5, "x " * 5), (None, "a b " * 4), (6, "w" * 100_000), (7, "a b a b " * 4), (8, "é é é é é é end"), (9, "a b a b a b a b b b b b b b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_words", "runs", "collapsed", "start", "__x")})
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()), key=lambda r: r[0])
    assert got == [(0, [(0, 8, 2)], "a b"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "x"), (4, [(0, 6, 1)], "x"), (5, [], "x x x x x"), (6, [], "w" * 100_000), (7, [(0, 8, 1)], "a b"), (8, [(0, 6, 1)], "é end"), (9, [(0, 8, 2), (7, 7, 1)], "a b")]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    best = spark.createDataFrame([([(0, 12, 3), (5, 8, 2), (9, 8, 2)],), ([],)], "runs array<struct<start:bigint,length:bigint,period:bigint>>").select(periodic_runs.greatest(F.col("runs")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in best] == [(0, 12, 3), None]


def test_runs_take_linear_time():
    rnd = random.Random(1)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 200_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    start = time.perf_counter()
    for w in (["a"] * 200_000, ["a", "b"] * 100_000, [str(i % 1000) for i in range(200_000)], [rnd.choice("ab") for _ in range(200_000)], list(fibonacci[-1])):
        periodic_runs.runs_of_words(w)
    assert time.perf_counter() - start < 60


def plain_ppm(training, order):
    """A scorer of texts over dictionaries, with escapes and exclusion written out."""
    counts = defaultdict(Counter)
    ends = lambda t: [lm_score.START] * order + list((t or "").encode()) + [lm_score.END]
    for t in training:
        s = ends(t)
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[tuple(s[i - j : i])][s[i]] += 1

    def score(t):
        s, total = ends(t), 0.0
        for i in range(order, len(s)):
            out: set = set()
            for j in range(order, -1, -1):
                own = {x: n for x, n in counts.get(tuple(s[i - j : i]), {}).items() if x not in out}
                if not own:
                    continue
                every = sum(own.values()) + len(own)
                if s[i] in own:
                    total += math.log10(own[s[i]] / every)
                    break
                total += math.log10(len(own) / every)
                out |= set(own)
            else:
                total -= math.log10(lm_score.SYMBOLS - len(out))
        return total

    return score


def plain_base(training):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(w for t in training for w in tokens(t))
    n, v = counts.total(), len(counts)
    return lambda t: (len(tokens(t)), sum(w in counts for w in tokens(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("options", [{}, {"order": 2, "chunk": 300}, {"order": 5, "chunk": 1}])
def test_scores_equal_brute_force(spark, monkeypatch, options):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["the", "The", "THEN", "é", "日本", "a b", "x" * 9, "of", "\n"]) for _ in range(rnd.randint(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "the lost one"), (None, "the lost one"), (7, rows[7][1]), (202, "zzz qqq \U0001f600")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "bucket", "number", "count", "id", "score", "held_out")})
    training = [t for i, t in rows if not held(i)]
    ppm, base = plain_ppm(training, options.get("order", lm_score.ORDER)), plain_base(training)
    want = sorted((-1 if i is None else i, held(i), *base(t), ppm(t)) for i, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.lm_score(df.repartition(3), **options).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_chances_of_a_context_sum_to_one(spark):
    """Over all symbols that can follow, seen and unseen."""
    order = 3
    number, n = np.unique(np.concatenate([np.concatenate(list(lm_score.contexts(t, order))) for t in (b"abracadabra", b"abrahadabra", b"bracket")]), return_counts=True)
    trie = lm_score.Trie(number, n, lm_score.shorter(number, n, order), order)
    for context in (b"abr", b"zab", b"zza", b"zzz", bytes([lm_score.START]) * 3):
        near = int.from_bytes(context[::-1], "big")
        symbols = np.array([near << 8 | s for s in range(256) if s != lm_score.START], np.uint64)
        assert (10 ** trie.log10(symbols)).sum() == pytest.approx(1)


def test_scores_of_long_texts_and_edges(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 7)
    data = bytes(random.Random(2).randbytes(100)).replace(b"\xfe", b"a").replace(b"\xff", b"b")
    pieces = np.concatenate(list(lm_score.contexts(data, 4)))
    monkeypatch.undo()
    assert pieces.tolist() == np.concatenate(list(lm_score.contexts(data, 4))).tolist() and len(pieces) == 101
    df = spark.createDataFrame([(1, "ab " * 300_000), (2, "ab")], "doc_id long, text string")
    rows = lm_score.lm_score(df).collect()
    assert len(rows) == 2 and all(r.score < 0 for r in rows)
    assert lm_score.lm_score(df.limit(0)).count() == 0
    alone = next(i for i in range(100) if held(i))
    row = lm_score.lm_score(spark.createDataFrame([(alone, "ab")], "doc_id long, text string")).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0)
    assert row.score == pytest.approx(-3 * math.log10(lm_score.SYMBOLS))


def test_held_out_documents_are_foretold_better_than_by_bytes_alone(spark):
    rows = queries.op13_lm_score(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    out = [r for r in rows if r.held_out]
    bits = -sum(r.score for r in out) / math.log10(2) / sum(len(texts[r.doc_id].encode()) for r in out)
    assert bits < 3.2
