"""Periodic runs, exact top-k search and the filter audit against brute force."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest

from kmerloom.llm import filter_audit, periodic_runs, queries, topk_search
from tests.conftest import same_rows
from tests.llm import brute


# periodic runs


def all_runs(ids):
    """By the definition: every period, every maximal stretch, no smaller period."""
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(all(ids[x] == ids[x + r] for x in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n):
    letters, out = rng.choice([1, 2, 3, 5, 50]), []
    while len(out) < n:
        if rng.random() < 0.5:
            p = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([2, 5, 12, max(2, n // 5)])))]
            out += (p * 9)[: rng.randint(1, len(p) * 8)]
        elif out and rng.random() < 0.4:
            out += out[-rng.randint(1, len(out)) :]
        else:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
    return out[:n]


@pytest.mark.parametrize(("times", "most"), [(1500, 120), (25, 1200)])
def test_runs_equal_brute_force(times, most):
    rng, n_found = random.Random(most), 0
    for _ in range(times):
        words = periodic(rng, rng.randint(0, most))
        want = all_runs(words)
        assert periodic_runs.runs(periodic_runs.numbered([b"%d" % w for w in words])) == want
        n_found += len(want)
    assert n_found > 100


def test_long_runs_of_every_scale():
    rng = np.random.default_rng(5)
    for q in (1, 2, 3, 16, 17, 63, 64, 1000, 4096):
        one = rng.integers(0, 10**6, q) + 10 * (q > 1)
        ids = np.concatenate([np.arange(50) + 2 * 10**6, np.resize(one, 4 * q + 7), np.arange(60) + 3 * 10**6]).astype(np.int32)
        assert periodic_runs.runs(ids) == [(50, 4 * q + 7, q)]


def described(doc_id, text):
    words = brute.WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        words = [words[i] if i < a else words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
    every = all_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in every)]
    best = min(every, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(every), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in every)), sha(" ".join(kept)))


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(f"wört{w}" for w in periodic(rng, rng.randint(0, 90)))) for i in range(250)]
    rows += [(None, "a a a a a a b"), (900, None), (901, ""), (-20, "x " * 50), (-20, "x " * 50), (903, "a\x85a\x85a\xa0b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((described(*r) for r in rows), key=repr)


# top-k search


def best_of(rows, k=20):
    whole = []
    for v, x in rows:
        if x is not None and not any(c is None or not np.isfinite(c) for c in x):
            whole.append((v, [int(np.floor(64 * float(np.float32(c)))) for c in x]))
    out = []
    for i, (q, x) in enumerate(whole):
        if q is not None and q % 20 == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y)))), v is None, v) for j, (v, y) in enumerate(whole) if j != i]
            out += [(q, rank + 1, v, -s) for rank, (s, _, v) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return out


def searched(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in queries.op12_topk_search(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("block", [8192, 37])
def test_topk_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "CHUNK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 24))
    rows = [(i, [float(c) for c in centres[i % 9] * rng.choice([1, 1, 3]) + rng.normal(size=24) * 0.2]) for i in range(700)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # ties
    got = searched(spark, tmp_path, rows)
    assert sorted(got) == sorted(best_of(rows)) and len(got) == 20 * 38


def test_topk_of_odd_vectors(spark, tmp_path):
    """Nulls, non-finite and very large components, repeated ids, no id, other lengths; fewer than k candidates."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1e30, -1e30]), (120, [3e9, 3e9]), (None, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0]), (7, []), (-20, [1.0, 2.0, 3.0]), (9, [1.0, 2.0])]
    got = searched(spark, tmp_path, rows)
    assert sorted(got, key=repr) == sorted(best_of(rows), key=repr)
    empty = tmp_path / "empty"
    assert searched(spark, empty, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(8)
    q, v = np.floor(rng.normal(size=(40, 30)) * 20), np.floor(rng.normal(size=(50, 30)) * 20)
    exact = q @ v.T
    last = np.full(exact.shape, np.inf)
    for n in topk_search.levels(30):
        bound = topk_search.statistics(q, n) @ topk_search.statistics(v, n).T
        assert (bound >= exact - 1e-6).all()
        last = np.minimum(last, bound)
    assert last.mean() < 0.9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)).mean()


# filter audit


def audit(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    facts = []
    for d, t, lang in docs:
        t, w = t or "", brute.WORD.findall(t or "")
        fails = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > least[t])) if bad}
        facts.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        mine, total = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [f for f in mine if x in f[1] and not f[1] & before]
                total[x] += len(gone)
                kept = sum(not f[1] & (before | {x}) for f in mine)
                out[part, order, k + 1] = [kept, len(gone), sum(x in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                out[part, order, k + 1].append(total[x])
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("audit"), random.Random(6)
    text = lambda: " ".join(rng.choice(["some", "Word", "MANY", "ärger", "#", "|x", f"w{rng.randrange(500)}", f"v{rng.randrange(500)}", f"u{rng.randrange(500)}"]) for _ in range(rng.choice([0, 5, 99, 100, 140])))
    plain = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([99, 100, 160])))
    some = [text() if rng.random() < 0.4 else plain() for _ in range(150)]
    docs = [(i, rng.choice(some[:60] if rng.random() < 0.5 else some), rng.choice(["en", "de", "", None])) for i in range(600)]
    docs += [(None, some[0], "en"), (None, "own text", "en"), (700, None, "fr"), (701, "", None), (5, some[1], "en"), docs[7], (703, "x\x85y " * 120, "en")]
    labels = [(rng.choice([None, *range(650)]), rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for _ in range(500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, labels


def test_audit_equals_brute_force(spark, audited):
    folder, docs, labels = audited
    got = sorted(tuple(r) for r in queries.op13_filter_audit(spark, folder).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    assert got == audit(docs, labels) and len(got) == 600 * 4


def test_audit_equals_sql(spark, audited):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{audited[0]}/{t}.parquet/*.parquet'")
    assert same_rows(queries.op13_filter_audit(spark, audited[0]).toPandas(), con.sql(filter_audit.SQL).df())


def test_audit_adds_up_over_many_parts(spark, audited, monkeypatch):
    """Counts given out in between, and batches of few documents, give the same sums."""
    folder, docs, labels = audited
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = queries.op13_filter_audit(spark, folder).where("filter_order = 'BADEC'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [r for r in audit(docs, labels) if r[1] == "BADEC"]
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got) == want
