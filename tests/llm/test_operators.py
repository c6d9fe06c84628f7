"""Each corpus operator against its SQL or a brute-force version."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import bilstm_crf, fingerprints, jaccard_join, langid, mixing, packing, pii, quality, queries, suffix_dedup
from kmerloom.llm import textvec as V
from kmerloom.llm.common import utf8_parts
from kmerloom.llm.components import components
from tests.conftest import same_rows
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
WORDS = [f"w{i}" for i in range(60)]


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    assert same_rows(queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.SQL[name]).df())


def odd_lines():
    rng = random.Random(4)
    lines = ["", "  ", "A b", "a  B ", "No. Yes! A line of nine words and some more here. Why? ", "Other.  a Line of nine words and  some more HERE.", "Two of a line. a line of nine words and some more here. And one! of a line that ends in other words", "Page 1 of 9", "Page 2 of 9", "one two three four five six seven eight nine", "one two three four five x seven eight nine", "tab\there"]
    return [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n")]


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op7_line_dedup"])
def test_odd_lines_equal_sql(spark, tmp_path, name):
    folder = tmp_path / "t"
    docs(spark, odd_lines()).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert same_rows(queries.QUERIES[name](spark, str(folder)).toPandas(), con.sql(queries.SQL[name]).df())


# packing


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 65, rng.integers(0, 60))
        bins, offsets = packing.first_fit_decreasing(lengths, 64)
        free = []
        for i in np.argsort(-lengths, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if at == len(free):
                free.append(64)
            assert (bins[i], offsets[i]) == (at, 64 - free[at])
            free[at] -= lengths[i]


@needs_data
def test_packing_is_a_round_trip(spark, corpus, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    special = ["<|endoftext|> x", "end of page <|endoftext|> next page", "<|endoftext|><|endoftext|>\n", "a<|endoftext|>b <|endoftext |> <|endoftex", "<|startoftext|>"]
    rows = texts + [(-1, None), (-2, ""), (-4, "é" * 5000)] + [(-10 - i, t) for i, t in enumerate(special)]
    files = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")
    got = packing.packed(docs(spark, rows), *files, group_docs=50).toPandas()
    assert 50256 in tokenizer.encode(special[1], add_special_tokens=False).ids
    assert [packing.encoder(files[0])(t) for t in special] == [packing.encoder(*files)(t) for t in special]
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = got[got.doc_id == d].sort_values("start")
        assert list(pieces.start) == list(np.cumsum([0, *pieces.length])[:-1]) and pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length)] == list(pieces.ids_crc32)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert list(sequence.offset) == list(np.cumsum([0, *sequence.length])[:-1]) and sequence.length.sum() <= 2048


# mixing


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 0)]
    leaves = spark.createDataFrame(rows, "d string, s string, leaf_tokens long")
    got = {(r.d, r.s): r.leaf_budget for r in mixing.budgeted(leaves, ["d", "s"], 800, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 390, ("b", "x"): 400, ("b", "y"): 0}
    got = {(r.d, r.s): r.leaf_budget for r in mixing.budgeted(leaves, ["d", "s"], 1900, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 890 + 10, ("b", "x"): 990, ("b", "y"): 0} or sum(got.values()) == 1900
    assert sum({(r.d, r.s): r.leaf_budget for r in mixing.budgeted(leaves, ["d", "s"], 4000, 2).collect()}.values()) == 4000


def test_epochs_and_prefixes(spark):
    rows = [(i, "x y z", "a" if i % 3 else "b") for i in range(300)]
    given = docs(spark, rows, "doc_id long, text string, s string")
    got = mixing.mixed(given, {"s": F.col("s")}, 1.5, F.when(F.col("s") == "b", 9).otherwise(1), max_epochs=4, block_docs=16).toPandas()
    assert got.copies.max() == 4 and 3 * got.copies.sum() <= 1350 and 3 * got.copies.sum() > 1350 - 6
    again = mixing.mixed(given, {"s": F.col("s")}, 1.5, F.when(F.col("s") == "b", 9).otherwise(1), max_epochs=4, block_docs=1000).toPandas()
    assert same_rows(got, again)


# fingerprints


@needs_data
def test_fingerprints(spark, texts):
    rows = texts[:60] + [(9001, None), (9002, ""), (9003, "one two"), (9004, "same text of a few words here"), (9005, "same text of a few words here")]
    rows = sorted(rows)
    got = {r.doc_id: r for r in fingerprints.compared(docs(spark, rows), least=False).collect()}
    assert len(got) == len(rows)
    written = lambda s: "".join(f"{h + (1 << 31):08x}" for h in sorted(s))
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        own, other, nxt = (brute.sketch(x, 5, fingerprints.SCALE) for x in (t, edited, after))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (written(own), written(other))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
        assert abs(r.near_edited - like(own, other)) < 1e-12 and abs(r.near_next - like(own, nxt)) < 1e-12
        assert abs(r.in_next - (len(own & nxt) / len(own) if own else 0.0)) < 1e-12


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(8)
    words = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(20000)]
    part, whole = " ".join(words[:4000]), " ".join(words)
    given = docs(spark, [(1, part), (2, whole), (3, " ".join(words[4000:]))]).select("doc_id", fingerprints.words(F.col("text")).alias("w")).select("doc_id", fingerprints.sketch("w", least=False).alias("s"))
    s = {r.doc_id: set(r.s) for r in given.collect()}
    a, b = given.where("doc_id = 1").select(F.col("s").alias("a")), given.where("doc_id = 2").select(F.col("s").alias("b"))
    row = a.join(b).select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert row.c == 1.0 and abs(row.l - 0.2) < 0.03 and len(s[2] - (s[1] | s[3])) <= 4


# language ID


def test_language_and_mixture(spark):
    rng = random.Random(3)
    own = {"aa": "kadobu lemino sarito".split(), "bb": "xyqwz vrghk jjtpl".split(), "cc": "oueau éêè çaïô".split()}
    write = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(i, write(lang, 60), lang) for i, lang in enumerate(rng.choices(list(own), k=400))] + [(1000, write("aa", 200) + " " + write("bb", 120), None)]
    got = langid.identified(docs(spark, rows, "doc_id long, text string, lang string")).toPandas().set_index("doc_id")
    held = [r for r in rows if r[2] and got.held_out[r[0]]]
    assert len(held) > 40 and all(got.lang_pred[d] == lang for d, _, lang in held)
    assert got.lang_pred[1000] == "aa" and got.n_langs[1000] == 2 and 0.5 < got.score[1000] < 0.8
    assert all(got.n_langs[d] == 1 for d, _, _ in held)
    assert [bool(x) for x in got.held_out.loc[[0, 1, 2]]] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in (0, 1, 2)]


@needs_data
def test_held_out_accuracy(corpus):
    got = langid.identified(corpus).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


# PII


def test_base_spans():
    rng = random.Random(1)
    for letters in ("ab@.-1 2+", "4-1 0+()", "1.25 "):
        for _ in range(20000):
            t = "".join(rng.choices(letters, k=rng.randint(0, 40)))
            assert pii.base_spans(t) == brute.base_spans(t, list(pii.KINDS), pii.luhn), t


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    t = bilstm_crf.Tagger(7, 3, allowed, np.array([True, True, False]), embed=4, hidden=3)
    t.p = {k: x.astype(np.float64) for k, x in t.p.items()}
    ids, mask = rng.integers(0, 7, (3, 6)), np.array([[1] * 6, [1] * 4 + [0] * 2, [1] * 2 + [0] * 4], float)
    tags = np.array([[0, 1, 2, 2, 1, 0], [1, 2, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]])
    _, grads = t.loss(ids, mask, tags)
    for name, x in t.p.items():
        flat = x.reshape(-1)
        for i in rng.choice(flat.size, min(10, flat.size), replace=False):
            was = flat[i]
            flat[i] = was + 1e-4
            up = t.loss(ids, mask, tags)[0]
            flat[i] = was - 1e-4
            down = t.loss(ids, mask, tags)[0]
            flat[i] = was
            assert abs((up - down) / 2e-4 - grads[name].reshape(-1)[i]) < 1e-3


def test_fast_scores_are_the_network_s():
    rng = np.random.default_rng(4)
    t = pii.trained()
    sizes = np.array([1, 7, 40, 40, 23])
    ids, mask = rng.integers(0, pii.N_CHARS, (5, 40)).astype(np.int32), (np.arange(40) < sizes[:, None]).astype(np.float32)
    e = t.p["emb"][ids]
    want = np.concatenate([t._run(d, e, mask, False)[0] for d in "fb"], 2) @ t.p["out"] + t.p["bias"]
    assert np.abs(t.scores(ids, mask) - want)[mask > 0].max() < 1e-3
    emit = rng.normal(0, 3, (300, 14, len(pii.TAGS))).astype(np.float32)
    emit[:, :, 0] += rng.choice([0, 6, 9], (300, 1))
    mask = np.arange(14) < rng.integers(1, 15, 300)[:, None]
    quiet, spoken = t.quiet(emit), t.viterbi(emit, mask).any(1)
    assert quiet.any() and spoken.any() and not (quiet & spoken).any() and (quiet | spoken).mean() > 0.7


def test_windows_are_reconciled():
    """Overlapping windows over a long text show the spans that one window over all of it shows; the heaviest ones without overlap stay."""
    tagger, parts = pii.trained(), pii.training(150, 5)
    text = "\n".join(t for t, _ in parts)
    ids = [pii.char_ids(text)]
    one = {s[:3] for s in pii.reconciled(pii.window_spans(tagger, ids, window=len(text), stride=len(text))[0])}
    many = {s[:3] for s in pii.reconciled(pii.window_spans(tagger, ids)[0])}
    assert len(one) > 80 and len(one ^ many) <= 0.05 * len(one)
    rng = random.Random(6)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6), rng.choice(pii.KINDS), rng.randint(1, 9) / 1.0) for a in rng.choices(range(12), k=rng.randint(0, 7))]
        apart = lambda sub: all(x[1] <= y[0] or y[1] <= x[0] for i, x in enumerate(sub) for y in sub[:i])
        most = max(sum(x[3] for x in sub) for m in range(1 << len(spans)) if apart(sub := [x for i, x in enumerate(spans) if m >> i & 1]))
        got = pii.reconciled(spans)
        assert apart(got) and sum(max(x[3] for x in spans if x[:3] == g) for g in got) == most


@needs_data
def test_disguised_spans_in_documents_are_found(texts):
    """Spans of unseen spellings, written into documents, are found whole; documents without any stay clean."""
    tagger, rng = pii.trained(), random.Random(12)
    clean = [t for _, t in texts if t]
    planted, want = [], []
    for held, spans in pii.training(400, 99):
        for a, b, kind in spans:
            host = rng.choice(clean)
            at = host.find(" ", rng.randrange(len(host)))
            if at >= 0 and not pii.base_spans(f" {held[a:b]} "):
                planted.append(f"{host[:at]} {held[a:b]} {host[at + 1:]}")
                want.append((at + 1, at + 1 + b - a, kind))
    got = pii.added_spans(tagger, planted, [[] for _ in planted])
    assert len(want) > 120 and sum(w in g for w, g in zip(want, got)) / len(want) >= 0.93
    spelled = [
        "contact bob.jones at mail dot com for more", "mail anna.b [at] site.org now", "phone 00 49 151 1234567 today", "please call (415) 555-1234 today", "reach me: jane_doe (at) company (dot) com",
        "the server at 10 dot 0 dot 0 dot 1 is down", "call five five five one two three four zero now", "john42 [at] host [dot] net", "dial 415.555.1234 or 0151 / 123 4567",
        "call 555-867-5309 tonight", "0151 23456789", "192[.]168[.]1[.]20 attacked", "sales {at} example {dot} org", "Tel: (089) 1234 5678", "06 12 34 56 78", "card 4111/1111/1111/1111",
    ]
    assert sum(bool(x) for x in pii.added_spans(tagger, spelled, [[] for _ in spelled])) >= 0.9 * len(spelled)
    odd = ["On 2024-01-02 at 10:30, v1.2.33 cost $12.50.", "License, Version 2.0.", "token 04dbebab91ab85687d33eeaaf9ac699e1188f962", "7,000 of 12 men", "Meet at one dot of the three."]
    assert pii.added_spans(tagger, odd, [[] for _ in odd]) == [[] for _ in odd]
    added = pii.added_spans(tagger, clean, [pii.base_spans(t) for t in clean])
    assert sum(map(bool, added)) <= 0.002 * len(clean)


def test_what_a_span_must_have():
    yes = [("a.b at c dot de", "email"), ("jo [at] x-y (dot) com", "email"), ("10 dot 0 dot 0 dot 1", "ip"), ("4111.1111/1111_1111", "card"), ("five five five 1 2 3 4", "phone"), ("(030) 12-34567", "phone")]
    no = [("dodoos doadodo", "email"), ("a at b", "email"), ("at b dot de", "email"), ("a at b at c dot de", "email"), ("a at b dot 5", "email"), ("1.2.3", "ip"), ("1.2.3.256", "ip"), ("4111111111111112", "card"), ("thing thing thing", "phone"), ("123456", "phone"), ("1234567 x", "phone"), ("", "email"), ("", "phone")]
    assert all(pii.holds(*x) for x in yes) and not any(pii.holds(*x) for x in no)


def test_training_learns_and_takes_hosts():
    """Training lowers the loss; stretches of hosts keep their base spans as labels, and all labels hold."""
    hosts = ("mail me now: ab@cd.org or at home " * 5, "plain words only " * 20)
    samples = pii.training(120, 3, hosts)
    assert all(pii.holds(t[a:b], k) for t, spans in samples for a, b, k in spans)
    assert any(t[a:b] == "ab@cd.org" for t, spans in samples for a, b, k in spans)
    tagger = pii.untrained()
    texts = [t[:60] for t, _ in samples]
    ids = np.zeros((len(texts), 60), np.int32)
    for i, t in enumerate(texts):
        ids[i, : len(t)] = pii.char_ids(t)
    losses = tagger.train(ids, (ids > 0).astype(np.float32), np.zeros(ids.shape, np.int64), 3)
    assert losses[-1] < losses[0]


@needs_data
def test_pii_query(spark, texts):
    got = {r.doc_id: r for r in pii.found(docs(spark, texts)).collect()}
    for d, t in texts:
        base = brute.base_spans(t, list(pii.KINDS), pii.luhn)
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(got[d].spans.split(","))
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]


# quality rules


def test_base_counts():
    rng = random.Random(1)
    rows = ["", "a", "\n\n", "é é é é é", "a b\na b\n"] + ["".join(rng.choices(["a", "b", "é", " ", "\n", "#", "\t"], k=rng.randint(0, 60))) for _ in range(2000)]
    got = quality.base_counts(*utf8_parts(pa.array(rows)))
    assert list(zip(*(x.tolist() for x in got.values()))) == [brute.counts(t) for t in rows]


def test_byte_fallback_share():
    share = quality.ByteFallback(queries.vocabulary("piece_bpe_32k.model"))
    for t in ["plain text\nwith lines", "éàü ß", "emoji 😀 and \U00013000", "\U00013000" * 30, "漢字 and かな", "a\x00b"]:
        ids = share.pieces.encode(t.translate(quality.TO_SPACES))
        assert share.share(t) == sum(share.pieces.is_byte(i) for i in ids) / max(1, len(ids))


@needs_data
def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.6


# joins and dedup


def near_texts():
    rng = random.Random(5)
    base = [rng.choices(WORDS, k=rng.randint(5, 80)) for _ in range(30)]
    rows = [(0, None), (1, ""), (2, "a"), (3, "A"), (4, "a b"), (5, "a b c"), (6, "A  B\nc")]
    for i in range(7, 500):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(WORDS)
        rows.append((i, " ".join(b + rng.choices(WORDS, k=rng.choice([0, 0, 2])))))
    clique = [w + str(rng.randrange(99)) for w in rng.choices(WORDS, k=60)]
    for i in range(500, 700):
        b = list(clique)
        for _ in range(rng.choice([1, 2])):
            b[rng.randrange(60)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(b)))
    return rows


@pytest.mark.parametrize("k,percent,block", [(3, 90, 4096), (3, 90, 40), (5, 80, 4096)])
def test_jaccard_join(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_texts()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs(spark, rows), k, percent).collect()} == brute.components(rows, k, percent)


@needs_data
def test_jaccard_join_on_the_corpus(corpus, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(corpus).collect()} == brute.components(texts, 3, 90)


def near_sets(rng, base, copies):
    sets = [np.unique(V.mix(rng.integers(0, 4000, rng.integers(20, 60)).astype(np.uint64))) for _ in range(base)]
    return sets + [np.unique(np.append(np.delete(s, rng.integers(0, len(s))), V.mix(rng.integers(0, 4000, 1).astype(np.uint64)))) for s in sets for _ in range(copies)]


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("cross", [False, True])
def test_signature_tree_keeps_all_links(percent, cross):
    """Of a unit of near and of unlike sets, reduced to a base or not, the tree keeps every linked pair, and links_of() finds just these."""
    rule, rng = jaccard_join.Rule(percent), np.random.default_rng(2)
    sets = near_sets(rng, 30, 6)
    n, own = np.array([len(s) for s in sets]), rng.integers(0, 2, len(sets)) if cross else np.zeros(len(sets), np.int64)
    unit = jaccard_join.Unit(np.arange(len(sets)), own, cross, 0, np.zeros(len(sets), np.int64), n, sets)
    want = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j) if (not cross or own[i] != own[j])}
    want = {p: c for p, c in want.items() if rule.linked(c, n[p[0]], n[p[1]])}
    kept = {tuple(sorted(p)) for c in jaccard_join.SignatureTree(unit, rule).candidates(50) for p in c.tolist()}
    assert len(want) > 50 and set(want) <= kept and len(kept) < len(sets) * (len(sets) - 1) / 8
    assert {tuple(sorted((g, o))): c for g, others, common in jaccard_join.links_of(unit, rule) for o, c in zip(others.tolist(), common.tolist())} == want


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    """Sets that differ as much as linked ones may, of all sizes, share a signature; at 90 % and more, sets that share half of their elements don't."""
    rule, rng = jaccard_join.Rule(percent), np.random.default_rng(percent)
    checked = apart = 0
    for size in [*range(1, 120), *rng.integers(120, 3000, 60).tolist()]:
        own = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64)
        for _ in range(4):
            most = size * (100 - percent) // percent
            gone = int(rng.integers(0, most + 1))
            other = np.append(own[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, most - gone + 1)), dtype=np.int64).astype(np.uint64))
            half = np.append(own[: size // 2], rng.integers(0, 1 << 63, size - size // 2, dtype=np.int64).astype(np.uint64))
            a, b, c = (np.unique(x) for x in (own, other, half))
            keys, owner = jaccard_join.signatures(np.concatenate([a, b, c]), np.cumsum([0, len(a), len(b), len(c)]), rule)
            common = len(np.intersect1d(a, b))
            if common < max(len(a), len(b)) and rule.linked(common, len(a), len(b)):
                checked += 1
                assert np.isin(keys[owner == 0], keys[owner == 1]).any(), (size, len(b), common)
            apart += size > 200 and not np.isin(keys[owner == 0], keys[owner == 2]).any()
    assert checked > 100 and (percent < 90 or apart > 100)


def passages():
    rng = random.Random(2)
    parts = ["".join(rng.choices("abcdé ", k=rng.randint(40, 300))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "x" * 350), (6, "ab" * 200), (7, "ab" * 30)]
    rows += [(i, "".join(rng.choice(parts)[rng.choice([0, 0, 3]) :] for _ in range(rng.randint(1, 6))) + rng.choice(["", "z", "é"])) for i in range(8, 400)]
    return rows + [(i, rows[50][1]) for i in range(400, 420)]


def test_suffix_dedup(spark):
    rows = passages()
    assert {r.doc_id: tuple(r[1:]) for r in suffix_dedup.deduped(docs(spark, rows)).collect()} == brute.suffix_dedup(rows)


@needs_data
def test_suffix_dedup_on_the_corpus(corpus, texts):
    assert {r.doc_id: tuple(r[1:]) for r in suffix_dedup.deduped(corpus).collect()} == brute.suffix_dedup(texts)


@pytest.mark.parametrize("chunk", [1, 500, 1 << 20])
def test_bucket_pointers_are_those_of_a_naive_suffix_array(chunk):
    """Suffixes stand in the order of a plain sort by group and rest of the run, but for those of a bucket, which share 100 bytes or are the only long one."""
    rng = random.Random(8)
    for letters, many in (("ab", 6), ("a", 3), ("abcdefgh", 12), ("\x00\xff", 5)):
        seed = "".join(rng.choices(letters, k=260))
        runs = [(seed[rng.randrange(90) :] if rng.random() < 0.7 else "".join(rng.choices(letters, k=300)))[: rng.randint(100, 250)].encode("latin-1") for _ in range(many)]
        group = np.sort(np.array([rng.randrange(3) for _ in runs]))
        length = np.array([len(r) for r in runs])
        begin, text = np.cumsum(length) - length, np.frombuffer(b"".join(runs), np.uint8)
        order, pointer = suffix_dedup.suffix_buckets(text, begin, length, group, chunk)
        rest = [(int(group[i]), r[j:]) for i, r in enumerate(runs) for j in range(len(r))]
        assert sorted(order.tolist()) == list(range(len(text)))
        cut = lambda p: (rest[p][0], rest[p][1][:100])
        members = {}
        for p in order.tolist():
            members.setdefault(int(pointer[p]), []).append(p)
        for own in members.values():
            long_ = [p for p in own if len(rest[p][1]) >= 100]
            assert len({cut(p) for p in long_}) <= 1 and (len(long_) < 2 or len({rest[p][0] for p in own}) == 1)
        windows = [p for p in order.tolist() if len(rest[p][1]) >= 100]
        assert [cut(p) for p in windows] == sorted(cut(p) for p in windows)
        seen, want = set(), set()
        for i, r in enumerate(runs):
            for j in range(len(r) - 99):
                key = (int(group[i]), r[j : j + 100])
                want |= {(i, j)} if key in seen else set()
                seen.add(key)
        run, window = suffix_dedup.repeated_windows(text, begin, length, group)
        assert set(zip(run.tolist(), window.tolist())) == want


def test_bucket_refinement_in_small_steps():
    """Whole groups at a time, however small the limit."""
    rows = passages()[:80]
    data, bounds = utf8_parts(pa.array([t for _, t in rows]))
    hashes, doc, start, stop = suffix_dedup.anchors(data, bounds)
    length = stop - start + 100
    text = np.concatenate([data[a : a + n] for a, n in zip(start, length)])
    row = (0, hashes.tobytes(), doc.astype(np.int64).tobytes(), doc.astype(np.int64).tobytes(), (start - bounds[doc]).tobytes(), length.astype(np.int32).tobytes(), text.tobytes(), False)
    for limit in (1, 5000, 1 << 30):
        cover = {i: set() for i in range(len(rows))}
        for batch in suffix_dedup.refined(iter([suffix_dedup.batch_of([row], suffix_dedup.RUNS)]), limit):
            for rid, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                for x, y in zip(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)):
                    cover[rid] |= set(range(x, y))
        assert {i: len(c) for i, c in cover.items()} == {i: x[1] for i, x in brute.suffix_dedup([(i, t) for i, (_, t) in enumerate(rows)]).items()}




def test_components(spark):
    """Chains, stars, loose pairs, loops and nulls; each id's component is the least id it reaches."""
    rng = random.Random(11)
    ids = rng.sample(range(-500, 100_000), 1500)
    links = [(ids[i], ids[i + 1]) for i in range(700)] + [(ids[701], x) for x in ids[702:900]] + [(rng.choice(ids[900:]), rng.choice(ids[900:])) for _ in range(250)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for p in links if p[0] != p[1] for x in p}
    got = components(docs(spark, [*links, links[0], (None, 5), (7, None)], "a long, b long")).collect()
    assert len(got) == len(want) and {r.id: r.component for r in got} == want
    assert components(docs(spark, [], "a long, b long")).count() == 0
