"""Cases that the operators once cut short."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kmerloom.llm import fingerprints, jaccard_join, line_dedup, queries
from tests.conftest import same_rows
from tests.llm import brute
from tests.llm.test_operators import near_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], SCHEMA)


# line dedup


def test_long_lines_recur_from_two_documents_on(spark):
    """An exact long line goes from the second document on; a short one, or one with another number, stays."""
    long_ = " ".join(f"word{chr(97 + i)}" for i in range(19))
    texts = [f"{long_} end\nfirst own", f"second own\n{long_}  end", f"{long_}\nthird own", f"{long_}\nfourth own", f"{long_} 7\nfifth own", f"{long_} 8\nsixth own"]
    got = {r.doc_id: r for r in line_dedup.deduped(documents(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 1, 0, 0, 0, 0] and got[1].kept_text == "second own"
    staged = {r.doc_id: r.text for r in corpus_pipeline.line_templates(spark, documents(spark, texts), "").collect()}
    assert staged == {0: texts[0], 1: "second own", **{i: texts[i] for i in range(2, 6)}}


def test_variable_words_are_fields(spark, tmp_path):
    """Log-like lines whose fields are words: short ones, several fields, fields with a few frequent values; ties of documents. The SQL agrees."""
    rng = random.Random(3)
    own = lambda: "".join(rng.choices("bcdfghklmnprst", k=9))
    texts = []
    for i in range(60):
        lines = [f"Posted by {own()}", f"Posted by {own()} on the board {rng.choice(['sports', 'news', own()])} for all readers", f"{own()} {own()} {own()} {own()}", f"The {own()} {own()} {own()} {own()} the {own()}", f"Seen 1{i} times"]
        texts.append("\n".join(lines if i else lines + lines[:1]))
    texts += ["Posted by anyone of us", "Posted with care", "Posted by"]
    folder = tmp_path / "t"
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_line_dedup(spark, str(folder)).collect()}
    assert got[0].n_removed == 0 and all(got[i].kept_text.split("\n") == texts[i].split("\n")[2:4] for i in range(1, 60))
    assert all(got[i].n_removed == 0 for i in range(60, 63))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert same_rows(queries.op7_line_dedup(spark, str(folder)).toPandas(), con.sql(queries.SQL["op7_line_dedup"]).df())


# fingerprints


def test_short_texts_have_fingerprints_of_their_own(spark, tmp_path):
    texts = [f"{a} {b}" for a in ("one", "two", "three", "four") for b in ("red", "blue", "green", "white", "black") for _ in range(2)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, str(tmp_path)).collect()}
    assert len({r.fingerprint for r in got.values()}) == 21
    for i, t in enumerate(texts[:-2]):
        all_ = brute.sketch(t, 5, 1)
        assert got[i].fingerprint == f"{min(all_) + (1 << 31):08x}"
        assert i % 2 or got[i].near_next == 1.0
    assert got[40].near_edited == got[41].near_edited == got[40].near_next == 1.0 and got[39].near_next == got[41].near_next == 0.0


def test_sketches_with_the_least_hash_merge(spark):
    rows = [("a b c", "d e"), ("a b", " ".join(f"w{i}" for i in range(90))), ("", "x y"), ("", "")] + [(f"u{i}", f"v{i}") for i in range(30)]
    of = lambda c: fingerprints.sketch(c, least=True)
    given = spark.createDataFrame(rows, "a string, b string").select("a", "b", fingerprints.words(F.col("a")).alias("p"), fingerprints.words(F.col("b")).alias("q"))
    got = given.select("a", "b", of("p").alias("p"), of("q").alias("q")).select("*", fingerprints.merged(F.col("p"), F.col("q")).alias("m"))
    for r in got.collect():
        every = brute.sketch(r.a, 5, 1) | brute.sketch(r.b, 5, 1)
        assert r.m == sorted((brute.sketch(r.a, 5, 4) | brute.sketch(r.b, 5, 4)) or ({min(every)} if every else set()))


# Jaccard join


@pytest.mark.parametrize("block", [4096, 40])
def test_every_link_is_listed_and_counted_once(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_texts()
    given = spark.createDataFrame([*rows, rows[9], (None, rows[9][1])], "doc_id long, text string")
    classes = {}
    for d, t in rows:
        w = brute.WORD.findall((t or "").lower())
        classes.setdefault(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset(), []).append(d)
    same = {s: min(ids) for s, ids in classes.items() if s}
    want = {}
    for s, a in same.items():
        for o, b in same.items():
            if a < b and 100 * len(s & o) >= 90 * len(s | o):
                want[a, b] = len(s & o)
    got = jaccard_join.links(given).collect()
    assert len(got) == len(want) > 200 and {(r.a, r.b): r.n_common for r in got} == want
    by_id = {r.doc_id: r for r in jaccard_join.linked(given).collect()}
    for s, ids in classes.items():
        for d in ids:
            n = sum(min(ids) in pair for pair in want) if s else 0
            assert (by_id[d].n_links, by_id[d].n_copies) == (n, len(ids) + 2 * (9 in ids) if s else 1)
