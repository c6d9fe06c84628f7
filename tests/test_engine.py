"""The k-mer engine against plain Python, on small and odd inputs."""

import random
import re

import pytest

from kmerloom.functions import dna
from kmerloom.operators import baselines, lookup, minimizers, sequences, statistics, validation
from kmerloom.operators.index import Index, build, relaid
from kmerloom.plans.config import OptionError, Options

FACTOR, MASK = dna.MURMUR_FACTOR, (1 << 64) - 1


def murmur(x: int, seed: int) -> int:
    x = x * FACTOR & MASK
    x = (x ^ x >> 47) * FACTOR & MASK
    h = ((seed ^ 8 * FACTOR & MASK) ^ x) * FACTOR & MASK
    h = (h ^ h >> 47) * FACTOR & MASK
    return h ^ h >> 47


def split(seq: str) -> list[tuple[int, str]]:
    return list(enumerate(re.split("[^ACGT]+", seq.upper().replace("U", "T"))))


def number(mm: str) -> int:
    return sum("ACGT".index(c) * 4 ** (len(mm) - 1 - i) for i, c in enumerate(mm))


def brute_runs(rows, k, m, seed=42):
    out = []
    for seq_id, seq in rows:
        for seg_id, seg in split(seq or ""):
            last = None
            for pos in range(len(seg) - k + 1):
                ap = min(range(pos, pos + k - m + 1), key=lambda i: (murmur(number(seg[i : i + m]), seed), i))
                if last and last[3] == ap:
                    last[6] += 1
                else:
                    last = [seq_id, seg_id, pos, ap, seg[ap : ap + m], ap - pos, 1]
                    out.append(last)
    return sorted(map(tuple, out))


def contigs(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, seq string")


def some_rows(seed=1, n=40, letters="ACGTacgtuN-é"):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices(letters, [9] * 4 + [2] * 5 + [1] * 3, k=rng.randint(0, 90)))) for i in range(n)]
    return rows + [(100, None), (101, ""), (102, "A" * 40), (103, "ACGTACGTTGCATGCC"), (104, "GATTACANNGATTACA"), (105, "ACGT"), (106, "NNACGTANACG"), (107, rows[3][1]), (108, "ACGTANACGTACG")]


@pytest.mark.parametrize("k,m", [(5, 3), (7, 7), (11, 4), (31, 15)])
def test_super_kmers(spark, k, m):
    rows = some_rows()
    got = sequences.super_kmers(contigs(spark, rows), Options(k=k, m=m)).drop("bases").collect()
    assert sorted(map(tuple, got)) == brute_runs(rows, k, m)


@pytest.mark.parametrize("tile", [1, 3, 10, 1000])
def test_tiles_change_nothing(spark, tile):
    rows, o = some_rows(8, 20), Options(k=7, m=3)
    whole = sequences.super_kmers(contigs(spark, rows), o).collect()
    assert sorted(map(tuple, sequences.super_kmers(contigs(spark, rows), o, tile).collect())) == sorted(map(tuple, whole))


def test_segments_and_kmers(spark):
    rows, k = some_rows(2), 5
    want = sorted((i, g, s) for i, seq in rows for g, s in split(seq or "") if len(s) >= k)
    assert sorted((r.seq_id, r.seg_id, r.seg) for r in sequences.segments(contigs(spark, rows), k).collect()) == want
    got = sequences.kmers(contigs(spark, rows), k).collect()
    assert sorted(map(tuple, got)) == sorted((i, g, p, s[p : p + k]) for i, g, s in want for p in range(len(s) - k + 1))
    assert {r.seq_id: r.n_kmers for r in sequences.kmer_counts(contigs(spark, rows), k).collect()} == {i: sum(len(s) - k + 1 for j, _, s in want if j == i) for i, _, _ in want}


def test_invariants(spark):
    o = Options(k=9, m=4)
    for r in sequences.super_kmers(contigs(spark, some_rows(3)), o).collect():
        assert 1 <= r["size"] <= o.window and 0 <= r.p1 <= o.k - o.m and r["size"] <= r.p1 + 1 and len(r.bases) == r["size"] + o.k - 1


@pytest.mark.parametrize("k,m,layout", [(5, 3, "partitioned"), (5, 3, "unpartitioned"), (5, 5, "partitioned"), (11, 6, "partitioned"), (31, 15, "unpartitioned")])
def test_index_is_minimal_and_perfect(spark, k, m, layout):
    given = contigs(spark, some_rows(4))
    index = build(given, Options(k=k, m=m, layout=layout))
    coded = lookup.by_super_kmer(given, index, keep_kmer=True).collect()
    codes = {r.kmer: r.hval for r in coded}
    assert sorted(codes.values()) == list(range(index.n_kmers)) and len({(r.kmer, r.hval) for r in coded}) == len(codes)
    assert set(map(tuple, lookup.by_kmer(given, index).collect())) == {(r.seq_id, r.seg_id, r.pos, r.hval) for r in coded}
    assert set(validation.report(given, index).first()) == {0}


def test_canonical_strands_share_minimizers(spark):
    o = Options(k=9, m=4, canonical=True)
    seq = "ACGTTGCAAGCTTACGGATCCA"
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = ({r.minimizer for r in sequences.super_kmers(contigs(spark, [(1, s)]), o).collect()} for s in (seq, back))
    assert a == b
    index = build(contigs(spark, [(1, seq), (2, back)]), o)
    assert set(validation.report(contigs(spark, [(1, seq), (2, back)]), index).first()) == {0}


def test_empty_input(spark):
    given = contigs(spark, [(1, "ACG"), (2, None)])
    index = build(given, Options(k=5, m=3))
    assert (index.n_main, index.n_kmers) == (0, 0) and lookup.by_super_kmer(given, index).count() == 0
    assert set(validation.report(given, index).first()) == {0}


def test_defects_are_seen(spark):
    given = contigs(spark, [(1, "ACGTTGCAAGCTTACG")])
    index = build(given, Options(k=5, m=3))
    wrong = Index(index.options, index.minimizers.selectExpr("minimizer", "mm_rank", "n", "cls", "p1", "size", "base + 1 as base", "sign"), index.fallback, index.n_main, index.n_kmers)
    assert sum(validation.report(given, wrong).first()) > 0


def test_layouts_saving_and_aliens(spark, tmp_path):
    given = contigs(spark, some_rows(5))
    index = build(given, Options(k=7, m=4))
    other = relaid(index, "unpartitioned")
    assert set(validation.report(given, other).first()) == {0}
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert again.options == index.options and (again.n_main, again.n_kmers) == (index.n_main, index.n_kmers)
    assert set(map(tuple, lookup.by_kmer(given, again).collect())) == set(map(tuple, lookup.by_kmer(given, index).collect()))
    alien = contigs(spark, [(1, "TTTTTTTTTTGGGGGGGGGGCACACACACATATATATA" + some_rows(5)[0][1])])
    known = {r.kmer for r in sequences.kmers(given, 7).collect()}
    found = {(r.seg_id, r.pos): r.hval for r in lookup.strict(alien, index, sequences.kmers(given, 7)).collect()}
    for r in sequences.kmers(alien, 7).collect():
        assert (found[r.seg_id, r.pos] is not None) == (r.kmer in known)
    n = lookup.counted(given, index).first()
    assert n.n_kmers == n.n_found == sequences.kmers(given, 7).count() and lookup.counted(given, index, one_by_one=True).first() == n


def test_baselines(spark):
    kmers = sequences.kmers(contigs(spark, some_rows(6)), 6)
    n = kmers.select("kmer").distinct().count()
    for made in (baselines.by_rank(kmers), baselines.by_levels(kmers, 1.0, 3), baselines.by_levels(kmers, 2.0)):
        assert sorted(r.hval for r in made.collect()) == list(range(n))


def test_statistics(spark):
    given, o = contigs(spark, some_rows(7)), Options(k=7, m=4)
    runs = sequences.super_kmers(given, o)
    row = statistics.build_statistics(given, runs, o).first()
    assert row.n_kmers == sequences.kmers(given, 7).count() and row.eps_theory == 2 / 5 and row.eps_true == row.n_super_kmers / row.n_kmers
    index = build(given, o)
    assert sum(r.n_minimizers for r in statistics.class_counts(index).collect()) == row.n_minimizers == minimizers.classified(runs).count()
    assert abs(sum(r.percent for r in statistics.class_counts(index).collect() if r.cls != "COLLISION") - 100) < 1e-9
    for i in (index, relaid(index, "unpartitioned")):
        assert all(r.bits >= 0 for r in statistics.space_model(i).collect())
    pairs = statistics.locality(lookup.by_super_kmer(given, index)).first()
    assert 0 < pairs.n_adjacent <= pairs.n_pairs and 0 <= statistics.fallback_share(index) <= 1


@pytest.mark.parametrize("bad", [{"k": 64}, {"k": 0}, {"k": 5, "m": 6}, {"k": 40, "m": 32}, {"layout": "other"}, {"hasher": "none"}])
def test_options_are_checked(bad):
    with pytest.raises(OptionError):
        Options(**{"k": 31, "m": 15} | bad)
