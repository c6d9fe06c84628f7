"""Long blanks, strings that confuse weak hashes, containment of short texts."""

import random

import pytest

from kmerloom.llm import packing, quality, queries
from kmerloom.llm import textvec as V
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# long blanks


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "a" + "\t" * 2_000_000 + "b", "\n" * 2_000_000 + "b", "a" + " " * 2_000_000, "a b" + " \n" * 40_000 + "\n<|endoftext|> c" + "　" * 40_000 + "\xa0d" + " " * 32_768 + "e " + " " * 32_767 + "f"])
def test_long_blanks_have_the_ids_of_tokenizers(text):
    json_, ranks = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")
    assert list(packing.encoder(json_, ranks)(text)) == packing.encoder(json_)(text)


def test_long_blanks_are_packed_and_judged(spark, tmp_path):
    folder = written(spark, tmp_path, ["a" + " " * 1_500_000 + "b", "some words\n" * 30 + "\t" * 1_200_000, " " * 1_100_000])
    pieces = queries.op1_packing(spark, folder).collect()
    assert sum(p.length for p in pieces if p.doc_id == 0) == 1_500_000 + 1 + 1 and {p.doc_id for p in pieces} == {0, 1, 2}
    judged = {r.doc_id: r for r in queries.op8_quality_rules(spark, folder).collect()}
    assert judged[0].n_words == 2 and judged[1].n_words == 60 and judged[2].n_words == 0 and not any(r.kept for r in judged.values())


def test_pieces_end_to_end_are_the_text():
    """The vocabulary without a json file too: cut at blanks, the ids are those of the whole where the engine can do the whole."""
    rng = random.Random(4)
    whole = packing.byte_bpe(queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    old = packing.LONG_BLANK, packing.BLANKS
    texts = ["".join(rng.choice(["a", "häuser", "1", "!", " ", "  ", "\n", "\t ", " " * 9, "\n" * 7, " " * 6]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = [list(whole(t)) for t in texts]
    try:
        import re

        packing.LONG_BLANK, packing.BLANKS = 1, re.compile(old[1].pattern.replace("32768", "4"))
        cut = packing.byte_bpe(queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
        assert [list(cut(t)) for t in texts] == want
    finally:
        packing.LONG_BLANK, packing.BLANKS = old


# strings that confuse polynomials modulo 2**64


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [256, 512, 1024, 2048, 4096])
def test_words_and_lines_that_repeat_their_complement(spark, tmp_path, n):
    a, b = thue_morse(n), thue_morse(n, "ba")
    filler = " ".join(f"w{i}" for i in range(25))
    folder = written(spark, tmp_path, [f"{a} x y", f"{b} x y", f"{a}\n{b}\n{a}", f"{a} {filler} x y z", f"{b} {filler} x y z"])
    joined = {r.doc_id: r.component_id for r in queries.op9_jaccard_join(spark, folder).collect()}
    assert joined[0] == 0 and joined[1] == 1
    judged = {r.doc_id: r for r in queries.op8_quality_rules(spark, folder).collect()}
    assert judged[2].n_dup_lines == 1 and judged[2].n_repeat_words == 0
    lines = {r.doc_id: r.n_removed for r in queries.op7_line_dedup(spark, folder).collect()}
    assert lines[3] == lines[4] == 0
    kept = {r.doc_id: tuple(r)[1:5] for r in queries.op10_suffix_dedup(spark, folder).collect()}
    assert kept == {d: v for d, v in brute.suffix_dedup([(0, f"{a} x y"), (1, f"{b} x y"), (2, f"{a}\n{b}\n{a}"), (3, f"{a} {filler} x y z"), (4, f"{b} {filler} x y z")]).items()}


def test_long_substrings_need_their_bytes():
    import numpy as np

    data = np.frombuffer(thue_morse(600).encode(), np.uint8)
    prefix = V.prefix_hash(data)
    at = np.array([0, 300]), np.array([256, 556])
    assert len(V.spans_hash(prefix, *at)) == 2
    with pytest.raises(ValueError, match="bytes"):
        V.spans_hash(prefix, np.array([0]), np.array([257]))


def test_entropy_is_a_share():
    import numpy as np

    assert quality.entropy_share(np.arange(1000)) == 1.0 and 0 <= quality.entropy_share(np.zeros(9, int)) < 1e-9


# containment


def test_containment_of_short_texts_in_long_ones(spark, tmp_path):
    rng = random.Random(7)
    texts, inside = [], []
    for i, n in enumerate([1, 2, 3, 5, 6, 6, 6, 8, 12, 20, 50, 120, 200] * 12):
        whole = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([300, 2_000, 20_000] if i % 13 == 0 else [300, 2_000]))]
        at = rng.randrange(len(whole) - n)
        texts += [" ".join(whole[at : at + n]), " ".join(whole)]
        inside.append((2 * i, n))
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, written(spark, tmp_path, texts)).collect()}
    known = [got[d].in_next for d, n in inside if n >= 5 and got[d].in_next is not None]
    assert min(known) == 1.0 and len(known) > 0.6 * sum(n >= 5 for _, n in inside)
    # texts that aren't contained are never said to be
    other = [got[d].in_next for d in range(1, len(texts) - 1, 2)]
    assert max(x for x in other if x is not None) < 0.05
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got.values())
