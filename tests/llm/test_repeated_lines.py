"""op2: lines of several short sentences, against plain Python and against the SQL."""

import random

import duckdb

from kmerloom.llm import queries, substring_dedup
from tests.conftest import same_rows


def brute(rows, least=substring_dedup.LEAST_WORDS, line_least=substring_dedup.LINE_WORDS):
    """{doc_id: kept text}, each unit met in order."""
    sentences_seen, lines_seen, out = set(), set(), {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            parts, words = substring_dedup.sentences(line), substring_dedup.normalised(line).split()
            whole = len(parts) > 1 and len(words) >= line_least
            gone = whole and " ".join(words) in lines_seen
            if whole:
                lines_seen.add(" ".join(words))
            left = []
            for part in parts:
                key = substring_dedup.normalised(part)
                counts = len(key.split()) >= least
                if not (gone or counts and key in sentences_seen):
                    left.append(part)
                if counts:
                    sentences_seen.add(key)
            if left:
                kept.append("".join(left))
        out[doc_id] = "\n".join(kept)
    return out


def some_documents(n=120):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.choice([2, 4, 6, 8, 9, 12]))) + rng.choice([".", "!", "?", ""])
    lines = [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["", " ", "a. b. c. d. e. f. g. h. i. j. k. l. m. n. "]
    spelled = lambda x: rng.choice([x, x.upper(), x.replace(" ", "\t", 1), x + "  "])
    return [(i, "\n".join(spelled(rng.choice(lines)) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(1, 8)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_lines_of_short_sentences(spark, tmp_path):
    rows = some_documents()
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup.without_repeats(made).collect()}
    assert got == brute(rows)
    made.write.parquet(f"{tmp_path}/t/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/t/documents.parquet/*.parquet'")
    assert same_rows(queries.QUERIES["op2_substring_dedup"](spark, f"{tmp_path}/t").toPandas(), con.sql(queries.SQL["op2_substring_dedup"]).df())


def test_a_repeated_line_goes_with_its_short_sentences(spark):
    line = "It rains. We stay in. The cat sleeps. Nobody calls. Then the sun comes out."
    rows = [(1, f"first\n{line}\nend"), (2, f"{line.upper()} \nown words"), (3, "It rains. We stay in. But not for long.")]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "own words" and got[3].kept_text == rows[2][1]
    assert got[2].n_removed == len(substring_dedup.sentences(line + " ")) and got[2].chars_removed == len(line) + 1
