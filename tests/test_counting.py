"""Counting in the tasks against the search for tokens and against the join."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonequarry.functions import text as T
from tonequarry.operators import counting, tone

LETTERS = "ABZ-- \n1_.Äß́’中٣\U0001d400a"


def texts(n, seed=7):
    draw = random.Random(seed)
    return ["".join(draw.choices(LETTERS, k=draw.choice((0, 1, 3, 8, 30, 200)))) for _ in range(n)]


def found(text):
    letters = np.frombuffer((text + " ").encode(), np.uint8)
    starts, lengths = counting.token_places(letters)
    return [letters[s : s + n].tobytes().decode() for s, n in zip(starts, lengths)]


def test_token_places_are_those_of_the_search(spark):
    given = texts(4000) + ["", " ", "-", "AB", "A-", "ABC-DE1", "1ABC-DEF", "-ABC-", "AB-́", "AB́", "́AB", "ÁB-CD", "é-ABC"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    expected = {r.i: r.w for r in df.select("i", T.tokens(F.col("text")).alias("w")).collect()}
    wrong = [(t, found(t), expected[i]) for i, t in enumerate(given) if found(t) != expected[i]]
    assert not wrong, ascii(min(wrong, key=lambda w: len(w[0])))


def test_ascii_tokens_are_those_of_the_pattern():
    for t in texts(2000, 11):
        t = t.encode("ascii", "ignore").decode()
        assert found(t) == re.findall(T.TOKEN, t)


@pytest.mark.parametrize("block", [1, 64, 1 << 21])
def test_blocks_cut_no_token(monkeypatch, block):
    monkeypatch.setattr(counting, "BLOCK", block)
    words = ["ALPHA", "BETA", "LONG-WORD-OF-MANY-LETTERS", "TWELVELETTER", "THIRTEENLETTE"]
    known = counting.Dictionary([(w, False, False) for w in words])
    given = ["ALPHA BETA\nGAMMA", "", "X" * 9000 + " BETA", "LONG-WORD-OF-MANY-LETTERS TWELVELETTER THIRTEENLETTE TWELVELETTEX", "alpha ALPHA1 ALPHA"]
    got = np.zeros((len(given), len(words)), int)
    array = pa.array(["skipped ", *(g + " " for g in given)]).slice(1)  # a slice's buffers begin elsewhere
    for row, place in counting.known_tokens(array, known):
        np.add.at(got, (row, place), 1)
    assert got.tolist() == [[re.findall(T.TOKEN, g).count(w) for w in words] for g in given]


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_counts_of_both_ways(spark, monkeypatch, most):
    """In the task and by the join: repeated keys, repeated words, null flags, null and empty texts, words that are no token."""
    monkeypatch.setattr(counting, "MOST_WORDS", most)
    docs = spark.createDataFrame([(1, "loss Loss gain"), (1, "gain"), (2, ""), (3, None), (None, "loss"), (4, "other-words only")], "id int, body string")
    words = spark.createDataFrame([("LOSS", True, False), ("LOSS", False, None), ("GAIN", None, True), ("x y", True, True), (None, True, True), ("", True, True)], "word string, neg boolean, pos boolean")
    sums = sorted((tuple(r) for r in tone.word_counts(docs, words, "id", "body").collect()), key=str)
    assert sums == sorted([(1, 4, 2, 2), (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 1, 0), (4, 0, 0, 0)], key=str)
    terms = sorted((tuple(r) for r in tone.term_counts(docs, words, "id", "body").collect()), key=str)
    assert terms == sorted([(1, "LOSS", 2, True, False), (1, "GAIN", 2, False, True), (None, "LOSS", 1, True, False)], key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "LOSS")], "doc_id int, text string")
    words = spark.createDataFrame([("LOSS", True, False)], "word string, neg boolean, pos boolean")
    assert [tuple(r) for r in tone.word_counts(docs, words.where("false")).collect()] == [(1, 0, 0, 0)]
    assert tone.word_counts(docs.where("false"), words).collect() == [] == tone.term_counts(docs.where("false"), words).collect()
    assert tone.term_counts(docs, words.where("false")).collect() == []


def test_no_token_is_a_row_of_the_plan(spark):
    docs = spark.createDataFrame([(1, "LOSS")], "doc_id int, text string")
    words = spark.createDataFrame([("LOSS", True, False)], "word string, neg boolean, pos boolean")
    plan = tone.word_counts(docs, words)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["SCR2_section_tone", "TXT11_sizes", "TXT1_clean_text", "TXT1b_markup", "AGG18_weighted_sums"])
def test_workers_get_texts_in_small_batches(spark, name):
    from tonequarry.plans import queries

    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 512), "spark.sql.execution.arrow.maxBytesPerBatch": (1 << 28, 4 << 20)}
    for key, (large, _) in limits.items():
        spark.conf.set(key, str(large))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns
    assert all(int(spark.conf.get(key)) <= most for key, (_, most) in limits.items())
