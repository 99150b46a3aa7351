"""Dictionary tone: word counts, term frequencies, proportional and tf-idf scores.

The sparse matrix of documents by words is a long relation ``(doc_id, scope, word, tf)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.functions.columns import percent
from tonequarry.functions.text import tokens
from tonequarry.operators import counting


def dictionary(words: DataFrame, rule: str = "nonzero") -> DataFrame:
    """``(word, neg, pos)`` from signed year flags: any flag, also of a word removed later, or only present ones."""
    if rule not in {"nonzero", "positive"}:
        raise ValueError(rule)
    flag = (lambda c: F.col(c) != 0) if rule == "nonzero" else (lambda c: F.col(c) > 0)
    # A word that stands twice is listed if any of its rows says so.
    return words.groupBy(F.upper("word").alias("word")).agg(F.bool_or(flag("negative")).alias("neg"), F.bool_or(flag("positive")).alias("pos"))


def _each(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``(key, word, neg, pos)`` of each token that is in the dictionary, by a join: for dictionaries beyond ``counting``'s bounds."""
    each = docs.select(key, F.explode(tokens(F.upper(F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    flags = (F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("neg", "pos"))
    return each.join(words.groupBy("word").agg(*flags), "word")


def term_counts(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, word, tf, neg, pos)`` of dictionary words: counted within each task before the shuffle.

    Rows of one key are one document. A word that stands twice in ``words`` counts once, with the flags of both rows; a
    null flag is false.
    """
    known = counting.loaded(words)
    if known is None:
        each = _each(docs, key, text, words).withColumn("tf", F.lit(1).cast("long"))
    else:
        each = counting.terms(docs, known, key, text).withColumnRenamed("key", key)
    return each.groupBy(key, "word").agg(F.sum("tf").alias("tf"), F.bool_or("neg").alias("neg"), F.bool_or("pos").alias("pos"))


def word_counts(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_neg, n_pos)`` of every document: tokens in the dictionary and those of its lists.

    One grouping by document of one row a text; documents without a known token have zeros. Keys, repeated words and
    null flags as in ``term_counts``.
    """
    known = counting.loaded(words)
    if known is None:
        found = _each(docs, key, text, words).select(key, F.lit(1).alias("n"), F.col("neg").cast("int").alias("neg"), F.col("pos").cast("int").alias("pos"))
        every = found.unionByName(docs.select(key, *(F.lit(0).alias(c) for c in ("n", "neg", "pos"))))
    else:
        every = counting.sums(docs, known, key, text).withColumnRenamed("key", key)
    return every.groupBy(key).agg(*(F.sum(c).alias(n) for c, n in (("n", "n_words"), ("neg", "n_neg"), ("pos", "n_pos"))))


def proportional(counts: DataFrame) -> DataFrame:
    """Shares of listed words in percent; null without words."""
    return counts.select("*", percent(F.col("n_neg"), F.col("n_words")).alias("neg_pct"), percent(F.col("n_pos"), F.col("n_words")).alias("pos_pct"))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("word").agg(F.count("*").alias("df"))


def weighted_sums(terms: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, w)``: the sum of (1 + ln tf) * ln(N / df) over each document's terms; zero without any.

    N and df come from the whole corpus: N is the number of rows of ``docs``, also of empty documents.
    """
    n = docs.agg(F.count("*").alias("N"))
    idf = document_frequency(terms).crossJoin(F.broadcast(n)).select("word", F.log(F.col("N") / F.col("df")).alias("idf"))
    weighted = terms.join(idf, "word").select(key, ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    sums = weighted.groupBy(key).agg(F.sum("w").alias("w"))
    return docs.select(key).join(sums, key, "left").select(key, F.coalesce("w", F.lit(0.0)).alias("w"))


def tfidf(terms: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, tfidf)``: ``weighted_sums`` over 1 + ln max(n_words, 1); N is the number of rows of ``counts``."""
    sums = weighted_sums(terms, counts.select(key), key)
    norm = 1 + F.log(F.greatest("n_words", F.lit(1)).cast("double"))
    return counts.select(key, norm.alias("norm")).join(sums, key).select(key, (F.col("w") / F.col("norm")).alias("tfidf"))


def published_scores(counts: DataFrame) -> DataFrame:
    """Scores from published counts; positive words are also taken net of negated ones, twice."""
    n = F.col("n_words")
    return counts.select("*", percent(F.col("n_negative"), n).alias("neg_pct"), percent(F.col("n_positive"), n).alias("pos_pct"), percent(F.col("n_positive") - 2 * F.col("n_negation"), n).alias("net_pos_pct"))
