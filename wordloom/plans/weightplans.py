"""Weighting plans: term statistics, idf variants, TF-IDF and count matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import weights as W
from .corpus import NEW, two_sided
from .similar import is_old, n_old_docs, side_counts, tfidf_weights


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, side, term, n) over the letters-only, lower-cased word lists."""
    docs = two_sided(spark, sf_dir)
    return W.term_counts(docs.select("doc_id", "side", T.word_list("text").alias("tokens")),
                         keep=("side",))


def tf_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, sublinear and augmented tf of every (document, term)."""
    c = W.with_tf(word_counts(spark, sf_dir).drop("side"), "augmented").withColumnRenamed("tf", "tf_aug")
    return c.select("doc_id", "term", "n", F.round(F.lit(1.0) + F.log("n"), 6).alias("tf_sublinear"),
                    F.round("tf_aug", 6).alias("tf_augmented"))


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idf of the old side with floor (integer) division and real division, plus the minimum."""
    counts = word_counts(spark, sf_dir)
    n_old = n_old_docs(spark, sf_dir)
    df = W.document_frequency(counts, where=is_old())
    out = df.select("term", "df", F.round(W.idf_expr(n_old, F.col("df"), "floor"), 6).alias("idf_floor"),
                    F.round(W.idf_expr(n_old, F.col("df"), "real"), 6).alias("idf_real"))
    min_floor = out.select(F.min("idf_floor")).scalar()
    return out.withColumn("min_idf_floor", min_floor)


def tfidf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2-normalised TF-IDF rows of every document (fitted on old)."""
    w = tfidf_weights(spark, sf_dir, normalize=True)
    return w.select("doc_id", "side", "term", F.round("w", 6).alias("w"))


def tfidf_sublinear_top(spark: SparkSession, sf_dir: str, max_features: int = 5000) -> DataFrame:
    """Sublinear TF-IDF with the vocabulary cut to ``max_features`` terms."""
    w = tfidf_weights(spark, sf_dir, normalize=True, max_features=max_features, sublinear=True)
    return w.select("doc_id", "side", "term", F.round("w", 6).alias("w"))


def count_matrix(spark: SparkSession, sf_dir: str, max_features: int = 1000) -> DataFrame:
    """Count rows restricted to the old side's ``max_features`` most frequent terms."""
    counts = side_counts(spark, sf_dir)
    vocab = W.fit_vocabulary(counts, max_features, where=is_old())
    return W.apply_counts(counts, vocab, keep=("side",))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = T.word_list("text")
    return two_sided(spark, sf_dir).select(
        "doc_id", "side", F.size(toks).cast("long").alias("n_tokens"),
        F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"))
