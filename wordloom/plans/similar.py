"""Similar-document plans: fit a weighting on the old side, apply it to both
sides, rank the k nearest old documents for every new one.

One scan, one tokenisation and one ``(doc_id, side, term, n)`` aggregate feed
both the fit (conditional aggregates over the old rows) and the apply; the
counts exchange is reused instead of re-planned per side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import weights as W
from ..operators.similarity import sparse_topk_sided
from .corpus import NEW, OLD, two_sided

def is_old():
    return F.col("side") == OLD


def side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, side, term, n) with the 2+ word-character token rule."""
    docs = two_sided(spark, sf_dir)
    return W.term_counts(docs.select("doc_id", "side", T.unicode_terms("text").alias("tokens")), keep=("side",))


def side_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, is_query) for every document: new documents are the queries."""
    return two_sided(spark, sf_dir, "n_chars").select("doc_id", (F.col("side") == NEW).alias("is_query"))


def n_old_docs(spark: SparkSession, sf_dir: str):
    return W.count_docs(two_sided(spark, sf_dir, "n_chars").where(is_old()))


def tfidf_weights(spark: SparkSession, sf_dir: str, normalize: bool = True,
                  max_features: int | None = None, sublinear: bool = False) -> DataFrame:
    """(doc_id, side, term, w): TF-IDF matrix fitted on old, applied to both sides."""
    counts = side_counts(spark, sf_dir)
    model = W.fit_tfidf(counts, n_old_docs(spark, sf_dir), max_features=max_features,
                        mode="smooth", where=is_old())
    return W.apply_tfidf(counts, model, sublinear=sublinear, normalize=normalize, keep=("side",), max_features=max_features)


def nearest_report(top: DataFrame) -> DataFrame:
    return top.select(F.col("query_id").alias("new_id"), F.col("rank").cast("long").alias("rank"),
                      F.col("ref_id").alias("old_id"), (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


def topk_tfidf(spark: SparkSession, sf_dir: str, k: int = 3, metric: str = "cosine") -> DataFrame:
    """(new_id, rank, old_id, dist) over TF-IDF rows.

    Cosine is scale-free, so rows are not L2-normalised first (one shuffle
    less); Euclidean and Jaccard see the normalised rows, as in the matrix.
    """
    w = tfidf_weights(spark, sf_dir, normalize=(metric != "cosine"))
    w = w.select("doc_id", (F.col("side") == NEW).alias("is_query"), "term", "w")
    return nearest_report(sparse_topk_sided(w, side_ids(spark, sf_dir), k, metric))


def topk_counts(spark: SparkSession, sf_dir: str, k: int = 3, metric: str = "jaccard",
                max_features: int | None = None) -> DataFrame:
    """Top-k over the count matrix fitted on the old side."""
    counts = side_counts(spark, sf_dir)
    vocab = W.fit_vocabulary(counts, max_features, where=is_old())
    w = W.apply_counts(counts, vocab, keep=("side",)).select(
        "doc_id", (F.col("side") == NEW).alias("is_query"), "term", F.col("n").alias("w"))
    return nearest_report(sparse_topk_sided(w, side_ids(spark, sf_dir), k, metric))
