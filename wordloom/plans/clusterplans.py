"""Cluster scoring and clustering plans over ``embeddings`` (label = class) and
``documents`` (source = class); LSI and PCA reductions."""

from __future__ import annotations

from functools import reduce as _reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import cluster as C
from ..operators import linkage
from ..operators import lsi as L
from ..operators import reduce as R
from ..operators import ward
from ..operators import weights as W
from ..operators.similarity import dense_topk_sided
from ..session import cut_lineage, table
from .corpus import two_sided
from .similar import is_old, n_old_docs, nearest_report, side_counts

K = 10
MAX_ITER = 10_000_000  # the reference's bound: k-means runs until no centre moves
SQL_STEPS = 8  # the steps that the SQL form unrolls; only the ``*_8_steps`` queries stop there


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), V.as_double_array("embedding").alias("vec"), "label")


def first_centres(pts: DataFrame, k: int = K) -> DataFrame:
    """Deterministic start: the k points with the smallest ids (bounded top-k),
    numbered 0..k-1 (window over those k rows only)."""
    first = pts.orderBy("doc_id").limit(k)
    return first.select((F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("cluster_id"),
                        "vec")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def fixed_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    assign = C.assign_nearest(pts.select("doc_id", "vec"), first_centres(pts))
    return C.contingency(assign, pts.select("doc_id", "label"))


def cluster_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_contingency(spark, sf_dir).select("cluster_id", "label", "n")


def cluster_scores_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.scores(fixed_contingency(spark, sf_dir))
    return s.select("n", F.round("purity", 6).alias("purity"), F.round("entropy", 6).alias("entropy"))


def cluster_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.majority_label(fixed_contingency(spark, sf_dir))


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    step = C.lloyd_step(pts.select("doc_id", "vec"), first_centres(pts))
    return step.select("cluster_id", "n", V.round_array("vec", 6).alias("vec"),
                       F.round("cost", 4).alias("cost"))


def _scored(method: str, assign: DataFrame, labels: DataFrame) -> DataFrame:
    s = C.scores(C.contingency(assign, labels))
    return s.select(F.lit(method).alias("method"), "n", F.round("purity", 6).alias("purity"),
                    F.round("entropy", 6).alias("entropy"))


def kmeans_scores(spark: SparkSession, sf_dir: str, max_iter: int = MAX_ITER) -> DataFrame:
    pts = points(spark, sf_dir)
    assign, _ = C.kmeans(pts.select("doc_id", "vec"), K, max_iter=max_iter)
    return _scored("kmeans", assign, pts.select("doc_id", "label"))


def spherical_kmeans_scores(spark: SparkSession, sf_dir: str, max_iter: int = MAX_ITER) -> DataFrame:
    pts = points(spark, sf_dir)
    assign, _ = C.kmeans(pts.select("doc_id", "vec"), K, max_iter=max_iter, metric="cosine")
    return _scored("spherical_kmeans", assign, pts.select("doc_id", "label"))


def spectral_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    assign = C.spectral(pts.select("doc_id", "vec"), K, neighbours=10)
    return _scored("spectral", assign, pts.select("doc_id", "label"))


def _single_linkage_cut(p: DataFrame, k: int = K) -> DataFrame:
    return linkage.cut(p, linkage.minimum_spanning_tree(p), k)


def compare_clusterings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, n, purity, entropy) for each clustering of the same points."""
    pts = points(spark, sf_dir)
    labels = pts.select("doc_id", "label")
    p = pts.select("doc_id", "vec")
    parts = [
        _scored("nearest_first_k", C.assign_nearest(p, first_centres(pts)).select("doc_id", "cluster_id"), labels),
        _scored("kmeans", C.kmeans(p, K, max_iter=MAX_ITER)[0], labels),
        _scored("spherical_kmeans", C.kmeans(p, K, max_iter=MAX_ITER, metric="cosine")[0], labels),
        _scored("spectral", C.spectral(p, K), labels),
        _scored("single_linkage", _single_linkage_cut(p), labels),
    ]
    return _reduce(DataFrame.unionByName, parts)


def top_terms_per_source(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """Centre of each source = mean L2-normalised TF-IDF row (fitted on all
    documents); its ``n`` heaviest terms."""
    docs = table(spark, sf_dir, "documents")
    counts = W.term_counts(docs.select("doc_id", "source", T.unicode_terms("text").alias("tokens")), keep=("source",))
    model = W.fit_tfidf(counts, W.count_docs(docs.select("doc_id")), mode="smooth")
    w = W.apply_tfidf(counts, model, normalize=True, keep=("source",))
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("nd"))
    centres = (w.groupBy("source", "term").agg(F.sum("w").alias("s"))
                .join(sizes, "source").select("source", "term", (F.col("s") / F.col("nd")).alias("weight")))
    top = C.top_terms(centres, n, group="source")
    return top.select("source", F.col("rank").cast("long").alias("rank"), "term",
                      F.round("weight", 6).alias("weight"))


def _document_points(spark: SparkSession, sf_dir: str, hashed: bool) -> DataFrame:
    """(doc_id, vec, label): averaged trained (or ``hashed``) word vectors of every document; the label is its source."""
    from .embedplans import doc_vectors_mean, with_every_document, word2vec_doc_vectors
    vecs = doc_vectors_mean(spark, sf_dir) if hashed else with_every_document(spark, sf_dir, word2vec_doc_vectors(spark, sf_dir))
    return vecs.select("doc_id", "vec").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label")), "doc_id")


def kmeans_documents_scores(spark: SparkSession, sf_dir: str, max_iter: int = MAX_ITER, hashed: bool = False) -> DataFrame:
    """Corpus -> document vectors -> k-means -> purity and entropy against the sources."""
    pts = cut_lineage(_document_points(spark, sf_dir, hashed))
    assign, _ = C.kmeans(pts.select("doc_id", "vec"), K, max_iter=max_iter)
    return _scored("kmeans_documents", assign, pts.select("doc_id", "label"))


def kmeans_documents_top_terms(spark: SparkSession, sf_dir: str, n: int = 20, max_iter: int = MAX_ITER,
                               hashed: bool = False) -> DataFrame:
    """The ``n`` heaviest terms of every document cluster: mean L2-normalised TF-IDF row of its documents."""
    pts = cut_lineage(_document_points(spark, sf_dir, hashed))
    assign, _ = C.kmeans(pts.select("doc_id", "vec"), K, max_iter=max_iter)
    assign = cut_lineage(assign)
    docs = table(spark, sf_dir, "documents")
    counts = W.term_counts(docs.select("doc_id", T.unicode_terms("text").alias("tokens")))
    model = W.fit_tfidf(counts, W.count_docs(docs.select("doc_id")), mode="smooth")
    w = W.apply_tfidf(counts, model, normalize=True)
    sizes = assign.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("nd"))
    centres = (w.join(assign, "doc_id").groupBy("cluster_id", "term").agg(F.sum("w").alias("s"))
                .join(sizes, "cluster_id").select("cluster_id", "term", (F.col("s") / F.col("nd")).alias("weight")))
    top = C.top_terms(centres.withColumn("weight", F.round("weight", 9)), n)
    return top.select("cluster_id", F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 6).alias("weight"))


# ----------------------------------------------------------------------------- reduction
def _lsi(spark: SparkSession, sf_dir: str, rank: int):
    """Tokenise once: counts and TF-IDF rows are checkpointed and feed the fit, the fold-in and the variance sums."""
    counts = cut_lineage(side_counts(spark, sf_dir))
    model = W.fit_tfidf(counts, n_old_docs(spark, sf_dir), mode="smooth", where=is_old())
    weights = cut_lineage(W.apply_tfidf(counts, model, normalize=True, keep=("side",)))
    return weights, L.fit_svd(weights.where(is_old()), rank)


def _lsi_vectors(spark: SparkSession, sf_dir: str, rank: int) -> DataFrame:
    weights, fit = _lsi(spark, sf_dir, rank)
    return (two_sided(spark, sf_dir, "n_chars").select("doc_id", "side").join(L.fold_in(weights, fit.comps), "doc_id", "left")
            .withColumn("vec", F.coalesce("vec", V.zeros(len(fit.values)))))


def lsi_doc_vectors(spark: SparkSession, sf_dir: str, rank: int = 300) -> DataFrame:
    """LSI: TF-IDF (old side, all terms) -> rank-r SVD -> fold both sides -> L2 norm.

    A row for every document; one without a term of the old side is all zeros.
    Fewer than ``rank`` components where the old documents have a lower rank.
    """
    return _lsi_vectors(spark, sf_dir, rank).select("doc_id", "side", V.round_array("vec", 6).alias("vec"))


def topk_lsi(spark: SparkSession, sf_dir: str, k: int = 3, rank: int = 300) -> DataFrame:
    """The k nearest old documents of every new one by cosine of their LSI vectors; all-zero vectors rank last."""
    vectors = cut_lineage(_lsi_vectors(spark, sf_dir, rank))
    return nearest_report(dense_topk_sided(vectors.select("doc_id", (~is_old()).alias("is_query"), "vec"), k, "cosine"))


def lsi_explained_variance(spark: SparkSession, sf_dir: str, rank: int = 300) -> DataFrame:
    """Share of the old side's variance over all terms that the rank-r SVD keeps."""
    weights, fit = _lsi(spark, sf_dir, rank)
    return L.explained_variance(weights.where(is_old()), fit, n_old_docs(spark, sf_dir)).select(
        F.lit(rank).alias("rank"), "ratio", "percent")


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    out = R.pca_2d(pts.select("doc_id", "vec"), 2)
    return out.select(F.col("doc_id").alias("vec_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def single_linkage_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage merge heights: (a, b, height) minimum spanning tree edges."""
    pts = points(spark, sf_dir)
    mst = linkage.minimum_spanning_tree(pts.select("doc_id", "vec"))
    return mst.select("a", "b", F.round("height", 6).alias("height"))


def single_linkage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage tree cut at k clusters, scored against the labels."""
    pts = points(spark, sf_dir)
    p = pts.select("doc_id", "vec")
    assign = linkage.cut(p, linkage.minimum_spanning_tree(p), K)
    return _scored("single_linkage", assign, pts.select("doc_id", "label"))


def ward_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward merges of the embeddings: (a, b, height, size)."""
    merges = ward.ward_linkage(points(spark, sf_dir).select("doc_id", "vec"))
    return merges.select("a", "b", F.round("height", 6).alias("height"), "size")


def ward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Ward tree cut at k clusters, scored against the labels."""
    pts = points(spark, sf_dir)
    p = pts.select("doc_id", "vec")
    return _scored("ward", linkage.cut(p, ward.ward_linkage(p), K), pts.select("doc_id", "label"))
