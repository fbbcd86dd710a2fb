"""Term statistics and document-term weighting as grouped DataFrame plans.

Long ("coordinate") layout throughout: ``(doc_id, term, n)`` counts and
``(doc_id, term, w)`` weights -- a document-term matrix is never densified.

Scale notes
* documents are shuffled once, as token arrays by ``doc_id``; ``explode``, the
  counts by (doc_id, term) and the row norms then need no further exchange.
* per-term statistics use ``groupBy(term)`` with partial aggregation, never a
  window over ``term``: a frequent term may own a third of all rows and a
  window would pull all of them into one task.
* idf tables are joined back by ``joined_in_place``: the ``HOT_TERMS`` most
  frequent terms, which own most (doc, term) rows, travel to the rows by broadcast;
  only the rows of rarer terms travel to their term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDF_MODES = ("floor", "real", "smooth", "spark")
#: Terms that are joined by broadcast (a bound on the broadcast; every other term is joined by a shuffle).
HOT_TERMS = 65536


def term_counts(df: DataFrame, tokens: str | Column = "tokens", id_col: str = "doc_id",
                keep: tuple[str, ...] = (), min_len: int | None = None) -> DataFrame:
    """(doc_id, *keep, term, n): raw term frequency per document.

    ``keep`` carries per-document columns (e.g. ``side``) through the grouping.
    ``min_len`` drops exploded pieces shorter than that (a code-generated
    filter after ``explode``, cheaper than an array ``filter`` lambda).
    """
    tok = F.col(tokens) if isinstance(tokens, str) else tokens
    # no alias of a column to its own name: it would keep the plan's branches from sharing the exchange
    id_ = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    whole = df.select(id_, *keep, tok.alias("_tokens")).repartition("doc_id")
    # explode_outer: a plain explode makes Catalyst infer ``size(tokens) > 0`` and
    # push it below the exchange, tokenising every document twice
    rows = whole.select("doc_id", *keep, F.explode_outer("_tokens").alias("term"))
    rows = rows.where(F.length("term") >= (min_len or 0)) if min_len else rows.where(F.col("term").isNotNull())
    return rows.groupBy("doc_id", *keep, "term").agg(F.count(F.lit(1)).alias("n"))


def with_tf(counts: DataFrame, mode: str = "raw") -> DataFrame:
    """Add ``tf`` to (doc_id, term, n).

    raw: n; sublinear: 1 + ln(n); augmented: 0.5 + 0.5 * n / max n in the doc.
    """
    if mode in ("raw", 1):
        return counts.withColumn("tf", F.col("n").cast("double"))
    if mode in ("sublinear", 2):
        return counts.withColumn("tf", F.lit(1.0) + F.log(F.col("n")))
    if mode in ("augmented", 3):
        mx = F.max("n").over(Window.partitionBy("doc_id"))
        return counts.withColumn("tf", F.lit(0.5) + F.lit(0.5) * F.col("n") / mx)
    raise ValueError(f"unknown tf mode {mode!r}")


def document_frequency(counts: DataFrame, where: Column | None = None) -> DataFrame:
    """(term, df, cf): documents containing the term and its total count.

    ``where`` restricts the statistics to some rows (e.g. the fitted side) by
    conditional aggregation, so callers can share one ``counts`` exchange
    between fitting and applying instead of filtering it into two subtrees.
    """
    if where is None:
        return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    return (counts.groupBy("term")
                  .agg(F.count_if(where).alias("df"), F.sum(F.when(where, F.col("n"))).alias("cf"))
                  .where(F.col("df") > 0))


def idf_expr(n_docs: Column, df: Column, mode: str = "floor") -> Column:
    """idf variants.

    floor  : 1 + ln(floor(N / df))     integer division, as the word-vector weighting does
    real   : 1 + ln(N / df)
    smooth : ln((1 + N) / (1 + df)) + 1 (the TF-IDF matrix rule)
    spark  : ln((N + 1) / (df + 1))     (MLlib IDF)
    """
    n, d = n_docs.cast("double"), df.cast("double")
    if mode == "floor":
        return F.lit(1.0) + F.log(F.floor(n / d))
    if mode == "real":
        return F.lit(1.0) + F.log(n / d)
    if mode == "smooth":
        return F.log((n + 1) / (d + 1)) + F.lit(1.0)
    if mode == "spark":
        return F.log((n + 1) / (d + 1))
    raise ValueError(f"unknown idf mode {mode!r}")


def count_docs(docs: DataFrame) -> Column:
    """Number of documents as a scalar sub-query (planned once, stays lazy)."""
    return docs.select(F.count(F.lit(1))).scalar()


def fit_idf(counts: DataFrame, n_docs: Column, mode: str = "floor",
            where: Column | None = None) -> DataFrame:
    """(term, df, cf, idf) over the fitted corpus."""
    return document_frequency(counts, where).withColumn("idf", idf_expr(n_docs, F.col("df"), mode))


def top_terms(counts: DataFrame, max_features: int, where: Column | None = None) -> DataFrame:
    """The ``max_features`` most frequent terms (ties by term); bounded top-N
    (each partition keeps N candidates, one task merges them)."""
    return (document_frequency(counts, where)
            .orderBy(F.desc("cf"), F.asc("term")).limit(max_features).select("term"))


def fit_tfidf(counts: DataFrame, n_docs: Column, max_features: int | None = None,
              mode: str = "smooth", where: Column | None = None) -> DataFrame:
    """Model table (term, idf) fitted on the ``where`` rows of ``counts``."""
    model = fit_idf(counts, n_docs, mode, where).select("term", "idf")
    if max_features:
        model = model.join(top_terms(counts, max_features, where), "term", "left_semi")
    return model


def most_documents(counts: DataFrame) -> DataFrame:
    """(term): the ``HOT_TERMS`` terms of the most documents."""
    return document_frequency(counts).orderBy(F.desc("df"), F.asc("term")).limit(HOT_TERMS).select("term")


def joined_in_place(cells: DataFrame, by_term: DataFrame, hot: DataFrame) -> DataFrame:
    """``cells`` (doc_id, term, ...) with the columns of ``by_term`` (term, ...), inner, still dealt by doc_id.

    hot: (term), the ``HOT_TERMS`` terms with the most cells. Their cells do not move; those of other terms are
    joined by a shuffle and sent back to their document.
    """
    more = [c for c in by_term.columns if c != "term"]
    near = by_term.join(F.broadcast(hot.select("term")), "term", "left_semi")
    out = [*cells.columns, *more]
    apart = cells.join(F.broadcast(hot.select("term")), "term", "left_anti").join(by_term, "term").select(*out).repartition("doc_id")
    return cells.join(F.broadcast(near), "term").select(*out).unionByName(apart)


def apply_tfidf(counts: DataFrame, model: DataFrame, sublinear: bool = False,
                normalize: bool = True, keep: tuple[str, ...] = (), max_features: int | None = None) -> DataFrame:
    """(doc_id, *keep, term, w): tf * idf, terms outside the model dropped,
    rows L2-normalised (window per document: bounded by document length).

    max_features: the model's number of terms at most, if that is bounded."""
    tf = (F.lit(1.0) + F.log("n")) if sublinear else F.col("n").cast("double")
    if max_features and max_features <= HOT_TERMS:
        cells = counts.join(F.broadcast(model), "term")
    else:  # the smallest idf: the terms of the most documents
        cells = joined_in_place(counts, model, model.orderBy("idf", "term").limit(HOT_TERMS))
    w = cells.select("doc_id", *keep, "term", (tf * F.col("idf")).alias("w"))
    if not normalize:
        return w
    nrm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", *keep)))
    return w.select("doc_id", *keep, "term", (F.col("w") / nrm).alias("w"))


def fit_vocabulary(counts: DataFrame, max_features: int | None = None,
                   where: Column | None = None) -> DataFrame:
    """Vocabulary (term) of the count matrix, cut to the most frequent terms."""
    if max_features:
        return top_terms(counts, max_features, where)
    return document_frequency(counts, where).select("term")


def apply_counts(counts: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, term, n) restricted to the fitted vocabulary."""
    return counts.join(vocab, "term", "left_semi").select("doc_id", *keep, "term", "n")
