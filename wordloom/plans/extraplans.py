"""HTML text and stemming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import strip_html
from ..functions.stem import stem_counts, stem_vocabulary
from ..operators import weights as W
from ..session import table


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page: (page_id, n_chars, n_words)."""
    p = table(spark, sf_dir, "pages")
    txt = strip_html("html")
    return p.select("page_id", txt.alias("t")).select(
        "page_id", F.length("t").cast("long").alias("n_chars"),
        F.size(T.whitespace_tokens("t")).cast("long").alias("n_words"))


def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, stem) for every distinct word (letters only, lower-cased, stop words out)."""
    d = table(spark, sf_dir, "documents")
    toks = d.select(F.explode(T.word_list("text", remove_stops=True)).alias("term"))
    return stem_vocabulary(toks)


def stemmed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    counts = W.term_counts(d.select("doc_id", T.word_list("text", remove_stops=True).alias("tokens")))
    return stem_counts(counts)
