"""Cleaning / tokenising plans over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import documents


def cleaned_old_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL lines, @tokens, non-letters, extra spaces and (case-sensitive) stop words removed."""
    toks = T.clean_old_new("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("clean"))


def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents before / after dropping those left empty by cleaning (one pass)."""
    d = documents(spark, sf_dir).select(F.size(T.clean_old_new("text")).alias("n"))
    return d.agg(F.count(F.lit(1)).alias("n_before"),
                 F.count_if(F.col("n") > 0).alias("n_after"),
                 F.count_if(F.col("n") == 0).alias("n_removed"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences per document, non-empty word lists, words (letters only, lower-cased)."""
    sents = T.split_sentences("text")
    words = T.sentence_words("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.size(sents).cast("long").alias("n_sentences"),
        F.size(words).cast("long").alias("n_word_lists"),
        F.size(F.flatten(words)).cast("long").alias("n_words"))


def punct_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = T.punct_tokens("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"),
        F.size(F.filter(toks, lambda x: x.rlike(r"^[.,!?;/-]$"))).cast("long").alias("n_punct"))


def alpha_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = T.whitespace_tokens(F.lower("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"),
        F.size(T.alpha_tokens(toks)).cast("long").alias("n_alpha"))


def word_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treebank-like word tokens (look-ahead regex: no RE2 form, rows-only)."""
    toks = T.word_tokens(F.lower("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"),
        F.size(F.filter(toks, lambda x: x.startswith("'") | (x == "n't"))).cast("long").alias("n_clitics"))


def newsgroup_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.strip_newsgroup_parts("text")
    return documents(spark, sf_dir).select("doc_id", F.length(body).cast("long").alias("n_chars"),
                                           F.md5(body).alias("body_md5"))


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: turns, tokens after the word-list rule and stop-word removal."""
    from ..session import table
    c = table(spark, sf_dir, "conversations")
    toks = T.word_list("text", remove_stops=True)
    return (c.select("conv_id", F.size(toks).alias("n"))
             .groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n").alias("n_tokens")))
