"""The corpus pipeline: five stages over ``documents``, each one written as Parquet before the next reads it.

Every stage takes the documents that the one before it kept. All but the last
return the columns of ``documents``; the last returns the pieces of the packed
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import maybe_in, read, without, write_state
from wordloom.llm.line_dedup import without_repeated_lines
from wordloom.llm.mixing import mixed_rows
from wordloom.llm.ngram_join import written_components
from wordloom.llm.packing import pack
from wordloom.llm.quality import quality_scores


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is at least one half; rows with a null doc_id stay."""
    judged = quality_scores(docs, read(spark, sf_dir, "labels"))
    return without(docs, "doc_id", judged.where("not kept").select("doc_id").distinct())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, also nearly, an earlier one; those left without a word go.

    n_chars is the new text's length. Documents that had no words before stay as they are.
    """
    blank = r"^[\x20\x09-\x0D]*$"
    was = docs.withColumn("n_chars", F.when(F.col("text").rlike(blank) | F.col("text").isNull(), -1))
    cut = without_repeated_lines(was).where(~F.coalesce(F.col("text").rlike(blank), F.lit(True)) | (F.col("n_chars") < 0))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies (five words, Jaccard >= 0.8).

    A row that repeats a doc_id and its text goes as well; rows with a null doc_id stay.
    """
    groups = written_components(docs, n=5, num=80, den=100)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    again = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    one = maybe_in(docs, "doc_id", again).join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(docs, "doc_id", gone.union(again)).union(one.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: passages of documents, as often as the mix takes them."""
    mixed = mixed_rows(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [("quality_classifier", good_quality), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates),
          ("mixing", mix), ("packing", packing)]

#: No stage but the last two could be put in SQL; tests/llm/test_pipeline.py checks each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_state(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
