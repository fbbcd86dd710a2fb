"""The two-sided corpus over the ``documents`` table.

old (reference) side: doc_id % 5 <> 0; new (query) side: the rest. Every
document lands on exactly one side; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

OLD, NEW = "old", "new"


def side_expr(id_col: str = "doc_id"):
    return F.when(F.col(id_col) % 5 != 0, F.lit(OLD)).otherwise(F.lit(NEW))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    cols = cols or ("doc_id", "text")
    return table(spark, sf_dir, "documents").select(*cols)


def two_sided(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """(doc_id, side, *cols) for every document."""
    cols = cols or ("text",)
    return table(spark, sf_dir, "documents").select("doc_id", side_expr().alias("side"), *cols)
