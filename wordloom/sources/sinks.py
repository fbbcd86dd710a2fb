"""Writers. Parquet (array column) is the native layout; the wide CSV forms
are produced on request. All writes are distributed (one file per partition)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_vectors(df: DataFrame, path: str, wide: bool = False, dim: int | None = None,
                  mode: str = "overwrite") -> None:
    """(label, name, vec) -> parquet, or CSV ``target_names, filenames, x0..x{d-1}``."""
    if not wide:
        df.select("label", "name", "vec").write.mode(mode).parquet(path)
        return
    if dim is None:
        dim = df.select(F.max(F.size("vec"))).first()[0]
    cols = [F.col("label").alias("target_names"), F.col("name").alias("filenames")]
    cols += [F.col("vec")[i].alias(f"x{i}") for i in range(dim)]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def write_xy(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(name, x, y) -> CSV ``Name, X, Y``."""
    df.select(F.col("name").alias("Name"), F.col("x").alias("X"), F.col("y").alias("Y")) \
      .write.mode(mode).option("header", True).csv(path)


def save_word_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(term, vec) -> parquet (read back with ``read_word_vectors(fmt='parquet')``)."""
    df.select("term", "vec").write.mode(mode).parquet(path)


def save_extracted(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Extracted texts -> parquet (no side files next to the inputs)."""
    df.write.mode(mode).parquet(path)
