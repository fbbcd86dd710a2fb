"""Clean vectors as bytes, and classes of equal vectors, for the two embedding operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import write_state


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch["embedding"]:
            values = x.values
            v = None
            if values is not None and len(values) and not values.null_count:
                v = np.asarray(values, np.float64) + 0.0  # -0.0 becomes 0.0
                with np.errstate(over="ignore"):
                    fine = np.isfinite(v).all() and v.any()
                v = v.tobytes() if fine else None
            out.append(v)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary())], ["vec_id", "vec"])


def vector_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec, key): the vector as doubles' bytes, null if it is null, empty, zero, or holds nulls or non-finite
    components; key is null if the row takes no part (no vector, or no vec_id)."""
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
            .mapInArrow(_clean, "vec_id long, vec binary"))
    return write_state(rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.md5("vec"))), "vectors")


def vector_classes(rows: DataFrame, ids: int = 1) -> DataFrame:
    """One row per distinct vector: cid (a number of its own), vec, weight (distinct vec_ids), ids (the ``ids`` smallest)."""
    single = rows.where("key is not null").groupBy("key", "vec_id").agg(F.first("vec").alias("vec"))
    counted = single.groupBy("key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    whole = single.join(counted.select("key", "weight", F.col("low").alias("vec_id")), ["key", "vec_id"])
    if ids > 1:  # the rank's limit is applied in every task before the shuffle
        order = Window.partitionBy("key").orderBy("vec_id")
        smallest = (single.select("key", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= ids)
                    .groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
        whole = whole.join(smallest, "key")
    else:
        whole = whole.withColumn("ids", F.array("vec_id"))
    return write_state(whole.select("key", "vec", "weight", "ids", F.monotonically_increasing_id().alias("cid")),
                       "vector-classes")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
