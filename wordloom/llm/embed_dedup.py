"""Near-duplicate vectors: random-hyperplane sign hashes in several tables, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import keyed_groups, write_state
from wordloom.llm.components import connected_components, least_labels
from wordloom.llm.vectors import matrix, vector_classes, vector_rows


def plan_tables(vectors: int, threshold: float, occupancy: int, miss: float) -> tuple[int, int]:
    """(bits, tables): buckets of about ``occupancy`` unlike vectors; a pair at the threshold is missed with ``miss``."""
    bits = min(30, max(1, round(log2(max(vectors, 1) / occupancy)) if vectors > occupancy else 1))
    agree = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 / miss) / -log(1 - agree)) if agree < 1 else 1


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.RandomState([seed, dim, bits, tables]).standard_normal((dim, bits * tables))


def _sign(bits: int, tables: int, seed: int):
    """Classes -> one row per table, with the signature of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["vec"].to_pylist()
            signs = np.zeros((len(raw), tables), np.int32)
            sizes = np.array([len(x) // 8 for x in raw], np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                up = (x @ planes(int(dim), bits, tables, seed) > 0).reshape(len(at), tables, bits)
                signs[at] = (up << np.arange(bits)).sum(axis=2)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes.astype(np.int32)), pa.array(np.full(len(raw), t, np.int32)), pa.array(signs[:, t]),
                     batch["cid"], batch["weight"], batch["vec"],
                     pa.array([row.tobytes() for row in signs], pa.binary())],
                    ["dim", "t", "sign", "cid", "weight", "vec", "signs"])

    return run, "dim int, t int, sign int, cid long, weight long, vec binary, signs binary"


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by a power of two, which is exact and keeps the squares finite, and their norms."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _cell(threshold: float):
    """Sorted (dim, t, sign, p, q) cells -> (cid, links) sums and (cid, root) forest edges of their new links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, t, _, p, q), table in keyed_groups(batches, ["dim", "t", "sign", "p", "q"]):
            cid, block, weight = (table[c].to_numpy() for c in ("cid", "block", "weight"))
            x, norm = _unit(matrix(table["vec"], dim))
            signs = np.frombuffer(b"".join(table["signs"].to_pylist()), np.int32).reshape(len(cid), -1)
            one, two = np.flatnonzero(block == p), np.flatnonzero(block == q)
            if not len(one) or not len(two):
                continue
            links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
            first, second = [], []
            for lo in range(0, len(one), 256):
                rows = one[lo: lo + 256]
                cosine = x[rows] @ x[two].T / np.outer(norm[rows], norm[two])
                i, j = np.nonzero(cosine >= threshold)
                i, j = rows[i], two[j]
                if p == q:
                    i, j = i[i < j], j[i < j]
                new = np.ones(len(i), bool)
                for u in range(t):  # a link counts in the first table that has it
                    new[new] = signs[i[new], u] != signs[j[new], u]
                first.append(i[new])
                second.append(j[new])
            i, j = np.concatenate(first), np.concatenate(second)
            if not len(i):
                continue
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = least_labels(i, j, len(cid))
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[label[at]]), pa.array(links[at])],
                                             ["a", "b", "links"])

    return run, "a long, b long, links long"


def embedding_components(embeddings: DataFrame, threshold: float = 0.9, occupancy: int = 256, miss: float = 1e-3,
                         block: int = 512, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings`` (vec_id, embedding; other columns are ignored).

    Vectors link when their cosine, in double precision, is at least
    ``threshold``. n_links counts the other vectors (vec_ids) linked directly, component_id is the
    smallest vec_id reachable, kept whether it is the row's own. Only pairs that
    share a bucket in one of the tables are compared: a pair at the threshold
    shares none with probability ``miss``, a closer one with less; no pair below the threshold links.

    Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing (0 links, a component of their own), as do vectors of different
    lengths, and rows with a null vec_id (component_id null, kept). Equal vectors are compared
    once, with their number; a repeated (vec_id, vector) counts once and all its rows come back. Empty tables give no rows.

    A bucket of any size is dealt out as pairs of blocks of about ``block`` vectors. A cell
    returns at most one count and one edge per vector, never its list of pairs; a link in
    several tables is counted in the first.
    """
    rows = vector_rows(embeddings)
    groups = vector_classes(rows)
    bits, tables = plan_tables(groups.count(), threshold, occupancy, miss)
    run, schema = _sign(bits, tables, seed)
    signed = groups.select("cid", "weight", "vec").mapInArrow(run, schema)
    place = ["dim", "t", "sign"]
    sizes = signed.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    cells = (signed.join(sizes, place).withColumn("many", F.ceil(F.col("n") / F.lit(block)))
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("many")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
             .withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")))
    key = [*place, "p", "q"]
    run, schema = _cell(threshold)
    found = write_state(cells.select(*key, "block", "cid", "weight", "vec", "signs").repartition(*key)
                        .sortWithinPartitions(*key).mapInArrow(run, schema), "cell-links")
    degree = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    linked = connected_components(found.select("a", "b")).withColumnRenamed("node", "cid")
    placed = (groups.select("cid", "key", "weight", F.col("ids")[0].alias("low")).join(degree, "cid", "left")
              .join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
