"""Clustering and cluster scoring on DataFrames.

* the k centres are bounded by k, so assignment is map-side: centres travel with
  the task, points are not shuffled;
* k-means and spherical k-means are Lloyd steps from centres chosen by a hash of
  the id: a grouped mean per step, the same result for any partitioning;
* spectral clustering: the normalised adjacency of the exact k-nearest-neighbour
  graph, block power iteration on packed blocks of nodes, then k-means;
* purity and entropy are grouped aggregates over the (cluster, label)
  contingency table; one hot cluster is just one big partial aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import drop_state, write_state
from .similarity import RANK_PLACES, dense_topk_self

_ASSIGNED = "doc_id long, cluster_id long, dist double, vec array<double>"


def _rows(vecs: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vecs.flatten(), np.float64).reshape(-1, dim)


def _nearest(centers: list[tuple[int, list[float]]], metric: str):
    """A function of a matrix of points: (cluster ids, distances); ties (to 12 places) to the lower cluster id."""
    centers = sorted(centers)
    ids, c = np.array([i for i, _ in centers], np.int64), np.array([v for _, v in centers], np.float64)

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dist = np.empty((len(x), len(c)))
        for j, centre in enumerate(c):
            if metric == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    dist[:, j] = 1.0 - x @ centre / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(centre @ centre))
            else:
                diff = x - centre
                dist[:, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        best = np.argmin(np.round(np.nan_to_num(dist, nan=np.inf), RANK_PLACES), axis=1)
        return ids[best], dist[np.arange(len(x)), best]

    return near


def _assign(points: DataFrame, centers: list[tuple[int, list[float]]], metric: str) -> DataFrame:
    """(doc_id, cluster_id, dist, vec); ties (to 12 places) to the lower cluster id."""
    near = _nearest(centers, metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, dist = near(_rows(batch["vec"], len(centers[0][1])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(which), pa.array(dist), batch["vec"]],
                                             ["doc_id", "cluster_id", "dist", "vec"])

    return points.select("doc_id", V.as_double_array("vec").alias("vec")).mapInArrow(run, _ASSIGNED)


def _collected(centers: DataFrame) -> list[tuple[int, list[float]]]:
    """The centres as rows on the driver: k of them."""
    return [(int(r["cluster_id"]), [float(x) for x in r["vec"]]) for r in centers.select("cluster_id", "vec").collect()]


def assign_nearest(points: DataFrame, centers: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(doc_id, cluster_id, dist): nearest centre, ties to the lower cluster id.

    points: (doc_id, vec); centers: (cluster_id, vec), k rows.
    """
    return _assign(points, _collected(centers), metric).select("doc_id", "cluster_id", "dist")


def _means(assigned: DataFrame) -> DataFrame:
    return (assigned.groupBy("cluster_id")
            .agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector("vec")).alias("m"),
                 F.sum(F.col("dist") * F.col("dist")).alias("cost"))
            .select("cluster_id", "n", vector_to_array("m").alias("vec"), "cost"))


_PACKED = 4096  # points of a packed row


def _packed(points: DataFrame) -> DataFrame:
    """The vectors as (block) rows of up to ``_PACKED`` points each, which a step reads as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _PACKED):
                x = np.asarray(batch.slice(lo, _PACKED)["vec"].flatten(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["block"])

    return write_state(points.select("vec").mapInArrow(run, "block binary"), "packed", compression="uncompressed")


def _centre_means(packed: DataFrame, centers: list[tuple[int, list[float]]], metric: str) -> dict[int, np.ndarray]:
    """The mean of every centre's points. A task adds up its own blocks, so no vector travels; k rows a task reach the driver."""
    near, dim = _nearest(centers, metric), len(centers[0][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for block in batch["block"]:
                x = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, dim)
                which = near(x)[0]
                for i in np.unique(which):
                    mine = x[which == i]
                    n, s = total.get(int(i), (0, 0.0))
                    total[int(i)] = (n + len(mine), s + mine.sum(axis=0))
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()),
                 pa.array([s.tobytes() for _, s in total.values()], pa.binary())], ["cluster_id", "n", "s"])

    sums: dict[int, list] = {}
    for r in packed.mapInArrow(run, "cluster_id long, n long, s binary").collect():
        n, s = sums.get(r["cluster_id"], (0, 0.0))
        sums[r["cluster_id"]] = (n + r["n"], s + np.frombuffer(bytes(r["s"])))
    return {i: s / n for i, (n, s) in sums.items()}


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One Lloyd iteration: (cluster_id, n, vec, cost) of the new centres."""
    return _means(_assign(points, _collected(centers), "euclidean"))


def hashed_centres(points: DataFrame, k: int) -> DataFrame:
    """(cluster_id, vec): the k points whose ids have the smallest md5, numbered in that order (a bounded top-k)."""
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    first = points.select(key.alias("h"), "doc_id", "vec").orderBy("h", "doc_id").limit(k)
    number = F.row_number().over(Window.orderBy("h", "doc_id")) - 1  # over those k rows
    return first.select(number.cast("long").alias("cluster_id"), V.as_double_array("vec").alias("vec"))


def kmeans(points: DataFrame, k: int, max_iter: int = 100, metric: str = "euclidean", centres: DataFrame | None = None):
    """Lloyd's k-means (``metric='cosine'`` = spherical: unit points, unit centres).

    Starts from ``centres`` (default: ``hashed_centres``) and stops when no centre
    moves (by more than 1e-12 of the largest coordinate, at least 1) or the
    centres are those of an earlier step, or after ``max_iter`` steps. Centres are
    kept to 12 places, so the order of summation does not show. A cluster that loses all points keeps its
    centre. Zero vectors are kept out of cosine k-means (undefined direction) and returned as cluster -1.

    Returns (assignments(doc_id, cluster_id), centers(cluster_id, vec)).
    """
    spark = points.sparkSession
    data = points.select("doc_id", V.as_double_array("vec").alias("vec"))
    zero = None
    if metric == "cosine":
        zero = data.where(V.norm("vec") == 0).select("doc_id", F.lit(-1).cast("long").alias("cluster_id"))
        data = data.where(V.norm("vec") > 0).select("doc_id", V.l2_normalize("vec").alias("vec"))
    data = write_state(data, "points")
    packed = _packed(data)
    now = dict(_collected(hashed_centres(data, k) if centres is None else centres))
    seen = set()
    for _ in range(max_iter):
        if not now:
            break
        got = _centre_means(packed, list(now.items()), metric)
        if metric == "cosine":
            got = {i: v / max(np.sqrt(v @ v), 1e-300) for i, v in got.items()}
        after = now | {i: [float(x) for x in np.round(v, RANK_PLACES)] for i, v in got.items()}
        a, b = (np.array([x[i] for i in sorted(now)]) for x in (now, after))
        now = after
        if np.abs(a - b).max() <= 10.0 ** -RANK_PLACES * max(1.0, np.abs(b).max()) or b.tobytes() in seen:
            break
        seen.add(b.tobytes())
    drop_state(packed)
    assigned = _assign(data, list(now.items()), metric).select("doc_id", "cluster_id") if now else \
        data.select("doc_id", F.lit(0).cast("long").alias("cluster_id"))
    if zero is not None:
        assigned = assigned.unionByName(zero)
    return assigned, spark.createDataFrame(sorted(now.items()), "cluster_id long, vec array<double>")


def neighbour_graph(points: DataFrame, neighbours: int = 10) -> DataFrame:
    """(a, b, w), both directions: exact nearest neighbours, weight exp(-d^2 / mean d^2), so no scale underflows."""
    nn = write_state(dense_topk_self(points, neighbours + 1, "euclidean").where(F.col("query_id") != F.col("ref_id"))
                     .select(F.least("query_id", "ref_id").alias("a"), F.greatest("query_id", "ref_id").alias("b"),
                             (F.col("dist") * F.col("dist")).alias("d2")).distinct(), "neighbours")
    scale = F.greatest(nn.select(F.avg("d2")).scalar(), F.lit(1e-300))
    one = nn.select("a", "b", F.exp(-F.col("d2") / scale).alias("w"))
    return write_state(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "graph")


#: Nodes of a block, edges of one product in it, and Arrow rows at a time: a row holds up to a block's vectors.
_BLOCK_NODES, _PRODUCT_EDGES, _BLOCK_ROWS = 32768, 65536, 4


def _packed_cell(table: pa.Table) -> pa.Table:
    """The edges (t, s, i, j, w) between two blocks -> the cell's product, and the rows of s that it takes.

    The product holds i, the place among those rows, and w of every edge, by i. The cell of a block with itself takes
    all its rows, so its places are rows.
    """
    t, s = table["t"][0].as_py(), table["s"][0].as_py()
    i, j, w = (table[c].to_numpy() for c in "ijw")
    order = np.lexsort((j, i))
    i, j, w = (x[order] for x in (i, j, w))
    takes, place = (None, j) if t == s else np.unique(j, return_inverse=True)
    return pa.table({"t": pa.array([t], pa.int32()), "s": pa.array([s], pa.int32()),
                     "cell": pa.array([i.astype("<i4").tobytes() + place.astype("<i4").tobytes() + w.astype("<f8").tobytes()],
                                      pa.binary()),
                     "takes": pa.array([None if takes is None else takes.astype("<i4").tobytes()], pa.binary())})


def _sent(k: int):
    """Rows by (s, t): a block's vectors (t = -1), then for every cell the rows it takes -> (t, s, kind, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, t, data in zip(batch["s"].to_pylist(), batch["t"].to_pylist(), batch["data"]):
                if t < 0:
                    t, v = s, np.frombuffer(data.as_buffer(), "<f8").reshape(-1, k)
                    piece = v
                else:
                    piece = v[np.frombuffer(data.as_buffer(), "<i4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([-1 if t == s else s], pa.int32()), pa.array([1], pa.int32()),
                     pa.array([piece.tobytes()], pa.binary())], ["t", "s", "kind", "data"])

    return run


def _moved(k: int, turn: np.ndarray):
    """Rows by (t, s, kind), a cell and then the vectors it takes, each block's own (s = -1) first -> (s, v, gram):
    the next vectors of every block and their products with each other."""

    def out(t: int, base: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        v = (total + base) / 2
        return pa.RecordBatch.from_arrays(
            [pa.array([t], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([(v.T @ v).tobytes()], pa.binary())],
            ["s", "v", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = base = total = cell = None
        for batch in batches:
            for t, s, kind, data in zip(*(batch[c].to_pylist() for c in ("t", "s", "kind")), batch["data"]):
                if kind == 0:
                    cell = data
                    continue
                piece = np.frombuffer(data.as_buffer(), "<f8").reshape(-1, k) @ turn
                if s < 0:
                    if now is not None:
                        yield out(now, base, total)
                    now, base, total = t, piece, np.zeros(piece.shape)
                if cell is None:
                    continue
                raw = cell.as_buffer()
                m = raw.size // 16
                i, j = np.frombuffer(raw, "<i4", 2 * m).reshape(2, m)
                w = np.frombuffer(raw, "<f8", m, 8 * m)
                for lo in range(0, m, _PRODUCT_EDGES):
                    rows, part = i[lo:lo + _PRODUCT_EDGES], piece[j[lo:lo + _PRODUCT_EDGES]] * w[lo:lo + _PRODUCT_EDGES, None]
                    runs = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                    total[rows[runs]] += np.add.reduceat(part, runs, axis=0)
                cell = None
        if now is not None:
            yield out(now, base, total)

    return run


def _packed_nodes(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("a")
        v = pc.list_flatten(table["v"]).to_numpy().reshape(-1, k)
        return pa.table({"s": table["s"][:1], "ids": pa.array([table["a"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "v": pa.array([v.tobytes()], pa.binary())})

    return run


def spectral(points: DataFrame, k: int, neighbours: int = 10, max_iter: int = 30, tol: float = 1e-3,
             block_nodes: int = _BLOCK_NODES) -> DataFrame:
    """Spectral clustering (doc_id, cluster_id): the k leading eigenvectors of the normalised adjacency
    D^-1/2 W D^-1/2 (the smallest of the normalised Laplacian) of the neighbour graph, rows scaled to unit length, k-means.

    ``neighbours``, ``max_iter`` and ``tol`` are parameters of the method. Block
    power iteration on (I + A) / 2. Nodes lie in blocks of about ``block_nodes`` (by a hash), vectors and edges packed: in a
    step a node's vector travels once to every block that has a neighbour of it, not once an edge, and a task holds one
    block and one cell of edges at a time; only a k x k Gram matrix a block reaches the driver.
    """
    spark = points.sparkSession
    graph = neighbour_graph(points, neighbours)
    degree = write_state(graph.groupBy("a").agg(F.sum("w").alias("deg")), "degree")
    blocks = max(1, -(-degree.count() // block_nodes))
    block = F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")
    place = (F.row_number().over(Window.partitionBy("t").orderBy("a")) - 1).cast("int")  # inside a block
    node = degree.select("a", "deg", block.alias("t")).select("a", "deg", "t", place.alias("i"))
    other = node.select(F.col("a").alias("b"), F.col("deg").alias("deg_b"), F.col("t").alias("s"), F.col("i").alias("j"))
    edges = graph.join(node, "a").join(other, "b").select("t", "s", "i", "j", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg_b"))).alias("w"))
    cells = write_state(edges.groupBy("t", "s").applyInArrow(_packed_cell, "t int, s int, cell binary, takes binary"),
                        "cells", rows=_BLOCK_ROWS)
    drop_state(graph)
    takes = cells.where("takes is not null").select("s", "t", F.col("takes").alias("data"))
    products = cells.select("t", F.when(F.col("t") == F.col("s"), -1).otherwise(F.col("s")).alias("s"),
                            F.lit(0).alias("kind"), F.col("cell").alias("data"))
    # start: numbers from md5, the same everywhere
    draw = [F.conv(F.substring(F.md5(F.concat_ws(":", F.col("a").cast("string"), F.lit(str(j))).cast("binary")), 1, 8), 16, 10)
            .cast("double") / 4294967296.0 - 0.5 for j in range(k)]
    start = write_state(degree.select("a", block.alias("s"), F.array(*draw).alias("v")).groupBy("s")
                        .applyInArrow(_packed_nodes(k), "s int, ids binary, v binary"), "block", rows=_BLOCK_ROWS)
    now, turn, last = start, np.eye(k), None
    for _ in range(max_iter):
        sent = (now.select("s", F.lit(-1).alias("t"), F.col("v").alias("data")).union(takes).repartition("s")
                .sortWithinPartitions("s", "t").mapInArrow(_sent(k), "t int, s int, kind int, data binary"))
        step = write_state(products.union(sent).repartition("t").sortWithinPartitions("t", "s", "kind")
                           .mapInArrow(_moved(k, turn), "s int, v binary, gram binary"), "block", rows=_BLOCK_ROWS)
        parts = sorted((r["s"], bytes(r["gram"])) for r in step.select("s", "gram").collect())
        gram = sum((np.frombuffer(g).reshape(k, k) for _, g in parts), np.zeros((k, k)))
        if now is not start:
            drop_state(now)
        values, vectors = np.linalg.eigh(gram)
        now, turn = step, vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
        size = np.sqrt(np.maximum(values[::-1], 0.0))
        if last is not None and np.abs(size - last).max() < tol:
            break
        last = size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in zip(batch["ids"], batch["v"]):
                v = np.frombuffer(v.as_buffer(), "<f8").reshape(-1, k) @ turn
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids.as_buffer(), "<i8")),
                     pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * k, v.reshape(-1))], ["a", "v"])

    before = now
    now = write_state(start.select("s", "ids").join(now.select("s", "v"), "s").select("ids", "v")
                      .mapInArrow(rows, "a long, v array<double>"), "block", rows=_BLOCK_ROWS)
    for state in {id(x): x for x in (start, before, cells, degree)}.values():
        drop_state(state)
    unit = now.select(F.col("a").alias("doc_id"), V.l2_normalize("v").alias("vec"))
    # start from points far apart: each next centre is the point least like those chosen so far
    chosen = [list(unit.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).select("vec").first()["vec"])]
    while len(chosen) < k:
        like = F.greatest(*[F.aggregate(F.zip_with("vec", F.array(*map(F.lit, c)), lambda x, y: x * y), F.lit(0.0),
                                        lambda s, x: s + x) for c in chosen], F.lit(-2.0))
        chosen.append(list(unit.orderBy(F.round(like, 9), "doc_id").select("vec").first()["vec"]))
    start = spark.createDataFrame(list(enumerate(chosen)), "cluster_id long, vec array<double>")
    return kmeans(unit, k, centres=start)[0]


def contingency(assign: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, label, n): equi-join on doc_id, then one grouped count."""
    return (assign.join(labels, "doc_id").groupBy("cluster_id", "label")
                  .agg(F.count(F.lit(1)).alias("n")))


def scores(cont: DataFrame, signed: bool = True) -> DataFrame:
    """(n, purity, entropy). purity = sum_c max_l n_cl / N. entropy = sum_c (n_c/N) *
    sum_l p log2 p with p = n_cl / n_c (<= 0 when ``signed``, as the
    comparison prints it; ``signed=False`` flips it to the usual >= 0)."""
    per = (cont.groupBy("cluster_id")
               .agg(F.sum("n").alias("nc"), F.max("n").alias("mx"),
                    F.sum(F.col("n") * F.log2("n")).alias("s_nlogn")))
    # sum_l p log2 p = (sum_l n log2 n) / n_c - log2 n_c
    h = F.col("s_nlogn") / F.col("nc") - F.log2("nc")
    out = per.agg(F.sum("nc").alias("n"), F.sum("mx").alias("mx"), F.sum(F.col("nc") * h).alias("wh"))
    ent = F.col("wh") / F.col("n")
    return out.select("n", (F.col("mx") / F.col("n")).alias("purity"),
                      (ent if signed else -ent).alias("entropy"))


def majority_label(cont: DataFrame) -> DataFrame:
    """(cluster_id, label, n): most frequent label per cluster, ties to the smaller label."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), F.asc("label"))
    return cont.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def top_terms(centres: DataFrame, n: int = 20, group: str = "cluster_id") -> DataFrame:
    """(group, rank, term, weight): the ``n`` heaviest terms of each centre
    (long layout (group, term, weight), zero weights absent)."""
    w = Window.partitionBy(group).orderBy(F.desc("weight"), F.asc("term"))
    return centres.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
