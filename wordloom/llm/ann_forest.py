"""Nearest neighbours by inner product: a forest of random-projection trees, one priority queue per query, exact scores.

Vectors are lifted to one more dimension, so that all have the largest norm and
the largest inner product is the smallest angle. The trees are grown from a
bounded sample; every vector is sorted into one leaf of each tree. A query walks all
trees from one queue, the least margin it has crossed first, until it has
opened its number of leaves; each leaf's vectors are then scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import keyed_groups, write_state
from wordloom.llm.vectors import matrix, vector_classes, vector_rows

#: Vectors that the trees are grown from; all are indexed.
SAMPLE = 16384


class Tree:
    """Splits in an array: normal and offset, children; a negative child -1 - leaf is a leaf."""

    def __init__(self, x: np.ndarray, leaf: int, random: np.random.RandomState):
        self.normals, self.offsets, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(x, leaf, random)
        self.normals = np.array(self.normals).reshape(-1, x.shape[1])
        self.offsets = np.array(self.offsets)

    def _grow(self, x, leaf, random) -> int:
        if len(x) > leaf:
            a, b = x[random.randint(len(x), size=2)]
            normal = a - b if (a != b).any() else random.standard_normal(x.shape[1])
            normal = normal / np.sqrt(normal @ normal)
            side = x @ normal
            offset = float(np.median(side))
            up = side > offset
            if 0 < up.sum() < len(x):
                node = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append(None)
                self.children[node] = (self._grow(x[~up], leaf, random), self._grow(x[up], leaf, random))
                return node
        self.leaves += 1
        return -self.leaves

    def sort(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf."""
        at = np.full(len(x), self.root)
        children = np.array(self.children, np.int64).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            up = np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.offsets[node]
            at[inner] = children[node, up.astype(np.int64)]
        return -at - 1


def open_leaves(trees: list[Tree], query: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The first ``visits`` (tree, leaf) that one queue over all trees gives, the least crossed margin first."""
    margins = [t.normals @ query - t.offsets if len(t.offsets) else t.offsets for t in trees]
    queue = [(0.0, i, t.root) for i, t in enumerate(trees)]
    found = []
    while queue and len(found) < visits:
        crossed, i, node = heapq.heappop(queue)
        while node >= 0:
            m = margins[i][node]
            far, node = trees[i].children[node][::-1] if m <= 0 else trees[i].children[node]
            heapq.heappush(queue, (max(crossed, abs(m)), i, far))
        found.append((i, -node - 1))
    return found


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))[:, None]])


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch["vec"].to_pylist()
        norm = [float(np.linalg.norm(np.frombuffer(x, np.float64))) for x in raw]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) // 8 for x in raw], pa.int32()), pa.array(norm)],
                                         ["dim", "norm"])


def _place(forests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["vec"].to_pylist()
            sizes = np.array([len(x) // 8 for x in raw])
            for dim, (largest, trees) in forests.value.items():
                at = np.flatnonzero(sizes == dim)
                if len(at):
                    x = _lift(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(-1, dim), largest)
                    own = batch.take(pa.array(at))
                    for t, tree in enumerate(trees):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), v, np.int32)) for v in (dim, t)]
                            + [pa.array(tree.sort(x).astype(np.int32)), own["vec"], own["ids"]],
                            ["dim", "t", "leaf", "vec", "ids"])

    return run


def _visit(forests, effort: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, raw in enumerate(batch["vec"].to_pylist()):
                dim = len(raw) // 8
                if dim not in forests.value:
                    continue
                trees = forests.value[dim][1]
                q = np.append(np.frombuffer(raw, np.float64), 0.0)
                visits = int(np.ceil(effort * sum(t.leaves for t in trees)))
                rows += [(row, dim, t, leaf) for t, leaf in open_leaves(trees, q / np.linalg.norm(q), visits)]
            row, dim, t, leaf = np.array(rows, np.int64).reshape(-1, 4).T
            own = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (dim, t, leaf)), own["vec"],
                                              own["vec_id"]], ["dim", "t", "leaf", "vec", "query_id"])

    return run


def _score(k: int):
    """Cells sorted with their index rows first: each query's best k of the cell."""

    def best(pool, members, queries, names):
        out = []
        for lo in range(0, len(names), 512):
            q = queries[lo: lo + 512]
            score = q @ pool.T
            take = min(k + 1, len(pool))  # classes; the query's own may be among them
            top = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(pool) else \
                np.broadcast_to(np.arange(len(pool)), score.shape)
            level = np.take_along_axis(score, top, axis=1).min(axis=1)
            for r in range(len(q)):
                near = top[r]
                if take < len(pool) and (tied := (score[r] == level[r]).sum()) > 1:
                    near = np.flatnonzero(score[r] >= level[r])
                exact = np.einsum("ij,j->i", pool[near], q[r])
                got = [(-s, i) for s, c in zip(exact, near) for i in members[c] if i != names[lo + r]]
                got.sort()
                out += [(names[lo + r], i, -s) for s, i in got[:k]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, *_), table in keyed_groups(batches, ["dim", "t", "leaf", "ib", "qb"]):
            query = np.array(table["query_id"].is_valid())
            index, asked = table.filter(pa.array(~query)), table.filter(pa.array(query))
            if not index.num_rows or not asked.num_rows:
                continue
            rows = best(matrix(index["vec"], dim), index["ids"].to_pylist(), matrix(asked["vec"], dim),
                        asked["query_id"].to_pylist())
            if rows:
                q, v, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s)],
                                                 ["query_id", "vec_id", "score"])

    return run


def grow(groups: DataFrame, trees: int, leaf: int, seed: int) -> dict:
    """{dim: (largest norm, trees)} from a sample of at most SAMPLE classes, those with the smallest hash."""
    norms = groups.select("vec").mapInArrow(_norms, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("m"))
    largest = {r["dim"]: r["m"] for r in norms.collect()}  # one row per length of vector
    sample = [r["vec"] for r in groups.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
    out = {}
    for dim, m in sorted(largest.items()):
        own = [np.frombuffer(x, np.float64) for x in sample if len(x) == 8 * dim]
        x = _lift(np.array(own).reshape(-1, dim), m)
        random = np.random.RandomState([seed, dim])
        out[dim] = (m, [Tree(x, leaf, random) for _ in range(trees)])
    return out


def nearest_neighbours(embeddings: DataFrame, queries: DataFrame, k: int = 20, trees: int = 6, leaf: int = 256,
                       effort: float = 0.25, block: int = 1024, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by inner product in double precision.

    Both tables have vec_id and embedding (other columns are ignored). A query
    opens ``effort`` of all leaves; a query never finds its own vec_id. Ties go to the smaller vec_id.
    With fewer than k candidates found, fewer rows. Null, empty and zero vectors, those with null
    or non-finite components, and rows with a null vec_id take no part on either
    side; vectors of another length than the query's are no candidates. Equal
    vectors are indexed once, with their k + 1 smallest vec_ids, more than a
    query can return; repeated rows count once. Empty tables give no rows.

    Leaves of any size are dealt out as cells of about ``block`` vectors and 4 * ``block`` queries.
    """
    spark = embeddings.sparkSession
    groups = vector_classes(vector_rows(embeddings), ids=k + 1)
    asked = vector_rows(queries).where("key is not null").select("vec_id", "vec").dropDuplicates(["vec_id", "vec"])
    forests = spark.sparkContext.broadcast(grow(groups, trees, leaf, seed))
    place = ["dim", "t", "leaf"]
    index = write_state(groups.select("vec", "ids").mapInArrow(
        _place(forests), "dim int, t int, leaf int, vec binary, ids array<long>"), "index")
    visits = write_state(asked.mapInArrow(_visit(forests, effort), "dim int, t int, leaf int, vec binary, query_id long"),
                         "visits")
    sizes = (index.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(block)).alias("ni"))
             .join(visits.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(4 * block)).alias("nq")), place))
    own = lambda n: F.pmod(F.xxhash64("vec"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(sizes, place).withColumn("ib", own("ni")).withColumn("qb", every("nq")).select(
        *place, "ib", "qb", "vec", "ids", F.lit(None).cast("long").alias("query_id"))
    right = (visits.join(sizes, place).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")))
             .withColumn("ib", every("ni"))
             .select(*place, "ib", "qb", "vec", F.lit(None).cast("array<long>").alias("ids"), "query_id"))
    cell = [*place, "ib", "qb"]
    found = (left.union(right).repartition(*cell).sortWithinPartitions(*cell)
             .mapInArrow(_score(k), "query_id long, vec_id long, score double"))
    # k in each tree hold the k best; the limit is applied in every task before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k * trees)
    single = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
