"""Hard negatives from rotated one-bit codes: popcount estimates, Cauchy-Schwarz intervals, integer scores.

A row's integer vector is rotated and cut to its signs; the code is stored with its
alignment, the inner product of the vector with the code's unit vector. What the code leaves
over is coded in the same way under a further rotation, ``LEVELS`` times. An anchor is rotated
too and quantised to bit planes, so its inner product with a code is a sum of
popcounts, up to a known quantisation error. A row's score then lies in

    sum of alignment * popcount product  +-  (errors + |rest| * |anchor outside the last code|)

by Cauchy-Schwarz, with no chance of an exception. Rows whose interval cannot reach the
result are dropped level by level; the rest are scored by integer inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import blobs, keyed_groups, write_state

LEVELS, PLANES = 3, 8
#: Rows and anchors in a cell.
BLOCK, ANCHORS = 8192, 1024
ROW = "vec_id long, label int, dim int, vec binary, codes binary, sizes binary"
_rotations: dict[int, list[np.ndarray]] = {}


def rotations(dim: int) -> list[np.ndarray]:
    """An orthogonal matrix per level, the same in every task."""
    if dim not in _rotations:
        _rotations[dim] = [np.linalg.qr(np.random.RandomState([11, dim, level]).standard_normal((dim, dim)))[0]
                           for level in range(LEVELS)]
    return _rotations[dim]


def _bits(flags: np.ndarray) -> np.ndarray:
    """(..., dim) flags as (..., words) 64-bit words."""
    raw = np.packbits(flags, axis=-1, bitorder="little")
    short = -raw.shape[-1] % 8
    raw = np.concatenate([raw, np.zeros((*raw.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(raw).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors as (n, LEVELS, words) codes and (n, 2 * LEVELS + 1) sizes: alignments, norms of the rests, own norm."""
    rest, dim = x.astype(np.float64), x.shape[1]
    codes, aligned, left = [], [], []
    own = np.sqrt(np.einsum("ij,ij->i", rest, rest))
    for turn in rotations(dim):
        z = rest @ turn.T
        up = z >= 0
        a = np.abs(z).sum(axis=1) / np.sqrt(dim)
        rest = rest - (a / np.sqrt(dim))[:, None] * (np.where(up, 1.0, -1.0) @ turn)
        codes.append(_bits(up))
        aligned.append(a)
        left.append(np.sqrt(np.einsum("ij,ij->i", rest, rest)))
    return np.stack(codes, axis=1), np.stack([*aligned, *left, own], axis=1)


class Anchor:
    """An anchor's bit planes at every level."""

    def __init__(self, q: np.ndarray):
        q = q.astype(np.float64)
        self.dim, self.norm, self.levels = len(q), float(np.sqrt(q @ q)), []
        for turn in rotations(self.dim):
            z = turn @ q
            low = float(z.min())
            step = (float(z.max()) - low) / ((1 << PLANES) - 1) or 1.0
            u = np.rint((z - low) / step).astype(np.int64)
            near = low + step * u
            planes = _bits((u >> np.arange(PLANES)[:, None]) & 1 == 1)
            self.levels.append((low, step, planes, float(near.sum()), float(np.sqrt(((z - near) ** 2).sum()))))

    def intervals(self, codes: np.ndarray, sizes: np.ndarray):
        """Per level (lower, upper) bounds of the scores, of the rows still wanted: a generator that is sent the kept rows."""
        estimate, errors = np.zeros(len(codes)), np.zeros(len(codes))
        for level, (low, step, planes, total, error) in enumerate(self.levels):
            code = codes[:, level]
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            weighed = np.zeros(len(code), np.int64)
            for j, plane in enumerate(planes):
                weighed += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << j
            product = (2 * (low * ones + step * weighed) - total) / np.sqrt(self.dim)
            estimate = estimate + sizes[:, level] * product
            errors = errors + sizes[:, level] * error
            inside = np.maximum(np.abs(product) - error, 0.0)
            outside = np.sqrt(np.maximum(self.norm ** 2 - inside ** 2, 0.0))
            width = errors + sizes[:, LEVELS + level] * outside + 1e-9 * (sizes[:, -1] * self.norm + 1)
            keep = yield estimate - width, estimate + width
            codes, sizes, estimate, errors = codes[keep], sizes[keep], estimate[keep], errors[keep]


class Cell:
    """The rows of a cell; equal rows count once."""

    def __init__(self, rows: pa.Table, dim: int):
        rows = rows.combine_chunks()
        ids, label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        if len(np.unique(ids)) < len(ids):
            seen = {row: i for i, row in enumerate(zip(ids.tolist(), label.tolist(), rows["vec"].to_pylist()))}
            rows = rows.take(pa.array(sorted(seen.values())))
            ids, label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.ids, self.label = ids, label
        read = lambda name, kind, *shape: np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(len(ids), *shape)
        self.x, self.sizes = read("vec", "<i4", dim), read("sizes", "<f8", 2 * LEVELS + 1)
        self.codes = read("codes", "<u8", LEVELS, -(-dim // 64)).astype(np.uint64)

    def scored(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.x[at].astype(np.int64), q)

    def positives(self, name: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the first ``k`` other rows of the same label."""
        at = np.flatnonzero((self.label == label) & (self.ids != name))
        bounds = Anchor(q).intervals(self.codes[at], self.sizes[at])
        keep = None
        for _ in range(LEVELS):
            lower, upper = bounds.send(keep)
            keep = np.ones(len(at), bool)
            if len(at) > k:
                keep = upper >= np.partition(lower, len(at) - k)[len(at) - k]
            at = at[keep]
        return self._first(at, self.scored(at, q), k)

    def _first(self, at: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
        order = np.lexsort((self.ids[at], -score))[:k]
        return list(zip(self.ids[at[order]].tolist(), score[order].tolist()))

    def negatives(self, label: int, q: np.ndarray, goals: list[tuple[int, int]], k: int, share: int) -> list[tuple]:
        """(positive, its score, negative, score): the first ``k`` rows of other labels in each positive's range."""
        goals = [(p, s, -(-share * s // 100)) for p, s in goals if s >= 0]
        if not goals:
            return []
        at = np.flatnonzero(self.label != label)
        bounds = Anchor(q).intervals(self.codes[at], self.sizes[at])
        keep = None
        for _ in range(LEVELS):
            lower, upper = bounds.send(keep)
            keep = np.zeros(len(at), bool)
            for _, high, low in goals:
                sure = lower[(lower >= low) & (upper <= high)]  # k of these are enough
                least = max(low, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else low
                keep |= (upper >= least) & (lower <= high)
            at = at[keep]
        score = self.scored(at, q)
        out = []
        for p, high, low in goals:
            fits = (score >= low) & (score <= high)
            out += [(p, high, i, s) for i, s in self._first(at[fits], score[fits], k)]
        return out


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[int, list] = {}
        ids, labels = batch["vec_id"].to_pylist(), batch["label"].to_pylist()
        for i, x in enumerate(batch["embedding"]):
            if x.values is None or x.values.null_count or ids[i] is None or labels[i] is None:
                continue
            v = np.asarray(x.values, np.float64)
            if np.isfinite(v).all():
                by.setdefault(len(v), []).append((ids[i], labels[i], v))
        for dim, rows in by.items():
            most = min(2**31 - 1, isqrt(2**62 // max(dim, 1)))
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(256 * np.array([v for *_, v in rows])), -most, most).astype("<i4")
            codes, sizes = encode(x) if dim else (np.zeros((len(rows), 0), np.uint64), np.zeros((len(rows), 2 * LEVELS + 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, *_ in rows], pa.int64()), pa.array([y for _, y, _ in rows], pa.int32()),
                 pa.array(np.full(len(rows), dim, np.int32)), blobs([v.tobytes() for v in x]),
                 blobs([c.astype("<u8").tobytes() for c in codes]), blobs([s.astype("<f8").tobytes() for s in sizes])],
                ["vec_id", "label", "dim", "vec", "codes", "sizes"])


def coded_rows(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, as integers with their codes and sizes; labels changed as the mining asks for."""
    label = F.col("label").cast("int")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    return write_state(rows.mapInArrow(_integers, ROW).where("dim > 0"), "coded")


def _cells(rows: DataFrame, asked: DataFrame, goals: str) -> DataFrame:
    """Rows and anchors dealt to cells (dim, rb, ab) of about BLOCK rows and ANCHORS anchors."""
    counts = (rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("nr"))
              .join(asked.groupBy("dim").agg(F.ceil(F.count("*") / ANCHORS).alias("na")), "dim"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (rows.join(counts, "dim").withColumn("rb", own("vec_id", "nr")).withColumn("ab", every("na"))
            .select("dim", "rb", "ab", "vec_id", "label", "vec", "codes", "sizes", F.lit(None).cast(goals).alias("goals"),
                    F.lit(False).alias("anchor")))
    right = (asked.join(counts, "dim").withColumn("ab", own("vec_id", "na")).withColumn("rb", every("nr"))
             .select("dim", "rb", "ab", "vec_id", "label", "vec", F.lit(None).cast("binary").alias("codes"),
                     F.lit(None).cast("binary").alias("sizes"), F.col("goals").cast(goals), F.lit(True).alias("anchor")))
    cell = ["dim", "rb", "ab"]
    return left.union(right).repartition(*cell).sortWithinPartitions(*cell)


def _per_cell(find, columns: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, *_), table in keyed_groups(batches, ["dim", "rb", "ab"]):
            anchor = table["anchor"].combine_chunks()
            rows, asked = table.filter(pc.invert(anchor)), table.filter(anchor)
            if not rows.num_rows or not asked.num_rows:
                continue
            cell, out = Cell(rows, dim), []
            for name, label, vec, goals in zip(*(asked[c].to_pylist() for c in ("vec_id", "label", "vec", "goals"))):
                out += find(cell, name, label, np.frombuffer(vec, "<i4").astype(np.int64), goals)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*out), columns)],
                                                 [name for name, _ in columns])

    return run


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
                   share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives per anchor and positive.

    ``embeddings`` has vec_id, embedding and label (other columns are ignored).
    Rows with a null vec_id or label, or a vector that is null, empty or holds null or
    non-finite components take no part; zero vectors do. Where vec_id is divisible by 7 the label becomes
    (label + 1) % 10. Components become floor(256 * x); those so large that an inner product could leave 64
    bits are held at the last value that cannot. Rows are compared with anchors of the same length only.

    Anchors are the rows whose vec_id is divisible by ``every``; their positives the first ``positives`` rows of
    another vec_id and the same label by integer inner product, ties by vec_id; returned are the first
    ``negatives`` rows of other labels whose score is at least ``share`` per cent of the positive's and not above
    it. Fewer rows where there are fewer; none for a negative positive_score. Repeated rows count once; rows that
    share a vec_id but differ are rows of their own, and the anchor is the least of them by (label, vector).
    Empty tables give no rows.
    """
    rows = coded_rows(embeddings)
    least = F.min(F.struct("label", "dim", "vec")).alias("a")
    anchors = write_state(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(least)
                          .select("vec_id", "a.label", "a.dim", "a.vec"), "anchors")
    pairs = "array<struct<id:bigint,score:bigint>>"

    def near(cell, name, label, q, goals):
        return [(name, i, s) for i, s in cell.positives(name, label, q, positives)]

    def hard(cell, name, label, q, goals):
        return [(name, *r) for r in cell.negatives(label, q, [(g["id"], g["score"]) for g in goals], negatives, share)]

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    kinds = [(n, pa.int64()) for n in names]
    found = (_cells(rows, anchors.withColumn("goals", F.lit(None)), pairs)
             .mapInArrow(_per_cell(near, kinds[:3]), "anchor_id long, positive_id long, positive_score long"))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = (found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
              .groupBy(F.col("anchor_id").alias("vec_id"))
              .agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("goals")))
    asked = write_state(anchors.join(chosen, "vec_id"), "asked")
    mined = (_cells(rows, asked, pairs).mapInArrow(_per_cell(hard, kinds), ", ".join(f"{n} long" for n in names)))
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return (mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


HARD_NEGATIVES_SQL = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
