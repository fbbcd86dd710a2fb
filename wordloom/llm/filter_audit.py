"""Filter interaction audit: 32-bit words of surviving filter subsets, summed by carry-save positional popcounts.

Five filters have 32 subsets. A document's word has bit s set where the document survives every filter of
subset s. The number of survivors of each subset, per part and label, is then the
positional popcount of the words, and every figure of every filter order is a
difference of two such numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import by_bytes, write_state

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: word[m]: bit s is set where failing the filters of m leaves the document in after subset s
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], np.uint32)
_UPPER = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20
#: The subset of one letter of filter_order, and of those before a step.
_BIT = "shiftleft(1, ascii(substr(filter_order, {j}, 1)) - ascii('A'))"
#: What the step's filter removes, over all orders: a subset s stands before it in |s|! (4 - |s|)! of them.
_SHAPLEY = (f"aggregate(filter(sequence(0, {SUBSETS - 1}), s -> s & own = 0), 0L, (v, s) -> v + "
            f"array({', '.join(str(factorial(i) * factorial(4 - i)) for i in range(5))})[bit_count(s)] * (whole[s] - whole[s | own]))")
_BEFORE = f"aggregate(filter(sequence(1, {len(FILTERS)}), j -> j < step), 0, (m, j) -> m + {_BIT.format(j='j')})"


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about a MB, cut at white space, so that its words never stand in memory at once."""
    at = 0
    while at < len(raw):
        cut = _GAP.search(raw, at + _PIECE) if len(raw) - at > _PIECE else None
        to = cut.start() if cut else len(raw)
        yield raw[at:to]
        at = to


def text_failures(raw: bytes, points: int) -> int:
    """Bits 0 to 3 where a text fails filters A to D."""
    n, seen = 0, set()
    for piece in _pieces(raw):
        words = piece.split()  # bytes split at exactly \\x20 and \\x09-\\x0D
        n += len(words)
        seen.update(words)
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    return ((n < 200) | (100 * len(seen) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2
            | (_MARKS.search(raw) is not None) << 3)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        digests, masks = [], []
        for text in batch["text"].to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            masks.append(text_failures(raw, len(text or "")))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                                         ["doc_id", "part", "digest", "mask"])


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set: carry-save adders turn three words into a sum and a carry word."""
    counts, weight, level = np.zeros(SUBSETS, np.int64), 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) >= 3:
            m = len(level) // 3
            a, b, c, rest = level[:m], level[m:2 * m], level[2 * m:3 * m], level[3 * m:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, rest])
        counts += weight * ((level[:, None] >> np.arange(SUBSETS, dtype=np.uint32)) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        level = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight *= 2
    return counts


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, good, toxic, n): survivors of each subset, summed per batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = WORDS[batch["mask"].to_numpy()]
        part = batch["part"].dictionary_encode()
        kind = (part.indices.to_numpy().astype(np.int64) * 4 + batch["good"].to_numpy(zero_copy_only=False) * 2
                + batch["toxic"].to_numpy(zero_copy_only=False))
        order = np.argsort(kind, kind="stable")
        kinds, first = np.unique(kind[order], return_index=True)
        sums = [positional_popcount(x) for x in np.split(words[order], first[1:])]
        yield pa.RecordBatch.from_arrays(
            [part.dictionary.take(pa.array(kinds // 4)), pa.array(kinds // 2 % 2 == 1), pa.array(kinds % 2 == 1),
             pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["part", "good", "toxic", "n"])


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): which filters each document fails, one row per row of ``docs``."""
    rows = write_state(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                                   F.col("text").cast("string").alias("text"))
                       .mapInArrow(_judge, "doc_id long, part string, digest binary, mask int"), "judged")
    # joined on doc_id, so that a text that very many documents share is no hot key
    firsts = (rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
              .withColumn("first", F.lit(True)))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(firsts, ["doc_id", "digest"], "left")
            .select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).cast("int").alias("mask")))


def subset_survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, whole, good, toxic): per part the survivors of each of the 32 subsets (bit i: filter i of ABCDE)
    of all documents, of those with quality 1, and of those with toxic 1; arrays of 32 numbers."""
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    rows = document_masks(docs).join(marks, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    sums = rows.mapInArrow(_survivors, "part string, good boolean, toxic boolean, n array<long>")
    total = lambda where: F.sum(F.when(where, F.col("survivors")).otherwise(0))
    by_subset = (sums.select("part", "good", "toxic", F.posexplode("n").alias("subset", "survivors")).groupBy("part", "subset")
                 .agg(total(F.lit(True)).alias("whole"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic")))
    rows = by_subset.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "whole", "good", "toxic"))).alias("s"))
    return rows.select("part", "s.whole", "s.good", "s.toxic")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, all from the survivors of the filters' subsets.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns
    are ignored. A part is a lang, null and empty alike. Null texts are empty; empty texts are equal to each other.
    Filter E fails a document whose text a smaller doc_id has too (equal 128-bit digests of the whole texts);
    rows with a null doc_id have no smaller one, and are none themselves. Repeated rows count each; a
    document is good (toxic) if any label row of its doc_id says so; null marks say nothing. An empty table gives no rows.
    """
    parts = write_state(subset_survivors(docs, labels), "survivors")
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    row = (parts.withColumn("filter_order", F.explode(orders))
           .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
           .withColumn("before", F.expr(_BEFORE)).withColumn("own", F.expr(_BIT.format(j="step"))))
    at = lambda name, subset: F.element_at(F.col(name), subset + 1)
    before, own = F.col("before"), F.col("own")
    after = before + own
    removed = at("whole", before) - at("whole", after)
    full = SUBSETS - 1
    return row.select(
        "part", "filter_order", "step", at("whole", after).alias("kept"), removed.alias("removed"),
        (at("whole", F.lit(0)) - at("whole", own) - removed).alias("redundant"),
        (at("whole", F.lit(full) - own) - at("whole", F.lit(full))).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"),
        (at("toxic", before) - at("toxic", after)).alias("toxic_lost"),
        F.expr(_SHAPLEY).alias("shapley"))


FILTER_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (
  SELECT doc_id, part,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
g AS MATERIALIZED (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM f a, f b, f c, f d, f e
  WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i
    AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
s AS (
  SELECT array_to_string(list_transform(p, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, f.i AS step, p[f.i] AS own,
         p[1:f.i - 1] AS before FROM o, f),
r AS (
  SELECT part, filter_order, step, own,
    len(list_filter(before, lambda x: fails[x])) > 0 AS gone, fails[own] AS hit,
    len(list_filter(fails, lambda x: x)) = 1 AS alone, good, toxic, n
  FROM g, s),
t AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (hit AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM t"""
