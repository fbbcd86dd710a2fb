"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import by_bytes, write_state

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times a source's size
SHARDS, BUCKETS = 8, 4096
STRIDE = 2147483647  # a prime, so j -> j * STRIDE mod n visits every block once


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess is shared again by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    for i in sorted(open_, key=lambda i: most * sizes[i] / weights[i]):
        rate = left / sum(weights[j] for j in sorted(open_))
        if rate * weights[i] <= most * sizes[i]:
            for j in sorted(open_):
                out[j] = rate * weights[j]
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        open_.discard(i)
    return out


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients weight / (2 seats + 1), ties to the earlier one, none above its cap.

    Starts from the rounded proportional share and moves single seats from
    there, which ends at the same allocation as granting all seats one by one.
    """
    total, seats = sum(weights), min(seats, sum(c for w, c in zip(weights, caps) if w > 0))
    got = [min(c, int(w * seats / total + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps)]
    ahead = [(-w / (2 * q + 1), i) for i, (w, q, c) in enumerate(zip(weights, got, caps)) if w > 0 and q < c]
    last = [(w / (2 * q - 1), -i) for i, (w, q) in enumerate(zip(weights, got)) if q]
    heapq.heapify(ahead)
    heapq.heapify(last)
    short = seats - sum(got)
    while short > 0:
        _, i = heapq.heappop(ahead)
        got[i] += 1
        short -= 1
        if got[i] < caps[i]:
            heapq.heappush(ahead, (-weights[i] / (2 * got[i] + 1), i))
    while short < 0:
        _, i = heapq.heappop(last)
        i = -i
        got[i] -= 1
        short += 1
        if got[i]:
            heapq.heappush(last, (weights[i] / (2 * got[i] - 1), -i))
    return got


def _plan(cells: list, block: int, seed: int):
    """Rows of PLAN for (source, shard, tokens) cells."""
    by: dict = {}
    for source, shard, tokens in cells:
        by.setdefault(source, {})[shard] = tokens
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(by[s].values()) for s in names]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]
    goals = targets(sizes, weights)
    blocks = [{h: max(1, (t + block // 2) // block) if t else 0 for h, t in by[s].items()} for s in names]
    counts = [sum(b.values()) for b in blocks]
    wanted = [g * n / s if s else 0.0 for g, n, s in zip(goals, counts, sizes)]
    quotas = sainte_lague(wanted, round(sum(wanted)), [MOST * n for n in counts])
    for name, size, goal, quota, have in zip(names, sizes, goals, quotas, blocks):
        shards = sorted(have)
        split = sainte_lague([float(have[h]) for h in shards], quota, [MOST * have[h] for h in shards])
        for h, q in zip(shards, split):
            draw = hashlib.md5(f"{seed}:{name!r}:{h}".encode("utf-8", "surrogatepass")).digest()
            yield name, h, size, goal, have[h], q, int.from_bytes(draw[:7], "little") % max(have[h], 1)


PLAN = ("_mix_name string, _mix_place int, _mix_source_size long, _mix_target double, _mix_blocks long, _mix_quota long, "
        "_mix_shift long")


def mix_sources(docs: DataFrame, block: int = 256, seed: int = 7) -> DataFrame:
    """``docs`` plus size, source_size, target, taken and spans (array of start, stop, copies, in words).

    Needs doc_id, text and source; other columns stay (columns of the five new
    names are replaced). A document's size is its number of words
    ``[^\\x20\\x09-\\x0D]+`` (null or empty text: 0). Sources by code point, null last,
    weigh 5, 2, 1, repeating; the targets share the corpus' words by weight, up
    to 3 times a source's size.

    In each of 8 shards (by a hash of the row) a source's documents lie on
    one line of words in seeded order, cut into blocks of ``block`` words (the last
    takes what is left over). Sources get numbers of blocks by Sainte-Laguë, then each source's shards do.
    A shard takes all its blocks as often as its quota allows and the rest
    by a seeded permutation, so no block, and no document, is taken more than 3
    times. Empty documents are taken 0 times. The result depends on the rows
    alone, not on their partitions; rows alike in doc_id and size may swap
    places. An empty table gives no rows.

    The driver holds one row for each source and shard. Running totals are taken
    inside 4,096 hash buckets, so a source with a third of all rows has thousands of groups.
    """
    new = ["size", "source_size", "target", "taken", "spans"]
    return _mix(docs, block, seed).select(*(c for c in docs.columns if c not in new), *(f"_mix_{c}" for c in new)) \
        .withColumnsRenamed({f"_mix_{c}": c for c in new})


def _mix(docs: DataFrame, block: int, seed: int) -> DataFrame:
    """``docs`` and the columns of ``mix_sources`` under names that begin with _mix_."""
    spark, m = docs.sparkSession, lambda c: F.col(f"_mix_{c}")
    sized = (docs.withColumn("_mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
             .withColumn("_mix_source", F.col("source").cast("string"))
             .withColumn("_mix_none", F.col("_mix_source").isNull())  # so that plain equality finds a null source
             .withColumn("_mix_source", F.coalesce("_mix_source", F.lit("")))
             .withColumn("_mix_h", F.xxhash64(F.lit(seed), "doc_id", "_mix_size"))
             .withColumn("_mix_bucket", F.pmod("_mix_h", F.lit(BUCKETS)).cast("int"))
             .withColumn("_mix_shard", F.pmod("_mix_bucket", F.lit(SHARDS)).cast("int")))
    totals = write_state(sized.groupBy("_mix_source", "_mix_none", "_mix_bucket").agg(F.sum("_mix_size").alias("tokens")),
                         "totals")
    shard = F.pmod("_mix_bucket", F.lit(SHARDS))
    named = F.when(~F.col("_mix_none"), F.col("_mix_source"))
    cells = totals.groupBy(named.alias("s"), shard.alias("shard")).agg(F.sum("tokens"))
    plan = spark.createDataFrame(list(_plan([tuple(r) for r in cells.collect()], block, seed)), PLAN)
    keys = ["_mix_source", "_mix_none", "_mix_bucket"]
    line = Window.partitionBy("_mix_source", "_mix_none", shard).orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("tokens").over(line), F.lit(0)).alias("_mix_base"))
    # the window and the join have the same keys: the rows with their texts travel once
    inside = Window.partitionBy(*keys).orderBy("_mix_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (sized.withColumn("_mix_before", F.coalesce(F.sum("_mix_size").over(inside), F.lit(0)))
              .join(starts, keys)
              .join(plan, named.eqNullSafe(m("name")) & (m("shard") == m("place"))))

    size, blocks, quota = m("size"), m("blocks"), m("quota")
    within = lambda p: F.least(F.floor(p / F.lit(block)), blocks - 1)

    def copies(j: Column) -> Column:
        place = F.pmod(F.pmod(F.lit(STRIDE), blocks) * j + m("shift"), blocks)
        return (F.expr("_mix_quota div _mix_blocks") + (place < quota % blocks).cast("long")).cast("int")

    def span(j: Column) -> Column:
        edge = F.when(j + 1 >= blocks, m("start") + size).otherwise((j + 1) * block)
        return F.struct((F.greatest(j * block, m("start")) - m("start")).alias("start"),
                        (F.least(edge, m("start") + size) - m("start")).alias("stop"), copies(j).alias("copies"))

    spans = F.when(size > 0, F.transform(F.sequence(within(m("start")), within(m("start") + size - 1)), span)).otherwise(
        F.array().cast("array<struct<start:bigint,stop:bigint,copies:int>>"))
    taken = F.aggregate("_mix_spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]) * s["copies"])
    return (placed.withColumn("_mix_start", m("base") + m("before")).withColumn("_mix_spans", spans)
            .withColumn("_mix_taken", taken))


_word = regex.compile(WORD)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        at, texts = [], []
        for row, (text, spans) in enumerate(zip(batch["text"].to_pylist(), batch["_mix_spans"].to_pylist())):
            joined: list[list[int]] = []
            for s in spans:
                if joined and joined[-1][1] == s["start"] and joined[-1][2] == s["copies"]:
                    joined[-1][1] = s["stop"]
                else:
                    joined.append([s["start"], s["stop"], s["copies"]])
            if len(joined) == 1:
                pieces = [text] * joined[0][2]
            else:
                edges = np.array([m.span() for m in _word.finditer(text)]) if joined else None
                pieces = [text[edges[a][0]: edges[b - 1][1]] for a, b, n in joined for _ in range(n)]
            at += [row] * len(pieces)
            texts += pieces
        out = batch.drop_columns(["_mix_spans"]).take(pa.array(at, pa.int64()))
        i = out.schema.get_field_index("text")
        yield out.set_column(i, out.schema.field(i), pa.array(texts, out.schema.field(i).type))


def mixed_rows(docs: DataFrame, block: int = 2048, seed: int = 7) -> DataFrame:
    """The mix itself: for every document the passages taken, each as often as it is taken, in the columns of ``docs``.

    A document all of whose words are taken alike keeps its text as it is; else its text
    is cut at the blocks' edges, between words. Documents that are not taken, or have no words, go.
    """
    mixed = _mix(docs, block, seed).where("_mix_taken > 0")
    return mixed.select(*docs.columns, "_mix_spans").mapInArrow(_cut, docs.schema)
