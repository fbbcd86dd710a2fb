"""Hierarchical weighted hash tree: region, rack, shard. DataFrame expressions only.

A shard draws ``-ln(u) / weight`` with u from a hash of (key, shard). An inner
node's draw is the smallest of its children's, which is again an exponential
draw whose rate is the subtree's weight, so a key descends to the region with
the smallest draw, then to that region's best rack, then to its best shard,
with probabilities in proportion to the weights at every level. Changing a
weight, or adding a shard, changes no draw outside the path to that shard: keys
only move between that shard and the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS_A_RACK, RACKS_A_REGION = 4, 2
BUCKETS = 1024


def tree(shards: int) -> list[list[list[int]]]:
    """Regions of racks of shards for shards 0 .. shards-1; a further shard never moves one."""
    racks = [list(range(i, min(i + SHARDS_A_RACK, shards))) for i in range(0, shards, SHARDS_A_RACK)]
    return [racks[i:i + RACKS_A_REGION] for i in range(0, len(racks), RACKS_A_REGION)]


def _hash(key: Column, rack: int) -> Column:
    return F.md5(F.concat_ws(":", key, F.lit(str(rack))).cast("binary"))


def _draw(digest: Column, place: int, weight: float) -> Column:
    word = F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("double")
    return -F.log((word + 0.5) / 4294967296.0) / F.lit(float(weight))


def _choose(digests: list[Column], shards: int, weights: list[float]) -> Column:
    """Descend: the best child is the one with the smallest (draw, number)."""

    def best(nodes: list[Column]) -> Column:
        return nodes[0] if len(nodes) == 1 else F.least(*nodes)

    regions = []
    for region in tree(shards):
        racks = []
        for rack in region:
            leaves = [F.struct(_draw(digests[s // SHARDS_A_RACK], s % SHARDS_A_RACK, weights[s]).alias("draw"),
                               F.lit(s).alias("shard")) for s in rack if weights[s] > 0]
            if leaves:
                racks.append(best(leaves))
        if racks:
            regions.append(best(racks))
    return best(regions)["shard"]


def assign_shards(docs: DataFrame, shards: int = 24, weights: list[float] | None = None,
                  grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs`` (doc_id, text).

    Law ``key``: doc_id and the shards (their number and weights) alone decide,
    so rows that share a doc_id share a shard; grown_shard is the shard with one
    more (of ``grown_weight``), either the same or the new one. A weight of 0 empties a shard; weights must
    not be negative and must not all be 0. size is the text's UTF-8 bytes plus 8
    and text_crc32 its unsigned CRC-32; a null text counts as empty, a null
    doc_id as a key of its own. slot numbers a shard's rows without gaps from 0:
    rows are numbered inside hash buckets of the shard, which start at running
    totals over the (shards x 1024) bucket counts, so no task sorts a whole
    shard. Repeated rows get slots of their own. Empty tables give no rows.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("one non-negative weight for each shard, not all 0")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    racks = -(-(shards + 1) // SHARDS_A_RACK)
    hashed = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"),
        *[_hash(key, r).alias(f"_h{r}") for r in range(racks)])
    digests = [F.col(f"_h{r}") for r in range(racks)]
    placed = hashed.select(
        "doc_id", "size", "text_crc32", _choose(digests, shards, weights).alias("shard"),
        _choose(digests, shards + 1, [*weights, grown_weight]).alias("grown_shard"),
        # digits of a hash that no draw uses; the checksum spreads rows that share a doc_id
        F.conv(F.substring(F.md5(F.concat_ws("/", "_key", F.col("text_crc32").cast("string")).cast("binary")), 1, 8),
               16, 10).cast("long").alias("_spread"))
    placed = placed.withColumn("_bucket", F.col("_spread") % BUCKETS)
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_spread", "doc_id", "text_crc32", "size")
    return (placed.join(starts, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.row_number().over(inside) - 1).alias("slot"), "grown_shard"))


def sharding_sql(shards: int = 24) -> str:
    """The same in DuckDB's SQL, with equal weights, as a flat choice over all shards."""

    def choice(n: int) -> str:
        draws = ", ".join(
            f"{{'draw': -ln((('0x' || substr(h{s // SHARDS_A_RACK}, {8 * (s % SHARDS_A_RACK) + 1}, 8))::BIGINT::DOUBLE"
            f" + 0.5) / 4294967296.0), 'shard': {s}}}" for s in range(n))
        return f"list_min([{draws}]).shard::INTEGER"

    racks = -(-(shards + 1) // SHARDS_A_RACK)
    hashes = ", ".join(f"md5(k || ':{r}') AS h{r}" for r in range(racks))
    crc = ("WITH RECURSIVE step(i, j, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, j + 1, "
           "CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END FROM step WHERE j < 8), "
           "crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE j = 8)")
    return f"""
{crc},
keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
summed AS (
  SELECT doc_id, k, (strlen(text) + 8)::BIGINT AS size,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
             [('0x' || hex(encode(text))[2 * i - 1:2 * i])::BIGINT for i in range(1, strlen(text) + 1)]),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS text_crc32
  FROM keyed, crc_table),
hashed AS (SELECT *, {hashes}, ('0x' || substr(md5(k || '/' || text_crc32::VARCHAR), 1, 8))::BIGINT AS spread
           FROM summed),
placed AS (SELECT *, {choice(shards)} AS shard, {choice(shards + 1)} AS grown_shard FROM hashed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard
                          ORDER BY spread % {BUCKETS}, spread, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown_shard
FROM placed"""
