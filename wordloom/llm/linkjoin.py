"""From shared tokens to the components of an exact similarity graph, without listing a group's pairs.

Input: postings (token, salt, node, n, need): two linked nodes always share a token
(for an exact join) or very likely do (for a sketch). A token that a sketch
counts often is salted, so no group grows beyond a bound. The work is done in
rounds, each verified on the whole sets:

1. every group's smallest node against its other nodes, and a salted token's
   smallest against those of its groups (linear in the postings);
2. tokens whose nodes still lie in several components: their nodes are dealt
   out in cells of bounded size, parity sketches (which bound the symmetric
   difference from below) rule pairs out, and a forest over the cell's
   components of what is left goes on (linear in the nodes; dealt anew in every
   such round, as long as at least a quarter of the pairs turn out to be links);
3. every pair left between components, in pairs of blocks; blocks of a token's
   largest component meet only the blocks of its other nodes.

After the last round every pair that shares a token has been verified, ruled out by an
exact bound, or lies inside one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import by_bytes, drop_states, release, write_state
from wordloom.llm.components import connected_components
from wordloom.llm.textgrams import mix

BITS = 1024
SALTED = 1024  # rows of a token beyond which it is salted
PROFILE = "node long, n long, need int, prefix binary, parity binary"
POSTINGS = "token long, salt int, node long, n long, need int"
PLAIN_POSTINGS = "token long, salt int, node long"  # any sizes may link, and one shared token is enough
HITS = "token long, salt int, node long, n long, need int, pivot long, ask int"


def parities(items: np.ndarray) -> bytes:
    """For every bit, whether an odd number of items falls on it. Two sets' sketches differ in at most as many bits
    as the sets in items, and unlike OR-ed bit maps they do not fill up."""
    return np.packbits(np.bincount((items & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes()


def postings(tokens: np.ndarray, nodes: np.ndarray, sketch, sizes: np.ndarray | None = None,
             needs: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of POSTINGS, or of PLAIN_POSTINGS without sizes; salt 0 for a token that ``sketch`` counts at most SALTED times, 1 .. else."""
    often = -(-np.maximum(sketch.counted(tokens) - sketch.usual, 1) // SALTED)
    salt = np.where(often > 1, 1 + (mix(nodes.astype(np.int64).view(np.uint64)) % often.astype(np.uint64)).astype(np.int64), 0)
    columns = {"token": pa.array(tokens.view(np.int64)), "salt": pa.array(salt.astype(np.int32)),
               "node": pa.array(nodes.astype(np.int64))}
    if sizes is not None:
        columns |= {"n": pa.array(sizes.astype(np.int64)), "need": pa.array(needs.astype(np.int32))}
    return pa.RecordBatch.from_pydict(columns)


def _hits(num: int, den: int):
    """Sorted postings -> those of groups of two and of salted tokens, with the group's smallest node.

    ask: the shared tokens that the pair (pivot, node) has to show, null if the sizes rule it out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["token", "salt", "node", "n", "need"], None

        def out(columns):
            token, salt, node, n, need = columns
            first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
            size = np.diff(np.concatenate([first, [len(token)]]))
            head = np.repeat(first, size)
            ask = np.minimum(need, need[head])
            never = (node == node[head]) | (den * np.minimum(n, n[head]) < num * np.maximum(n, n[head]))
            keep = (np.repeat(size, size) > 1) | (salt > 0)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x[keep]) for x in (token, salt, node, n, need, node[head])),
                 pa.array(ask[keep], pa.int32(), mask=never[keep])], [*names, "pivot", "ask"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch[c].to_numpy() for c in batch.schema.names]
            if len(columns) < len(names):
                columns += [np.ones(batch.num_rows, np.int64), np.ones(batch.num_rows, np.int32)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            token, salt = columns[:2]
            last = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield out([x[:at] for x in columns])
            held = [x[at:] for x in columns]
        if held is not None:
            yield out(held)
        release()

    return run


def bounded(pairs: DataFrame, bounds: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the profiles do not rule out: sizes, parities, and the number of shared prefix tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                    for c in ("xa", "xb"))
            na, nb, needs = batch["na"].to_numpy(), batch["nb"].to_numpy(), (batch["la"].to_numpy(), batch["lb"].to_numpy())
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good = ((den + num) * apart <= (den - num) * (na + nb)) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
            need = np.minimum(*needs)
            for i in np.flatnonzero(good & (need > 1)):
                p, q = (np.frombuffer(batch[c][int(i)].as_py(), np.uint64) for c in ("pa", "pb"))
                p, q = p[:len(p) - needs[0][i] + need[i]], q[:len(q) - needs[1][i] + need[i]]
                good[i] = len(np.intersect1d(p, q, assume_unique=True)) >= need[i]
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def side(to: str) -> DataFrame:
        return bounds.select(F.col("node").alias(to), F.col("n").alias("n" + to), F.col("need").alias("l" + to),
                             F.col("prefix").alias("p" + to), F.col("parity").alias("x" + to))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, payloads: DataFrame, to_sets: Callable[[list[bytes]], list[np.ndarray]], num: int,
             den: int) -> DataFrame:
    """Pairs (a, b) with den * |A & B| >= num * |A | B| on the sets of ``payloads`` (node, payload)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(iter([whole]), "left", 1 << 20):
                sides = [batch[c].to_pylist() for c in ("left", "right")]
                single = {raw: i for i, raw in enumerate(dict.fromkeys(sides[0] + sides[1]))}
                sets, good = to_sets(list(single)), []
                for i, (x, y) in enumerate(zip(*([sets[single[raw]] for raw in side] for side in sides))):
                    few, many = sorted((len(x), len(y)))
                    if not few or den * few < num * many:
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (few + many - both):
                        good.append(i)
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    sides = (pairs.join(payloads.select(F.col("node").alias("a"), F.col("payload").alias("left")), "a")
             .join(payloads.select(F.col("node").alias("b"), F.col("payload").alias("right")), "b"))
    return sides.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Positions in (i, j) of a forest over the classes of ``label``, which are merged in place.

    ``label`` points every row to the first of its class.
    """
    chosen, at = [], np.arange(len(i))
    while True:
        one, two = label[i[at]], label[j[at]]
        at, one, two = (x[one != two] for x in (at, one, two))
        if not len(at):
            return chosen
        high, first = np.unique(np.maximum(one, two), return_index=True)  # each hangs on a smaller one: no cycles
        label[high] = np.minimum(one, two)[first]
        chosen.append(at[first])
        while (label[label] != label).any():
            label[:] = label[label]


def _cells(num: int, den: int, each: bool):
    """Rows sorted by (token, p, q) -> pairs between components that sizes and parities allow: all of them if
    ``each``, else a forest over the components of each cell, at most as many as rows."""
    names = ["token", "p", "q", "block", "node", "comp", "n"]

    def solve(columns: list[np.ndarray], parity: np.ndarray) -> pa.RecordBatch:
        token, p, q, block, node, comp, n = columns
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        ends = np.append(np.flatnonzero(new), len(token))
        left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(token)) - 1  # rows of the cell after this one
        _, first, place = np.unique(np.stack([np.cumsum(new), comp], axis=1), axis=0, return_index=True,
                                    return_inverse=True)
        label = first[place.reshape(-1)]  # the first row of the same cell and component
        one, two = [], []
        for apart in range(1, int(left.max(initial=0)) + 1):
            i = np.flatnonzero(left >= apart)
            j = i + apart
            fits = (label[i] != label[j]) & ((p[i] == q[i]) | (block[i] != block[j]))
            i, j = i[fits], j[fits]
            fits = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            # |A ^ B| <= (den - num) / (den + num) * (|A| + |B|) holds for every link
            odd = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
            fits = (den + num) * odd <= (den - num) * (n[i] + n[j])
            i, j = i[fits], j[fits]
            for at in ([slice(None)] if each else _hooked(label, i, j)):
                one.append(node[i[at]])
                two.append(node[j[at]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch[c].to_numpy() for c in names]
            columns.append(np.frombuffer(b"".join(batch["parity"].to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            other = np.flatnonzero(np.any([x != x[-1] for x in columns[:3]], axis=0))
            at = int(other[-1]) + 1 if len(other) else 0  # a cell that may go on waits for the next batch
            if at:
                yield solve([x[:at] for x in columns[:-1]], columns[-1][:at])
            held = [x[at:] for x in columns]
        if held is not None:
            yield solve(held[:-1], held[-1])
        release()

    return run


def _leftover(hits: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(token, node, comp, c) of the tokens whose nodes lie in several components; None if there are none.

    A token of two nodes is not among them: round 1 has seen its pair.
    """
    placed = (hits.select("token", "node").join(labels.withColumnRenamed("component", "comp"), "node", "left")
              .withColumn("comp", F.coalesce("comp", "node")))
    mixed = (placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
             .where("lo <> hi and c > 2").select("token", "c"))
    left = write_state(placed.join(mixed, "token").select("token", "node", "comp", "c"), "leftover", None)
    return None if left.isEmpty() else left


def _dealt(left: DataFrame, step: int, block: int) -> DataFrame:
    """``left`` in cells of about ``block`` nodes of a token, other ones for every ``step``; a row stays one row."""
    cell = F.pmod(F.xxhash64("node", F.lit(step)), F.ceil(F.col("c") / F.lit(block)))
    return left.select("token", "node", "comp", cell.alias("p"), cell.alias("q"), cell.alias("block"))


def _block_pairs(left: DataFrame, block: int) -> DataFrame:
    """``left`` in cells of two blocks, such that any two nodes of a token and of different components meet.

    A token's largest component has blocks of its own, which meet only those of the token's other nodes.
    """
    main = (left.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token")
            .agg(F.max("m").alias("m"), F.max_by("comp", "m").alias("main")))
    blocks = (left.join(main, "token").withColumn("inside", F.col("comp") == F.col("main"))
              .withColumn("k", F.ceil(F.col("m") / F.lit(block)))
              .withColumn("others", F.ceil((F.col("c") - F.col("m")) / F.lit(block)))
              .withColumn("hash", F.xxhash64("node"))
              .withColumn("block", F.when(F.col("inside"), F.pmod("hash", "k"))
                          .otherwise(F.col("k") + F.pmod("hash", "others")))
              .withColumn("other", F.explode(F.sequence(F.when(F.col("inside"), F.col("k")).otherwise(F.lit(0).cast("long")),
                                                        F.col("k") + F.col("others") - 1))))
    return blocks.select("token", "node", "comp", F.least("block", "other").alias("p"),
                         F.greatest("block", "other").alias("q"), "block")


def _candidates(cells: DataFrame, known: DataFrame, num: int, den: int, each: bool) -> DataFrame:
    """Pairs (a, b) between components that share a cell and pass the bounds of the profiles ``known``."""
    rows = (cells.join(known.select("node", "n", "parity"), "node").repartition("token", "p", "q")
            .sortWithinPartitions("token", "p", "q", "node")
            .select("token", "p", "q", "block", "node", "comp", "n", "parity"))
    pairs = rows.mapInArrow(_cells(num, den, each), "a long, b long").distinct()
    return bounded(pairs, known, num, den)


def link_components(rows: DataFrame, payloads: Callable[[DataFrame], DataFrame],
                    profiles: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]],
                    to_sets: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int,
                    bounds: DataFrame | None = None, block: int = 512, again: bool = True) -> DataFrame:
    """(node, component) for every node with a verified link; the component is its smallest node.

    ``rows`` are POSTINGS or PLAIN_POSTINGS. ``payloads(nodes)`` gives (node, payload) for the
    nodes of a table (node), ``profiles(nodes)`` the columns of PROFILE and, if it has
    them at hand, the payloads; ``bounds`` may give the profiles of all nodes, to rule out pairs of round 1.
    Without ``again`` there is one round of forests, over pairs of blocks; the components are the same.
    A pair is verified only if it shares at least the smaller of the two nodes' ``need`` tokens.
    """
    hits = write_state(rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
                       .mapInArrow(_hits(num, den), HITS), "hits", None)
    heads = hits.where("salt > 0 and node = pivot").select("token", "node", "n", "need")
    least = heads.groupBy("token").agg(F.min("node").alias("pivot"), F.min_by("n", "node").alias("m"),
                                       F.min_by("need", "node").alias("other"))
    salted = (heads.join(least, "token").where(f"node <> pivot and {den} * least(n, m) >= {num} * greatest(n, m)")
              .select("pivot", "node", F.least("need", "other").alias("ask")))
    star = (hits.where("ask is not null").select("pivot", "node", "ask").union(salted)
            .groupBy(F.col("pivot").alias("a"), F.col("node").alias("b"))
            .agg(F.count("*").alias("k"), F.min("ask").alias("ask")).where("k >= ask").select("a", "b"))

    def links(pairs: DataFrame, whole: DataFrame | None = None) -> tuple[DataFrame, int]:
        pairs = write_state(pairs, "pairs", None)
        if whole is None:
            whole = payloads(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        found, tried = write_state(verified(pairs, whole, to_sets, num, den), "links"), pairs.count()
        drop_states(pairs)
        return found, tried

    first, _ = links(star if bounds is None else bounded(star, bounds, num, den))
    labels = connected_components(first)
    drop_states(first)
    known = whole = None
    each, step = False, 0
    while (left := _leftover(hits, labels)) is not None:
        if each:
            drop_states(hits)
        if known is None:  # later rounds have no nodes that this one has not
            known, whole = profiles(left.select("node").distinct())
        cells = _dealt(left, step, block) if again and not each else _block_pairs(left, block)
        more, tried = links(_candidates(cells, known, num, den, each), whole)
        found = more.count()
        drop_states(left)
        if found:
            labels = connected_components(more.union(labels.select("node", "component")))
        drop_states(more)
        if each:
            break
        each, step = not again or 4 * found < tried or not tried, step + 1
    drop_states(hits, known, whole)
    return labels
