"""Exact Jaccard join of documents on word shingles, by adaptive multi-match prefixes.

Tokens (shingles) have one global order, rare ones first. Two sets with
Jaccard >= t share at least L tokens among the first n - ceil(t n) + L of each,
for every L. Each document picks its own L from the estimated cost of the
longer prefix's postings against the candidates it saves; a pair is verified
only if it shares at least the smaller of the two L.

The order and the estimates come from a count sketch of fixed size over the
shingles of all documents; any order is right, a good one is fast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Sketch, blobs, by_bytes, drop_states, maybe_in, utf8, write_state
from wordloom.llm.linkjoin import POSTINGS, PROFILE, link_components, parities, postings
from wordloom.llm.textgrams import mix, word_shingles

MOST_NEEDED = 4
#: Cost of one posting against that of one verification.
POSTING_COST, VERIFY_COST = 1.0, 20.0


def _count(n: int):
    """Documents -> (doc_id, n_shingles, s1, s2) and, per partition, its part of the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in by_bytes(batches):
            sizes, one, two, seen = [], [], [], []
            for tokens in word_shingles(*utf8(batch["text"]), n):
                sizes.append(len(tokens))
                one.append(tokens.sum(dtype=np.uint64))
                two.append(mix(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64))
                seen.append(tokens)
                if len(seen) == 1000:
                    sketch.add(np.concatenate(seen))
                    seen.clear()
            if seen:
                sketch.add(np.concatenate(seen))
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                 pa.array(np.array(two, np.uint64).view(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                schema=schema)
        if parts := sketch.slices():
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int32()),
                                              blobs(parts)], schema=schema)

    return run, "doc_id long, n_shingles long, s1 long, s2 long, slice int, counts binary"


def order(tokens: np.ndarray, sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens, rare first (ties by hash), and their counted numbers of documents."""
    df = sketch.counted(tokens)
    at = np.argsort(df, kind="stable")
    return tokens[at], df[at]


def choose(df: np.ndarray, base: int) -> int:
    """L in 1 .. MOST_NEEDED with the smallest estimated cost; ``base`` is the plain L = 1 prefix's length."""
    best, least = 1, None
    for need in range(1, MOST_NEEDED + 1):
        if base - 1 + need > len(df):
            break
        scanned = df[: base - 1 + need].sum()
        cost = POSTING_COST * scanned + VERIFY_COST * scanned / need**2
        if least is None or cost < least:
            best, least = need, cost
    return best


def _profile(n: int, num: int, den: int, sketch_var):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("need", pa.int32()), ("prefix", pa.binary()),
                        ("parity", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch.of(sketch_var.value)
        for batch in by_bytes(batches):
            keep, sizes, needs, prefixes, maps = [], [], [], [], []
            for i, tokens in enumerate(word_shingles(*utf8(batch["text"]), n)):
                size = len(tokens)
                if not size:
                    continue
                ordered, df = order(tokens, sketch)
                base = size - -(-num * size // den) + 1
                need = choose(np.maximum(df - sketch.usual, 1), base)
                keep.append(i)
                sizes.append(size)
                needs.append(need)
                prefixes.append(ordered[: base - 1 + need].tobytes())
                maps.append(parities(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(needs, pa.int32()), blobs(prefixes), blobs(maps)], schema=schema)

    return run


def _postings(sketch_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch.of(sketch_var.value)
        for batch in batches:
            data, offsets = utf8(batch["prefix"])
            sizes = np.diff(offsets) // 8
            node, n, need = (np.repeat(batch[c].to_numpy(), sizes) for c in ("node", "n", "need"))
            yield postings(np.frombuffer(data.tobytes(), np.uint64), node, sketch, n, need)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], blobs([t.tobytes() for t in word_shingles(*utf8(batch["text"]), n)])],
                ["node", "payload"])

    return run


def ngram_jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text; other columns are ignored).

    Words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. A document's set holds its
    distinct n-word shingles; with fewer words, the whole sequence as one. Two
    documents link when den * |A & B| >= num * |A | B|; component_id is the
    smallest doc_id reachable by links, itself included.

    A null or empty text, or one without words, has an empty set (n_shingles 0)
    and links with nothing. A row with a null doc_id takes no part in the join
    (component_id null). Equal sets are joined once, through the one with the
    smallest doc_id; repeated rows each come back. An empty table gives no rows.
    """
    return _components(docs, n, num, den)[0]


def written_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``ngram_jaccard_components`` as a table of the shared folder, for callers that read it several times;
    the larger tables that it comes from go."""
    found, states = _components(docs, n, num, den)
    written = write_state(found, "components", None)
    drop_states(*states)
    return written


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """``ngram_jaccard_components``, and the tables of the shared folder that it reads."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _count(n)
    counted = write_state(texts.mapInArrow(run, schema), "shingle-counts")
    rows = counted.where("slice is null")
    sketch = Sketch.gather(counted.where("slice is not null").select("slice", "counts"))

    classes = (rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2")
               .agg(F.min("doc_id").alias("node")))
    profile = write_state(texts.mapInArrow(_profile(n, num, den, sketch), PROFILE)
                          .join(classes.select("node").distinct(), "node", "left_semi"), "profiles")

    def payloads(nodes):
        wanted = nodes.withColumnRenamed("node", "doc_id")
        return (maybe_in(texts, "doc_id", wanted).join(wanted, "doc_id", "left_semi")
                .mapInArrow(_sets(n), "node long, payload binary"))

    linked = link_components(profile.mapInArrow(_postings(sketch), POSTINGS), payloads,
                             lambda nodes: (write_state(maybe_in(profile, "node", nodes).join(nodes, "node", "left_semi"),
                                                        "profiles"), None),
                             lambda raw: [np.frombuffer(x, np.uint64) for x in raw], num, den, bounds=profile)
    named = classes.join(linked, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return (rows.join(named, ["n_shingles", "s1", "s2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")),
            [counted, profile])
