"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, one line kept per component."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import FILTER_BITS, Sketch, bits_of, blobs, by_bytes, drop_states, free_name, maybe_in, surely_out, utf8, write_state
from wordloom.llm.linkjoin import PLAIN_POSTINGS, PROFILE, link_components, parities, postings
from wordloom.llm.textgrams import bands, char_shingles, distinct, sketches

#: 8 bands of 3 rows: a pair at Jaccard 0.8 shares a band with probability 0.997, at 0.85 with 0.9995.
BANDS, ROWS = 8, 3
GROUP = 1 << 18
SEEN = 1 << 20  # digests that a task remembers


def normal(line: str) -> str:
    return line.strip(" \t\r\v\f").lower()


def _digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _groups(lines: list[str]) -> Iterator[list[str]]:
    at = size = 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= GROUP:
            yield lines[at: i + 1]
            at, size = i + 1, 0
    if at < len(lines):
        yield lines[at:]


def _lines(k: int):
    """Documents -> (doc_id, line_no, d1, d2, bands), bands at a line's first occurrence in the task (or since the
    task has forgotten the lines it has seen: results are the same); and, per task, its part of a sketch of the bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("bands", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = Sketch(), set()
        for batch in by_bytes(batches):
            ids, numbers, texts, which = [], [], {}, []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for i, line in enumerate((text or "").split("\n") if doc is not None else ()):
                    if plain := normal(line):
                        ids.append(doc)
                        numbers.append(i)
                        which.append(texts.setdefault(plain, len(texts)))
            unique = list(texts)
            raw = [_digest(x) for x in unique]
            digests = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
            new, keys = [i for i, d in enumerate(raw) if d not in seen], [None] * len(which)
            seen.update(raw)
            if len(seen) > SEEN:
                seen.clear()
            which = np.array(which, np.int64)
            first = np.unique(which, return_index=True)[1]
            found = [bands(sketches(*char_shingles(group, k), BANDS * ROWS), ROWS)
                     for group in _groups([unique[i] for i in new])]
            if found:
                found = np.concatenate(found)
                sketch.add(found.reshape(-1))
                for i, row in zip(new, found):
                    keys[first[i]] = row.tobytes()
            m = len(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests[which, 0]),
                 pa.array(digests[which, 1]),
                 pa.array(keys, pa.binary()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        if parts := sketch.slices():
            m = len(parts)
            none = [pa.nulls(m, f.type) for f in schema][:5]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(m), pa.int32()), blobs(parts)], schema=schema)

    return run, "doc_id long, line_no int, d1 long, d2 long, bands binary, slice int, counts binary"


def _postings(sketch_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch.of(sketch_var.value)
        for batch in batches:
            data, _ = utf8(batch["bands"])
            yield postings(np.frombuffer(data.tobytes(), np.uint64), np.repeat(batch["line_id"].to_numpy(), BANDS), sketch)

    return run


def _line_bit(doc, line):
    """A line's bit, from its doc_id and number (columns or arrays)."""
    return doc * 2654435 + line * 40503


def _fetch(wanted):
    """(doc_id, text) -> (d1, d2, payload): the lines whose bits are set in ``wanted``, normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in by_bytes(batches):
            found = {}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                lines = (text or "").split("\n")
                at = _line_bit(doc % FILTER_BITS, np.arange(len(lines))) % FILTER_BITS
                for i in np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                    if plain := normal(lines[i]):
                        found.setdefault(plain, None)
            digests = np.frombuffer(b"".join(map(_digest, found)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[:, 0]), pa.array(digests[:, 1]), blobs([x.encode("utf-8", "surrogatepass") for x in found])],
                ["d1", "d2", "payload"])

    return run


def _shingle_sets(k: int):
    def run(raw: list[bytes]) -> list[np.ndarray]:
        out = []
        for group in _groups([bytes(x).decode("utf-8", "surrogatepass") for x in raw]):
            hashes, at = char_shingles(group, k)
            out += [distinct(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
        return out

    return run


def _profiles(k: int):
    to_sets = _shingle_sets(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload"):
            sets = to_sets(batch["payload"].to_pylist())
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch["node"], pa.array([len(x) for x in sets], pa.int64()), pa.array(np.ones(m, np.int32)),
                 blobs([b""] * m), blobs([parities(x) for x in sets])], ["node", "n", "need", "prefix", "parity"])

    return run


def fuzzy_lines(docs: DataFrame, k: int = 8, num: int = 80, den: int = 100) -> DataFrame:
    """One row per non-blank line: doc_id, line_no, first_doc_id, first_line_no, kept.

    ``docs`` has doc_id and text (other columns are ignored). Lines end at
    ``\\n``; they are compared trimmed of ASCII white space and lower-cased.
    Lines link when the Jaccard similarity of their k-character shingles is at
    least num / den (a shorter line is one shingle); equal lines always do. Of
    every component the line with the smallest (doc_id, line_no) is kept:
    first_doc_id and first_line_no name it.

    Blank lines and null or empty texts give no row (a blank line always
    stays), nor do rows with a null doc_id (they stay whole). Rows that repeat a
    doc_id and a line number are the same line: all copies of a kept line stay. An empty table gives no rows.
    """
    return _fuzzy_lines(docs, k, num, den)[0]


def _fuzzy_lines(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """``fuzzy_lines``, and the tables of the shared folder that it reads."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _lines(k)
    read = write_state(texts.mapInArrow(run, schema), "lines")
    lines = read.where("slice is null").drop("slice", "counts")
    sketch = Sketch.gather(read.where("slice is not null").select("slice", "counts"))
    unique = write_state(
        lines.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"),
                                      F.first("bands", ignorenulls=True).alias("bands"))
        .select("d1", "d2", "first.doc_id", "first.line_no", "bands",
                F.monotonically_increasing_id().alias("line_id")), "unique-lines")

    fetched = []  # the first round's nodes hold all that come later: a node in a group of two is in one of its pairs

    def payloads(nodes):
        ids = nodes.withColumnRenamed("node", "line_id")
        wanted = write_state(maybe_in(unique.drop("bands"), "line_id", ids).join(ids, "line_id", "left_semi"), "wanted", None)
        doc = F.pmod("doc_id", F.lit(FILTER_BITS))
        bits = bits_of(wanted, F.pmod(_line_bit(doc, F.col("line_no").cast("long")), F.lit(FILTER_BITS)))
        # lines travel, not documents; equal digests are equal lines, and the first of each stays where the join has put it
        fetched.append(write_state(
            maybe_in(texts, "doc_id", wanted.select("doc_id")).mapInArrow(_fetch(bits), "d1 long, d2 long, payload binary")
            .join(wanted.select("d1", "d2", "line_id"), ["d1", "d2"]).dropDuplicates(["d1", "d2"])
            .select(F.col("line_id").alias("node"), "payload"), "payloads"))
        drop_states(wanted)
        return fetched[-1]

    def profiles(nodes):
        first = fetched.pop()
        needed = write_state(maybe_in(first, "node", nodes).join(nodes, "node", "left_semi"), "payloads")
        drop_states(first)
        return write_state(needed.mapInArrow(_profiles(k), PROFILE), "profiles"), needed

    linked = link_components(
        unique.select("line_id", "bands").mapInArrow(_postings(sketch), PLAIN_POSTINGS), payloads,
        profiles, _shingle_sets(k), num, den, again=False).withColumnRenamed("node", "line_id")
    drop_states(*fetched)
    member = maybe_in(unique.drop("bands"), "line_id", linked.select("line_id")).join(linked, "line_id")
    heads = member.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("head"))
    kept = (unique.select("d1", "d2", "doc_id", "line_no")
            .join(member.join(heads, "component").select("d1", "d2", "head"), ["d1", "d2"], "left")
            .select("d1", "d2", F.coalesce("head.doc_id", "doc_id").alias("first_doc_id"),
                    F.coalesce("head.line_no", "line_no").alias("first_line_no")))
    same = (F.col("doc_id") == F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no"))
    return (lines.drop("bands").join(kept, ["d1", "d2"]).select("doc_id", "line_no", "first_doc_id", "first_line_no",
                                                                same.alias("kept")), [read, unique])


def _without(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            out = []
            for text, gone in zip(batch["text"].to_pylist(), batch[column].to_pylist()):
                if gone:
                    drop = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                out.append(text)
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type)).drop_columns([column])

    return run


def without_repeated_lines(docs: DataFrame, k: int = 8, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with every line gone that ``fuzzy_lines`` does not keep; all columns and rows stay."""
    own = free_name(docs, "gone")
    judged, states = _fuzzy_lines(docs, k, num, den)
    gone = write_state(judged.where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias(own)), "gone")
    drop_states(*states)
    key = free_name(docs, "key")
    keyed, ids = docs.withColumn(key, F.col("doc_id").cast("long")), gone.select(F.col("doc_id").alias(key))
    cut = (maybe_in(keyed, key, ids).join(gone.withColumnRenamed("doc_id", key), key, "left").select(*docs.columns, own)
           .mapInArrow(_without(own), docs.schema))
    return surely_out(keyed, key, ids).select(*docs.columns).union(cut)
