"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all normalised benchmark items.

Normalised text is the words in order, A-Z lower-cased, one space before and after each, so that a
window of words occurs where its string occurs. A batch of documents is normalised at once in
NumPy and read once by the automaton; matches are mapped to words and from there to
the places in the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import by_bytes, sub_bucket, utf8, write_state

WINDOW = 10
#: Windows in one automaton (about 100 MB); a benchmark with more is read by several, one after the other.
PART = 50_000
_TABLE = np.full(256, 32, np.uint8)
_TABLE[48:58], _TABLE[97:123], _TABLE[128:] = range(48, 58), range(97, 123), range(128, 256)
_TABLE[65:91] = _TABLE[97:123]
FOUND = "doc_id long, digest string, n_words long, spans array<struct<word:bigint,words:bigint,start:bigint,end:bigint>>, items array<string>"
MERGED = FOUND.replace("digest string, ", "")
_SPAN = pa.struct([(n, pa.int64()) for n in ("word", "words", "start", "end")])


class Normalised:
    """A batch of texts as one string of Latin-1 characters, one per byte: ' w1 w2 \\n' per text.

    starts, ends: the words' places in it; first: each text's first word (and the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        n = len(sizes)
        buffer = np.full(len(data) + 3 * n, 32, np.uint8)
        self.base = offsets[:-1] + 3 * np.arange(n) + 1  # each text's first byte in the buffer
        buffer[self.base + sizes + 1] = 10
        self.place = np.repeat((self.base - offsets[:-1]).astype(np.int32), sizes)
        self.place += np.arange(len(data), dtype=np.int32)
        buffer[self.place] = _TABLE[data]
        blank = buffer == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[:1] = True
        self.kept = keep
        bytes_ = buffer[keep]
        self.text = bytes_.tobytes().decode("latin-1")
        word = (bytes_ != 32) & (bytes_ != 10)
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.flatnonzero(bytes_ == 10)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, breaks)])

    def origin(self, at: np.ndarray) -> np.ndarray:
        """The buffer's places of places in the string."""
        return np.flatnonzero(self.kept)[at]


def words_of(texts: pa.Array) -> list[list[str]]:
    """The normalised words of each text, as Latin-1 strings of their bytes."""
    return [line.strip(" ").split(" ") if line != " " else [] for line in Normalised(*utf8(texts)).text.split("\n")[:len(texts)]]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, limit=1 << 18):
        for item, words in zip(batch["item"].to_pylist(), words_of(batch["text"])):
            own = {" " + " ".join(words[i:i + WINDOW]) + " " for i in range(max(1, len(words) - WINDOW + 1))} if words else set()
            own = sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array([w.encode("latin-1") for w in own], pa.binary()),
                                              pa.array([item] * len(own), pa.string())], ["window", "item"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(window, item) of all items: each ``WINDOW`` consecutive words, or all of fewer."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"),
                                                         F.col("text").cast("string").alias("text"))
    return write_state(rows.mapInArrow(_windows, "window binary, item string").distinct(), "windows")


_built: dict[str, tuple] = {}


def automaton(key: str, rows: list[tuple[bytes, str]]):
    """(automaton, items per window) of rows sorted by window; a worker keeps the last one."""
    if key not in _built:
        _built.clear()
        found, items = ahocorasick.Automaton(ahocorasick.STORE_ANY), []
        for window, own in groupby(rows, key=lambda r: r[0]):
            found.add_word(window.decode("latin-1"), (len(items), len(window)))
            items.append([item for _, item in own])
        found.make_automaton()
        _built[key] = (found, items)
    return _built[key]


def _scan(key: str, shared, every: bool):
    """Rows of FOUND for the documents, or where not ``every`` for those with a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, items = automaton(key, shared.value) if shared.value else (None, [])
        for batch in by_bytes(batches):
            data, offsets = utf8(batch["text"])
            norm = Normalised(data, offsets)
            hits = [(end, which, size) for end, (which, size) in found.iter(norm.text)] if found else []
            spans, names = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            if hits:
                end, which, size = np.array(hits, np.int64).T
                lo = np.searchsorted(norm.starts, end - size + 1)
                hi = np.searchsorted(norm.starts, end)  # the word after the last one
                change = np.bincount(lo, minlength=len(norm.starts) + 1) - np.bincount(hi, minlength=len(norm.starts) + 1)
                inside = np.concatenate([[0], np.cumsum(change)[:-1] > 0, [0]]).astype(np.int8)
                step = np.diff(inside)
                # a span ends with its text
                cuts = norm.first[1:-1][(inside[norm.first[1:-1]] == 1) & (inside[norm.first[1:-1] + 1] == 1)]
                a = np.union1d(np.flatnonzero(step == 1), cuts)
                b = np.union1d(np.flatnonzero(step == -1), cuts)
                doc = np.searchsorted(norm.first, a, "right") - 1
                origin = norm.origin(np.concatenate([norm.starts[a], norm.ends[b - 1] - 1]))
                point = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte
                start, stop = (np.searchsorted(norm.place, origin[:len(a)]), np.searchsorted(norm.place, origin[len(a):]))
                before = np.where(offsets[doc] > 0, point[offsets[doc] - 1], 0)
                for d, *row in zip(doc.tolist(), (a - norm.first[doc]).tolist(), (b - a).tolist(),
                                   (point[start] - 1 - before).tolist(), (point[stop] - before).tolist()):
                    spans[d].append(dict(zip(("word", "words", "start", "end"), row)))
                pairs = np.unique(np.stack([np.searchsorted(norm.first, lo, "right") - 1, which]), axis=1)
                for d, w in pairs.T.tolist():
                    names[d] += items[w]
            out = pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["digest"], pa.array(np.diff(norm.first).astype(np.int64)),
                 pa.array(spans, pa.list_(_SPAN)), pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))],
                ["doc_id", "digest", "n_words", "spans", "items"])
            yield out if every else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, n_words, spans, items) per row of ``docs``: where benchmark items occur in it.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Words are runs of
    digits, letters a-z (A-Z is lower-cased) and characters beyond ASCII. An item's windows are
    each 10 consecutive words of it, or all its words if they are fewer. spans are the longest runs of words inside
    occurrences: first word, number of words, and the characters (start, end) of the original text; items
    the ids, as strings, of the items with an occurring window. Null texts have no words, items without words
    no windows; rows with a null item_id are ignored; repeated items and rows count once and each.
    An empty ``docs`` gives no rows, an empty ``benchmark`` no spans.

    One automaton holds at most about ``part`` windows, so its size is bounded; with more
    windows, further ones read the documents in turn, and a document's spans are merged.
    A text is held whole, about 20 bytes per byte.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark)
    parts = -(-windows.count() // part) or 1
    digest = F.md5("text") if parts > 1 else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", digest)
    found = []
    for i in range(parts):
        own = windows.where(sub_bucket("window", "item", buckets=parts) == i)
        shared = spark.sparkContext.broadcast(sorted((bytes(r["window"]), r["item"]) for r in own.collect()))
        found.append(write_state(rows.mapInArrow(_scan(uuid.uuid4().hex, shared, i == 0), FOUND), "found"))
    if parts == 1:
        return found[0].drop("digest")
    more = (reduce(DataFrame.union, found[1:]).groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("h"))
            .agg(F.flatten(F.collect_set("spans")).alias("s"), F.flatten(F.collect_set("items")).alias("i")))
    both = found[0].join(more, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("digest").eqNullSafe(F.col("h")), "left")
    joined = lambda a, b: F.concat(a, F.coalesce(b, F.array().cast(found[0].schema[a].dataType)))
    return both.select("doc_id", "n_words", joined("spans", "s").alias("spans"),
                       F.array_sort(F.array_distinct(joined("items", "i"))).alias("items")).mapInArrow(_merge, MERGED)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that overlap or touch become one."""
    for batch in batches:
        spans = []
        for own in batch["spans"].to_pylist():
            out = []
            for s in sorted(own, key=lambda s: s["word"]):
                if out and s["word"] <= out[-1]["word"] + out[-1]["words"]:
                    out[-1]["words"] = max(out[-1]["words"], s["word"] + s["words"] - out[-1]["word"])
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(s)
            spans.append(out)
        yield batch.set_column(2, "spans", pa.array(spans, pa.list_(_SPAN)))


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document, from ``contaminated_spans``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return contaminated_spans(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS words FROM benchmark),
w AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
h AS MATERIALIZED (
  SELECT doc_id, i, w.size AS size, item_id
  FROM (SELECT doc_id, i, s.size, array_to_string(words[i:i + s.size - 1], ' ') AS w
        FROM p, (SELECT DISTINCT size FROM w) s WHERE i + s.size - 1 <= len(words)) x JOIN w USING (size, w)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
