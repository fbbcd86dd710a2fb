"""Harmonic packing: pieces of reciprocal-capacity lengths, a fixed number of them in each sequence of a class."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm.common import KEPT, by_bytes, sub_bucket, utf8, write_state
from wordloom.llm.textgrams import word_spans

BUCKETS = 1024
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, fits int")


def classes(capacity: int) -> np.ndarray:
    """For each length up to ``capacity`` the largest capacity // j not above it; class j's sequences hold j pieces."""
    sizes = sorted({capacity // j for j in range(1, capacity + 1)})
    return np.array([0] + [sizes[np.searchsorted(sizes, n, "right") - 1] for n in range(1, capacity + 1)])


_LETTERS = regex.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# fixed values: byte-level BPE spells bytes that are not printable as characters from 256 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of whole texts, word by word: the tokenizer sees each distinct word of a worker once.

    The tokenizer drops white space and lower-cases, and no token spans white
    space, or the place between an ASCII letter and a comma or full stop that
    ends a word; so a text's ids are its words' ids in a row.
    """

    MOST = 1 << 19  # words remembered (some 20 MB); beyond it the memory starts anew
    RECENT = 1 << 15  # new words gathered before they are merged into the large table

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        # matched before lower-casing, so case tells such words apart; the words' hash folds it
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # the direct way is taken where it gives this tokenizer's own result on every kind of such letters
        self.direct = False
        probe = ["the", "Tokenizers", "\u00c9t\u00e9", "se\u00f1or", "stra\u00dfe", "\u00fcbergr\u00f6\u00dfen", "\u00e7\u00e0", "q"]
        slow = [self._encode([w])[0].tolist() for w in probe]
        self.direct = True
        self.direct = all(self._encode([w])[0].tolist() == x for w, x in zip(probe, slow))
        self.clear()

    def clear(self) -> None:
        nothing = lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tables = [nothing(), nothing()]  # large and recent: hashes sorted, where each word's ids begin, how many
        self.ids = [np.zeros(0, np.uint32)]
        self.used = 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and their numbers.

        A word of plain Latin letters is one piece for the tokenizer's model once
        it is lower-cased and its bytes are spelled out, and goes there directly;
        the others are encoded as one text, which is cut by where its tokens begin.
        """
        ids: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if self.direct and w.isascii() and w.isalpha():
                ids[i] = [t.id for t in self.model.tokenize(w.lower())]
            elif self.direct and not w.isascii() and _LETTERS.fullmatch(w):
                ids[i] = [t.id for t in self.model.tokenize(w.lower().encode().decode("latin-1").translate(_BYTES))]
            else:
                rest.append(i)
        for lo in range(0, len(rest), 256):
            part = rest[lo: lo + 256]
            code = self.tokenizer.encode(" ".join(words[i] for i in part), add_special_tokens=False)
            starts = np.cumsum([len(words[i]) + 1 for i in part])
            owner = np.searchsorted(starts, [first for first, _ in code.offsets], "right")
            for i in part:
                ids[i] = []
            for k, t in zip(owner.tolist(), code.ids):
                ids[part[k]].append(t)
        return (np.fromiter(chain.from_iterable(ids), np.uint32),
                np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """``hashes`` are sorted and new."""
        text, sizes = [w.decode("utf-8", "replace") for w in words], []
        start = self.used
        for lo in range(0, len(text), 4096):
            ids, n = self._encode(text[lo: lo + 4096])
            self.ids.append(ids)
            self.used += len(ids)
            sizes.append(n)
        size = np.concatenate(sizes)
        fresh = (hashes, start + np.cumsum(size) - size, size)
        self.tables[1] = self._merged(self.tables[1], fresh)
        if len(self.tables[1][0]) > self.RECENT:
            self.tables = [self._merged(*self.tables), tuple(x[:0] for x in self.tables[1])]

    @staticmethod
    def _merged(old: tuple, new: tuple) -> tuple:
        at = np.searchsorted(old[0], new[0])
        return tuple(np.insert(x, at, y) for x, y in zip(old, new))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words' ids begin (-1: unknown), and how many they are."""
        at, size = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for known, begin, count in self.tables:
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                at[hit], size[hit] = begin[place[hit]], count[place[hit]]
        return at, size

    def _keyed(self, raw: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The words' hashes; a word that holds an added token's text, in any case, goes by its exact bytes."""
        low, out = raw.lower(), h
        for token in self.added:
            at = low.find(token)
            while at >= 0:
                i = int(np.searchsorted(s, at, "right")) - 1
                if i >= 0:
                    out = h.copy() if out is h else out
                    out[i] = int.from_bytes(blake2b(raw[s[i]: e[i]], digest_size=8).digest(), "little")
                at = low.find(token, at + 1)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts in order, and where each text's begin."""
        out, sizes, firsts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, s, e, h in word_spans(data, offsets, split_tail=True):
            if len(self.tables[0][0]) > self.MOST:
                self.clear()
            raw = data[lo: lo + int(e[-1])].tobytes() if len(e) else b""
            h = self._keyed(raw, s, e, h)
            unique, first, which = np.unique(h, return_index=True, return_inverse=True)
            at, size = self._find(unique)
            new = np.flatnonzero(at < 0)
            if len(new):
                self._learn(unique[new], [raw[s[i]: e[i]] for i in first[new]])
                at[new], size[new] = self._find(unique[new])
            if len(self.ids) > 1:
                self.ids = [np.concatenate(self.ids)]
            n = size[which]
            ends = np.cumsum(n)
            out.append(self.ids[0][np.repeat(at[which] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)])
            sizes.append(n)
            firsts.append(s + lo)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(out), ends[np.searchsorted(np.concatenate(firsts), offsets)]


@cache
def _word_ids(path: str) -> WordIds:
    """One per worker process, which keeps its words from task to task."""
    return WordIds(path)


KEPT["packing"] = _word_ids.cache_clear


def cut(tokens: int, capacity: int, below: np.ndarray) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the largest reciprocal length that fits, again and again."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        out.append(int(below[rest]))
        rest -= out[-1]
    return out


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, below = _word_ids(path), classes(capacity)
        cuts: dict[int, list[int]] = {}
        for batch in by_bytes(batches, owner="packing"):
            ids, at = words.encode(*utf8(batch["text"]))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                mine = np.append(ids[at[i]: at[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                total, start = len(mine) // 4, 0
                if total not in cuts:
                    cuts[total] = cut(total, capacity, below)
                for n in cuts[total]:
                    rows.append((i, start, n, zlib.crc32(mine[4 * start: 4 * (start + n)]), total))
                    start += n
            which, start, length, crc, total = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(which)), pa.array(start), pa.array(length), pa.array(crc), pa.array(total),
                 pa.array((capacity // np.maximum(length, 1)).astype(np.int32))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "fits"])

    return run


def _rest(capacity: int):
    """First-fit decreasing over the few pieces that fill no whole sequence of their class."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is not None, r["doc_id"] or 0, r["start"]))
        fill: list[int] = []
        open_ = 0
        for r in rows:
            while open_ < len(fill) and fill[open_] == capacity:
                open_ += 1
            at = next((k for k in range(open_, len(fill)) if fill[k] + r["length"] <= capacity), len(fill))
            if at == len(fill):
                fill.append(0)
            r["sequence_id"], r["offset"] = r.pop("first") + at, fill[at]
            fill[at] += r["length"]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array([r[n] for r in rows], pa.int64()) for n in names})

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A document is its
    text's token ids (``tokenizer``: a tokenizers file, by default
    word_bpe_49k.json) and ``end_id``; a null or empty text is that id alone. It is cut
    into pieces of the lengths capacity // j: as many whole sequences as fit,
    then the largest such length not above the rest, again and again. The
    sequences of class j hold exactly j pieces, so they fill from all tasks
    independently: pieces are numbered inside hash buckets, which start at
    running totals over the bucket counts, and number n lies in sequence n div j at
    (n mod j) * length. What is left, at most j - 1 pieces of each class and
    so a number that does not grow with the input, is packed first-fit decreasing by one task.

    Every row of ``docs`` is a document, repeated ones and those with a null
    doc_id too. sequence_id counts without gaps from 0. Empty tables give no rows.
    """
    path = tokenizer or str(public_tokenizers.path("word_bpe_49k.json"))
    spark = docs.sparkSession
    pieces = write_state(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_pieces(path, end_id, capacity), PIECES)
        .withColumn("_bucket", sub_bucket("doc_id", "start", "ids_crc32", buckets=BUCKETS)), "pieces")
    counts = pieces.groupBy("fits", "_bucket").agg(F.count("*").alias("n"))
    # one row per class: at most 2 * sqrt(capacity) of them
    totals = {r["fits"]: r["n"] for r in counts.groupBy("fits").agg(F.sum("n").alias("n")).collect()}
    firsts, next_id = [], 0
    for fits in sorted(totals):
        whole = totals[fits] // fits
        firsts.append((fits, next_id, whole))
        next_id += whole
    plan = spark.createDataFrame(firsts, "fits int, first long, whole long")
    line = Window.partitionBy("fits").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("fits", "_bucket", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    inside = Window.partitionBy("fits", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    placed = (pieces.withColumn("n", F.row_number().over(inside) - 1).join(starts, ["fits", "_bucket"])
              .join(plan, "fits").withColumn("n", F.col("n") + F.col("base"))
              .withColumn("bin", F.expr("n div fits")))
    full = placed.where("bin < whole").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("bin")).alias("sequence_id"),
        ((F.col("n") % F.col("fits")) * F.col("length")).alias("offset"))
    rest = (placed.where("bin >= whole").select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                F.lit(next_id).cast("long").alias("first"))
            .groupBy("first").applyInArrow(_rest(capacity), "doc_id long, start long, length long, ids_crc32 long, "
                                                            "doc_tokens long, sequence_id long, offset long"))
    return full.union(rest)
