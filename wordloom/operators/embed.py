"""Word vectors -> document vectors, as joins and grouped vector sums.

Token rows are pre-aggregated to ``(doc_id, term, n)`` before the join with the
word-vector table, so a frequent term contributes one row per document, not
one per occurrence. The word-vector table is joined, not broadcast blindly: short
vectors by ``weights.joined_in_place``, a 3M x 300 table shuffles.
Per-document sums use ``Summarizer`` (a partial aggregate) on ML vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import weights as W


def hashed_word_vectors(vocab: DataFrame, dim: int = 8) -> DataFrame:
    """Deterministic stand-in for pre-trained vectors: (term, vec ARRAY<DOUBLE>).

    Component i is the (i mod 8)-th 16-bit slice of md5(term#block) scaled to
    [-0.5, 0.5]; identical in any engine with md5, so averaged document
    vectors can be checked in SQL.
    """
    comps = []
    for i in range(dim):
        block, j = divmod(i, 8)
        h = F.md5(F.concat(F.col("term"), F.lit(f"#{block}")))
        comps.append(F.conv(F.substring(h, 4 * j + 1, 4), 16, 10).cast("double") / 65535.0 - 0.5)
    return vocab.select("term", F.array(*comps).alias("vec"))


def normalize_vectors(wv: DataFrame) -> DataFrame:
    """Unit-length word vectors (done before any averaging)."""
    return wv.select("term", V.l2_normalize("vec").alias("vec"))


def _weighted_sum(rows: DataFrame, keys: list[str], weight: Column, count: Column, dim: int | None = None) -> DataFrame:
    if dim is not None:  # short vectors: plain sums, which a hash aggregate keeps as numbers
        sums = [F.sum(F.col("vec")[i] * F.coalesce(weight, F.lit(0.0))).alias(f"_s{i}") for i in range(dim)]
        return (rows.groupBy(*keys).agg(*sums, F.sum(count).alias("cnt"))
                    .select(*keys, F.array(*[F.col(f"_s{i}") / F.col("cnt") for i in range(dim)]).alias("vec")))
    return (rows.groupBy(*keys)
                .agg(Summarizer.sum(array_to_vector("vec"), weight).alias("s"),
                     F.sum(count).alias("cnt"))
                .select(*keys, F.transform(vector_to_array("s"), lambda x: x / F.col("cnt")).alias("vec")))


def word_blocks(cells: DataFrame, wv: DataFrame, block_docs: int) -> DataFrame:
    """(block, term, vec, docs, xs, ns): every word of a block of documents with its vector, once a block.

    cells: (doc_id, term, x, n). A vector travels to each block that has its word instead of to each document,
    so hot words cost by blocks and rare ones once. Rows come in order of block and word.
    """
    docs = cells.select(F.approx_count_distinct("doc_id")).first()[0]
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-docs // block_docs)))).cast("int")
    lists = (cells.groupBy(block.alias("block"), "term")
             .agg(F.collect_list(F.struct("doc_id", F.col("x").cast("double").alias("x"), F.col("n").cast("long").alias("n"))).alias("c")))
    return (lists.join(wv, "term")
            .select("block", "term", F.col("vec").cast("array<double>").alias("vec"), F.col("c.x").alias("xs"),
                    F.col("c.n").alias("ns"), F.transform("c", lambda s: s["doc_id"]).alias("docs"))
            .repartition("block").sortWithinPartitions("block", "term"))


def block_cells(batch: pa.RecordBatch):
    """One batch of one block as (word vectors, row of each cell, document codes, documents, xs, ns)."""
    vecs = batch["vec"].flatten().to_numpy().reshape(batch.num_rows, -1)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["docs"]).to_numpy())
    docs = batch["docs"].flatten().dictionary_encode(null_encoding="encode")
    return (vecs, row, docs.indices.to_numpy(), docs.dictionary.to_pylist(), batch["xs"].flatten().to_numpy(),
            batch["ns"].flatten().to_numpy())


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches in order of block, cut where it changes."""
    for batch in batches:
        blocks = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield int(blocks[lo]), batch.slice(lo, hi - lo)


def blocked_mean_vectors(cells: DataFrame, wv: DataFrame, block_docs: int = 16384) -> DataFrame:
    """(doc_id, vec): sum of x * vector over sum of n of (doc_id, term, x, n), block by block of documents.

    The same as ``mean_vectors`` for long vectors, of which a row per document and word would be too much to send.
    A task holds one block's sums.
    """
    id_type = cells.schema["doc_id"].dataType.simpleString()

    def finished(slots, sums, counts) -> pa.RecordBatch:
        vecs = sums[:len(slots)] / counts[:len(slots), None]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(slots), pa.int64()),
             pa.ListArray.from_arrays(np.arange(0, vecs.size + 1, vecs.shape[1], dtype=np.int32), vecs.reshape(-1))], ["doc_id", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, sums, counts = None, {}, None, None
        for block, batch in by_block(batches):
            vecs, row, code, docs, x, n = block_cells(batch)
            if block != now:
                if now is not None:
                    yield finished(slots, sums, counts)
                now, slots, sums, counts = block, {}, np.zeros((0, vecs.shape[1])), np.zeros(0)
            slot = np.array([slots.setdefault(d, len(slots)) for d in docs])
            if len(slots) > len(sums):
                more = max(len(slots), 2 * len(sums)) - len(sums)
                sums, counts = np.vstack([sums, np.zeros((more, sums.shape[1]))]), np.concatenate([counts, np.zeros(more)])
            np.add.at(counts, slot[code], n)
            order = np.argsort(code, kind="stable")  # a document's words stay in order
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            for lo in range(0, len(starts), 256):
                first, end = starts[lo], starts[lo + 256] if lo + 256 < len(starts) else len(order)
                at = order[first:end]
                part = np.add.reduceat(vecs[row[at]] * x[at, None], starts[lo:lo + 256] - first, axis=0)
                sums[slot[code[order[starts[lo:lo + 256]]]]] += part
        if now is not None:
            yield finished(slots, sums, counts)

    return word_blocks(cells, wv, block_docs).mapInArrow(run, "doc_id long, vec array<double>").select(
        F.col("doc_id").cast(id_type).alias("doc_id"), "vec")


def mean_vectors(counts: DataFrame, wv: DataFrame, keys: tuple[str, ...] = ("doc_id",), dim: int | None = None) -> DataFrame:
    """Mean of word vectors over in-vocabulary token occurrences; ``dim``: their length, if short.

    Out-of-vocabulary tokens are dropped first (inner join); a document with
    no in-vocabulary token gets no row (instead of a mean of nothing).
    """
    rows = counts.join(wv, "term") if dim is None else W.joined_in_place(counts, wv, W.most_documents(counts))
    return _weighted_sum(rows, list(keys), F.col("n").cast("double"), F.col("n"), dim)


def tfidf_mean_vectors(counts: DataFrame, wv: DataFrame, fit_where: Column, n_fit_docs: Column,
                       tf_mode: str = "raw", idf_mode: str = "floor",
                       keys: tuple[str, ...] = ("doc_id",), dim: int | None = None) -> DataFrame:
    """TF-IDF weighted mean of word vectors.

    idf comes from the *unfiltered* fitted rows (``fit_where``), tf from the
    in-vocabulary tokens of each document; a term unseen in the fitted rows
    takes the minimum idf. Summed over token occurrences:
    sum_t n_t * tf(t) * idf(t) * v(t) / sum_t n_t.
    """
    if dim is None:
        rows = _tfidf_rows(counts, wv, fit_where, n_fit_docs, tf_mode, idf_mode).join(wv, "term")
    else:  # short vectors travel to the words' cells, with the idf
        idf = W.fit_idf(counts, n_fit_docs, idf_mode, where=fit_where).select("term", "idf")
        known = wv.join(idf, "term", "left").withColumn("idf", F.coalesce(F.col("idf"), idf.select(F.min("idf")).scalar()))
        rows = (W.with_tf(W.joined_in_place(counts, known, W.most_documents(counts)), tf_mode)
                .withColumn("x", F.col("n") * F.col("tf") * F.col("idf")))
    return _weighted_sum(rows, list(keys), F.col("x"), F.col("n"), dim)


def _tfidf_rows(counts: DataFrame, wv: DataFrame, fit_where: Column, n_fit_docs: Column, tf_mode: str, idf_mode: str) -> DataFrame:
    """``counts`` of the words that have a vector, with ``x`` = n * tf * idf."""
    idf = W.fit_idf(counts, n_fit_docs, idf_mode, where=fit_where).select("term", "idf")
    min_idf = idf.select(F.min("idf")).scalar()
    inv = counts.join(wv.select("term"), "term", "left_semi")
    tf = W.with_tf(inv, tf_mode)
    return (tf.join(idf, "term", "left")
              .withColumn("idf", F.coalesce(F.col("idf"), min_idf))
              .withColumn("x", F.col("n") * F.col("tf") * F.col("idf")))


def blocked_tfidf_mean_vectors(counts: DataFrame, wv: DataFrame, fit_where: Column, n_fit_docs: Column,
                               tf_mode: str = "raw", idf_mode: str = "floor") -> DataFrame:
    """(doc_id, vec): ``tfidf_mean_vectors`` by ``blocked_mean_vectors``."""
    rows = _tfidf_rows(counts, wv, fit_where, n_fit_docs, tf_mode, idf_mode)
    return blocked_mean_vectors(rows.select("doc_id", "term", "x", "n"), wv)


def pair_counts(tokens: DataFrame, window: int = 10) -> DataFrame:
    """(term, ctx, n), term <= ctx: unordered pairs of words at most ``window`` places apart in a sentence.

    tokens: (doc_id, sid, wid, term). A sentence's words are gathered in order; the pairs of a batch of
    sentences are counted as numbers before a string of them is made.
    """
    sents = (tokens.groupBy("doc_id", "sid").agg(F.array_sort(F.collect_list(F.struct("wid", "term"))).alias("w"))
             .select(F.transform("w", lambda x: x["term"]).alias("w")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = pc.list_value_length(batch["w"]).to_numpy()
            coded = batch["w"].flatten().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words, sid = place[coded.indices.to_numpy()], np.repeat(np.arange(len(lens)), lens)
            found = []
            for apart in range(1, min(window, len(words) - 1) + 1):
                x, y = words[:-apart], words[apart:]
                both = sid[:-apart] == sid[apart:]
                found.append(np.minimum(x, y)[both] * len(order) + np.maximum(x, y)[both])
            keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            names = coded.dictionary.take(pa.array(order))
            low, high = np.divmod(keys, max(len(order), 1))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(low)), names.take(pa.array(high)), pa.array(counts)],
                                             ["term", "ctx", "n"])

    return (sents.mapInArrow(count, "term string, ctx string, n long")
            .groupBy("term", "ctx").agg(F.sum("n").alias("n")))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Unordered pairs (term, ctx, n, ...) in both directions; a word beside itself counts twice.

    Of ``mark`` and ``ctx_mark``, if there, a row keeps its context's, as ``mark``."""
    more = [c for c in pairs.columns if c not in ("term", "ctx", "mark", "ctx_mark")]
    mark = lambda c: [F.col(c).alias("mark")] if c in pairs.columns else []
    one = F.struct(F.col("term"), F.col("ctx"), *more, *mark("ctx_mark"))
    two = F.struct(F.col("ctx").alias("term"), F.col("term").alias("ctx"), *more, *mark("mark"))
    alone = F.struct(F.col("term"), F.col("ctx"), *[(2 * F.col(c)).alias(c) if c == "n" else F.col(c) for c in more], *mark("mark"))
    return pairs.select(F.explode(F.when(F.col("term") == F.col("ctx"), F.array(alone)).otherwise(F.array(one, two))).alias("p")).select("p.*")


def cooccurrences(tokens: DataFrame, window: int = 10) -> DataFrame:
    """(term, ctx, n): ordered pairs of words at most ``window`` places apart in a sentence, both directions."""
    return mirrored(pair_counts(tokens, window))


def ppmi(pairs: DataFrame, mark: Column | None = None) -> DataFrame:
    """(term, ctx, n, ppmi), both directions: positive pointwise mutual information of unordered pairs.

    ``pairs`` is read several times. Each pair travels once to each of its two words' totals and is mirrored last.
    ``mark``: a value of ``term``, made once a word; the rows then have the context's as ``mark``.
    """
    whole = mirrored(pairs).groupBy("term").agg(F.sum("n").alias("total"))
    n = whole.select(F.sum("total")).scalar()
    if mark is not None:
        whole = whole.withColumn("mark", mark)
    seen = F.when(F.col("term") == F.col("ctx"), 2 * F.col("n")).otherwise(F.col("n"))
    info = F.log(seen * n / (F.col("total") * F.col("ctx_total")))
    marks = [] if mark is None else ["mark", "ctx_mark"]
    far = whole.select(*[F.col(c).alias("ctx" if c == "term" else f"ctx_{c}") for c in whole.columns])
    return mirrored(pairs.join(whole, "term").join(far, "ctx")
                    .select("term", "ctx", "n", F.greatest(info, F.lit(0.0)).alias("ppmi"), *marks))


_STEP_BITS = 16  # of a step in a word's mark: 2 * place + sign


def step_mark(dim: int = 300, places: int = 4) -> Column:
    """The ``places`` signed unit steps in ``dim`` dimensions that a word (``term``) stands for, from its md5, in one number."""
    if places * _STEP_BITS > 64 or 2 * dim > 1 << _STEP_BITS:
        raise ValueError(f"{places} steps in {dim} dimensions do not fit a number of 64 bits")
    mark = F.lit(0).cast("long")
    for j in range(places):
        h = F.md5(F.concat(F.col("term"), F.lit(f"#{j}")))
        at = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim))
        mark = mark.bitwiseOR(F.shiftleft(2 * at + F.when(F.substring(h, 9, 1) < "8", 0).otherwise(1), _STEP_BITS * j))
    return mark


#: Words whose sums a task of ``indexed_word_vectors`` holds, about.
INDEXED_WORDS = 8192


def indexed_word_vectors(info: DataFrame, dim: int = 300, places: int = 4, words: int | None = None) -> DataFrame:
    """(term, vec), unit length: the PPMI row of every word, projected by random indexing.

    info: (term, ppmi, mark), the mark being the context's ``step_mark`` of the same ``dim`` and ``places``; ``words``:
    about how many words it has, if known (it shapes the plan only).
    Each context stands for ``places`` signed unit steps in ``dim`` dimensions,
    taken from md5 of the word, which keeps inner products in expectation. A pair travels
    to its word as those steps, and a task adds up the rows of ``INDEXED_WORDS`` words as it reads them: no vocabulary
    on the driver, every word of ``info``, and no dependence on cores or partitions. A word without informative contexts
    has zeros, one without any co-occurrence no row.
    """
    if words is None:
        words = info.select(F.approx_count_distinct("term")).first()[0]
    rows = info.select("term", "ppmi", "mark").repartition(max(1, -(-words // INDEXED_WORDS)), "term")
    shifts = np.arange(places, dtype=np.uint64) * np.uint64(_STEP_BITS)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sums = {}, np.zeros((0, dim))
        for batch in batches:
            coded = batch["term"].dictionary_encode()
            slot = np.array([slots.setdefault(t, len(slots)) for t in coded.dictionary.to_pylist()], np.int64)
            if len(slots) > len(sums):
                sums = np.vstack([sums, np.zeros((max(len(slots), len(sums) * 5 // 4) - len(sums), dim))])
            step = (batch["mark"].to_numpy().view(np.uint64)[:, None] >> shifts & np.uint64((1 << _STEP_BITS) - 1)).astype(np.int64)
            x = batch["ppmi"].to_numpy()[:, None] * (1.0 - 2.0 * (step & 1))
            at = slot[coded.indices.to_numpy()][:, None] * dim + (step >> 1)
            np.add.at(sums.reshape(-1), at.reshape(-1), x.reshape(-1))
        names = list(slots)
        for lo in range(0, len(names), 1024):
            part = sums[lo:min(lo + 1024, len(names))]
            size = np.sqrt(np.einsum("ij,ij->i", part, part))
            part = part / np.where(size > 0, size, 1.0)[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[lo:lo + 1024]), pa.ListArray.from_arrays(np.arange(0, part.size + 1, dim, dtype=np.int32), part.reshape(-1))],
                ["term", "vec"])

    return rows.mapInArrow(add_up, "term string, vec array<double>")


def train_word_vectors(sentences: DataFrame, col: str = "sentence", dim: int = 300, window: int = 10,
                       min_count: int = 0, max_iter: int = 1, seed: int = 1,
                       partitions: int | None = None, normalize: bool = True) -> DataFrame:
    """Train word vectors on a table of token arrays (one row per sentence) with
    MLlib Word2Vec (skip-gram, hierarchical softmax) and return
    (term, vec ARRAY<DOUBLE>), unit length by default. MLlib keeps the vocabulary
    and its vectors on the driver: for vocabularies that fit there;
    ``indexed_word_vectors`` has no such bound. More ``partitions`` train faster at some cost in quality."""
    from pyspark.ml.feature import Word2Vec
    w2v = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=max_iter,
                   seed=seed, inputCol=col, outputCol="_v",
                   numPartitions=partitions or 1)
    model = w2v.fit(sentences.select(col))
    vecs = model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec"))
    return normalize_vectors(vecs) if normalize else vecs


def lookup(wv: DataFrame, word: str) -> DataFrame:
    """The vector of one word (empty when out of vocabulary)."""
    return wv.where(F.col("term") == F.lit(word))


def save_word2vec(sentences: DataFrame, path: str, col: str = "sentence", dim: int = 300, window: int = 10,
                  min_count: int = 0, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Train MLlib Word2Vec, save the model itself (reloadable with
    ``Word2VecModel.load``) and return its (term, vec) table."""
    from pyspark.ml.feature import Word2Vec
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, seed=seed,
                     inputCol=col, outputCol="_v", numPartitions=partitions or 1).fit(sentences.select(col))
    model.write().overwrite().save(path)
    return model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec"))
