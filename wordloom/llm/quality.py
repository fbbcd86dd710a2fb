"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import blobs, by_bytes, maybe_in, utf8, write_state
from wordloom.llm.textgrams import SPACE, distinct, mix, powers, running_hash, word_spans, LOWER

#: Bounds of the fit: labelled documents, and words and word beginnings that count as signs.
SAMPLE, SIGNS = 20000, 8192
LEAST_Z = 6.0
PREFIXES = (4, 5)
_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n", "!?", "|", ",.;:",
           "'\"`", "()[]{}<>", "#$%&*@^~", "-_=+/\\"]
_MEMBER = np.zeros((256, len(_GROUPS) + 2))
for _i, _g in enumerate(_GROUPS):
    _MEMBER[[ord(c) for c in _g], _i] = 1
_MEMBER[128:, -2] = 1
_MEMBER[:, -1] = _MEMBER[:, :-1].sum(axis=1) == 0  # control characters
N_FEATURES = _MEMBER.shape[1] + 7


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in order with each text's first, and as further columns the hashes of the words' beginnings."""
    columns, starts = [np.zeros((0, 1 + len(PREFIXES)), np.uint64)], [np.zeros(0, np.int64)]
    for lo, s, e, h in word_spans(data, offsets):
        piece = data[lo: lo + (int(e[-1]) if len(e) else 0)]
        total, (_, down) = running_hash(LOWER[piece]), powers(len(piece) + 1)
        more = [mix((total[np.minimum(s + n, e)] - total[s]) * down[s] + np.uint64(1000 + n)) for n in PREFIXES]
        columns.append(np.stack([h, *more], axis=1))
        starts.append(s + lo)
    return np.concatenate(columns), np.searchsorted(np.concatenate(starts), offsets)


def features(data: np.ndarray, offsets: np.ndarray, signs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row per text: shares of byte groups, word and line statistics, and the strongest signs. Whole texts."""
    words, first = tokens(data, offsets)
    if len(signs):
        at = np.minimum(np.searchsorted(signs, words), len(signs) - 1)
        found = np.where(signs[at] == words, weights[at], 0.0).max(axis=1, initial=0.0)
    else:
        found = np.zeros(len(words))
    out = np.zeros((len(offsets) - 1, N_FEATURES))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        count = np.bincount(data[a:b], minlength=256)
        size = max(b - a, 1)
        out[i, :_MEMBER.shape[1]] = np.sqrt(count @ _MEMBER / size)
        lo, hi = first[i], first[i + 1]
        own, n = words[lo:hi, 0], hi - lo
        if n:
            runs = np.diff(np.flatnonzero(np.concatenate([[True], (x := np.sort(own))[1:] != x[:-1], [True]])))
            out[i, -7:] = (np.log1p(size), len(runs) / n, runs.max() / n, np.sqrt((own[1:] == own[:-1]).sum() / n),
                           np.log(size / n), found[lo:hi].max(), np.sqrt((found[lo:hi] > 0).sum() / n))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; (weights with the intercept last, scale rows: mean and deviation)."""
    scale = np.stack([x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)])
    z = np.hstack([(x - scale[0]) / scale[1], np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def probabilities(x: np.ndarray, model: tuple[np.ndarray, np.ndarray] | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(x), model)
    w, scale = model
    return 1 / (1 + np.exp(-np.clip((np.clip((x - scale[0]) / scale[1], -20, 20)) @ w[:-1] + w[-1], -30, 30)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        words, first = tokens(*utf8(batch["text"]))
        good = batch["good"].to_numpy()
        for lo in range(0, len(good), 200):
            sets = [distinct(words[a:b].reshape(-1)) for a, b in zip(first[lo:lo + 200], first[lo + 1: lo + 201])]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            mine = np.repeat(good[lo: lo + 200], [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(mine.astype(np.int64))],
                                             ["token", "good"])


def fit(docs: DataFrame, labels: DataFrame):
    """(signs, their weights, model), from at most SAMPLE labelled documents, those with the smallest hash of doc_id.

    Good is quality 1 and not toxic. Signs are words and word beginnings that
    bad documents hold far too often to be chance (z >= 6), at most SIGNS of them, with
    their log odds; the model is a ridge logistic regression on ``features``.
    Without both kinds of labelled documents the model is the smoothed share of good ones.
    """
    chosen = (labels.where("doc_id is not null and quality is not null")
              .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")).alias("good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    chosen = write_state(chosen, "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = write_state(maybe_in(texts, "doc_id", chosen.select("doc_id")).join(chosen, "doc_id"), "sample")
    total = {r["good"]: r["count"] for r in sample.groupBy("good").count().collect()}
    n_good, n_bad = total.get(1, 0), total.get(0, 0)
    share = (n_good + 1) / (n_good + n_bad + 2)
    if not n_good or not n_bad:
        return np.zeros(0, np.uint64), np.zeros(0), float(share)
    counted = (sample.select("text", "good").mapInArrow(_words, "token long, good long").groupBy("token")
               .agg(F.count("*").alias("n"), F.sum("good").alias("g")))
    bad_share = n_bad / (n_good + n_bad)
    z = ((F.col("n") - F.col("g")) - F.col("n") * bad_share) / F.sqrt(F.col("n") * bad_share * (1 - bad_share))
    odds = F.log((F.col("n") - F.col("g") + 0.5) / n_bad) - F.log((F.col("g") + 0.5) / n_good)
    got = sorted((np.int64(r["token"]).view(np.uint64), r["odds"]) for r in
                 counted.withColumn("z", z).withColumn("odds", odds).where(F.col("z") >= LEAST_Z)
                 .orderBy(F.desc("z"), "token").limit(SIGNS).select("token", "odds").collect())
    signs, weights = np.array([t for t, _ in got], np.uint64), np.array([o for _, o in got])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            x = features(*utf8(batch["text"]), signs, weights)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["good"], blobs([r.tobytes() for r in x])],
                                             ["doc_id", "good", "x"])

    rows = sorted(sample.select("doc_id", "good", "text").mapInArrow(describe, "doc_id long, good int, x binary").collect())
    return signs, weights, fit_logistic(np.array([np.frombuffer(r["x"]) for r in rows]),
                                        np.array([float(r["good"]) for r in rows]))


def _strength(sites: DataFrame, prior: Column) -> float:
    """Method of moments: how many documents the level above counts for, from rows (n, s, prior)."""
    gap = F.pow(F.col("s") / F.col("n") - prior, 2)
    r = sites.agg(F.sum(F.col("n") * gap).alias("between"), F.sum(prior * (1 - prior)).alias("within"),
                  F.sum("n").alias("n"), F.avg(prior * (1 - prior)).alias("spread")).first()
    if not r["n"]:
        return 1.0
    variance = max((r["between"] - r["within"]) / r["n"], 1e-9)
    return float(min(max(r["spread"] / variance - 1, 1.0), 1e6))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                   threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, quality, kept) per row of ``docs``.

    ``docs`` has doc_id, text and the columns that name a document's host and path below it;
    ``labels`` doc_id, quality and toxic. evidence is the classifier's
    probability that the document is good. Each host's share of good documents
    (the sum of the evidence over all its documents) is shrunk toward the corpus'
    share, each path's toward its host's posterior, with strengths fitted by the method of
    moments, so a site with few documents takes the level above. quality adds to the
    evidence's log odds the path posterior's, less the corpus'; documents below ``threshold`` are not kept.

    A null host or path is a site of its own. Null and empty texts get the
    evidence of a text without words; they are judged like others. Repeated rows each come back
    alike. An empty ``docs`` gives no rows; without usable labels every document gets the same evidence.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, weights, logistic = model.value
        for batch in by_bytes(batches):
            p = probabilities(features(*utf8(batch["text"]), signs, weights), logistic)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], batch["path"], pa.array(p)],
                                             ["doc_id", "host", "path", "evidence"])

    judged = write_state(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                                     F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
                         .mapInArrow(judge, "doc_id long, host string, path string, evidence double"), "judged")
    # rounded, so that sums do not depend on the order of addition
    soft = F.sum(F.round(F.col("evidence") * 1e6).cast("long")).alias("e")
    paths = write_state(judged.groupBy("host", "path").agg(F.count("*").alias("n"), soft)
                        .withColumn("s", F.col("e") / 1e6), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), (F.sum("e") / 1e6).alias("s"))
    whole = paths.agg(F.sum("n").alias("n"), (F.sum("e") / 1e6).alias("s")).first()
    base = (whole["s"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    k = _strength(hosts, F.lit(base))
    hosts = hosts.select("host", ((F.col("s") + k * base) / (F.col("n") + k)).alias("host_posterior"))
    named = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    k = _strength(named, F.col("host_posterior"))
    named = named.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior",
                         ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))
    odds = lambda p: F.log(p) - F.log1p(-p)
    safe = lambda p: F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    total = odds(safe("evidence")) + odds(safe("path_posterior")) - float(np.log(base) - np.log1p(-base))
    return (judged.join(named, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
            .withColumn("quality", 1 / (1 + F.exp(-total)))
            .select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality",
                    (F.col("quality") >= threshold).alias("kept")))
