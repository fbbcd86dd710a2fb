"""Stream-static scoring: documents arriving on a stream are weighted with a
TF-IDF model fitted on the reference corpus and ranked against it.

Stateless per micro-batch (no aggregation across batches, so no watermark or
state store): ``foreachBatch`` runs the same batch plan (term counts -> model
join -> blocked top-k) on each micro-batch and appends the result. Restarts
resume from the checkpoint location; the sink write is idempotent per batch id
(one output directory per batch, overwritten on replay).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import weights as W
from ..operators.similarity import sparse_topk_sided
from ..session import write_state


def fit_reference(ref_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model(term, idf), ref_weights(doc_id, term, w)) from (doc_id, text)."""
    counts = W.term_counts(ref_docs.select("doc_id", T.unicode_terms("text").alias("tokens")))
    model = W.fit_tfidf(counts, W.count_docs(ref_docs.select("doc_id")), mode="smooth")
    return model, W.apply_tfidf(counts, model, normalize=False)


def score_batch(batch: DataFrame, model: DataFrame, ref_w: DataFrame, ref_ids: DataFrame, k: int) -> DataFrame:
    counts = W.term_counts(batch.select("doc_id", T.unicode_terms("text").alias("tokens")))
    q = W.apply_tfidf(counts, model, normalize=False)
    w = (q.select("doc_id", F.lit(True).alias("is_query"), "term", "w")
          .unionByName(ref_w.select("doc_id", F.lit(False).alias("is_query"), "term", "w")))
    ids = (batch.select("doc_id", F.lit(True).alias("is_query"))
                .unionByName(ref_ids.select("doc_id", F.lit(False).alias("is_query"))))
    top = sparse_topk_sided(w, ids, k, "cosine")
    return top.select(F.col("query_id").alias("new_id"), F.col("rank").cast("long").alias("rank"),
                      F.col("ref_id").alias("old_id"), F.round("dist", 6).alias("dist"))


def score_stream(new_stream: DataFrame, ref_docs: DataFrame, out_path: str, checkpoint: str,
                 k: int = 3, trigger_once: bool = False):
    """Start the streaming query; returns the ``StreamingQuery``.

    The model, the reference weights and ids are written as tables once, so the
    reference corpus is read and tokenised once, not in every micro-batch.
    """
    model, ref_w = (write_state(t, n) for t, n in zip(fit_reference(ref_docs), ("model", "weights")))
    ref_ids = write_state(ref_docs.select("doc_id"), "ids")

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        score_batch(batch, model, ref_w, ref_ids, k) \
            .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    w = new_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
