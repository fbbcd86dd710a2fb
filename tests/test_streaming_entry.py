import os

import duckdb

from conftest import SF0001
from wordloom.streaming.score import score_stream


def test_score_stream_matches_batch(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    ref = docs.where("doc_id % 5 <> 0")
    new = docs.where("doc_id % 5 = 0")
    src = f"{tmpdir_path}/incoming"
    new.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = score_stream(stream, ref, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt", k=3, trigger_once=True)
    q.awaitTermination(300)
    out = spark.read.parquet(f"{tmpdir_path}/out")
    assert out.count() == 3 * new.count()
    assert out.groupBy("new_id").count().where("count <> 3").count() == 0


def test_score_stream_reads_the_reference_once(spark, tmpdir_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} common") for i in range(30)], "doc_id long, text string")
    ref = f"{tmpdir_path}/ref"
    docs.where("doc_id < 20").write.parquet(ref)
    src = f"{tmpdir_path}/in"
    docs.where("doc_id >= 20").repartition(2).write.parquet(src)
    reference = spark.read.parquet(ref)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = score_stream(stream, reference, f"{tmpdir_path}/out", f"{tmpdir_path}/ck", k=2, trigger_once=True)
    import shutil
    shutil.move(ref, f"{ref}-gone")  # the batches have tables of their own
    q.awaitTermination(300)
    assert q.exception() is None and spark.read.parquet(f"{tmpdir_path}/out").count() == 20


def test_entry_and_oracles_small(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["new_id", "rank", "old_id", "dist"]
    assert df.count() == 3 * 40
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    from tools.oracle_check import canon
    for name in ("topk_cosine_tfidf", "cluster_scores_fixed", "doc_vectors_tfidf_weighted", "word_index"):
        got = qs[name](spark, SF0001)
        rows = [tuple(r) for r in got.collect()]
        cur = con.execute(f"SELECT * FROM ({sql[name]})")
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(got.columns), name
        assert canon(rows, got.columns) == canon(cur.fetchall(), cols), name


def test_same_rows_at_any_partitioning(spark):
    """No registered result depends on how the scan is spread."""
    import __spark_entry__ as E
    from tools.oracle_check import canon
    names = ["topk_cosine_tfidf", "topk_euclidean_embeddings", "kmeans_scores", "doc_vectors_mean", "padded_sequences",
             "cluster_contingency", "pca_projection", "lsi_explained_variance"]
    seen = {}
    try:
        for parts in ("3", "16"):
            spark.conf.set("spark.wordloom.scanPartitions", parts)
            for name in names:
                df = E.queries()[name](spark, SF0001)
                seen.setdefault(name, []).append(canon([tuple(r) for r in df.collect()], df.columns))
    finally:
        spark.conf.unset("spark.wordloom.scanPartitions")
    assert not [n for n, (a, b) in seen.items() if a != b]
