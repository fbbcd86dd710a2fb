import math

from pyspark.sql import functions as F

from conftest import tiny_docs
from wordloom.functions import text as T
from wordloom.operators import weights as W


def counts(spark):
    d = tiny_docs(spark)
    return W.term_counts(d.select("doc_id", T.whitespace_tokens("text").alias("tokens")))


def test_idf_modes_f8(spark):
    c = counts(spark)
    n = F.lit(4)
    got = {m: {r["term"]: r["idf"] for r in W.fit_idf(c, n, m).collect()}
           for m in ("floor", "real", "smooth", "spark")}
    assert math.isclose(got["floor"]["dog"], 1.0)
    assert math.isclose(got["floor"]["bird"], 2.386294, abs_tol=1e-6)
    assert math.isclose(got["real"]["dog"], 1.287682, abs_tol=1e-6)
    assert math.isclose(got["smooth"]["cat"], 1.510826, abs_tol=1e-6)
    assert math.isclose(got["spark"]["fish"], 0.510826, abs_tol=1e-6)


def test_tf_modes_f8(spark):
    c = counts(spark)
    aug = {(r["doc_id"], r["term"]): r["tf"] for r in W.with_tf(c, "augmented").collect()}
    sub = {(r["doc_id"], r["term"]): r["tf"] for r in W.with_tf(c, "sublinear").collect()}
    assert aug[(0, "cat")] == 1.0 and aug[(0, "dog")] == 0.75 and aug[(2, "cat")] == 0.75
    assert math.isclose(sub[(2, "bird")], 1.693147, abs_tol=1e-6)


def test_tfidf_rows_f8(spark):
    c = counts(spark)
    model = W.fit_tfidf(c, F.lit(4), mode="smooth")
    w = {(r["doc_id"], r["term"]): r["w"] for r in W.apply_tfidf(c, model).collect()}
    assert math.isclose(w[(0, "cat")], 0.926937, abs_tol=1e-6)
    assert math.isclose(w[(1, "fish")], 0.777221, abs_tol=1e-6)
    assert math.isclose(w[(2, "bird")], 0.891844, abs_tol=1e-6)
    assert math.isclose(w[(3, "fish")], 1.0)
    # unit rows
    norms = W.apply_tfidf(c, model).groupBy("doc_id").agg(F.sum(F.col("w") ** 2).alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in norms)


def test_vocabulary_cut(spark):
    c = counts(spark)
    top = [r["term"] for r in W.top_terms(c, 2).collect()]
    # cf: cat 3, dog 3, bird 2, fish 2 -> cat, dog (ties by term)
    assert sorted(top) == ["cat", "dog"]
    where = F.col("doc_id") != 2
    assert sorted(r["term"] for r in W.fit_vocabulary(c, None, where).collect()) == ["cat", "dog", "fish"]


def _cells(spark):
    """Words of two documents or more, words of one, a repeated and a null id."""
    docs = [(1, "a", "cat dog cat x1"), (2, "a", "cat fish x2"), (3, "b", "dog cat x3 x3"), (3, "b", "cat x4"), (None, "b", "cat x5")]
    d = spark.createDataFrame(docs, "doc_id long, side string, text string")
    return W.term_counts(d.select("doc_id", "side", T.whitespace_tokens("text").alias("tokens")), keep=("side",))


def test_frequent_terms_stay_with_their_document(spark, monkeypatch):
    """Whichever terms are broadcast the rows are the same; counts, weights and norms need one exchange by doc_id."""
    c = _cells(spark)
    model = W.fit_tfidf(c, F.lit(5), mode="smooth")
    rows = lambda: sorted((r["doc_id"] or 0, r["term"], r["w"]) for r in W.apply_tfidf(c, model, keep=("side",)).collect())
    want = rows()
    assert len(want) == len({w[:2] for w in want}) == c.count()
    monkeypatch.setattr(W, "HOT_TERMS", 2)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2]) for a, b in zip(rows(), want, strict=True))
    plan = W.apply_tfidf(c, model, keep=("side",))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "REPARTITION_BY_COL" in plan
    assert not any("hashpartitioning(doc_id" in line and "ENSURE_REQUIREMENTS" in line for line in plan.splitlines())


def test_short_vectors_join_rare_and_frequent_terms(spark, monkeypatch):
    from wordloom.operators import embed as E
    c = _cells(spark)
    wv = E.hashed_word_vectors(W.document_frequency(c).select("term").where("term <> 'x2'"), 4)
    for mode in ("raw", "augmented"):
        for hot in (65536, 2):
            monkeypatch.setattr(W, "HOT_TERMS", hot)
            short, long = ({r["doc_id"]: r["vec"] for r in E.tfidf_mean_vectors(c, wv, F.col("side") == "a", F.lit(2), mode, dim=d).collect()}
                           for d in (4, None))
            assert short.keys() == long.keys() == {1, 2, 3, None}
            assert all(math.isclose(x, y, abs_tol=1e-12) for i in long for x, y in zip(short[i], long[i], strict=True))
