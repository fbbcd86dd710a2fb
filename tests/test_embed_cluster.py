import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import tiny_docs
from wordloom.functions import text as T
from wordloom.functions import vectors as V
from wordloom.operators import cluster as C
from wordloom.operators import embed as E
from wordloom.operators import sequence as S
from wordloom.operators import similarity
from wordloom.operators import weights as W


def f9(spark):
    d = tiny_docs(spark)
    counts = W.term_counts(d.select("doc_id", T.whitespace_tokens("text").alias("tokens")))
    wv = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0]), ("fish", [1.0, 1.0])],
                               "term string, vec array<double>")
    return counts, wv


def vecs(df):
    return {r["doc_id"]: r["vec"] for r in df.collect()}


def close(a, b):
    return all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b))


def test_f9_mean(spark):
    counts, wv = f9(spark)
    got = vecs(E.mean_vectors(counts, wv))
    assert close(got[0], [0.666667, 0.333333]) and close(got[2], [0.5, 0.5]) and close(got[3], [1, 1])


def test_f9_tfidf_modes(spark):
    counts, wv = f9(spark)
    gold = {"raw": [2.257530, 0.333333], "sublinear": [1.911165, 0.333333], "augmented": [1.128765, 0.25]}
    for mode, g in gold.items():
        got = vecs(E.tfidf_mean_vectors(counts, wv, F.lit(True), F.lit(4), tf_mode=mode))
        assert close(got[0], g), mode
        assert close(got[1], [0.846574, 1.346574])
        assert close(got[2], [0.846574, 0.5])
        assert close(got[3], [1.693147, 1.693147])


def test_new_side_uses_min_idf(spark):
    counts, wv = f9(spark)
    fit = F.col("doc_id") != 3            # 'fish' alone in d3 -> still seen in d1
    fit2 = F.col("doc_id").isin(0, 2)     # fish unseen -> min idf
    got = vecs(E.tfidf_mean_vectors(counts, wv, fit2, F.lit(2), tf_mode="raw"))
    # fitted on d0, d2 (N=2): cat df 2 -> 1 + ln 1 = 1, dog df 2 -> 1; min idf = 1
    assert close(got[3], [1.0, 1.0])
    assert vecs(E.tfidf_mean_vectors(counts, wv, fit, F.lit(3)))[3] is not None


def test_f10_scores(spark):
    rows = [(0, "a", 3), (0, "b", 1), (1, "b", 2), (1, "c", 2), (2, "c", 2)]
    cont = spark.createDataFrame(rows, "cluster_id long, label string, n long")
    s = C.scores(cont).first()
    assert s["n"] == 10 and math.isclose(s["purity"], 0.7)
    assert math.isclose(s["entropy"], -0.724511, abs_tol=1e-6)
    assert math.isclose(C.scores(cont, signed=False).first()["entropy"], 0.724511, abs_tol=1e-6)
    maj = {r["cluster_id"]: r["label"] for r in C.majority_label(cont).collect()}
    assert maj == {0: "a", 1: "b", 2: "c"}


def test_lloyd_cost_does_not_rise(spark):
    pts = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(40)], "doc_id long, vec array<double>")
    cen = spark.createDataFrame([(0, [0.0, 0.0]), (1, [6.0, 5.0])], "cluster_id long, vec array<double>")
    s1 = C.lloyd_step(pts, cen)
    s2 = C.lloyd_step(pts, s1.select("cluster_id", "vec"))
    c1 = s1.agg(F.sum("cost")).first()[0]
    c2 = s2.agg(F.sum("cost")).first()[0]
    assert c2 <= c1 + 1e-9


def test_kmeans_separated_groups(spark):
    pts = spark.createDataFrame([(i, [float(i % 2) * 10 + (i % 3) * 0.1, 0.0]) for i in range(30)],
                                "doc_id long, vec array<double>")
    a, centers = C.kmeans(pts, 2)
    groups = {r["doc_id"]: r["cluster_id"] for r in a.collect()}
    assert len({groups[i] for i in range(0, 30, 2)}) == 1 and groups[0] != groups[1]
    assert centers.count() == 2
    zero = pts.union(spark.createDataFrame([(99, [0.0, 0.0])], pts.schema))
    assert {r["doc_id"]: r["cluster_id"] for r in C.kmeans(zero, 2, metric="cosine")[0].collect()}[99] == -1


def test_kmeans_same_at_any_partitioning(spark):
    import random
    rng = random.Random(5)
    pts = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)], "doc_id long, vec array<double>")
    runs = [{r["doc_id"]: r["cluster_id"] for r in C.kmeans(pts.repartition(n), 5, max_iter=8)[0].collect()} for n in (1, 4, 37)]
    assert runs[0] == runs[1] == runs[2]


def test_registered_kmeans_runs_until_nothing_moves(spark, tmpdir_path):
    """Points that need more than 8 steps; the scores are those of a brute-force fit."""
    import hashlib
    import numpy as np
    from wordloom.plans import clusterplans as P
    rng = np.random.RandomState(4)
    x = rng.rand(3000, 2)
    labels = [int(v * 5) for v in x[:, 0]]
    spark.createDataFrame([(i, [float(v) for v in p], labels[i]) for i, p in enumerate(x)],
                          "vec_id long, embedding array<double>, label long").write.parquet(f"{tmpdir_path}/embeddings.parquet")

    def fit(steps):
        order = sorted(range(len(x)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        c, done = x[order[:P.K]], 0
        while True:
            near = np.linalg.norm(x[:, None] - c[None], axis=2).argmin(axis=1)
            new = np.array([x[near == j].mean(axis=0) for j in range(P.K)])
            if done == steps or np.abs(new - c).max() < 1e-12:
                return near, done
            c, done = new, done + 1

    def purity(near):
        return sum(max(np.bincount(np.array(labels)[near == j])) for j in range(P.K)) / len(x)

    full, steps = fit(None)
    assert steps > 8
    assert abs(P.kmeans_scores(spark, tmpdir_path).first()["purity"] - purity(full)) < 1e-6
    assert abs(purity(full) - purity(fit(8)[0])) > 1e-6
    assert abs(P.kmeans_scores(spark, tmpdir_path, max_iter=P.SQL_STEPS).first()["purity"] - purity(fit(8)[0])) < 1e-6


def test_spectral_separates_groups(spark):
    """Two clouds, one much wider than the other, at any scale."""
    import random
    rng = random.Random(3)
    cloud = [(0.0, 0.2) if i % 2 else (9.0, 2.0) for i in range(120)]
    base = [[rng.gauss(x, s), rng.gauss(0, s)] for x, s in cloud]
    for scale in (1.0, 1000.0):
        pts = spark.createDataFrame([(i, [scale * v for v in p]) for i, p in enumerate(base)], "doc_id long, vec array<double>")
        got = {r["doc_id"]: r["cluster_id"] for r in C.spectral(pts, 2, neighbours=15).collect()}
        assert len({got[i] for i in range(0, 120, 2)}) == 1 and len({got[i] for i in range(1, 120, 2)}) == 1
        assert got[0] != got[1]


def test_spectral_in_small_blocks(spark):
    """Many blocks give the clusters of one; a step's vectors travel once a pair of blocks, not once an edge."""
    rng = np.random.RandomState(5)
    x = np.vstack([rng.randn(60, 3) + 4 * c for c in np.eye(3)])
    pts = spark.createDataFrame([(7 * i, [float(v) for v in p]) for i, p in enumerate(x)], "doc_id long, vec array<double>")
    one, many = ({r["doc_id"]: r["cluster_id"] for r in C.spectral(pts, 3, max_iter=6, block_nodes=n).collect()} for n in (1000, 9))
    assert one == many and len(one) == 180
    v = np.arange(8.0).reshape(4, 2)
    takes = np.array([3, 1], "<i4").tobytes()
    rows = pa.table({"s": pa.array([2, 2], pa.int32()), "t": pa.array([-1, 5], pa.int32()),
                     "data": pa.array([v.tobytes(), takes], pa.binary())}).to_batches()
    sent = pa.Table.from_batches(C._sent(2)(iter(rows))).to_pylist()
    assert [(r["t"], r["s"]) for r in sent] == [(2, -1), (5, 2)]
    assert (np.frombuffer(sent[1]["data"]).reshape(-1, 2) == v[[3, 1]]).all()


def test_search_of_all_rows_for_all_rows(spark):
    """The same nearest as with every row on both sides: copies, repeated ids and zero vectors too."""
    rng = np.random.RandomState(6)
    rows = [(i, [float(v) for v in rng.randint(0, 3, 4)]) for i in range(60)] + [(3, [1.0, 2.0, 0.0, 1.0]), (80, [0.0] * 4)]
    pts = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    both = pts.withColumn("is_query", F.lit(True)).unionByName(pts.withColumn("is_query", F.lit(False)))
    for metric in ("euclidean", "cosine"):
        want = sorted(map(str, similarity.dense_topk_sided(both, 5, metric).collect()))
        for block in (None, 11):
            got = similarity.dense_topk_self(pts, 5, metric, block_rows=block)
            assert sorted(map(str, got.collect())) == want


def _sparse(spark, x):
    return spark.createDataFrame([(d, f"t{t:03d}", float(v)) for d, row in enumerate(x) for t, v in enumerate(row) if v],
                                 "doc_id long, term string, w double").repartition(5)


def test_lsi_equals_a_dense_solve(spark, tmpdir_path):
    """Several blocks and chunks, a repeated term, an empty row; the variance also in SQL from the written tables."""
    import duckdb
    import numpy as np
    from wordloom.operators import lsi as L
    from wordloom.operators import reduce as R
    rng = np.random.RandomState(2)
    x = rng.rand(90, 60) * (rng.rand(90, 60) > 0.6)
    x[:, 3] = x[:, 4]
    x[7] = 0
    w, want = _sparse(spark, x), np.linalg.svd(x)
    fit = L.fit_svd(w, 8, width=12, tol=1e-6, sizes=(32, 25, 8))
    assert len(fit.values) == 8 and fit.residual <= 1e-6 and np.allclose(fit.values, want[1][:8], rtol=1e-9)
    rows = L.fold_in(w, fit.comps, normalize=False, sizes=(40, 16, 10))
    got = {r["doc_id"]: np.array(r["vec"]) for r in rows.collect()}
    dense = x @ want[2][:8].T
    assert 7 not in got and all(np.allclose(np.abs(got[d]), np.abs(dense[d]), atol=1e-4) for d in got) and len(got) == 89
    share = dense.var(axis=0).sum() / x.var(axis=0).sum()
    assert abs(L.explained_variance(w, fit, F.lit(90)).first()["ratio"] - share) < 1e-6
    assert abs(R.explained_variance(w, rows, F.lit(90)).first()["ratio"] - share) < 1e-6
    w.write.parquet(f"{tmpdir_path}/w")
    fit.comps.write.parquet(f"{tmpdir_path}/v")
    ratio = duckdb.sql(f"""
        WITH w AS (SELECT * FROM '{tmpdir_path}/w/*.parquet'), v AS (SELECT * FROM '{tmpdir_path}/v/*.parquet'),
        y AS (SELECT doc_id, j, sum(w * comp[j]) AS y FROM w JOIN v USING (term), range(1, 9) g(j) GROUP BY ALL),
        kept AS (SELECT sum(q / 90 - (s / 90) ** 2) AS k FROM (SELECT j, sum(y) AS s, sum(y * y) AS q FROM y GROUP BY j)),
        total AS (SELECT sum(q / 90 - (s / 90) ** 2) AS t FROM (SELECT term, sum(w) AS s, sum(w * w) AS q FROM w GROUP BY term))
        SELECT k / t FROM kept, total""").fetchall()[0][0]
    assert abs(ratio - share) < 1e-9
    whole = L.fit_svd(w, 500, width=25, sizes=(32, 25, 8))  # more components than the rank: exact
    assert len(whole.values) == np.linalg.matrix_rank(x) and np.allclose(whole.values, want[1][:len(whole.values)])
    assert L.fit_svd(w.limit(0), 5).comps.count() == 0


def test_lsi_queries(spark, tmpdir_path):
    """More terms than the former cut of 2,000: a document of rare terms has a vector; nearest documents by brute force."""
    import numpy as np
    from wordloom.plans import clusterplans as P
    texts = [" ".join(f"c{j % 2000:04d}" for j in range(i * 97, i * 97 + 300)) for i in range(60)]
    texts += ["rare1 rare2 rare3"] * 2 + ["", ""]  # ids 60, 61 (rare, new and old), 62, 63 (without terms, old)
    spark.createDataFrame([(i, t, len(t), "s") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, source string") \
         .write.parquet(f"{tmpdir_path}/documents.parquet")
    got = {r["doc_id"]: np.array(r["vec"]) for r in P.lsi_doc_vectors(spark, tmpdir_path).collect()}
    assert len(got) == 64 and any(got[60]) and any(got[61]) and not any(got[62])
    top = {(r["new_id"], r["rank"]): r for r in P.topk_lsi(spark, tmpdir_path).collect()}
    assert len(top) == 3 * 13 and top[60, 1]["old_id"] == 61 and abs(top[60, 1]["dist"]) < 1e-6
    for new in (0, 25, 55):
        near = sorted((1 - got[new] @ got[o], o) for o in got if o % 5 and any(got[o]))[:3]
        assert np.allclose([top[new, r]["dist"] for r in (1, 2, 3)], [d for d, _ in near], atol=1e-5)
    assert P.lsi_explained_variance(spark, tmpdir_path).first()["percent"] >= 99


def test_document_queries_use_trained_vectors(spark, tmpdir_path):
    """Nearest documents, sequence codes and clusters are those of the 300-dimensional trained vectors, by brute force."""
    import random
    import numpy as np
    from wordloom.plans import clusterplans as P
    from wordloom.plans import embedplans as D
    rng = random.Random(8)
    texts = [". ".join(" ".join(f"{'abc'[i % 3]}word{rng.randrange(12)}" for _ in range(9)) for _ in range(4)) for i in range(45)]
    lonely = texts + ["alone"]  # id 45, a new document without a co-occurrence
    spark.createDataFrame([(i, t, len(t), "xyz"[i % 3]) for i, t in enumerate(lonely)],
                          "doc_id long, text string, n_chars long, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    for plan, vectors in ((D.topk_doc_vectors_mean, D.word2vec_doc_vectors), (D.topk_doc_vectors_tfidf, D.doc_vectors_tfidf_trained)):
        v = {r["doc_id"]: np.array(r["vec"]) for r in vectors(spark, tmpdir_path).collect()}
        assert len(v) == 45 and len(v[0]) == 300
        top = plan(spark, tmpdir_path).collect()
        assert sum(r["new_id"] == 45 for r in top) == 3
        for r in top:
            if r["new_id"] == 45:
                continue
            a, b = v[r["new_id"]], v[r["old_id"]]
            assert abs(r["dist"] - (1 - a @ b / np.sqrt((a @ a) * (b @ b)))) < 1e-5
    words = {r["term"]: np.array(r["vec"]) for r in D.trained_word_vectors(spark, tmpdir_path).collect()}
    x = np.zeros((45, D.SEQ_LEN, 300))
    for i, t in enumerate(texts):
        tokens = t.replace(".", " ").split()[-D.SEQ_LEN:]
        x[i, D.SEQ_LEN - len(tokens):] = [words.get(w, np.zeros(300)) for w in tokens]
    left, size, _ = np.linalg.svd(x.reshape(45, -1), full_matrices=False)
    want = left[:, :30] * size[:30]
    codes = np.array([r["code"] for r in D.sequence_autoencoder_codes(spark, tmpdir_path).where("doc_id < 45").orderBy("doc_id").collect()])
    assert np.allclose(codes @ codes.T, want @ want.T, atol=1e-2)
    assert P._document_points(spark, tmpdir_path, False).selectExpr("max(size(vec))").first()[0] == 300
    assert P.kmeans_documents_scores(spark, tmpdir_path).first()["n"] == 46


def test_f11_word_index_and_pad(spark):
    d = tiny_docs(spark)
    toks = S.positioned(d, S.sequence_tokens("text"))
    idx = {r["term"]: r["term_id"] for r in S.word_index(toks).collect()}
    assert idx == {"cat": 1, "dog": 2, "fish": 3, "bird": 4}
    seqs = {r["doc_id"]: r["seq"] for r in S.pad(S.id_sequences(toks, S.word_index(toks)), 5).collect()}
    assert seqs[2] == [0, 1, 4, 4, 2]


def test_single_linkage_f8(spark):
    from wordloom.operators import linkage as L
    rows = {0: [0.0, 0.926937, 0.375218, 0.0], 1: [0.0, 0.0, 0.629228, 0.777221],
            2: [0.891844, 0.351570, 0.284626, 0.0], 3: [0.0, 0.0, 0.0, 1.0]}
    pts = spark.createDataFrame([(k, v) for k, v in rows.items()], "doc_id long, vec array<double>")
    mst = {(r["a"], r["b"]): r["height"] for r in L.minimum_spanning_tree(pts).collect()}
    assert len(mst) == 3
    assert math.isclose(mst[(1, 3)], 0.667501, abs_tol=1e-5)
    assert math.isclose(mst[(0, 2)], 1.065195, abs_tol=1e-5)
    assert math.isclose(max(mst.values()), 1.236044, abs_tol=1e-5)
    two = {r["doc_id"]: r["cluster_id"] for r in L.cut(pts, L.minimum_spanning_tree(pts), 2).collect()}
    assert two[0] == two[2] and two[1] == two[3] and two[0] != two[1]


def test_mst_matches_prim(spark):
    import numpy as np
    from wordloom.operators import linkage as L
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 3))
    pts = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "doc_id long, vec array<double>")
    got = sorted(r["height"] for r in L.minimum_spanning_tree(pts).collect())
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    seen, best, total = {0}, d[0].copy(), []
    for _ in range(59):
        best[list(seen)] = np.inf
        j = int(np.argmin(best)); total.append(best[j]); seen.add(j)
        best = np.minimum(best, d[j])
    assert np.allclose(sorted(total), got)


def _ward_by_hand(x):
    """(smaller id, larger id, height, size) of every merge, the least pair first."""
    import numpy as np
    clusters, out = {i: (1, v) for i, v in enumerate(x)}, []
    while len(clusters) > 1:
        ids = sorted(clusters)
        n = np.array([clusters[i][0] for i in ids], float)
        c = np.array([clusters[i][1] for i in ids])
        h = np.sqrt(2 * n[:, None] * n / (n[:, None] + n)) * np.linalg.norm(c[:, None] - c, axis=2)
        h[np.tril_indices(len(ids))] = np.inf
        i, j = np.unravel_index(np.argmin(np.round(h, 12)), h.shape)
        size = n[i] + n[j]
        out.append((ids[i], ids[j], h[i, j], int(size)))
        clusters[ids[i]] = (size, (n[i] * c[i] + n[j] * c[j]) / size)
        del clusters[ids[j]]
    return out


def test_ward_linkage(spark):
    """Every merge equals the brute force; copies merge first; cut into groups."""
    import numpy as np
    from wordloom.operators import linkage
    from wordloom.operators.ward import ward_linkage
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) + 9 * rng.integers(0, 3, size=(200, 1))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>").repartition(3)
    want = sorted(_ward_by_hand(x))
    merges = ward_linkage(pts)
    got = sorted(map(tuple, merges.collect()))
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([h for *_, h, _ in got], [h for *_, h, _ in want], rtol=1e-9)
    group = {r["doc_id"]: r["cluster_id"] for r in linkage.cut(pts, merges, 3).collect()}
    assert len({(group[i], round(x[i].mean() / 9)) for i in range(200)}) == 3
    assert ward_linkage(pts.limit(0)).count() == ward_linkage(pts.limit(1)).count() == 0
    # a line of equal steps and copies: ties everywhere; the heights add up to the same total sum of squares
    line = np.array([[float(i // 2)] for i in range(16)])
    got = ward_linkage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(line)], "doc_id long, vec array<double>")).collect()
    assert len(got) == 15 and sum(r["height"] == 0 for r in got) == 8 and max(r["size"] for r in got) == 16
    assert np.isclose(sum(r["height"] ** 2 / 2 for r in got), ((line - line.mean()) ** 2).sum())


def test_paragraph_vectors(spark):
    """At the defaults: equal texts have equal vectors whatever the id, and topics lie apart."""
    import numpy as np
    from wordloom.operators.doc2vec import paragraph_vectors
    rows = []
    for d in range(20):
        words = ["a1", "a2", "a3"] if d < 10 else ["b1", "b2", "b3"]
        rows += [(d * 7919, w, 3) for w in words]
    counts = spark.createDataFrame(rows, "doc_id long, term string, n long").repartition(5)
    wv = spark.createDataFrame([("a1", [1.0, 0.0]), ("a2", [0.9, 0.1]), ("a3", [1.0, 0.2]),
                                ("b1", [0.0, 1.0]), ("b2", [0.1, 0.9]), ("b3", [-0.1, 1.0])],
                               "term string, vec array<double>")
    pv = {r["doc_id"] // 7919: np.array(r["vec"]) for r in paragraph_vectors(counts, wv).collect()}
    assert len(pv) == 20
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert all((pv[i] == pv[0]).all() for i in range(10)) and all((pv[i] == pv[10]).all() for i in range(10, 20))
    assert cos(pv[0], pv[1]) > 0.999 and cos(pv[0], pv[15]) < 0.5



def test_components_of_a_long_chain(spark):
    """A path of 3,000 nodes in shuffled order, with the ids that label propagation needs many rounds for."""
    from wordloom.operators import linkage
    order = np.random.default_rng(2).permutation(3000)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:]) if a != 17 and b != 17],
                                  "a long, b long").repartition(8)
    got = {r["doc_id"]: r["component"] for r in
           linkage.connected_components(spark.range(3000).withColumnRenamed("id", "doc_id"), edges).collect()}
    at = int(np.flatnonzero(order == 17)[0])
    want = {17: 17} | {int(x): int(part.min()) for part in (order[:at], order[at + 1:]) for x in part}
    assert got == want


def test_blocked_means_equal_plain_ones(spark):
    """A word's vector is sent once a block; the means are those of one row per document and word."""
    rng = np.random.default_rng(4)
    cells = [(d, f"w{t}", int(rng.integers(1, 5))) for d in [None, *range(40)] for t in rng.choice(30, 6, replace=False)]
    counts = spark.createDataFrame(cells, "doc_id long, term string, n long")
    wv = spark.createDataFrame([(f"w{t}", [float(x) for x in rng.normal(size=12)]) for t in range(25)], "term string, vec array<double>")
    rows = counts.select("doc_id", "term", F.col("n").alias("x"), "n")
    want = vecs(E.mean_vectors(counts, wv))
    for size in (1000, 7):
        got = vecs(E.blocked_mean_vectors(rows, wv, size))
        assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], atol=1e-12) for d in want)
    blocks = E.word_blocks(rows, wv, 1000)
    assert blocks.count() == counts.join(wv, "term").select("term").distinct().count()


def test_pairs_travel_once(spark):
    """Unordered pairs are counted once, also over several batches; mirrored they are all ordered pairs."""
    from collections import Counter
    sents = [["a", "b", "a", "c"], ["c", "b"], ["d"], ["b", "b", "a"]]
    tokens = spark.createDataFrame([(i, 0, j, w) for i, s in enumerate(sents) for j, w in enumerate(s)],
                                   "doc_id long, sid int, wid int, term string")
    want = Counter((x, y) for s in sents for i, x in enumerate(s) for j, y in enumerate(s) if i != j and abs(i - j) <= 2)
    pairs = E.pair_counts(tokens, 2)
    assert pairs.where("term > ctx").isEmpty()
    assert {(r["term"], r["ctx"]): r["n"] for r in E.mirrored(pairs).collect()} == want


def test_short_vectors_are_summed_as_numbers(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 3), (3, "z", 1)], "doc_id long, term string, n long")
    wv = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, -1.0])], "term string, vec array<double>")
    got = E.mean_vectors(counts, wv, dim=2)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().toString()
    assert vecs(got) == vecs(E.mean_vectors(counts, wv)) == {1: [2.0, 1.0], 2: [1.0, 2.0]}


def test_a_norm_is_summed_once_a_vector(spark):
    """Not once an element, which makes the square of the length of it."""
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, None]), (5, [])], "doc_id long, vec array<double>")
    out = df.select("doc_id", V.l2_normalize("vec").alias("vec"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert vecs(out) == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [0.0, None], 5: []}


def test_subsampling_sends_no_token(spark):
    """Only words above some 2.6 thresholds can lose tokens; the draws are those of a join with every word's count."""
    rows = [(d, p, w) for d in range(40) for p, w in enumerate(["the"] * 12 + ["of"] * 3 + [f"w{d}", f"x{d % 7}", None])]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, term string")
    got = S.subsample(tokens, 0.05, 3)
    n, f = tokens.count(), F.col("cf") / tokens.count()
    want = tokens.join(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "term").withColumn(
        "keep", S.uniform_from_md5(F.col("doc_id"), F.col("pos"), F.lit(3)) < (F.sqrt(f / 0.05) + 1) * 0.05 / f)
    as_set = lambda df: sorted(tuple(r) for r in df.select("doc_id", "pos", "term", "keep").collect())
    assert as_set(got) == as_set(want) and n == len(rows)
    assert 0 < got.where("not keep").count() < got.where("keep").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every word's count were a large table
    try:
        plan = S.subsample(tokens, 0.05, 3).where("keep")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_large_group_is_searched_in_tiles():
    """Groups of the spanning tree and of Ward's linkage hold more rows than a tile; the tree is the one of a single tile."""
    import pandas as pd
    from wordloom.operators import linkage, ward
    from wordloom.operators.similarity import DENSE_BLOCK, QUERY_ROWS, plan_blocks
    rng = np.random.default_rng(8)
    n = 2 * QUERY_ROWS + 7
    x = np.round(rng.normal(size=(n, 3)), 1)
    one = pd.DataFrame({"doc_id": np.arange(n), "n": 1 + np.arange(n) % 3, "comp": np.arange(n) // 2, "vec": list(x)})
    both = pd.concat([one.assign(is_query=True), one.assign(is_query=False)])
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    m = one["n"].to_numpy(float)
    height = np.round(np.sqrt(2 * m[:, None] * m[None] / (m[:, None] + m[None]) * d2), 12)
    got = ward._nearest(both)
    assert got["a"].tolist() == list(range(n)) and got["b"].tolist() == height.argmin(axis=1).tolist()
    away = np.where(one["comp"].to_numpy()[:, None] == one["comp"].to_numpy()[None], np.inf, np.round(np.sqrt(d2), 12))
    got = linkage._nearest_other(both)
    assert got["a"].tolist() == list(range(n)) and got["b"].tolist() == away.argmin(axis=1).tolist()
    assert plan_blocks(60_000, 60_000, 8, max_block_rows=DENSE_BLOCK) == (4, 4)  # not 59 x 59


def test_trees_plan_large_groups(spark, monkeypatch):
    from wordloom.operators import linkage, ward
    from wordloom.operators.similarity import DENSE_BLOCK
    points = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "doc_id long, vec array<double>")

    class Planned(Exception):
        pass

    def planned(*args, max_block_rows=1024):
        raise Planned(max_block_rows)

    for module, tree in ((linkage, linkage.minimum_spanning_tree), (ward, ward.ward_linkage)):
        monkeypatch.setattr(module, "plan_blocks", planned)
        try:
            tree(points)
        except Planned as seen:
            assert seen.args == (DENSE_BLOCK,)
        else:
            raise AssertionError("no plan")


def test_kmeans_step_sends_no_shuffle(spark):
    """A step's sums come from packed points, several rows a block; centres are the plain means."""
    import numpy as np
    rng = np.random.RandomState(4)
    x = np.vstack([rng.rand(300, 3), rng.rand(200, 3) + 9])
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>").repartition(5)
    packed = C._packed(pts)
    assert packed.count() < 500
    got = C._centre_means(packed, [(0, [0.0] * 3), (1, [9.0] * 3)], "euclidean")
    assert np.allclose(got[0], x[:300].mean(0)) and np.allclose(got[1], x[300:].mean(0))
    assign, _ = C.kmeans(pts, 2)
    groups = {frozenset(r["ids"]) for r in assign.groupBy("cluster_id").agg(F.collect_list("doc_id").alias("ids")).collect()}
    assert groups == {frozenset(range(300)), frozenset(range(300, 500))}


def test_lsi_blocks_grow_with_the_matrix(spark, monkeypatch):
    """Fewer copies of the columns on a large matrix, bounded blocks; parts that leave in pieces give the same vectors."""
    from wordloom.operators import lsi as L
    assert L.block_sizes(8000, 204830) == (8192, 32768, 1024)
    db, tb, chunk = L.block_sizes(410_000, 2_500_000)
    assert 8192 < db <= L.MOST_DOCS and 32768 < tb <= L.MOST_TERMS and db % chunk == 0 and -(-2_500_000 // tb) < 77 // 3
    assert L.block_sizes(10 ** 9, 10 ** 9) == (L.MOST_DOCS, L.MOST_TERMS, 1024)
    rng = np.random.RandomState(6)
    x = rng.rand(40, 30) * (rng.rand(40, 30) > 0.5)
    w = _sparse(spark, x)
    monkeypatch.setattr(L, "PIECE", 7)
    fit = L.fit_svd(w, 4, width=6, tol=1e-6)
    assert np.allclose(fit.values, np.linalg.svd(x)[1][:4], rtol=1e-9)
    got = {r["doc_id"]: np.array(r["vec"]) for r in L.fold_in(w, fit.comps, normalize=False).collect()}
    want = x @ np.linalg.svd(x)[2][:4].T
    assert all(np.allclose(np.abs(got[d]), np.abs(want[d]), atol=1e-4) for d in got) and len(got) == 40


def test_word_vectors_from_marks(spark):
    """A context's steps are made once a word and travel as one number; the vectors are those of a plain loop."""
    import hashlib
    rows = [(f"w{i % 17}", f"w{(i * 7) % 23}") for i in range(150)]
    counts = {}
    for a, b in rows:
        k = (min(a, b), max(a, b))
        counts[k] = counts.get(k, 0) + 1
    pairs = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "term string, ctx string, n long").repartition(3)
    info = E.ppmi(pairs, E.step_mark(20, 3))
    plain = {(r["term"], r["ctx"]): r["ppmi"] for r in E.ppmi(pairs).collect()}
    assert {(r["term"], r["ctx"]): r["ppmi"] for r in info.collect()} == plain
    want = {}
    for (a, b), x in plain.items():
        v = want.setdefault(a, np.zeros(20))
        for j in range(3):
            h = hashlib.md5(f"{b}#{j}".encode()).hexdigest()
            v[int(h[:8], 16) % 20] += x if h[8] < "8" else -x
    for words in (None, 1, 20_000):
        got = {r["term"]: np.array(r["vec"]) for r in E.indexed_word_vectors(info, 20, 3, words).collect()}
        assert got.keys() == want.keys()
        for t, v in want.items():
            assert np.allclose(got[t], v / max(np.sqrt(v @ v), 1e-300), atol=1e-12)


def test_spanning_tree_searches_all_pairs_once(spark, monkeypatch):
    """Lists of nearest points make the tree of a plain Kruskal, ties and copies included; all pairs are searched once,
    then only points whose list has run out."""
    from wordloom.operators import linkage
    rng = np.random.default_rng(4)
    x = np.vstack([np.round(rng.normal(size=(60, 2)), 1), np.round(rng.normal(size=(40, 2)), 1) + 50, [[9.0, 9.0]] * 12])
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), [float(v) for v in p]) for i, p in zip(ids, x)]
    pts = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(4)
    at = {i: np.array(v) for i, v in rows}
    edges = sorted((round(float(np.sqrt(((at[a] - at[b]) ** 2).sum())), 12), a, b) for a in at for b in at if a < b)
    root = {i: i for i in at}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    want = set()
    for d, a, b in edges:
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.add((a, b, d))
    asked = []
    for name in ("dense_topk_self", "dense_topk_sided"):
        plain = getattr(linkage, name)
        monkeypatch.setattr(linkage, name, lambda df, *a, _f=plain, _n=name: asked.append(
            (_n, df.where("is_query").count() if "is_query" in df.columns else df.count())) or _f(df, *a))
    for k in (3, 16):
        asked.clear()
        got = {(r["a"], r["b"], round(r["height"], 12)) for r in linkage.minimum_spanning_tree(pts, neighbours=k).collect()}
        assert got == want
        assert [n for n, _ in asked].count("dense_topk_self") == 1 and all(n < len(x) for f, n in asked if f == "dense_topk_sided")


def test_first_columns_are_few(monkeypatch):
    """Only a tile's first columns are ranked whole; the nearest are those of one sort, at any tile size."""
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=(40, 4)), 1), np.round(rng.normal(size=(900, 4)), 1)
    whole = []
    plain = similarity._dense_distances
    monkeypatch.setattr(similarity, "_dense_distances", lambda x, y, *m: whole.append(len(y)) or plain(x, y, *m))
    for metric in ("euclidean", "cosine"):
        got = similarity._dense_tiles(np.arange(40), np.arange(900), a, b, metric, 5)
        key = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), 12) if metric == "euclidean" else np.round(
            1 - (a[:, None] * b[None]).sum(2) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None]), 12)
        assert got["ref_id"].tolist() == np.argsort(key, axis=1, kind="stable")[:, :5].ravel().tolist()
    assert whole == [similarity.FIRST_COLUMNS] * 2
