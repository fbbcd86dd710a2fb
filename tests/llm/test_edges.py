"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator."""

from collections import Counter

import pytest

from wordloom.llm import ann_forest, embed_dedup, line_dedup, mixing, ngram_join, packing, quality, sharding, url_filter
from wordloom.llm import warc

TEXT = "one two three four five six seven eight nine ten"


def docs(spark, rows=None):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = rows if rows is not None else [
        (1, TEXT, "a", "en"), (1, TEXT, "a", "en"), (2, None, "a", None), (3, "", None, "en"), (None, TEXT, "b", "fr"),
        (4, " \t\n ", "b", "en"), (5, TEXT.upper(), None, None), (6, "x", "a", "en"), (7, long, "c", "en"),
        (8, "y" * 100000, "c", "de"), (9, long + " end", "c", "en")]
    # names that the operators use inside
    return spark.createDataFrame(
        [(*r, 5, "n", 1.5, "s", 2, "q") for r in rows],
        "doc_id long, text string, source string, lang string, node int, token string, size double, shard string, "
        "_h int, quality string")


def empty(spark):
    return docs(spark, []).limit(0)


def labels(spark, rows=((1, 1, 0), (6, 0, None), (None, 1, 0), (7, None, 0), (5, 1, 0), (5, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality(spark):
    rows = quality.quality_scores(docs(spark), labels(spark)).collect()
    assert len(rows) == 11 and all(r["quality"] is not None and r["kept"] is not None for r in rows)
    same = quality.quality_scores(docs(spark), labels(spark).limit(0)).collect()
    assert len(same) == 11 and len({r["evidence"] for r in same}) == 1 and all(r["kept"] for r in same)
    assert quality.quality_scores(empty(spark), labels(spark)).count() == 0


def test_ngram_join(spark):
    rows = sorted((tuple(r) for r in ngram_join.ngram_jaccard_components(docs(spark), 3, 90, 100).collect()),
                  key=lambda r: (r[0] is None, r))
    assert rows == [(1, 8, 1), (1, 8, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 8, 1), (6, 1, 6), (7, 59998, 7), (8, 1, 8),
                    (9, 59999, 7), (None, 8, None)]
    assert ngram_join.ngram_jaccard_components(empty(spark)).count() == 0


def test_ngram_join_salted(spark, monkeypatch):
    """Groups beyond the salting and block bounds give the same components."""
    from wordloom.llm import linkjoin
    monkeypatch.setattr(linkjoin, "SALTED", 3)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = list(base)
        words[i % 40] = f"x{i}"
        if i >= 40:
            words[(i * 7) % 40] = f"z{i}"
        rows.append((i, " ".join(words), "a", "en"))
    sets = [{tuple(t.split()[j:j + 2]) for j in range(39)} for _, t, _, _ in rows]
    group = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i] | sets[j])):
                    group[i] = group[j] = min(group[i], group[j])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(docs(spark, rows), 2, 85, 100).collect()}
    assert got == dict(enumerate(group))


def test_sharding(spark):
    rows = sharding.assign_shards(docs(spark), 5).collect()
    assert len(rows) == 11
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {8}
    assert len({(r["shard"], r["slot"]) for r in rows}) == 11
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_sharding_weights(spark):
    many = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    weights = [4.0, 1.0, 0.0, 1.0, 2.0]
    count = {r["shard"]: r["count"] for r in sharding.assign_shards(many, 5, weights).groupBy("shard").count().collect()}
    assert 2 not in count and all(abs(count[s] - 20000 * weights[s] / 8) < 400 for s in count)
    after = sharding.assign_shards(many, 5, [4.0, 1.0, 0.0, 3.0, 2.0]).select("doc_id", "shard")
    before = sharding.assign_shards(many, 5, weights).select("doc_id", "shard")
    moved = before.withColumnRenamed("shard", "old").join(after, "doc_id").where("old <> shard")
    assert {r["shard"] for r in moved.collect()} == {3}  # only into the subtree whose weight grew
    with pytest.raises(ValueError):
        sharding.assign_shards(many, 2, [0.0, 0.0])


def test_mixing(spark):
    mixed = mixing.mix_sources(docs(spark), block=4)
    rows = mixed.collect()
    assert len(rows) == 11 and {"node", "token", "shard", "_h", "quality"} <= set(mixed.columns)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_sources(empty(spark)).count() == 0
    only = docs(spark, [(1, None, None, None), (2, "", "a", None)])
    assert [r["taken"] for r in mixing.mix_sources(only).collect()] == [0, 0]
    out = mixing.mixed_rows(docs(spark), block=4)
    assert out.columns == docs(spark).columns and out.count() > 0


def test_sainte_lague():
    assert mixing.sainte_lague([53.0, 24.0, 23.0], 7, [99] * 3) == [3, 2, 2]
    for weights, seats in (([5.0, 3.0, 1.0, 0.0], 11), ([1.0] * 4, 6), ([7.5, 0.1], 3)):
        got, one = mixing.sainte_lague(weights, seats, [99] * len(weights)), [0] * len(weights)
        for _ in range(seats):
            best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * one[i] + 1), -i))
            one[best] += 1
        assert got == one
    assert mixing.sainte_lague([5.0, 1.0], 10, [3, 4]) == [3, 4]


def test_fuzzy_lines(spark):
    rows = [(1, "same line here\nother line of text\n\nsame line here ", "a", "en"), (2, "Same Line Here", "a", "en"),
            (2, "Same Line Here", "a", "en"), (None, "same line here", "a", "en"), (3, None, "a", "en"), (4, "", "a", "en"),
            (5, "x" * 50000 + "\n" + "ab", "a", "en")]
    got = {(r["doc_id"], r["line_no"]): r["kept"] for r in line_dedup.fuzzy_lines(docs(spark, rows)).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 3): False, (2, 0): False, (5, 0): True, (5, 1): True}
    kept = line_dedup.without_repeated_lines(docs(spark, rows))
    texts = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert kept.columns == docs(spark).columns
    assert texts == sorted([(1, "same line here\nother line of text\n"), (2, ""), (2, ""), (None, "same line here"), (3, None),
                            (4, ""), (5, rows[-1][1])], key=str)
    assert line_dedup.fuzzy_lines(empty(spark)).count() == 0


def test_packing(spark):
    rows = packing.pack(docs(spark)).collect()
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r["length"])
    assert sum(per[2]) == sum(per[3]) == sum(per[4]) == 1 and None in per
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(empty(spark)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, key string, cid int")


def test_embedding_dedup(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [1.0, None]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [1.0]), (11, []), (12, [-0.0, 1.0])]
    rows = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in
                   embed_dedup.embedding_components(vectors(spark, data)).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True),
            (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (None, 0, None, True), (10, 0, 10, True),
            (11, 0, 11, True), (12, 1, 9, False)]
    assert rows == sorted(want, key=str)
    assert embed_dedup.embedding_components(vectors(spark, data).limit(0)).count() == 0


def test_embedding_blocks(spark):
    """A bucket far beyond the block size, with copies."""
    import numpy as np
    r = np.random.RandomState(3)
    base = r.standard_normal(8)
    x = np.vstack([base + 0.25 * r.standard_normal((150, 8)), r.standard_normal((50, 8))]).astype(np.float32)
    x[20:40] = x[0]
    rows = {q["vec_id"]: q for q in embed_dedup.embedding_components(
        vectors(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)]), block=7, miss=1e-9).collect()}
    y = x.astype(np.float64)
    n = np.linalg.norm(y, axis=1)
    near = y @ y.T / np.outer(n, n) >= 0.9
    assert [rows[i]["n_links"] for i in range(200)] == (near.sum(axis=1) - 1).tolist()


def test_neighbours(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [nan, 1.0]),
            (7, [0.0, 0.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0]), (None, [9.0, 9.0]), (40, None), (60, [1.0])]
    table = vectors(spark, data)
    rows = ann_forest.nearest_neighbours(table, table.where("vec_id % 20 = 0"), k=3, effort=1.0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 2.0), (2, 2.0), (3, 2.0)], 20: [(1, 4.0), (2, 4.0), (3, 4.0)]}
    assert ann_forest.nearest_neighbours(table.limit(0), table.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "page_id long, url string, html string, host string, n int")


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/x?y", None), (2, "http://WWW.example.com/en/", None), (3, "http://example.com", None),
            (4, None, None), (5, "no scheme", None), (6, "http://b.net/fr/1#z", None), (6, "http://b.net/fr/1#z", None),
            (None, "ftp://net/es/", None), (8, "http://notexample.com/en/", None), (9, "http:///en/", None)]
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages(spark, rows), url_filter.rule_table(
        spark, url_filter.RULES)).collect()), key=str)
    want = [(1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"),
            (3, "example.com", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
            (6, "b.net", "/fr/1", "net/fr/", "block"), (6, "b.net", "/fr/1", "net/fr/", "block"),
            (None, "net", "/es/", "net/es/", "block"), (8, "notexample.com", "/en/", "com/", "allow"), (9, "", "/en/", None, "allow")]
    assert got == sorted(want, key=str)
    no_rules = url_filter.judge_urls(pages(spark, rows), url_filter.rule_table(spark, []))
    assert {r["verdict"] for r in no_rules.collect()} == {"allow"}
    assert url_filter.judge_urls(pages(spark, rows).limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/\r\nx: y", big), (2, None, big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None),
            (None, "u", big), (6, "u", ""), (7, "u", "z" * 300000)]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in
                  warc.warc_round_trip(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None),
                          (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None),
                          (None, 1200, "revisit", 2), (6, 0, "response", None), (7, 300000, "response", None)], key=str)
    pages(spark, rows).limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.warc_round_trip(spark, f"{tmp_path}/none").count() == 0


def test_warc_broken():
    import struct

    import zstandard
    lead = struct.pack("<II", warc.DICTIONARY_MAGIC, 0)
    good = warc.record(1, "http://a/", b"payload")
    frame = zstandard.ZstdCompressor().compress(good)
    assert [warc.parse(raw)["payload"] for _, raw in warc.frames(memoryview(lead + frame + frame))] == [b"payload"] * 2
    packed = zstandard.ZstdCompressor().compress(b"some dictionary content, itself compressed " * 9)
    lead2 = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
    framed = zstandard.ZstdCompressor(dict_data=words).compress(good)
    assert [raw for _, raw in warc.frames(memoryview(lead2 + framed))] == [good]
    for data in (b"", frame, lead + frame[:-3], lead[:-1]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(memoryview(data)))
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload\r\n", b"paYload\r\n"),
                good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_packing_tells_added_tokens_by_case():
    """'<|EndOfText|>' is text, '<|endoftext|>' one token; whichever a worker meets first."""
    import public_tokenizers
    from tokenizers import Tokenizer
    from wordloom.llm.common import utf8
    from wordloom.llm.packing import WordIds
    import pyarrow as pa
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some <|EndOfText|> here, the x<|STARTOFTEXT|>y", "some <|endoftext|> here, the x<|startoftext|>y", "<|EndOfText|>"]
    plain = Tokenizer.from_file(path)
    for order in (texts, texts[::-1]):
        ids, at = WordIds(path).encode(*utf8(pa.array(order)))
        for i, t in enumerate(order):
            assert ids[at[i]:at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def labelled_vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2.0) for r in rows],
                                 "vec_id long, embedding array<double>, label int, codes string, dim int, rb double")


def test_hard_negatives(spark):
    from wordloom.llm.hard_negatives import hard_negatives
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 2), (0, [1.0, 0.0], 2), (1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (2, [0.9, 5.0], 3), (3, [0.9, 0.0], 4),
            (4, [0.8, 1.0], 4), (5, None, 3), (6, [1.0, 0.0], None), (8, [nan, 1.0], 3), (9, [1.0, inf], 3), (10, [None, 1.0], 3),
            (11, [], 3), (None, [1.0, 0.0], 3), (12, [1.0, 0.0, 0.0], 3), (13, [0.0, 0.0], 3), (14, [1e300, -1e300], 9)]
    # anchor 0 has label 3 (0 is divisible by 7); 14 has label 0 and components held at 2**30 and below
    got = sorted(map(tuple, hard_negatives(labelled_vectors(spark, rows)).collect()))
    one, near, far = 256 * 256, 256 * 230, 256 * 204
    assert got == [(0, 1, 1, 3, one, near), (0, 2, 1, 3, near, near), (0, 2, 2, 4, near, far)]
    assert hard_negatives(labelled_vectors(spark, rows).limit(0)).count() == 0
    ties = [(0, [1.0, 1.0], 2)] + [(i, [1.0, 1.0], 3 if i % 2 else 5) for i in range(1, 60) if i % 7]
    got = hard_negatives(labelled_vectors(spark, ties)).collect()
    assert {r["positive_id"] for r in got} == {1, 3, 5, 9, 11} and len(got) == 25
    assert {r["negative_id"] for r in got} == {2, 4, 6, 8, 10}


def test_hard_negatives_cells(spark, monkeypatch):
    """Many cells, other lengths than a word's, and intervals that hold the integer scores."""
    import numpy as np

    from wordloom.llm import hard_negatives as H
    random = np.random.RandomState(3)
    x = random.standard_normal((300, 70)) + 2 * random.standard_normal((10, 70))[np.arange(300) % 10]
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(x)]
    whole = Counter(map(tuple, H.hard_negatives(labelled_vectors(spark, rows), every=20).collect()))
    for name, size in (("BLOCK", 32), ("ANCHORS", 4)):
        monkeypatch.setattr(H, name, size)
    assert Counter(map(tuple, H.hard_negatives(labelled_vectors(spark, rows).repartition(5), every=20).collect())) == whole
    v = np.floor(256 * x).astype(np.int64)
    label = np.array([(i % 10 + 1) % 10 if i % 7 == 0 else i % 10 for i in range(300)])
    want = Counter()
    for a in range(0, 300, 20):
        score = v @ v[a]
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != a]
        for p in [i for i in order if label[i] == label[a]][:5]:
            fits = [i for i in order if label[i] != label[a] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            want.update((a, p, r, n, score[p], score[n]) for r, n in enumerate(fits, 1))
    assert whole == want and want
    codes, sizes = H.encode(v)
    for a in (0, 17):
        bounds, keep = H.Anchor(v[a]).intervals(codes, sizes), None
        for _ in range(H.LEVELS):
            low, high = bounds.send(keep)
            keep = np.ones(300, bool)
            assert (low <= v @ v[a]).all() and (v @ v[a] <= high).all()
    assert (high - low).mean() < np.linalg.norm(v, axis=1).mean() * np.linalg.norm(v[17])  # the last level is narrow


def test_filter_audit(spark):
    from wordloom.llm.filter_audit import filter_audit, positional_popcount
    import numpy as np
    words = np.random.RandomState(1).randint(0, 2**32, 1000, dtype=np.uint64).astype(np.uint32)
    for n in (0, 1, 2, 3, 4, 1000):
        assert positional_popcount(words[:n]).tolist() == [int((words[:n] >> np.uint32(b) & 1).sum()) for b in range(32)]
    rows = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit(docs(spark), labels(spark)).collect()}
    assert len(rows) == 4 * 600 and {p for p, *_ in rows} == {"", "en", "fr", "de"}
    # part '': 2 (null text: A), 5 (upper case: A, C); 'en': 1, 1, 3 (empty as 2: E), 4, 6 (A), 7, 9 (kept)
    r = rows["", "ABCDE", 1]
    assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) == (0, 2, 0, 1, 1, 180)
    r = rows["", "CABDE", 1]
    assert (r["kept"], r["removed"], r["unique_fails"], r["good_lost"], r["shapley"]) == (1, 1, 0, 1, 60)
    r = rows["en", "AEBCD", 2]
    assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"]) == (2, 0, 1, 0)
    assert rows["en", "AEBCD", 1]["good_lost"] == 2 and rows["en", "EABCD", 1]["removed"] == 1
    assert rows["de", "ABCDE", 1]["removed"] == 1 and rows["fr", "ABCDE", 5]["kept"] == 0
    assert filter_audit(empty(spark), labels(spark)).count() == 0
    assert {r["good_lost"] for r in filter_audit(docs(spark), labels(spark).limit(0)).collect()} == {0}


def test_filter_audit_pieces():
    from wordloom.llm import filter_audit as A
    words = [f"w{i % 900}" for i in range(2000)]
    raw = "\t".join(words).encode()
    assert b"".join(A._pieces(raw)) == raw
    before = A.text_failures(raw, len(raw))
    old, A._PIECE = A._PIECE, 7
    try:
        assert [w for p in A._pieces(raw) for w in p.split()] == [w.encode() for w in words]
        assert A.text_failures(raw, len(raw)) == before == 2
    finally:
        A._PIECE = old


def test_decontamination(spark):
    from wordloom.llm.decontam import contaminated_spans, decontamination
    w = [f"q{i}" for i in range(30)]
    items = [(7, "Q: " + " ".join(w[:14]), 1), (7, "Q: " + " ".join(w[:14]), 1), (12, "ünï-code 5", 2), (3, " ".join(w[4:20]).upper(), 1),
             (None, "nothing here", 1), (20, None, 1), (21, " .,; ", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string, items int")
    texts = [(1, "x " + ", ".join(w[:25]) + " y"), (2, "ünï--CODE\n5 ünï code 55"), (2, "ünï--CODE\n5 ünï code 55"), (3, None), (4, ""),
             (None, "ünï code 5"), (11, "Ünï code 5"), (5, " ".join(w[5:14])), (6, "é" * 50 + " \u0085 " + "-".join(w[4:14]) + "\u00a0"), (8, "ünï code"), (9, "5"),
             (10, "w " * 100000 + " ".join(w[:10]))]
    docs_ = spark.createDataFrame([(*t, "s", 1) for t in texts], "doc_id long, text string, digest string, spans int")

    def seen(part):
        rows = contaminated_spans(docs_, bench, part).collect()
        return sorted(((r["doc_id"], r["n_words"], [(s["word"], s["words"], s["start"], s["end"]) for s in r["spans"]], r["items"])
                       for r in rows), key=str)

    whole = seen(50_000)
    by = {r[0]: r for r in whole}
    assert by[1][1:] == (27, [(1, 20, 2, 2 + len(", ".join(w[:20])))], ["3", "7"])
    assert by[2][1:] == (6, [(0, 3, 0, 11)], ["12"]) and len(whole) == len(texts)
    assert by[3][1:] == by[4][1:] == (0, [], []) and by[None][2] == [(0, 3, 0, 10)]
    assert by[5][2] == by[8][2] == by[9][2] == by[11][2] == []
    # \u0085 and \u00a0 are beyond ASCII, so word characters: the last word is another one
    assert by[6][1:] == (12, [], [])
    assert by[10][2] == [(100000, 10, 200000, 200000 + len(" ".join(w[:10])))]
    for part in (4, 9):  # several automata, merged
        assert seen(part) == whole
    rows = decontamination(docs_, bench).collect()
    assert {r["doc_id"]: r["n_hit"] for r in rows}[1] == 20 and sum(r["contaminated"] for r in rows) == 5
    assert decontamination(docs_.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination(docs_, bench.limit(0)).collect())


def test_lines_and_sieves_beside_any_column(spark):
    """Columns named like those that the stages add for a while."""
    from wordloom.llm.common import maybe_in, without
    rows = [(1, "a line of words\nown line here", 1, "x", 5), (2, "a line of words", 2, "y", 6), (None, "a line of words", 3, "z", 7)]
    named = spark.createDataFrame(rows, "doc_id long, text string, _gone int, gone string, place int")
    got = sorted(map(tuple, line_dedup.without_repeated_lines(named).collect()), key=str)
    assert got == sorted([rows[0], (2, "", 2, "y", 6), rows[2]], key=str)
    keys = spark.createDataFrame([(1,)], "k long")
    assert [r["place"] for r in maybe_in(named, "doc_id", keys).collect()] == [5]
    assert sorted(r["place"] for r in without(named, "doc_id", keys).collect()) == [6, 7]
