import os

from wordloom.functions.stem import porter_stem
from wordloom.sources import corpus as SC
from wordloom.sources import sinks as SK


def write(path, name, data, mode="w"):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), mode) as f:
        f.write(data)


def test_read_corpus_skips_pdf_and_subdirs(spark, tmpdir_path):
    old, new = f"{tmpdir_path}/old", f"{tmpdir_path}/new"
    write(old, "a.txt", "hello world\nsecond line")
    write(old, "b.pdf", "%PDF-1.4 binary")
    write(f"{old}/sub", "c.txt", "nested")
    write(new, "d.txt", "new doc")
    df = SC.read_corpus(spark, {"old": [old], "new": [new]})
    got = sorted((r["side"], r["name"], r["text"]) for r in df.collect())
    assert got == [("new", "d.txt", "new doc"), ("old", "a.txt", "hello world\nsecond line")]


def test_read_labelled_and_newsgroups(spark, tmpdir_path):
    write(f"{tmpdir_path}/lab/cameras", "1.txt", "Nice CAMERA")
    write(f"{tmpdir_path}/lab/tablets", "2.txt", "Good tablet")
    lab = {r["label"]: r["text"] for r in SC.read_labelled(spark, f"{tmpdir_path}/lab").collect()}
    assert lab == {"cameras": "nice camera", "tablets": "good tablet"}
    write(f"{tmpdir_path}/ng/train/sci.space", "1", "From: x\n\nOrbit text\n> quoted\n--\nsig")
    write(f"{tmpdir_path}/ng/train/rec.autos", "2", "From: y\n\nCar text")
    ng = SC.read_newsgroups(spark, f"{tmpdir_path}/ng", "train", ["sci.space"]).collect()
    assert [(r["label"], r["text"]) for r in ng] == [("sci.space", "Orbit text")]


def test_sniff_and_extract(spark, tmpdir_path):
    write(tmpdir_path, "a.pdf", b"%PDF-1.4\x00\x01", "wb")
    write(tmpdir_path, "b.html", "<html><body><p>Hi &amp; bye</p><script>x=1</script></body></html>")
    write(tmpdir_path, "c.txt", "plain words")
    write(tmpdir_path, "d.bin", b"\x01\x02\x00\x03", "wb")
    m = {r["name"]: r["mime"] for r in SC.sniff_mime(spark, [tmpdir_path]).collect()}
    assert m == {"a.pdf": "application/pdf", "b.html": "text/html", "c.txt": "text/plain",
                 "d.bin": "application/octet-stream"}
    ex = {r["name"]: r["text"] for r in SC.extract_text(spark, [tmpdir_path],
                                                        {"application/pdf": lambda b: "pdf!"}).collect()}
    assert ex["a.pdf"] == "pdf!" and ex["c.txt"] == "plain words" and ex["d.bin"] is None
    assert ex["b.html"].strip() == "Hi & bye"


def test_word_vectors_and_vector_csv_roundtrip(spark, tmpdir_path):
    write(tmpdir_path, "wv.txt", "2 3\ncat 1 0 0.5\ndog 0 1 -0.5\n")
    wv = {r["term"]: r["vec"] for r in SC.read_word_vectors(spark, f"{tmpdir_path}/wv.txt").collect()}
    assert wv == {"cat": [1.0, 0.0, 0.5], "dog": [0.0, 1.0, -0.5]}
    df = spark.createDataFrame([("a", "f1", [1.0, 2.0]), ("b", "f2", [3.0, 4.0])],
                               "label string, name string, vec array<double>")
    SK.write_vectors(df, f"{tmpdir_path}/vec_csv", wide=True)
    back = sorted(tuple(r) for r in SC.read_vectors(spark, f"{tmpdir_path}/vec_csv").collect())
    assert back == [("a", "f1", [1.0, 2.0]), ("b", "f2", [3.0, 4.0])]
    SK.write_xy(spark.createDataFrame([("n", 1.0, 2.0)], "name string, x double, y double"), f"{tmpdir_path}/xy")
    assert spark.read.csv(f"{tmpdir_path}/xy", header=True).columns == ["Name", "X", "Y"]


def test_summaries(spark, summaries):
    s = SC.read_summaries(spark, summaries)
    rows = {r["name"]: r for r in s.collect()}
    a = rows["a.summary"]
    assert {r["n_sections"] for r in rows.values()} == {4} and a["url"] == "http://news.example.com/a"
    assert [tuple(x) for x in a["sentences"]] == [("@entity0 said the @entity1 opened on Monday .", 1), ("It was n't raining", 0)]
    assert a["highlights"] == ["the *bridge* opened", "crowds came"]
    assert [tuple(x) for x in a["entities"]] == [("@entity0", "Mayor Ann Lee"), ("@entity1", "Long Bridge")]
    assert sorted(r["doc_id"] for r in rows.values()) == [1, 2]


def test_sniff_text_formats(spark, tmpdir_path):
    files = {"a": "<!doctype html><p>x", "b": "\n \t<HTML><body>x", "c": '<?xml version="1.0"?><r/>', "d": "say <html>",
             "e": "\ufeff<!DOCTYPE HTML>"}
    for name, text in files.items():
        write(tmpdir_path, name, text.encode(), "wb")
    got = {r["name"]: r["mime"] for r in SC.sniff_mime(spark, [tmpdir_path]).collect()}
    assert got == {"a": "text/html", "b": "text/html", "c": "application/xml", "d": "text/plain", "e": "text/html"}
    docs = SC.read_extracted(spark, {"old": [tmpdir_path]}).collect()
    assert sorted((r["doc_id"], r["name"], r["side"]) for r in docs) == [(i + 1, n, "old") for i, n in enumerate("abcde")]
    assert next(r["text"] for r in docs if r["name"] == "a").strip() == "x"


def test_porter_examples():
    for w, st in {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat",
                  "generalizations": "gener", "electrical": "electr", "adoption": "adopt"}.items():
        assert porter_stem(w) == st


def test_word2vec_save_lookup_and_report(spark, tmpdir_path):
    from pyspark.ml.feature import Word2VecModel
    from wordloom.operators import embed as E
    from wordloom.operators.similarity import named_report, sparse_topk
    sents = spark.createDataFrame([(["a", "b", "c"],), (["b", "c", "d"],)] * 5, "sentence array<string>")
    wv = E.save_word2vec(sents, f"{tmpdir_path}/w2v", dim=4, partitions=1)
    assert Word2VecModel.load(f"{tmpdir_path}/w2v").getVectors().count() == 4
    assert E.lookup(wv, "b").count() == 1 and E.lookup(wv, "zz").count() == 0
    w = spark.createDataFrame([(1, "x", 1.0), (10, "x", 1.0), (11, "y", 1.0)], "doc_id long, term string, w double")
    top = sparse_topk(w.where("doc_id < 10"), w.where("doc_id >= 10"), 1)
    names = spark.createDataFrame([(1, "q.txt"), (10, "a.txt"), (11, "b.txt")], "doc_id long, name string")
    rep = named_report(top, names, names).first()
    assert (rep["query_name"], rep["rank"], rep["ref_name"]) == ("q.txt", 1, "a.txt")
