import os

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr("t").alias("x")).first()["x"]


def test_url_rule(spark):
    s = "http://a.b/c d\r\n\r\nhello @x y\nhttp://q\nmore 12"
    assert one(spark, T.strip_url_lines, s) == "hello @x y\nmore 12"


def test_clean_preset_keeps_capitalised_stopwords(spark):
    toks = one(spark, T.clean_old_new, "The cat and the dog @bob went to the-park 42 times")
    assert toks == ["The", "cat", "dog", "went", "park", "times"]


def test_word_list_and_sentences(spark):
    assert one(spark, T.word_list, "Hello, World! 3D e-mail") == ["hello", "world", "d", "e", "mail"]
    sents = one(spark, T.sentence_words, "First one. Second? ... Third!")
    assert sents == [["first", "one"], ["second"], ["third"]]


def test_tokenizers(spark):
    assert one(spark, T.word_tokens, "They're fine, didn't they?") == \
        ["They", "'re", "fine", ",", "did", "n't", "they", "?"]
    assert one(spark, T.punct_tokens, "it's a test, ok?") == ["it's", "a", "test", ",", "ok", "?"]
    assert one(spark, lambda c: T.alpha_tokens(T.whitespace_tokens(c)), "abc 3d e-mail été") == ["abc", "été"]
    assert one(spark, T.unicode_terms, "Ça va, a b cd_e 12") == ["ça", "va", "cd_e", "12"]


def test_pad_sequence(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6, 7],)], "s array<int>")
    out = [r["p"] for r in df.select(T.pad_sequence("s", 5).alias("p")).collect()]
    assert out == [[0, 0, 1, 2, 3], [3, 4, 5, 6, 7]]


def test_newsgroup_strip(spark):
    doc = "From: a@b\nSubject: x\n\nHello there\n> quoted line\nBob writes:\nbody text\n--\nsig line"
    assert one(spark, T.strip_newsgroup_parts, doc) == "Hello there\nbody text"
    assert one(spark, T.strip_newsgroup_header, "no blank line") == ""


def test_sample_corpus_cleaning(spark, summaries):
    from wordloom.sources.corpus import read_corpus
    docs = read_corpus(spark, {"old": [summaries]})
    toks = {r["name"]: r["t"] for r in docs.select("name", T.clean_old_new("text", stops=[]).alias("t")).collect()}
    assert toks["b.summary"] == "Two boats crews boats raced".split()
    assert toks["a.summary"] == ("said the opened on Monday It was n t raining the bridge opened crowds came Ann Lee "
                                 "Bridge").split()


def test_word_tokens_accents_and_clitics(spark):
    assert one(spark, T.word_tokens, "na\u00efve caf\u00e9, didn't they're well-known") == [
        "na\u00efve", "caf\u00e9", ",", "did", "n't", "they", "'re", "well-known"]


def test_sentences_keep_abbreviations(spark):
    assert one(spark, T.split_sentences, "Mr. Smith came. Dr. Lee, e.g. Ann, left! Was it 5 p.m. then? Yes.") == [
        "Mr. Smith came.", "Dr. Lee, e.g. Ann, left!", "Was it 5 p.m. then?", "Yes."]


def test_html(spark):
    page = ("<html><head><title>T</title><style>p{a:b}</style><script type='x>y'>var t='</p>';</script></head><!-- c > d -->"
            "<body><p a=\"1>2\">One<br/>two &amp;lt; &#233;&#x41; &lt;b&gt;</p><p>three <b>four</b></p></body></html>")
    from wordloom.functions.html import strip_html
    text = one(spark, strip_html, page)
    assert text.split() == ["T", "One", "two", "&lt;", "\u00e9&#x41;", "<b>", "three", "four"]


def test_custom_splitter(spark):
    got = one(spark, lambda c: T.sentence_words(c, splitter=lambda x: F.split(x, "\n")), "A b.\nC d")
    assert got == [["a", "b"], ["c", "d"]]
