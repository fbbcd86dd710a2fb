"""The pipeline's stages one after the other, each against its own input."""

from collections import Counter, defaultdict
from types import SimpleNamespace

import corpus_pipeline as P
import numpy as np
import pyarrow as pa

from wordloom.llm import line_dedup as L
from wordloom.llm import mixing as M
from wordloom.llm.common import FILTER_BITS

from tests.llm.test_queries import SF, WORD, components, shingles, table


def test_stages(spark):
    docs = P.read(spark, SF, "documents")
    columns, before = docs.columns, table("documents")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table("labels")}
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = P.write_state(stage(spark, docs, SF), name)
        assert out.columns == columns and out.schema.fields == docs.schema.fields
        kept[name] = [r.asDict() for r in out.collect()]
        docs = out
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}

    first = {r["doc_id"]: r for r in kept["quality_classifier"]}
    source = {r["doc_id"]: r for r in before}
    assert all(source[i] == r for i, r in first.items())
    clean = [i for i, (q, t) in labels.items() if q == 1 and t == 0]
    assert sum(i in first for i in clean) > 0.95 * len(clean)

    lines = {r["doc_id"]: r for r in kept["line_dedup"]}
    for i, r in lines.items():  # what is left are lines of the document, in their order
        rest = iter(first[i]["text"].split("\n"))
        assert all(any(x == y for y in rest) for x in r["text"].split("\n")) and r["n_chars"] == len(r["text"])
    count = Counter(x.strip().lower() for r in lines.values() for x in r["text"].split("\n") if x.strip())
    assert max(count.values()) == 1

    sets = {i: shingles(r["text"], 5) for i, r in lines.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = components(sets, links)
    assert ids["ngram_jaccard"] == {i for i in sets if group[i] == i}

    words, near = Counter(), {r["doc_id"]: r for r in kept["ngram_jaccard"]}
    for r in kept["mixing"]:
        assert r["text"] in near[r["doc_id"]]["text"]
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert all(n <= 3 * len(WORD.findall(near[i]["text"])) for i, n in words.items())

    pieces = defaultdict(int)
    for r in P.run(spark, SF).collect():
        pieces[r["sequence_id"]] += r["length"]
    assert max(pieces.values()) <= 2048


def test_empty(spark):
    docs = P.read(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def shuffled_texts(df):
    """The exchanges of a plan, without broadcasts, that texts go through."""
    jvm = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    shown = df._jdf.queryExecution().explainString(jvm.fromString("formatted"))
    return [x for x in shown.split("\n\n") if " Exchange\n" in x and "text#" in x]


def test_texts_travel_once_to_be_mixed(spark):
    rows = [(i, f"w{i} " * (i % 5), None if i % 7 == 0 else "" if i % 7 == 1 else "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        mixed = M._mix(docs, 4, 7).select("doc_id", "text", "_mix_source_size", "_mix_taken")
        assert len(shuffled_texts(mixed.join(docs.select("doc_id"), "doc_id"))) <= 3  # the mix, its plan, and this join
        got = mixed.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    size = {k: sum(i % 5 for i, _, s, _ in rows if s == k) for k in (None, "", "s")}
    kind = {i: s for i, _, s, _ in rows}
    assert len(got) == 200 and all(r["_mix_source_size"] == size[kind[r["doc_id"]]] for r in got)


def test_only_wanted_lines_are_fetched():
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for doc, line in ((5, 2), (-3, 0)):
        at = (doc % FILTER_BITS * 2654435 + line * 40503) % FILTER_BITS
        bits[at >> 3] |= 1 << (at & 7)
    docs = pa.RecordBatch.from_pydict({"doc_id": [5, -3, 6], "text": ["a\nb\n  C \n", "x\ny", "a\nb"]})
    got = list(L._fetch(SimpleNamespace(value=bits.tobytes()))(iter([docs])))
    assert [x for b in got for x in b["payload"].to_pylist()] == [b"c", b"x"]


def test_lines_of_odd_rows(spark):
    """Repeated and null doc_ids: rows without a repeated line stay as they are, the others lose it."""
    long = "one line that is long enough to be compared with its near copies"
    rows = [(1, f"{long}\nkeep"), (1, "also\nother"), (2, f"own\n{long.upper()} "), (None, long), (3, None), (4, long + "!")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = L.without_repeated_lines(docs)
    assert got.schema == docs.schema
    assert Counter(map(tuple, got.collect())) == Counter(
        [(1, f"{long}\nkeep"), (1, "also\nother"), (2, "own"), (None, long), (3, None), (4, "")])
