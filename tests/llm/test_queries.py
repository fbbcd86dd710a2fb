"""Every opN query over whole small tables, against brute force, exact round trips or the registered SQL."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from wordloom.llm import queries as Q
from wordloom.llm.common import read
from wordloom.llm.line_dedup import normal

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(result.fetchall())


def test_quality(spark):
    rows = Q.op1_quality_bayes(spark, SF).collect()
    assert len(rows) == len(table("documents"))
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in table("labels")}
    judged = [(r["kept"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert np.mean([a == b for a, b in judged]) > 0.9
    logit = lambda p: np.log(p / (1 - p))
    soft = {r["doc_id"]: round(r["evidence"] * 1e6) / 1e6 for r in rows}
    base = (sum(soft.values()) + 1) / (len(rows) + 2)
    for r in rows:
        want = logit(r["evidence"]) + logit(r["path_posterior"]) - logit(base)
        assert abs(logit(r["quality"]) - want) < 1e-6
    by = defaultdict(list)
    for r in rows:
        by[r["host"]].append(soft[r["doc_id"]])
    for r in rows:  # a posterior lies between the host's own share and the corpus'
        own = np.mean(by[r["host"]])
        assert min(own, base) - 1e-9 <= r["host_posterior"] <= max(own, base) + 1e-9


def test_quality_held_out(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    from wordloom.llm.quality import quality_scores
    scored = quality_scores(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "kept")
    rows = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    poor = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(clean) > 0.95 and np.mean(poor) < 0.2


def test_embedding_dedup(spark):
    rows = {r["vec_id"]: r for r in Q.op2_embedding_dedup(spark, SF).collect()}
    data = table("embeddings")
    x = np.array([r["embedding"] for r in data], np.float64)
    ids = [r["vec_id"] for r in data]
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(cosine >= 0.9)) if i < j]
    count = Counter(i for pair in links for i in pair)
    want = components(ids, links)
    assert {i: (count[i], want[i], want[i] == i) for i in ids} == {
        i: (r["n_links"], r["component_id"], r["kept"]) for i, r in rows.items()}


def test_shards(spark):
    rows = Q.op3_hash_tree_shards(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    text = {r["doc_id"]: r["text"].encode() for r in table("documents")}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]])) for r in rows)


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_ngram_join(spark, n, num):
    from wordloom.llm.ngram_join import ngram_jaccard_components
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in ngram_jaccard_components(read(spark, sf, "documents"), n, num, 100).collect()}
    sets = {r["doc_id"]: shingles(r["text"], n) for r in table("documents", sf)}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            few, many = sorted((len(sets[a]), len(sets[b])))
            if few and 100 * few >= num * many:
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (few + many - both):
                    links.append((a, b))
    want = components(ids, links)
    assert {i: (len(sets[i]), want[i]) for i in ids} == {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()}


def test_neighbours(spark):
    rows = Q.op5_ann_forest(spark, SF).collect()
    data = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in table("embeddings")}
    ids = np.array(sorted(data))
    x = np.array([data[i] for i in ids])
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert abs(r["score"] - data[r["query_id"]] @ data[r["vec_id"]]) < 1e-12
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    recall = []
    for q in (i for i in ids if i % 20 == 0):
        score = x @ data[q]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        assert got[q] == sorted(got[q]) and len(got[q]) == 20 and q not in {v for _, v in got[q]}
        recall.append(len({v for _, v in got[q]} & set(best)) / 20)
    assert len(recall) == len(got) and np.mean(recall) >= 0.9


def test_mixing(spark):
    docs = read(spark, SF, "documents")
    from wordloom.llm.mixing import mix_sources, mixed_rows
    rows = Q.op7_mixing(spark, SF).collect()
    text = {r["doc_id"]: r for r in table("documents")}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in text.items()}
    whole = Counter()
    for i, r in text.items():
        whole[r["source"]] += size[i]
    names = sorted(whole, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), sum(whole.values())  # reshared until none is above
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * whole[s]}
        goal |= {s: 3 * whole[s] for s in above} if above else share
        left -= sum(goal[s] for s in above)
        open_ = open_ - above if above else set()
    taken = Counter()
    for r in rows:
        source = text[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[source]
        assert abs(r["target"] - goal[source]) < 1e-6 * goal[source]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= max(0.05 * goal[s], 300) for s in names)
    again = mix_sources(docs.repartition(7, "n_chars")).select(*rows[0].__fields__)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
    words = Counter()
    for r in mixed_rows(docs, block=256).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_fuzzy_lines(spark):
    rows = {(r["doc_id"], r["line_no"]): r for r in Q.op8_fuzzy_lines(spark, SF).collect()}
    lines = {(r["doc_id"], i): normal(x) for r in table("documents") for i, x in enumerate((r["text"] or "").split("\n"))
             if normal(x)}
    assert rows.keys() == lines.keys()
    sets = {x: {x[i:i + 8] for i in range(len(x) - 7)} or {x} for x in set(lines.values())}
    by = defaultdict(set)
    for x, own in sets.items():
        for s in own:
            by[s].add(x)
    links = set()
    for x, own in sets.items():
        shared = Counter(y for s in own for y in by[s] if y < x)
        links |= {(y, x) for y, k in shared.items() if 100 * k >= 80 * (len(own) + len(sets[y]) - k)}
    group = components(sets, links)
    first = {}
    for place in sorted(lines):
        first.setdefault(group[lines[place]], place)
    right = sum((r["first_doc_id"], r["first_line_no"]) == first[group[lines[p]]] for p, r in rows.items())
    assert right >= 0.995 * len(rows)
    for p, r in rows.items():  # no line joins a component that it does not belong to
        assert group[lines[(r["first_doc_id"], r["first_line_no"])]] == group[lines[p]]
        assert r["kept"] == (p == (r["first_doc_id"], r["first_line_no"]))


def test_packing(spark):
    rows = Q.op10_harmonic_packing(spark, SF).collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {r["doc_id"]: np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
           for r in table("documents")}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]: r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(sequences) == list(range(len(sequences)))
    assert padding < 0.02 * sum(map(len, ids.values()))
