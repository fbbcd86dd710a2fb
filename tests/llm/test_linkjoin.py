"""The join's later rounds against brute force, in cells of a few nodes."""

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm import linkjoin
from wordloom.llm.common import blobs

NUM, DEN = 80, 100


def families(seed: int) -> dict[int, np.ndarray]:
    """Sets around a few cores: chains of near copies, most pairs just above or just below the threshold."""
    rng, out = np.random.default_rng(seed), {}
    for core in range(3):
        base = rng.integers(0, 1 << 62, 60 if core else 400, dtype=np.uint64)
        for _ in range(40):
            swapped = base.copy()
            at = rng.choice(len(base), int(len(base) * rng.choice([0.05, 0.09, 0.13])), replace=False)
            swapped[at] = rng.integers(0, 1 << 62, len(at), dtype=np.uint64)
            out[len(out)] = np.unique(swapped)
            if rng.random() < 0.2:
                base = swapped
    return out


def linked(a, b) -> bool:
    both = len(np.intersect1d(a, b))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def components(sets) -> dict[int, int]:
    label = {i: i for i in sets}
    while True:
        after = {i: min(label[j] for j in sets if linked(sets[i], sets[j])) for i in sets}
        after = {i: min(x, after[x]) for i, x in after.items()}
        if after == label:
            return label
        label = after


@pytest.mark.parametrize("seed,needs", [(1, True), (2, False)])
def test_components_equal_brute_force(spark, seed, needs):
    sets = families(seed)
    rows = [(int(t.astype(np.int64)), 0, i, len(s), 1) for i, s in sets.items() for t in s[: len(s) // 2]]
    whole = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "node long, payload binary")
    profile = spark.createDataFrame([(i, len(s), 1, s[: len(s) // 2].tobytes(), linkjoin.parities(s)) for i, s in sets.items()],
                                    linkjoin.PROFILE)
    postings = spark.createDataFrame(rows, linkjoin.POSTINGS)
    got = linkjoin.link_components(
        postings if needs else postings.select("token", "salt", "node"), lambda nodes: whole.join(nodes, "node", "left_semi"),
        lambda nodes: (profile, None), lambda raw: [np.frombuffer(x, np.uint64) for x in raw], NUM, DEN, block=4, again=needs)
    got = {r["node"]: r["component"] for r in got.collect()}
    truth = components(sets)
    assert 3 < len(set(truth.values())) < len(sets)
    assert {i: got.get(i, i) for i in sets} == truth


def cell_rows(sets, comps, p=0, q=0, block=None):
    n, m = [len(s) for s in sets], len(sets)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(m, np.int64)), pa.array(np.full(m, p)), pa.array(np.full(m, q)),
         pa.array(np.zeros(m, np.int64) if block is None else np.array(block)), pa.array(np.arange(m)), pa.array(np.array(comps)),
         pa.array(np.array(n, np.int64)), blobs([linkjoin.parities(s) for s in sets])],
        ["token", "p", "q", "block", "node", "comp", "n", "parity"])


def test_a_cell_gives_a_forest():
    same = [np.arange(50, dtype=np.uint64)] * 200
    run = lambda each, comps, **more: [
        pair for batch in linkjoin._cells(NUM, DEN, each)(iter([cell_rows(same, comps, **more)]))
        for pair in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
    apart = list(range(200))
    assert len(run(True, apart)) == 200 * 199 // 2
    forest = run(False, apart)
    assert len(forest) == 199 and len({x for pair in forest for x in pair}) == 200
    assert len(run(False, [i % 7 for i in apart])) == 6
    assert run(False, [0] * 200) == []
    halves = [i % 2 for i in apart]
    assert len(run(True, apart, p=0, q=1, block=halves)) == 100 * 100


def test_every_pair_of_components_meets_in_a_block(spark):
    comp = {i: 0 if i < 50 else i % 9 + 1 for i in range(60)}
    left = spark.createDataFrame([(7, i, c, 60) for i, c in comp.items()], "token long, node long, comp long, c long")
    rows = linkjoin._block_pairs(left, 8).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r["p"], r["q"]), []).append((r["node"], r["block"]))
    met = {(a, b) for (p, q), nodes in cells.items() for a, x in nodes for b, y in nodes if a < b and (p == q or x != y)}
    assert met >= {(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b]}
    assert not any(comp[a] == comp[b] == 0 for a, b in met)
    assert linkjoin._dealt(left, 0, 8).count() == 60
