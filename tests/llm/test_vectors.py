"""Top-k search and lattice hashing against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import lattice, topk
from basketry.llm.components import components
from basketry.llm.e8 import SHORTEST, nearest, neighbours


def edge_vectors():
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 6))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(20 + k, [float(x) for x in base[0] + r.normal(size=6) * 0.05]) for k in range(9)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, [2 * x for x in rows[3][1]])]
    rows += [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (52, [math.nan] * 6), (53, [math.inf] * 6),
             (54, [0.0] * 6), (55, []), (56, [1.0, 2.0]), (57, [1.0, 2.0]), (None, rows[0][1]),
             (5, rows[5][1])]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(edge_vectors(), "vec_id bigint, embedding array<double>")
    return df.withColumns({c: F.lit("clash") for c in ("id", "v", "cell", "task", "dim", "score", "rank", "n")}).repartition(3)


def distinct(rows):
    out = {}
    for k, v in rows:
        if k is not None:
            out[k] = v if k not in out or v is not None and v < out[k] else out[k]
    return out


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, queries, k):
    have = {i: [math.floor(256 * x) for x in v] for i, v in distinct(rows).items() if sound(v)}
    out = []
    for q in queries:
        if q in have:
            scores = [(-sum(a * b for a, b in zip(have[q], v)), i) for i, v in have.items()
                      if i != q and len(v) == len(have[q])]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("k, block_bytes, nodes", [(5, 4 << 20, 2), (3, 200, 4), (1, 150, 1), (40, 250, 9)])
def test_top_k(vectors, k, block_bytes, nodes):
    ids = [0, 3, 5, 20, 40, 42, 50, 51, 54, 55, 56]
    got = topk.top_k(vectors, vectors.where(F.col("vec_id").isin(ids)), k=k, nodes=nodes, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(edge_vectors(), ids, k)


@pytest.mark.parametrize("nodes", [2, 3])
def test_top_k_copies_and_negative_scores(spark, nodes):
    r = np.random.default_rng(7)
    rows = [(k, [float(x) for x in -abs(v)]) for k, v in enumerate(r.normal(size=(40, 5)))]
    rows = [(k, v if k % 3 else [-x for x in v]) for k, v in rows]  # most inner products are below 0
    rows += [(100 + k, rows[k % 2][1]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    ids = [0, 1, 2, 3, 100, 101, 117]
    got = topk.top_k(df, df.where(F.col("vec_id").isin(ids)), k=4, nodes=nodes, block_bytes=300)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, ids, 4)


def test_nodes_give_few_entries_and_none_that_is_needed_is_missing():
    """Phase 2 on a block: with the cutoff of each query, far fewer entries than pairs, and at least one of each best row."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    rows, queries = np.floor(256 * r.normal(size=(2000, 16))), np.floor(256 * r.normal(size=(20, 16)))
    scores = queries @ rows.T
    cutoffs = np.sort(scores, axis=1)[:, -5]
    given = []
    for node, at in enumerate((slice(0, 8), slice(8, 16))):
        left = pa.table({"id": pa.array(np.arange(2000)), "copies": pa.array(np.ones(2000, np.int32)),
                         "part": pa.array(rows[:, at].tolist()), "node": pa.array(np.full(2000, node, np.int32))})
        right = pa.table({"id": pa.array(np.arange(5000, 5020)), "part": pa.array(queries[:, at].tolist()),
                          "cutoff": pa.array(cutoffs.astype(np.int64))})
        given += [(e["query_id"] - 5000, e["class"]) for e in topk._shares(left, right, 2).to_pylist()]
        lists = topk._lists(left, right, 5).to_pylist()
        assert len(lists) == 20 * 5 and all(e["node"] == node for e in lists)
    assert len(given) < 0.1 * scores.size
    assert set(zip(*(x.tolist() for x in np.nonzero(scores >= cutoffs[:, None])))) <= set(given)


def test_top_k_ties_large_numbers_and_empty(spark, vectors):
    rows = [(k, [1.0, 1.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 7"), k=5).collect()) == brute_top(rows, [7], 5)
    big = [(1, [3e6, 1.0]), (2, [2e6, 5.0]), (3, [2e6, -5.0]), (4, [2e6, 5.0])]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, df, k=2).collect()) == brute_top(big, [1, 2, 3, 4], 2)
    assert topk.top_k(vectors.limit(0), vectors).isEmpty() and topk.top_k(vectors, vectors.limit(0)).isEmpty()
    huge = spark.createDataFrame([(1, [1e30]), (2, [1e30])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, huge).collect()


def test_e8_points():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 8)) * 2
    p = nearest(x)
    whole = (p % 1 == 0).all(axis=1)
    assert (whole | ((p - 0.5) % 1 == 0).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius is 1
    assert ((x[:, None] - (p[:, None] + SHORTEST[None])) ** 2).sum(axis=2).min(axis=1).min() >= 0
    offsets, costs = neighbours(x, p, 3)
    assert (costs >= -1e-9).all() and (np.diff(costs, axis=1) >= 0).all()
    assert np.allclose(((x - p - offsets[:, 0]) ** 2).sum(axis=1) - d, costs[:, 0])


def brute_links(rows, least):
    have = distinct(rows)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in have.items() if sound(v) and any(v)}
    link = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least - 1e-12}
            if i in unit else set() for i in have}
    component = {i: i for i in have}
    for _ in have:
        component = {i: min([component[i], *(component[j] for j in link[i])]) for i in have}
    return sorted((i, len(link[i]), component[i], component[i] == i) for i in have)


@pytest.mark.parametrize("block", [2, 2048])
def test_near_vectors(vectors, block):
    got = lattice.near_vectors(vectors, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(edge_vectors(), 0.95)


def test_near_vectors_recall(spark):
    r = np.random.default_rng(9)
    rows = []
    for g in range(60):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = r.uniform(0.951, 0.99)
        rows += [(2 * g, a.tolist()), (2 * g + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = {x.vec_id: x.n_links for x in lattice.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.95 * 120
    assert lattice.near_vectors(df.limit(0)).isEmpty()


def test_near_vectors_tasks_hold_replicated_rows(spark, monkeypatch):
    most = 3000
    edges, counts = lattice._edges, lattice._counts

    def spied(step):
        def run(table, least):
            assert table.num_rows <= most
            return step(table, least)
        return run

    monkeypatch.setattr(lattice, "_edges", spied(edges))
    monkeypatch.setattr(lattice, "_counts", spied(counts))
    monkeypatch.setattr(lattice, "TASK_ROWS", 1000)
    r = np.random.default_rng(2)
    base = r.normal(size=16)
    rows = [(k, (base + r.normal(size=16) * 0.01).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = sorted(tuple(x) for x in lattice.near_vectors(df, block=10, tables=2).collect())
    assert got == [(k, 299, 0, k == 0) for k in range(300)]


def test_components(spark):
    path = [(k, k + 1) for k in range(0, 60)]
    star = [(100, 100 + k) for k in range(1, 40)]
    edges = path + star + [(200, 200), (301, 300), (301, 300), (300, 302)]
    r = np.random.default_rng(1)
    df = spark.createDataFrame([edges[k] for k in r.permutation(len(edges))], "a bigint, b bigint")
    got = {x.id: x.component for x in components(df).collect()}
    want = {k: 0 for k in range(61)} | {100 + k: 100 for k in range(40)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert components(df.where("a = 200")).isEmpty()
