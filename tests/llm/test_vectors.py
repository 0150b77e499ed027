"""Operators on vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from folioflow.llm import embedding_dedup, topk
from folioflow.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, bucket int, norm string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    for k in range(60):  # near copies, some of them chained, and equal vectors
        v[240 + k] = v[k // 6] + (rng.normal(size=12) * 0.05 if k % 6 else 0)
    v[:40] *= np.linspace(0.1, 8, 40)[:, None]
    out = [(i, [float(x) for x in v[i]], i % 3 if i < 280 else 0, 1, "x") for i in range(300)]
    odd = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [0.0] * 12]
    out += [(300 + 20 * k, x, 1, 1, "x") for k, x in enumerate(odd)]
    out += [(500, out[0][1], None, 1, "x"), (None, out[1][1], 1, 1, "x"), out[7]]
    return out


@pytest.mark.parametrize(("bucket", "together"), [(2048, 4), (32, 2)])
def test_top_k(spark, rows, bucket, together):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = topk.top_inner_products(df, "id % 20 = 0", k=7, bucket_rows=bucket, query_rows=5, buckets_together=together).collect()
    good = {i: np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 12 - len(v)))) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q)[:7]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_nothing(spark):
    assert topk.top_inner_products(spark.createDataFrame([], SCHEMA), "id % 20 = 0").count() == 0


def test_top_k_of_huge_and_ragged_vectors(spark):
    rows = [(1, [1.0, 2.0]), (20, [3.0, 1.0]), (3, [-1e308, 0.0]), (40, [1e300, 5.0]), (5, [1e7, 3.0, 2.0]), (60, [2.0**25, -7.25]), (7, []), (8, [0.0, 0.0]), (9, [2.0**24 + 1, 4.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_inner_products(df, "id % 20 = 0", k=4).collect()}
    whole = {i: [topk.floor(topk.Fraction(x) * 64) for x in v] + [0] * (3 - len(v)) for i, v in rows}
    want = set()
    for q in (20, 40, 60):
        every = [(max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q]
        want |= {(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(every, key=lambda x: (-x[0], x[1]))[:4])}
    assert got == want


def test_top_k_where_norms_prune(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)) * np.geomspace(50, 0.05, 600)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_inner_products(df, "id % 20 = 0", k=5, bucket_rows=16, query_rows=4, buckets_together=2).collect()}
    whole = np.floor(64 * v)
    want = set()
    for q in range(0, 600, 20):
        best = sorted((-int(whole[i] @ whole[q]), i) for i in range(600) if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want


def test_coordinate_bounds_lose_nothing():
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(2000, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for q in unit[:50]:
        for least in (0.75, 0.9, 0.99):
            near = set(np.flatnonzero(unit @ q >= least).tolist())
            assert near <= set(topk._candidates(unit, q, least, np.argsort(-np.abs(q))[:4]).tolist())


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, rows, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "UNIT_ROWS", block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    good = {i: (np.array(v, float), l) for i, v, l, *_ in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: 0 for i, *_ in rows}
    up = {i: i for i, *_ in rows}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a < b and la == lb and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                low, high = sorted((top(a), top(b)))
                up[high] = low
    assert sum(links.values()) > 50
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], top(r.vec_id), r.vec_id == top(r.vec_id) or r.vec_id is None)


def test_near_duplicates_of_tiny_huge_and_ragged_vectors(spark):
    rows = [
        (1, [1e-200, 0.0], 1), (2, [2e-200, 0.0], 1), (3, [1e200, 1.0], 1), (4, [2e200, 1.0], 1), (5, [1.0, 0.0, 0.0], 1), (6, [5e-324, 0.0, 0.0], 1),
        (7, [0.0, 0.0], 1), (8, [1.7e308, 1.7e308], 2), (9, [3.0, 3.0], 2), (10, [-3.0, -3.0], 2), (11, [], 2), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3),
    ]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 8: (1, 8), 9: (1, 8), 12: (1, 12), 13: (1, 12)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: links.get(i, (0, i)) for i, *_ in rows}


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probes_lose_no_pair():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(1500, 16))
    unit[750:] = unit[:750] + rng.normal(size=(750, 16)) * 0.08
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q = embedding_dedup.Quantiser(unit, lists=20)
    lists = q.probes(unit, np.sqrt(2 - 2 * 0.98))
    for a, b in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.98), strict=True):
        assert lists[a][0] in lists[b] or lists[b][0] in lists[a]


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    up = {}

    def top(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: top(k) for k in up if any(k in e and e[0] != e[1] for e in edges)}


def test_labels_and_vectors_of_one_row_stay_together(spark):
    """An id whose vector has no label and whose label has no vector links with nothing; reruns agree where rows of an
    id differ."""
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(1, v, "a"), (2, v, None), (2, None, "a"), (3, v, "a"), (4, w, "b"), (4, v, "a"), (5, [0.0, 0.0, 0.0], "a")]
    schema = "vec_id long, embedding array<double>, label string"
    for parts in (1, 3):
        df = spark.createDataFrame(rows[::1 if parts == 1 else -1], schema).repartition(parts)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
        assert got == {1: (2, 1), 2: (0, 2), 3: (2, 1), 4: (2, 1), 5: (0, 5)}
        best = topk.top_inner_products(df, "id = 1", k=2).select("vec_id", "score").collect()
        assert sorted(map(tuple, best)) == [(2, 64 * 64 + 32 * 32), (3, 64 * 64 + 32 * 32)]
