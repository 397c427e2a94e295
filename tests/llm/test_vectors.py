import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from sonolith.llm import embedding_dedup, knn, queries

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def brute_top(rows, k, every):
    """Ranks by exact integers; every row is a candidate but the query's own."""
    data = [
        (i, [math.floor(64 * Fraction(float(np.float32(x)))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, most = Counter(), 2**63 - 1
    for n, (q, a) in enumerate(data):
        if q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(data) if m != n and len(b) == len(a))
        out.update((q, r, i, max(-most, min(most, -s))) for r, (s, i) in enumerate(scores[:k], 1))
    return out


def odd_vectors(n=300, width=8, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, width))
    rows = [(i, (base[i % 6] + 0.1 * rng.normal(size=width) * (i % 5)).astype(np.float32).tolist()) for i in range(n)]
    rows[7] = (7, None)
    rows[8] = (8, [])
    rows[9] = (9, [1.0, None] + [0.0] * (width - 2))
    rows[10] = (10, [float("nan")] * width)
    rows[11] = (11, [float("inf")] * width)
    rows[12] = (12, [0.0] * width)
    rows[13] = (13, [1.0, 2.0])
    rows[20] = (20, [2.0, 1.0])
    rows += [(None, rows[0][1]), rows[40], (500, rows[40][1]), (501, rows[40][1])]
    return rows


@pytest.mark.parametrize("shard,leaf,asked", [(8192, 128, 1 << 15), (64, 4, 5), (9, 2, 3)])
def test_top_k_equals_brute_force(spark, shard, leaf, asked):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = Counter(tuple(r) for r in knn.top_k(df, shard=shard, leaf=leaf, queries=asked).collect())
    assert got == brute_top(rows, 20, 20)


def test_top_k_of_a_table_and_of_none(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op2_top_k(spark, small).collect()) == brute_top(rows, 20, 20)
    assert knn.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_k_rows_of_a_repeated_id_are_rows_of_their_own(spark):
    rows = [(40, [float(i % 7), 1.0]) for i in range(100)] + [(40, [0.0, 0.0, 0.0])] + [(i, [1.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    assert Counter(tuple(r) for r in knn.top_k(df, shard=8, leaf=2, queries=7).collect()) == brute_top(rows, 20, 20)


@pytest.mark.parametrize("shard", [8192, 16])
def test_top_k_of_components_of_any_size(spark, shard):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(60)]
    big = [3e5, -3e5, 2.0**24, 1e9, -1e9, 1e18, 1e30, -1e30, 3.4e38, -3.4e38]
    rows += [(60 + n, [float(np.float32(x)), float(n), 1.0]) for n, x in enumerate(big)] + [(80 + n, [1.0, float(np.float32(x)), 1.0]) for n, x in enumerate(big)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    for every in (20, 1):
        assert Counter(tuple(r) for r in knn.top_k(df, every=every, shard=shard, leaf=4).collect()) == brute_top(rows, 20, every)


def test_top_k_skips_cells_that_cannot_reach(spark):
    near = knn._reached({2: ([(False, 0), (False, 1)], np.array([[0.0, 0.0], [640.0, 0.0]]), np.array([[64.0, 64.0], [704.0, 64.0]]))}, 64.0)
    batch = pa.record_batch({"v": pa.array([[1.0, 0.0], [-1.0, 0.0]]), "width": pa.array([2, 2], pa.int32()), "least": pa.array([41000.0, 0.0])})
    (out,) = near([batch])
    assert [[c["cell"] for c in cells] for cells in out.column("cells").to_pylist()] == [[1], [0]]


def brute_links(rows, least=0.95):
    good = [
        (n, i, np.array(v, float)) for n, (i, v) in enumerate(rows)
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links, up = defaultdict(int), {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (n, i, x) in enumerate(good):
        for m, j, y in good[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[n] += 1
                links[m] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    per_id = defaultdict(int)
    for n, (i, _) in enumerate(rows):
        per_id[i] += links[n]
    return {i: (per_id[i] if i is not None else 0, None if i is None else root(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [2048, 7])
def test_embedding_links_equal_brute_force(spark, block):
    rows = odd_vectors(240, 16)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    assert len(got) == len(rows)
    want = brute_links(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.component_id in (None, r.vec_id))


def test_embedding_recall_on_a_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, got = brute_links(rows), {r.vec_id: r for r in queries.op5_embedding_dedup(spark, small).collect()}
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert found <= there and found >= 0.99 * there
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
