import re
from collections import defaultdict

import numpy as np
import pytest
from sonolith.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size string, target string"


def brute_targets(sizes, weights=(3, 1, 2), volume=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = set(names), {}
    while left:
        rest = volume * sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}
        left -= over
    return fixed


def made():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        source = ["hot", "b", "ä", "Z", None, "tiny", "blank"][rng.choice(7, p=[0.5, 0.15, 0.15, 0.1, 0.08, 0.01, 0.01])]
        n = 0 if source == "blank" else int(rng.choice([0, 1, 7, 40, 300]))
        rows.append((i, None if n == 0 and i % 2 else "w " * n, source))
    return rows + [(5, "a b c", "b"), (5, "a b c", "b"), (None, "x y", "hot"), (9000, "q " * 20_000, "hot")]


@pytest.mark.parametrize("block", [4096, 50])
def test_mix_meets_targets(spark, block):
    rows = made()
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)
    got = mixing.mix(df, block=block).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 * largest[s] / (1 + sizes[s] / 1e5) * (sizes[s] < 2000 or s == "hot") + 300
    again = mixing.mix(df.repartition(3), block=block).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_rows_alike_fly_as_one(spark):
    rows = [(None, "x y", "a")] * 901 + [(4, "x y", "a")] * 500 + [(i, "u v w " * (i % 9), "b") for i in range(300)]
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)
    got = mixing.mix(df, block=50).collect()
    assert len(got) == len(rows)
    for i, n in ((None, 901), (4, 500)):
        own = [r for r in got if r.doc_id == i and r.source == "a"]
        ratio = own[0].target / own[0].source_size
        assert len(own) == n and abs(sum(r.copies for r in own) - n * ratio) < 1
    known = spark.range(1000).selectExpr("false AS no_id", "5L AS doc_id", "'a' AS source", "7L AS size", "0.3D AS chance", "1L AS draw")
    chances = sorted(r.chance for r in mixing._among_alike(known).collect())
    assert sum(chances) == pytest.approx(300) and sum(0 < c < 1 for c in chances) <= 1


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 999):
        chance, size = rng.random(n), rng.integers(0, 40, n).astype(float)
        done = mixing.fly(chance, size, np.random.default_rng(n))
        assert ((done > 0) & (done < 1)).sum() <= 2
        assert done.sum() == pytest.approx(chance.sum()) and done @ size == pytest.approx(chance @ size)
        landed = mixing.land(done, size)
        assert set(landed) <= {0.0, 1.0}


def test_flight_keeps_each_chance_on_average():
    size = np.array([1.0, 5, 9, 2, 2, 30, 4, 8])
    chance = np.full(8, 0.25)
    drawn = np.mean([mixing.fly(chance, size, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(drawn - 0.25).max() < 0.03


def test_query_and_empty_table(spark, small):
    got = queries.op10_mixing(spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = mixing.mix(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(0, 0.0, 0)]
