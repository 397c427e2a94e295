import random
import re

import numpy as np
import pytest
from sonolith.llm import minhash_dedup as M
from sonolith.llm import queries, shingles

SCHEMA = "doc_id long, text string, rep string, set_key string"


def brute(rows, threshold=75):
    def shingled(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < 5:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = [shingled(t) for _, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by: dict = {}
    for n, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(n)
    for n, s in enumerate(sets):
        i = rows[n][0]
        if i is None:
            continue
        for m in {m for x in s for m in by[x] if m < n and rows[m][0] is not None}:
            both = len(s & sets[m])
            if 100 * both >= threshold * (len(s) + len(sets[m]) - both):
                a, b = root(i), root(rows[m][0])
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)]


def test_pigeonhole_guarantees_every_pair_within_the_radius():
    kept = M.chunk_keys()
    rng = np.random.default_rng(1)
    for _ in range(3000):
        differ = set(rng.choice(M.HASHES, M.RADIUS, replace=False).tolist())
        assert any(not differ & set(k) for k in kept)


def test_shingles():
    assert len(shingles.shingle_set(None)) == len(shingles.shingle_set(" \t\x0b\n")) == 0
    assert len(shingles.shingle_set("one two")) == 1
    assert len(shingles.shingle_set("a b c d e f")) == 2
    assert len(shingles.shingle_set("a " * 50)) == 1
    assert (shingles.shingle_set("A B c d E") == shingles.shingle_set("a\tb  C D e")).all()
    assert len(shingles.shingle_set("Ä b c d e")) == 1 and shingles.shingle_set("Ä b c d e")[0] != shingles.shingle_set("ä b c d e")[0]


def made(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "two words"), (4, "TWO  words"), (None, "two words"), (5, "x"), (5, "two words y")]
    n = 10
    for size in (5, 8, 30, 100, 400):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for copy in range(rng.randint(1, 6)):
                words = list(base)
                for _ in range(rng.randint(0, max(1, size // 25)) if copy else 0):
                    words[rng.randrange(size)] = rng.choice(vocabulary)
                rows.append((n, " ".join(words)))
                n += rng.randint(1, 3)
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(40)) + " " + passage) for i in range(80)]
    crowd = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(150):
        words = list(crowd)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((2000 + i, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_components_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = made()
    got = M.near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.component_id in (None, r.doc_id)) for r in got)


def test_query_equals_brute_force_on_a_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op6_minhash_dedup(spark, small).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
