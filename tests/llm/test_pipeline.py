import re

import corpus_pipeline as P
from sonolith.llm import secrets

from .test_minhash import brute
from .test_mixing import brute_targets

COLUMNS = list(P.COLUMNS)


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["language ID", "MinHash near-dedup", "secret scan", "mixing", "packing"]

    kept = stages["language ID"](spark, docs, small)
    assert kept.columns == COLUMNS
    before, after = docs.collect(), kept.collect()
    dropped = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(dropped) <= 0.02 * len(before)

    from sonolith.llm.common import written

    kept = written(kept, "t1")
    unique = written(stages["MinHash near-dedup"](spark, kept, small), "t2")
    want = {i for i, _, c in brute([(r.doc_id, r.text) for r in after]) if i == c}
    assert {r.doc_id for r in unique.collect()} == want and unique.count() == len(want) and unique.columns == COLUMNS

    clean = written(stages["secret scan"](spark, unique, small), "t3")
    assert clean.count() == len(want) and clean.columns == COLUMNS
    assert secrets.find_secrets(clean).where("exists(secrets, s -> s.kind <> 'entropy')").count() == 0
    assert all(len(r.text) == r.n_chars for r in clean.collect() if r.text is not None)

    mixed = written(stages["mixing"](spark, clean, small), "t4")
    assert mixed.columns == COLUMNS
    sizes, taken = {}, {}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    counts = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    targets = brute_targets(sizes)
    assert max(counts.values()) <= 2
    assert abs(sum(taken.values()) - sum(targets.values())) < 0.1 * sum(targets.values())
    largest = max(words(r.text) for r in clean.collect())
    for source, target in targets.items():
        assert abs(taken.get(source, 0) - target) <= largest, source

    packed = stages["packing"](spark, mixed, small)
    assert packed.count() > 0 and "sequence_id" in packed.columns


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat and the dog " * 4, "en", "a", 80), (1, "the cat and the dog " * 4, "en", "a", 80), (None, "the dog and a cat", "en", None, 17),
            (3, None, "en", "a", 0), (4, "", None, "b", 0), (5, "der Hund und die Katze und die Maus", "de", "b", None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), stage(spark, docs, None).schema)
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= {1, None, 5} and ids
    # Columns beside those of documents, named like those that the stages make, and a very long text.
    clash = ("no", "row_no", "digest", "id", "from", "size", "copies", "copy", "secrets", "component_id", "text_2")
    long_text = " ".join(f"der hund{i} und die katze{i}" for i in range(30_000))
    docs = spark.createDataFrame([*rows, (9, long_text, "de", "b", None)], schema).selectExpr("*", *[f"'x' AS `{c}`" for c in clash])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == COLUMNS and long_text in {r.text for r in out.collect()}
    assert sum(r.length for r in P.pack(spark, docs, None).collect() if r.doc_id == 9) > 120_000
    empty = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        assert stage(spark, empty, None).collect() == []


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    near = one + " more"
    rows = [(1, one, "en"), (2, near, "en"), (2, two, "en"), (3, two, "en"), (4, three, "en"), (4, three, "de"), (4, None, "en"), (5, one, "en"),
            (6, "d " + three, "en"), (6, "only here", "en"), (None, one, "en"), (-7, "least", "en"), (-7, "other", "en")]
    docs = spark.createDataFrame([(i, t, la, "a", None) for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_dedup(spark, docs, "")
    assert got.columns == COLUMNS
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(1, one), (2, two), (4, three), (4, None), (6, "only here"), (None, one), (-7, "least"), (-7, "other")]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key)
