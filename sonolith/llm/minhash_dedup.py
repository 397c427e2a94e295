"""MinHash near-duplicates by a multi-index Hamming join.

Every distinct shingle set gets a signature of ``HASHES`` b-bit MinHash values (b = 16). Two sets of
similarity J differ in a signature value with probability 1 - J, so at J = 0.75 the Hamming distance
over 52 values has mean 13 and deviation 3.1; ``RADIUS`` = 25 misses a pair at the threshold with
probability below 0.0002 and more similar pairs less. The signature is cut into 13 chunks of 4 values.
By the pigeonhole principle two signatures within RADIUS agree in some chunk up to that chunk's share
of errors (the shares plus one add up to RADIUS + 1). Allowed errors are enumerated as the positions
left out, so equal keys find *every* pair within RADIUS. Links are confirmed on the full shingle sets.

Work stays linear in a group's size where a group holds together:

1. Equal sets are one class (grouped by a digest); only class representatives go on.
2. Star rounds: in each key's group, members are compared with one pivot, never with all others.
   Confirmed links merge components.
3. What is left are groups of one key that hold several components. Their pairs across components
   are compared by signature and confirmed on the full sets inside tasks, in bounded blocks, each pair
   under one key only; a spanning forest of the links comes out, never the pairs. Pairs inside a
   component are not looked at: they can't change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, written
from .shingles import digest, mixed, shingle_set

HASHES, BITS, RADIUS, CHUNK = 52, 16, 25, 4
#: Rows of one key's group that a block holds; larger groups are compared block by block.
BLOCK = 2048
STAR_ROUNDS = 2
_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def chunk_keys(hashes: int = HASHES, radius: int = RADIUS, chunk: int = CHUNK) -> list[tuple[int, ...]]:
    """The value positions that each key keeps; pigeonhole over the chunks' allowed errors."""
    chunks = [range(i, min(i + chunk, hashes)) for i in range(0, hashes, chunk)]
    share, more = divmod(radius + 1, len(chunks))
    kept: list[tuple[int, ...]] = []
    for i, positions in enumerate(chunks):
        errors = share + (i < more) - 1
        if errors >= 0:
            kept += combinations(positions, max(0, len(positions) - errors))
    return kept


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a non-empty set, cut to 16 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        least = np.minimum(least, (values[i : i + 2048, None] * _FACTORS).min(axis=0))
    return (mixed(least) & np.uint64(0xFFFF)).astype("<u2")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = (shingle_set(x.as_py()) for x in batch.column(1))  # one text at a time
        rows = [(len(s), digest(s) if len(s) else None, signature(s).tobytes() if len(s) else None) for s in sets]
        n, keys, signatures = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "signature"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = chunk_keys()
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            values = _matrix(part.column(1)).astype(np.uint64)
            for k, positions in enumerate(kept):
                h = np.full(len(values), k + 1, np.uint64)
                for p in positions:
                    h = mixed((h << np.uint64(BITS)) ^ h ^ values[:, p])
                number = pa.array(np.full(len(h), k, np.int16))
                yield pa.record_batch([pa.array(h.view(np.int64)), number, part.column(0)], ["key", "number", "rep"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), HASHES)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = [shingle_set(x.as_py()) for x in part.column(1)]
            signatures = [signature(s).tobytes() if len(s) else None for s in sets]
            lists = pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([part.column(0), pa.array(signatures, pa.binary()), lists], ["rep", "signature", "shingles"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets, by products of 0/1 blocks."""
    ids = np.unique(np.concatenate(left))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
        known = ids[at] == values
        order = np.argsort(at[known], kind="stable")
        return at[known][order], rows[known][order]

    counts = np.zeros((len(left), len(right)), np.float32)
    sides = [(places(left), len(left)), (places(right), len(right))]
    for start in range(0, len(ids), 4096):
        blocks = []
        for (at, rows), n in sides:
            i, j = np.searchsorted(at, [start, start + 4096])
            block = np.zeros((n, 4096), np.float32)
            block[rows[i:j], at[i:j] - start] = 1
            blocks.append(block)
        counts += blocks[0] @ blocks[1].T
    return counts


def _across(threshold: int):
    """Links across components in each run of equal (key, x, y), as a forest.

    Rows come sorted by the run. A run of a split group holds the rows of the blocks x and y and compares x
    with y only (all with all where x = y). A pair that several keys bring together is confirmed under the
    first of them only, which the signatures tell.
    """
    kept = [list(k) for k in chunk_keys()]

    def run_links(run: list[tuple], x: int, y: int) -> list[tuple[int, int]]:
        number, part = run[0][3], np.array([r[4] for r in run])
        rep, comp = np.array([r[5] for r in run], np.int64), np.array([r[6] for r in run], np.int64)
        if (comp == comp[0]).all():
            return []
        values = np.frombuffer(b"".join(r[7] for r in run), "<u2").reshape(-1, HASHES)
        size = np.array([len(r[8]) for r in run])
        left, right = (np.flatnonzero(part == x), np.flatnonzero(part == y)) if x != y else (np.arange(len(run)),) * 2
        links = []
        for i in range(0, len(left), 128):
            block = left[i : i + 128]
            distance = np.zeros((len(block), len(right)), np.uint8)
            for k in range(HASHES):
                distance += values[block, k][:, None] != values[right, k][None, :]
            near = (distance <= RADIUS) & (comp[block][:, None] != comp[right][None, :])
            if x == y:
                near &= block[:, None] < right[None, :]
            p, q = np.nonzero(near)
            first = np.ones(len(p), bool)
            for positions in kept[:number]:
                same = np.ones(len(p), bool)
                for k in positions:
                    same &= values[block[p], k] == values[right[q], k]
                first &= ~same
            p, q = p[first], q[first]
            if not len(p):
                continue
            if len(p) > 2 * len(run):
                some_p, at_p = np.unique(p, return_inverse=True)
                some_q, at_q = np.unique(q, return_inverse=True)
                both = overlaps([run[j][8] for j in block[some_p]], [run[j][8] for j in right[some_q]])[at_p, at_q].astype(np.int64)
            else:
                both = np.array(
                    [len(np.intersect1d(run[block[m]][8], run[right[n]][8], assume_unique=True)) for m, n in zip(p, q, strict=True)]
                )
            linked = both * 100 >= (size[block[p]] + size[right[q]] - both) * threshold
            links += zip(rep[block[p[linked]]].tolist(), rep[right[q[linked]]].tolist(), strict=True)
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            names = ("key", "x", "y", "number", "part", "rep", "comp", "signature")
            for batch in batches:
                sets = batch.column("shingles")
                offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
                columns = [batch.column(c).to_pylist() for c in names]
                for i, row in enumerate(zip(*columns, strict=True)):
                    yield (*row, flat[offsets[i] : offsets[i + 1]].copy())

        forest = Forest()
        for (_, x, y), same in groupby(rows(), key=lambda r: r[:3]):
            for a, b in run_links(list(same), x, y):
                forest.join(a, b)
            if len(forest.parent) > 100_000:
                yield forest.flush()
        yield forest.flush()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Links have 100 * intersection >= threshold * union of the 5-word shingle sets; the signature's
    radius is set for a threshold of 75 or more. Null, empty and blank texts have no shingles and link
    with nothing, not with each other either. Rows that repeat a doc_id are one document: their links
    are joined. A null doc_id can't be named by others: its row has component_id null and is kept.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    if threshold < 75:
        raise ValueError("the signature's radius is set for thresholds of 75 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, signature binary"), "sketch")

    named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(
        named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature")), "classes"
    )
    # A row of a repeated doc_id can be the representative of several sets: a node is a doc_id.
    copies = named.select("doc_id", "set_key").join(classes.select("set_key", "rep"), "set_key").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")
    ).where("a <> b")
    reps = classes.select("rep", "signature")

    keys = reps.mapInArrow(_keys, "key long, number short, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    members = written(keys.join(shared.select("key"), "key"), "members")

    involved = members.select("rep").distinct()
    texts = docs.join(involved, docs.doc_id == involved.rep, "left_semi").select(F.col("doc_id").alias("rep"), "text")
    sets = written(texts.mapInArrow(_sets, "rep long, signature binary, shingles array<long>"), "sets")

    links, current = None, members.withColumn("comp", F.col("rep"))
    for turn in range(STAR_ROUNDS):
        pivot = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "comp", "rep"))
        pivots = current.groupBy("key").agg(pivot.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        pairs = current.join(pivots.select("key", F.col("p.comp").alias("pc"), F.col("p.rep").alias("b")), "key").where("comp <> pc")
        # Of several keys' pivots, the one that shares the most keys.
        pairs = pairs.groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("n"))
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
        new = written(_confirmed(pairs, sets, threshold), "checked").where("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        current = _labelled(members, links)

    open_keys = current.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    open_rows = current.join(open_keys.select("key", "n"), "key")
    parts = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    open_rows = open_rows.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    open_rows = open_rows.join(sets.where("signature IS NOT NULL"), "rep").select(
        "key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "number", "part", "rep", "comp", "signature", "shingles"
    ).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    last = written(open_rows.mapInArrow(_across(threshold), "a long, b long"), "across")

    every = copies.unionByName(last) if links is None else copies.unionByName(links).unionByName(last)
    named_by = written(components(every), "components")
    component = F.coalesce("component", "doc_id")
    return sketch.join(named_by, sketch.doc_id == named_by.node, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    of = components(links)
    return written(
        members.join(of, members.rep == of.node, "left").select("key", "number", "rep", F.coalesce("component", "rep").alias("comp")), "labelled"
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b, linked): whether the full shingle sets of each pair are similar enough.

    A repeated doc_id has several sets, so its pairs come several times. They are not grouped here: after
    grouping by (a, b) the planner could no longer split the pairs of one pivot over many tasks.
    """
    mine = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    found = pairs.join(mine, "a").join(other, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return found.select("a", "b", (both * 100 >= either * threshold).alias("linked"))


#: DuckDB SQL for all links that ``near_duplicates`` over ``documents`` may find (doc_id unique).
ORACLE_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
classes AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
spread AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM spread a JOIN spread b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
named AS (SELECT s, least(rep, coalesce(m, rep)) AS c FROM classes LEFT JOIN least ON a = rep)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(n.c, d.doc_id) AS component_id, coalesce(n.c, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN named n ON len(d.s) > 0 AND n.s = list_sort(d.s)
"""
