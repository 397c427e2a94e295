"""Near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and names the
largest coordinate with its sign. A table joins HASHES such names into a bucket. A vector is stored in
its home bucket of every table and asks PROBES more buckets a table, in the order in which the runner-up
coordinates come close. Candidate pairs are verified by cosine in double precision.

Equal vectors are one class. In a bucket, pairs are compared block by block inside tasks and never
leave them: a task returns each vector's number of links and a spanning forest. A pair that meets in
several buckets counts in the first one only, which both vectors' names tell; they are made once and
travel with the vector. A task works on flat arrays of many buckets at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, written
from .shingles import mixed
from .vectors import complete, matrix, rows_of

TABLES, HASHES, PROBES = 10, 3, 6
#: Rows of one bucket that a block holds; larger buckets are compared block by block.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(unit: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + PROBES) bucket names; the first is the home bucket."""
    rows, width = unit.shape
    size = max(2, 1 << (width - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :width] = unit
    out = np.empty((rows, TABLES, 1 + PROBES), np.int64)
    line = np.arange(rows)
    for t in range(TABLES):
        names, losses = [], []
        for h in range(HASHES):
            x = padded
            for r in range(3):
                bits = mixed((np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(2 * (((t * HASHES + h) * 3 + r)) + 1))
                x = hadamard(x * np.where(bits & np.uint64(1), 1.0, -1.0)) / np.sqrt(size)
            # Names 0..size-1 stand for positive, the rest for negative coordinates.
            both = np.concatenate([x, -x], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, : PROBES + 1]
            names.append(best)
            losses.append(both[line, best[:, 0]][:, None] - both[line[:, None], best])
        # Probes: one hash takes a runner-up, the others stay; least loss first.
        total = np.concatenate([loss[:, 1:] for loss in losses], axis=1)
        chosen = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
        for p in range(1 + PROBES):
            name = np.full(rows, t + 1, np.uint64)
            for h in range(HASHES):
                at = np.zeros(rows, np.int64)
                if p:
                    width_h = names[h].shape[1] - 1
                    pick = chosen[:, min(p, chosen.shape[1]) - 1]
                    at = np.where(pick // width_h == h, pick % width_h + 1, 0)
                name = mixed(name * np.uint64(2 * size + 1) + names[h][line, at].astype(np.uint64))
            out[:, t, p] = name.view(np.int64)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, copies, v, names): bucket names of vectors, each table's home bucket first."""
    for batch in batches:
        widths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            for start in range(0, part.num_rows, 1024):
                some = part.slice(start, 1024)
                names = (buckets(_unit(matrix(some.column("v")))) ^ int(width)).reshape(some.num_rows, -1)
                yield some.append_column("names", pa.FixedSizeListArray.from_arrays(pa.array(names.reshape(-1)), names.shape[1]).cast(pa.list_(pa.int64())))


def _asked(hashed: DataFrame) -> DataFrame:
    """(rep, bucket, home), a row for each distinct bucket that a vector is stored in or asks."""
    homes = F.filter("names", lambda _, i: i % (1 + PROBES) == 0)
    with_homes = hashed.select("rep", "names", homes.alias("homes"))
    every = F.transform(F.array_distinct("names"), lambda n: F.struct(n.alias("bucket"), F.array_contains("homes", n).alias("home")))
    return with_homes.select("rep", F.explode(every).alias("b")).select("rep", "b.bucket", "b.home")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each run, the runs given by start and size, some 100,000 at a time."""
    rows = _ranges(starts, sizes)
    later = np.repeat(starts + sizes, sizes) - rows - 1
    cuts = np.searchsorted(np.cumsum(later), np.arange(100_000, later.sum() + 100_000, 100_000), side="left") + 1
    for i, j in itertools.pairwise([0, *dict.fromkeys(cuts.tolist())]):
        yield np.repeat(rows[i:j], later[i:j]), _ranges(rows[i:j] + 1, later[i:j])


class _Run:
    """Columns of rows that hold whole (bucket, x, y) runs."""

    def __init__(self, table: pa.Table):
        flat = {c: table.column(c).to_numpy() for c in ("bucket", "x", "y", "part", "rep", "copies", "home")}
        self.bucket, self.x, self.y, self.part, self.rep, self.copies, self.home = flat.values()
        self.names = matrix(table.column("names"), TABLES * (1 + PROBES), np.int64).reshape(len(self.rep), TABLES, 1 + PROBES)
        widths = table.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        # Runs hold one width, or by a clash of 64-bit names several; the zeros behind a shorter one add nothing.
        self.width = widths
        self.unit = np.zeros((len(widths), widths.max(initial=1)))
        for width in np.unique(widths):
            here = np.flatnonzero(widths == width)
            self.unit[here, :width] = _unit(matrix(table.column("v").take(pa.array(here))))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs to verify: those of small runs one by one, of large ones if a block product comes near."""
        edge = np.flatnonzero((np.diff(self.bucket) != 0) | (np.diff(self.x) != 0) | (np.diff(self.y) != 0)) + 1
        starts = np.concatenate([[0], edge]).astype(np.int64)
        sizes = np.diff(np.append(starts, len(self.bucket)))
        small = sizes <= 64
        yield from _pairs(starts[small], sizes[small])
        for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            for i in range(start, start + size, 256):
                j = min(i + 256, start + size)
                p, q = np.nonzero(self.unit[i:j] @ self.unit[i : start + size].T >= self.least - 1e-9)
                yield p[p < q] + i, q[p < q] + i

    def links(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows with a cosine of ``least`` or more, under the first bucket where they meet only."""
        self.least = least
        for a, b in self.candidates():
            for i in range(0, len(a), 20_000):
                p, q = a[i : i + 20_000], b[i : i + 20_000]
                some = (self.home[p] | self.home[q]) & ((self.x[p] == self.y[p]) | (self.part[p] != self.part[q])) & (self.width[p] == self.width[q])
                p, q = p[some], q[some]
                p, q = np.where(self.rep[p] < self.rep[q], p, q), np.where(self.rep[p] < self.rep[q], q, p)
                near = np.einsum("ij,ij->i", self.unit[p], self.unit[q]) >= least
                p, q = p[near], q[near]
                at_p = (self.names[p][:, :, :1] == self.names[q]).any(axis=2)
                at_q = (self.names[q][:, :, :1] == self.names[p]).any(axis=2)
                table, line = (at_p | at_q).argmax(axis=1), np.arange(len(p))
                first = np.where(at_p[line, table], self.names[p, table, 0], self.names[q, table, 0]) == self.bucket[p]
                yield p[first], q[first]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels of the rows after joining the pairs (a, b)."""
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _linked(least: float):
    """(a, null, links): other vectors linked with a; (a, b, 0): edges of a spanning forest."""

    def counted(table: pa.Table, forest: Forest) -> pa.RecordBatch:
        run = _Run(table)
        links, label = np.zeros(len(run.rep)), np.arange(len(run.rep))
        for p, q in run.links(least):
            links += np.bincount(p, run.copies[q], len(links)) + np.bincount(q, run.copies[p], len(links))
            label = _joined(label, p, q)
        for i in np.flatnonzero(label != np.arange(len(label))):
            forest.join(int(run.rep[i]), int(run.rep[label[i]]))
        some = np.flatnonzero(links)
        return pa.record_batch([pa.array(run.rep[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("bucket", "x", "y")]
            change = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys]))
            if len(change):  # the last run may go on in the next batch
                yield counted(held.slice(0, int(change[-1]) + 1), forest)
                held = held.slice(int(change[-1]) + 1)
            if len(forest.parent) > 200_000:
                yield _with_links(forest.flush())
        if held is not None and held.num_rows:
            yield counted(held, forest)
        yield _with_links(forest.flush())

    return run


def _with_links(edges: pa.RecordBatch) -> pa.RecordBatch:
    return edges.append_column("links", pa.array([0] * edges.num_rows, pa.int64()))


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``.

    Links have a cosine of ``least`` or more; equal vectors link. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing; only vectors of one length are compared. A row that
    repeats a vec_id is one more vector of that name: its links count on every row of the name. A null
    vec_id can't be named: no links, component_id null, kept. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = rows_of(vectors, id_col, vector_col)
    good = complete(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    used = rows.where(good).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = written(used.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = used.join(classes.select("v", "rep", "copies"), "v").select("vec_id", "rep", "copies")
    members = written(members, "vector_members")

    hashed = classes.mapInArrow(_hashed, "v array<double>, rep long, copies long, names array<long>")
    hashed = written(hashed, "hashed")
    shared = _asked(hashed).groupBy("bucket").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 AND any").select("bucket", "n")
    # Blocks of an eighth of a group, but not of fewer than block / 8 or of more than block rows.
    parts = F.greatest(F.least(F.ceil(F.col("n") * 8 / F.lit(float(block))), F.lit(8)), F.ceil(F.col("n") / F.lit(float(block)))).cast("int")
    met = _asked(hashed).join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).join(hashed, "rep")
    met = met.select(
        "bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rep", "copies", "home", "v", "names"
    ).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    found = written(met.mapInArrow(_linked(least), "a long, b long, links long"), "links")

    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    edges = found.where("b IS NOT NULL").select("a", "b").unionByName(members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    of = components(edges)
    counted = members.join(links, "rep", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    named = rows.select("vec_id").join(counted, "vec_id", "left").join(of, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return named.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


#: DuckDB SQL for all links that ``near_duplicates`` over ``embeddings`` may find (vec_id unique).
ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(l.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
