"""Exact top-k by inner product: a KD-tree per shard, searched best bound first.

Vectors are routed to cells by a few median splits that a bounded sample gives, and a cell is dealt to as
many shards as its rows need, so a vector that fills a third of the table fills many shards. A shard's tree
is built once, by median splits of the widest dimension with tight boxes, and written. A query first
searches the shard it lies in. The k-th score found there is propagated: only cells whose box allows that score
get the query, and there it visits the nodes in the order of the largest inner product that their boxes
allow, until that falls below the k-th best score known. A task holds one tree and one block of queries;
a tree is copied once for each block of ``QUERIES`` queries that reach it.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import complete, matrix, rows_of

#: Rows of a shard, rows of a leaf, queries of a block: memory bounds of a task.
SHARD, LEAF, QUERIES = 8192, 128, 1 << 15
#: Bounds of the routing, which changes no result: lengths of vectors that get cells, numbers in a length's
#: sample, numbers in the boxes of its cells. Vectors of other lengths have one cell each.
WIDTHS, SAMPLE, BOXES = 4, 1 << 20, 1 << 15
#: Products of integers below this are exact in doubles; scores beyond are summed as Python integers.
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1
_KEYS = ["width", "large", "cell", "sub"]


def integers(vector, scale: float) -> list[int]:
    """floor(scale * x) of each component, whatever its size."""
    return [math.floor(Fraction(scale) * Fraction(float(x))) for x in vector]


def _scaled(v: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(v * scale)


def _reach(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each box allows; a little more where doubles may round."""
    with np.errstate(over="ignore", invalid="ignore"):
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bound = up @ high.T + down @ low.T
        size = np.abs(query) @ np.maximum(np.abs(low), np.abs(high)).T
        bound = np.where(size < _EXACT, bound, bound + size * 1e-9)
    return np.where(np.isnan(bound), np.inf, bound)


class Tree:
    """KD-tree over the rows of ``data``; ``nos`` are the rows' numbers, ``ids`` their names."""

    def __init__(self, data: np.ndarray, nos: np.ndarray, ids: np.ndarray, scale: float, leaf: int = LEAF):
        points, order = _scaled(data, scale), np.arange(len(data))
        self.scale = scale
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        low, high = [], []
        todo = [(0, len(data), -1)]
        while todo:
            start, stop, parent = todo.pop()
            node = len(self.spans)
            rows = points[order[start:stop]]
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            low.append(lo)
            high.append(hi)
            self.spans.append((start, stop))
            self.children.append(None)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            with np.errstate(over="ignore", invalid="ignore"):
                spread = np.where(hi > lo, hi - lo, 0.0)
            widest = int(spread.argmax())
            if stop - start > leaf and spread[widest] > 0:
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(rows[:, widest], middle)]
                todo += [(start + middle, stop, node), (start, start + middle, node)]
        self.points, self.raw = points[order], data[order]
        self.nos, self.ids = nos[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)
        largest = max(1.0, float(np.abs(points).max(initial=0)))
        self.exact_below = _EXACT / (largest * max(1, data.shape[1])) if math.isfinite(largest) else 0.0
        if self.exact_below > largest:
            self.raw = None  # integers come from ``points``

    def _scores(self, start: int, stop: int, query: np.ndarray, whole: list[int] | None):
        if whole is None:
            return self.points[start:stop] @ query
        if self.raw is None:
            rows = ([int(x) for x in row] for row in self.points[start:stop])
        else:
            rows = (integers(row, self.scale) for row in self.raw[start:stop])
        return np.array([sum(a * b for a, b in zip(row, whole, strict=True)) for row in rows], object)

    def search(self, asked: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[list, np.ndarray]]:
        """(scores, ids) of each query's k best rows that score ``least`` or more, without the row ``own``."""
        points = _scaled(asked, self.scale)
        for first in range(0, len(points), 512):
            bounds = _reach(points[first : first + 512], self.low, self.high)
            for q, bound in enumerate(bounds, first):
                query, floor = points[q], least[q]
                whole = None if np.abs(query).max(initial=0) < self.exact_below else integers(asked[q], self.scale)
                scores, ids = np.empty(0, float if whole is None else object), np.empty(0, np.int64)
                heap = [(-bound[0], 0)]
                while heap:
                    negative, node = heapq.heappop(heap)
                    if -negative < floor:
                        break
                    if self.children[node]:
                        for child in self.children[node]:
                            if bound[child] >= floor:
                                heapq.heappush(heap, (-bound[child], child))
                        continue
                    start, stop = self.spans[node]
                    found = self._scores(start, stop, query, whole)
                    near = np.flatnonzero(found >= floor)
                    near = near[self.nos[near + start] != own[q]]
                    if len(near):
                        scores, ids = np.concatenate([scores, found[near]]), np.concatenate([ids, self.ids[near + start]])
                        if len(ids) > k:
                            best = np.lexsort((ids, -scores))[:k] if whole is None else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
                            scores, ids = scores[best], ids[best]
                        if len(ids) == k:
                            floor = max(floor, scores.min())
                yield [int(s) for s in scores], ids


def _beyond(score: int) -> str:
    """Orders scores that a long can't hold, by size; empty for the others."""
    if abs(score) <= _MOST:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _built(scale: float, leaf: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no")
        tree = Tree(np.array(rows["v"].tolist(), float), rows["row_no"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), scale, leaf)
        return pd.DataFrame([(*key, pickle.dumps(tree, protocol=5), tree.low[0].tolist(), tree.high[0].tolist())], columns=[*_KEYS, "tree", "low", "high"])

    return run


def _searched(k: int):
    schema = {"query_no": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64", "beyond": "object"}

    def run(key: tuple, trees: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(block):
            return pd.DataFrame({n: [] for n in schema}).astype(schema)
        tree = pickle.loads(trees["tree"].iloc[0])
        asked = np.array(block["v"].tolist(), float)
        found = list(tree.search(asked, block["row_no"].to_numpy(np.int64), k, block["least"].to_numpy(float)))
        n, scores = [len(ids) for _, ids in found], [s for part, _ in found for s in part]
        return pd.DataFrame(
            {
                "query_no": np.repeat(block["row_no"].to_numpy(np.int64), n),
                "query_id": np.repeat(block["vec_id"].to_numpy(np.int64), n),
                "vec_id": np.concatenate([ids for _, ids in found]),
                "score": np.array([max(-_MOST, min(_MOST, s)) for s in scores], np.int64),
                "beyond": pd.Series([_beyond(s) for s in scores], dtype=object),
            }
        )

    return run


def splits(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, value) of a balanced tree of medians, in heap order; rows below the value go left."""
    out, parts = [], [sample]
    for _ in range(depth):
        below = []
        for rows in parts:
            if len(rows):
                with np.errstate(over="ignore", invalid="ignore"):
                    spread = np.nan_to_num(rows.max(axis=0) - rows.min(axis=0))
                dim = int(spread.argmax())
                value = float(np.sort(rows[:, dim])[len(rows) // 2])
            else:
                dim, value = 0, 0.0
            out.append((dim, value))
            left = rows[:, dim] < value
            below += [rows[left], rows[~left]]
        parts = below
    return out


def route(rows: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each row."""
    at = np.zeros(len(rows), np.int64)
    for _ in range((len(tree) + 1).bit_length() - 1):
        dims, values = np.array([d for d, _ in tree])[at], np.array([v for _, v in tree])[at]
        at = 2 * at + 1 + (rows[np.arange(len(rows)), dims] >= values)
    return at - len(tree)


def _routed(trees: dict[int, list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy(zero_copy_only=False)
            cell = np.zeros(batch.num_rows, np.int32)
            for width, tree in trees.items():
                here = widths == width
                if here.any():
                    cell[here] = route(matrix(batch.column("v").filter(pa.array(here))), tree)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    return run


def _reached(boxes: dict[int, tuple[list, np.ndarray, np.ndarray]], scale: float):
    """The cells that can still hold one of a query's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                widths, least = batch.column("width").to_numpy(zero_copy_only=False), batch.column("least").to_numpy(zero_copy_only=False)
                cells = np.full(batch.num_rows, None, object)
                for width in np.unique(widths):
                    here = np.flatnonzero(widths == width)
                    if width not in boxes:
                        known, reach = [(False, 0), (True, 0)], np.full((len(here), 2), np.inf)
                    else:
                        known, low, high = boxes[width]
                        reach = _reach(_scaled(matrix(batch.column("v").take(pa.array(here))), scale), low, high)
                    for i, bound in zip(here, reach, strict=True):
                        cells[i] = [{"large": known[c][0], "cell": known[c][1]} for c in np.flatnonzero(bound >= least[i])]
                yield batch.append_column("cells", pa.array(list(cells), pa.list_(pa.struct([("large", pa.bool_()), ("cell", pa.int32())]))))

    return run


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 64.0, shard: int = SHARD, leaf: int = LEAF, queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row whose id is divisible by ``every``.

    A component x counts as floor(scale * x); scores are exact integer inner products, ties go to the
    smaller vec_id. Vectors that are null, empty or hold null or non-finite components take no part; nor do
    rows with a null vec_id, which can't be named. Vectors are compared with vectors of their own length
    only. Rows that repeat a vec_id are rows of their own: each is a candidate, each a query if the id is
    divisible, and only the query's own row is left out. A score beyond a long is shown as the largest (or
    least) long; the ranks follow the true score. Fewer than k rows are all returned; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = rows_of(vectors, id_col, vector_col).where("vec_id IS NOT NULL").where(complete(F.col("v")))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x))) * F.lit(scale) + 1
    rows = rows.withColumn("width", F.size("v")).withColumn("large", largest * largest * F.col("width") >= F.lit(_EXACT))
    spark = vectors.sparkSession
    trees: dict[int, list] = {}
    for r in rows.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") > shard).orderBy(F.desc("n"), "width").limit(WIDTHS).collect():
        depth = min(int(math.log2(r.n / shard)) + 1, int(math.log2(max(1, BOXES // r.width))))
        most = max(1, SAMPLE // r.width)
        share = F.lit(min(1.0, most / r.n) * (1 << 30))
        drawn = rows.where((F.col("width") == r.width) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share)).select("v").limit(2 * most)
        trees[r.width] = splits(matrix(drawn.toArrow().column("v"), r.width), depth)

    rows = rows.withColumn("row_no", F.monotonically_increasing_id())
    rows = rows.mapInArrow(_routed(trees), "vec_id long, v array<double>, width int, large boolean, row_no long, cell int")
    rows = written(rows, "vectors")
    sizes = rows.groupBy("width", "large", "cell").agg(F.ceil(F.count("*") / F.lit(float(shard))).cast("int").alias("subs"))
    sizes = written(sizes, "cell_sizes")
    dealt = rows.join(sizes, ["width", "large", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row_no"), F.col("subs")).cast("int")).drop("subs")
    forest = written(
        dealt.groupBy(*_KEYS).applyInPandas(_built(scale, leaf), "width int, large boolean, cell int, sub int, tree binary, low array<double>, high array<double>"), "trees"
    )

    def searched(asked: DataFrame) -> DataFrame:
        asked = written(asked, "asked")
        blocks = asked.groupBy(*_KEYS).agg(F.ceil(F.count("*") / F.lit(float(queries))).cast("int").alias("blocks"))
        blocks = written(blocks, "blocks")
        sent = asked.join(blocks, _KEYS).withColumn("block", F.pmod(F.xxhash64("row_no"), F.col("blocks")).cast("int")).drop("blocks")
        held = forest.select(*_KEYS, "tree").join(blocks, _KEYS).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        by = [*_KEYS, "block"]
        return written(
            held.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(_searched(k), "query_no long, query_id long, vec_id long, score long, beyond string"), "found"
        )

    nothing = F.lit(-float("inf"))
    first = searched(dealt.where(F.col("vec_id") % every == 0).withColumn("least", nothing))
    score = F.min("score").cast("double")
    # A long beyond 2 ** 53 may round up as a double; the least long may stand for less.
    score = F.when(F.min("score") == -_MOST, nothing).when(F.abs(score) >= _EXACT, score - F.abs(score) * 1e-9).otherwise(score)
    kth = first.groupBy(F.col("query_no").alias("row_no")).agg(F.when(F.count("*") >= k, score).alias("least"))
    asked = dealt.where(F.col("vec_id") % every == 0).join(kth, "row_no", "left").withColumn("least", F.coalesce("least", nothing))
    asked = asked.select("row_no", "vec_id", "v", "width", F.struct(*_KEYS).alias("home"), "least")

    sides: dict[int, tuple[list, list, list]] = {}
    if trees:
        corner = F.posexplode(F.arrays_zip("low", "high")).alias("at", "side")
        corners = forest.where(F.col("width").isin(list(trees))).select("width", "large", "cell", corner)
        corners = corners.groupBy("width", "large", "cell", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
        corners = corners.groupBy("width", "large", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box"))
        for r in corners.collect():
            known, low, high = sides.setdefault(r.width, ([], [], []))
            known.append((r.large, r.cell))
            low.append([side.low for side in r.box])
            high.append([side.high for side in r.box])
    boxes = {w: (known, np.array(low), np.array(high)) for w, (known, low, high) in sides.items()}
    home = "home struct<width:int,large:boolean,cell:int,sub:int>"
    cells = asked.mapInArrow(
        _reached(boxes, scale), f"row_no long, vec_id long, v array<double>, width int, {home}, least double, cells array<struct<large:boolean,cell:int>>"
    )
    others = cells.withColumn("to", F.explode("cells")).select("row_no", "vec_id", "v", "width", "home", "least", "to.large", "to.cell")
    others = others.join(sizes, ["width", "large", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    others = others.where(F.struct(*_KEYS) != F.col("home")).select("row_no", "vec_id", "v", *_KEYS, "least")
    found = first.unionByName(searched(others))
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for ``top_k`` over ``embeddings`` with its defaults.
ORACLE_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, len(embedding) AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.n = c.n AND q.row_no <> c.row_no WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
