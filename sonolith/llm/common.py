"""What the operators of this subpackage share: the shared folder, written tables and components."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator that counts or shingles words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session that runs inside one process (tests) gets a temporary folder;
    on a cluster it is an error, since executors would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sonolith-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage for good: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    ``edges`` has two long columns. Returns (node, component), component the smallest node
    reachable, one row per node that has an edge to another node. Every round is two aggregations
    with map-side combining and two joins, and the number of rounds grows with the logarithm of the
    longest path. The least neighbours are written before they are joined: so both sides of a join come
    straight from an exchange, and the planner splits the edges of a hub over many tasks.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    state = _fingerprint(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(up.distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = written(small, "edges")
        before, state = state, _fingerprint(now)
        if before == state:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
    return tuple(row)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


class Forest:
    """Union-find inside a task; what leaves it is an edge for each node, to the smallest of its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.parent.setdefault(x, x)
        while up != x:
            self.parent[x] = self.parent[up]
            x, up = up, self.parent[up]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def flush(self) -> pa.RecordBatch:
        """(a, b) edges; the forest starts anew."""
        edges = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        self.parent = {}
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
