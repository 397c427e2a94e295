"""CSV and Parquet tables, and idempotent appends of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import RESULT_KEY, appended, merged_results


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_results(new: DataFrame, path: str, key=RESULT_KEY) -> int:
    """Appends the rows whose key ``path`` doesn't have yet; returns how many that were."""
    spark = new.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        new.limit(0).write.parquet(path)
    seen = Observation()
    fresh = appended(spark.read.schema(new.schema).parquet(path), new.dropDuplicates(list(key)), key)
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def save_results(new: DataFrame, path: str, key=RESULT_KEY, order: str | None = None) -> int:
    """Merges ``new`` into the table at ``path``, sorted by key; what is there wins. Returns the rows added."""
    spark = new.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = spark.read.parquet(path) if files.exists(at) else new.limit(0)
    seen, before = Observation(), old.count()
    merged = merged_results(old, new, key, order or key[0]).observe(seen, F.count(F.lit(1)).alias("n"))
    # The old table is read while the new one is written, so the new one gets a place of its own first.
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.next")
    merged.write.mode("overwrite").parquet(f"{path}.next")
    files.delete(at, True)
    files.rename(beside, at)
    return seen.get["n"] - before


def cleared(spark: SparkSession, folder: str, keep: tuple[str, ...] = (), retries: int = 5) -> list[str]:
    """Deletes what ``folder`` holds but the names in ``keep``, trying again after a failure; returns what stays."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    left: list[str] = []
    for _ in range(retries):
        there = [f.getPath() for f in files.listStatus(at)] if files.exists(at) else []
        left = [p.getName() for p in there if p.getName() not in keep and not files.delete(p, True)]
        if not left:
            break
    return left
