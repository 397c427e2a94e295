"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash. A bucket whose bytes pass the limit
splits on the next bit, alone; all others stay. The splits of BITS levels are found at once from the byte
totals of cells (map-side sums by hash prefix): a cell's shard is its shortest prefix whose total fits.
Only cells that still don't fit go to the next round, so the rounds grow with the logarithm of the input.
The hash has 60 bits of the id, then 60 of the text: rows that repeat an id can be split too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LIMIT, BITS, WIDTH = 16 << 20, 10, 120


def hash_bits(doc_id: Column, text: Column) -> Column:
    """120 bits as a string of 0 and 1, from md5 of the id's text and of the text (null: empty)."""

    def half(value: Column) -> Column:
        digits = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15)
        return F.lpad(F.conv(digits, 16, 2), 60, "0")

    return F.concat(half(doc_id), half(text))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, fits) for each row of ``docs``; ``shard`` is the hash prefix.

    ``n_bytes`` is the text's UTF-8 size, 0 for null and empty. A shard's bytes are at most ``limit``; ``fits``
    is false only for a shard that can't be split: one document larger than the limit, or rows that
    repeat one id and text. A null id hashes like an empty one. Other columns are ignored; an empty table
    gives an empty result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        hash_bits(F.col(id_col), text).alias("bits"),
    )
    rows = written(rows, "hashed")
    open_rows, done = rows, []
    for depth in range(BITS, WIDTH + 1, BITS):
        first = 0 if depth == BITS else depth - BITS + 1
        cells = open_rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(depth)))).withColumn("shard", F.expr("left(cell, depth)"))
        sums = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        sums = sums.withColumn("fits", F.col("bytes") <= limit).where((F.col("fits")) | (F.col("n") == 1) | (F.col("depth") == WIDTH))
        best = levels.select("cell", "depth", "shard").join(sums.select("depth", "shard", "fits"), ["depth", "shard"])
        best = best.groupBy("cell").agg(F.min(F.struct("depth", "shard", "fits")).alias("to"))
        best = written(cells.select("cell").join(best, "cell", "left").select("cell", "to.depth", "to.shard", "to.fits"), "cells")
        placed = open_rows.withColumn("cell", F.substring("bits", 1, depth)).join(best, "cell")
        done.append(placed.where("shard IS NOT NULL"))
        if best.where("shard IS NULL").isEmpty():
            break
        open_rows = placed.where("shard IS NULL").select("doc_id", "n_bytes", "bits")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select("doc_id", "n_bytes", "shard", "depth", "fits")


def directory(sharded: DataFrame) -> DataFrame:
    """(shard, depth, n_bytes, n_docs, fits): the directory's buckets."""
    return sharded.groupBy("shard", "depth").agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"), F.min("fits").alias("fits")
    )


#: DuckDB SQL for ``shards`` over ``documents``.
ORACLE_SQL = f"""
WITH hashed AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0')
         || lpad(bin(('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
levels AS (SELECT d AS depth, left(bits, d) AS shard, sum(n_bytes) AS bytes, count(*) AS n
           FROM hashed, range(0, {WIDTH + 1}) t(d) GROUP BY ALL),
fitting AS (SELECT depth, shard, bytes <= {LIMIT} AS fits FROM levels WHERE bytes <= {LIMIT} OR n = 1 OR depth = {WIDTH}),
best AS (SELECT h.bits, min(f.depth) AS depth FROM (SELECT DISTINCT bits FROM hashed) h
         JOIN fitting f ON f.shard = left(h.bits, f.depth) GROUP BY h.bits)
SELECT h.doc_id, h.n_bytes::BIGINT AS n_bytes, f.shard, f.depth::INT AS depth, f.fits
FROM hashed h JOIN best b ON b.bits = h.bits JOIN fitting f ON f.depth = b.depth AND f.shard = left(h.bits, b.depth)
"""
