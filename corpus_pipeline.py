"""A training corpus from ``documents``: language ID, near-dedup, secret redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage's rows
are written as Parquet and reread as the next one's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonolith.llm import langid, minhash_dedup, mixing, packing, secrets
from sonolith.llm.common import table, word_count, written

#: A document goes if it has no letter or no language stands out: the score is the best language's share of
#: its own and the runner-up's likelihood, whatever the number of languages, and half of it is a tie.
TIE = 0.5 + 1e-6
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _classes(rows: DataFrame) -> DataFrame:
    """Rows with a number ``no``, the same for rows that share doc_id and text, ascending with doc_id."""
    rows = rows.withColumn("digest", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    known = rows.select(F.col("doc_id").alias("id"), F.col("digest").alias("of")).distinct()
    known = written(known.orderBy("id", "of").withColumn("no", F.monotonically_increasing_id()), "classes")
    return written(rows.join(known, (rows.doc_id == known.id) & (rows.digest == known.of)).select(*COLUMNS, "no"), "classed")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language that stands out."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        found = [(lang, score) for langs, scores in shared.value.predict_texts(texts) for lang, score in zip(langs, scores, strict=True)]
        return pd.Series([lang != langid.UNKNOWN and score >= TIE for lang, score in found], dtype=bool)

    return docs.select(*COLUMNS).where(accepted("text")) if model.languages else docs.select(*COLUMNS).limit(0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates; rows that repeat an id and a text are one document.

    Rows of one id with different texts are documents of their own, linked by their texts only.
    """
    rows = docs.select(*COLUMNS)
    named, unnamed = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = minhash_dedup.near_duplicates(named).where("kept").select(F.col("doc_id").alias("id"))
        return named.join(kept, named.doc_id == kept.id, "left_semi").unionByName(unnamed)
    classed = _classes(named)
    kept = minhash_dedup.near_duplicates(classed, id_col="no").where("kept").select(F.col("doc_id").alias("id")).distinct()
    some = classed.join(kept, classed.no == kept.id, "left_semi")
    order = Window.partitionBy("no").orderBy(F.xxhash64("lang", "source"), "n_chars")
    first = some.withColumn("row_no", F.row_number().over(order)).where("row_no = 1").select(*COLUMNS)
    return first.unionByName(unnamed)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark."""
    found = secrets.find_secrets(docs.select(*COLUMNS))
    clean = secrets.redacted(F.col("text"), F.col("secrets"))
    return found.withColumn("text", clean).withColumn(
        "n_chars", F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source has its share of the words."""
    # The mix knows rows by id, source and size; rows alike in these are told apart by a number.
    alike = Window.partitionBy("id", "from", "size")
    mixed = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("from"), "size", "copies")
    mixed = mixed.withColumn("no", F.row_number().over(alike.orderBy(F.desc("copies"))))
    rows = docs.select(*COLUMNS, F.col("doc_id").alias("id"), F.col("source").alias("from"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("row_no", F.row_number().over(alike.orderBy(F.xxhash64("text", "lang"), "n_chars")))
    same = [rows[c].eqNullSafe(mixed[c]) for c in ("id", "from", "size")]
    picked = rows.join(mixed, same[0] & same[1] & same[2] & (rows.row_no == mixed.no))
    return picked.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of whole powers of two, one document each."""
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mixture),
    ("packing", pack),
]

#: The operators' methods are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
