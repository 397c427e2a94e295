"""Intervals of series: fixed, merged and event segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_segments(df: DataFrame, series: str, duration: str, length: float = 5.0) -> DataFrame:
    """(series_id, seg_no, start_sec, end_sec): [k L, min((k+1) L, T)) while k L < T; numbers from 1."""
    t, step = F.col(duration).cast("double"), F.lit(float(length))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(t / step).cast("long") - 1))
    out = df.where(t > 0).select(F.col(series).alias("series_id"), t.alias("_t"), k.alias("_k"))
    return out.select(
        "series_id", (F.col("_k") + 1).alias("seg_no"), (F.col("_k") * step).alias("start_sec"),
        F.least((F.col("_k") + 1) * step, F.col("_t")).alias("end_sec"),
    )


def long_enough(segments: DataFrame, least: float) -> DataFrame:
    return segments.where(F.col("end_sec") - F.col("start_sec") >= F.lit(float(least)))


def merged_segments(segments: DataFrame, gap: float = 0.5) -> DataFrame:
    """Intervals of a series merged where one starts at most ``gap`` after the furthest end so far."""
    order = Window.partitionBy("series_id").orderBy("start_sec", "end_sec")
    before = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start_sec") - before > F.lit(float(gap))), 1).otherwise(0)
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = segments.withColumn("_fresh", fresh).withColumn("_island", island)
    out = out.groupBy("series_id", "_island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))
    return out.select("series_id", F.col("_island").cast("long").alias("seg_no"), "start_sec", "end_sec")


def or_whole(segments: DataFrame, clips: DataFrame, duration: str) -> DataFrame:
    """Series without a segment get their whole clip as one."""
    whole = clips.join(segments.select("series_id").distinct(), "series_id", "left_anti").select(
        "series_id", F.lit(1).cast("long").alias("seg_no"), F.lit(0.0).alias("start_sec"), F.col(duration).cast("double").alias("end_sec")
    )
    return segments.unionByName(whole)


def active_frames(frames: DataFrame, weight: float = 0.5, tail: float = 0.1) -> DataFrame:
    """Frames whose energy passes (1 - weight) * mean of the lowest tenth + weight * mean of the highest.

    ``frames`` has (series_id, frame, energy).
    """
    order = Window.partitionBy("series_id").orderBy("energy", "frame")
    n = F.count("*").over(Window.partitionBy("series_id"))
    ranked = frames.withColumn("_r", F.row_number().over(order)).withColumn("_k", F.greatest(F.floor(n * F.lit(tail)), F.lit(1))).withColumn("_n", n)
    low = F.avg(F.when(F.col("_r") <= F.col("_k"), F.col("energy")))
    high = F.avg(F.when(F.col("_r") > F.col("_n") - F.col("_k"), F.col("energy")))
    level = ranked.groupBy("series_id").agg(((1 - weight) * low + weight * high).alias("level"))
    return frames.join(level, "series_id").where("energy >= level")


def frames_to_segments(active: DataFrame, step: float, window: float) -> DataFrame:
    """Runs of neighbouring frames as intervals in seconds."""
    order = Window.partitionBy("series_id").orderBy("frame")
    run = F.col("frame") - F.row_number().over(order)
    out = active.withColumn("_run", run).groupBy("series_id", "_run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return out.select("series_id", (F.col("a") * F.lit(step)).alias("start_sec"), (F.col("b") * F.lit(step) + F.lit(window)).alias("end_sec"))


def fewest(candidates: DataFrame, params: list[str], order: str) -> DataFrame:
    """Of each series' parameter sets the one with the fewest segments, the first in order on a tie."""
    return candidates.groupBy("series_id").agg(F.min(F.struct(F.col("n"), F.col(order), *params)).alias("_b")).select(
        "series_id", F.col("_b.n").alias("n"), *[F.col(f"_b.{p}").alias(p) for p in params]
    )


def sliced(segments: DataFrame, long: DataFrame, rate: float) -> DataFrame:
    """Samples of each segment: idx from int(start * rate), below int(end * rate)."""
    s = segments.withColumns({"_a": (F.col("start_sec") * rate).cast("long"), "_b": (F.col("end_sec") * rate).cast("long")})
    s = s.withColumn("idx", F.explode(F.when(F.col("_b") > F.col("_a"), F.sequence("_a", F.col("_b") - 1)).otherwise(F.array().cast("array<bigint>"))))
    return s.drop("_a", "_b").join(long, ["series_id", "idx"])


def named(segments: DataFrame) -> DataFrame:
    return segments.withColumn("name", F.format_string("%s_%03d", F.col("series_id").cast("string"), F.col("seg_no")))
