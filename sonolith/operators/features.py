"""Feature tables in long form (id, feature, value): filling, scaling, selecting, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import ratio


def by_feature() -> WindowSpec:
    return Window.partitionBy("feature")


def imputed(long: DataFrame, train: Column = None) -> DataFrame:
    """Null and NaN values replaced by the feature's mean over the training rows."""
    value = F.when(~F.isnan("value"), F.col("value"))
    rows = long.withColumn("value", value)
    fit = rows.where(train) if train is not None else rows
    means = fit.groupBy("feature").agg(F.avg("value").alias("_mean"))
    return rows.join(means, "feature", "left").withColumn("value", F.coalesce("value", "_mean")).drop("_mean")


def scaled(long: DataFrame, train: Column = None) -> DataFrame:
    """(value - mean) / population deviation of the training rows; a deviation of 0 counts as 1."""
    fit = long.where(train) if train is not None else long
    known = fit.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    out = long.join(known, "feature")
    by = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return out.withColumn("value", (F.col("value") - F.col("_m")) / by).drop("_m", "_s")


def anova(long: DataFrame, label: str = "label") -> DataFrame:
    """(feature, f): between-class over within-class mean squares."""
    cells = long.groupBy("feature", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("ss"))
    out = cells.withColumn("all_n", F.sum("n").over(by_feature())).withColumn("mean", F.sum(F.col("n") * F.col("m")).over(by_feature()) / F.sum("n").over(by_feature()))
    out = out.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"), F.sum("ss").alias("within"),
        F.count("*").alias("k"), F.max("all_n").alias("n"),
    )
    f = F.try_divide(F.col("between") / F.when(F.col("k") > 1, F.col("k") - 1), F.col("within") / F.when(F.col("n") > F.col("k"), F.col("n") - F.col("k")))
    return out.select("feature", f.alias("f"))


def mutual_information(long: DataFrame, label: str = "label", bins: int = 10) -> DataFrame:
    """(feature, mi) in nats between equal-width bins of a feature and the label."""
    ends = long.groupBy(F.col("feature").alias("_f")).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))  # a row a feature
    binned = long.join(ends, F.col("feature").eqNullSafe(F.col("_f"))).withColumn(
        "bin", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    )
    cells = binned.groupBy("feature", "bin", label).agg(F.count("*").alias("n"))
    cells = cells.withColumns(
        {
            "all_n": F.sum("n").over(by_feature()), "n_bin": F.sum("n").over(Window.partitionBy("feature", "bin")),
            "n_label": F.sum("n").over(Window.partitionBy("feature", label)),
        }
    )
    part = F.col("n") / F.col("all_n") * F.ln(F.col("n") * F.col("all_n") / (F.col("n_bin") * F.col("n_label")))
    return cells.groupBy("feature").agg(F.sum(part).alias("mi"))


def best_features(scores: DataFrame, score: str, k: int | None) -> DataFrame:
    ranked = scores.orderBy(F.desc_nulls_last(score), "feature")
    return ranked if k is None else ranked.limit(k)


def encoded(df: DataFrame, label: str, into: str = "label_id") -> DataFrame:
    """Labels in sorted order as 0, 1, ...; the ids are made on the table of labels."""
    ids = df.select(label).distinct().where(F.col(label).isNotNull())
    ids = ids.withColumn(into, F.row_number().over(Window.orderBy(label)).cast("long") - 1)
    return df.join(ids, label, "left")


def majority_vote(predictions: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, label, prediction): first true label by row order, most frequent prediction, ties to the smaller.

    ``predictions`` has (key, seg_no, label, prediction).
    """
    counts = predictions.groupBy(key, "prediction").agg(F.count("*").alias("_n"))
    votes = counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("prediction").alias("p"))).alias("_v"))
    truth = predictions.where("label IS NOT NULL").groupBy(key).agg(F.min_by("label", "seg_no").alias("label"))
    return truth.join(votes, key).select(key, "label", F.col("_v.p").alias("prediction"))


def confusion(predictions: DataFrame) -> DataFrame:
    """(label, prediction, n) with all pairs of labels, 0 where none."""
    labels = predictions.select("label").union(predictions.select("prediction")).distinct()
    # A table of labels crossed with itself; it holds a row a class.
    pairs = labels.crossJoin(F.broadcast(labels.withColumnRenamed("label", "prediction")))
    counts = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return pairs.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mean_confusion(predictions: DataFrame, split: str = "split") -> DataFrame:
    """(label, prediction, n): the mean over the splits of the confusion matrix, 0 where a split has none."""
    splits = predictions.select(split).distinct().count()
    every = confusion(predictions.select("label", "prediction"))
    return every.withColumn("n", F.col("n") / F.lit(splits))


def weighted_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by support; a ratio without a base counts 0."""
    cells = predictions.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    true = cells.groupBy(*by, "label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(*by, F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    rows = true.join(said, [*by, "label"], "left")
    p, r = ratio(F.col("hit"), F.coalesce("said", F.lit(0))), ratio(F.col("hit"), F.col("support"))
    rows = rows.withColumns({"p": p, "r": r})
    rows = rows.withColumn("f1", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    weigh = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return rows.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), weigh("p").alias("precision"), weigh("r").alias("recall"), weigh("f1").alias("f1")
    )


def aggregated(metrics: DataFrame, names: list[str], sample: bool = True, digits: int | None = None) -> DataFrame:
    """Mean and deviation over splits: of a sample (0 for one split), or of the population and rounded half to even."""
    out = []
    for c in names:
        std = F.coalesce(F.stddev_samp(c), F.lit(0.0)) if sample else F.stddev_pop(c)
        for v, n in ((F.avg(c), "mean"), (std, "std")):
            out.append((v if digits is None else F.bround(v, digits)).alias(f"{c}_{n}"))
    return metrics.agg(*out)


def best_split(metrics: DataFrame, score: str = "f1", order: str = "split") -> DataFrame:
    """The row of the highest score, the first on a tie."""
    return metrics.orderBy(F.desc(score), order).limit(1)
