"""Queries over feature tables and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as O
from .common import query, table

_LONG = "f AS (SELECT vec_id, label, 'f' || lpad((generate_subscripts(embedding, 1) - 1)::VARCHAR, 2, '0') AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"
_HOLE = "h AS (SELECT vec_id, label, feature, CASE WHEN vec_id % 7 <> 0 THEN value END AS value FROM f)"


def _long(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "value"))
    return rows.select("vec_id", "label", F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), F.col("value").cast("double").alias("value"))


@query(f"""WITH {_LONG}, {_HOLE}, m AS (SELECT feature, avg(value) AS m FROM h WHERE vec_id % 5 <> 0 GROUP BY 1)
SELECT vec_id, feature, round(coalesce(value, m), 6) AS value FROM h JOIN m USING (feature)""")
def impute_mean(spark, d):
    holes = _long(spark, d).withColumn("value", F.when(F.col("vec_id") % 7 != 0, F.col("value")))
    return O.imputed(holes, F.col("vec_id") % 5 != 0).select("vec_id", "feature", F.round("value", 6).alias("value"))


@query(f"""WITH {_LONG}, m AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM f WHERE vec_id % 5 <> 0 GROUP BY 1)
SELECT vec_id, feature, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS value FROM f JOIN m USING (feature)""")
def zscore(spark, d):
    return O.scaled(_long(spark, d), F.col("vec_id") % 5 != 0).select("vec_id", "feature", F.round("value", 5).alias("value"))


_F = """c AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM f GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM c),
a AS (SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(ss) / (max(t) - count(*))) AS f FROM w GROUP BY 1)"""


@query(f"WITH {_LONG}, {_F} SELECT feature, round(f, 4) AS f FROM a")
def anova_f(spark, d):
    return O.anova(_long(spark, d)).select("feature", F.round("f", 4).alias("f"))


@query(f"WITH {_LONG}, {_F} SELECT feature, round(f, 4) AS f FROM a ORDER BY f DESC, feature LIMIT 10")
def anova_topk(spark, d):
    return O.best_features(O.anova(_long(spark, d)), "f", 10).select("feature", F.round("f", 4).alias("f"))


@query(f"""WITH {_LONG}, r AS (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM f),
b AS (SELECT feature, label, least(floor((value - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS n FROM r GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl FROM b)
SELECT feature, round(sum(n / t * ln(n * t / (nb * nl))), 6) AS mi FROM t GROUP BY 1""")
def mutual_information(spark, d):
    return O.mutual_information(_long(spark, d)).select("feature", F.round("mi", 6).alias("mi"))


@query("SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::BIGINT AS label_id FROM documents WHERE lang IS NOT NULL")
def label_encode(spark, d):
    return O.encoded(table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "lang"), "lang")


_CENTRE = f"""{_LONG}, c AS (SELECT label AS prediction, feature, avg(value) AS m FROM f WHERE vec_id % 2 = 0 GROUP BY 1, 2),
s AS (SELECT vec_id, label, prediction, round(sum((value - m) * (value - m)), 9) AS dist FROM f JOIN c USING (feature) GROUP BY 1, 2, 3),
p AS (SELECT vec_id, label, prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, prediction) AS r FROM s) WHERE r = 1)"""


def _predictions(spark, d):
    """Nearest centroid of the even rows: a centroid table of a row a class and feature."""
    long = _long(spark, d)
    centres = long.where("vec_id % 2 = 0").groupBy(F.col("label").alias("prediction"), "feature").agg(F.avg("value").alias("m"))
    far = long.join(centres, "feature").groupBy("vec_id", "label", "prediction").agg(F.round(F.sum((F.col("value") - F.col("m")) * (F.col("value") - F.col("m"))), 9).alias("dist"))
    return far.groupBy("vec_id", "label").agg(F.min(F.struct("dist", "prediction")).alias("best")).select("vec_id", "label", F.col("best.prediction").alias("prediction"))


@query(f"WITH {_CENTRE} SELECT * FROM p")
def nearest_centroid(spark, d):
    return _predictions(spark, d)


@query(f"""WITH {_CENTRE}, l AS (SELECT label FROM p UNION SELECT prediction FROM p)
SELECT a.label, b.label AS prediction, count(p.vec_id)::BIGINT AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.label = a.label AND p.prediction = b.label GROUP BY 1, 2""")
def confusion(spark, d):
    return O.confusion(_predictions(spark, d))


_WEIGHTED = """t AS (SELECT {by} label, count(*) AS support, sum((label = prediction)::INT) AS hit FROM p GROUP BY ALL),
q AS (SELECT {by} prediction AS label, count(*) AS said FROM p GROUP BY ALL),
r AS (SELECT t.*, coalesce(hit / said, 0) AS pr, hit / support AS re FROM t LEFT JOIN q USING ({by} label)),
z AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM r),
m AS (SELECT {by} sum(hit) / sum(support) AS accuracy, sum(pr * support) / sum(support) AS precision, sum(re * support) / sum(support) AS recall, sum(f * support) / sum(support) AS f1 FROM z GROUP BY ALL)"""


@query(f"WITH {_CENTRE}, {_WEIGHTED.format(by='')} SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def weighted_metrics(spark, d):
    out = O.weighted_metrics(_predictions(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_SPLITS = f"{_CENTRE.replace('p AS (', 'p0 AS (')}, p AS (SELECT vec_id % 4 AS split, * FROM p0), {_WEIGHTED.format(by='split,')}"


def _by_split(spark, d):
    return O.weighted_metrics(_predictions(spark, d).withColumn("split", F.col("vec_id") % 4), "split")


@query(f"""WITH {_SPLITS} SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM m""")
def mc_aggregate(spark, d):
    out = O.aggregated(_by_split(spark, d), ["accuracy", "f1"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {_SPLITS} SELECT round_even(avg(accuracy), 4) AS accuracy_mean, round_even(stddev_pop(accuracy), 4) AS accuracy_std FROM m")
def mc_aggregate_rounded(spark, d):
    return O.aggregated(_by_split(spark, d), ["accuracy"], sample=False, digits=4)


@query(f"WITH {_SPLITS} SELECT split, round(f1, 6) AS f1 FROM m ORDER BY m.f1 DESC, split LIMIT 1")
def best_split(spark, d):
    return O.best_split(_by_split(spark, d)).select("split", F.round("f1", 6).alias("f1"))


_VOTES = f"""{_CENTRE.replace('p AS (', 'p0 AS (')}, v AS (SELECT vec_id // 4 AS file_id, vec_id AS seg_no, label, prediction FROM p0),
n AS (SELECT file_id, prediction, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, prediction) AS r FROM v GROUP BY 1, 2),
t AS (SELECT file_id, arg_min(label, seg_no) AS label FROM v WHERE label IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_VOTES} SELECT file_id, label, prediction FROM t JOIN n USING (file_id) WHERE r = 1")
def majority_vote(spark, d):
    votes = _predictions(spark, d).select(F.floor(F.col("vec_id") / 4).alias("file_id"), F.col("vec_id").alias("seg_no"), "label", "prediction")
    return O.majority_vote(votes)
