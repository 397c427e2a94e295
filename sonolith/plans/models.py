"""Queries whose kernels or models SQL can't express; tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import clips as C
from ..operators import models as M
from .common import query, table


def _clips(spark, d):
    """Embeddings as short clips of 8 kHz, tiled to a quarter of a second."""
    y = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 32))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), "label", F.lit(8000).alias("sr"), y.alias("samples"))


def _features(domain):
    def run(spark, d):
        out = C.extracted(_clips(spark, d), [domain])
        return out.select("file_id", "label", "ok", F.map_entries("features").alias("f")).select("file_id", "label", "ok", F.explode_outer("f").alias("f")).select(
            "file_id", "label", "ok", F.col("f.key").alias("feature"), F.round("f.value", 6).alias("value")
        )

    run.__name__ = f"{domain}_features"
    return run


def _stats4(of, name):
    """SQL for mean, deviation, skewness and excess kurtosis of each file's ``of``; higher moments of next to none are 0."""
    c = f"({of} - m_{name})"
    var = f"avg({c} * {c})"
    high = [f"CASE WHEN {var} >= 1e-10 THEN avg({c} ** {p}) / {var} ** {p / 2}{less} ELSE 0 END AS {name}_{n}" for n, p, less in (("skew", 3, ""), ("kurt", 4, " - 3"))]
    return f"avg({of}) AS {name}_mean, sqrt({var}) AS {name}_std, {', '.join(high)}"


_TIME = f"""WITH y AS (SELECT vec_id AS file_id, i, embedding[i % 64 + 1]::DOUBLE AS y, embedding[(i + 1) % 64 + 1]::DOUBLE AS z FROM embeddings, range(2048) t(i)),
f AS (SELECT file_id, t, sqrt(sum(y * y) FILTER (i + 1024 BETWEEN 512 * t AND 512 * t + 2047) / 2048) AS rms,
  count(*) FILTER ((y < 0) <> (z < 0) AND i < 2047 AND i + 1025 BETWEEN 512 * t + 1 AND 512 * t + 2047) / 2048 AS zcr FROM y, range(5) r(t) GROUP BY ALL),
e AS (SELECT file_id, {_stats4("rms", "envelope")}, {_stats4("zcr", "zcr")} FROM (SELECT *, avg(rms) OVER w AS m_envelope, avg(zcr) OVER w AS m_zcr FROM f WINDOW w AS (PARTITION BY file_id)) GROUP BY 1),
c AS (SELECT *, y - avg(y) OVER w AS c, min(y) OVER w AS lo, max(y) OVER w AS hi FROM y WINDOW w AS (PARTITION BY file_id)),
h AS (SELECT file_id, -sum(d * log2(d)) AS entropy FROM (SELECT file_id, least(floor((y - lo) / (hi - lo) * 100), 99) AS bin, count(*) / (2048 * (any_value(hi) - any_value(lo)) / 100) AS d FROM c GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT file_id, avg(y) AS mean_amplitude, median(y) AS median_amplitude, sqrt(avg(c * c)) AS std_amplitude, min(y) AS min_amplitude, max(y) AS max_amplitude,
  max(abs(y)) AS peak_amplitude, max(y) - min(y) AS peak_to_peak, avg(c * c) AS variance, avg(abs(c)) AS mean_absolute_deviation, avg(y * y) AS signal_energy,
  sqrt(avg(c * c)) / (sqrt(avg(y * y)) + 1e-10) AS nrmsd, 10 * log10(sum(y * y) / (sum(c * c) + 1e-10)) AS snr, corr(y, z) FILTER (i < 2047) AS autocorrelation,
  avg(c ** 3) / avg(c * c) ** 1.5 * sqrt(2048 * 2047) / 2046 AS skewness, 2047 / (2046 * 2045) * (2049 * (avg(c ** 4) / avg(c * c) ** 2 - 3) + 6) AS kurtosis FROM c GROUP BY 1),
r AS (SELECT a.*, e.* EXCLUDE (file_id), entropy, peak_amplitude / (envelope_mean + 1e-10) AS peak_to_rms_ratio FROM a JOIN e USING (file_id) JOIN h USING (file_id))
SELECT file_id, label, true AS ok, feature, round(value, 6) AS value FROM (UNPIVOT r ON COLUMNS(* EXCLUDE (file_id)) INTO NAME feature VALUE value) JOIN (SELECT vec_id AS file_id, label FROM embeddings) USING (file_id)"""

query(_TIME)(_features("time"))
for _domain in ("frequency", "cepstral"):
    query()(_features(_domain))


def _summed(values):
    """Size, sum of squares and range of an array."""
    energy = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    return [
        F.size(values).alias("n"), F.round(energy, 6).alias("energy"), F.round(F.array_min(values), 6).alias("least"), F.round(F.array_max(values), 6).alias("greatest")
    ]


@query()
def time_frequency_features(spark, d):
    out = C.extracted(_clips(spark, d), ["time_frequency"])
    values = F.transform(F.array_sort(F.map_entries("features")), lambda e: e.value)
    return out.withColumn("values", values).select("file_id", "ok", *_summed(F.col("values")))


def _denoised(method):
    def run(spark, d):
        out = C.denoised(_clips(spark, d), method)
        return out.select("file_id", "status", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))

    run.__name__ = f"denoise_{method}"
    return run


for _method in K.DENOISE:
    query()(_denoised(_method))


@query()
def augment(spark, d):
    out = C.augmented(_clips(spark, d))
    return out.select("file_id", "status", *_summed(F.col("samples")))


@query()
def preprocess_chain(spark, d):
    steps = C.option_steps({"sampling_rate": "4000", "bit_depth": "16", "denoising": "wiener", "pre_emphasis": "0.97", "amplitude_method": "peak", "segmentation": "time_based"}, False)
    out = C.pipeline(_clips(spark, d), steps)
    return out.select("file_id", "seg_no", "start_sec", "end_sec", *_summed(F.col("samples")))


_NAMES = [f"f{i:02}" for i in range(64)]


def _wide(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.col("label").cast("string").alias("label"), (F.col("vec_id") % 25).alias("group"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(_NAMES)])


@query()
def random_forest_splits(spark, d):
    return M.monte_carlo(_wide(spark, d), _NAMES, "vec_id", n_splits=2, group="group", n_estimators=10, max_depth=4).drop("train_time_sec")


@query()
def rocket_features(spark, d):
    return C.rocket(_clips(spark, d)).select("file_id", *_summed(F.col("rocket")))
