"""Queries that hold kernels against SQL: clips of 64 samples, transforms as sums over sines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import clips as C
from .common import query, table

_RATE, _FFT, _HOP, _BANDS = 8000, 32, 16, 8
_Y = "y AS (SELECT vec_id AS file_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS y FROM embeddings)"
_S = f"""{_Y}, x AS (SELECT file_id, t AS frame, j, y * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS x FROM range(32) a(j), range(5) b(t), y WHERE i = 16 * t + j - 16),
s AS (SELECT file_id, frame, k, sqrt(pow(sum(x * cos(2 * pi() * k * j / 32)), 2) + pow(sum(x * sin(2 * pi() * k * j / 32)), 2)) AS s FROM x, range(17) c(k) GROUP BY ALL)"""
_DB = f"""{_S}, e AS (SELECT m, CASE WHEN x < 15 THEN x * 200 / 3 ELSE 1000 * exp(ln(6.4) / 27 * (x - 15)) END AS f
  FROM (SELECT m, m / 9.0 * (15 + ln(4) / (ln(6.4) / 27)) AS x FROM range(10) t(m))),
b AS (SELECT l.m AS band, k, greatest(0, least((k * 250 - l.f) / (m.f - l.f), (h.f - k * 250) / (h.f - m.f))) * 2 / (h.f - l.f) AS w
  FROM e l JOIN e m ON m.m = l.m + 1 JOIN e h ON h.m = l.m + 2, range(17) c(k)),
p AS (SELECT file_id, frame, band, 10 * log10(greatest(sum(w * s * s), 1e-10)) AS p FROM s JOIN b USING (k) GROUP BY ALL),
db AS (SELECT file_id, frame, band, greatest(p, max(p) OVER (PARTITION BY file_id) - 80) AS db FROM p)"""


def _clips(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("file_id"), F.lit(_RATE).alias("sr"), F.col("embedding").cast("array<double>").alias("samples"))


def _by_number(rows):
    return {f"{i:02}": r for i, r in enumerate(np.atleast_2d(rows))}


def _spectrum(y):
    return np.abs(K.stft(y, _FFT, _HOP))


def _rounded(rows, digits=5):
    return rows.select("file_id", "name", F.col("frame").cast("long").alias("frame"), F.round("value", digits).alias("value"))


@query(f"WITH {_S} SELECT file_id, lpad(k::VARCHAR, 2, '0') AS name, frame, round(s, 5) AS value FROM s")
def stft_magnitudes(spark, d):
    return _rounded(C.kernel_rows(_clips(spark, d), lambda y, sr: _by_number(_spectrum(y))))


@query(f"""WITH {_S}, q AS (SELECT *, greatest(sum(s) OVER (PARTITION BY file_id, frame), 1e-10) AS total, sum(s) OVER (PARTITION BY file_id, frame ORDER BY k) AS run FROM s),
c AS (SELECT *, sum(k * 250 * s / total) OVER (PARTITION BY file_id, frame) AS centroid FROM q),
r AS (SELECT file_id, frame, any_value(centroid) AS centroid, sqrt(sum(s / total * pow(k * 250 - centroid, 2))) AS bandwidth,
  exp(avg(ln(greatest(s * s, 1e-10)))) / avg(greatest(s * s, 1e-10)) AS flatness, min(k * 250.0::DOUBLE) FILTER (run >= 0.85 * total) AS rolloff FROM c GROUP BY ALL)
SELECT file_id, name, frame, round(value, 5) AS value FROM (UNPIVOT r ON centroid, bandwidth, flatness, rolloff INTO NAME name VALUE value)""")
def spectral_shape(spark, d):
    f = np.fft.rfftfreq(_FFT, 1 / _RATE)
    return _rounded(C.kernel_rows(_clips(spark, d), lambda y, sr: K.shape(_spectrum(y), f)))


@query(f"WITH {_DB} SELECT file_id, lpad(band::VARCHAR, 2, '0') AS name, frame, round(db, 5) AS value FROM db")
def mel_decibels(spark, d):
    return _rounded(C.kernel_rows(_clips(spark, d), lambda y, sr: _by_number(K.decibels(K.mel_bank(sr, _FFT, _BANDS) @ _spectrum(y) ** 2))))


@query(f"""WITH {_DB} SELECT file_id, lpad(c::VARCHAR, 2, '0') AS name, frame,
round(sum(db * cos(pi() * c * (2 * band + 1) / 16)) * CASE c WHEN 0 THEN sqrt(1 / 8) ELSE 0.5 END, 5) AS value FROM db, range(5) n(c) GROUP BY file_id, c, frame""")
def mfcc(spark, d):
    return _rounded(C.kernel_rows(_clips(spark, d), lambda y, sr: _by_number(K.mfcc(y, sr, 5, _FFT, _HOP, _BANDS))))


@query(f"""WITH {_DB}, r AS (SELECT file_id, frame, avg(greatest(db - before, 0)) AS r
  FROM (SELECT file_id, frame, db, lag(db) OVER (PARTITION BY file_id, band ORDER BY frame) AS before FROM db) WHERE before IS NOT NULL GROUP BY ALL)
SELECT f.file_id, 'onset' AS name, t AS frame, round(coalesce(r, 0), 5) AS value
FROM (SELECT file_id, t FROM (SELECT DISTINCT file_id FROM db), range(5) n(t)) f LEFT JOIN r ON r.file_id = f.file_id AND t >= 2 AND r.frame = t - 1""")
def onset_strength(spark, d):
    return _rounded(C.kernel_rows(_clips(spark, d), lambda y, sr: {"onset": K.onset(y, sr, _HOP, _FFT, _BANDS)}))


@query(f"""WITH {_Y}, x AS (SELECT file_id, k, sum(y * cos(2 * pi() * k * i / 64)) AS re, -sum(y * sin(2 * pi() * k * i / 64)) AS im FROM y, range(17) c(k) GROUP BY ALL)
SELECT file_id, 'y' AS name, m AS frame, round(sum(CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * m / 32) - im * sin(2 * pi() * k * m / 32))) / 64, 5) AS value
FROM x, range(32) n(m) GROUP BY file_id, m""")
def resample_half(spark, d):
    return _rounded(C.kernel_rows(_clips(spark, d), lambda y, sr: {"y": K.resample(y, sr, sr // 2)}))


@query(f"""WITH {_Y}, w AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest([-0.2, -0.1, 0, 0.1, 0.2]::DOUBLE[]) AS d1, unnest([2, -1, -2, -1, 2]) / 7 AS d2),
r AS (SELECT file_id, n AS frame, sum(y * d1) AS d1, sum(y * d2) AS d2 FROM range(64) t(n), w, y WHERE i = least(greatest(n, 2), 61) + o GROUP BY ALL)
SELECT file_id, name, frame, round(value, 5) AS value FROM (UNPIVOT r ON d1, d2 INTO NAME name VALUE value)""")
def savgol_deltas(spark, d):
    return _rounded(C.kernel_rows(_clips(spark, d), lambda y, sr: {"d1": K.delta(y[None, :])[0], "d2": K.delta(y[None, :], 2)[0]}))
