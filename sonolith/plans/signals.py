"""Queries over waveforms: the event stream as long series, embeddings as short clips."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.stats import corrected_kurtosis, corrected_skewness, stats4
from ..operators import segments as G
from ..operators import signal as S
from .common import query, table

_EV = "ev AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS y FROM events)"
_PRE = "pre AS (SELECT series_id, idx, coalesce(y - 0.97::DOUBLE * lag(y) OVER (PARTITION BY series_id ORDER BY idx), y) AS y FROM ev)"
_SM = "s AS (SELECT vec_id AS series_id, generate_subscripts(embedding, 1) - 1 AS idx, unnest(embedding)::DOUBLE AS y FROM embeddings)"


def _events(spark, d):
    return S.long_form(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


def _clips(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("series_id"), F.col("embedding").cast("array<double>").alias("samples"))


def _long_clips(spark, d, change=None):
    clips = _clips(spark, d)
    samples = F.col("samples") if change is None else change(F.col("samples"))
    return S.exploded(clips, "series_id", samples)


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""WITH {_EV}, {_PRE}, pk AS (SELECT series_id, max(abs(y)) AS m FROM pre GROUP BY 1),
nm AS (SELECT series_id, idx, CASE WHEN m > 0 THEN y / m ELSE y END AS y FROM pre JOIN pk USING (series_id))
SELECT series_id, count(*)::BIGINT AS n, round(avg(y), 6) AS wave_mean, round(stddev_pop(y), 6) AS wave_std,
round(skewness(y) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS wave_skew, round(kurtosis_pop(y), 6) AS wave_kurt,
round(median(y), 6) AS wave_median, round(skewness(y), 6) AS g1, round(kurtosis(y), 6) AS g2
FROM nm GROUP BY series_id HAVING count(*) >= 4 AND var_pop(y) >= 1e-10""")
def signal_profile(spark, d):
    long = S.amplitude(S.preemphasis(_events(spark, d)), "peak")
    y = F.col("y")
    out = long.groupBy("series_id").agg(
        F.count("*").alias("n"), *stats4(y, "wave"), F.median(y).alias("wave_median"), corrected_skewness(y).alias("g1"),
        corrected_kurtosis(y).alias("g2"), F.var_pop(y).alias("v"),
    ).where("n >= 4 AND v >= 1e-10").drop("v")
    return _rounded(out, "wave_mean", "wave_std", "wave_skew", "wave_kurt", "wave_median", "g1", "g2")


@query(f"WITH {_EV}, {_PRE} SELECT series_id, idx::BIGINT AS idx, round(y, 6) AS y FROM pre")
def preemphasis(spark, d):
    return _rounded(S.preemphasis(_events(spark, d)), "y")


@query(f"""WITH {_SM} SELECT a.series_id, a.idx::BIGINT AS idx, round(sum(b.y * pow(0.97::DOUBLE, a.idx - b.idx)), 6) AS y
FROM s a JOIN s b ON a.series_id = b.series_id AND b.idx <= a.idx GROUP BY 1, 2""")
def undo_preemphasis(spark, d):
    return _rounded(_long_clips(spark, d, S.undone_preemphasis), "y")


@query(f"WITH {_SM} SELECT series_id, idx::BIGINT AS idx, round(y / max(abs(y)) OVER (PARTITION BY series_id), 6) AS peak, round(y / sqrt(avg(y * y) OVER (PARTITION BY series_id)), 6) AS rms FROM s")
def amplitude(spark, d):
    both = _clips(spark, d).select(
        "series_id", F.posexplode(F.arrays_zip(S.amplitude_array(F.col("samples"), "peak").alias("p"), S.amplitude_array(F.col("samples"), "rms").alias("r"))).alias("idx", "z")
    )
    return both.select("series_id", F.col("idx").cast("long").alias("idx"), F.round("z.p", 6).alias("peak"), F.round("z.r", 6).alias("rms"))


@query(f"WITH {_SM}, r AS (SELECT series_id, idx, y FROM s) SELECT a.series_id, a.idx::BIGINT AS idx, round((a.y + b.y) / 2, 6) AS y FROM r a JOIN r b ON a.series_id = b.series_id AND b.idx = 63 - a.idx")
def channel_mix(spark, d):
    return _rounded(_long_clips(spark, d, lambda s: S.to_mono(s, F.reverse(s))), "y")


@query(f"WITH {_SM} SELECT series_id, idx::BIGINT AS idx, greatest(least(round_even(y * 32768, 0), 32767), -32768)::DOUBLE AS q16, greatest(least(round_even(y * 8388608, 0), 8388607), -8388608)::DOUBLE AS q24 FROM s")
def quantize(spark, d):
    both = _clips(spark, d).select(
        "series_id", F.posexplode(F.arrays_zip(S.quantized(F.col("samples"), 16).alias("a"), S.quantized(F.col("samples"), 24).alias("b"))).alias("idx", "z")
    )
    return both.select("series_id", F.col("idx").cast("long").alias("idx"), F.col("z.a").alias("q16"), F.col("z.b").alias("q24"))


@query(f"""WITH {_EV}, n AS (SELECT *, coalesce(lag(y) OVER w, 0) AS a, coalesce(lead(y) OVER w, 0) AS b FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
m AS (SELECT *, (a + y + b) / 3 AS mm FROM n), v AS (SELECT *, greatest((a * a + y * y + b * b) / 3 - mm * mm, 0) AS vv FROM m),
z AS (SELECT *, avg(vv) OVER (PARTITION BY series_id) AS noise, var_pop(y) OVER (PARTITION BY series_id) AS vr FROM v)
SELECT series_id, idx::BIGINT AS idx, round(CASE WHEN vr < 1e-12 THEN y WHEN vv <= noise THEN mm ELSE mm + (1 - noise / vv) * (y - mm) END, 5) AS y FROM z""")
def wiener(spark, d):
    return _rounded(S.wiener(_events(spark, d)), "y", digits=5)


@query(f"""WITH {_SM}, u AS (SELECT series_id, median(abs(y)) / 0.6745::DOUBLE * sqrt(2 * ln(count(*))) AS u FROM s GROUP BY 1)
SELECT series_id, idx::BIGINT AS idx, round(sign(y) * greatest(abs(y) - u, 0), 6) + 0.0 AS y FROM s JOIN u USING (series_id)""")
def soft_threshold(spark, d):
    long = _long_clips(spark, d)
    u = long.groupBy("series_id").agg((S.robust_sigma(F.col("y")) * F.sqrt(2 * F.ln(F.count("*")))).alias("u"))
    out = _clips(spark, d).join(u, "series_id").select("series_id", F.posexplode(S.soft_threshold(F.col("samples"), F.col("u"))).alias("idx", "y"))
    return out.select("series_id", F.col("idx").cast("long").alias("idx"), (F.round("y", 6) + 0.0).alias("y"))


@query(f"WITH {_EV}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev) SELECT series_id, ((idx + trunc(n * 0.2::DOUBLE)::BIGINT) % n)::BIGINT AS idx, y FROM n")
def roll(spark, d):
    return S.rolled(_events(spark, d), F.floor(F.count("*").over(S.whole()) * F.lit(0.2)))


@query(f"WITH {_SM} SELECT series_id, (idx - series_id % 13)::BIGINT AS idx, round(y, 6) AS y FROM s WHERE idx >= series_id % 13 AND idx < series_id % 13 + 51")
def crop(spark, d):
    out = _clips(spark, d).select("series_id", F.posexplode(S.cropped(F.col("samples"), 0.8, F.col("series_id") % 13)).alias("idx", "y"))
    return _rounded(out.withColumn("idx", F.col("idx").cast("long")), "y")


@query(f"WITH {_SM} SELECT series_id, idx::BIGINT AS idx, round(greatest(least(ln(1 + abs(y)) * sign(y), 0.9), -0.9), 6) + 0.0 AS y FROM s")
def compress(spark, d):
    return _long_clips(spark, d, S.compressed).withColumn("y", F.round("y", 6) + 0.0)


@query(f"WITH {_SM} SELECT series_id, idx::BIGINT AS idx, round(CASE WHEN idx >= series_id % 40 AND idx < series_id % 40 + 10 THEN 0 ELSE y END, 6) AS y FROM s")
def time_mask(spark, d):
    out = _clips(spark, d).select("series_id", F.posexplode(S.time_masked(F.col("samples"), F.col("series_id") % 40, F.lit(10))).alias("idx", "y"))
    return _rounded(out.withColumn("idx", F.col("idx").cast("long")), "y")


_TAPS = S.reverb_taps(400)


@query(f"""WITH {_SM}, t(k, w) AS (VALUES {', '.join(f'({i}, {w!r}::DOUBLE)' for i, w in enumerate(_TAPS))})
SELECT a.series_id, a.idx::BIGINT AS idx, round(sum(b.y * w), 6) AS y FROM s a JOIN t ON true JOIN s b ON b.series_id = a.series_id AND b.idx = a.idx - k GROUP BY 1, 2""")
def reverberate(spark, d):
    return _rounded(_long_clips(spark, d, lambda s: S.reverberated(s, _TAPS)), "y")


@query("""WITH t AS (SELECT doc_id AS series_id, n_chars / 100.0::DOUBLE AS t FROM documents)
SELECT series_id, k + 1 AS seg_no, k * 5.0::DOUBLE AS start_sec, least((k + 1) * 5.0::DOUBLE, t) AS end_sec
FROM (SELECT series_id, t, unnest(range(0, ceil(t / 5.0::DOUBLE)::BIGINT)) AS k FROM t WHERE t > 0)""")
def segments_fixed(spark, d):
    return G.fixed_segments(table(spark, d, "documents").withColumn("t", F.col("n_chars") / F.lit(100.0)), "doc_id", "t")


_IV = "iv AS (SELECT user_id AS series_id, floor(epoch(ts))::DOUBLE AS start_sec, floor(epoch(ts)) + trunc(value * 60)::DOUBLE AS end_sec FROM events)"
_MERGE = """iv2 AS (SELECT *, max(end_sec) OVER (PARTITION BY series_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM kept),
fl AS (SELECT *, sum(CASE WHEN b IS NULL OR start_sec - b > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS g FROM iv2)"""


def _intervals(spark, d):
    start = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, d, "events").select(
        F.col("user_id").alias("series_id"), start.alias("start_sec"), (start + F.floor(F.col("value") * 60)).alias("end_sec")
    )


@query(f"WITH {_IV}, kept AS (SELECT * FROM iv WHERE end_sec - start_sec >= 600), {_MERGE.format(gap=7200)} SELECT series_id, g::BIGINT AS seg_no, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM fl GROUP BY series_id, g")
def segments_merged(spark, d):
    return G.merged_segments(G.long_enough(_intervals(spark, d), 600), 7200)


@query(f"WITH {_IV}, kept AS (SELECT * FROM iv WHERE end_sec - start_sec >= 20000), {_MERGE.format(gap=3600)}, m AS (SELECT series_id, g::BIGINT AS seg_no, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM fl GROUP BY series_id, g), a AS (SELECT * FROM m UNION ALL SELECT user_id, 1, 0, count(*) FROM events WHERE user_id NOT IN (SELECT series_id FROM m) GROUP BY user_id) SELECT *, series_id || '_' || lpad(seg_no::VARCHAR, 3, '0') AS name FROM a")
def segments_event(spark, d):
    clips = table(spark, d, "events").groupBy(F.col("user_id").alias("series_id")).agg(F.count("*").cast("double").alias("t"))
    merged = G.merged_segments(G.long_enough(_intervals(spark, d), 20000), 3600)
    return G.named(G.or_whole(merged, clips, "t"))


_P = "(VALUES (0, 3600.0, 600.0), (1, 3600.0, 6000.0), (2, 7200.0, 600.0), (3, 7200.0, 6000.0)) p(o, gap, least)"


@query(f"""WITH {_IV}, p AS (SELECT * FROM {_P}), kept AS (SELECT o, gap, least, iv.* FROM iv JOIN p ON end_sec - start_sec >= least),
b AS (SELECT *, max(end_sec) OVER (PARTITION BY series_id, o ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM kept),
n AS (SELECT series_id, o, gap, least, sum(CASE WHEN b IS NULL OR start_sec - b > gap THEN 1 ELSE 0 END)::BIGINT AS n FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n, o) AS r FROM n) SELECT series_id, n, gap::DOUBLE AS gap, least::DOUBLE AS least FROM r WHERE r = 1""")
def adaptive_params(spark, d):
    out = None
    for o, (gap, least) in enumerate(((3600.0, 600.0), (3600.0, 6000.0), (7200.0, 600.0), (7200.0, 6000.0))):
        n = G.merged_segments(G.long_enough(_intervals(spark, d), least), gap).groupBy("series_id").agg(F.count("*").alias("n"))
        n = n.withColumns({"o": F.lit(o), "gap": F.lit(gap), "least": F.lit(least)})
        out = n if out is None else out.unionByName(n)
    return G.fewest(out, ["gap", "least"], "o")


@query(f"""WITH {_EV}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
g AS (SELECT series_id, unnest(range(0, max(n))) AS f FROM n GROUP BY series_id),
f AS (SELECT series_id, f.f AS frame, avg(y * y) AS e FROM n JOIN g f USING (series_id) WHERE idx >= f.f * 2 AND idx < f.f * 2 + 4 AND f.f * 2 + 4 <= n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY e, frame) AS r, count(*) OVER (PARTITION BY series_id) AS c FROM f),
l AS (SELECT series_id, 0.5::DOUBLE * avg(e) FILTER (WHERE r <= greatest(floor(c * 0.1::DOUBLE), 1)) + 0.5::DOUBLE * avg(e) FILTER (WHERE r > c - greatest(floor(c * 0.1::DOUBLE), 1)) AS lv FROM r GROUP BY 1),
a AS (SELECT series_id, frame, frame - row_number() OVER (PARTITION BY series_id ORDER BY frame) AS g FROM f JOIN l USING (series_id) WHERE e >= lv)
SELECT series_id, min(frame) * 0.5::DOUBLE AS start_sec, max(frame) * 0.5::DOUBLE + 1.0 AS end_sec FROM a GROUP BY series_id, g""")
def segments_active(spark, d):
    frames = S.framed(_events(spark, d), 4, 2).groupBy("series_id", "frame").agg(F.avg(F.col("y") * F.col("y")).alias("energy"))
    return G.frames_to_segments(G.active_frames(frames), 0.5, 1.0)


@query(f"""WITH {_EV}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, CASE WHEN idx > 0 AND (y >= 100) <> (lag(y) OVER (PARTITION BY series_id ORDER BY idx) >= 100) THEN 1 ELSE 0 END AS z FROM ev)
SELECT series_id, f.f::BIGINT AS frame, round(sqrt(avg(y * y)), 5) AS rms, round(avg(z), 6) AS zcr FROM n JOIN (SELECT series_id, unnest(range(0, max(n))) AS f FROM n GROUP BY series_id) f USING (series_id) WHERE idx >= f.f * 4 AND idx < f.f * 4 + 8 AND f.f * 4 + 8 <= n GROUP BY 1, 2""")
def frame_rms_zcr(spark, d):
    long = _events(spark, d)
    above = F.col("y") >= 100
    crossed = F.when((F.col("idx") > 0) & (above != F.lag(above).over(S.in_order())), 1).otherwise(0)
    frames = S.framed(long.withColumn("z", crossed), 8, 4).groupBy("series_id", "frame")
    return frames.agg(F.round(F.sqrt(F.avg(F.col("y") * F.col("y"))), 5).alias("rms"), F.round(F.avg("z"), 6).alias("zcr"))


@query(f"""WITH {_EV}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
f AS (SELECT *, unnest([idx // 4, idx // 4 - 1]) AS f FROM n WHERE n >= 8),
w AS (SELECT series_id, idx, y, 1 - abs(idx - 4 * f - 3.5::DOUBLE) / 4 AS w FROM f WHERE f >= 0 AND f <= (n - 8) // 4)
SELECT series_id, idx::BIGINT AS idx, round(sum(y * w) / sum(w * w), 5) AS y FROM w GROUP BY 1, 2""")
def overlap_add(spark, d):
    """Frames of 8 with a triangular window, 4 apart."""
    window = 1 - F.abs(F.col("idx") - 4 * F.col("frame") - 3.5) / 4
    return _rounded(S.overlap_added(S.framed(_events(spark, d), 8, 4), window), "y", digits=5)


@query(f"""WITH {_EV}, p AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS b FROM ev)
SELECT series_id, count(*)::BIGINT AS n_pairs, round(CASE WHEN stddev_pop(y) * stddev_pop(b) > 0 THEN covar_pop(y, b) / (stddev_pop(y) * stddev_pop(b)) ELSE 0 END, 6) AS autocorrelation FROM p WHERE b IS NOT NULL GROUP BY 1""")
def autocorrelation(spark, d):
    return _rounded(S.lag_correlation(_events(spark, d)), "autocorrelation")


@query(f"""WITH {_EV}, r AS (SELECT *, min(y) OVER w AS lo, max(y) OVER w AS hi, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY series_id)),
b AS (SELECT series_id, least(floor((y - lo) / ((hi - lo) / 100)), 99) AS bin, any_value(n) AS n, any_value((hi - lo) / 100) AS w, count(*) AS c FROM r WHERE hi > lo GROUP BY 1, 2)
SELECT series_id, round(-sum(c / (n * w) * log2(c / (n * w))), 6) AS entropy FROM b GROUP BY 1""")
def histogram_entropy(spark, d):
    return _rounded(S.histogram_entropy(_events(spark, d)), "entropy")


@query(f"""WITH {_SM}, p AS (SELECT series_id, y * y AS p, sum(y * y) OVER (PARTITION BY series_id) AS t FROM s)
SELECT series_id, round(-sum(p / (t + 1e-10) * log2(p / (t + 1e-10) + 1e-10)), 6) AS entropy FROM p GROUP BY 1""")
def spectral_entropy(spark, d):
    long = _long_clips(spark, d, lambda s: F.transform(s, lambda x: x * x))
    p = F.col("y") / (F.sum("y").over(S.whole()) + 1e-10)
    return long.withColumn("p", p).groupBy("series_id").agg(F.round(-F.sum(F.col("p") * F.log2(F.col("p") + 1e-10)), 6).alias("entropy"))


@query(f"""WITH {_EV}, x AS (SELECT series_id, idx, (2 * lead(y, 2) OVER w + lead(y) OVER w - lag(y) OVER w - 2 * lag(y, 2) OVER w) / 10 AS delta FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY idx))
SELECT series_id, idx::BIGINT AS idx, round(delta, 6) AS delta FROM x WHERE delta IS NOT NULL""")
def deltas(spark, d):
    return _rounded(S.deltas(_events(spark, d)).select("series_id", "idx", "delta"), "delta")


@query(f"WITH {_EV} SELECT series_id, idx::BIGINT AS idx, round(coalesce(greatest(y - lag(y) OVER (PARTITION BY series_id ORDER BY idx), 0), 0), 6) AS flux FROM ev")
def flux(spark, d):
    return _rounded(S.flux(_events(spark, d)).select("series_id", "idx", "flux"), "flux")


@query(f"""WITH {_SM}, c AS (SELECT series_id, idx, sum(y * y) OVER (PARTITION BY series_id ORDER BY idx) AS c, sum(y * y) OVER (PARTITION BY series_id) AS t FROM s)
SELECT series_id, min(idx)::INT AS bin FROM c WHERE c >= 0.85::DOUBLE * t GROUP BY 1""")
def rolloff(spark, d):
    return _clips(spark, d).select("series_id", S.rolloff(F.transform("samples", lambda x: x * x)).alias("bin"))


@query(f"""WITH {_SM}, g AS (SELECT series_id, i, i * 63 / 99.0::DOUBLE AS x FROM (SELECT DISTINCT series_id FROM s), range(0, 100) r(i))
SELECT g.series_id, i::BIGINT AS idx, round(a.y + (x - floor(x)) * (b.y - a.y), 6) AS y FROM g JOIN s a ON a.series_id = g.series_id AND a.idx = floor(x)::BIGINT JOIN s b ON b.series_id = g.series_id AND b.idx = least(floor(x)::BIGINT + 1, 63)""")
def interpolate(spark, d):
    return _rounded(_long_clips(spark, d, lambda s: S.interpolated(s, 100)), "y")


@query(f"""WITH {_EV}, c AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS c FROM ev)
SELECT series_id, count(*)::BIGINT AS n, round(avg(y) + 1e-9::DOUBLE, 5) AS mean_amplitude, round(median(y) + 1e-9::DOUBLE, 5) AS median_amplitude, round(stddev_pop(y) + 1e-9::DOUBLE, 5) AS std_amplitude, round(min(y) + 1e-9::DOUBLE, 5) AS min_amplitude,
round(max(y) + 1e-9::DOUBLE, 5) AS max_amplitude, round(max(abs(y)) + 1e-9::DOUBLE, 5) AS peak_amplitude, round(max(y) - min(y) + 1e-9::DOUBLE, 5) AS peak_to_peak, round(var_pop(y) + 1e-9::DOUBLE, 4) AS variance, round(avg(abs(c)) + 1e-9::DOUBLE, 5) AS mean_absolute_deviation,
round(avg(y * y) + 1e-9::DOUBLE, 4) AS signal_energy, round(sqrt(avg(c * c)) / (sqrt(avg(y * y)) + 1e-10) + 1e-9::DOUBLE, 6) AS nrmsd, round(10 * log10(sum(y * y) / (sum(c * c) + 1e-10)) + 1e-9::DOUBLE, 5) AS snr FROM c GROUP BY 1""")
def time_profile(spark, d):
    out = S.time_profile(_events(spark, d))
    digits = {"variance": 4, "signal_energy": 4, "nrmsd": 6}
    # Means of values with two decimals often lie halfway: the offset decides them alike in any engine.
    return out.select("series_id", "n", *[F.round(F.col(c) + 1e-9, digits.get(c, 5)).alias(c) for c in out.columns if c not in ("series_id", "n")])


@query(f"""WITH {_EV}, f AS (SELECT *, first_value(y) OVER (PARTITION BY series_id ORDER BY idx) AS y0 FROM ev),
g AS (SELECT series_id FROM f GROUP BY 1 HAVING count(*) >= 2 AND bool_or(abs(y - y0) > 1e-8 + 1e-5 * abs(y0))) SELECT series_id, count(*)::BIGINT AS n FROM ev JOIN g USING (series_id) GROUP BY 1""")
def usable_series(spark, d):
    return S.usable(_events(spark, d)).groupBy("series_id").agg(F.count("*").alias("n"))


@query(f"WITH {_SM} SELECT series_id, round(sqrt(avg(y * y)) / sqrt(pow(10, 1.0::DOUBLE)), 8) AS sigma FROM s GROUP BY 1")
def noise_level(spark, d):
    long = _long_clips(spark, d)
    return long.groupBy("series_id").agg(F.round(F.sqrt(F.avg(F.col("y") * F.col("y"))) / math.sqrt(10.0), 8).alias("sigma"))
