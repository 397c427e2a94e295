"""Waveforms as (series_id, idx, y) rows or as arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("idx")


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def long_form(df: DataFrame, series: str, order: list[str], value: str, *keep: str) -> DataFrame:
    """Rows numbered from 0 in each series."""
    n = F.row_number().over(Window.partitionBy(series).orderBy(*order)).cast("long") - 1
    return df.select(F.col(series).alias("series_id"), n.alias("idx"), F.col(value).cast("double").alias("y"), *keep)


def exploded(df: DataFrame, series: str, samples: Column) -> DataFrame:
    return df.select(F.col(series).alias("series_id"), F.posexplode(samples).alias("idx", "y")).withColumn("idx", F.col("idx").cast("long"))


def preemphasis(long: DataFrame, c: float | None = 0.97) -> DataFrame:
    """y[n] - c * y[n-1], the first sample as it is; no change for no coefficient."""
    if not c:
        return long
    return long.withColumn("y", F.coalesce(F.col("y") - F.lit(c) * F.lag("y").over(in_order()), F.col("y")))


def undone_preemphasis(samples: Column, c: float = 0.97, block: int = 256) -> Column:
    """out[n] = y[n] + c * out[n-1] over an array, in time linear in its length.

    Blocks are filtered alone, as if silence came before; what a block leaves behind fades into the next.
    """
    none = F.array().cast("array<double>")

    def alone(part: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("t"), none.alias("xs"))
        step = lambda s, y: F.struct((y + F.lit(c) * s.t).alias("t"), F.concat(s.xs, F.array(y + F.lit(c) * s.t)).alias("xs"))
        return F.aggregate(part, start, step, lambda s: s.xs)

    last = F.floor((F.size(samples) - 1) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: alone(F.slice(samples, k * block + 1, F.lit(block))))
    start = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<array<double>>").alias("xs"))

    def joined(s: Column, part: Column) -> Column:
        faded = F.transform(part, lambda x, i: x + s.t * F.pow(F.lit(c), (i + 1).cast("double")))
        return F.struct(F.coalesce(F.try_element_at(faded, F.lit(-1)), s.t).alias("t"), F.concat(s.xs, F.array(faded)).alias("xs"))

    return F.when(samples.isNotNull(), F.flatten(F.aggregate(blocks, start, joined, lambda s: s.xs)))


def amplitude(long: DataFrame, method: str = "peak") -> DataFrame:
    """Divided by the largest magnitude or by the root mean square, if that isn't 0."""
    if method == "none":
        return long
    if method not in ("peak", "rms"):
        raise ValueError(f"unknown amplitude method {method}")
    y = F.col("y")
    by = F.max(F.abs(y)).over(whole()) if method == "peak" else F.sqrt(F.avg(y * y).over(whole()))
    return long.withColumn("_by", by).withColumn("y", F.when(F.col("_by") > 0, y / F.col("_by")).otherwise(y)).drop("_by")


def _once(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda an expression is computed again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def amplitude_array(samples: Column, method: str = "peak") -> Column:
    if method == "none":
        return samples
    if method == "peak":
        level = lambda y: F.array_max(F.transform(y, F.abs))
    elif method == "rms":
        level = lambda y: F.sqrt(F.aggregate(y, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(y), F.lit(0)))
    else:
        raise ValueError(f"unknown amplitude method {method}")
    return _once(samples, lambda y: _once(level(y), lambda by: F.when(by > 0, F.transform(y, lambda x: x / by)).otherwise(y)))


def to_mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def to_stereo(samples: Column) -> Column:
    return F.array(samples, samples)


def quantized(samples: Column, bits: int = 24) -> Column:
    """PCM integers of 16, 24 or 32 bits (16 for others), clipped, as doubles."""
    top = float(2 ** ((bits if bits in (16, 24, 32) else 16) - 1))
    return F.transform(samples, lambda x: F.greatest(F.least(F.rint(x * top), F.lit(top - 1)), F.lit(-top)))


def wiener(long: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Local Wiener filter over three samples with zeros beyond the ends; a flat series stays as it is."""
    y = F.col("y")
    a, b = F.coalesce(F.lag("y").over(in_order()), F.lit(0.0)), F.coalesce(F.lead("y").over(in_order()), F.lit(0.0))
    m = (a + y + b) / 3
    out = long.withColumn("_m", m).withColumn("_v", F.greatest((a * a + y * y + b * b) / 3 - m * m, F.lit(0.0)))
    out = out.withColumn("_noise", F.avg("_v").over(whole())).withColumn("_var", F.var_pop("y").over(whole()))
    gain = 1 - F.col("_noise") / F.when(F.col("_v") > 0, F.col("_v")).otherwise(1.0)
    filtered = F.when(F.col("_v") <= F.col("_noise"), F.col("_m")).otherwise(F.col("_m") + gain * (y - F.col("_m")))
    return out.withColumn("y", F.when(F.col("_var") < floor, y).otherwise(filtered)).drop("_m", "_v", "_noise", "_var")


def soft_threshold(samples: Column, u: Column) -> Column:
    return F.transform(samples, lambda x: F.signum(x) * F.greatest(F.abs(x) - u, F.lit(0.0)))


def robust_sigma(y: Column) -> Column:
    return F.median(F.abs(y)) / 0.6745


def rolled(long: DataFrame, shift: Column) -> DataFrame:
    """Circular shift to the right by int(shift)."""
    n = F.count("*").over(whole())
    return long.withColumn("idx", F.pmod(F.col("idx") + shift.cast("long"), n))


def cropped(samples: Column, share: float, start: Column) -> Column:
    """int(share * n) samples from ``start``."""
    return F.slice(samples, start.cast("int") + 1, F.floor(F.size(samples) * F.lit(share)).cast("int"))


def compressed(samples: Column, c: float = 1.0, clip: float = 0.9) -> Column:
    """Dynamic range compression: clip(c * log1p(|y|) * sign(y))."""
    return F.transform(samples, lambda x: F.greatest(F.least(F.lit(c) * F.log1p(F.abs(x)) * F.signum(x), F.lit(clip)), F.lit(-clip)))


def time_masked(samples: Column, start: Column, width: Column) -> Column:
    return F.transform(samples, lambda x, i: F.when((i >= start) & (i < start + width), F.lit(0.0)).otherwise(x))


def reverberated(samples: Column, taps: list[float]) -> Column:
    """Convolution with ``taps``, cut to the length of the input."""
    n = len(taps)
    kernel = F.array(*[F.lit(float(t)) for t in taps])

    def at(x: Column, i: Column) -> Column:
        lags = F.sequence(F.lit(0), F.least(i, F.lit(n - 1)))
        return F.aggregate(lags, F.lit(0.0), lambda a, k: a + F.get(samples, i - k) * F.get(kernel, k))

    return F.transform(samples, at)


def reverb_taps(rate: int, scale: float = 0.3) -> list[float]:
    """Decay from 1 to 0.001 over 30 ms, scaled."""
    n = int(0.03 * rate)
    return [scale * 10 ** (-3 * i / max(1, n - 1)) for i in range(n)]


def framed(long: DataFrame, length: int, hop: int) -> DataFrame:
    """A row for each frame and sample in it; frames that would run over the end are left out."""
    n = F.count("*").over(whole())
    first = F.greatest(F.ceil((F.col("idx") - (length - 1)) / F.lit(hop)), F.lit(0))
    last = F.least(F.floor(F.col("idx") / F.lit(hop)), F.floor((n - length) / F.lit(hop)))
    out = long.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    out = out.withColumn("frame", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return out.withColumn("frame", F.col("frame").cast("long"))


def overlap_added(frames: DataFrame, window: Column) -> DataFrame:
    """Sum of windowed frames over the sum of squared windows (0 counts as 1)."""
    out = frames.groupBy("series_id", "idx").agg(F.sum(F.col("y") * window).alias("_y"), F.sum(window * window).alias("_w"))
    return out.select("series_id", "idx", (F.col("_y") / F.when(F.col("_w") != 0, F.col("_w")).otherwise(1.0)).alias("y"))


def deltas(long: DataFrame) -> DataFrame:
    """Slope of five samples by least squares; samples without two neighbours on each side are left out."""
    at = lambda k: F.lag("y", -k).over(in_order())
    slope = (at(2) * 2 + at(1) - at(-1) - at(-2) * 2) / 10
    return long.withColumn("delta", slope).where("delta IS NOT NULL")


def flux(long: DataFrame) -> DataFrame:
    """Positive differences to the sample before; 0 for the first."""
    return long.withColumn("flux", F.coalesce(F.greatest(F.col("y") - F.lag("y").over(in_order()), F.lit(0.0)), F.lit(0.0)))


def interpolated(samples: Column, n: int) -> Column:
    """Linear interpolation of an array to ``n`` points over its whole length."""
    size = F.size(samples)

    def at(i: Column) -> Column:
        x = i * (size - 1) / F.lit(max(1, n - 1))
        low = F.floor(x).cast("int")
        high = F.least(low + 1, size - 1)
        return F.get(samples, low) + (x - low) * (F.get(samples, high) - F.get(samples, low))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def rolloff(spectrum: Column, share: float = 0.85) -> Column:
    """The first bin at which the running sum reaches ``share`` of the whole."""
    total = F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + x)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("at"))

    def step(s: Column, x: Column) -> Column:
        sum_ = s["sum"] + x
        return F.struct(sum_.alias("sum"), (s.i + 1).alias("i"), F.when((s["at"] < 0) & (sum_ >= total * F.lit(share)), s.i).otherwise(s["at"]).alias("at"))

    return F.aggregate(spectrum, state, step, lambda s: s["at"])


def histogram_entropy(long: DataFrame, bins: int = 100) -> DataFrame:
    """-sum(d * log2(d)) over the densities d of an equal-width histogram; may be negative."""
    out = long.withColumns({"_lo": F.min("y").over(whole()), "_hi": F.max("y").over(whole()), "_n": F.count("y").over(whole())})
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = out.where("_hi > _lo").withColumn("_bin", F.least(F.floor((F.col("y") - F.col("_lo")) / width), F.lit(bins - 1)))
    out = out.groupBy("series_id", "_bin").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first((F.col("_hi") - F.col("_lo")) / bins).alias("_w"))
    d = F.col("_c") / (F.col("_n") * F.col("_w"))
    return out.groupBy("series_id").agg((-F.sum(d * F.log2(d))).alias("entropy"))


def lag_correlation(long: DataFrame) -> DataFrame:
    """Correlation of each series with itself one sample later; 0 if either side is flat."""
    pairs = long.withColumn("_b", F.lag("y").over(in_order())).where("_b IS NOT NULL")
    n = F.count("*")
    cov = F.covar_pop("y", "_b")
    both = F.stddev_pop("y") * F.stddev_pop("_b")
    return pairs.groupBy("series_id").agg(F.when(both > 0, cov / F.when(both > 0, both)).otherwise(0.0).alias("autocorrelation"), n.alias("n_pairs"))


def usable(long: DataFrame) -> DataFrame:
    """Series of two or more samples that are not all close to the first."""
    first = F.first("y").over(in_order())
    out = long.withColumn("_far", F.abs(F.col("y") - first) > 1e-8 + 1e-5 * F.abs(first))
    out = out.withColumn("_ok", F.max("_far").over(whole()) & (F.count("*").over(whole()) >= 2))
    return out.where("_ok").drop("_far", "_ok")


def time_profile(long: DataFrame) -> DataFrame:
    """The amplitude statistics of the time domain, a row a series."""
    y = F.col("y")
    centred = long.withColumn("_m", F.avg("y").over(whole()))
    c = y - F.col("_m")
    return centred.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg(y).alias("mean_amplitude"), F.median(y).alias("median_amplitude"),
        F.stddev_pop(y).alias("std_amplitude"), F.min(y).alias("min_amplitude"), F.max(y).alias("max_amplitude"),
        F.max(F.abs(y)).alias("peak_amplitude"), (F.max(y) - F.min(y)).alias("peak_to_peak"), F.var_pop(y).alias("variance"),
        F.avg(F.abs(c)).alias("mean_absolute_deviation"), F.avg(y * y).alias("signal_energy"),
        (F.sqrt(F.avg(c * c)) / (F.sqrt(F.avg(y * y)) + 1e-10)).alias("nrmsd"),
        (10 * F.log10(F.sum(y * y) / (F.sum(c * c) + 1e-10))).alias("snr"),
    )
