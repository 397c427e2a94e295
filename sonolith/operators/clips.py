"""Clips (file_id, sr, samples) through numpy kernels, in Arrow batches; errors become a column."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import signal as S

_CLIP = "struct<status:string,error:string,samples:array<double>>"


def _batched(f):
    @F.pandas_udf(_CLIP)
    def run(samples: pd.Series, rate: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = []
        for y, sr, k in zip(samples, rate, key, strict=True):
            try:
                rows.append(("success", None, f(np.asarray(y, float), int(sr), str(k))))
            except Exception as e:  # a clip that fails is reported, never dropped
                rows.append(("failed", f"{type(e).__name__}: {e}", None))
        return pd.DataFrame(rows, columns=["status", "error", "samples"])

    return run


def _applied(clips: DataFrame, f, key: Column | None = None) -> DataFrame:
    out = clips.withColumn("_r", _batched(f)(F.col("samples"), F.col("sr"), F.col("file_id").cast("string") if key is None else key))
    ok = F.coalesce(F.col("status"), F.lit("success")) == "success" if "status" in clips.columns else F.lit(True)
    status = F.when(ok, F.col("_r.status")).otherwise(F.col("status")) if "status" in clips.columns else F.col("_r.status")
    error = F.when(ok, F.col("_r.error")).otherwise(F.col("error")) if "error" in clips.columns else F.col("_r.error")
    return out.withColumns({"status": status, "error": error, "samples": F.col("_r.samples")}).drop("_r")


def split_status(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    return clips.where("status = 'success'"), clips.where("status <> 'success'")


def normalized(clips: DataFrame, rate: int | None = None, bits: int | None = None) -> DataFrame:
    """Resampled and quantized; None keeps what there is."""
    out = clips
    if rate:
        out = _applied(clips, lambda y, sr, k: K.resample(y, sr, rate)).withColumn("sr", F.lit(rate))
    if bits:
        top = float(2 ** (bits - 1))
        out = out.withColumn("samples", F.transform(S.quantized(F.col("samples"), bits), lambda x: x / top))
    return out


#: Formats and channel counts that options name.
FORMATS = ("wav", "flac", "mp3", "ogg")
CHANNELS = {"mono": 1, "stereo": 2}


def targeted(clips: DataFrame, format: str | None = None, channels: str | None = None) -> DataFrame:
    """The format and channel count that a sink writes; clips hold one channel, which stereo repeats there."""
    if format is not None and format.lower() not in FORMATS:
        raise ValueError(f"unknown format {format}")
    if channels is not None and channels.lower() not in CHANNELS:
        raise ValueError(f"unknown channels {channels}")
    out = clips.withColumn("format", F.lit(format.lower())) if format else clips
    return out.withColumn("channels", F.lit(CHANNELS[channels.lower()])) if channels else out


#: Other names that options use for denoising methods.
_DENOISE = {"spectral_sub": "spectral_subtraction"}


def denoised(clips: DataFrame, method: str = "wiener") -> DataFrame:
    method = _DENOISE.get(method, method)
    if method == "none":
        return clips
    if method not in K.DENOISE:
        raise ValueError(f"unknown denoising method {method}")
    return _applied(clips, lambda y, sr, k: K.DENOISE[method](y, sr))


def preemphasized(clips: DataFrame, c: float | None = 0.97) -> DataFrame:
    if not c:
        return clips
    y = F.col("samples")
    return clips.withColumn("samples", F.transform(y, lambda x, i: F.when(i == 0, x).otherwise(x - F.lit(float(c)) * F.get(y, i - 1))))


def amplitude(clips: DataFrame, method: str = "peak") -> DataFrame:
    return clips.withColumn("samples", S.amplitude_array(F.col("samples"), method))


#: Other names that options use for segmentation methods.
_SEGMENT = {"time_based": "time", "event_based": "event"}


def segmented(clips: DataFrame, method: str = "time", length: float = 5.0) -> DataFrame:
    """A row for each segment, with seg_no, start_sec and end_sec; ``event`` keeps the runs of loud frames,
    ``adaptive`` those of the window and weight that give the fewest. A clip that fails is one failed row."""
    method = _SEGMENT.get(method, method)
    if method == "none":
        return clips
    if method not in ("time", "event", "adaptive"):
        raise ValueError(f"unknown segmentation {method}")
    n = F.size("samples")
    total = n / F.col("sr")
    if method == "time":
        cut = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(total / F.lit(length)).cast("int") - 1, F.lit(0))),
            lambda k: F.struct((k * F.lit(length)).alias("start_sec"), F.least((k + 1) * F.lit(length), total).alias("end_sec")),
        )
    else:

        @F.pandas_udf("array<struct<start_sec:double,end_sec:double>>")
        def cut_events(samples: pd.Series, rate: pd.Series) -> pd.Series:
            find = fewest_runs if method == "adaptive" else loud_runs
            found = []
            for y, sr in zip(samples, rate, strict=True):
                try:
                    found.append(find(np.asarray(y, float), int(sr)))
                except Exception:  # a clip that fails is reported, never dropped
                    found.append(None)
            return pd.Series(found)

        cut = cut_events("samples", "sr")
        if "status" not in clips.columns:
            clips = clips.withColumns({"status": F.lit("success"), "error": F.lit(None).cast("string")})
    out = clips.select(*clips.columns, F.posexplode_outer(cut).alias("_k", "_s"))
    if method != "time":
        bad = F.col("_k").isNull() & (F.col("status") == "success")
        out = out.withColumns({"error": F.when(bad, "segmentation failed").otherwise(F.col("error")), "status": F.when(bad, "failed").otherwise(F.col("status"))})
    a, b = (F.col("_s.start_sec") * F.col("sr")).cast("int"), (F.col("_s.end_sec") * F.col("sr")).cast("int")
    return out.withColumns(
        {"seg_no": F.col("_k") + 1, "start_sec": F.col("_s.start_sec"), "end_sec": F.col("_s.end_sec"), "samples": F.slice("samples", a + 1, F.greatest(b - a, F.lit(0)))}
    ).drop("_k", "_s")


def loud_runs(y: np.ndarray, rate: int, window=0.05, weight=0.5, least=0.2, gap=0.5) -> list[dict]:
    """Runs of frames over the energy level, long ones only, merged over short gaps; else the whole clip."""
    step = max(1, int(window * rate))
    energy = np.array([(y[i : i + step] ** 2).mean() for i in range(0, len(y), step)])
    whole = [{"start_sec": 0.0, "end_sec": len(y) / rate}]
    if not len(energy):
        return whole
    order, k = np.sort(energy), max(1, len(energy) // 10)
    loud = energy >= (1 - weight) * order[:k].mean() + weight * order[-k:].mean()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
    first, last = edges[::2] * step / rate, np.minimum(edges[1::2] * step, len(y)) / rate
    long = last - first >= least
    first, last = first[long], last[long]
    if not len(first):
        return whole
    # Runs are apart and in order, so a new segment starts where the silence before is long.
    starts = np.flatnonzero(np.append(True, first[1:] - last[:-1] > gap))
    stops = np.append(starts[1:], len(first)) - 1
    return [{"start_sec": float(first[a]), "end_sec": float(last[b])} for a, b in zip(starts, stops, strict=True)]


#: Windows and weights that the adaptive method tries.
ADAPTIVE = {"window": (0.5, 1.0, 2.0), "weight": (0.3, 0.5, 0.7)}


def fewest_runs(y: np.ndarray, rate: int) -> list[dict]:
    """The segments of the first window and weight that give the fewest."""
    tried = [loud_runs(y, rate, window, weight, least=1.0) for window in ADAPTIVE["window"] for weight in ADAPTIVE["weight"]]
    return min(tried, key=len)


def augmented(clips: DataFrame, methods: list[str] | None = None, copies: int = 2, seed: int = 42, include_original: bool = False) -> DataFrame:
    """``copies`` changed clips of each: method and numbers drawn from a hash of seed, file and copy; an unknown
    method leaves the clip as it is, tagged none. New ids are {file}_aug_{method}_{copy}."""
    methods = methods or [m for m in K.AUGMENT if m != "none"]
    tags = F.array(*[F.lit(m if m in K.AUGMENT else "none") for m in methods])
    out = clips.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    out = out.withColumn("_tag", F.get(tags, F.pmod(F.xxhash64(F.lit(seed), "file_id", "_i"), F.lit(len(methods))).cast("int")))

    def change(y: np.ndarray, sr: int, key: str) -> np.ndarray:
        tag, h = key.split("|")
        return K.AUGMENT[tag](y, sr, np.random.default_rng(int(h) & (2**63 - 1)))

    out = _applied(out, change, F.concat_ws("|", "_tag", F.xxhash64(F.lit(seed + 1), "file_id", "_i").cast("string")))
    out = out.withColumn("file_id", F.format_string("%s_aug_%s_%d", F.col("file_id").cast("string"), F.col("_tag"), F.col("_i"))).drop("_i", "_tag")
    same = clips.withColumn("file_id", F.col("file_id").cast("string"))
    return same.unionByName(out, allowMissingColumns=True) if include_original else out


def kernel_rows(clips: DataFrame, f) -> DataFrame:
    """(file_id, name, frame, value) of what ``f`` (samples, rate) gives: rows over frames by name."""

    @F.pandas_udf("array<struct<name:string,values:array<double>>>")
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        found = (f(np.asarray(y, float), int(sr)) for y, sr in zip(samples, rate, strict=True))
        return pd.Series([[{"name": k, "values": np.asarray(v, float).tolist()} for k, v in rows.items()] for rows in found])

    rows = clips.select("file_id", F.explode(run("samples", "sr")).alias("r"))
    return rows.select("file_id", F.col("r.name").alias("name"), F.posexplode("r.values").alias("frame", "value"))


def extracted(clips: DataFrame, domains: list[str] = ("time",)) -> DataFrame:
    """``clips`` without samples, with ``features`` (map of name to value), ok and error; one pass for all domains."""
    known = [K.EXTRACTORS[d] for d in domains]

    @F.pandas_udf("struct<ok:boolean,error:string,features:map<string,double>>")
    def run(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
        rows = []
        for y, sr in zip(samples, rate, strict=True):
            try:
                found = {}
                for f in known:
                    found |= {k: float(v) for k, v in f(np.asarray(y, float), int(sr)).items()}
                rows.append((True, None, found))
            except Exception as e:  # reported in the row
                rows.append((False, f"{type(e).__name__}: {e}", None))
        return pd.DataFrame(rows, columns=["ok", "error", "features"])

    kept = [c for c in clips.columns if c not in ("samples", "status", "error")]
    return clips.withColumn("_r", run("samples", "sr")).select(*kept, "_r.ok", "_r.error", "_r.features")


def feature_table(features: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """A column for each name, sorted; rows without features are left out."""
    return features.where("ok").select(*keep, *[F.try_element_at("features", F.lit(n)).alias(n) for n in sorted(names)])


def rocket(clips: DataFrame) -> DataFrame:
    """``clips`` with the array of kernel responses."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda y: K.minirocket(np.asarray(y, float)))

    return clips.withColumn("rocket", run("samples"))


def pipeline(clips: DataFrame, steps: list[tuple]) -> DataFrame:
    """Steps (function, arguments) in order, as one lazy plan."""
    return reduce(lambda df, step: step[0](df, **step[1]), steps, clips)


def option_steps(option: dict, train: bool) -> list[tuple]:
    """Steps of one combination in the fixed order; the word none, null and 0 leave a step out."""
    value = lambda name: None if option.get(name) is None or str(option[name]).lower() == "none" else option[name]
    steps: list[tuple] = []
    if value("format") or value("channels"):
        steps.append((targeted, {"format": value("format"), "channels": value("channels")}))
    if value("sampling_rate") or value("bit_depth"):
        steps.append((normalized, {"rate": int(value("sampling_rate") or 0) or None, "bits": int(value("bit_depth") or 0) or None}))
    if value("denoising"):
        steps.append((denoised, {"method": value("denoising")}))
    if value("pre_emphasis") and float(value("pre_emphasis")):
        steps.append((preemphasized, {"c": float(value("pre_emphasis"))}))
    if value("amplitude_method"):
        steps.append((amplitude, {"method": value("amplitude_method")}))
    if value("segmentation"):
        steps.append((segmented, {"method": value("segmentation")}))
    if train and value("augmentation"):
        steps.append((augmented, {}))
    return steps


