import time

import numpy as np
from sonolith.functions import kernels as K
from sonolith.operators import signal as S
from sonolith.plans import registry


def _tiled(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: np.tile(np.array(r["embedding"], np.float32).astype(float), 32) for r in rows}


def test_amplitude_of_long_clips_takes_linear_time(spark):
    y = np.random.default_rng(5).normal(size=30_000)
    df = spark.createDataFrame([(0, y.tolist()), (1, [0.0, 0.0]), (2, []), (3, None), (4, [None, -2.0, 1.0])], "k int, y array<double>").coalesce(1)
    for method, by in (("peak", np.abs(y).max()), ("rms", np.sqrt((y * y).mean()))):
        began = time.monotonic()
        got = {r["k"]: r["z"] for r in df.select("k", S.amplitude_array(df["y"], method).alias("z")).collect()}
        assert time.monotonic() - began < 15
        assert np.allclose(got[0], y / by, rtol=1e-9) and got[1] == [0.0, 0.0] and got[2] == [] and got[3] is None
        assert got[4] == ([None, -1.0, 0.5] if method == "peak" else [None, -2.0, 1.0])


def test_preprocess_chain_equals_numpy(spark, small):
    got = {r["file_id"]: r for r in registry.queries()["preprocess_chain"](spark, small).collect()}
    clips = _tiled(spark, small)
    assert set(got) == set(clips)
    for k, y in clips.items():
        y = K.wiener(np.clip(np.rint(K.resample(y, 8000, 4000) * 32768), -32768, 32767) / 32768)
        y = y - 0.97 * np.append(0, y[:-1])
        y = y / np.abs(y).max()
        r = got[k]
        assert (r["seg_no"], r["start_sec"], r["end_sec"], r["n"]) == (1, 0.0, 0.256, 1024)
        assert np.allclose([r["energy"], r["least"], r["greatest"]], [y @ y, y.min(), y.max()], rtol=0, atol=2e-6)


def test_minirocket_equals_each_kernel_alone():
    kernels, rng = K.minirocket_kernels(), np.random.default_rng(6)
    grid = np.round(rng.normal(size=300) * 4) / 4  # many values of a convolution equal a bias
    for y in (rng.normal(size=1), rng.normal(size=7), rng.normal(size=2049), grid, np.full(50, 0.1), np.zeros(20), np.array([1.0, np.nan, 2.0])):
        want, scale = [], y.std() or 1.0
        for w, d in kernels:
            padded = np.pad(y / scale, 4 * d)
            conv = sum(w[k] * padded[k * d : k * d + len(y)] for k in range(9))
            want += [float((conv > b).mean()) for b in (-0.5, 0.0, 0.5)]
        assert K.minirocket(y) == want and all(K.minirocket(y, block=size) == want for size in (1, 64))
    assert len(K.minirocket(np.zeros(0))) == 1008 and all(np.isnan(K.minirocket(np.zeros(0))))


def test_minirocket_is_several_times_as_fast_as_each_kernel_alone():
    y = np.random.default_rng(7).normal(size=2048)

    def alone():
        for w, d in K.minirocket_kernels():
            padded = np.pad(y / y.std(), 4 * d)
            conv = sum(w[k] * padded[k * d : k * d + len(y)] for k in range(9))
            [(conv > b).mean() for b in (-0.5, 0.0, 0.5)]

    def least(f):
        took = []
        for _ in range(5):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        return min(took)

    assert 2.5 * least(lambda: K.minirocket(y)) < least(alone)


def test_rocket_features_equal_the_kernel(spark, small):
    got = {r["file_id"]: r for r in registry.queries()["rocket_features"](spark, small).collect()}
    clips = _tiled(spark, small)
    assert set(got) == set(clips)
    for k, y in clips.items():
        v, r = np.array(K.minirocket(y)), got[k]
        assert r["n"] == 1008 and np.allclose([r["energy"], r["least"], r["greatest"]], [v @ v, v.min(), v.max()], rtol=0, atol=2e-6)
