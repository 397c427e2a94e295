import math
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sonolith.functions import kernels as K
from sonolith.functions import text as T
from sonolith.operators import clips as C
from sonolith.operators import grid
from sonolith.operators import models as M
from sonolith.operators import tables as O
from sonolith.plans import registry
from sonolith.sources import audio, config, harvest, results

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    got = registry.queries()[name](spark, small)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    a, b = sorted(map(tuple, got.select(*columns).collect()), key=_key), sorted(want, key=_key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-5, abs_tol=2e-5)) for p, q in zip(x, y, strict=True)), (x, y)


def test_wav_round_trip_and_files(spark, tmp_path):
    y = np.sin(np.arange(4000) / 10) * 0.5
    for bits in (16, 24, 32):
        back, rate, got = audio.read_wav(audio.write_wav(y, 8000, bits))
        assert rate == 8000 and got == bits and np.abs(back[0] - y).max() <= 2.0 ** (1 - bits)
    os.makedirs(tmp_path / "finch")
    (tmp_path / "finch" / "XC12.WAV").write_bytes(audio.write_wav(np.vstack([y, -y]), 8000, 16))
    (tmp_path / "finch" / "XC13.wav").write_bytes(b"broken")
    (tmp_path / "finch" / "notes.txt").write_text("x")
    files = audio.find_audio(spark, str(tmp_path))
    got = {r["file_id"]: r for r in audio.decoded(files).collect()}
    assert set(got) == {"XC12", "XC13"} and got["XC12"]["class"] == "finch"
    assert got["XC12"]["status"] == "success" and abs(sum(got["XC12"]["samples"])) < 1e-9 and got["XC13"]["status"] == "failed"
    props = {r["file_id"]: r for r in audio.properties(files).collect()}
    assert props["XC12"]["channels"] == 2 and props["XC12"]["duration"] == 0.5 and props["XC13"]["format"] == "error"


def test_harvest_retries_and_rounds(spark):
    calls, waits = [], []

    def flaky(key):
        calls.append(key)
        return (200, {"recordings": [{"id": key, "rec": "r"}]}) if len(calls) >= 3 else (503, None)

    assert harvest.fetched(flaky, "7", harvest.BUSY_ONLY, waits.append)["id"] == "7" and waits == [5.0, 10.0]
    assert harvest.fetched(lambda k: (404, None), "7", harvest.BUSY_ONLY, waits.append) is None and len(waits) == 2
    rows = harvest.harvest_rounds(spark.createDataFrame([("1",), ("2",)], "id string"), lambda k: (200, {"recordings": [{"rec": k}]} if k == "1" else {"recordings": []}), rounds=2, sleep=lambda s: None)
    assert {(r["id"], r["ok"]) for r in rows.collect()} == {("1", True), ("2", False)}
    assert harvest.page_count(301) == 2


def test_config():
    out = config.load_config("base_path: /d\nraw: ${base_path}/raw\nlist: ['${base_path}', 3]")
    assert out["raw"] == "/d/raw" and out["list"] == ["/d", 3]


def test_results_append_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1.0), ("b", 5, 2.0), ("a", None, 3.0)], "model string, top int, f1 double")
    path = str(tmp_path / "results")
    assert results.append_results(rows, path, ("model", "top")) == 2
    assert results.append_results(rows, path, ("model", "top")) == 0
    assert spark.read.parquet(path).count() == 2


def clips(spark, n=24):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", "ab"[i % 2], i // 2, 4000, (np.sin(np.arange(4000) * (0.1 + 0.3 * (i % 2))) + 0.1 * rng.normal(size=4000)).tolist()) for i in range(n)]
    rows.append(("flat", "a", 99, 4000, [0.0] * 100))
    return spark.createDataFrame(rows, "file_id string, label string, group int, sr int, samples array<double>")


def test_clip_steps(spark):
    df = clips(spark)
    out = C.pipeline(df, C.option_steps({"sampling_rate": "2000", "denoising": "wiener", "pre_emphasis": 0.97, "amplitude_method": "peak", "segmentation": "event"}, True)).collect()
    assert all(np.abs(r["samples"]).max() <= 1 + 1e-9 for r in out if r["samples"])
    assert C.option_steps({"denoising": "none", "pre_emphasis": 0, "bit_depth": None}, True) == []
    assert C.denoised(df, "spectral_sub").where("status = 'success'").count() == df.count()
    assert C.segmented(df, "adaptive").where("file_id = 'c0'").count() >= 1
    for bad in (lambda: C.denoised(df, "other"), lambda: C.targeted(df, channels="five"), lambda: C.targeted(df, format="doc")):
        with pytest.raises(ValueError):
            bad()
    more = C.augmented(df, ["gaussian", "unknown"])
    assert more.count() == 2 * df.count() and C.augmented(df, include_original=True).count() == 3 * df.count()
    first, again = (sorted((r["file_id"], str(r["samples"])) for r in C.augmented(df).collect()) for _ in range(2))
    assert first == again
    found = {r["file_id"]: r for r in C.extracted(df, ["time"]).collect()}
    assert not found["flat"]["ok"] and len(found["c0"]["features"]) == 25
    parts = C.segmented(df, "time_based", 0.3).where("file_id = 'c0'").collect()
    assert len(parts) == 4 and sum(len(r["samples"]) for r in parts) == 4000


def test_training_tuning_and_grid(spark, tmp_path):
    table = C.feature_table(C.extracted(clips(spark), ["time"]), ["zcr_mean", "variance", "autocorrelation"], "file_id", "label", "group").cache()
    names = ["zcr_mean", "variance", "autocorrelation"]
    scores = M.monte_carlo(table, names, "file_id", n_splits=2, group="group", n_estimators=5, max_depth=3)
    assert scores.count() == 2 and M.summary(scores).first()["accuracy_mean"] > 0.9
    best, f1 = M.tuned(table, names, M.grid_candidates({"n_estimators": [2], "max_depth": [1, 2]}), "file_id", k=2)
    assert best["n_estimators"] == 2 and f1 > 0.9
    space = M.sampled_space({"a": {"type": "int", "low": 1, "high": 9}, "b": {"type": "float", "low": 0.01, "high": 1, "log": True}, "c": {"type": "bool"}}, 20)
    assert all(1 <= s["a"] <= 9 and 0.01 <= s["b"] <= 1 for s in space)
    assert M.fitted(table, names, "m3gp", generations=2).expressions
    fit, test, tested = M.train_simple(table, names, "file_id", n_estimators=3, save_to=str(tmp_path / "m"))
    again = M.evaluated(M.Fitted.load(str(tmp_path / "m")), test).first()
    assert again == tested.first() and again["accuracy"] > 0.9
    assert M.fitted(table, names, top_k=2, method="mutual_info", n_estimators=2).transform(table).count() == table.count()
    assert M.fitted(table, names, top_k=2, method="pca", n_estimators=2).transform(table).count() == table.count()
    for bad in (lambda: M.get_model("other"), lambda: M.fitted(table, names, top_k=2, method="other")):
        with pytest.raises(ValueError):
            bad()
    grid = {"a": [1, 2], "b": [1, 2, 3]}
    assert M.grid_size(grid) == 6 == len(M.drawn_candidates(grid, 6)) and len(M.drawn_candidates({"a": list(range(9))} | grid, 5)) == 5


def test_m3gp_does_not_lose_its_best(spark):
    rng = np.random.default_rng(3)
    rows = [(*(float(v) for v in x), "ab"[int(x[0] * x[1] > 0)]) for x in rng.normal(size=(300, 3))]
    df = spark.createDataFrame(rows, "x double, y double, z double, label_id string")
    shares = []
    for n in (0, 3, 12):
        gp = M.M3GP(generations=n, depth=4, seed=1, population=40)
        found = gp.expressions(df, ["x", "y", "z"])
        per = [df.selectExpr("label_id", f"{e} AS v").groupBy("label_id").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect() for e in found]
        share = []
        for rows in per:
            w, m, v = (np.array([r[c] for r in rows], float) for c in "nms")
            between = w @ (m - w @ m / w.sum()) ** 2
            share.append(between / (between + w @ v))
        shares.append(np.mean(share) - 0.001 * len(share))
    assert shares[0] <= shares[1] + 1e-9 and shares[1] <= shares[2] + 1e-9 and shares[2] > 0.3  # x * y tells the classes


def test_run_options(spark, tmp_path):
    options = {
        "pre_emphasis_coefficients": ["none"], "denoising_methods": ["none"], "segmentation_methods": ["time"],
        "feature_extractors": ["time", "combined", "nowhere"], "model_names": ["random_forest", "m3gp"], "channels": ["mono"],
        "models": {"random_forest": {"n_estimators": 3, "max_depth": 3, "n_jobs": -1}, "m3gp": {"max_depth": 4, "max_generation": 1}}, "normalize": True,
    }
    path, told = str(tmp_path / "r"), []
    df = clips(spark).cache()
    run = lambda o: grid.run_options(df, o, path, str(tmp_path / "w"), hyperparameters={"random_forest": {"param_grid": {"max_depth": [2]}}}, n_splits=1, notify=told.append)
    failures = run(options)
    assert len(failures) == 1 and "nowhere" in failures[0], failures
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 4 == len(told) and {(r["domain"], r["model"]) for r in rows} == {(d, m) for d in ("time", "combined") for m in options["model_names"]}
    assert set(rows[0].asDict()) == {*O.RESULT_KEY, "best_params", "train_time_sec", "test_accuracy", "test_precision", "test_recall", "test_f1_score"} | {
        f"{m}_{s}" for m in ("accuracy", "f1", "precision", "recall", "train_time_sec") for s in ("mean", "std")}
    assert all(r["test_accuracy"] > 0.9 for r in rows if r["model"] == "random_forest")
    assert {r["best_params"] for r in rows if r["model"] == "random_forest"} == {'{"max_depth": 2}'}
    assert len(run(options)) == 1 and spark.read.parquet(path).count() == 4  # what is recorded isn't run again
    rocket = {**options, "feature_extractors": ["time"], "model_names": ["minirocket"]}
    assert run(rocket) == [] and spark.read.parquet(path).where("model = 'minirocket' AND test_accuracy > 0.9").count() == 1
    louder = df.withColumn("samples", F.transform("samples", lambda x: x * 3)).cache()
    one = {**options, "feature_extractors": ["time"], "model_names": ["random_forest"], "models": {"random_forest": {"n_estimators": 3}}}
    assert grid.run_options(louder, one, str(tmp_path / "r3"), str(tmp_path / "w"), n_splits=1) == []
    stored, fresh = (grid._values(spark.read.parquet(f), "time") if "clips" in f else spark.read.parquet(f) for f in (
        str(next((tmp_path / "w").glob("S_*")) / "test" / x) for x in ("time", "clips")))
    same = lambda t: sorted((r["file_id"], r["seg_no"], r["values"]) for r in t.collect())
    assert same(stored) == same(fresh)  # other recordings in the same folder have features of their own
    sent = df.limit(1).select(F.lit("S").alias("subset"), *[F.lit("x").alias(c) for c in grid.COMBO_FIELDS[1:]]).select(T.combo_tag().alias("t")).first()["t"]
    assert sent == grid.tag({c: "x" for c in grid.COMBO_FIELDS} | {"subset": "S"}) == "S_x_xHz_xbit_x_Dx__PEx_Ampx_Sx_Augx"


def test_results_merge_and_clean_up(spark, tmp_path):
    path = str(tmp_path / "d" / "results")
    one = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "model string, f1 double")
    assert results.save_results(one, path, ("model",)) == 2
    assert results.save_results(spark.createDataFrame([("a", 9.0), ("c", 3.0)], one.schema), path, ("model",)) == 1
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 2.0), ("b", 1.0), ("c", 3.0)}
    (tmp_path / "d" / "keep").mkdir()
    assert results.cleared(spark, str(tmp_path / "d"), ("keep",)) == [] and [p.name for p in (tmp_path / "d").iterdir()] == ["keep"]


def test_numbering_without_one_task(spark):
    rows = [(i % 3 if i % 7 else None, i * 37 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, a int, id int")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for parts in (2, 64):
        got = {r["id"]: r["k"] for r in O.numbered(df, ["g", "a", "id"], "k", parts).collect()}
        assert got == {r[2]: n for n, r in enumerate(order, 1)}
    within = {r["id"]: (r["k"], r["n"]) for r in O.ranked_within(df, "g", ["a", "id"], "k", "n").collect()}
    for g in (None, 0, 1, 2):
        own = [r[2] for r in order if r[0] == g]
        assert [within[i] for i in own] == [(n, len(own)) for n in range(1, len(own) + 1)]
    assert O.numbered(df.limit(0), ["a"], "k").collect() == []
    with pytest.raises(KeyError):
        O.sure_lookup(df, df.where("id < 5"), "id", "a", "g")


def test_options_pass(spark):
    grid = O.grid(spark, {"sampling_rate": ["none", "22050", "x"], "denoising": ["none", "Wiener", "wiener"]})
    assert grid.where(O.passes({"sampling_rate": ["22050.0", "22050"], "denoising": []})).count() == 3
    assert grid.where(O.passes({"sampling_rate": ["NONE"], "denoising": ["wiener"]})).count() == 1


def test_entry_without_the_optional_part(tmp_path):
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'signal_profile' in q and 'op1_secret_scan' not in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run(f"cp -r {ROOT}/sonolith {ROOT}/__spark_entry__.py {tmp_path} && rm -rf {tmp_path}/sonolith/llm", shell=True, check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert F and K
