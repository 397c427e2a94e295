"""All combinations of run options: prepare, extract, train, tune, evaluate by file, record.

Options are a map of lists as the configuration has them. Clips are prepared and each domain's features
are extracted once for a combination and written; every model reads them back. Rows already recorded are
left out before any work on them.
"""

from __future__ import annotations

import json
import time
from itertools import product

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.text import COMBO_FIELDS, COMBO_TAG
from ..sources.results import append_results, cleared
from . import clips, models, tables

#: Option lists of the configuration and the fields of a combination that they fill.
OPTION_LISTS = {
    "formats": "format", "sampling_rates": "sampling_rate", "bit_depths": "bit_depth", "channels": "channels", "amplitude_methods": "amplitude_method",
    "pre_emphasis_coefficients": "pre_emphasis", "denoising_methods": "denoising", "segmentation_methods": "segmentation",
    "augmentation_methods": "augmentation",
}
DOMAINS = (*K.EXTRACTORS, "combined")
#: The model that has features of its own, whatever the domain.
ROCKET = "minirocket"
_KEY = ("file_id", "seg_no")


def combinations(spark: SparkSession, options: dict, subset: str) -> list[dict]:
    """Combinations of the option lists that pass their filters; an option that is left out is none."""
    lists = {field: [v if v is None else str(v) for v in options.get(name) or ["none"]] for name, field in OPTION_LISTS.items()}
    found = tables.grid(spark, lists).where(tables.passes(lists))
    return [{"subset": subset, **r.asDict()} for r in found.collect()]  # a row a combination of options


def tag(combo: dict) -> str:
    return COMBO_TAG % tuple(combo[c] for c in COMBO_FIELDS)


def domain_names(domain: str, parts: list[str] | None = None, rate: int = 8000) -> list[str]:
    """Names of a domain's features in the order of their values, from a short noise; ``parts`` make up combined."""
    noise = np.random.default_rng(0).normal(size=rate)
    if domain == ROCKET:
        return [f"rocket_{i}" for i in range(len(K.minirocket(noise[:100])))]
    if domain == "combined":
        return [n for d in parts or K.EXTRACTORS for n in domain_names(d, None, rate)]
    return sorted(K.EXTRACTORS[domain](noise, rate))


def _values(ready: DataFrame, domain: str) -> DataFrame:
    """(file_id, seg_no, group, label, values) of the clips that have features, values in the order of the names."""
    if domain == ROCKET:
        values = clips.rocket(ready).withColumnRenamed("rocket", "values")
    else:
        values = clips.extracted(ready, [domain]).where("ok")
        values = values.withColumn("values", F.transform(F.array_sort(F.map_entries("features")), lambda e: e.value))
    return values.select(*_KEY, "group", "label", "values")


def _combined(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Full outer join of the domains; a clip that one lacks has zeros there."""
    out, width = parts[0], sizes[0]
    for part, size in zip(parts[1:], sizes[1:], strict=True):
        other = part.withColumnsRenamed({c: f"_{c}" for c in part.columns})
        same = [out[c].eqNullSafe(other[f"_{c}"]) for c in _KEY]
        values = [F.coalesce(c, F.array_repeat(F.lit(0.0), n)) for c, n in (("values", width), ("_values", size))]
        out = out.join(other, same[0] & same[1], "full").select(
            *[F.coalesce(c, f"_{c}").alias(c) for c in (*_KEY, "group", "label")], F.concat(*values).alias("values")
        )
        width += size
    return out


def _vectors(rows: DataFrame, width: int) -> DataFrame:
    whole = F.transform("values", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return rows.where(F.size("values") == width).select(*_KEY, "group", F.col("label").cast("string").alias("label"), array_to_vector(whole).alias("numbers"))


def run_options(
    recordings: DataFrame, options: dict, results_path: str, work: str, subset: str = "S", group: str = "group", seed: int = 42,
    hyperparameters: dict | None = None, trials: int = 50, n_splits: int = 2, notify=None,
) -> list[str]:
    """Runs every combination, domain and model of ``options`` over clips (file_id, label, group, sr, samples).

    Test files are whole groups. A model is tuned if ``hyperparameters`` has a grid for it (model: param_grid),
    scored over ``n_splits`` group-aware splits, fitted again on all training rows and saved below ``work``;
    each test file gets its segments' vote. A row has the 14 key columns, means and deviations over the
    splits, the best parameters, the test scores and the time. What fails is returned and the run goes on;
    an unknown domain fails alone.
    """
    spark = recordings.sparkSession
    combos = combinations(spark, options, subset)
    domains = [str(d) for d in options.get("feature_extractors") or DOMAINS]
    names = [str(m) for m in options.get("model_names") or ["random_forest"]]
    normalized, top_k = bool(options.get("normalize", False)), int(options.get("top_k_features") or 50) if options.get("select") else None
    method = str(options.get("selection_method") or "f_classif")
    split, failures, done = tables.group_split(recordings, group, seed=seed), [], 0
    total = len(combos) * len(domains) * len(names)
    for combo in combos:
        at = f"{work}/{tag(combo)}"
        tasks = [(d, m) for d, m in product(domains, names) if not _recorded(spark, results_path, _key(combo, d, m, normalized, top_k))]
        if not tasks:
            continue
        try:
            for side in ("train", "test"):
                cleared(spark, f"{at}/{side}")  # features of another run's clips
                ready = clips.pipeline(split.where(F.col("split") == side), clips.option_steps(combo, side == "train"))
                if "status" in ready.columns:
                    ready = clips.split_status(ready)[0]
                if "seg_no" not in ready.columns:
                    ready = ready.withColumn("seg_no", F.lit(1))
                ready.withColumn("group", F.col(group)).select(*_KEY, "group", "label", "sr", "samples").write.mode("overwrite").parquet(f"{at}/{side}/clips")
        except Exception as e:
            failures.append(f"{tag(combo)}: {e}")
            continue
        for domain in dict.fromkeys(d for d, _ in tasks):
            own = [m for d, m in tasks if d == domain]
            try:
                parts = [d for d in domains if d in K.EXTRACTORS] or list(K.EXTRACTORS)
                sources = {ROCKET} if set(own) == {ROCKET} else {domain} if ROCKET not in own else {domain, ROCKET}
                sides = {s: {side: _stored(spark, at, side, s, parts) for side in ("train", "test")} for s in sources}
            except Exception as e:
                failures.append(f"{tag(combo)} {domain}: {e}")
                continue
            for model in own:
                try:
                    source = ROCKET if model == ROCKET else domain
                    columns = domain_names(source, parts)
                    train, test = (_vectors(sides[source][side], len(columns)) for side in ("train", "test"))
                    if train.isEmpty() or test.isEmpty():
                        raise ValueError("a side has no clip with features")
                    began = time.time()
                    grid = ((hyperparameters or {}).get(model) or {}).get("param_grid")
                    params = {k: v for k, v in ((options.get("models") or {}).get(model) or {}).items() if k != "n_jobs"}
                    fit, scores, best = models.train_monte_carlo(
                        train, columns, "file_id", model, n_splits, "group", seed, grid=grid, trials=trials, save_to=f"{at}/models/{model}_{domain}",
                        top_k=top_k, method=method, scale=normalized, vector="numbers", **params,
                    )
                    took = time.time() - began
                    tested = models.evaluated(fit, test, key="file_id").select(
                        *[F.col(c).alias(f"test_{'f1_score' if c == 'f1' else c}") for c in ("accuracy", "precision", "recall", "f1")]
                    )
                    row = scores.join(tested, F.lit(True)).withColumns({"best_params": F.lit(json.dumps(best, sort_keys=True)), "train_time_sec": F.lit(took)})
                    key = _key(combo, domain, model, normalized, top_k)
                    kinds = {"normalized": "boolean", "selected_top_k": "int"}
                    row = row.select(*[F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in key.items()], *row.columns)
                    append_results(row, results_path)
                    done += 1
                    if notify:
                        notify(f"{done}/{total} {tag(combo)} {domain} {model}")
                except Exception as e:
                    failures.append(f"{tag(combo)} {domain} {model}: {e}")
    return failures


def _key(combo: dict, domain: str, model: str, normalized: bool, top_k: int | None) -> dict:
    every = combo | {"model": model, "domain": domain, "normalized": normalized, "selected_top_k": top_k}
    return {k: every[k] for k in tables.RESULT_KEY}


def _recorded(spark: SparkSession, path: str, key: dict) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False
    same = F.lit(True)
    for k, v in key.items():
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return not spark.read.parquet(path).where(same).isEmpty()


def _stored(spark: SparkSession, at: str, side: str, domain: str, parts: list[str]) -> DataFrame:
    """A domain's features of one side, extracted and written when first asked for."""
    path = f"{at}/{side}/{domain}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        if domain == "combined":
            found = _combined([_stored(spark, at, side, d, parts) for d in parts], [len(domain_names(d)) for d in parts])
        elif domain in K.EXTRACTORS or domain == ROCKET:
            found = _values(spark.read.parquet(f"{at}/{side}/clips"), domain)
        else:
            raise ValueError(f"unknown domain {domain}")
        found.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
