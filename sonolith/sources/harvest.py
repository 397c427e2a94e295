"""Metadata harvesting with an injectable transport, retries as policies, and failed rows kept apart."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a recording that the archive returns.
FIELDS = (
    "id", "gen", "sp", "ssp", "grp", "en", "rec", "cnt", "loc", "lat", "lon", "alt", "type", "sex", "stage", "method", "q", "length",
    "time", "date", "uploaded", "rmk", "animal-seen", "playback-used", "auto", "dvc", "mic", "smp", "file-name",
)
PAGE = 300


@dataclass(frozen=True)
class Retry:
    """When and how long to wait: ``base * 2**attempt`` plus jitter, on the listed codes (none: on any failure)."""

    attempts: int = 8
    base: float = 1.0
    jitter: float = 1.0
    codes: tuple[int, ...] = ()

    def again(self, code: int, attempt: int) -> bool:
        return attempt + 1 < self.attempts and (not self.codes or code in self.codes)

    def wait(self, attempt: int, rng: random.Random) -> float:
        return self.base * 2**attempt + rng.uniform(0, self.jitter)


ANY_FAILURE = Retry(8, 1.0, 1.0)
BUSY_ONLY = Retry(10, 5.0, 0.0, (429, 503))
TRANSPORT = Retry(3, 0.5, 0.0, (429, 500, 502, 503, 504))


def fetched(transport: Callable[[str], tuple[int, dict | None]], key: str, policy: Retry = ANY_FAILURE, sleep=time.sleep, seed: int = 0) -> dict | None:
    """The first recording of a reply, or None. ``transport`` returns a status code and the parsed reply."""
    rng = random.Random(f"{seed}|{key}")
    for attempt in range(policy.attempts):
        code, body = transport(key)
        if code == 200 and body is not None:
            found = body.get("recordings") or []
            return found[0] if found else None
        if not policy.again(code, attempt):
            return None
        sleep(policy.wait(attempt, rng))
    return None


def harvest(ids: DataFrame, transport, policy: Retry = ANY_FAILURE, id_col: str = "id", sleep=time.sleep) -> DataFrame:
    """(id, ok, meta map) for each id; a partition works through its rows in Arrow batches."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in batch[id_col]:
                found = fetched(transport, str(i), policy, sleep)
                rows.append((str(i), found is not None, {k: str((found or {}).get(k) or "") for k in FIELDS}))
            yield pd.DataFrame(rows, columns=["id", "ok", "meta"])

    return ids.select(F.col(id_col).cast("string").alias(id_col)).mapInPandas(run, "id string, ok boolean, meta map<string,string>")


def harvest_rounds(ids: DataFrame, transport, rounds: int = 5, write=None, **kwargs) -> DataFrame:
    """Rounds over what failed so far. ``write(df, round)`` stores a round and returns it as read again, so a
    lost executor repeats no request; without it a round may be computed more than once."""
    done, todo = None, ids
    for n in range(rounds):
        got = harvest(todo, transport, **kwargs)
        got = write(got, n) if write else got
        ok = got.where("ok")
        done = ok if done is None else done.unionByName(ok)
        failed = got.where("NOT ok").select("id")
        if failed.isEmpty():
            return done
        todo = failed
    return done.unionByName(got.where("NOT ok"))


def recordings(df: DataFrame) -> DataFrame:
    """Harvested rows with columns for the fields, and class, author and composite group as the metadata has them."""
    out = df.select("id", "ok", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in FIELDS if k != "id"])
    author = F.when(F.coalesce(F.col("rec"), F.lit("")) == "", "unknown").otherwise(F.col("rec"))
    return out.withColumn("author", author).withColumn("full_name", F.concat_ws(" ", "gen", "sp"))


def pages(n: Column) -> Column:
    """Pages of PAGE recordings that ``n`` take."""
    return F.ceil(n / F.lit(PAGE))


def better_than(quality: Column, than: str = "D") -> Column:
    """A is best."""
    return quality < than


def page_count(n: int) -> int:
    return math.ceil(n / PAGE)
