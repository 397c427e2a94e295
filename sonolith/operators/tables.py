"""Joins, groups, samples, splits and result bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cleaned, composite

#: Columns that name a result row.
RESULT_KEY = (
    "subset", "format", "sampling_rate", "bit_depth", "channels", "amplitude_method", "pre_emphasis", "denoising",
    "segmentation", "augmentation", "model", "domain", "normalized", "selected_top_k",
)
#: Metadata columns that are no features.
METADATA = ("file_id", "file_path", "filename", "class", "label", "group", "Unnamed: 0")


def draw_key(seed: int | str, *ids: Column) -> Column:
    """A pseudo-random order that any engine with md5 repeats."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]).cast("binary"))


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``names`` that are there, in that order."""
    return df.select(*[c for c in names if c in df.columns])


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def features_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in METADATA if c not in keep])


def numbered(df: DataFrame, order: list[str], into: str, parts: int = 64) -> DataFrame:
    """Rows numbered from 1 in ``order`` (ascending, nulls first), without a task that sees them all.

    Rows are cut into ranges at the keys of a small sample, numbered within their range, and shifted by the
    sizes of the ranges before. The sample changes the ranges only, never the numbers.
    """
    key = F.struct(*order)
    cuts = df.select(*order).orderBy(F.rand(7)).limit(parts).distinct()
    cuts = sorted((r[0] for r in cuts.select(F.struct(key.alias("k")).alias("r")).collect()), key=lambda r: tuple((v is not None, v) for v in r["k"]))
    schema = df.select(key.alias("k")).schema["k"].dataType
    types = [f.dataType for f in schema.fields]
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(r["k"], types, order, strict=True)]) for r in cuts])
    rows = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= key)) if cuts else F.lit(0))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    rows = rows.withColumn(into, number).join(sizes.select("_range", before.alias("_before")), "_range")
    return rows.withColumn(into, F.col(into) + F.col("_before")).drop("_range", "_before").select(*[c for c in df.columns if c != into], into)


def ranked_within(df: DataFrame, by: str, order: list[str], into: str, size: str) -> DataFrame:
    """Rows numbered from 1 within their ``by``, and the size of it; a hot value is numbered by many tasks."""
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias(size))  # a row a value
    before = Window.partitionBy(F.lit(0)).orderBy("_by").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_first", F.coalesce(F.sum(size).over(before), F.lit(0)))
    rows = numbered(df, [by, *order], into)
    out = rows.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn(into, F.col(into) - F.col("_first"))
    return out.drop("_by", "_first")


def numbered_groups(df: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """Dense ids by first appearance in ``order``, from 0; -1 for a null key.

    The ids are made on the table of keys (a row each after map-side aggregation) and joined back.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    ids = numbered(firsts, ["_first", key], into).withColumn(into, F.col(into) - 1).drop("_first")
    return df.join(ids, key, "left").withColumn(into, F.coalesce(into, F.lit(-1)).cast("long"))


def prepared_metadata(meta: DataFrame, order: str) -> DataFrame:
    """Recorder and place cleaned, a group key of species, recorder and place, and its number."""
    out = meta.withColumn("rec", cleaned(F.col("rec"), "unknown_rec")).withColumn("loc", cleaned(F.col("loc"), "unknown_loc"))
    out = out.withColumn("group_str", composite(F.col("full_name"), F.col("rec"), F.col("loc")))
    return numbered_groups(out, "group_str", order, "group")


def with_groups(subset: DataFrame, meta: DataFrame, subset_id: str = "file_id", meta_id: str = "id") -> DataFrame:
    """Left join on ids as strings; a repeated metadata id repeats the row."""
    known = meta.select(F.col(meta_id).cast("string").alias("_id"), "group")
    return subset.withColumn(subset_id, F.col(subset_id).cast("string")).join(known, F.col(subset_id) == F.col("_id"), "left").drop("_id")


def lookup(df: DataFrame, side: DataFrame, key: str, value: str, order: str, last: bool = False) -> DataFrame:
    """Left join to one row a key: the first of ``side`` in ``order``, or the last."""
    pick = F.max_by if last else F.min_by
    return df.join(side.groupBy(key).agg(pick(value, order).alias(value)), key, "left")


def unmatched(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Rows that a lookup that must succeed would miss."""
    return df.join(side, key, "left_anti")


def sure_lookup(df: DataFrame, side: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``lookup`` that fails when a row has no match."""
    if missed := unmatched(df, side, key).select(key).first():
        raise KeyError(f"no {value} for {key} {missed[0]!r}")
    return lookup(df, side, key, value, order)


def merged_features(tables: list[DataFrame], key: str = "file_id", shared: tuple[str, ...] = ("class", "group")) -> DataFrame:
    """Full outer join of feature tables on ``key``; shared metadata from the first table that has it;
    missing features are 0."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        both = [c for c in shared if c in a.columns and c in b.columns]
        renamed = b.withColumnsRenamed({c: f"_{c}" for c in both})
        out = a.join(renamed, key, "full")
        for c in both:
            out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
        return out

    out = reduce(join, tables)
    return out.na.fill(0, [c for c in out.columns if c != key and c not in shared])


def appended(existing_rows: DataFrame, new: DataFrame, key=RESULT_KEY) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet; nulls in a key are equal."""
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in key])
    return new.alias("n").join(existing_rows.alias("e"), same, "left_anti")


def merged_results(existing_rows: DataFrame, new: DataFrame, key, order: str) -> DataFrame:
    """Both, one row a key: existing rows win, then the first in ``order``; sorted by key."""
    both = existing_rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(*key).orderBy("_new", order)
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_new").orderBy(*key)


def stratified_sample(df: DataFrame, stratum: str, id_col: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """max(1, min(int(n * share), n - 1)) rows of each stratum, chosen by a seeded hash of the id."""
    rows = ranked_within(df.withColumn("_draw", draw_key(seed, F.col(id_col))), stratum, ["_draw", id_col], "_k", "_n")
    wanted = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1))
    return rows.where(F.col("_k") <= wanted).select(*df.columns)


def capped(df: DataFrame, stratum: str, id_col: str, most: int = 750, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each stratum; tasks keep no more than these before they are exchanged."""
    order = Window.partitionBy(stratum).orderBy(draw_key(seed, F.col(id_col)), id_col)
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def remaining(df: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    return df.join(taken.select(id_col), id_col, "left_anti")


def memberships(species: DataFrame, name_col: str, subsets: list[str]) -> DataFrame:
    """(species, subset) for each 1 in the membership columns."""
    long = species.unpivot([name_col], subsets, "subset", "flag")
    return long.where("flag = 1").select(F.col(name_col).alias("species"), "subset")


def nested_subsets(files: DataFrame, species: DataFrame, subsets: list[str], share: float = 0.15, most: int = 750, seed: int = 42):
    """(testing, subset rows): a test sample of each species, and the capped rest in all its subsets."""
    testing = stratified_sample(files, "species", "file_id", share, seed)
    rest = capped(remaining(files, testing, "file_id"), "species", "file_id", most, seed)
    return testing, rest.join(memberships(species, "species", subsets), "species")


def group_split(df: DataFrame, group: str, share: float = 0.2, seed: int = 42, into: str = "split") -> DataFrame:
    """Whole groups to test: ceil(share * groups) of them; no group is on both sides."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    known = numbered(groups.withColumn("_draw", draw_key(seed, F.col(group))), ["_draw", group], "_k")
    side = F.when(F.col("_k") <= F.ceil(F.lit(groups.count()) * F.lit(share)), "test").otherwise("train")
    return df.join(known.select(group, side.alias(into)), group)


def row_split(df: DataFrame, id_col: str, share: float = 0.2, seed: int = 42, stratum: str | None = None, into: str = "split") -> DataFrame:
    """ceil(share * n) rows to test, of each stratum if there is one."""
    drawn, order = df.withColumn("_draw", draw_key(seed, F.col(id_col))), ["_draw", id_col]
    if stratum:
        rows = ranked_within(drawn, stratum, order, "_k", "_n")
    else:
        rows = numbered(drawn, order, "_k").withColumn("_n", F.lit(df.count()))
    side = F.when(F.col("_k") <= F.ceil(F.col("_n") * F.lit(share)), "test").otherwise("train")
    return rows.select(*[c for c in df.columns if c != into], side.alias(into))


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups on both sides; empty if a split is sound."""
    train, test = (df.where(F.col(split) == s).select(group) for s in ("train", "test"))
    return train.intersect(test)


def folds(df: DataFrame, id_col: str, label: str, k: int = 3, seed: int = 42, into: str = "fold") -> DataFrame:
    """Stratified folds: rows of a label dealt in turn."""
    rows = ranked_within(df.withColumn("_draw", draw_key(seed, F.col(id_col))), label, ["_draw", id_col], "_k", "_n")
    return rows.select(*[c for c in df.columns if c != into], F.pmod(F.col("_k") - 1, F.lit(k)).cast("long").alias(into))


def group_folds(df: DataFrame, group: str, k: int = 3, into: str = "fold") -> DataFrame:
    """Whole groups, largest first, dealt in turn."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    known = numbered(sizes.withColumn("_less", -F.col("_n")), ["_less", group], "_k")
    return df.join(known.select(group, F.pmod(F.col("_k") - 1, F.lit(k)).cast("long").alias(into)), group)


def paged(df: DataFrame, order: list[str], size: int, into: str = "page", first: int = 1) -> DataFrame:
    """Pages of ``size`` rows in order."""
    return numbered(df, order, into).withColumn(into, (F.floor((F.col(into) - 1) / F.lit(size)) + first).cast("long"))


def grid(spark, options: dict[str, list]) -> DataFrame:
    """All combinations of option lists, a column each: constants exploded one after another, no join."""
    out = spark.range(1).select()
    for name, values in options.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(None if v is None else str(v)) for v in values])))
    return out


#: Options compared as numbers, with their types.
NUMERIC_OPTIONS = {"sampling_rate": "int", "bit_depth": "int", "pre_emphasis": "double"}


def passes(allowed: dict[str, list[str]]) -> Column:
    """A combination passes if every option is in its allow-list; an empty list allows all. Numbers are
    compared as numbers, a value that is none must be allowed as none."""
    tests = [F.lit(True)]
    for name, values in allowed.items():
        if not values:
            continue
        texts = [str(v) for v in values]
        none = any(t.lower() == "none" for t in texts)
        off = F.lower(F.col(name)) == "none"
        if name in NUMERIC_OPTIONS:
            kind = NUMERIC_OPTIONS[name]
            numbers = F.array(*[F.lit(t).try_cast(kind) for t in texts])
            same = F.coalesce(F.array_contains(F.filter(numbers, lambda x: x.isNotNull()), F.col(name).try_cast(kind)), F.lit(False))
            tests.append(F.when(off, F.lit(none)).otherwise(same))
        else:
            tests.append(F.when(off, F.lit(none)).otherwise(F.col(name).isin(*texts)))
    return reduce(lambda a, b: a & b, tests)
