"""Queries over tables: scans, joins, groups, samples, splits, results, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as O
from .common import query, table

_DRAW = "md5('42|' || {0}::VARCHAR)"


@query("""SELECT page_id, url, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.\\.([^.]*)$', 1)) AS suffix FROM pages
WHERE lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.\\.([^.]*)$', 1)) IN ('wav', 'mp3', 'flac', 'ogg', 'm4a', 'aac', 'html', 'com')""")
def scan_suffix(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", T.suffix(F.col("url")).alias("suffix"))
    return pages.where(F.col("suffix").isin(*T.AUDIO_SUFFIXES["all"], "html", "com"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS name,
CASE WHEN len(string_split(url, '/')) >= 2 THEN string_split(url, '/')[-2] END AS parent,
split_part(regexp_extract(url, '[^/]*$'), '_', 1) AS base_id, ltrim(upper(regexp_extract(url, '[^/]*$')), 'XC') AS recording,
CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS rel FROM pages""")
def path_parts(spark, d):
    url = F.col("url")
    rel = F.when(url.startswith("https://"), F.substring(url, 9, 1 << 30)).otherwise(url)
    return table(spark, d, "pages").select(
        "page_id", T.basename(url).alias("name"), T.parent(url).alias("parent"), T.base_id(T.basename(url)).alias("base_id"),
        T.recording_id(F.upper(T.basename(url))).alias("recording"), rel.alias("rel"),
    )


@query("""WITH q AS (SELECT doc_id, CASE quality WHEN 1 THEN 'A' ELSE 'E' END AS q FROM labels)
SELECT doc_id, q, floor((row_number() OVER (ORDER BY doc_id) - 1) / 300)::BIGINT + 1 AS page,
floor((row_number() OVER (ORDER BY doc_id) - 1) / 50)::BIGINT AS batch FROM q WHERE q < 'D'""")
def quality_page_plan(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("E").alias("q")).where("q < 'D'")
    return O.paged(O.paged(rows, ["doc_id"], 300), ["doc_id"], 50, "batch", 0)


_META = """meta AS (SELECT doc_id, coalesce(lower(trim(source)), 'unknown_rec') AS rec, coalesce(lower(trim(lang)), 'unknown_loc') AS loc, 'sp ' || lang AS full_name FROM documents),
keyed AS (SELECT *, replace(full_name, ' ', '_') || '_' || replace(rec, ' ', '_') || '_' || replace(loc, ' ', '_') AS group_str FROM meta),
firsts AS (SELECT group_str, row_number() OVER (ORDER BY min(doc_id)) - 1 AS grp FROM keyed WHERE group_str IS NOT NULL GROUP BY group_str)"""


def _metadata(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("rec"), F.col("lang").alias("loc"), F.concat(F.lit("sp "), "lang").alias("full_name")
    )
    return O.prepared_metadata(docs, "doc_id")


@query(f"WITH {_META} SELECT doc_id, rec, loc, k.group_str, coalesce(grp, -1)::BIGINT AS \"group\" FROM keyed k LEFT JOIN firsts USING (group_str)")
def metadata_groups(spark, d):
    return _metadata(spark, d).select("doc_id", "rec", "loc", "group_str", "group")


@query(f"""WITH {_META} SELECT l.doc_id::VARCHAR AS file_id, l.quality, coalesce(f.grp, -1)::BIGINT AS "group"
FROM labels l LEFT JOIN keyed k ON k.doc_id = l.doc_id LEFT JOIN firsts f ON f.group_str = k.group_str""")
def subset_group_join(spark, d):
    files = table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    return O.with_groups(files, _metadata(spark, d), meta_id="doc_id").select("file_id", "quality", "group")


@query("SELECT count(*)::BIGINT AS n_missing FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def missing_group(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.where("quality IS NULL").agg(F.count("*").alias("n_missing"))


_RANKED = f"""ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format('doc_id')}, doc_id) AS k,
count(*) OVER (PARTITION BY lang) AS n FROM documents)"""
_TEST = "test AS (SELECT doc_id, lang FROM ranked WHERE k <= greatest(1, least(floor(n * 0.15::DOUBLE), n - 1)))"


def _files(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query(f"WITH {_RANKED}, {_TEST} SELECT * FROM test")
def test_sample(spark, d):
    return O.stratified_sample(_files(spark, d), "lang", "doc_id")


@query(f"WITH {_RANKED}, {_TEST} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM test)")
def remaining_files(spark, d):
    return O.remaining(_files(spark, d), O.stratified_sample(_files(spark, d), "lang", "doc_id"), "doc_id")


@query(f"WITH {_RANKED} SELECT doc_id, lang FROM ranked WHERE k <= 75")
def capped_sample(spark, d):
    return O.capped(_files(spark, d), "lang", "doc_id", 75)


_SPECIES = "species(species, S10, S20, S40) AS (VALUES ('en', 1, 1, 1), ('fr', 0, 1, 1), ('de', 0, 0, 1), ('es', 0, 0, 0))"


def _species(spark):
    return spark.createDataFrame([("en", 1, 1, 1), ("fr", 0, 1, 1), ("de", 0, 0, 1), ("es", 0, 0, 0)], "species string, S10 int, S20 int, S40 int")


@query(f"WITH {_SPECIES} SELECT species, subset FROM (UNPIVOT species ON S10, S20, S40 INTO NAME subset VALUE flag) WHERE flag = 1")
def subset_membership(spark, d):
    return O.memberships(_species(spark), "species", ["S10", "S20", "S40"])


@query(f"""WITH {_RANKED}, {_TEST}, {_SPECIES},
rest AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format('doc_id')}, doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM test)),
m AS (SELECT species, subset FROM (UNPIVOT species ON S10, S20, S40 INTO NAME subset VALUE flag) WHERE flag = 1)
SELECT lang AS species, doc_id AS file_id, subset FROM rest JOIN m ON m.species = rest.lang WHERE k <= 750""")
def nested_subsets(spark, d):
    files = _files(spark, d).select(F.col("lang").alias("species"), F.col("doc_id").alias("file_id"))
    return O.nested_subsets(files, _species(spark), ["S10", "S20", "S40"])[1]


@query("SELECT lang, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS n_groups FROM documents GROUP BY lang")
def species_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_groups"))


_SPLIT = """groups AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
sides AS (SELECT source, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM groups)"""


@query(f"WITH {_SPLIT} SELECT doc_id, source, split FROM documents JOIN sides USING (source)")
def group_split(spark, d):
    return O.group_split(table(spark, d, "documents").select("doc_id", "source"), "source")


@query(f"WITH {_SPLIT}, rows AS (SELECT doc_id, lang, split FROM documents JOIN sides USING (source)) SELECT lang FROM rows WHERE split = 'train' INTERSECT SELECT lang FROM rows WHERE split = 'test'")
def leak_check(spark, d):
    split = O.group_split(table(spark, d, "documents").select("doc_id", "source", "lang"), "source")
    return O.leaks(split, "lang")


@query("""SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id::VARCHAR), vec_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM embeddings""")
def stratified_split(spark, d):
    return O.row_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", stratum="label")


@query("SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || vec_id::VARCHAR), vec_id) <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM embeddings")
def plain_split(spark, d):
    return O.row_split(table(spark, d, "embeddings").select("vec_id"), "vec_id")


@query("SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id::VARCHAR), vec_id) - 1) % 3)::BIGINT AS fold FROM embeddings")
def stratified_folds(spark, d):
    return O.folds(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("""WITH s AS (SELECT source, ((row_number() OVER (ORDER BY count(*) DESC, source) - 1) % 3)::BIGINT AS fold FROM documents GROUP BY source)
SELECT doc_id, source, fold FROM documents JOIN s USING (source)""")
def group_folds(spark, d):
    return O.group_folds(table(spark, d, "documents").select("doc_id", "source"), "source")


def _results(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("price"))
    return orders.where("o_orderstatus = 'F'"), orders.where("price > 100000")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) AS price FROM orders WHERE round(o_totalprice, 2) > 100000 AND o_orderstatus <> 'F'")
def results_append(spark, d):
    old, new = _results(spark, d)
    return O.appended(old, new, ("o_orderkey", "o_orderstatus"))


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) AS price, 0 AS src FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2), 1 FROM orders WHERE round(o_totalprice, 2) > 100000),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY src, o_orderkey) AS n FROM b)
SELECT o_orderkey, o_orderstatus, o_orderpriority, price FROM r WHERE n = 1""")
def results_merge(spark, d):
    old, new = _results(spark, d)
    return O.merged_results(old, new, ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("""WITH a AS (SELECT user_id AS file_id, min(props) AS class, round(avg(value), 6) AS f1 FROM events WHERE event_type < 'f' GROUP BY 1),
b AS (SELECT user_id AS file_id, min(props) AS class, round(max(value), 6) AS f2 FROM events WHERE event_type >= 'f' AND event_type < 's' GROUP BY 1),
c AS (SELECT user_id AS file_id, count(*)::DOUBLE AS f3 FROM events WHERE event_type >= 's' GROUP BY 1)
SELECT coalesce(a.file_id, b.file_id, c.file_id) AS file_id, coalesce(a.class, b.class) AS class, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3
FROM a FULL JOIN b ON a.file_id = b.file_id FULL JOIN c ON c.file_id = coalesce(a.file_id, b.file_id)""")
def merge_feature_tables(spark, d):
    """Three feature tables that share out all events by their type."""
    events = table(spark, d, "events").withColumnRenamed("user_id", "file_id")
    kind = F.col("event_type")
    a = events.where(kind < "f").groupBy("file_id").agg(F.min("props").alias("class"), F.round(F.avg("value"), 6).alias("f1"))
    b = events.where((kind >= "f") & (kind < "s")).groupBy("file_id").agg(F.min("props").alias("class"), F.round(F.max("value"), 6).alias("f2"))
    c = events.where(kind >= "s").groupBy("file_id").agg(F.count("*").cast("double").alias("f3"))
    return O.merged_features([a, b, c])


@query("""SELECT c_custkey, f.status FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey""")
def first_match_lookup(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return O.lookup(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "status", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def lookup_misses(spark, d):
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return O.unmatched(table(spark, d, "orders").select("o_orderkey", "o_custkey"), some, "o_custkey").select("o_orderkey")


_OPTIONS = {
    "sampling_rate": ["none", "22050", "44100"], "bit_depth": ["16", "24"], "pre_emphasis": ["none", "0.95", "0.97"],
    "denoising": ["none", "wiener"], "segmentation": ["none", "time"], "augmentation": ["none"],
}
_VALUES = ", ".join(f"(VALUES {', '.join(f'({v!r})' for v in vs)}) t_{k}({k})" for k, vs in _OPTIONS.items())


@query(f"SELECT {', '.join(_OPTIONS)} FROM {_VALUES}")
def combo_grid(spark, d):
    return O.grid(spark, _OPTIONS)


@query(f"""SELECT {', '.join(_OPTIONS)} FROM {_VALUES}
WHERE try_cast(sampling_rate AS INT) = 22050 AND try_cast(pre_emphasis AS DOUBLE) IN (0.95, 0.97) AND denoising = 'wiener'""")
def combo_filter(spark, d):
    return O.grid(spark, _OPTIONS).where(O.passes({"sampling_rate": ["22050"], "bit_depth": [], "pre_emphasis": [0.95, 0.970], "denoising": ["wiener"]}))


@query(f"""SELECT DISTINCT 'PE' || pre_emphasis || '-D' || upper(substr(denoising, 1, 3)) || '-S' || upper(substr(segmentation, 1, 3)) || '-A' || upper(substr(augmentation, 1, 3)) AS code FROM {_VALUES}""")
def combo_code(spark, d):
    code = T.combo_code(F.col("pre_emphasis"), F.col("denoising"), F.col("segmentation"), F.col("augmentation"))
    return O.grid(spark, _OPTIONS).select(code.alias("code")).distinct()


@query("""SELECT event_id, coalesce(props->>'$.k', props->>'$.ref', '') AS got, 'x/${y}/' || event_type AS raw, 'x/base/' || event_type AS path FROM events""")
def json_and_templates(spark, d):
    props = F.col("props")
    return table(spark, d, "events").select(
        "event_id", F.coalesce(F.get_json_object(props, "$.k"), F.get_json_object(props, "$.ref"), F.lit("")).alias("got"),
        F.concat(F.lit("x/${y}/"), "event_type").alias("raw"), T.template(F.concat(F.lit("x/${y}/"), "event_type"), "y", "base").alias("path"),
    )


@query("SELECT lang, count(*)::BIGINT AS n, coalesce(lang, 'None') || '_' || coalesce(source, 'None') AS composite FROM documents GROUP BY lang, source")
def composite_keys(spark, d):
    docs = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return docs.select("lang", "n", T.composite_text(F.col("lang"), F.col("source")).alias("composite"))
