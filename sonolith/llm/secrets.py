"""Secret scans over whole texts, in DataFrame functions only.

Three base rules are regular expressions. The entropy rule looks for what they miss: in every candidate
string (a run of token characters) a window slides by one character; its Shannon entropy comes from
counts that change by one character in and one out per step. Each character class has its own window
threshold. An allow-list suppresses stretches that are no secrets: UUIDs, runs in alphabet order, paths of
words, and what the caller adds; what it leaves without a letter beside a digit (words, numbers) is none either.

Everything is a narrow projection: no shuffle, no Python, one pass over the text; the parts beyond the
first pattern test are computed for matching rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Kind, pattern, group that must be long enough, its least length.
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Patterns that find the same matches of a rule as dropping its short matches does, and faster.
_QUICK = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Character class: pattern of a whole candidate, least window entropy in bits. The first that fits counts.
CLASSES = (("hex", "^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.6), ("base64", "", 3.8))
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)abcdefghijklm|0123456789|aaaaaaaa|00000000|xxxxxxxx|example",
    "(?:[0-9]{0,4}[a-z]{2,}[/_-]){2,64}",
)
_BLOCK = 256


def _running(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs, in blocks so that long arrays stay cheap."""
    none = F.array().cast("array<bigint>")

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("t"), none.alias("xs"))
        step = lambda s, v: F.struct((s.t + v).alias("t"), F.concat(s.xs, F.array(s.t + v)).alias("xs"))
        return F.aggregate(block, start, step, lambda s: s.xs)

    blocks = let(
        values,
        lambda all_: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / F.lit(_BLOCK)).cast("int")),
            lambda b: within(F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK))),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<array<bigint>>").alias("xs"))

    def join(s: Column, block: Column) -> Column:
        return F.struct(
            (s.t + F.element_at(block, -1)).alias("t"),
            F.concat(s.xs, F.array(F.transform(block, lambda v: v + s.t))).alias("xs"),
        )

    return F.flatten(F.aggregate(blocks, start, join, lambda s: s.xs))


_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, stop, text) in code points.

    The pieces between matches and the matches alternate, so their lengths sum up to the positions.
    """

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(between, found, lambda b, m: (F.char_length(b) + F.char_length(m)).cast("long"))
        return F.zip_with(
            _running(steps), found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("stop"), m.alias("text"))
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _rule(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    # A short assign match may swallow a keyword, so only its original pattern has the right matches.
    scan = pattern if group else _QUICK[kind]
    spans = _matches(text, scan)
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        spans = F.zip_with(spans, values, lambda s, v: F.struct(s.start.alias("start"), s.stop.alias("stop"), v.alias("text")))
    spans = F.filter(spans, lambda s: F.char_length(s.text) >= least)
    spans = F.transform(
        spans, lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.stop.alias("stop"), F.lit(kind).alias("kind"))
    )
    return F.when(text.rlike(_QUICK[kind]), spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _term(count: Column) -> Column:
    """count * log2(count), 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _hot(candidate: Column, bits: Column) -> Column:
    """(first, last): starts of the first and last window of at least ``bits`` entropy, null if none.

    The state holds a count for each symbol and the sum of count * log2(count), both kept up to date
    with one symbol in and one out; the window's entropy is log2(WINDOW) - sum / WINDOW.
    """
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def at(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(candidate, i, F.lit(1)))

    def step(s: Column, i: Column) -> Column:
        enter, leave = at(i), F.when(i > WINDOW, at(F.greatest(i - WINDOW, F.lit(1)))).otherwise(0)
        gained, lost = F.element_at(s.counts, enter), F.coalesce(F.get(s.counts, leave - 1), F.lit(0))
        change = F.when(
            enter == leave, F.lit(0.0)
        ).otherwise(_term(gained + 1) - _term(gained) + F.when(leave > 0, _term(lost - 1) - _term(lost)).otherwise(0.0))
        counts = F.transform(
            s.counts, lambda c, j: c + F.when(j + 1 == enter, 1).otherwise(0) - F.when(j + 1 == leave, 1).otherwise(0)
        )
        entropy = math.log2(WINDOW) - (s["sum"] + change) / WINDOW
        hot = (i >= WINDOW) & (entropy >= bits - 1e-9)
        return F.struct(
            counts.alias("counts"),
            (s["sum"] + change).alias("sum"),
            F.when(hot, F.coalesce(s["first"], i - WINDOW)).otherwise(s["first"]).alias("first"),
            F.when(hot, i - WINDOW).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.char_length(candidate)),
        state,
        step,
        lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
    )


def _gaps(taken: Column, start: Column, stop: Column) -> Column:
    """What ``taken`` (sorted by start) leaves of start to stop, as an array of (start, stop)."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(out: Column, a: Column, b: Column) -> Column:
        return F.when(a < b, F.concat(out, F.array(F.struct(a.alias("start"), b.alias("stop"))))).otherwise(out)

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["at"], x.stop).alias("at"), add(s["out"], s["at"], x.start).alias("out"))

    first = F.struct(start.cast("long").alias("at"), none.alias("out"))
    return F.aggregate(taken, first, step, lambda s: add(s["out"], s["at"], stop))


def _cut(s: Column, taken: Column) -> Column:
    """The parts of the match ``s`` outside ``taken``, as matches."""
    return F.transform(
        _gaps(taken, s.start, s.stop),
        lambda g: F.struct(
            g.start.alias("start"), g.stop.alias("stop"), F.substring(s.text, (g.start - s.start + 1).cast("int"), (g.stop - g.start).cast("int")).alias("text")
        ),
    )


def _pieces(runs: Column, base: Column, allowed: str) -> Column:
    """What base spans and matches of ``allowed`` leave of ``runs``, as matches of WINDOW or more characters."""

    def outside_base(s: Column) -> Column:
        return let(F.filter(base, lambda b: (b.start < s.stop) & (s.start < b.stop)), lambda near: F.when(F.size(near) > 0, _cut(s, near)).otherwise(F.array(s)))

    def outside_allowed(s: Column) -> Column:
        found = F.transform(
            _matches(s.text, allowed), lambda m: F.struct((s.start + m.start).alias("start"), (s.start + m.stop).alias("stop"))
        )
        return F.when(s.text.rlike(allowed), _cut(s, found)).otherwise(F.array(s))

    def long(pieces: Column) -> Column:
        return F.filter(F.flatten(pieces), lambda s: s.stop - s.start >= WINDOW)

    return long(F.transform(long(F.transform(runs, outside_base)), outside_allowed))


def _entropy_spans(text: Column, base: Column, allow: tuple[str, ...]) -> Column:
    mixed, allowed = "[A-Za-z][0-9]|[0-9][A-Za-z]", "|".join(f"(?:{a})" for a in allow)
    runs = F.filter(_matches(text, CANDIDATE), lambda s: s.text.rlike(mixed))
    suspects = F.filter(_pieces(runs, base, allowed), lambda s: s.text.rlike(mixed))

    def scored(s: Column) -> Column:
        bits = F.coalesce(*[F.when(s.text.rlike(p), F.lit(t)) for _, p, t in CLASSES])
        hot = _hot(s.text, bits)
        return F.struct(s.start.alias("start"), hot.alias("hot"))

    spans = F.filter(F.transform(suspects, scored), lambda s: s.hot["first"].isNotNull())
    spans = F.transform(
        spans,
        lambda s: F.struct(
            (s.start + s.hot["first"]).alias("start"), F.lit(len(BASE_RULES)).alias("rank"), (s.start + s.hot["last"] + WINDOW).alias("stop"), F.lit("entropy").alias("kind")
        ),
    )
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets", allow: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a column ``into``: array of (start, rank, stop, kind), sorted; code points, end exclusive.

    Kinds are assign, access, hex (leftmost non-overlapping each, short ones dropped) and entropy, which
    never overlaps a base span. Null and empty texts have an empty array, rows are kept as they are, also
    repeated ones; texts of any length are scanned whole; an empty table stays empty; a column that is
    already named ``into`` is replaced. ``allow`` adds patterns to the allow-list of the entropy rule; they
    must match more than the empty string. Base rules are never suppressed. Base spans and allowed
    stretches are cut out of a candidate, and the windows of every piece left are scored, so a secret
    beside them is found. A string of letters only is no candidate, however random.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    taken = {c.lower() for c in docs.columns} | {into.lower()}
    own = [next(n for i in range(9999) if (n := f"_{k}{i}") not in taken) for k in ("base", "secret")]
    base = F.array_sort(F.concat(*[_rule(text, k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE_RULES)]))
    found = docs.withColumn(own[0], base)
    extra = _entropy_spans(text, F.col(own[0]), ALLOW + tuple(allow))
    return found.withColumn(own[1], F.array_sort(F.concat(F.col(own[0]), extra))).drop(
        own[0], *[c for c in docs.columns if c.lower() == into.lower()]
    ).withColumnRenamed(own[1], into)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each (merged) span replaced by ``mark``; texts without spans stay as they are."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x.start - s["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(x.start >= s["at"], F.concat(s.out, gap, F.lit(mark))).otherwise(s.out).alias("out"),
            F.greatest(s["at"], x.stop).alias("at"),
        )

    whole = F.aggregate(
        spans, start, step, lambda s: F.concat(s.out, F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _oracle() -> str:
    """DuckDB SQL for the query over ``documents``: every rule's matches, and the entropy of each window by itself."""

    def sql(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def placed(pattern: str, of: str = "docs") -> str:
        """The columns of ``of`` and f: text t of a match, its first position a in ``text``."""
        found, parts = f"regexp_extract_all(text, {sql(pattern)})", f"string_split_regex(text, {sql(pattern)})"
        return (
            f"(SELECT * EXCLUDE (m, p), unnest(list_transform(m, lambda x, i: {{'t': x, 'a': list_sum(list_transform(p[1:i], lambda y: length(y)))"
            f" + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)}})) AS f"
            f" FROM (SELECT *, {found} AS m, {parts} AS p FROM {of}) WHERE len(m) > 0)"
        )

    def left(of: str, taken: str) -> str:
        """What ``taken`` (row_no, pos, a, b) leaves of ``of`` (row_no, pos, text), as rows of the same columns."""
        return f"""
  SELECT row_no, low AS pos, substr(text, low - pos + 1, high - low) AS text FROM (
    SELECT row_no, pos, text, a AS high, greatest(pos, coalesce(max(b) OVER (
      PARTITION BY row_no, pos ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pos)) AS low
    FROM (SELECT o.*, t.a, t.b FROM {of} o JOIN {taken} t USING (row_no, pos) UNION ALL
          SELECT o.*, pos + length(text), pos + length(text) FROM {of} o))
  WHERE high - low >= {WINDOW}"""

    rules = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_RULES):
        rules.append(
            f"SELECT row_no, {rank} AS rank, '{kind}' AS kind, f.a::BIGINT AS a, (f.a + length(f.t))::BIGINT AS b FROM {placed(pattern)}"
            f" WHERE length(regexp_extract(f.t, {sql(pattern)}, {group})) >= {least}"
        )
    # A match of a pattern for whole pieces takes the piece out; the others' matches are cut out of it.
    allowed = "|".join(f"(?:{p})" for p in ALLOW if not p.startswith("^"))
    whole = " OR ".join(f"regexp_matches(text, {sql(p)})" for p in ALLOW if p.startswith("^"))
    bits = "CASE " + " ".join(f"WHEN regexp_matches(text, {sql(p)}) THEN {t}" for _, p, t in CLASSES) + " END"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k, *_ in BASE_RULES)
    joined_as = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank){}, '')"
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(rules)}),
runs AS (SELECT row_no, f.a::BIGINT AS pos, f.t AS text FROM {placed(CANDIDATE)}),
near AS (SELECT r.row_no, r.pos, b.a, b.b FROM runs r JOIN base b ON b.row_no = r.row_no AND b.a < r.pos + length(r.text) AND r.pos < b.b),
outside AS (FROM ({left("runs", "near")}) WHERE NOT ({whole})),
listed AS (SELECT row_no, pos, (pos + f.a)::BIGINT AS a, (pos + f.a + length(f.t))::BIGINT AS b FROM {placed(allowed, "outside")}),
pieces AS (FROM ({left("outside", "listed")}) WHERE regexp_matches(text, '[A-Za-z][0-9]|[0-9][A-Za-z]')),
hot AS (
  SELECT row_no, pos, list_filter(range(1, length(text) - {WINDOW} + 2),
    lambda i: list_entropy(string_split(substr(text, i, {WINDOW}), '')) >= bits - 1e-9) AS h FROM (SELECT *, {bits} AS bits FROM pieces)),
spans AS (
  FROM base UNION ALL
  SELECT row_no, {len(BASE_RULES)}, 'entropy', (pos + h[1] - 1)::BIGINT, (pos + h[-1] - 1 + {WINDOW})::BIGINT FROM hot WHERE len(h) > 0)
SELECT d.doc_id, {counts}, sha256({joined_as.format(f" FILTER (rank < {len(BASE_RULES)})")}) AS base_sha256, {joined_as.format("")} AS spans
FROM docs d LEFT JOIN spans s ON s.row_no = d.row_no GROUP BY d.doc_id, d.row_no
"""


ORACLE_SQL = _oracle()
