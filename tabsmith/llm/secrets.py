"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns (assignment, access key, long hexadecimal run) give spans by position; a wider
pattern adds candidate tokens.  The SHA-256 of every candidate value is aggregated over the
whole corpus: distinct repositories and distinct owners that hold it.  Without a column that names the
repository each distinct text is one, with the least owner of its copies, so copies of a text do not make
its values common.  A value of few owners and repositories is owner-specific and looks live; one that many
hold is a copied example.
A wider candidate that looks live becomes a span of kind ``live``; base spans always stay.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the lengths of the
pieces and the matches alternate, and their running sum (by blocks, so that a text of very many matches
takes time in proportion) is the position in code points.

Defined results: a null text is empty; a null repository or owner counts as one value of its own;
repeated rows are judged row by row and count once per repository; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

SALTS = 16
MAX_LIVE_OWNERS = 1
MAX_LIVE_REPOS = 3
MASK = "[SECRET]"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# Maximal runs: the shorter matches that the rule drops never begin a longer one, so the bound can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
WIDE = "[A-Za-z0-9+/_-]{20,}"
MIN_DISTINCT_CHARS = 10


BLOCK = 64


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside a lambda an outer expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, add, levels: int = 3) -> Column:
    """For every element the total of those before it (0 for the first): totals of blocks, then inside a block, in ``levels`` levels."""
    total = lambda part: F.aggregate(part, F.lit(0), add)
    if levels == 1:
        return F.transform(values, lambda _, i: total(F.slice(values, F.lit(1), i)))
    blocks = F.floor(F.size(values) / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), blocks), lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    at = lambda i: F.floor(i / BLOCK).cast("int")
    inside = lambda first, i: total(F.concat(F.array(F.get(first, at(i))), F.slice(values, at(i) * BLOCK + 1, F.pmod(i, F.lit(BLOCK)))))
    firsts = _let(sums, lambda s: _before(s, add, levels - 1))
    return _let(firsts, lambda first: F.transform(values, lambda _, i: inside(first, i)))


def _matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """array<struct(start, kind, end, value)> of the leftmost non-overlapping matches, positions in code points."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), gaps.alias("gaps"))

    def placed(f: Column) -> Column:
        steps = F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["whole"])), f["whole"], lambda g, m: g + F.char_length(m))
        return _let(_let(steps, lambda s: _before(s, lambda a, x: a + x)), lambda before: F.transform(f["whole"], lambda m, i: span(f, before, m, i)))

    def span(f: Column, before: Column, m: Column, i: Column) -> Column:
        start = F.get(before, i) + F.get(f["gaps"], i)
        value = F.regexp_extract(m, pattern, group) if group else m
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(m)).alias("end"), value.alias("value"))

    return F.when(text.rlike(pattern), _let(found, placed))


def _looks_random(value: Column) -> Column:
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_remove(F.array_distinct(F.split(value, "")), "")) >= MIN_DISTINCT_CHARS)
    )


KINDS = ("assign", "access", "hex", "live")


def find_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, wider candidates) as arrays of struct(start, kind, end, value), each sorted by start and kind."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= 12)
    access = _matches(text, ACCESS, 1, 0)
    runs = _matches(text, HEX, 2, 0)
    wide = F.filter(_matches(text, WIDE, 3, 0), lambda s: _looks_random(s["value"]))
    base = F.array_sort(F.concat(*(F.coalesce(x, none) for x in (assign, access, runs))))
    return base, F.coalesce(wide, none)


def _span_text(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of rows (hash, repo, owner): copies of one repository count once, with their least owner."""
    repos = candidates.groupBy("hash", "repo").agg(F.min("owner").alias("owner"))
    return repos.groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def scan_secrets(
    spark: SparkSession,
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    repo: str | None = None,
    owner: str = "source",
    max_live_owners: int = MAX_LIVE_OWNERS,
    max_live_repos: int = MAX_LIVE_REPOS,
) -> DataFrame:
    """The columns ``keep`` of every row as the struct ``doc`` with ``base``, ``spans`` (arrays of spans) and ``n_shared``, the number of its
    candidate values that are widely copied.

    ``repo`` and ``owner`` name the columns that say where a row comes from; without ``repo`` each distinct text is a repository.
    """
    missing = F.lit("\x00null")
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), missing)
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base, wide = find_spans(value)
    place = named(repo) if repo else F.sha2(value.cast("binary"), 256)
    doc = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(doc.alias("doc"), base.alias("base"), wide.alias("wide"), place.alias("repo"), named(owner).alias("owner"))
    any_span = (F.size("base") > 0) | (F.size("wide") > 0)
    rows = cut(spark, rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = rows.where(any_span)
    one = some.select("row", "repo", "owner", F.explode(F.concat("base", "wide")).alias("span"))
    one = one.withColumn("hash", F.sha2(F.col("span.value").cast("binary"), 256))
    shared = (F.col("n_owners") > max_live_owners) | (F.col("n_repos") > max_live_repos)
    verdict = ownership(one).select("hash", shared.alias("shared"))
    # A value may stand in a third of all rows: its verdict is copied to SALTS keys and the rows spread over them.
    salted = one.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    spread = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    judged = salted.join(spread, ["hash", "salt"]).groupBy("row").agg(
        F.collect_list(F.when((F.col("span.kind") == 3) & ~F.col("shared"), F.col("span"))).alias("live"),
        F.count_distinct(F.when(F.col("shared"), F.col("hash"))).alias("n_shared"),
    )
    # Rows without a span, nearly all, are not moved.
    with_any = some.join(judged, "row").select("doc", "base", F.array_sort(F.concat("base", "live")).alias("spans"), "n_shared")
    return with_any.union(rows.where(~any_span).select("doc", "base", F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_shared")))


def secret_report(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """One row per document: span counts by kind, digest of the base spans, all spans, copied candidates."""
    found = scan_secrets(spark, docs, ["doc_id"], **kw)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == 3)).cast("long").alias("n_live"),
        F.col("n_shared").cast("long").alias("n_shared"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span (sorted by start) as ``mask``; one that begins inside an earlier one only lengthens it."""
    parts = F.struct(F.split(text, "").alias("chars"), spans.alias("spans"), _let(F.transform(spans, lambda s: s["end"]), lambda ends: _before(ends, lambda a, x: F.greatest(a, x))).alias("done"))

    def joined(p: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            done = F.get(p["done"], i)
            kept = F.slice(p["chars"], done + 1, F.greatest(s["start"] - done, F.lit(0)))
            return F.when(s["start"] >= done, F.concat(F.array_join(kept, ""), F.lit(mask))).otherwise(F.lit(""))

        last = F.aggregate(p["spans"], F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        tail = F.slice(p["chars"], last + 1, F.size(p["chars"]))
        return F.concat(F.array_join(F.transform(p["spans"], piece), ""), F.array_join(tail, ""))

    return _let(parts, joined)


def redact_secrets(spark: SparkSession, docs: DataFrame, mask: str = MASK, **kw) -> DataFrame:
    """The documents, all rows and columns, with every span of their texts replaced by ``mask``; ``n_chars`` follows."""
    found = scan_secrets(spark, docs, docs.columns, **kw)
    any_span = F.size("spans") > 0
    clean = F.when(any_span, _masked(F.col("doc.text"), F.col("spans"), mask)).otherwise(F.col("doc.text"))
    found = found.select("doc", any_span.alias("any_span"), clean.alias("clean"))
    cols = []
    for c in docs.columns:
        old = F.col(f"doc.`{c}`")
        if c == "text":
            old = F.col("clean")
        elif c == "n_chars":
            old = F.when(F.col("any_span"), F.char_length("clean").cast("long")).otherwise(old)
        cols.append(old.alias(c))
    return found.select(*cols)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_kind(kind: int, pattern: str, group: int) -> str:
    return (
        f"select r, {kind} as kind, unnest(regexp_extract_all(t, {_sql_text(pattern)}, 0)) as m,"
        f" unnest(regexp_extract_all(t, {_sql_text(pattern)}, {group})) as v,"
        f" unnest(list_resize(string_split_regex(t, {_sql_text(pattern)}), len(regexp_extract_all(t, {_sql_text(pattern)}, 0)))) as gap,"
        f" unnest(range(len(regexp_extract_all(t, {_sql_text(pattern)}, 0)))) as i from d"
    )


REPORT_SQL = f"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
m as ({' union all '.join(_sql_kind(*k) for k in ((0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0), (3, WIDE, 0)))}),
s as (
  select r, kind, v, i, length(m) as n, sum(length(gap) + length(m)) over (partition by r, kind order by i) as e from m),
c as (
  select r, kind, v, cast(e - n as bigint) as a, cast(e as bigint) as b from s
  where kind in (1, 2) or kind = 0 and length(v) >= 12
     or kind = 3 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
        and len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT_CHARS}),
repo as (select v, t, min(coalesce(source, chr(1))) as owner from c join d using (r) group by v, t),
own as (select v, count(*) as repos, count(distinct owner) as owners from repo group by v),
j as (
  select c.*, own.owners > {MAX_LIVE_OWNERS} or own.repos > {MAX_LIVE_REPOS} as shared,
         ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || b as span
  from c join own using (v)),
g as (
  select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         count(*) filter (kind = 3 and not shared) as n_live, count(distinct v) filter (shared) as n_shared,
         string_agg(span, ',' order by a, kind) filter (kind < 3) as base,
         string_agg(span, ',' order by a, kind) filter (kind < 3 or not shared) as spans
  from j group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_live, 0) as n_live, coalesce(n_shared, 0) as n_shared
from d left join g using (r)
"""
