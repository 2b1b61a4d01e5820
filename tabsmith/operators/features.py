"""Feature operators fitted on train and applied to test.

Fitted state is always a small aggregate (a count per category, a median, a
mean/std pair, a sorted category list); applying it is a projection or a join
with that aggregate.  All columns are added in one ``withColumns`` per step so
plans stay flat.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import date_parts, is_missing, lenient_double, log1p_clipped, missing_indicator, string_form
from .quality import q
from .ranking import ordinal

# What the distinct values of a column may take, with 16 bytes a value beside its text, for its counts to be broadcast.
FEW_BYTES = 4_000_000
PLAN_KEYS = ("missing_indicators", "datetime_parts", "log1p_columns", "frequency_encode")


@dataclass
class FeaturePlan:
    """E0 spec; unknown keys are ignored and ``transforms_applied`` is only echoed."""

    missing_indicators: list[str] = field(default_factory=list)
    datetime_parts: list[str] = field(default_factory=list)
    log1p_columns: list[str] = field(default_factory=list)
    frequency_encode: list[str] = field(default_factory=list)
    transforms_applied: list[Any] = field(default_factory=list)

    @classmethod
    def from_spec(cls, spec: Mapping[str, Any] | None) -> "FeaturePlan":
        spec = spec or {}
        return cls(
            missing_indicators=list(spec.get("missing_indicators", []) or []),
            datetime_parts=list(spec.get("datetime_parts", []) or []),
            log1p_columns=list(spec.get("log1p_columns", []) or []),
            frequency_encode=list(spec.get("frequency_encode", []) or []),
            transforms_applied=list(spec.get("transforms_applied", []) or []),
        )


def frequency_table(train: DataFrame, col: str) -> DataFrame:
    """J2 fit: (value, count) on the string form (NULL -> 'nan'), partial-aggregated map-side."""
    v = string_form(q(col), train.schema[col].dataType)
    return train.groupBy(v.alias("_fv")).agg(F.count(F.lit(1)).cast("double").alias("_fc"))


def few_values(train: DataFrame, cols: Sequence[str]) -> set[str]:
    """The columns whose distinct string forms take FEW_BYTES at most, estimated in one map-side combined aggregation."""
    forms = [string_form(q(c), train.schema[c].dataType) for c in cols]
    sizes = train.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(forms) for n, f in (("n", F.approx_count_distinct), ("b", lambda x: F.max(F.octet_length(x))))])
    r = sizes.first()
    return {c for i, c in enumerate(cols) if r[f"n{i}"] * ((r[f"b{i}"] or 0) + 16) <= FEW_BYTES}


def apply_frequency(df: DataFrame, col: str, freq: DataFrame, out_col: str | None = None, few: bool = False) -> DataFrame:
    """J2 apply: left join with the per-value counts; unseen values get 0.

    ``freq`` has one row per distinct training value.  ``few``: it is broadcast and no row of ``df`` moves; a shuffle by a
    column of few values would bring each value's rows to one task.  Otherwise the join is shuffled, with skew splitting.
    """
    out_col = out_col or f"{col}__freq"
    v = string_form(q(col), df.schema[col].dataType)
    joined = df.withColumn("_fv", v).join(F.broadcast(freq) if few else freq, "_fv", "left")
    return joined.withColumn(out_col, F.coalesce(F.col("_fc"), F.lit(0.0))).drop("_fv", "_fc")


def apply_feature_plan(
    train: DataFrame, test: DataFrame | None, plan: FeaturePlan, target: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """E0 in the reference's order: missing -> datetime parts -> log1p -> frequency.

    Columns absent from train are skipped; test gets a step only when it has the
    column.  log1p overwrites its source with the numeric parse (D18), so a later
    frequency encoding of that column sees numbers, as in the reference.  The
    target is never transformed (P8).
    """
    tr, te = train, test

    def has(df: DataFrame | None, c: str) -> bool:
        return df is not None and c in df.columns

    for step in PLAN_KEYS:
        cols = [c for c in getattr(plan, step) if c in tr.columns and c != target]
        if not cols:
            continue
        if step == "missing_indicators":
            tr = tr.withColumns({f"{c}__is_missing": missing_indicator(q(c), tr.schema[c].dataType) for c in cols})
            if te is not None:
                te = te.withColumns({f"{c}__is_missing": missing_indicator(q(c), te.schema[c].dataType) for c in cols if has(te, c)})
        elif step == "datetime_parts":
            tr = tr.withColumns({k: v for c in cols for k, v in date_parts(q(c), c, tr.schema[c].dataType).items()})
            if te is not None:
                te = te.withColumns({k: v for c in cols if has(te, c) for k, v in date_parts(q(c), c, te.schema[c].dataType).items()})
        elif step == "log1p_columns":
            tr = tr.withColumns({c: lenient_double(q(c), tr.schema[c].dataType) for c in cols})
            tr = tr.withColumns({f"{c}__log1p": log1p_clipped(q(c)) for c in cols})
            if te is not None:
                tc = [c for c in cols if has(te, c)]
                te = te.withColumns({c: lenient_double(q(c), te.schema[c].dataType) for c in tc})
                te = te.withColumns({f"{c}__log1p": log1p_clipped(q(c)) for c in tc})
        elif step == "frequency_encode":
            few = few_values(tr, cols)
            for c in cols:
                freq = frequency_table(tr, c)
                tr_new = apply_frequency(tr, c, freq, few=c in few)
                if has(te, c):
                    te = apply_frequency(te, c, freq, few=c in few)
                tr = tr_new
    return tr, te


# ---------------------------------------------------------------- imputers / scaling stats
# The values between two bounds that are looked at one by one on the driver; more are halved in further passes.
MEDIAN_BRACKET = 20_000


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median of the non-missing values (mean of the middle two) of every column with a value.

    Each round asks for approximate percentiles around the wanted ranks (all columns in one map-side combined
    aggregation), counts what lies below the bounds, and goes on between them, until the distinct values left
    are few; those come with their counts.  No value is sorted, shuffled or stored.
    """
    value = {c: F.when(~is_missing(q(c), df.schema[c].dataType), q(c).cast("double")) for c in cols}
    ends = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(value.values()) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    state = {c: {"n": ends[f"n{i}"], "below": 0, "lo": ends[f"lo{i}"], "hi": ends[f"hi{i}"], "inside": ends[f"n{i}"]} for i, c in enumerate(cols)}
    state = {c: s for c, s in state.items() if s["n"]}
    between = {c: (value[c] >= F.lit(s["lo"])) & (value[c] <= F.lit(s["hi"])) for c, s in state.items()}
    while wide := [c for c, s in state.items() if s["inside"] > MEDIAN_BRACKET and s["lo"] < s["hi"]]:
        asks = []
        for i, c in enumerate(wide):
            s = state[c]
            ranks = [((s["n"] - 1) // 2 - s["below"]) / s["inside"], (s["n"] // 2 + 1 - s["below"]) / s["inside"]]
            shares = [min(max(r + d, 0.0), 1.0) for r, d in zip(ranks, (-3e-4, 3e-4))]
            asks.append(F.percentile_approx(F.when(between[c], value[c]), F.array(*[F.lit(x) for x in shares]), 10_000).alias(f"b{i}"))
        bounds = df.agg(*asks).first()
        counts = []
        for i, c in enumerate(wide):
            lo, hi = bounds[f"b{i}"]
            inside = between[c] & (value[c] >= F.lit(lo)) & (value[c] <= F.lit(hi))
            counts += [F.count_if(value[c] < F.lit(lo)).alias(f"below{i}"), F.count_if(inside).alias(f"in{i}")]
        seen = df.agg(*counts).first()
        for i, c in enumerate(wide):
            s, (lo, hi) = state[c], bounds[f"b{i}"]
            holds = seen[f"below{i}"] <= (s["n"] - 1) // 2 and seen[f"below{i}"] + seen[f"in{i}"] > s["n"] // 2
            if not holds or seen[f"in{i}"] == s["inside"]:  # no progress by percentiles: take half of the range that holds the ranks
                lo, hi = s["lo"], s["hi"]
                mid = lo + (hi - lo) / 2
                left = df.agg(F.count_if(value[c] <= F.lit(mid)).alias("n"), F.max(F.when(value[c] <= F.lit(mid), value[c])).alias("l"),
                              F.min(F.when(value[c] > F.lit(mid), value[c])).alias("r")).first()
                if left["n"] > s["n"] // 2:
                    hi = left["l"]
                elif left["n"] <= (s["n"] - 1) // 2:
                    lo = left["r"]
                else:  # the two middle values lie on both sides
                    lo, hi = left["l"], left["r"]
                both = df.agg(F.count_if(value[c] < F.lit(lo)).alias("b"), F.count_if((value[c] >= F.lit(lo)) & (value[c] <= F.lit(hi))).alias("i")).first()
                s.update(lo=lo, hi=hi, below=both["b"], inside=both["i"])
                if left["n"] == s["n"] // 2 and s["n"] % 2 == 0:
                    s.update(inside=0, found=(left["l"] + left["r"]) / 2)
            else:
                s.update(lo=lo, hi=hi, below=seen[f"below{i}"], inside=seen[f"in{i}"])
            between[c] = (value[c] >= F.lit(s["lo"])) & (value[c] <= F.lit(s["hi"]))
    out = {}
    open_cols = [c for c, s in state.items() if "found" not in s and s["lo"] < s["hi"]]
    rows = []
    if open_cols:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.when(between[c], value[c]).alias("v")) for c in open_cols])
        rows = df.select(F.explode(pairs).alias("p")).where("p.v is not null").groupBy("p.c", "p.v").count().collect()
    for c, s in state.items():
        if "found" in s or s["lo"] == s["hi"]:
            out[c] = s.get("found", s["lo"])
            continue
        at, picked = s["below"], {}
        for r in sorted((r for r in rows if r["c"] == c), key=lambda r: r["v"]):
            for rank in ((s["n"] - 1) // 2, s["n"] // 2):
                if at <= rank < at + r["count"]:
                    picked[rank] = r["v"]
            at += r["count"]
        out[c] = (picked[(s["n"] - 1) // 2] + picked[s["n"] // 2]) / 2
    return out


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """A6 as a one-row table (median); NULL without values."""
    return df.sparkSession.createDataFrame([(exact_medians(df, [col]).get(col),)], "median double")


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """The most frequent non-missing value, ties -> smallest.  One row: (value, rows).

    Counts are a map-side-combined groupBy; the winner is a global min over the
    per-value aggregate, never a per-row buffer.
    """
    dt = df.schema[col].dataType
    counts = df.where(~is_missing(q(col), dt)).groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    best = counts.agg(F.min(F.struct((-F.col("rows")).alias("neg"), F.col("value"))).alias("b"))
    return best.select(F.col("b.value").alias("value"), (-F.col("b.neg")).alias("rows"))


def mean_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std per column in one aggregation (unpivoted)."""
    aggs, rows = [], []
    for i, c in enumerate(cols):
        v = F.when(~is_missing(q(c), df.schema[c].dataType), q(c).cast("double"))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std_pop")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def standardize(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std_pop; a constant column (std 0) maps to 0."""
    out = {}
    for c, (m, s) in stats.items():
        out[c] = F.lit(0.0) if not s else (q(c).cast("double") - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


# ---------------------------------------------------------------- categorical encoders
def category_index(train: DataFrame, col: str) -> DataFrame:
    """E4/E5 fit: sorted distinct non-null training values -> 0-based code.

    A categorical column can have as many values as rows, so the codes are a
    distributed dense ordinal of the distinct values (range sort + partition
    offsets), not a window over all categories in one task.
    """
    cats = train.where(q(col).isNotNull()).select(q(col).cast("string").alias("_cat")).distinct()
    return ordinal(cats, ["_cat"], ordinal_col="_code").select("_cat", F.col("_code").cast("int").alias("_code"))


def ordinal_encode(df: DataFrame, col: str, index: DataFrame, out_col: str | None = None) -> DataFrame:
    """E5 apply: code of the category; unknown or missing -> -1."""
    out_col = out_col or f"{col}__ord"
    j = df.withColumn("_cat", q(col).cast("string")).join(index, "_cat", "left")
    return j.withColumn(out_col, F.coalesce(F.col("_code"), F.lit(-1))).drop("_cat", "_code")


def one_hot_slots(df: DataFrame, col: str, index: DataFrame, out_col: str | None = None) -> DataFrame:
    """E4 apply, sparse form: the active slot (0-based) or NULL (unknown/missing -> all zeros)."""
    out_col = out_col or f"{col}__slot"
    j = df.withColumn("_cat", q(col).cast("string")).join(index, "_cat", "left")
    return j.withColumnRenamed("_code", out_col).drop("_cat")


def fill_missing(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """E1/E3 apply: replace NULL (and NaN for floats) with the fitted value."""
    out = {}
    for c, v in values.items():
        dt = df.schema[c].dataType
        out[c] = F.when(is_missing(q(c), dt), F.lit(v).cast(dt)).otherwise(q(c))
    return df.withColumns(out)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
