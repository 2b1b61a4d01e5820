"""Quality rules as a learned decision list over text statistics.

Statistics of every text are counted in one pass.  On labelled statistics a decision list is
learned by sequential covering: a rule for low quality starts empty and grows by the threshold
condition of most information gain on two thirds of the rows; it is pruned from its end
while the other third says so; the rows it covers leave, and the next rule is grown, until a pruned rule
is not precise enough.  The list becomes one ordered Spark ``CASE WHEN`` expression, readable and evaluated
in the JVM.

Labelled rows with equal statistics and verdict are one row with a weight, so a document that stands in a third of all rows, or has
as many labels, is one row and loses none of its weight.  The distinct rows for learning are bounded: of more than ``max_labels``, the
share ``max_labels`` / n by a hash of their statistics and verdict; statistics and verdicts of texts cover all rows.

Defined results: a null text has no words; labels that are null or have no document teach
nothing; without labels of both kinds the list is empty and keeps all that the base rule keeps; repeated
rows are judged row by row and, if labelled, count as often as they occur; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

MAX_LABELS = 30_000
MAX_RULES = 12
MAX_CONDITIONS = 4
THRESHOLDS = 48
MIN_PRECISION = 0.85
MIN_COVER = 5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_stops",
)
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
    "words_per_stop": ("n_words", "n_stops"),
}
FEATURES = ("n_words", *RATIOS)

_SYMBOLS = "#*$%&|<>"
_UPPER = re.compile("[A-Z]+")
_DIGITS = re.compile("[0-9]+")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    repeated = 0
    ids = [number.setdefault(w, len(number)) for w in words]
    if n >= 3:
        a = np.array(ids, dtype=np.int64)
        key = (a[:-2] * len(number) + a[1:-1]) * len(number) + a[2:] if len(number) < 2_000_000 else None
        if key is None:  # the product would not fit in 64 bits: number the pairs first
            pair = np.unique(a[:-2] * len(number) + a[1:-1], return_inverse=True)[1].astype(np.int64)
            key = pair * len(number) + a[2:]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        if same.any():
            twice = np.zeros(len(key), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, dtype=bool)
            for k in range(3):
                cover[k : k + len(key)] |= twice
            repeated = int(cover.sum())
    return (
        n,
        chars,
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(number),
        sum(map(len, _UPPER.findall(text))),
        sum(map(len, _DIGITS.findall(text))),
        sum(map(text.count, ".!?")),
    )


def counts_column(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([text_counts(t) for t in batch.tolist()], columns=list(COUNTS))

    return count(text)


def feature_columns() -> dict[str, Column]:
    """FEATURES as expressions over the columns COUNTS; a ratio without a divisor is 0."""
    out = {"n_words": F.col("n_words").cast("double")}
    for name, (a, b) in RATIOS.items():
        out[name] = F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        c = features[self.feature]
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = list[Condition]


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> Rule:
    """Conditions of most gain (positives kept times the rise in log precision), until no negative is covered."""
    rule, inside = [], weight > 0
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int(weight[inside & bad].sum()), int(weight[inside & ~bad].sum())
        if not p0 or not n0:
            break
        best = None
        y, w = bad[inside], weight[inside]
        for f, v in x.items():
            values = v[inside]
            # thresholds by distinct rows, not by weight: a hot row would leave none for the others
            for t in np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS), method="nearest")):
                for above in (True, False):
                    hit = values >= t if above else values <= t
                    p = int(w[hit & y].sum())
                    n = int(w[hit].sum()) - p
                    if p and p + n < p0 + n0:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, Condition(f, above, float(t)))
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _worth(inside: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """The weights of low and of other quality in a part."""
    return int(weight[inside & bad].sum()), int(weight[inside & ~bad].sum())


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on rows it was not grown on; the longer on a tie."""
    best = (-2.0, rule)
    for k in range(1, len(rule) + 1):
        p, n = _worth(_covered(rule[:k], x), bad, weight)
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best[0]:
            best = (worth, rule[:k])
    return best[1]


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray | None = None, seed: int = 7) -> list[Rule]:
    """An ordered list of rules for low quality, by sequential covering; each row counts ``weight`` times (once by default).

    About two thirds of each row's weight grow rules, the rest prunes them.
    """
    rules: list[Rule] = []
    weight = np.ones(len(bad), dtype=np.int64) if weight is None else weight
    left = weight > 0
    growing = np.random.default_rng(seed).binomial(weight, 2 / 3)
    pruning = weight - growing
    while len(rules) < MAX_RULES and (left & bad).any() and (left & ~bad).any():
        rule = _grow(x, bad, growing * left)
        if not rule:
            break
        if (pruning * left).any():
            rule = _prune(rule, x, bad, pruning * left)
        inside = _covered(rule, x) & left
        p, n = _worth(inside, bad, weight)
        hp, hn = _worth(inside, bad, pruning)
        if p < MIN_COVER or p < MIN_PRECISION * (p + n) or hp < MIN_PRECISION * (hp + hn):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def rules_column(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, from 1, or 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column(features)
        for c in rule[1:]:
            cond = cond & c.column(features)
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, r)) + " -> drop" for r in rules]


def fit(counted: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """Learn from rows of ``counted`` (doc_id, COUNTS) that ``labels`` (doc_id, quality) covers and that the base rule lets pass."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id", (F.col("quality") == 0).alias("bad"))
    known = known.agg(F.count(F.lit(1)).alias("n_labels"))
    texts = counted.where(~base_failed()).groupBy("doc_id", *COUNTS).agg(F.count(F.lit(1)).alias("n_rows"))
    weight = F.sum(F.col("n_labels") * F.col("n_rows")).alias("weight")
    rows = texts.join(known, "doc_id").select("*", *(c.alias(f"f_{f}") for f, c in feature_columns().items()))
    names = [f"f_{f}" for f in FEATURES]
    rows = cut(rows.sparkSession, rows.groupBy("bad", *names).agg(weight), "labelled")
    n = rows.count()
    if n > max_labels:  # a share by hash: no sort, and what comes to the driver is bounded
        place = (F.xxhash64("bad", *names) / F.lit(2.0**64)) + 0.5
        rows = rows.where(place < max_labels / n)
    got = rows.toPandas().sort_values([*names, "bad"], ignore_index=True)  # the same rows give the same rules in any order
    if not len(got):
        return []
    x = {f: got[f"f_{f}"].to_numpy() for f in FEATURES}
    return learn_rules(x, got["bad"].to_numpy(dtype=bool), got["weight"].to_numpy(dtype=np.int64))


def quality_report(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: its counts, the base verdict, the number of the rule that drops it (0: none) and the verdict."""
    small_batches(spark)
    counted = docs.select("doc_id", counts_column(F.col("text")).alias("c")).select("doc_id", *(F.col(f"c.{c}") for c in COUNTS))
    counted = cut(spark, counted, "counts")
    rule = rules_column(fit(counted, labels, max_labels), feature_columns())
    return counted.select(
        "doc_id",
        *COUNTS[:5],
        base_failed().alias("base_failed"),
        (~base_failed() & (rule == 0)).alias("kept"),
        F.when(base_failed(), F.lit(0)).otherwise(rule).alias("dropped_by"),
    )
