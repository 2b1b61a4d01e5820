"""Preprocessing fitted on a training side and shared by all candidates of a fold.

Numbers: exact median for the missing ones, mean and population deviation for the scaled
form.  Categories: the most frequent value for the missing ones, then the position among the sorted
training values; a value that training has not seen is -1 (codes) or all zeros (one-hot).
All statistics of a kind come from one aggregation over all columns; codes are a distributed
ordinal, so a category may have any number of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import exact_medians, mean_std
from ..operators.profile import is_numeric_type
from ..operators.quality import q
from ..operators.ranking import ordinal

LINEAR, TREE = "features_linear", "features_tree"
# A category with more training values than this enters the linear form by its code: a model keeps one weight per slot on the driver.
ONE_HOT_MAX_VALUES = 1_000


@dataclass
class Columns:
    numeric: list[str]
    categorical: list[str]
    text: str | None = None


def split_columns(schema_fields: Sequence, exclude: Sequence[str], text_columns: Sequence[str] = ()) -> Columns:
    """Numbers and categories by type; free text is no category."""
    left = [f for f in schema_fields if f.name not in {*exclude, *text_columns}]
    simple = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return Columns(
        [f.name for f in left if is_numeric_type(f.dataType)],
        [f.name for f in left if not is_numeric_type(f.dataType) and isinstance(f.dataType, simple)],
    )


def _value(col: str):
    return q(col).cast("string")


@dataclass
class Preprocessor:
    columns: Columns
    medians: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    codes: DataFrame | None = None
    one_hot: bool = True
    one_hot_max: int = ONE_HOT_MAX_VALUES

    @classmethod
    def fit(cls, train: DataFrame, columns: Columns, *, one_hot: bool = True, one_hot_max: int = ONE_HOT_MAX_VALUES) -> "Preprocessor":
        p = cls(columns, one_hot=one_hot, one_hot_max=one_hot_max)
        if columns.numeric:
            p.medians = exact_medians(train, columns.numeric)
            filled = p.fill(train.select(*[q(c) for c in columns.numeric]))
            p.scales = {r["column"]: (r["mean"], r["std_pop"]) for r in mean_std(filled, columns.numeric).collect()}
        if columns.categorical:
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), _value(c).alias("value")) for c in columns.categorical])
            counts = train.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")
            counts = counts.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            placed = ordinal(counts, ["column", "value"], ordinal_col="at")  # one checkpointed table of distinct values
            per = placed.groupBy("column").agg(
                F.min("at").alias("first"), F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best")
            )
            found = per.collect()  # one row per column
            p.modes = {r["column"]: r["best"]["value"] for r in found}
            p.sizes = {r["column"]: r["size"] for r in found}
            first = {r["column"]: r["first"] for r in found}
            offset = F.coalesce(*[F.when(F.col("column") == c, F.lit(v)) for c, v in first.items()]) if first else F.lit(0)
            p.codes = placed.select("column", "value", (F.col("at") - offset).cast("int").alias("code"))
        return p

    def fill(self, df: DataFrame) -> DataFrame:
        """Numbers as doubles, missing ones by the median (a column without any value by 0)."""
        out = {}
        for c in self.columns.numeric:
            v = q(c).cast("double")
            out[c] = F.when(v.isNull() | F.isnan(v), F.lit(self.medians.get(c, 0.0))).otherwise(v)
        return df.withColumns(out) if out else df

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the vectors LINEAR (scaled numbers, one-hot) and TREE (numbers, codes)."""
        nums, cats = self.columns.numeric, self.columns.categorical
        out = self.fill(df)
        scaled = {}
        for c in nums:
            mean, std = self.scales[c]
            scaled[f"{c}__scaled"] = (q(c) - F.lit(mean or 0.0)) / F.lit(std) if std else F.lit(0.0)
        out = out.withColumns(scaled) if scaled else out
        slots, linear = {}, list(scaled)
        for c in cats:
            index = self.codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            out = out.withColumn("_value", F.coalesce(_value(c), F.lit(self.modes.get(c))))
            out = out.join(index, "_value", "left").drop("_value")  # AQE broadcasts a small index
            out = out.withColumn(f"{c}__code", F.coalesce("_code", F.lit(-1)).cast("double")).drop("_code")
            n = self.sizes.get(c, 0)
            if n and self.one_hot and n <= self.one_hot_max:
                # the slot after the last one stands for unknown values and is dropped by the encoder
                out = out.withColumn(f"{c}__slot", F.when(F.col(f"{c}__code") < 0, F.lit(float(n))).otherwise(F.col(f"{c}__code")))
                slots[c] = n
                linear.append(f"{c}__onehot")
            else:
                linear.append(f"{c}__code")
        if slots:
            ins = [f"{c}__slot" for c in slots]
            sizes = df.sparkSession.createDataFrame([tuple(float(n - 1) for n in slots.values())], ", ".join(f"`{c}` double" for c in ins))
            encoder = OneHotEncoder(inputCols=ins, outputCols=[f"{c}__onehot" for c in slots], dropLast=True, handleInvalid="keep")
            out = encoder.fit(sizes).transform(out)
        tree = [*nums, *[f"{c}__code" for c in cats]]
        if not tree:
            return out
        out = VectorAssembler(inputCols=linear, outputCol=LINEAR).transform(out)
        return VectorAssembler(inputCols=tree, outputCol=TREE).transform(out)
