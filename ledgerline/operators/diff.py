"""Record-level differences of two tables on a key, compared as text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, StringType


@dataclass(frozen=True)
class KeyedDiff:
    """joined: one row per pair of records, with key columns, side (both, left_only, right_only), and l_<c>, r_<c> for each compared column c."""

    joined: DataFrame
    keys: list[str]
    columns: list[str]
    skipped: dict[str, str]
    left: DataFrame
    right: DataFrame

    def warnings(self) -> DataFrame:
        """(side, kind, n): records without any key, which match nothing, and keys that occur more than once, whose records all pair with each other."""
        parts = []
        for side, df in (("left", self.left), ("right", self.right)):
            blank = _blank(df, self.keys)
            parts.append(df.where(blank).agg(F.lit(side).alias("side"), F.lit("no key").alias("kind"), F.count("*").alias("n")))
            parts.append(repeated_keys(df.where(~blank), self.keys).agg(F.lit(side).alias("side"), F.lit("repeated key").alias("kind"), F.count("*").alias("n")))
        return reduce(DataFrame.unionByName, parts).where("n > 0")

    def summary(self) -> DataFrame:
        """One row (matched, only_left, only_right, total_mismatches, cols_with_mismatches)."""
        of = lambda s: F.count(F.when(F.col("side") == s, 1))
        per = [F.count(F.when(self._differs(c), 1)) for c in self.columns]
        zero = F.lit(0).cast("long")
        return self.joined.agg(
            of("both").alias("matched"), of("left_only").alias("only_left"), of("right_only").alias("only_right"),
            sum(per, zero).alias("total_mismatches"), sum(((p > 0).cast("long") for p in per), zero).alias("cols_with_mismatches"),
        )

    def by_column(self) -> DataFrame:
        """(column_name, mismatches) of every compared column, from one pass."""
        counts = self.joined.agg(*[F.count(F.when(self._differs(c), 1)).alias(c) for c in self.columns])
        return counts.unpivot([], self.columns, "column_name", "mismatches") if self.columns else counts.sparkSession.createDataFrame([], "column_name string, mismatches bigint")

    def examples(self, n: int = 10) -> DataFrame:
        """(column_name, keys..., left_value, right_value, place): the first n mismatches of each column in order of the key."""
        from pyspark.sql import Window

        long = self.joined.where("side = 'both'").select(*self.keys, F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value")) for c in self.columns]), lambda s: s["left_value"] != s["right_value"])).alias("d"))
        place = F.row_number().over(Window.partitionBy("column_name").orderBy(*self.keys, "left_value", "right_value"))
        return long.select("d.column_name", *self.keys, "d.left_value", "d.right_value").withColumn("place", place).where(F.col("place") <= n)

    def _differs(self, c: str):
        return (F.col("side") == "both") & (F.col(f"l_{c}") != F.col(f"r_{c}"))


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> KeyedDiff:
    """Match records on keys and compare columns as exact text; null is the empty text. Repeated keys pair with each other; records whose keys are all null or blank match nothing.

    Keys of the same type are joined as they are, others as text. Columns that a side lacks or that are keys are skipped, with the reason; a key that a side lacks is an error.
    """
    for side, df in (("left", left), ("right", right)):
        if gone := [k for k in keys if k not in df.columns]:
            raise ValueError(f"key columns missing on {side}: {', '.join(gone)}")
    skipped, compared = {}, []
    for c in columns:
        gone = [side for side, df in (("left", left), ("right", right)) if c not in df.columns]
        if c in keys:
            skipped[c] = "is a primary key"
        elif gone:
            skipped[c] = f"missing on {' and '.join(gone)} side"
        elif c not in compared:
            compared.append(c)
    text = lambda df, c: F.coalesce(df[c].cast("string"), F.lit(""))
    same = {k: left.schema[k].dataType == right.schema[k].dataType and not isinstance(left.schema[k].dataType, StringType | FractionalType) for k in keys}

    def side_of(df: DataFrame, name: str) -> DataFrame:
        # records without a key are told apart by a number of their own, so that they neither meet nor gather in one task
        lone = F.when(_blank(df, keys), F.concat(F.lit(f"{name} "), F.monotonically_increasing_id().cast("string")))
        own = [(df[k] if same[k] else text(df, k)).alias(f"__k{i}") for i, k in enumerate(keys)]
        return df.select(*own, F.coalesce(lone, F.lit("")).alias("__lone"), *[text(df, c).alias(f"{name}_{c}") for c in compared], F.lit(True).alias(f"__{name}"))

    lhs, rhs = side_of(left, "l").alias("l"), side_of(right, "r").alias("r")
    on = [F.col(f"l.__k{i}").eqNullSafe(F.col(f"r.__k{i}")) for i in range(len(keys))] + [F.col("l.__lone") == F.col("r.__lone")]
    side = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
    shown = [F.coalesce(F.when(F.col("__l"), F.col(f"l.__k{i}")).otherwise(F.col(f"r.__k{i}")).cast("string"), F.lit("")).alias(k) for i, k in enumerate(keys)]
    joined = lhs.join(rhs, reduce(lambda a, b: a & b, on), "full_outer").select(*shown, *[f"{s}_{c}" for c in compared for s in "lr"], side.alias("side"))
    return KeyedDiff(joined, list(keys), compared, skipped, left, right)


def _blank(df: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.length(F.trim(F.coalesce(df[k].cast("string"), F.lit("")))) == 0 for k in keys])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
