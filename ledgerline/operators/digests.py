"""Record differences by digests: parts of the key space in which both tables say the same are told by a few numbers, and never joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.diff import KeyedDiff, _blank, keyed_diff

#: The parts of each level, as bits of the keys' hashes. The driver and every task hold at most 2**LEVELS[-1] numbers.
LEVELS = (10, 18)


def _key(df: DataFrame, keys: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(df[k].cast("string"), F.lit("")) for k in keys])


def _digests(df: DataFrame, columns: list[str], bits: int, name: str) -> DataFrame:
    """(part, n, a, b) of rows with the column __key: counts, and sums of two hashes of each row, in whatever order the rows come."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    of = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.col("__key"), *texts).cast("decimal(20,0)"))
    return df.groupBy(F.shiftrightunsigned("__key", 64 - bits).alias("part")).agg(F.count("*").alias(f"n_{name}"), of(1).alias(f"a_{name}"), of(2).alias(f"b_{name}"))


def _within(df: DataFrame, parts: DataFrame | None, bits: int) -> DataFrame:
    return df if parts is None else df.join(F.broadcast(parts), F.shiftrightunsigned("__key", 64 - bits) == F.col("part"), "left_semi")


class DigestDiff:
    """found: keyed_diff() of the records in parts that differ; same: how many records the other parts hold on either side; parts: of each level how many parts differ."""

    def __init__(self, found: KeyedDiff, same: int, parts: list[int]):
        self.found, self.same, self.parts = found, same, parts

    def summary(self) -> DataFrame:
        """As KeyedDiff.summary(): records of equal parts count as matched."""
        return self.found.summary().withColumn("matched", F.col("matched") + F.lit(self.same))

    def by_column(self) -> DataFrame:
        return self.found.by_column()

    def examples(self, n: int = 10) -> DataFrame:
        return self.found.examples(n)


def digest_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], levels: tuple[int, ...] = LEVELS) -> DigestDiff:
    """keyed_diff() without shuffling the records that are the same.

    Keys are hashed, and the hashes cut into 2**levels[0] parts; of each part and side only a count and two sums of row hashes are shuffled. Parts that differ are cut further, level by level, and the
    records in what differs in the end are compared as keyed_diff() does; records without a key, which match nothing, are compared with them. That pays where few records differ: every level reads
    the tables once more. Keys are to be unique: of repeated ones (see warnings()) equal parts count records, not pairs of them. Two parts that differ pass for equal once in 2**128.
    """
    probe = keyed_diff(left, right, keys, columns)
    compared, spark = probe.columns, left.sparkSession
    sides = [df.where(~_blank(df, keys)).withColumn("__key", _key(df, keys)) for df in (left, right)]
    same, counts, parts, before = 0, [], None, 0
    for bits in levels:
        own = [_digests(_within(df, parts, before), compared, bits, n) for df, n in zip(sides, "lr", strict=True)]
        both = own[0].join(own[1], "part", "full_outer")
        equal = reduce(lambda a, b: a & b, [F.col(f"{x}_l").eqNullSafe(F.col(f"{x}_r")) for x in "nab"])
        # the parts that differ, and one row of what the equal ones hold
        rows = both.groupBy(F.when(~equal, F.col("part")).alias("part")).agg(F.sum(F.when(equal, F.col("n_l"))).alias("same")).toArrow().to_pylist()
        same += sum(r["same"] or 0 for r in rows if r["part"] is None)
        apart = [(r["part"],) for r in rows if r["part"] is not None]
        counts.append(len(apart))
        parts, before = spark.createDataFrame(apart, "part bigint"), bits
    rest = [_within(df, parts, before).drop("__key").unionByName(whole.where(_blank(whole, keys))) for df, whole in zip(sides, (left, right), strict=True)]
    return DigestDiff(keyed_diff(*rest, keys, columns), same, counts)
