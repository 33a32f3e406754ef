"""URL filtering by a sort-merge range join, in DataFrame operations only.

A host is written label by label from its end (``www.example.com`` as ``com,example,www,``), followed by a slash and the path. A rule's key is then an
interval of sorted keys: all that begin with it. A url is looked up once for each host it lies in (``com``, ``example.com``, ...), under that host's key and its own path.
Intervals nest or are disjoint. One sweep over rules and lookups in key order carries the stack of the nested rules opened last; of those the deepest whose interval still holds
the lookup is its rule, and of a url's lookups that of the longest host decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, written


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a comma."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(","))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule the rules that its interval lies in, itself included, as an array of (key, host_length, rule, verdict). A stack is no longer than its rule's path."""
    host = ascii_lower(F.col("host"))
    rules = rules.where("host is not null and path is not null").select(host_key(host).alias("host"), "path", F.concat(host, "path").alias("rule"), "verdict")
    # where one host and path has several verdicts, block holds
    rules = rules.groupBy("host", "path", "rule").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.concat("host", F.lit("/"), "path").alias("key"), "path", F.length("host").alias("host_length"), "rule", "verdict")
    outer = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("key"), F.lit(1), F.col("host_length") + 1 + n))
    opened = rules.select("key", F.explode(outer).alias("outer"))
    return opened.join(rules.select(F.col("key").alias("outer"), F.struct("key", "host_length", "rule", "verdict").alias("own")), "outer").groupBy("key").agg(F.collect_list("own").alias("stack"))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None, range_rows: int = 2_000_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of urls(page_id, url), under rules(host, path, verdict).

    A rule fits its host and all subdomains where the url's path starts with the rule's path. Of those that fit, the one with the
    longest host wins, then the one with the longest path; where one host and path has several verdicts, the last in order (block). No rule: rule is null and verdict is default. A url that is null or has
    no :// has empty host and path. Repeated rows are all returned, long urls are read whole. Rules with a null host or path fit nothing.

    Lookups are dealt out by ranges of (key, hash), so that one key may fill any number of partitions, of about range_rows rows; every
    partition starts with the stack that was open at the end of those before it: one short array for each.
    """
    spark = urls.sparkSession
    stacks = _stacks(rules)
    stack_type = stacks.schema["stack"].dataType
    pages = written(urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row")), "url-rows")
    labels = F.split(host_key(F.col("host")), ",", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), ","), F.lit(",")))
    lookups = pages.select(F.explode(hosts).alias("own"), "path", "row").select(F.concat("own", F.lit("/"), "path").alias("key"), F.lit(1).alias("kind"), "row", F.lit(None).cast(stack_type).alias("stack"), F.xxhash64("row").alias("spread"))
    opened = stacks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), "stack", F.lit(0).cast("long").alias("spread"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * pages.count() // range_rows)
    # written, so that partition numbers stand still
    dealt = written(lookups.unionByName(opened).repartitionByRange(n, "key", "kind", "spread").withColumn("part", F.spark_partition_id()), "url-sweep")
    # a partition begins with the last stack opened in any part before it: one row per part
    ends = dealt.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    parts = spark.range(n).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    carried = parts.select("part", F.last("stack", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("stack", True).over(sweep)).where("kind = 1").join(carried, "part", "left")
    active = F.filter(F.coalesce("open", "carried"), lambda r: F.col("key").startswith(r["key"]))
    deepest = F.array_max(F.transform(active, lambda r: F.struct(r["host_length"].alias("host_length"), F.length(r["key"]).alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    best = swept.select("row", deepest.alias("best")).where("best is not null").groupBy("row").agg(F.max("best").alias("best"))
    return pages.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
