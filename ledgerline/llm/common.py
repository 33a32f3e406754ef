"""What the training-data operators share: the shared folder, written tables, graph components, fixed expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, where all is one machine, may leave it unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='ledgerline-')}")
        at = context.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """crc32(key as text) mod folds = fold; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows whose hashes of key are least (all, if there are fewer). Rows that can't be among them are left out before any are sorted in one place."""
    total = rows.count()
    share = (most + 20 * most**0.5 + 100) / max(1, total)
    low = rows if share >= 1 else rows.where(F.xxhash64(key) < F.lit(int(share * 2**64) - 2**63))
    return low.orderBy(F.xxhash64(key), key).limit(most)


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, in which each u and its smaller neighbours are joined to the smallest of those."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    both = edges.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
    return both.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps: each node hands its neighbours to the smallest
    of them, so the longest chain shrinks geometrically and no task ever holds a whole component. Only nodes
    of edges with a <> b are returned.
    """
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before, edges = edges, written(_small_star(edges), name)  # many edges within one component become few before the first round
    drop_written(spark, before)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below has nothing but shuffles under it: of a node with very many neighbours Spark splits the rows
        low = written(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), f"{name}-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        new = written(_small_star(large), name)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(spark, edges, low)
        edges = new
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
