"""The session settings the library expects: UTC, adaptive execution, ANSI SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "ledgerline", **conf: object) -> SparkSession:
    """A SparkSession; conf gives further settings with _ in place of dots."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=settings | {k.replace("_", "."): str(v) for k, v in conf.items()}).getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share, spark.checkpoint.dir. Only a local session, where all is one machine, may leave that unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='ledgerline-')}")
        at = context.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
