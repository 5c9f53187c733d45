"""Session settings and shared checkpoint storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "skysieve", **conf: str) -> SparkSession:
    """A session with adaptive planning, ANSI semantics and UTC times; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed to the folder in spark.checkpoint.dir (a temporary one only in a local session without it)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master.startswith("local") or df.sparkSession.conf.get("spark.checkpoint.dir", None)):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="skysieve-"))
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share; a temporary one only in a local session without spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or tempfile.mkdtemp(prefix='skysieve-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"
