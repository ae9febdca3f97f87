"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``; it must be set."""
    active = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or active
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if active is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


_open_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables settled inside are deleted at the end.

    What is built on them must be written inside the scope, since a DataFrame reads them
    when it runs. Without a scope they stay until the owner of the folder expires them.
    """
    held: list[str] = []
    _open_scopes.append(held)
    try:
        yield
    finally:
        _open_scopes.remove(held)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in held:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the scratch folder and read it back.

    Cuts lineage like ``checkpoint()``, survives lost executors, and keeps column
    pruning and filter pushdown for the passes that follow.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/gridloom-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
