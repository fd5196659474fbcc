"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. None of them names a cluster size: partition counts, memory and
# executors stay with the deployment.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Model output may repeat a JSON key; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster in spark.checkpoint.dir.

    Only a session in one process, as in tests, gets a folder of its own if the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Used where later steps must see the very same rows and partition numbers again, whatever
    executors are lost in between. Written Parquet also keeps column pruning for those steps. The
    table stays until its scope ends (`staging`); without a scope it stays for good.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Scope of staged tables: they are deleted when it ends.

    Results that read them must be written inside the scope. Scopes nest; each deletes its own.
    """
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)

