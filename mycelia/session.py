"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders that an application's queries have written below the checkpoint folder.
_scratch: dict[str, list[str]] = {}


def build(app: str = "mycelia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and times in UTC. `conf` keys use __ for a dot."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session on one machine can do without that setting and gets a local one.
    """
    context = spark.sparkContext
    if not (path := context.getCheckpointDir()):
        if not (given := spark.conf.get("spark.checkpoint.dir", None)):
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            given = tempfile.mkdtemp(prefix="mycelia-")
        context.setCheckpointDir(given)
        path = context.getCheckpointDir()
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, until release()."""
    path = f"{checkpoint_dir(spark)}/mycelia-{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Free what queries have written so far and how many folders that were: results that aren't read yet are lost. Cached tables go too; checkpoints follow as the driver drops them."""
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    spark.catalog.clearCache()
    return len(paths)
