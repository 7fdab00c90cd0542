"""Session defaults and the shared-folder rule for cutting lineage."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "pagewright", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    """A folder of this process alone, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="pagewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests, the benchmark) gets a folder
    of its own; a session on a cluster is refused, since no other machine would see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master or ""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a bare scan, in at least as many partitions as there are cores.

    Only a scan of fewer files and row groups than cores is shuffled, so what moves is
    bounded by what that few tasks read; any larger one stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
