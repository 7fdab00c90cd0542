"""Where results go: versioned tables, JSON and CSV exports, saved runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v" and s.getPath().getName()[1:].isdigit()]
    return sorted(int(v.getName()[1:]) for v in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(v, "_SUCCESS")))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table; null where there is none. A version cut off while written does not count."""
    known = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{known[-1]}") if known else None


def latest_before(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The newest whole version under a number."""
    known = [v for v in _versions(spark, path) if v < version]
    return spark.read.parquet(f"{path}/v{known[-1]}") if known else None


def publish(df: DataFrame, path: str, version: int | None = None) -> str:
    """Write ``df`` as the next version, or as ``version``; readers keep the one they hold.

    A number is claimed by a file made for it, which only one of several writers can
    make, so no two take one. A given version is written over: the same step run again
    gives the same.
    """
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    system = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if version is None:
        known = _versions(spark, path)
        version = known[-1] + 1 if known else 1
        while not system.createNewFile(path_of(f"{path}/claims/{version}")):
            version += 1
    target = f"{path}/v{version}"
    df.write.mode("overwrite").parquet(target)
    return target


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` whole versions; which ones went."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    system = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = _versions(spark, path)[:-keep]
    for v in gone:
        system.delete(path_of(f"{path}/v{v}"), True)
    return gone


def export_json(df: DataFrame, path: str, dry: bool = False) -> int | None:
    """JSON lines; with ``dry`` only the count, and nothing written."""
    if dry:
        return df.count()
    df.write.mode("overwrite").json(path)
    return None


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def save_run(results: DataFrame, summary: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def save_statements(statements: DataFrame, path: str) -> None:
    """Kept and rejected statements, apart."""
    state = F.when(F.col("rejected").isNull(), "kept").otherwise("rejected")
    statements.withColumn("state", state).write.mode("overwrite").partitionBy("state").json(path)


def save_patterns(patterns: DataFrame, path: str) -> None:
    """One sorted text list per kind of pattern."""
    for kind in ("name", "date", "phrase", "word"):
        lines = patterns.where(F.col("kind") == kind).select("value").distinct()
        lines.sort("value").write.mode("overwrite").text(f"{path}/{kind}")
