"""Helpers shared by all operators: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster each executor would write to its own
    disk, so there it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
        d = sc.getCheckpointDir()
    return d.rstrip("/")


#: Tables written by this process, by session's application.
_written: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which clean() removes."""
    path = f"{shared_dir(spark)}/strataloom-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Removes every table this process wrote to the shared folder; results that still read them must be done. Their number."""
    n = 0
    while _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


#: Whether Spark removes a query's shuffle files when it ends, instead of when the driver collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, partitions: int | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like checkpoint(), but columnar: later passes prune columns, and a lost executor costs nothing.
    free: the shuffle files are removed at once.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(_FREE)
    try:
        if free:
            spark.conf.set(_FREE, "true")
        (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    if not folder.rsplit("/", 1)[-1].startswith("strataloom-"):
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a table in memory that is broadcast at most.
MAX_BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most max_rows rows of together max_bytes, else unchanged (a shuffle join
    follows). What is checked is written and read again, so a table within the bound is not computed twice."""
    whole, df = df, materialize(df.limit(max_rows + 1))
    fixed = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}
    flat = [f for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    nested = [f for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    width = sum(fixed.get(f.dataType.typeName(), 8) for f in df.schema.fields) + 16
    size = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in flat), F.lit(width))
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) for f in nested), size)
    n, total = df.agg(F.count("*"), F.sum(size.cast("long"))).collect()[0]
    return F.broadcast(df) if n <= max_rows and (total or 0) <= max_bytes else whole
