"""Sinks: upsert into a versioned table, validated import with rejects, and the state of a table.

A table is a folder of numbered versions; the newest complete one counts, so a reader never sees half a write and a failed
write leaves the table as it was. An upsert reads the old version and writes the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    mark = lambda v: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and mark(n))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    v = versions(spark, path)
    return spark.read.parquet(f"{path}/{v[-1]}") if v else None


def deduplicate(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; among equals one that does not depend on how rows are partitioned."""
    cols = [c for c in df.columns if c != key]
    sortable = [c for c in cols if not df.schema[c].dataType.typeName() in ("map", "variant")]
    best = F.max_by(F.struct(*cols), F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in sortable])))
    return df.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def upsert(spark: SparkSession, path: str, incoming: DataFrame, key: str, order: str, newest: bool = True) -> DataFrame:
    """Writes the table's next version: incoming rows replace those of equal key. Repeating it changes nothing.

    newest: a row replaces one of equal key only if its ``order`` is not lower, so rows may arrive late; else what arrives
    last wins. A null order is the lowest.
    """
    new = deduplicate(incoming, key, order)
    old = current(spark, path)
    if old is None:
        out = new
    elif newest:
        # one aggregation over both, the incoming row first among equals
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        cols = [c for c in both.columns if c not in (key, "__new")]
        best = F.max_by(F.struct(*cols), F.struct(F.col(order), F.col("__new")))
        out = both.groupBy(key).agg(best.alias("r")).select(key, "r.*")
    else:
        out = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    v = versions(spark, path)
    out.write.parquet(f"{path}/{v[-1] + 1 if v else 1}")
    for n in v[:-1]:
        # the version before stays for readers that are still at it
        drop(spark, f"{path}/{n}")
    return current(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def status(spark: SparkSession, path: str, vector: str = "embedding") -> dict:
    """Whether the table exists, its rows, and which retrieval it allows."""
    df = current(spark, path)
    if df is None:
        return {"exists": False, "rows": 0, "retrieval": "unavailable"}
    return {"exists": True, "rows": df.count(), "retrieval": "hybrid" if vector in df.columns else "fulltext"}


def split_valid(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a record is valid if each required field is present and not empty."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.length(F.trim(F.col(c).cast("string"))) > 0)
    return df.where(ok), df.where(~ok)
