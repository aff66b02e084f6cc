"""A small mutable store of collections and bookmarks, as tables that are rewritten whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(collections: DataFrame, owner: str) -> DataFrame:
    return collections.where((F.col("owner") == owner) | F.col("is_public"))


def owned(collections: DataFrame, owner: str) -> DataFrame:
    return collections.where(F.col("owner") == owner)


def delete(collections: DataFrame, bookmarks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the collections of ``ids`` (collection_id) and what is filed in them."""
    return collections.join(ids, "collection_id", "left_anti"), bookmarks.join(ids, "collection_id", "left_anti")


def upsert_bookmarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """One bookmark for each (collection, document); a repeat keeps the old note unless it brings a new one."""
    key = ["collection_id", "document_id"]
    both = old.withColumnRenamed("note", "n0").withColumn("in_old", F.lit(True)).join(new.withColumnRenamed("note", "n1").dropDuplicates(key), key, "full_outer")
    return both.select(*key, F.coalesce(F.nullif("n1", F.lit("")), "n0", F.lit("")).alias("note"), F.coalesce("in_old", F.lit(False)).alias("was_there"))


def remove_bookmarks(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone, ["collection_id", "document_id"], "left_anti")
