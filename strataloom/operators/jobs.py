"""Jobs over several sources: each fails alone, progress is counted, a dry run writes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import registry
from .sinks import current, split_valid, upsert


def index_documents(spark: SparkSession, path: str, docs: DataFrame, key: str = "id", order: str = "indexed_at") -> dict[str, int]:
    """Upserts the valid documents; counts are observed while the one job runs."""
    seen = Observation()
    title = F.length(F.trim(F.coalesce("title", F.lit("")))) > 0
    counted = docs.observe(seen, F.count("*").alias("fetched"), F.count_if(title).alias("indexed"), F.count_if(~title).alias("errors"))
    good, _ = split_valid(counted, [key, "title"])
    upsert(spark, path, good, key, order)
    return {k: int(v) for k, v in seen.get.items()}


def dry_run(docs: DataFrame, required: list[str]) -> dict[str, int]:
    good, bad = split_valid(docs, required)
    return {"valid": good.count(), "rejected": bad.count()}


def reindex_all(raw_of: dict[str, DataFrame], write: Callable[[str, DataFrame], int]) -> dict[str, str]:
    """Every named source normalised and written; the outcome of each, an error of one stopping no other."""
    out = {}
    for name, raw in sorted(raw_of.items()):
        try:
            out[name] = f"ok {write(name, registry.valid_documents(raw, registry.get(name)))}"
        except Exception as e:  # noqa: BLE001 - reported, and the next source goes on
            out[name] = f"failed {type(e).__name__}"
    return out


def seed(spark: SparkSession, path: str, batches: list[DataFrame], target: int, key: str = "id", order: str = "indexed_at") -> int:
    """Upserts batches until the table holds ``target`` rows; running it again does nothing more."""
    have = lambda: (df.count() if (df := current(spark, path)) is not None else 0)
    for b in batches:
        if have() >= target:
            break
        upsert(spark, path, b, key, order)
    return have()
