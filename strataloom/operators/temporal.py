"""Operator: timestamps of several tables in one form, with each source's zone and date order from a lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import normalize_timestamp
from ..runtime import bounded_broadcast

#: Largest lookup of sources that is broadcast; beyond it the lookup is joined by shuffle.
MAX_SOURCES = 100_000


def normalize_fields(df: DataFrame, key: str, fields: list[str], tab: str, profiles: DataFrame | None = None, source: str = "source") -> DataFrame:
    """One row (tab, row_key, field_name, norm_value) for each value of ``fields`` that denotes a date or time.

    profiles: (source, home_zone, day_first); a source it lacks, and a null source, count as UTC and day first. If it
    repeats a source, the first by (home_zone, day_first) holds. Null, empty and unusable values give no row; repeated
    input rows give repeated rows. Other columns, whatever their names, are never read.
    """
    cols = [F.col(key).alias("__key"), *[F.col(f).alias(f"__v{i}") for i, f in enumerate(fields)]]
    if profiles is not None:
        df = df.select(*cols, F.col(source).alias("__source"))
        prof = profiles.groupBy(F.col("source").alias("__source")).agg(F.min(F.struct("home_zone", "day_first")).alias("__p"))
        df = df.join(bounded_broadcast(prof, MAX_SOURCES), "__source", "left")
        zone, day_first = F.col("__p.home_zone"), F.col("__p.day_first")
    else:
        df, zone, day_first = df.select(*cols), F.lit("UTC"), F.lit(True)
    # fields become rows first, so that the expression is compiled once however many fields there are
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"__v{i}").alias("v")) for i, f in enumerate(fields)])
    rows = df.select("__key", zone.alias("__zone"), day_first.alias("__df"), F.explode(pairs).alias("__x"))
    return rows.select(
        F.lit(tab).alias("tab"),
        F.col("__key").cast("long").alias("row_key"),
        F.col("__x.f").alias("field_name"),
        normalize_timestamp(F.col("__x.v"), F.col("__zone"), F.col("__df")).alias("norm_value"),
    ).where(F.col("norm_value").isNotNull())
