"""Queries of the core operators for general data problems, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .multivalue import split_values
from .temporal import normalize_fields

PEOPLE_AND_CODES = {"libgenrs_updated": ("ID", {"ISBN": "code", "Authors": "people"}), "libgenli_editions": ("e_id", {"authors": "people"})}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of engineering_docs.published, .updated and libgenrs_updated.Year that denotes a date or time."""
    docs = normalize_fields(table(spark, sf_dir, "engineering_docs"), "ingest_seq", ["published", "updated"], "engineering_docs", table(spark, sf_dir, "source_profiles"))
    return docs.unionByName(normalize_fields(table(spark, sf_dir, "libgenrs_updated"), "ID", ["Year"], "libgenrs_updated"))


def p1_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field came out as an instant, a day, a month or a year."""
    n = F.length("norm_value")
    kind = F.when(n == 27, "instant").when(n == 10, "day").when(n == 7, "month").otherwise("year")
    return p1_found(spark, sf_dir).groupBy("tab", "field_name", kind.alias("grain")).agg(F.count("*").alias("n_values"))


def p4_all(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Every value of libgenrs_updated.ISBN, .Authors and libgenli_editions.authors with its position."""
    parts = [split_values(table(spark, sf_dir, t), key, fields, t, least=least) for t, (key, fields) in PEOPLE_AND_CODES.items()]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p4_all, for fields that hold two or more values."""
    return p4_all(spark, sf_dir, 2)


QUERIES = {"p1_found": p1_found, "p1_precision": p1_precision, "p4_found": p4_found, "p4_all": p4_all}
SQL: dict[str, str] = {}
