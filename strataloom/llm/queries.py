"""Queries of the training-text operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import contamination, matching, packing, personal, repeated_lines, scanned, survivorship


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of engineering_docs.body that is an instance of a line repeated in its source."""
    return repeated_lines.find_repeated_lines(table(spark, sf_dir, "engineering_docs"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body without the lines repeated in its source."""
    return repeated_lines.remove_repeated_lines(table(spark, sf_dir, "engineering_docs"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each file that two or more catalogue rows name, each field with the best value of the group."""
    return survivorship.best_records(table(spark, sf_dir, "zlib_book"), table(spark, sf_dir, "libgenrs_updated"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group, the row with the most complete undamaged description of that very book."""
    return p3_records(spark, sf_dir).where(F.col("descr_id").isNotNull()).select("md5", F.col("descr_id").alias("zlibrary_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect in a scanned body of engineering_docs: furniture, broken words, misread words."""
    found = scanned.find_defects(table(spark, sf_dir, "engineering_docs"))
    return found.select("ingest_seq", "line_no", "repaired").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body of engineering_docs, those of scanned pages as continuous paragraphs of right words."""
    return scanned.repair(table(spark, sf_dir, "engineering_docs"))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of two catalogues that describe the same book, with a confidence."""
    rows = matching.books(table(spark, sf_dir, "libgenli_editions"), table(spark, sf_dir, "libgenrs_updated"), table(spark, sf_dir, "zlib_book"))
    return matching.match(rows)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p6_pairs without their confidence."""
    return p6_pairs(spark, sf_dir).select("rec_a", "rec_b").distinct()


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, or piece of one longer than the largest window, with its container."""
    return packing.assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces, tokens and the share of room used, by window."""
    return packing.usage(p7_pack(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least half of an evaluation item as one passage."""
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct personal value in a document, as it stands in the text."""
    spans = personal.find_spans(table(spark, sf_dir, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.pii_type", "s.surface").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of its personal values."""
    return personal.redact(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean, "p3_found": p3_found, "p3_records": p3_records, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_pack": p7_pack, "p7_usage": p7_usage, "p8_found": p8_found, "p9_found": p9_found, "p9_redacted": p9_redacted}
SQL: dict[str, str] = {}
