"""Repeated lines: what is counted outside a source, and how many rows a source has."""

from strataloom.llm import repeated_lines

SCHEMA = "ingest_seq long, source string, body string"


def test_single_rows_of_many_sources_count(spark):
    """An ordinary line, in 6 of 10 rows of one source and once in each of 300 small ones, is none of that source's own."""
    rows = [(i, "big", f"own words {'abcdefghij'[i]}" + ("\nsee the figure below" if i < 6 else "")) for i in range(10)]
    rows += [(100 + i, f"small{i}", "see the figure below") for i in range(300)]
    keys = repeated_lines.line_keys(spark.createDataFrame(rows, SCHEMA), "ingest_seq", "source", "body")
    assert repeated_lines.excess_lines(keys).count() == 0


def test_rows_without_body_count(spark):
    """Five of 100 rows are under the 8 % of a source, even if most of its bodies are null."""
    rows = [(i, "a", "all rights reserved" if i < 5 else None) for i in range(100)]
    rows += [(200 + i, "b", f"other words {'abcdefghij'[i % 10]} {'abcdefghij'[i // 10]}") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert repeated_lines.find_repeated_lines(df).count() == 0
    assert repeated_lines.remove_repeated_lines(df).where("clean is null").count() == 95
