"""Descriptions of a book that name it late."""

from pyspark.sql import functions as F

from strataloom.llm import survivorship


def test_title_named_late(spark):
    late = "It was long in the making, as all who took part will say. " * 12 + "This is the whole story of Gearbox Lubrication."
    other = "It was long in the making, as all who took part will say. " * 12 + "This is the whole story of sailing boats."
    df = spark.createDataFrame([(1, late), (2, other)], "i int, d string")
    got = df.where(survivorship.usable_text(F.col("d"), F.lit("Gearbox Lubrication"))).collect()
    assert [r.i for r in got] == [1]
