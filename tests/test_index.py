"""The stored index against row-by-row scoring, what it reads, fusion of failing branches, sinks and shared folder."""

import itertools

import pytest
from pyspark.sql import functions as F

from strataloom import runtime
from strataloom.operators import index as X
from strataloom.operators import retrieval as S
from strataloom.operators import sinks as K

TEXTS = [(1, "Sensor valve", "the sensor drives a valve and a valve"), (2, "Valve", "sensor near the big old valve"), (3, None, "a valve before the sensor"), (4, "Gearbox", ""), (5, "", None), (6, "valve sensor", "valve " * 400)]
def fields():
    return {"title": F.col("title"), "search_text": F.col("body")}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TEXTS, "k long, title string, body string")


@pytest.fixture(scope="module")
def idx(spark, table):
    return X.build(table, "k", fields(), runtime.scratch(spark))


@pytest.mark.parametrize("q", ["sensor valve", "valve", "gearbox", "nothing here", "", "sensor valve valve gearbox the", "the sensor drives a valve"])
@pytest.mark.parametrize("short", ["all", "any"])
def test_equals_row_by_row(spark, table, idx, q, short):
    got = {r.id: r.score for r in X.bm25(spark, idx, q, short=short).collect()}
    assert got == pytest.approx({r.id: r.score for r in S.bm25(table, "k", fields(), q, short=short).collect()}, abs=2e-6)


def test_filter_and_floor(spark, table, idx):
    keep = table.where("k < 3").select(F.col("k").alias("id"))
    assert {r.id for r in X.bm25(spark, idx, "valve", keep).collect()} == {1, 2}
    assert {r.id for r in X.bm25(spark, idx, "gearbox zebra valve", least=1).collect()} == {1, 2, 3, 4, 6}


def test_reads_only_its_terms(spark, idx):
    plan = idx.postings(spark, ["valve"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120] and "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1][:120]


def test_built_once(spark, table, tmp_path):
    path = str(tmp_path / "x")
    a = X.build(table, "k", fields(), path)
    assert X.build(table.limit(0), "k", fields(), path).stats == a.stats
    empty = X.build(table.limit(0), "k", fields(), str(tmp_path / "y"))
    assert X.bm25(spark, empty, "valve").count() == 0


def near(lists, slop):
    moved = [[p - i for p in ps] for i, ps in enumerate(lists)]
    return any(max(c) - min(c) <= slop for c in itertools.product(*moved))


def test_slop(spark):
    cases = [([[3], [4]], 2), ([[3], [5]], 2), ([[3], [6]], 2), ([[3], [7]], 2), ([[4], [3]], 2), ([[5], [3]], 2), ([[0, 9], [30, 11], [12]], 2), ([[0], [], [2]], 2), ([[1], [2]], 0), ([[1], [3]], 0)]
    df = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(cases)], "i int, p array<array<int>>, s int")
    for slop in (0, 2):
        got = {r.i: r.x for r in df.where(F.col("s") == slop).select("i", S.slop_phrase(F.col("p"), slop).alias("x")).collect()}
        assert got == {i: near(p, s) for i, (p, s) in enumerate(cases) if s == slop}


def test_fuse(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id long, score double")
    broken = a.select("id", F.raise_error(F.lit("down")).cast("double").alias("score"))

    def raises():
        raise KeyError("absent")

    assert {r.id: r.score for r in X.fuse([lambda: a, lambda: broken, raises]).collect()} == {1: 1.0, 2: 0.5}
    two = X.fuse([lambda: a, lambda: a.where("id = 2"), raises]).orderBy(F.desc("score")).collect()
    assert [r.id for r in two] == [2, 1]
    with pytest.raises(Exception, match="down"):
        X.fuse([lambda: broken, raises])


def test_more_like(spark, table, idx):
    got = X.more_like(spark, idx, table, "k", fields(), 2)
    assert {r.id for r in got.collect()} >= {1, 3} and 2 not in {r.id for r in got.collect()}
    assert X.more_like(spark, idx, table, "k", fields(), 5).count() == 0


def test_upsert_keeps_the_newest(spark, tmp_path):
    row = lambda *r: spark.createDataFrame(list(r), "id long, at long, v string")
    path = str(tmp_path / "t")
    K.upsert(spark, path, row((1, 5, "new"), (2, 1, "a"), (2, 1, "a")), "id", "at")
    K.upsert(spark, path, row((1, 3, "late"), (2, 1, "b"), (3, None, "c")), "id", "at")
    assert {(r.id, r.v) for r in K.current(spark, path).collect()} == {(1, "new"), (2, "b"), (3, "c")}
    K.upsert(spark, path, row((1, 3, "late")), "id", "at", newest=False)
    assert {(r.id, r.v) for r in K.current(spark, path).collect()} == {(1, "late"), (2, "b"), (3, "c")}
    assert K.versions(spark, path) == [2, 3]


def test_broadcast_by_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    small, wide = spark.range(10), spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert hinted(runtime.bounded_broadcast(small, 10)) and not hinted(runtime.bounded_broadcast(small, 9))
    assert not hinted(runtime.bounded_broadcast(wide, 10, 5000)) and hinted(runtime.bounded_broadcast(wide, 10, 50_000))


def test_clean(spark):
    df = runtime.materialize(spark.range(3))
    assert df.count() == 3 and runtime.clean(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017 - the files are gone
        spark.read.parquet(df.inputFiles()[0]).count()
