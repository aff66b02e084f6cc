"""Timestamps: every format family, policies, and bad input."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from strataloom.functions.timestamps import local_to_utc, normalize_timestamp
from strataloom.operators.temporal import normalize_fields

NY, BERLIN = "America/New_York", "Europe/Berlin"
CASES = [
    ("2024-04-26T20:10:32.456524895Z", NY, False, "2024-04-26T20:10:32.456524Z"),
    ("2023-08-08 15:04:32+0530", BERLIN, True, "2023-08-08T09:34:32.000000Z"),
    ("2012-11-07T18:22:01-05", NY, False, "2012-11-07T23:22:01.000000Z"),
    ("20200704T031548Z", "UTC", True, "2020-07-04T03:15:48.000000Z"),
    ("1704906172", NY, True, "2024-01-10T17:02:52.000000Z"),
    ("1317077593633", NY, True, "2011-09-26T22:53:13.633000Z"),
    ("Sat, 30 Nov 2024 08:12:45 -0500", BERLIN, True, "2024-11-30T13:12:45.000000Z"),
    ("4 Dec 2024 16:15:29 EST", NY, False, "2024-12-04T21:15:29.000000Z"),
    ("4 Dec 2024 16:15:29 EDT", "Australia/Sydney", True, "2024-12-04T05:15:29.000000Z"),
    ("2010-05-17 23:29:06 America/New_York", "UTC", True, "2010-05-18T03:29:06.000000Z"),
    ("2025-02-12 01:15:56 (Asia/Tokyo)", "UTC", True, "2025-02-11T16:15:56.000000Z"),
    ("Jul 20, 2010 5:20 a.m.", "UTC", True, "2010-07-20T05:20:00.000000Z"),
    ("Jul 20, 2010 12:05 PM", "UTC", True, "2010-07-20T12:05:00.000000Z"),
    ("22. Dezember 2021, 01:07 Uhr", BERLIN, True, "2021-12-22T00:07:00.000000Z"),
    ("13 mai 2022 à 19h44", "Europe/Paris", True, "2022-05-13T17:44:00.000000Z"),
    ("22 de mayo de 2021, 07:51 h", "Europe/Madrid", True, "2021-05-22T05:51:00.000000Z"),
    ("05/06/2022 9:24 PM", "America/Chicago", False, "2022-05-07T02:24:00.000000Z"),
    ("05/06/2022 21:24", BERLIN, True, "2022-06-05T19:24:00.000000Z"),
    # a time that occurs twice is the earlier instant, a skipped one takes the offset before the change
    ("2022-11-06 01:30:00", NY, False, "2022-11-06T05:30:00.000000Z"),
    ("2022-11-06 01:30:00 EST", NY, False, "2022-11-06T06:30:00.000000Z"),
    ("2022-03-13 02:30:00", NY, False, "2022-03-13T07:30:00.000000Z"),
    ("06/05/2022", BERLIN, True, "2022-05-06"),
    ("06/05/2022", NY, False, "2022-06-05"),
    ("2021-W13-1", "UTC", True, "2021-03-29"),
    ("2020-W53-5", "UTC", True, "2021-01-01"),
    ("2008-366", "UTC", True, "2008-12-31"),
    ("20200229", "UTC", True, "2020-02-29"),
    ("5. Juni 2008", BERLIN, True, "2008-06-05"),
    ("August 2009", "UTC", True, "2009-08"),
    ("2022-08", "UTC", True, "2022-08"),
    ("10/2004", "UTC", True, "2004-10"),
    ("\t 2017  ", "UTC", True, "2017"),
    ("c1999", "UTC", True, "1999"),
    ("[2023]", "UTC", True, "2023"),
    ("1998.", "UTC", True, "1998"),
    ("2015.0", "UTC", True, "2015"),
    ("MCMLXXXIV", "UTC", True, "1984"),
]
BAD = ["", None, "n.d.", "unknown", "0", "19--", "0000-00-00", "2023-13-45", "2021-02-29", "2007-366", "2021-W54-1", "not-a-date", "31/04/2020", "25:61", "2020-01-01 25:00", "IIII", "s.a.", "TBD", "x" * 100_000]


def test_formats(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, v string, z string, d boolean, want string")
    got = df.select("v", "want", normalize_timestamp(F.col("v"), F.col("z"), F.col("d")).alias("got")).collect()
    assert [(r.v, r.got) for r in got] == [(r.v, r.want) for r in got]


def test_no_dates(spark):
    df = spark.createDataFrame([(v,) for v in BAD], "v string")
    assert [r.v for r in df.select("v", normalize_timestamp(F.col("v")).alias("g")).where("g is not null").collect()] == []


def test_zone_independent_of_session(spark):
    df = spark.createDataFrame([(c[0], c[1], c[2], c[3]) for c in CASES], "v string, z string, d boolean, want string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        bad = df.select("v", "want", normalize_timestamp(F.col("v"), F.col("z"), F.col("d")).alias("g")).where("g is null or g != want").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert bad == []


@pytest.mark.parametrize("zone", [NY, BERLIN, "Australia/Sydney", "Asia/Kolkata"])
def test_against_zoneinfo(spark, zone):
    """Each quarter hour around both changes of a year, against the standard library (fold 0 is the earlier instant)."""
    rows = [f"2022-{m:02d}-{d:02d} {h:02d}:{q:02d}:00" for m, d in ((3, 13), (3, 27), (4, 3), (10, 2), (10, 30), (11, 6)) for h in range(5) for q in (0, 30)]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    for r in df.select("v", normalize_timestamp(F.col("v"), zone).alias("g")).collect():
        want = datetime.strptime(r.v, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
        assert r.g == want.strftime("%Y-%m-%dT%H:%M:%S.000000Z"), r.v


def test_policies(spark):
    df = spark.createDataFrame([("2022-11-06 01:30:00",), ("2022-03-13 02:30:00",), ("2022-06-01 00:00:00",)], "v string").select(F.col("v").cast("timestamp_ntz").alias("t"))
    get = lambda **k: [r[0] for r in df.select(local_to_utc(F.col("t"), F.lit(NY), **k).cast("string")).collect()]
    assert get() == ["2022-11-06 05:30:00", "2022-03-13 07:30:00", "2022-06-01 04:00:00"]
    assert get(ambiguous="later")[0] == "2022-11-06 06:30:00" and get(ambiguous="null")[0] is None
    assert get(nonexistent="after")[1] == "2022-03-13 06:30:00" and get(nonexistent="null")[1] is None
    assert get(ambiguous="later", nonexistent="null")[2] == "2022-06-01 04:00:00"


def test_fields(spark):
    rows = [(1, "a", "2020-01-01", None, 5), (1, "a", "2020-01-01", None, 5), (2, None, "1 Jan 2020", "bad", 6), (3, "zz", None, "05/06/2020", 7)]
    df = spark.createDataFrame(rows, "k long, source string, p string, u string, norm_value int")
    prof = spark.createDataFrame([("a", NY, False), ("a", NY, False), (None, "UTC", True)], "source string, home_zone string, day_first boolean")
    got = sorted((r.row_key, r.field_name, r.norm_value) for r in normalize_fields(df, "k", ["p", "u"], "t", prof).collect())
    assert got == [(1, "p", "2020-01-01"), (1, "p", "2020-01-01"), (2, "p", "2020-01-01"), (3, "u", "2020-06-05")]
    assert normalize_fields(df.limit(0), "k", ["p", "u"], "t", prof).count() == 0


def test_every_zone_name_is_known(spark):
    """Names whose parts are not capitalised word by word, in any case."""
    from strataloom.functions.timestamps import normalize_timestamp

    rows = [("2024-01-15 12:00 US/Eastern", "17"), ("2024-01-15 12:00 us/pacific", "20"), ("2024-01-15 12:00 America/Port_of_Spain", "16"), ("2024-01-15 12:00 Africa/Dar_es_Salaam", "09"), ("2024-01-15 12:00 [Europe/Isle_of_Man]", "12"), ("2024-01-15 12:00 Mars/Base", None)]
    df = spark.createDataFrame(rows, "v string, h string")
    for r in df.select("v", "h", normalize_timestamp(F.col("v")).alias("n")).collect():
        assert r.n == (r.h and f"2024-01-15T{r.h}:00:00.000000Z"), r
