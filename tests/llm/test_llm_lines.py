"""Repeated lines, survivorship, packing: brute force, invariants and bad input."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.llm import packing, repeated_lines, survivorship


def key_of(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    return [r.k for r in df.select("i", repeated_lines.line_key(F.col("x")).alias("k")).orderBy("i").collect()]


def test_line_keys(spark):
    same = key_of(spark, "Reviewed by Ada Lund on 3 May 2014", "REVIEWED BY BEA HOLT-KROG ON DECEMBER 12, 2020!", " * reviewed  by Cy D. Ness on 1 mars 2001")
    assert len(set(same)) == 1 and same[0] is not None
    a, b = key_of(spark, "Shared 568 times this week", "Shared 9 times this month")
    assert a != b
    assert key_of(spark, "", None, "12 - 3", "---") == [None] * 4


def site_rows(n=60):
    rnd = random.Random(1)
    rows = []
    for s in ("a", "b", "c"):
        for i in range(n):
            body = [f"own words {s} {''.join(rnd.choice('abcdefgh') for _ in range(12))} here" for _ in range(3)]
            if s == "a" and i % 2:
                body.insert(0, f"All rights {i} reserved")
            if s == "a" and i % 2 and i % 3 == 0:
                body += ["all RIGHTS reserved."]
            if i < 3:
                body.append("too rare to count")
            rows.append((len(rows), s, "\n".join(body), s))
    return rows


def test_repeated_lines(spark):
    rows = site_rows()
    df = spark.createDataFrame(rows, "ingest_seq long, source string, body string, x string")
    got = {(r.ingest_seq, r.line_no) for r in repeated_lines.find_repeated_lines(df).collect()}
    want = {(k, i) for k, s, b, _ in rows for i, line in enumerate(b.split("\n")) if "rights" in line.lower()}
    assert got == want
    clean = {r.ingest_seq: r.clean for r in repeated_lines.remove_repeated_lines(df).collect()}
    assert clean == {k: "\n".join(line for line in b.split("\n") if "rights" not in line.lower()) for k, _, b, _ in rows}


def test_repeated_lines_edges(spark):
    rows = [(1, None, "a b", 1), (2, "s", None, 1), (3, "s", "", 1), (4, "s", "x" * 200_000, 1), (4, "s", "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "ingest_seq long, source string, body string, h int")
    assert repeated_lines.find_repeated_lines(df).count() == 0
    assert repeated_lines.remove_repeated_lines(df).count() == 5
    assert repeated_lines.find_repeated_lines(df.limit(0)).count() == 0


def test_only_one_source(spark):
    """Without another source to compare with, the line's own counts decide."""
    df = spark.createDataFrame([r for r in site_rows() if r[1] == "a"], "ingest_seq long, source string, body string, x string")
    assert repeated_lines.find_repeated_lines(df).count() > 0


BOOK = "In Sealed Valves of the North, Ada Lund gives a clear account of the subject."


def catalogues(spark):
    h, g = "0123456789abcdef0123456789abcde0"[::-1], "a1b2c3d4e5f60718293a4b5c6d7e8f90"
    z = [
        (1, "Sealed Valves of the North", "Lund", None, "1999", "en", "pdf", 5, g, BOOK),
        (2, "SEALED VALVES OF THE NORTH", "Ada Lund", "Press", "1999", "en", "pdf", 0, f"md5:{g.upper()}", BOOK + " It ends well."),
        (3, "Sealed Valves of the North", "Ada Lund", "Press", None, None, "", -4, f" {g} ", BOOK + " It ends well."),
        (4, "Sealed Valves of the North", None, None, None, None, None, None, f"{g[:8]}-{g[8:16]}-{g[16:24]}-{g[24:]}", BOOK + " It ends well. But it was cut [more]"),
        (5, "Sealed Valves of the North", None, None, None, None, None, None, g, "In Open Pumps of the South, Bea Holt gives a very long and good account of another subject altogether here."),
        (6, "Other", None, None, None, None, None, None, "f" * 32, BOOK),
        (7, "Other", None, None, None, None, None, None, "f" * 32, BOOK),
        (8, "Other", None, None, None, None, None, None, survivorship.EMPTY_FILE, None),
        (9, "Lone", None, None, None, None, None, None, h, "No description available."),
    ]
    zs = "zlibrary_id long, title string, authors string, publisher string, year string, language string, extension string, filesize long, md5 string, descr string"
    zl = spark.createDataFrame(z, zs).withColumns({"date_added": F.current_timestamp().cast("timestamp_ntz"), "date_modified": F.lit(None).cast("timestamp_ntz"), "v": F.lit(1), "r0": F.lit(2)})
    r = [(1, "Sealed Valves", None, "P", "1999", "en", None, h, "12 KB", "pdf"), (2, "Lone", "Zed", "P", "2001", "en", None, None, "x", "pdf")]
    rs = spark.createDataFrame(r, "ID long, Title string, Authors string, Publisher string, Year string, Language string, ISBN string, MD5 string, Size string, Extension string").withColumns({"TimeAdded": F.current_timestamp().cast("timestamp_ntz"), "TimeModified": F.lit(None).cast("timestamp_ntz")})
    return zl, rs, g, h


def test_survivorship(spark):
    zl, rs, g, h = catalogues(spark)
    got = {r.md5: r for r in survivorship.best_records(zl, rs).collect()}
    assert set(got) == {g, h}
    assert got[g].descr_id == 2 and got[g].descr.endswith("It ends well.") and got[g].n_rows == 5
    assert got[g].title == "Sealed Valves of the North" and got[g].filesize == 5 and got[g].authors == "Ada Lund"
    assert got[h].descr_id is None and got[h].filesize == 12 * 1024
    assert survivorship.best_records(zl.limit(0), rs.limit(0)).count() == 0


def test_hashes(spark):
    bad = [None, "", "N/A", "0" * 32, "d41d8cd98f00b204e9800998ecf8427e", "a" * 31, "ab" * 16, "xyz", "g" * 32]
    df = spark.createDataFrame([(b,) for b in bad], "h string")
    assert df.select(survivorship.file_hash(F.col("h")).alias("k")).where("k is not null").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pack(seed):
    rnd = random.Random(seed)
    caps = [512, 2048, 8192]
    items = [(i, min(8192, int(rnd.lognormvariate(5.2, 1.1)) + 1)) for i in range(3000)]
    size = dict(items)
    held = packing.pack(items, caps)
    assert sorted(i for _, h in held for i in h) == list(range(3000))
    assert all(0 < sum(size[i] for i in h) <= caps[t] for t, h in held)
    used = sum(size.values()) / sum(caps[t] for t, _ in held)
    assert used > 0.97


def test_assign(spark):
    text = "one two three four five six seven eight nine ten "
    rows = [(1, text * 300, 1), (2, None, 1), (3, "", 1), (4, "hi", 1), (4, "hi", 1), (5, text * 10, 1)] + [(10 + i, text * (1 + i % 7), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    win = spark.createDataFrame([(1, 64), (2, 256), (2, 256), (3, None)], "window_id int, capacity int")
    got = packing.assign(df, win, shard_items=60).collect()
    tokens = {r.doc_id: r.n_tokens for r in packing.count_tokens(df.dropDuplicates(["doc_id"]), "doc_id", "text").collect()}
    assert tokens[2] == tokens[3] == 0 and {r.doc_id for r in got} == {k for k, n in tokens.items() if n}
    total = {}
    for r in got:
        total[r.container] = total.get(r.container, 0) + r.n_tokens
        assert r.n_tokens <= r.capacity and (r.piece == 0 or tokens[r.doc_id] > 256)
    cap = {r.container: r.capacity for r in got}
    assert all(n <= cap[c] for c, n in total.items())
    pieces = sorted((r.start_token, r.n_tokens) for r in got if r.doc_id == 1)
    assert sum(n for _, n in pieces) == tokens[1] and [a for a, _ in pieces] == [256 * i for i in range(len(pieces))]
    assert sum(r.doc_id == 4 for r in got) == 2
    slots = sorted((r.container, r.slot_start, r.n_tokens) for r in got)
    assert all(b[0] != a[0] or b[1] == a[1] + a[2] for a, b in zip(slots, slots[1:]))
    assert packing.assign(df.limit(0), win).count() == 0
    with pytest.raises(ValueError):
        packing.assign(df, win.where("false"))
