"""Normal forms in Arrow batches say what the expressions say; titles that share a key meet once, without a join; files of ended shuffles go."""

import os
import random
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataloom.llm import matching as M
from strataloom.llm import normal as N
from strataloom.llm.survivorship import file_hash
from strataloom.llm.words import plain
from strataloom.runtime import materialize

ODD = ["", "A <b>Bold</b> &amp; Title", "Größe ÅNGSTRÖM ﬁnal ﬂow ﬀ", "Тhе Меtаl", "x­y​z", "éä", "漢字 ﬁ", "İstanbul ΟΔΟΣ", "a &#12; b < c", "ａｂｃ ①²", "﻿q r"]
HASHES = [None, "", "0" * 32, "D41D8CD98F00B204E9800998ECF8427E", "0123456789abcdef0123456789abcdef", "9E107D9D372BB6826BD81D3542A419D6", "urn:md5:9e107d9d372bb6826bd81d3542a419d6", " {9e107d9d-372bb682-6bd81d35-42a419d6}", "0x9e107d9d372bb6826bd81d3542a419d6", "9e107d9d372bb6826bd81d3542a419d", "abcabcab" * 4, "md5 = 9e 10 7d 9d 37 2b b6 82 6b d8 1d 35 42 a4 19 d6"]


def test_same_as_expressions(spark):
    got = spark.createDataFrame([(x,) for x in ODD], "s string").select("s", plain(F.col("s")).alias("p")).collect()
    assert [N.plain_text(r.s) for r in got] == [r.p for r in got]
    got = spark.createDataFrame([(x,) for x in HASHES], "s string").select("s", file_hash(F.col("s")).alias("p")).collect()
    assert [N.hash_digits(r.s) for r in got] == [r.p for r in got]


def test_title_form():
    assert N.title_form("Hdbk. of Optical Valves, Vol. II: a manual (3rd ed.)") == ("handbook optical valves", False, "ii", "3")
    assert N.title_form("Thermal_Drift  (2) [pdf]") == ("thermal drift", False, "2", None)
    assert N.title_form("Sealed Encoder..., The") == ("sealed encoder", True, None, None)
    assert N.title_form("") == ("", False, None, None)


def test_every_two_of_a_key_meet_once():
    """However a key's rows are spread over batches, and if they have more pairs than are worked on at a time."""
    key = np.sort(np.random.default_rng(3).integers(0, 300, 900).tolist() + [777] * 260)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 50]), pa.array(np.arange(len(key))[i : i + 50])], ["key", "c"]) for i in range(0, len(key), 50)]
    got = []
    for rows, i, j in M._met(iter([batches[0].slice(0, 0), *batches])):
        c = rows.column(1).to_numpy()
        got += zip(c[i].tolist(), c[j].tolist())
    want = {(i, j) for i in range(len(key)) for j in range(i + 1, len(key)) if key[i] == key[j]}
    assert len(got) == len(want) and set(got) == want and 260 * 259 // 2 > M.CHUNK


def test_bands_meet_without_a_join(spark):
    t = ["optical valve drift control harbour", "optical valve drift control harbours", "linear sensor", "optical valve"]
    rows = spark.createDataFrame([(x, i, i == 3) for i, x in enumerate(t)], "t string, c long, cut boolean")
    met = M._meet_titles(M._title_bands(rows))
    assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    assert {(r.c1, r.c2) for r in met.collect()} >= {(0, 1)}


def test_foreign_words_against_all_pairs():
    from tests.llm.test_title_candidates import plain_distance

    rnd = random.Random(5)
    words = ["valve", "valves", "volve", "drift", "drafts", "sun", "suns", "abcd", "cdab", "control", "kontroll"]
    one, two = ([" ".join(rnd.choices(words, k=rnd.randrange(1, 6))) for _ in range(150)] for _ in "ab")
    alone = lambda x, y: len({w for w in set(x) - set(y) if len(w) > 3 and all(plain_distance(w, v) > 2 for v in set(y) - set(x))})
    a, b = M._foreign(one, two)
    assert list(zip(a, b)) == [(alone(x.split(), y.split()), alone(y.split(), x.split())) for x, y in zip(one, two)]


def test_name_features():
    rnd = random.Random(6)
    some = lambda: " ".join(sorted({"".join(rnd.choices("abc", k=rnd.randrange(3, 6))) for _ in range(rnd.randrange(4))}))
    one, two = ([some() for _ in range(300)] for _ in "ab")
    grams = lambda s: {w[i : i + 3] for w in s.split() for i in range(len(w) - 2)}
    for x, y, over, hit, none in zip(one, two, *M.name_features(pa.array(one), pa.array(two))):
        g, h = grams(x), grams(y)
        assert abs(over - len(g & h) / max(min(len(g), len(h)), 1)) < 1e-6
        assert hit == bool({*x.split()} & {*y.split()}) and none == (not g or not h)


def test_shuffle_files_go_when_the_query_ends(spark):
    local = spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()
    files = lambda: {f"{d}/{f}" for d, _, fs in os.walk(local) for f in fs if f.startswith("shuffle_") and f.endswith(".data")}
    before = files()
    kept = materialize(spark.range(5000).repartition(3, "id"))
    assert files() - before, "no shuffle files are seen here"
    before = files()
    freed = materialize(spark.range(5000).repartition(3, "id"), free=True)
    assert not files() - before
    assert freed.count() == kept.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
