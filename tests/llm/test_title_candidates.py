"""Titles of books as candidates: no pair is lost to a bound beside LEAST_TITLE, and few are lost to the bands."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import matching as M
from strataloom.llm.edits import distances


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j] + (x != y), d[j + 1] + 1, e[-1] + 1))
        d = e
    return d[-1]


def flat(strings):
    size = np.array([len(s) for s in strings])
    return np.frombuffer("".join(strings).encode(), np.uint8), np.cumsum(size) - size, size


def test_distances():
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    a = [some(n) for n in (0, 0, 1, 7, 63, 64, 65, 128, 129, 300)] * 6
    b = [some(n) for n in (0, 5, 3, 64, 65, 63, 64, 120, 200, 7)] * 5 + [x[:3] + "q" + x[5:] for x in a[:10]]
    (d1, s1, n1), (d2, s2, n2) = flat(a), flat(b)
    assert distances((d1, d2), (s1, s2), (n1, n2)).tolist() == [plain_distance(x, y) for x, y in zip(a, b)]


def test_similar(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    b = a[:40] + "q" * 20 + a[60:]
    rows = [(1, 2, a, b, False, False), (1, 3, a, a[:30], False, False), (1, 4, a, a[:30], False, True), (1, 5, a, a[::-1], False, False), (6, 7, "a b", "a b c", False, False)]
    df = spark.createDataFrame(rows, "c1 long, c2 long, t1 string, t2 string, cut1 boolean, cut2 boolean")
    assert {r.c2: round(r.sim, 6) for r in M.similar(df).collect()} == {2: round(1 - 20 / len(a), 6), 3: 0.9, 4: 1.0, 7: 0.6}
    assert M.similar(df.limit(0)).count() == 0


FIELDS = "n long, tab string, t string, cut boolean, names array<int>, grams array<short>, y int, lang int, pub string, vol int, ed int, hash long"


def test_foreign_words(spark):
    a, b = "numerical methods structural vibration control marine", "numerical methods structural vibration optics lasers"
    rest = [5, 9], [1, 2], 1990, 1, None, None, None, None
    df = spark.createDataFrame([(1, "li", a, False, *rest), (2, "rs", b, False, *rest)], FIELDS)
    got = M.candidates(df).select("a", "b", F.col("tf.word_swap").alias("w")).collect()
    assert [(r.a, r.b, r.w) for r in got] == [(1, 2, 2.0)]


def test_long_titles_keep_all_words(spark):
    t = " ".join(f"word{i}" for i in range(90))
    raw = spark.createDataFrame([(1, t, "A. Body")], "id long, t string, p string")
    got = M.comparable(raw, "x", F.col("id").cast("string"), "t", "p", "p", "p").collect()[0]
    assert got.t == t


def test_bands_find_seven_tenths():
    """At a trigram similarity of 0.7 the bands alone find at least seven in ten."""
    assert 1 - (1 - 0.7**M.ROWS) ** M.BANDS >= 0.7


def test_recall_against_all_pairs(spark, sf):
    """Of the pairs that the model accepts among all pairs of titles, the bands bring at least 97 in 100."""
    from strataloom.runtime import materialize, table

    d = sf.replace("sf0.001", "sf0.01")
    rows = materialize(M.with_grams(M.books(table(spark, d, "libgenli_editions"), table(spark, d, "libgenrs_updated"), table(spark, d, "zlib_book")).withColumn("n", F.xxhash64("rec")))).where("length(t) >= 3")
    found = M.scored(M.candidates(rows)).cache()
    w = M.train(found)
    got = {(r.a, r.b) for r in M.accepted(found, *w).collect()}
    # every pair of different titles with a letter count that allows the similarity, compared without bands
    t = rows.withColumn("c", F.xxhash64("t", "cut")).select("c", "t", "cut").dropDuplicates(["c"])
    side = lambda i: t.select(*[F.col(c).alias(f"{c}{i}") for c in t.columns])
    every = M.similar(side(1).crossJoin(side(2)).where("c1 < c2")).select("c1", "c2", "t1", "t2", "sim")
    full = M.scored(M.records_of(every, t, rows.withColumn("c", F.xxhash64("t", "cut"))))
    want = {(r.a, r.b) for r in M.accepted(full, *w).collect()}
    assert got <= want and len(got) >= 0.97 * len(want), (len(got), len(want))
