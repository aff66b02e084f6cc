"""Ranking, filters, text functions, answers, linkage, sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import documents as D
from strataloom.operators import linkage as L
from strataloom.operators import retrieval as S
from strataloom.operators import sinks as K
from strataloom.plans import retrieval_queries
from strataloom.sources import payloads, registry  # noqa: F401


def one(spark, c, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(c.alias("x")).collect()[0].x


def lists(spark, *ls):
    return [spark.createDataFrame([(i, r) for r, i in enumerate(x)], "id string, rank int") for x in ls]


def test_rrf(spark):
    got = {r.id: r.score for r in S.rrf(lists(spark, "abc", "bda")).collect()}
    assert sorted(got, key=lambda i: -got[i])[:2] in (["b", "a"], ["a", "b"]) and got["b"] == round(1 / 62 + 1 / 61, 6)
    w = {r.id: r.score for r in S.rrf(lists(spark, "ab", "ba"), weights=[0.1, 10.0]).collect()}
    assert w["b"] > w["a"]
    with pytest.raises(ValueError):
        S.rrf(lists(spark, "ab"), weights=[1.0, 2.0])
    assert [S.score_ceiling(n) for n in (0, 1, 3)] == [0.0, 1.0, 3 / 61]


def test_floor():
    assert [S.floor_of(n) for n in (1, 2, 3, 4, 6)] == [1, 2, 2, 2, 4] and S.floor_of(2, "any") == 1
    assert S.query_terms("circular-buffer, DMA") == ["circular", "buffer", "DMA"] and S.query_terms(None) == []


def test_bm25_edges(spark):
    df = spark.createDataFrame([(1, "valve sensor", 9), (2, None, 9), (3, "", 9), (4, "sensor " * 50, 9), (5, "valve", 9)], "k long, t string, score int")
    hit = {r.id: r.score for r in S.bm25(df, "k", {"search_text": F.col("t")}, "sensor valve").collect()}
    assert set(hit) == {1}
    assert set(r.id for r in S.bm25(df, "k", {"search_text": F.col("t")}, "sensor valve", short="any").collect()) == {1, 4, 5}
    assert S.bm25(df, "k", {"search_text": F.col("t")}, "").count() == 0
    assert S.bm25(df.limit(0), "k", {"search_text": F.col("t")}, "valve").count() == 0


def test_postings(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "k long, t string")
    p = {r.term: (r.tf, list(r.positions), r.dl) for r in S.postings(df, "k", {"t": F.col("t")}).collect()}
    assert p == {"a": (2, [0, 2], 3), "b": (1, [1], 3)}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id long, v array<float>")
    assert [(r.id, r.score) for r in S.knn(df, "id", "v", [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.0), (4, 0.0)]
    assert [r.id for r in S.related(df, "id", "v", 1, 1).collect()] == [2] and S.related(df, "id", "v", 99).count() == 0
    v = S.hash_vector("dma", 384)
    assert v == {79: 1.0} and S.hash_vector("") == {0: 1.0}
    got = S.hash_vectors(spark.createDataFrame([(1, "dma")], "id long, t string"), "id", F.col("t"), 384).collect()
    assert [(r.bucket, r.weight) for r in got] == [(79, 1.0)]


def test_approximate_recall_of_defaults(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").cache()
    rows = e.collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)

    def share(i, got):
        near = np.argsort(-np.round(v @ v[i], 6), kind="stable")[:20]
        return len({rows[j].vec_id for j in near} & {r.id for r in got.collect()}) / 20

    all_ = [share(i, S.approximate_knn(e, "vec_id", "embedding", list(r.embedding), 20)) for i, r in enumerate(rows) if r.vec_id % 20 == 0]
    assert len(all_) > 20 and sum(all_) / len(all_) >= 0.9
    assert share(0, retrieval_queries.QUERIES["ret08_approximate_knn"](spark, sf)) >= 0.9


def test_key_terms_of_a_long_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100_500))), (2, "other")], "k long, t string")
    assert len(S.key_terms(df, "k", F.col("t"), 1, 200_000)) == 100_500


def test_domains(spark):
    asked = [("source:Pelmo",), ("paper",), ("Pelmo",), ("topic:cs.RO",), (None,), (" ",), ("kind: Report ",), ("odd: thing",), ("source:",), ("a:b:c",)]
    df = spark.createDataFrame(asked, "q string")
    got = {r.q: (r.facet, r.value) for r in D.resolve_domains(df, "q", spark.createDataFrame([("pelmo",), ("PELMO",)], "source string")).collect()}
    assert got == {"source:Pelmo": ("sources", "pelmo"), "paper": ("kinds", "paper"), "Pelmo": ("sources", "pelmo"), "topic:cs.RO": ("categories", "cs.RO"), None: (None, None), " ": (None, None), "kind: Report ": ("kinds", "report"), "odd: thing": ("categories", "odd: thing"), "source:": ("categories", "source:"), "a:b:c": ("categories", "a:b:c")}
    assert D.domain_filters("kinds", "paper").kinds == ["paper"] and D.domain_filters(None, None) == D.Filters()


def test_dates(spark):
    for v, want in (("2024-05-01", "2024-05-01"), ("2023-06", "2023-06-01"), ("2022", "2022-01-01"), ("2024-01-01T12:00:00Z", "2024-01-01"), ("not-a-date", None), ("2023-13-45", "2023-01-01")):
        got = one(spark, T.lenient_date(F.lit(v)).cast("string"))
        assert got == want, v


def test_text(spark):
    assert one(spark, T.html_title(F.lit("<h1>A &amp; B</h1>"))) == "A & B"
    assert one(spark, T.html_text(F.lit("<p>a</p><script>x</script><p>b<br>c</p>"))) == "a\nb\nc"
    assert one(spark, T.chunks(F.lit(" ".join(["word"] * 12)), 5, 2))[0] == " ".join(["word"] * 5)
    assert one(spark, F.size(T.chunks(F.lit(" ".join(["word"] * 400))))) == 2
    assert one(spark, T.is_subsequence(F.lit("Abc"), F.lit("xaxBxc"))) is True and one(spark, T.is_subsequence(F.lit("ba"), F.lit("ab"))) is False
    assert one(spark, T.all_isbns(F.array(F.lit("0-306-40615-2"), F.lit("9790000000002"), F.lit("0306406153")))) == ["0306406152", "9780306406157"]
    assert one(spark, T.keep_em(F.lit("<b>&<em>x</em>"))) == "&lt;b&gt;&amp;<em>x</em>"
    assert one(spark, T.document_id(F.lit("s"), F.lit(" 7 "))) == one(spark, T.document_id(F.lit("s"), F.lit("7")))
    assert one(spark, T.grounded(F.lit("the pump"), F.lit("a pump is the best"))) is True


def test_linkage(spark):
    a = F.array(F.lit("abc"), F.lit("a b c d"), F.lit("zz"), F.lit(""), F.lit(None))
    assert one(spark, L.best_value(a)) == "a b c d" and one(spark, L.additional_values(a)) == ["zz"]
    assert one(spark, L.best_value(F.array(F.lit("ab"), F.lit("cd")))) == "ab"
    assert one(spark, L.best_extension(F.array(F.lit("djvu"), F.lit("pdf")))) == "pdf"
    rows = spark.createDataFrame([(1, "Pub. Year", "1999", 1), (1, "Pub. Year", "2000", 2)], "id long, k string, v string, o int")
    r = L.pivot_attributes(rows, "id", "k", "v", "o").collect()[0]
    assert r["last"] == {"pubyear": "2000"} and r["multiple"] == {"pubyear": ["1999", "2000"]}


def test_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "only")], "id string, at int, v string")
    for _ in range(2):
        got = {r.id: r.v for r in K.upsert(spark, path, a, "id", "at").collect()}
        assert got == {"x": "new", "y": "only"}
    assert K.upsert(spark, path, a.limit(0), "id", "at").count() == 2 and K.status(spark, path) == {"exists": True, "rows": 2, "retrieval": "fulltext"}
    K.drop(spark, path)
    assert K.status(spark, path)["exists"] is False


def test_registry():
    with pytest.raises(KeyError):
        registry.get("nothing")
    with pytest.raises(ValueError):
        registry.register(registry.get("reports"))
    with pytest.raises(ValueError):
        registry.register(registry.Source("", lambda df: df))
