"""Catalogue operators on literal fixtures: edge rows, chains of fallbacks and the sources' own quirks."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.operators import catalogue as G


def test_record_maps(spark):
    z = spark.createDataFrame([(7, "T", None, None, 5, "EXTRA")], "id long, title string, authors string, filesize long, filesize_reported long, odd string")
    assert G.map_record(z, "zlib").collect()[0].asDict() == {"zlibrary_id": 7, "title": "T", "author": "", "publisher": "", "year": "", "language": "", "extension": "", "md5": "", "md5_reported": "", "description": "", "filesize": 0, "filesize_reported": 5}
    i = spark.createDataFrame([("9780306406157", None, ["A", "B"], "T")], "isbn13 string, isbn10 string, authors array<string>, title string")
    r = G.map_record(i, "isbndb").collect()[0]
    assert (r.isbn13, r.isbn10) == ("9780306406157", "") and json.loads(r.json)["authors"] == ["A", "B"] and json.loads(r.json)["pages"] == ""
    assert set(G.map_record(spark.createDataFrame([(1,)], "f_id long"), "li").columns) >= {"f_id", "md5", "file_size", "libgen_topic"}


def test_validation(spark):
    df = spark.createDataFrame([(1, "T"), (None, "T"), (2, ""), (0, "T"), (3, None)], "ID long, Title string")
    assert [r.v for r in G.map_record(df, "rs").select(G.valid_record("rs").alias("v")).collect()] == [True, False, False, False, False]
    i = spark.createDataFrame([("1", ""), ("", "2"), ("", ""), (None, None)], "isbn13 string, isbn10 string")
    assert [r.v for r in G.map_record(i, "isbndb").select(G.valid_record("isbndb").alias("v")).collect()] == [True, True, False, False]


def test_editions_works_authors(spark):
    j = json.dumps
    rows = [
        ("/books/1", j({"works": [{"key": "/works/1"}], "authors": [{"key": "/authors/2"}, {"key": "/authors/1"}, {"key": "/authors/9"}]})),
        ("/books/2", j({"works": [{"key": "/works/1"}, {"key": "/works/2"}]})),
        ("/books/3", "{broken"), ("/books/4", None), ("/books/5", j({"works": [], "authors": []})), ("/books/6", j({"works": [{"key": "/works/7"}]})),
        ("/works/1", j({"authors": [{"author": {"key": "/authors/1"}}]})), ("/authors/1", "{}"), ("/authors/2", "{}"),
    ]
    got = {r.ol_key: (r.work_key, r.work_json is not None, r.author_keys) for r in G.editions_with_works(spark.createDataFrame(rows, "ol_key string, json string")).collect()}
    assert got == {"/books/1": ("/works/1", True, ["/authors/2", "/authors/1"]), "/books/2": ("/works/1", True, ["/authors/1"]), "/books/3": (None, False, []), "/books/4": (None, False, []), "/books/5": (None, False, []), "/books/6": ("/works/7", False, [])}


def test_isbn_matches(spark):
    rec = spark.createDataFrame([("9780306406157", "0306406152"), ("9790306406156", "0306406152"), ("9780306406157", "x"), ("9781234567897", "0306406152"), (None, "0306406152")], "isbn13 string, isbn10 string")
    asked = spark.createDataFrame([("9780306406157",), ("9790306406156",), ("9780306406157",), (None,)], "isbn string")
    got = {(r.isbn, r.isbn13, r.isbn10): r.match_type for r in G.isbn_matches(asked, rec).collect()}
    assert got == {("9780306406157", "9780306406157", "0306406152"): "ISBN-10 and ISBN-13", ("9780306406157", "9780306406157", "x"): "ISBN-13", ("9780306406157", "9781234567897", "0306406152"): "ISBN-10", ("9790306406156", "9790306406156", "0306406152"): "ISBN-13"}


def test_attribute_map(spark):
    meta = "struct<name_en:string,name_add1_en:string,name_add2_en:string,name_add3_en:string>"
    rows = [(1, 1, "a", "x", "", None, "", ("Web Site", "Date (from)", "", None)), (1, 2, "b", "y", "", None, "Pub", ("Web-Site", "Date (from)", "", None)), (2, 1, None, "", "", None, None, ("ISBN", "", "", None))]
    df = spark.createDataFrame(rows, f"id long, o int, value string, value_add1 string, value_add2 string, value_add3 string, publisher_title string, meta {meta}")
    got = {r.id: (r.one, r.many) for r in G.attribute_map(df, "id", "o").collect()}
    assert got[1] == ({"website": "b", "website_datefrom": "y", "publisher_title": "Pub"}, {"website": ["a", "b"], "website_datefrom": ["x", "y"], "publisher_title": ["Pub"]})
    assert got[2] == ({"isbn": None}, {"isbn": [None]})


def test_content_type(spark):
    df = spark.createDataFrame([("l", False, False), ("a", True, False), ("a", False, True), ("m", True, True), ("q", False, False), (None, False, False)], "t string, n boolean, f boolean")
    assert [r.c for r in df.select(G.content_type(F.col("t"), F.col("n"), F.col("f")).alias("c")).collect()] == ["book_nonfiction", "book_nonfiction", "book_fiction", "magazine", "book_unknown", "book_unknown"]


def test_article_link(spark):
    rows = [("10.1000\\abc.pdf", "pdf", "https://doi.org/10.1000/abc"), ("10.0000/x.org%2Fa%2Fb.pdf", "pdf", "http://x.org/a/b"), ("10.0000/plain", "pdf", "https://doi.org/10.0000/plain"), ("", "pdf", ""), (None, None, "")]
    df = spark.createDataFrame(rows, "p string, e string, want string")
    for r in df.select("want", G.article_link(F.col("p"), F.col("e")).alias("got")).collect():
        assert r.got == r.want


def test_search_text(spark):
    df = spark.createDataFrame([("t" * 1200, None, "", "a", "f", "pdf", None)], "a string, b string, c string, d string, e string, f string, g string")
    got = df.select(G.unified_search_text(*[F.col(c) for c in "abcdefg"]).alias("s")).collect()[0].s
    assert got == "t" * 1000 + "\n\n\na\nf\npdf\n"


def test_content_chunk(spark):
    df = spark.createDataFrame([(["<em>a</em>  b", "", "c"], "abs", "body"), ([], "", "x  y"), (None, "abs", None), (None, None, None), (["w " * 900], "", "")], "h array<string>, a string, b string")
    got = [r.c for r in df.select(G.content_chunk(F.col("h"), F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[:4] == ["a b … c", "x y", "abs", ""] and got[4].endswith(" …") and len(got[4]) <= 1202


@pytest.mark.parametrize("x", [0.0, 1.0, -1.5, 0.1, 1 / 3, 123456.789, 1234567.0, 12345678.0, 1e-4, 1.5e-5, 9999999.6, -2.5e-9, 3e20, 0.00012345678, 0.12890625, 0.12890675048828125, -1.2890625])
def test_vector_literal(spark, x):
    df = spark.createDataFrame([([x, 1.0],), ([],), (None,)], "v array<double>")
    assert [r.s for r in df.select(G.vector_literal(F.col("v")).alias("s")).collect()] == [f"[{x:.7g},1]", None, None]


def test_nested(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "key string")
    x = spark.createDataFrame([("a", 2), ("a", 1), ("c", 3), (None, 4)], "k string, id int")
    got = {r.key: ([t.id for t in r.x], r.y) for r in G.nested_documents(keys, "key", {"x": (x, "k"), "y": (x.limit(0), "k")}).collect()}
    assert got == {"a": ([1, 2], []), "b": ([], [])}


def test_window_fragments(spark):
    text = "start " + "pad " * 60 + "the Valve opens " + "pad " * 60 + "valves close " + "pad " * 60 + "valve again"
    df = spark.createDataFrame([(text,), ("no match",), (None,), ("valve",)], "t string")
    got = [r.f for r in df.select(G.window_fragments(F.col("t"), ["valve"]).alias("f")).collect()]
    assert len(got[0]) == 2 and "<em>Valve</em>" in got[0][0] and "<em>valves</em>" in got[0][1] and all(len(x) <= 190 for x in got[0])
    assert got[1:] == [[], [], ["<em>valve</em>"]]
