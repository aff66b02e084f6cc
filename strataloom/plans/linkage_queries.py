"""Queries of joins, set operations, pivots, entity resolution and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as G
from ..operators import collections as C
from ..operators import linkage as L
from ..runtime import table
from .registry import Registry
from .text_queries import S13, TO10

R = Registry()
z = lambda s, d: table(s, d, "zlib_book")
rs = lambda s, d: table(s, d, "libgenrs_updated")
li = lambda s, d: table(s, d, "libgenli_editions")
MD5 = "CASE WHEN regexp_full_match(lower(trim({c})), '[0-9a-f]{{32}}') THEN lower(trim({c})) END"
ZK, RK = MD5.format(c="z.md5"), MD5.format(c='r."MD5"')


def _keyed_rs(s, d):
    return rs(s, d).select(T.canonical_md5(F.col("MD5")).alias("rk"), F.col("ID").alias("rs_id"), F.col("Title").alias("rs_title"), F.col("Authors").alias("rs_authors"), F.col("Publisher").alias("rs_publisher"), F.col("Year").alias("rs_year"), F.col("Extension").alias("rs_ext"), F.col("Language").alias("rs_lang"))


def _pairs(s, d):
    zz = z(s, d).withColumn("zk", T.canonical_md5(F.col("md5")))
    return zz.join(_keyed_rs(s, d), F.col("zk") == F.col("rk"))


@R.add("joi01_left_chain_constant_in_on", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name = 'EUROPE'")
def joi01(s, d):
    o, c, n, r = (table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    c = c.select("c_custkey", "c_name", "c_nationkey")
    n, r = n.select("n_nationkey", "n_name", "n_regionkey"), r.where("r_name = 'EUROPE'").select("r_regionkey", "r_name")
    out = o.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = L.lookup(out, n, F.col("c_nationkey") == F.col("n_nationkey"))
    return L.lookup(out, r, F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@R.add("joi02_three_table_left", f"SELECT z.zlibrary_id, r.\"ID\" AS rs_id, e.e_id FROM zlib_book z LEFT JOIN libgenrs_updated r ON {ZK} = {RK} LEFT JOIN libgenli_editions e ON e.title = z.title")
def joi02(s, d):
    zz = z(s, d).select("zlibrary_id", "title", T.canonical_md5(F.col("md5")).alias("zk"))
    return L.left_chain(L.left_chain(zz, "zk", [(_keyed_rs(s, d).select("rk", "rs_id"), "rk")]), "title", [(li(s, d).select("e_id", F.col("title").alias("t2")), "t2")]).select("zlibrary_id", "rs_id", "e_id")


@R.add("joi03_nested_children", "SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def joi03(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey"))
    kids = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    n = L.nest(o, kids, "o_orderkey", ["l_linenumber", "l_partkey"], "lines")
    return n.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@R.add("joi04_bridge", "SELECT p_partkey, count(DISTINCT s_suppkey) AS suppliers, min(s_name) AS first_supplier FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey")
def joi04(s, d):
    bridge = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    far = L.lookup(bridge, table(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    per = far.groupBy("p_partkey").agg(F.count("s_name").alias("suppliers"), F.min("s_name").alias("first_supplier"))
    return table(s, d, "part").select("p_partkey").join(per, "p_partkey", "left").select("p_partkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "first_supplier")


@R.add("joi05_conditional_join", "SELECT e.event_id, s.s_name FROM events e LEFT JOIN supplier s ON e.event_type = 'purchase' AND try_cast(e.props::JSON->>'k' AS BIGINT) = s.s_suppkey")
def joi05(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"))
    return L.lookup(e, table(s, d, "supplier").select("s_suppkey", "s_name"), F.col("k") == F.col("s_suppkey")).select("event_id", "s_name")


@R.add("joi06_conditional_attribute", "SELECT s.s_id, s.name, count(e.e_id) AS numbered FROM libgenli_series s LEFT JOIN libgenli_editions e ON e.s_id = s.s_id AND e.volume <> '' GROUP BY s.s_id, s.name")
def joi06(s, d):
    e = li(s, d).where("volume != ''").select(F.col("s_id"), "e_id")
    return table(s, d, "libgenli_series").select("s_id", "name").join(e, "s_id", "left").groupBy("s_id", "name").agg(F.count("e_id").alias("numbered"))


@R.add("joi07_metadata_lookup", "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def joi07(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    return L.lookup(table(s, d, "supplier"), n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@R.add("joi08_key_list_lookup", f"WITH k AS (SELECT DISTINCT {RK} AS key FROM libgenrs_updated r WHERE {RK} IS NOT NULL), a AS (SELECT {MD5.format(c='md5_reported')} AS key, min(zlibrary_id) AS id FROM zlib_book GROUP BY 1), b AS (SELECT {MD5.format(c='md5')} AS key, min(zlibrary_id) AS id FROM zlib_book GROUP BY 1) SELECT k.key, coalesce(a.id, b.id) AS zlibrary_id FROM k LEFT JOIN a USING (key) LEFT JOIN b USING (key)")
def joi08(s, d):
    keys = L.union_keys([rs(s, d)], ["MD5"])
    one = lambda c: z(s, d).select(T.canonical_md5(F.col(c)).alias("k2"), "zlibrary_id").where("k2 is not null").groupBy("k2").agg(F.min("zlibrary_id").alias(f"id_{c}"))
    return L.left_chain(keys, "key", [(one("md5_reported"), "k2"), (one("md5"), "k2")]).select("key", F.coalesce("id_md5_reported", "id_md5").alias("zlibrary_id"))


@R.add("joi09_edition_work_fallback", "SELECT '/books/' || e.e_id AS ol_key, coalesce('/works/' || e.s_id, '') AS work_key, s.s_id IS NOT NULL AS has_work, CASE WHEN e.e_id % 2 = 0 THEN '/authors/' || (e.e_id % 7) || ',/authors/' || (e.e_id % 3) WHEN s.s_id IS NOT NULL THEN '/authors/' || (s.s_id % 5) ELSE '' END AS authors FROM libgenli_editions e LEFT JOIN libgenli_series s ON s.s_id = e.s_id")
def joi09(s, d):
    """Editions, works and authors as rows of JSON; half of the editions name authors of their own."""
    key = lambda p, c: F.concat(F.lit(f"/{p}/"), c.cast("string"))
    named = lambda c: F.struct(c.alias("key"))
    e, ser = li(s, d).select("e_id", "s_id"), table(s, d, "libgenli_series").select("s_id")
    own = F.when(F.col("e_id") % 2 == 0, F.array(named(key("authors", F.col("e_id") % 7)), named(key("authors", F.col("e_id") % 3))))
    books = e.select(key("books", F.col("e_id")).alias("ol_key"), F.to_json(F.struct(F.when(F.col("s_id").isNotNull(), F.array(named(key("works", F.col("s_id"))))).alias("works"), own.alias("authors"))).alias("json"))
    works = ser.select(key("works", F.col("s_id")).alias("ol_key"), F.to_json(F.struct(F.array(F.struct(named(key("authors", F.col("s_id") % 5)).alias("author"))).alias("authors"))).alias("json"))
    people = s.range(7).select(key("authors", F.col("id")).alias("ol_key"), F.lit("{}").alias("json"))
    got = G.editions_with_works(books.unionByName(works).unionByName(people))
    return got.select("ol_key", F.coalesce("work_key", F.lit("")).alias("work_key"), F.col("work_json").isNotNull().alias("has_work"), F.array_join("author_keys", ",").alias("authors"))


@R.add("joi10_match_with_label", f"WITH a AS (SELECT {ZK} AS key, count(*) AS n FROM zlib_book z GROUP BY 1), b AS (SELECT {RK} AS key, count(*) AS n FROM libgenrs_updated r GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'second' WHEN b.key IS NULL THEN 'first' ELSE 'both' END AS label FROM (SELECT * FROM a WHERE key IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE key IS NOT NULL) b ON a.key = b.key")
def joi10(s, d):
    a, b = L.union_keys([z(s, d)], ["md5"]).withColumn("a", F.lit(1)), L.union_keys([rs(s, d)], ["MD5"]).withColumn("b", F.lit(1))
    return a.join(b, "key", "full_outer").select("key", F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("both").alias("label"))


_X13 = rf"""SELECT DISTINCT id, x FROM (SELECT "ID" AS id, replace(replace(unnest(regexp_extract_all("ISBN", '[0-9][0-9 -]{{8,15}}[0-9Xx]')), '-', ''), ' ', '') AS x FROM libgenrs_updated WHERE "ISBN" IS NOT NULL) WHERE regexp_full_match(x, '[0-9]{{13}}') AND ({S13}) % 10 = 0"""
_TEN = f"CASE WHEN x[1:3] = '978' THEN x[4:12] || CASE WHEN (11 - ({TO10}) % 11) % 11 = 10 THEN 'X' ELSE CAST((11 - ({TO10}) % 11) % 11 AS VARCHAR) END END"


@R.add("joi10_isbn_matches", f"""WITH c AS ({_X13}), a AS (SELECT DISTINCT x AS isbn, {_TEN} AS ten FROM c), r AS (SELECT DISTINCT x AS isbn13, coalesce(CASE WHEN id % 2 = 0 THEN {_TEN} ELSE x[4:13] END, '') AS isbn10 FROM c),
m AS (SELECT isbn, isbn13, isbn10, 2 AS way FROM a JOIN r ON isbn = isbn13 UNION ALL SELECT isbn, isbn13, isbn10, 1 FROM a JOIN r ON ten = isbn10 WHERE isbn13[1:3] = '978')
SELECT isbn, isbn13, isbn10, CASE sum(way) WHEN 3 THEN 'ISBN-10 and ISBN-13' WHEN 2 THEN 'ISBN-13' ELSE 'ISBN-10' END AS match_type FROM m GROUP BY ALL""")
def joi10_isbn(s, d):
    """ISBNs against records of which every second has its ISBN-10 chopped off the ISBN-13, as sources do."""
    found = F.explode(F.regexp_extract_all("ISBN", F.lit("[0-9][0-9 -]{8,15}[0-9Xx]"), F.lit(0)))
    c = rs(s, d).where("ISBN is not null").select("ID", found.alias("x")).select("ID", F.regexp_replace("x", "[- ]", "").alias("x")).where(T.is_isbn13(F.col("x")))
    rec = c.select(F.col("x").alias("isbn13"), F.when(F.col("ID") % 2 == 0, T.isbn10_of(F.col("x"))).otherwise(F.substr("x", F.lit(4), F.lit(10))).alias("isbn10"))
    return G.isbn_matches(c.select(F.col("x").alias("isbn")), rec)


@R.add("joi11_unnest_json", "SELECT DISTINCT ingest_seq, unnest(categories) AS category FROM engineering_docs")
def joi11(s, d):
    js = table(s, d, "engineering_docs").select("ingest_seq", F.to_json("categories").alias("j"))
    return js.select("ingest_seq", F.explode(F.from_json("j", "array<string>")).alias("category")).distinct()


@R.add("joi12_query_terms_join", r"SELECT t.term, count(*) AS n_docs FROM (SELECT unnest(['sensor', 'valve', 'zzz']) AS term) t LEFT JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) p USING (term) WHERE p.doc_id IS NOT NULL GROUP BY t.term")
def joi12(s, d):
    q = s.createDataFrame([("sensor",), ("valve",), ("zzz",)], "term string")
    p = table(s, d, "documents").select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    return p.join(F.broadcast(q), "term").groupBy("term").agg(F.count("*").alias("n_docs"))


@R.add("joi13_hydrate_page", "SELECT doc_id, title, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def joi13(s, d):
    docs = table(s, d, "documents")
    page = docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")
    return docs.join(F.broadcast(page), "doc_id").select("doc_id", "title", "source")


@R.add("joi14_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)")
def joi14(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    return docs.join(docs.orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id"), "doc_id", "left_anti").select("doc_id")


@R.add("set01_union_distinct", f"SELECT DISTINCT key FROM (SELECT {ZK} AS key FROM zlib_book z UNION SELECT {MD5.format(c='z.md5_reported')} FROM zlib_book z UNION SELECT {RK} FROM libgenrs_updated r) WHERE key IS NOT NULL")
def set01(s, d):
    return L.union_keys([z(s, d), z(s, d), rs(s, d)], ["md5", "md5_reported", "MD5"])


_CT = "coalesce({c}, [])"


@R.add("set02_intersect_except", f"SELECT ingest_seq, array_to_string(list_sort(list_intersect({_CT.format(c='categories')}, {_CT.format(c='tags')})), '|') AS common, len(list_filter(list_distinct({_CT.format(c='categories')}), lambda x: NOT list_contains({_CT.format(c='tags')}, x))) AS own FROM engineering_docs")
def set02(s, d):
    none = F.array().cast("array<string>")
    e = table(s, d, "engineering_docs").select("ingest_seq", F.coalesce("categories", none).alias("c"), F.coalesce("tags", none).alias("t"))
    return e.select("ingest_seq", F.array_join(F.array_sort(F.array_intersect("c", "t")), "|").alias("common"), F.size(F.array_except("c", "t")).cast("bigint").alias("own"))


@R.add("set03_ordered_distinct", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(title), '[a-z0-9]+'), 1) AS i FROM documents WHERE title IS NOT NULL), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id")
def set03(s, d):
    w = F.array_distinct(T.ascii_tokens(F.col("title")))
    return table(s, d, "documents").where("title is not null").select("doc_id", F.array_join(w, " ").alias("words")).where("words != ''")


@R.add("set04_sorted_union", "SELECT ingest_seq, array_to_string(list_sort(list_distinct(list_concat(coalesce(categories, []), coalesce(tags, [])))), '|') AS all_labels FROM engineering_docs")
def set04(s, d):
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("categories", none), F.coalesce("tags", none)))
    return table(s, d, "engineering_docs").select("ingest_seq", F.array_join(F.array_sort(both), "|").alias("all_labels"))


_EAV = "(SELECT e_id, 'Pub. Year' AS k, year AS v, 1 AS o FROM libgenli_editions WHERE year <> '' UNION ALL SELECT e_id, 'Volume', volume, 2 FROM libgenli_editions WHERE volume <> '' UNION ALL SELECT e_id, 'Pub. Year', month, 3 FROM libgenli_editions WHERE month <> '')"


@R.add("map01_attribute_pivot", f"SELECT e_id, arg_max(v, o) FILTER (WHERE k = 'Pub. Year') AS last_year, string_agg(v, '|' ORDER BY o) FILTER (WHERE k = 'Pub. Year') AS all_years, arg_max(v, o) FILTER (WHERE k = 'Volume') AS last_volume FROM {_EAV} GROUP BY e_id")
def map01(s, d):
    e = li(s, d)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v"), F.lit(o).alias("o")) for k, c, o in (("Pub. Year", "year", 1), ("Volume", "volume", 2), ("Pub. Year", "month", 3))])
    long = e.select("e_id", F.explode(rows).alias("x")).select("e_id", "x.*").where("v != ''")
    p = L.pivot_attributes(long, "e_id", "k", "v", "o")
    return p.select("e_id", F.try_element_at("last", F.lit("pubyear")).alias("last_year"), F.array_join(F.try_element_at("multiple", F.lit("pubyear")), "|").alias("all_years"), F.try_element_at("last", F.lit("volume")).alias("last_volume"))


@R.add("map02_select_keys", "SELECT ingest_seq, kv.key AS id_type, kv.value AS id_value FROM (SELECT ingest_seq, unnest(map_entries(identifiers)) AS kv FROM engineering_docs) WHERE kv.key IN ('doi', 'report')")
def map02(s, d):
    known = F.map_filter("identifiers", lambda k, v: k.isin("doi", "report"))
    return table(s, d, "engineering_docs").select("ingest_seq", F.explode(known).alias("id_type", "id_value"))


@R.add("map03_display_name", "SELECT doc_id, coalesce(MAP {'en': 'English', 'de': 'German', 'fr': 'French'}[lang], lang) AS language_name FROM documents")
def map03(s, d):
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German", "fr", "French")])
    return table(s, d, "documents").select("doc_id", F.coalesce(F.try_element_at(names, "lang"), "lang").alias("language_name"))


_P = f"FROM zlib_book z JOIN libgenrs_updated r ON {ZK} = {RK}"


def _best_sql(a: str, b: str) -> str:
    return f"CASE WHEN length(trim(coalesce({b}, ''))) > length(trim(coalesce({a}, ''))) THEN trim({b}) ELSE trim(coalesce({a}, '')) END"


@R.add("res01_best_value", f"SELECT z.zlibrary_id, r.\"ID\" AS rs_id, {_best_sql('z.title', 'r.\"Title\"')} AS title, {_best_sql('z.authors', 'r.\"Authors\"')} AS author, {_best_sql('z.publisher', 'r.\"Publisher\"')} AS publisher {_P}")
def res01(s, d):
    b = lambda x, y: L.best_value(F.array(x, y))
    return _pairs(s, d).select("zlibrary_id", "rs_id", b("title", "rs_title").alias("title"), b("authors", "rs_authors").alias("author"), b("publisher", "rs_publisher").alias("publisher"))


@R.add("res02_additional_values")
def res02(s, d):
    """Other titles that the longest does not hold as a subsequence; rows only (SQL has no such loop), with unit tests."""
    c = F.array("title", "rs_title", "publisher")
    return _pairs(s, d).select("zlibrary_id", "rs_id", F.array_join(L.additional_values(c), "|").alias("others"))


@R.add("res03_file_name", r"SELECT ingest_seq, regexp_extract(url, '[^/\\]*$') AS file_name FROM engineering_docs")
def res03(s, d):
    return table(s, d, "engineering_docs").select("ingest_seq", F.regexp_extract("url", r"[^/\\]*$", 0).alias("file_name"))


@R.add("res04_first_by_priority", "SELECT ingest_seq, coalesce(nullif(trim(pdf_url), ''), nullif(trim(url), ''), '') AS best_url FROM engineering_docs")
def res04(s, d):
    urls = F.filter(F.array(F.trim("pdf_url"), F.trim("url")), lambda u: u.isNotNull() & (u != ""))
    return table(s, d, "engineering_docs").select("ingest_seq", F.coalesce(F.try_element_at(urls, F.lit(1)), F.lit("")).alias("best_url"))


@R.add("res05_extension", f"SELECT z.zlibrary_id, r.\"ID\" AS rs_id, CASE WHEN z.extension = 'epub' OR r.\"Extension\" = 'epub' THEN 'epub' WHEN z.extension = 'pdf' OR r.\"Extension\" = 'pdf' THEN 'pdf' ELSE {_best_sql('z.extension', 'r.\"Extension\"')} END AS extension {_P}")
def res05(s, d):
    return _pairs(s, d).select("zlibrary_id", "rs_id", L.best_extension(F.array(T.empty(F.col("extension")), T.empty(F.col("rs_ext")))).alias("extension"))


@R.add("res06_file_size", "SELECT zlibrary_id, CASE WHEN filesize > 0 THEN filesize ELSE greatest(coalesce(filesize_reported, 0), coalesce(filesize, 0)) END AS size FROM zlib_book")
def res06(s, d):
    return z(s, d).select("zlibrary_id", L.best_size(F.col("filesize"), [F.col("filesize_reported")]).alias("size"))


_LG = "list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(coalesce({c}, '')), '[-_,;/]'), lambda w: {m}[trim(w)]), lambda w: w IS NOT NULL)))"
_LM = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGE_NAMES.items()) + "}"


@R.add("res07_language_codes", f"WITH p AS (SELECT z.zlibrary_id, r.\"ID\" AS rs_id, {_LG.format(c='z.language', m=_LM)} AS a, {_LG.format(c='r.\"Language\"', m=_LM)} AS b {_P}) SELECT zlibrary_id, rs_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS codes, coalesce(a[1], b[1]) AS likely FROM p")
def res07(s, d):
    a, b = T.language_codes(T.empty(F.col("language"))), T.language_codes(T.empty(F.col("rs_lang")))
    return _pairs(s, d).select("zlibrary_id", "rs_id", F.array_join(F.array_sort(F.array_distinct(F.concat(a, b))), ",").alias("codes"), F.coalesce(F.try_element_at(a, F.lit(1)), F.try_element_at(b, F.lit(1))).alias("likely"))


@R.add("res08_problems", "SELECT zlibrary_id, concat_ws(',', CASE WHEN coalesce(filesize, 0) <= 0 THEN 'size' END, CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN coalesce(md5, '') = '' THEN 'hash' END) AS problems FROM zlib_book")
def res08(s, d):
    flag = lambda c, n: F.when(c, n)
    return z(s, d).select("zlibrary_id", F.concat_ws(",", flag(F.coalesce("filesize", F.lit(0)) <= 0, "size"), flag(T.empty(F.col("title")) == "", "title"), flag(T.empty(F.col("md5")) == "", "hash")).alias("problems"))


@R.add("res09_content_type", f"SELECT z.zlibrary_id, CASE WHEN k.key IS NOT NULL AND z.zlibrary_id % 3 <> 0 THEN 'book_nonfiction' WHEN k.key IS NULL AND z.zlibrary_id % 3 = 0 THEN 'book_fiction' ELSE CASE ['l','f','r','a','s','m','c','q'][z.zlibrary_id % 8 + 1] WHEN 'l' THEN 'book_nonfiction' WHEN 'f' THEN 'book_fiction' WHEN 'r' THEN 'book_fiction' WHEN 'a' THEN 'journal_article' WHEN 's' THEN 'standards_document' WHEN 'm' THEN 'magazine' WHEN 'c' THEN 'book_comic' ELSE 'book_unknown' END END AS content_type FROM zlib_book z LEFT JOIN (SELECT DISTINCT {RK} AS key FROM libgenrs_updated r) k ON k.key = {ZK}")
def res09(s, d):
    """Topic letters drawn from the id, one specialised source that has the file if a hash agrees, another by the id."""
    zz = z(s, d).select("zlibrary_id", T.canonical_md5(F.col("md5")).alias("key")).join(L.union_keys([rs(s, d)], ["MD5"]).withColumn("hit", F.lit(True)), "key", "left")
    topic = F.substr(F.lit("lfrasmcq"), (F.col("zlibrary_id") % 8 + 1).cast("int"), F.lit(1))
    return zz.select("zlibrary_id", G.content_type(topic, F.col("hit").isNotNull(), F.col("zlibrary_id") % 3 == 0).alias("content_type"))


@R.add("res10_search_text", "SELECT zlibrary_id, array_to_string([coalesce(title, '')[1:1000], coalesce(publisher, '')[1:1000], coalesce(year, '')[1:1000], coalesce(authors, '')[1:1000], coalesce(md5_reported, '')[1:1000], coalesce(extension, ''), coalesce(language, '')], chr(10)) AS search_text FROM zlib_book")
def res10(s, d):
    return z(s, d).select("zlibrary_id", G.unified_search_text(*[F.col(c) for c in ("title", "publisher", "year", "authors", "md5_reported", "extension", "language")]).alias("search_text"))


@R.add("res11_source_list", f"SELECT z.zlibrary_id, string_agg('rs:' || r.\"ID\", ',' ORDER BY r.\"ID\") AS sources {_P} GROUP BY z.zlibrary_id")
def res11(s, d):
    ids = F.transform(F.array_sort(F.collect_list("rs_id")), lambda x: F.concat(F.lit("rs:"), x.cast("string")))
    return _pairs(s, d).groupBy("zlibrary_id").agg(F.array_join(ids, ",").alias("sources"))


@R.add("res12_edition_fallbacks", "SELECT e_id, concat_ws('-', nullif(trim(year), ''), nullif(trim(month), '')) AS edition_date, coalesce(nullif(trim(e.authors), ''), s.name, '') AS by_line FROM libgenli_editions e LEFT JOIN libgenli_series s ON s.s_id = e.s_id")
def res12(s, d):
    e = L.lookup(li(s, d), table(s, d, "libgenli_series").select("s_id", "name"), "s_id")
    nz = lambda c: F.nullif(F.trim(c), F.lit(""))
    return e.select("e_id", F.concat_ws("-", nz("year"), nz("month")).alias("edition_date"), F.coalesce(nz("authors"), "name", F.lit("")).alias("by_line"))


@R.add("res13_bucket", "SELECT zlibrary_id, zlibrary_id // 1000 * 1000 AS bucket FROM zlib_book")
def res13(s, d):
    return z(s, d).select("zlibrary_id", (F.floor(F.col("zlibrary_id") / 1000) * 1000).alias("bucket"))


@R.add("res14_article_link", "WITH p AS (SELECT ingest_seq, CASE ingest_seq % 4 WHEN 0 THEN '10.0000/' || replace(regexp_replace(url, '^https?://', ''), '/', '%2F') || '.pdf' WHEN 1 THEN '10.' || (1000 + ingest_seq) || chr(92) || 'x.' || ingest_seq WHEN 2 THEN '' ELSE '10.0000/plain.pdf' END AS path FROM engineering_docs WHERE url <> ''), q AS (SELECT ingest_seq, path, regexp_replace(replace(path, chr(92), '/'), '[.]pdf$', '') AS u FROM p) SELECT ingest_seq, CASE WHEN path = '' THEN '' WHEN starts_with(u, '10.0000/') AND contains(u, '%2F') THEN 'http://' || replace(u[9:], '%2F', '/') ELSE 'https://doi.org/' || u END AS link FROM q")
def res14(s, d):
    n, bare = F.col("ingest_seq"), F.regexp_replace("url", "^https?://", "")
    coded = F.concat(F.lit("10.0000/"), F.replace(bare, F.lit("/"), F.lit("%2F")), F.lit(".pdf"))
    doi = F.concat(F.lit("10."), (n + 1000).cast("string"), F.lit("\\x."), n.cast("string"))
    path = F.when(n % 4 == 0, coded).when(n % 4 == 1, doi).when(n % 4 == 2, "").otherwise("10.0000/plain.pdf")
    return table(s, d, "engineering_docs").where("url != ''").select("ingest_seq", G.article_link(path, F.lit("pdf")).alias("link"))


@R.add("map01_sub_values", "SELECT e_id, volume, month, nullif(issue, '') AS publisher FROM libgenli_editions")
def map01_sub(s, d):
    """An attribute with one additional value and a publisher's title for each edition, as maps."""
    none = F.lit(None).cast("string")
    meta = F.struct(F.lit("Volume (no.)").alias("name_en"), F.lit("Month").alias("name_add1_en"), F.lit("").alias("name_add2_en"), none.alias("name_add3_en"))
    rows = li(s, d).select("e_id", F.lit(1).alias("o"), F.col("volume").alias("value"), F.col("month").alias("value_add1"), none.alias("value_add2"), none.alias("value_add3"), F.col("issue").alias("publisher_title"), meta.alias("meta"))
    got = G.attribute_map(rows, "e_id", "o")
    return got.select("e_id", F.try_element_at("one", F.lit("volumeno")).alias("volume"), F.try_element_at("one", F.lit("volumeno_month")).alias("month"), F.try_element_at("one", F.lit("publisher_title")).alias("publisher"))


@R.add("res15_headline", "SELECT s_id, arg_min(title, e_id) FILTER (WHERE title <> '') AS headline, arg_max(description, e_id) FILTER (WHERE description <> '') AS last_description FROM libgenli_editions WHERE s_id IS NOT NULL GROUP BY s_id")
def res15(s, d):
    e = li(s, d).where("s_id is not null")
    return e.groupBy("s_id").agg(F.min_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.col("e_id"))).alias("headline"), F.max_by(F.col("description"), F.when(F.col("description") != "", F.col("e_id"))).alias("last_description"))


_HAS = "CASE WHEN coalesce({c}, '') <> '' THEN 10 ELSE 0 END"
_LNG = f"coalesce({_LM}[lower(trim(language))], '')"


@R.add("ret25_heuristic_score", f"SELECT zlibrary_id, round(CASE WHEN filesize > 500000 THEN 10000 ELSE 0 END + CASE WHEN {_LNG} = 'en' THEN 900.0 WHEN {_LNG} = 'de' THEN 100.0 ELSE 0 END + CASE WHEN {_LNG} = '' THEN 100 ELSE 0 END + CASE WHEN extension IN ('epub', 'pdf') THEN 100 ELSE 0 END + CASE WHEN coalesce(title, '') <> '' THEN 100 ELSE 0 END + {_HAS.format(c='authors')} + {_HAS.format(c='publisher')} + {_HAS.format(c='descr')}, 3) AS score FROM zlib_book")
def ret25(s, d):
    names = F.create_map(*[F.lit(x) for kv in T.LANGUAGE_NAMES.items() for x in kv])
    lang = F.coalesce(F.try_element_at(names, F.lower(F.trim("language"))), F.lit(""))
    sc = L.heuristic_score(F.col("filesize"), lang, F.coalesce("extension", F.lit("")), F.col("title"), [F.col("authors"), F.col("publisher"), F.col("descr")], {"en": 0.9, "de": 0.1})
    return z(s, d).select("zlibrary_id", F.round(sc.cast("double"), 3).alias("score"))


@R.add("srt04_by_length", "SELECT ingest_seq, array_to_string(list_transform(list_sort(list_transform(coalesce(authors, []), lambda x: [lpad(CAST(1000 - length(x) AS VARCHAR), 4, '0'), x])), lambda p: p[2]), '|') AS authors FROM engineering_docs")
def srt04(s, d):
    by = F.transform(F.array_sort(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("v")))), lambda p: p["v"])
    return table(s, d, "engineering_docs").select("ingest_seq", F.array_join(by, "|").alias("authors"))


@R.add("srt05_key_order", "SELECT doc_id, CAST(list_position(['paper', 'report', 'code'], kind) AS BIGINT) AS place FROM documents WHERE kind IN ('paper', 'report', 'code')")
def srt05(s, d):
    order = F.array(*map(F.lit, ("paper", "report", "code")))
    return table(s, d, "documents").where(F.col("kind").isin("paper", "report", "code")).select("doc_id", F.array_position(order, F.col("kind")).alias("place"))


@R.add("srt06_latest_first", "SELECT e_id, CAST(last_modified AS VARCHAR) AS changed FROM libgenli_editions ORDER BY last_modified DESC NULLS LAST, e_id LIMIT 50")
def srt06(s, d):
    top = li(s, d).orderBy(F.desc_nulls_last("last_modified"), "e_id").limit(50)
    return top.select("e_id", F.col("last_modified").cast("string").alias("changed"))


# collections: a series is a collection, its editions are bookmarks, and every third series is public ---------------------
def _collections(s, d):
    return table(s, d, "libgenli_series").select(F.col("s_id").alias("collection_id"), F.concat(F.lit("user"), F.col("s_id") % 4).alias("owner"), (F.col("s_id") % 3 == 0).alias("is_public"), "name")


def _bookmarks(s, d):
    return li(s, d).where("s_id is not null").select(F.col("s_id").cast("long").alias("collection_id"), F.col("e_id").alias("document_id"), T.empty(F.col("volume")).alias("note"))


_COL = "(SELECT s_id AS collection_id, 'user' || CAST(s_id % 4 AS VARCHAR) AS owner, s_id % 3 = 0 AS is_public, name FROM libgenli_series)"
_BM = "(SELECT s_id AS collection_id, e_id AS document_id, coalesce(volume, '') AS note FROM libgenli_editions WHERE s_id IS NOT NULL)"


@R.add("col01_list_by_owner", f"SELECT collection_id, name FROM {_COL} WHERE owner = 'user1'")
def col01(s, d):
    return C.owned(_collections(s, d), "user1").select("collection_id", "name")


@R.add("col02_visible", f"SELECT collection_id, owner FROM {_COL} WHERE owner = 'user1' OR is_public")
def col02(s, d):
    return C.visible(_collections(s, d), "user1").select("collection_id", "owner")


@R.add("col03_delete_cascade", f"SELECT collection_id, CAST(NULL AS BIGINT) AS document_id FROM {_COL} WHERE owner <> 'user2' UNION ALL SELECT collection_id, document_id FROM {_BM} WHERE collection_id % 4 <> 2")
def col03(s, d):
    c, b = C.delete(_collections(s, d), _bookmarks(s, d), C.owned(_collections(s, d), "user2").select("collection_id"))
    return c.select("collection_id", F.lit(None).cast("long").alias("document_id")).unionByName(b.select("collection_id", "document_id"))


@R.add("col04_upsert_bookmark", f"WITH o AS (SELECT * FROM {_BM}), n AS (SELECT collection_id, document_id + CASE WHEN document_id % 2 = 0 THEN 0 ELSE 1000000 END AS document_id, CASE WHEN document_id % 3 = 0 THEN 'new' ELSE '' END AS note FROM {_BM}) SELECT coalesce(o.collection_id, n.collection_id) AS collection_id, coalesce(o.document_id, n.document_id) AS document_id, coalesce(nullif(n.note, ''), o.note, '') AS note, o.document_id IS NOT NULL AS was_there FROM o FULL JOIN n ON o.collection_id = n.collection_id AND o.document_id = n.document_id")
def col04(s, d):
    o = _bookmarks(s, d)
    new = o.select("collection_id", (F.col("document_id") + F.when(F.col("document_id") % 2 == 0, 0).otherwise(1000000)).alias("document_id"), F.when(F.col("document_id") % 3 == 0, "new").otherwise("").alias("note"))
    return C.upsert_bookmarks(o, new)


@R.add("col05_remove_bookmarks", f"SELECT collection_id, document_id FROM {_BM} WHERE note = ''")
def col05(s, d):
    o = _bookmarks(s, d)
    return C.remove_bookmarks(o, o.where("note != ''").select("collection_id", "document_id")).select("collection_id", "document_id")


QUERIES, SQL = R.queries, R.sql
