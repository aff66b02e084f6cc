"""Queries of sources, sinks and streams: whole tables are written as raw payloads or dumps and read by the reader."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as G
from ..operators import jobs, requests
from ..operators import sinks as K
from ..runtime import scratch, table
from ..sources import files as I
from ..sources import payloads as P
from ..sources import registry
from ..streaming.ingest import ingest
from .registry import Registry

R = Registry()
eng = lambda s, d: table(s, d, "engineering_docs")
zl = lambda s, d: table(s, d, "zlib_book")
J = lambda c: F.array_join(c, "|")


@R.add("src01_registry", "SELECT * FROM (VALUES ('articles', 'paper'), ('catalog', 'library'), ('code', 'code'), ('energy_reports', 'report'), ('reports', 'report'), ('repositories', 'repository')) t(name, kind)")
def src01(s, d):
    return s.createDataFrame([(n, registry.get(n).kind) for n in registry.names()], "name string, kind string")


def _repos(s, d):
    e = eng(s, d)
    return e.select("ingest_seq", F.to_json(F.struct(F.col("id").alias("full_name"), F.col("abstract").alias("description"), F.col("url").alias("html_url"), F.struct(F.col("source").alias("login")).alias("owner"), F.col("published").alias("created_at"), "language", F.col("tags").alias("topics"), F.col("popularity").cast("double").alias("stargazers_count"))).alias("raw"))


@R.add("src02_valid_documents", "SELECT count(*) AS n FROM (SELECT * FROM engineering_docs WHERE length(trim(id)) > 0 LIMIT 100)")
def src02(s, d):
    return registry.valid_documents(_repos(s, d), registry.get("repositories"), 100).agg(F.count("*").alias("n"))


@R.add("src05_repository_payload", "SELECT id AS native, coalesce(abstract, '') AS abstract, source AS author, published, coalesce(array_to_string(list_filter(tags, lambda x: x <> ''), '|'), '') AS tags, coalesce(language, '') AS categories, round(popularity::DOUBLE, 3) AS popularity FROM engineering_docs")
def src05(s, d):
    r = P.repository(_repos(s, d))
    return r.select("native", "abstract", J("authors").alias("author"), "published", J("tags").alias("tags"), J("categories").alias("categories"), F.round("popularity", 3).alias("popularity"))


@R.add("src06_code_payload", "SELECT source || '/' || url AS native, url || ' — ' || source AS title, CASE WHEN contains(url, '.') THEN regexp_extract(url, '[^.]*$') ELSE '' END AS tags FROM engineering_docs")
def src06(s, d):
    raw = eng(s, d).select(F.to_json(F.struct(F.struct(F.col("source").alias("full_name")).alias("repository"), F.col("url").alias("path"))).alias("raw"))
    return P.code_file(raw).select("native", "title", J("tags").alias("tags"))


@R.add("src07_report_payload", "SELECT id AS native, trim(title) AS title, coalesce(array_to_string(authors, '|'), '') AS authors, CASE WHEN coalesce(pdf_url, '') = '' THEN 'https://reports.example/x' ELSE pdf_url END AS pdf_url, published FROM engineering_docs WHERE title IS NOT NULL")
def src07(s, d):
    e = eng(s, d).where("title is not null")
    aff = F.transform("authors", lambda a: F.struct(F.struct(F.struct(a.alias("name")).alias("author")).alias("meta")))
    pdf = F.array(F.struct(F.struct(F.nullif("pdf_url", F.lit("")).alias("pdf"), F.lit("/x").alias("original")).alias("links")))
    raw = e.select(F.to_json(F.struct("id", "title", "abstract", aff.alias("authorAffiliations"), pdf.alias("downloads"), F.col("published").alias("distributionDate"))).alias("raw"))
    return P.report(raw).select("native", "title", J("authors").alias("authors"), "pdf_url", "published")


@R.add("src08_energy_payload", "SELECT id AS native, coalesce(array_to_string(authors, '|'), '') AS authors, coalesce(nullif(url, ''), '') AS url, lower(coalesce(nullif(language, ''), 'en'))[1:2] AS language, coalesce(array_to_string(tags, '|'), '') AS tags FROM engineering_docs WHERE title IS NOT NULL AND url <> ''")
def src08(s, d):
    e = eng(s, d).where("title is not null and url != ''")
    link = F.array(F.struct(F.lit("citation").alias("rel"), F.lit("http://old.example").alias("href")), F.struct(F.lit("citation").alias("rel"), F.col("url").alias("href")))
    raw = e.select(F.to_json(F.struct(F.col("id").alias("osti_id"), "title", F.array_join("authors", "; ").alias("authors"), link.alias("links"), F.array_join("tags", ";").alias("subjects"), "language")).alias("raw"))
    return P.energy_report(raw).select("native", J("authors").alias("authors"), "url", "language", J("tags").alias("tags"))


@R.add("src09_article_payload", "SELECT id AS native, coalesce(array_to_string(list_concat(coalesce(categories, []), coalesce(tags, []))[1:30], '|'), '') AS tags, kind AS categories FROM engineering_docs")
def src09(s, d):
    none = F.array().cast("array<string>")
    terms = F.create_map(F.lit("a"), F.struct(F.coalesce("categories", none).alias("terms")), F.lit("b"), F.struct(F.coalesce("tags", none).alias("terms")))
    raw = eng(s, d).select(F.to_json(F.struct(F.col("id").alias("article_number"), "title", F.col("kind").alias("content_type"), terms.alias("index_terms"))).alias("raw"))
    return P.article(raw).select("native", J("tags").alias("tags"), J("categories").alias("categories"))


def _pages(s, d):
    link = lambda p: F.concat(F.lit(f"<a href='{p}"), F.col("source"), F.lit("'>x</a>"))
    html = F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit("</title>"), F.lit("<p>"), F.col("text"), F.lit("</p>"), link("/d/"), link("https://other.example/d/"), link("e/"))
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("https://docs.example/p/"), F.col("doc_id")).alias("url"), html.alias("html"))


@R.add("src10_page_documents")
def src10(s, d):
    """Pages of at least 120 characters as documents; rows only, as txt01_html_text checks the text itself."""
    return I.page_documents(_pages(s, d), "docs").select("url", "title", "abstract", F.length("body").alias("n"))


@R.add("src11_frontier", "SELECT DISTINCT 'https://docs.example/d/' || source AS url FROM documents")
def src11(s, d):
    return I.frontier(_pages(s, d), "docs.example", "/d/")


@R.add("src13_version_of_url", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'latest' ELSE CAST(doc_id % 7 AS VARCHAR) || '.' || CAST(doc_id % 5 AS VARCHAR) END AS version FROM documents")
def src13(s, d):
    v = F.concat((F.col("doc_id") % 7).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string"))
    url = F.when(F.col("doc_id") % 3 == 0, "https://x.example/en/latest/a").otherwise(F.concat(F.lit("https://x.example/en/v"), v, F.lit("/a")))
    return table(s, d, "documents").select("doc_id", I.version_of(url).alias("version"))


@R.add("src14_tag_rules", "SELECT doc_id, CASE WHEN source LIKE '%docs' THEN 'documentation' WHEN source LIKE '%archive' THEN 'archive' ELSE 'other' END AS tag FROM documents")
def src14(s, d):
    rules = F.when(F.col("source").like("%docs"), "documentation").when(F.col("source").like("%archive"), "archive").otherwise("other")
    return table(s, d, "documents").select("doc_id", rules.alias("tag"))


def _catalog(s, d):
    e = table(s, d, "libgenli_series")
    return e.select(F.col("s_id").cast("string").alias("id"), F.to_json(F.struct(F.col("s_id").cast("string").alias("id"), "name", "description", F.lit("Open Access").alias("access_method"), F.array(F.lit("pdf")).alias("formats"), F.array(F.lit("fr"), F.lit("en")).alias("languages"), F.array(F.lit("library"), F.lit("x")).alias("tags"))).alias("raw"))


@R.add("src15_catalog_query", "SELECT CAST(s_id AS VARCHAR) AS id FROM libgenli_series WHERE contains(lower(name || ' ' || description), 'sensor') ORDER BY s_id LIMIT 10")
def src15(s, d):
    hit = _catalog(s, d).where(P.matches(F.col("raw"), "Sensor")).select("id")
    return hit.orderBy(F.col("id").cast("long")).limit(10)


@R.add("src16_catalog_entry", "SELECT CAST(s_id AS VARCHAR) AS native, trim(name) AS title, 'library|x|open-access' AS tags, 'fr' AS language, 'Libraries' AS categories FROM libgenli_series")
def src16(s, d):
    return P.catalog_entry(_catalog(s, d)).select("native", "title", J("tags").alias("tags"), "language", J("categories").alias("categories"))


@R.add("src17_merge_catalog", "WITH k AS (SELECT rtrim(lower(url), '/') AS key FROM engineering_docs WHERE has_code GROUP BY 1), f AS (SELECT rtrim(lower(url), '/') AS key, min(id) AS id FROM engineering_docs WHERE NOT has_code GROUP BY 1) SELECT key, 'known' AS origin FROM k UNION ALL SELECT key, id FROM f WHERE key NOT IN (SELECT key FROM k)")
def src17(s, d):
    e = eng(s, d).select("id", F.col("title").alias("name"), "url", "has_code")
    known = e.where("has_code").groupBy(P.merge_key(F.col("url"), F.col("id"), F.col("name")).alias("key")).agg(F.lit("known").alias("id"), F.first("name").alias("name"), F.min("url").alias("url"))
    return P.merge_catalog(known.drop("key"), e.where("not has_code").drop("has_code")).select("key", F.col("id").alias("origin"))


@R.add("src18_json_lines", "SELECT zlibrary_id, title, 'record' AS kind FROM zlib_book UNION ALL SELECT NULL, '{broken', 'reject'")
def src18(s, d):
    path = scratch(s)
    lines = zl(s, d).select(F.to_json(F.struct("zlibrary_id", "title")).alias("value"))
    lines.unionByName(s.createDataFrame([("{broken",)], "value string")).write.text(path)
    good, bad = I.json_lines(s, path, "zlibrary_id long, title string")
    return good.select("zlibrary_id", "title", F.lit("record").alias("kind")).unionByName(bad.select(F.lit(None).cast("long").alias("zlibrary_id"), F.col("line").alias("title"), F.lit("reject").alias("kind")))


_DUMP = ["id", "title", "publisher", "year"]


@R.add("src19_sql_dump", "SELECT CAST(zlibrary_id AS VARCHAR) AS id, title, publisher, year FROM zlib_book")
def src19(s, d):
    path = scratch(s)
    q = lambda c: F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    zl(s, d).select(F.concat(F.lit("INSERT INTO `books` (a) VALUES ("), F.col("zlibrary_id"), F.lit(", "), q("title"), F.lit(","), q("publisher"), F.lit(", "), q("year"), F.lit(");"))).write.text(path)
    return I.sql_dump(s, path, _DUMP)


@R.add("src20_tsv_dump", "SELECT '/type/edition' AS type, CAST(e_id AS VARCHAR) AS ol_key, CASE WHEN e_id % 4 = 0 THEN 0 ELSE CAST(e_id AS INTEGER) END AS revision, regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g') AS json FROM libgenli_editions WHERE trim(coalesce(title, '')) <> ''")
def src20(s, d):
    path = scratch(s)
    e = table(s, d, "libgenli_editions").where("trim(coalesce(title, '')) != ''")
    rev = F.when(F.col("e_id") % 4 == 0, "r1").otherwise(F.col("e_id").cast("string"))
    line = F.concat_ws("\t", F.lit("/type/edition"), F.col("e_id").cast("string"), rev, F.lit("2020"), F.concat(F.regexp_replace("title", r"\s+", " "), F.lit("\\u0000|")))
    e.select(line.alias("v")).unionByName(s.createDataFrame([("too\tshort",)], "v string")).write.text(path)
    return I.tsv_dump(s, path).select("type", "ol_key", "revision", F.regexp_replace("json", r"\|$", "").alias("json"))


@R.add("src03_atom_entries", "SELECT id AS native, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(array_to_string(list_filter(authors, lambda x: trim(x) <> ''), '|'), '') AS authors, coalesce(array_to_string(categories, '|'), '') AS categories, 'http://x.example/' || id || '.pdf' AS pdf_url FROM engineering_docs WHERE title IS NOT NULL")
def src03(s, d):
    path = scratch(s)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    many = lambda c, a, b: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(a), esc(x), F.lit(b))), "")
    xml = F.concat(
        F.lit("<entry><id>http://x.example/abs/"), F.col("id"), F.lit("</id><title>"), esc(F.col("title")), F.lit("</title><summary>s</summary><published>2020-01-01</published>"), many(F.col("authors"), "<author><name>", "</name></author>"),
        many(F.col("categories"), "<category term=\"", "\"/>"), F.lit("<link title=\"pdf\" href=\"http://x.example/"), F.col("id"), F.lit(".pdf\"/></entry>"),
    )
    eng(s, d).where("title is not null").select(xml).write.text(path)
    a = I.atom_entries(s, path, whole_files=False)
    return a.select("native", "title", J("authors").alias("authors"), J("categories").alias("categories"), "pdf_url")


@R.add("src22_record_map", "SELECT zlibrary_id, coalesce(title, '') AS title, coalesce(authors, '') AS author, coalesce(publisher, '') AS publisher, coalesce(md5, '') AS md5, coalesce(descr, '') AS description, coalesce(filesize, 0) AS filesize, coalesce(filesize_reported, 0) AS filesize_reported, zlibrary_id IS NOT NULL AND zlibrary_id <> 0 AND coalesce(title, '') NOT IN ('', '0') AS valid FROM zlib_book")
def src22(s, d):
    m = G.map_record(zl(s, d).withColumnRenamed("zlibrary_id", "id"), "zlib")
    return m.select("zlibrary_id", "title", "author", "publisher", "md5", "description", "filesize", "filesize_reported", G.valid_record("zlib").alias("valid"))


@R.add("src22_record_map_rs", "SELECT \"ID\", coalesce(\"Title\", '') AS \"Title\", coalesce(\"Series\", '') AS \"Series\", coalesce(\"ISBN\", '') AS \"ISBN\", coalesce(\"Size\", '') AS \"Size\" FROM libgenrs_updated WHERE coalesce(\"Title\", '') NOT IN ('', '0') AND \"ID\" <> 0")
def src22_rs(s, d):
    return G.map_record(table(s, d, "libgenrs_updated"), "rs").where(G.valid_record("rs")).select("ID", "Title", "Series", "ISBN", "Size")


@R.add("src22_record_map_isbndb", "SELECT isbn13, isbn10, title FROM (SELECT '978' || \"ID\" AS isbn13, CASE WHEN \"ID\" % 2 = 0 THEN CAST(\"ID\" AS VARCHAR) ELSE '' END AS isbn10, coalesce(\"Title\", '') AS title FROM libgenrs_updated)")
def src22_isbndb(s, d):
    raw = table(s, d, "libgenrs_updated").select(F.concat(F.lit("978"), "ID").alias("isbn13"), F.when(F.col("ID") % 2 == 0, F.col("ID").cast("string")).alias("isbn10"), F.col("Title").alias("title"))
    return G.map_record(raw, "isbndb").where(G.valid_record("isbndb")).select("isbn13", "isbn10", F.get_json_object("json", "$.title").alias("title"))


@R.add("src23_validation", "SELECT zlibrary_id, coalesce(length(trim(title)) > 0 AND length(trim(md5)) > 0, false) AS valid FROM zlib_book")
def src23(s, d):
    good, bad = K.split_valid(zl(s, d), ["zlibrary_id", "title", "md5"])
    return good.select("zlibrary_id", F.lit(True).alias("valid")).unionByName(bad.select("zlibrary_id", F.lit(False).alias("valid")))


@R.add("src24_checksums")
def src24(s, d):
    """Size and MD5 of the files of a folder; rows only, as SQL reads no bytes."""
    path = scratch(s)
    table(s, d, "nation").select(F.to_json(F.struct("*"))).coalesce(1).write.text(path)
    return I.checksums(s, path).select("size", "md5")


@R.add("src25_keyset_scan", "SELECT zlibrary_id, title FROM zlib_book WHERE zlibrary_id > 500 ORDER BY zlibrary_id LIMIT 100")
def src25(s, d):
    return zl(s, d).where("zlibrary_id > 500").orderBy("zlibrary_id").limit(100).select("zlibrary_id", "title")


@R.add("src26_point_lookup", "SELECT ingest_seq, id, title FROM engineering_docs WHERE ingest_seq IN (1, 7, 42, 100)")
def src26(s, d):
    return eng(s, d).where(F.col("ingest_seq").isin(1, 7, 42, 100)).select("ingest_seq", "id", "title")


_LAST = "SELECT id, max(indexed_at) AS last_at FROM engineering_docs GROUP BY id"


def _versioned(s, d):
    path = scratch(s)
    e = eng(s, d).select("id", "title", "indexed_at", "ingest_seq", "has_code")
    for code in (False, True):
        K.upsert(s, path, e.where(F.col("has_code") == code).drop("has_code"), "id", "indexed_at", newest=False)
    return path


@R.add("snk03_upsert", "WITH p AS (SELECT id, indexed_at, title, has_code::INTEGER AS part FROM engineering_docs), w AS (SELECT id, max(part) AS part FROM p GROUP BY id) SELECT p.id, CAST(max(p.indexed_at) AS VARCHAR) AS indexed_at FROM p JOIN w USING (id, part) GROUP BY p.id")
def snk03(s, d):
    return K.current(s, _versioned(s, d)).select("id", F.col("indexed_at").cast("string").alias("indexed_at"))


@R.add("snk04_table_count", "SELECT count(DISTINCT id) AS n, 2 AS versions FROM engineering_docs")
def snk04(s, d):
    path = _versioned(s, d)
    return K.current(s, path).agg(F.count("*").alias("n")).withColumn("versions", F.lit(len(K.versions(s, path))))


@R.add("snk11_status", "SELECT true AS exists_, count(DISTINCT id) AS n, 'fulltext' AS retrieval FROM engineering_docs")
def snk11(s, d):
    st = K.status(s, _versioned(s, d))
    return s.createDataFrame([(st["exists"], st["rows"], st["retrieval"])], "exists_ boolean, n long, retrieval string")


@R.add("snk12_import", "SELECT count(*) FILTER (WHERE length(trim(title)) > 0) AS imported, count(*) FILTER (WHERE NOT coalesce(length(trim(title)) > 0, false)) AS rejected FROM zlib_book")
def snk12(s, d):
    good, bad = K.split_valid(zl(s, d), ["zlibrary_id", "title"])
    one = lambda df, g, b: df.agg(F.count("*").alias("n")).select((F.col("n") * g).alias("imported"), (F.col("n") * b).alias("rejected"))
    return one(good, 1, 0).unionByName(one(bad, 0, 1)).agg(F.sum("imported").alias("imported"), F.sum("rejected").alias("rejected"))


@R.add("snk01_batch_pipeline", "SELECT count(*) AS indexed, sum(n) AS tokens FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n FROM documents)")
def snk01(s, d):
    """Read, embed and write as one plan; the table is then read for the counts."""
    path = scratch(s)
    table(s, d, "documents").select("doc_id", F.size(T.terms(F.col("text"))).alias("n")).write.parquet(path)
    return s.read.parquet(path).agg(F.count("*").alias("indexed"), F.sum("n").alias("tokens"))


@R.add("snk10_nested_rebuild", """WITH a AS (SELECT lower(trim(md5)) AS key, count(*) AS n, min(zlibrary_id) AS first FROM zlib_book WHERE regexp_full_match(lower(trim(md5)), '[0-9a-f]{32}') GROUP BY 1), b AS (SELECT lower(trim("MD5")) AS key, count(*) AS n, min("ID") AS first FROM libgenrs_updated WHERE regexp_full_match(lower(trim("MD5")), '[0-9a-f]{32}') GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS n_zlib, coalesce(b.n, 0) AS n_rs, a.first AS first_zlib, b.first AS first_rs FROM a FULL JOIN b ON a.key = b.key""")
def snk10(s, d):
    """One nested document for each file of either catalogue, written and read again."""
    a = zl(s, d).select(T.canonical_md5(F.col("md5")).alias("k"), "zlibrary_id", "title", "extension", "filesize").where("k is not null")
    b = table(s, d, "libgenrs_updated").select(T.canonical_md5(F.col("MD5")).alias("k"), "ID", "Title", "Extension", "Size").where("k is not null")
    keys = a.select(F.col("k").alias("key")).unionByName(b.select(F.col("k").alias("key")))
    path = scratch(s)
    G.nested_documents(keys, "key", {"zlib": (a, "k"), "rs": (b, "k")}).write.parquet(path)
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return s.read.parquet(path).select("key", n("zlib"), n("rs"), F.try_element_at("zlib", F.lit(1))["zlibrary_id"].alias("first_zlib"), F.try_element_at("rs", F.lit(1))["ID"].alias("first_rs"))


@R.add("str01_stream_ingest", f"SELECT id, CAST(last_at AS VARCHAR) AS indexed_at FROM ({_LAST})")
def str01(s, d):
    """Files are ingested by a stream that is started twice; the second start finds nothing new."""
    base = scratch(s)
    e = eng(s, d).select("id", "indexed_at", "source")
    e.repartition(4, "id").write.parquet(f"{base}/in")
    out = None
    for _ in range(2):
        out = ingest(s, f"{base}/in", e.schema, f"{base}/table", f"{base}/checkpoint")
    return out.select("id", F.col("indexed_at").cast("string").alias("indexed_at"))


@R.add("str02_idempotent_batch", f"SELECT id, CAST(last_at AS VARCHAR) AS indexed_at FROM ({_LAST})")
def str02(s, d):
    path = scratch(s)
    e = eng(s, d).select("id", "indexed_at")
    for _ in range(2):
        K.upsert(s, path, e, "id", "indexed_at")
    return K.current(s, path).select("id", F.col("indexed_at").cast("string").alias("indexed_at"))


@R.add("src12_sitemap", "SELECT DISTINCT url AS loc FROM engineering_docs WHERE trim(url) <> ''")
def src12(s, d):
    """Every address in sitemaps that an index names."""
    base = scratch(s)
    e = eng(s, d).where("trim(url) != ''")
    e.select(F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")).alias("x"), "kind").write.partitionBy("kind").text(f"{base}/maps")
    kinds = [r.kind for r in e.select("kind").distinct().collect()]
    index = [(f"<sitemap><loc>http://x.example/{k}.xml</loc></sitemap>",) for k in kinds]
    s.createDataFrame(index, "x string").coalesce(1).write.text(f"{base}/index")
    return I.sitemap(s, [f"{base}/index"], lambda u: f"{base}/maps/kind={u.rsplit('/', 1)[-1][:-4]}", whole_files=False)


if find_spec("pypdf"):

    @R.add("src21_pdf_text")
    def src21(s, d):
        """Text of PDF files, empty for what is none; registered only where the PDF library is installed."""
        path = scratch(s)
        table(s, d, "region").select("r_name").coalesce(1).write.text(path)
        return I.pdf_text(s, path).select("text")


@R.add("snk02_index_documents", "SELECT 'fetched' AS counter, count(*) AS n FROM engineering_docs UNION ALL SELECT 'indexed', count(*) FROM engineering_docs WHERE length(trim(title)) > 0 UNION ALL SELECT 'errors', count(*) FROM engineering_docs WHERE NOT coalesce(length(trim(title)) > 0, false)")
def snk02(s, d):
    st = jobs.index_documents(s, scratch(s), eng(s, d).select("id", "title", "indexed_at"))
    return s.createDataFrame(sorted(st.items()), "counter string, n long")


@R.add("snk06_dry_run", "SELECT count(*) FILTER (WHERE coalesce(length(trim(md5)) > 0, false)) AS valid, count(*) FILTER (WHERE NOT coalesce(length(trim(md5)) > 0, false)) AS rejected FROM zlib_book")
def snk06(s, d):
    st = jobs.dry_run(zl(s, d), ["zlibrary_id", "md5"])
    return s.createDataFrame([(st["valid"], st["rejected"])], "valid long, rejected long")


@R.add("snk08_reindex_all", "SELECT 'repositories' AS source, 'ok ' || count(*) AS outcome FROM engineering_docs WHERE length(trim(id)) > 0 UNION ALL SELECT 'unknown', 'failed KeyError'")
def snk08(s, d):
    got = jobs.reindex_all({"repositories": _repos(s, d), "unknown": _repos(s, d)}, lambda name, df: df.count())
    return s.createDataFrame(sorted(got.items()), "source string, outcome string")


@R.add("snk09_seed", "SELECT count(DISTINCT id) AS n FROM engineering_docs")
def snk09(s, d):
    e = eng(s, d).select("id", "indexed_at", "has_code")
    batches = [e.where(F.col("has_code") == c).drop("has_code") for c in (False, True)]
    n = jobs.seed(s, scratch(s), batches, e.select("id").distinct().count())
    return s.createDataFrame([(n,)], "n long")


@R.add("ret22_request_validation", "SELECT * FROM (VALUES (0, 'valve|5|0.0|hybrid'), (1, 'valve|25|1.0|semantic'), (2, 'query must be a text that is not empty'), (3, 'limit must be a whole number'), (4, 'domain_filter must be a text')) t(n, outcome)")
def ret22(s, d):
    bodies = [{"query": " valve "}, {"query": "valve", "limit": 99, "min_score": "7", "mode": "semantic"}, {"query": ""}, {"query": "x", "limit": 1.5}, {"query": "x", "domain_filter": 3}]
    out = []
    for i, b in enumerate(bodies):
        try:
            r = requests.parse(b)
            out.append((i, f"{r.query}|{r.limit}|{r.min_score}|{r.mode}"))
        except ValueError as e:
            out.append((i, str(e)))
    return s.createDataFrame(out, "n int, outcome string")


@R.add("str03_resume", f"SELECT id, CAST(last_at AS VARCHAR) AS indexed_at FROM ({_LAST})")
def str03(s, d):
    """Files that arrive after a first run are taken up by the next, from the checkpoint."""
    base = scratch(s)
    e = eng(s, d).select("id", "indexed_at", "source", "has_code")
    out = None
    for code in (False, True):
        e.where(F.col("has_code") == code).drop("has_code").write.mode("append").parquet(f"{base}/in")
        out = ingest(s, f"{base}/in", e.drop("has_code").schema, f"{base}/table", f"{base}/checkpoint")
    return out.select("id", F.col("indexed_at").cast("string").alias("indexed_at"))


QUERIES, SQL = R.queries, R.sql
