"""Queries over the scalar functions: text, dates, identifiers, vectors, maps and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import table
from .registry import Registry

R = Registry()
docs = lambda s, d: table(s, d, "documents")
eng = lambda s, d: table(s, d, "engineering_docs")
# SQL of the token lists, for the queries below
W = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"
A = r"regexp_extract_all(lower(text), '[a-z0-9]+')"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20)"


@R.add("txt01_html_text", r"""WITH p AS (SELECT doc_id, '<html><head><title> ' || coalesce(title, '') || ' &amp; more</title><style>b{}</style></head><body><nav>menu</nav><h1>' || source || '</h1><p>' || text || '</p><br/>end &copy; 1</body></html>' AS html FROM documents),
s AS (SELECT doc_id, html, regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g') AS a FROM p),
h AS (SELECT doc_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '(?is)<header[^>]*>.*?</header>', ' ', 'g'), '(?i)</(p|div|li|h[1-6]|section|article|tr)>', chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS b FROM s),
u AS (SELECT doc_id, html, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t]+', ' ', 'g') AS c FROM h)
SELECT doc_id, trim(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS page_title,
regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(c, '\r?\n'), lambda x: trim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM u""")
def txt01(s, d):
    html = F.concat(F.lit("<html><head><title> "), T.empty(F.col("title")), F.lit(" &amp; more</title><style>b{}</style></head><body><nav>menu</nav><h1>"), F.col("source"), F.lit("</h1><p>"), F.col("text"), F.lit("</p><br/>end &copy; 1</body></html>"))
    return docs(s, d).select("doc_id", T.html_title(html).alias("page_title"), T.html_text(html).alias("body"))


@R.add("txt02_query_terms", f"SELECT doc_id, array_to_string({W}, ' ') AS terms, len({W}) AS n FROM documents")
def txt02(s, d):
    w = T.words(F.col("text"))
    return docs(s, d).select("doc_id", F.array_join(w, " ").alias("terms"), F.size(w).cast("bigint").alias("n"))


@R.add("txt03_embedding_tokens", r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS tokens FROM documents")
def txt03(s, d):
    return docs(s, d).select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("tokens"))


@R.add("txt04_ascii_tokens", f"SELECT doc_id, array_to_string({A}, ' ') AS tokens FROM documents")
def txt04(s, d):
    return docs(s, d).select("doc_id", F.array_join(T.ascii_tokens(F.col("text")), " ").alias("tokens"))


@R.add("txt05_sentences", f"WITH s AS (SELECT doc_id, {_SENT.format(c='text')} AS l FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS sentence FROM s, range(1, 100000) t(i) WHERE i <= len(l)")
def txt05(s, d):
    return docs(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@R.add("txt06_chunks", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS l FROM documents),
c AS (SELECT doc_id, i, array_to_string(l[i * 40 + 1:i * 40 + 50], ' ') AS chunk FROM w, range(0, 2000) t(i) WHERE i * 40 < len(l))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, chunk FROM c WHERE length(chunk) > 20""")
def txt06(s, d):
    return docs(s, d).select("doc_id", F.posexplode(T.chunks(F.col("text"), 50, 10)).alias("chunk_index", "chunk"))


@R.add("txt07_grounded", f"SELECT doc_id, len(list_intersect(regexp_extract_all(lower(title), '[a-z0-9]+'), {A})) >= 2 AS grounded FROM documents WHERE title IS NOT NULL")
def txt07(s, d):
    return docs(s, d).where("title is not null").select("doc_id", T.grounded(F.col("title"), F.col("text")).alias("grounded"))


@R.add("txt08_hash_embedding", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
h AS (SELECT doc_id, CAST(('0x' || md5(w)[1:8])::BIGINT % 64 AS INTEGER) AS bucket, CASE WHEN ('0x' || md5(w)[9:10])::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sgn FROM t),
v AS (SELECT doc_id, bucket, sum(sgn) AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id)
SELECT doc_id, bucket, round(x / norm, 6) AS weight FROM v JOIN n USING (doc_id) WHERE norm > 0 AND x <> 0""")
def txt08(s, d):
    from ..operators.retrieval import hash_vectors

    return hash_vectors(docs(s, d), "doc_id", F.col("text")).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@R.add("txt10_highlight", r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '\n+'), lambda x: contains(lower(x), 'valve')) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l[1:2], lambda x: regexp_replace(x, '(?i)(valve)', '<em>\1</em>', 'g')), chr(1)) AS fragments FROM s WHERE len(l) > 0""")
def txt10(s, d):
    from ..operators.retrieval import highlight

    return highlight(docs(s, d), "doc_id", F.col("text"), ["valve"]).select("doc_id", F.array_join("fragments", "\x01").alias("fragments"))


@R.add("txt11_window_highlight", r"""SELECT doc_id, substr(text, greatest(1, strpos(lower(text), 'gearbox') - 80), 160) AS fragment FROM documents WHERE contains(lower(text), 'gearbox')""")
def txt11(s, d):
    at = F.locate("gearbox", F.lower("text"))
    return docs(s, d).where(at > 0).select("doc_id", F.substr("text", F.greatest(F.lit(1), at - 80), F.lit(160)).alias("fragment"))


@R.add("txt11_fragments")
def txt11_fragments(s, d):
    """Up to two marked windows of title and of text; rows only, as SQL's patterns know no look-around."""
    from ..operators.catalogue import window_fragments

    two = docs(s, d).select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), window_fragments(F.col(c), ["gearbox", "valve"]).alias("f")) for c in ("title", "text")])).alias("x"))
    return two.where("size(x.f) > 0").select("doc_id", "x.field", F.array_join("x.f", "\x01").alias("fragments"))


@R.add("txt12_snippet")
def txt12(s, d):
    """Word-aligned snippet with prefix-aware marks around the first match; rows only, as SQL has no such cut."""
    from ..operators.retrieval import snippets

    return snippets(docs(s, d), "doc_id", F.col("text"), ["calibrat", "sensor"])


@R.add("txt13_content_chunk", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents), c AS (SELECT doc_id, x, x[1:1200] AS h FROM t)
SELECT doc_id, CASE WHEN length(x) <= 1200 THEN x ELSE rtrim(CASE WHEN strpos(reverse(h), ' ') > 0 THEN h[1:length(h) - strpos(reverse(h), ' ')] ELSE h END) || ' …' END AS chunk FROM c""")
def txt13(s, d):
    return docs(s, d).select("doc_id", T.cut_at_word(T.collapse(F.col("text"))).alias("chunk"))


@R.add("txt13_joined_highlights", r"""WITH s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\n+'), lambda x: contains(lower(x), 'valve'))[1:2] AS l FROM documents),
t AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(list_transform(l, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), ' … ') ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS x FROM s), c AS (SELECT doc_id, x, x[1:1200] AS h FROM t)
SELECT doc_id, CASE WHEN length(x) <= 1200 THEN x ELSE rtrim(CASE WHEN strpos(reverse(h), ' ') > 0 THEN h[1:length(h) - strpos(reverse(h), ' ')] ELSE h END) || ' …' END AS chunk FROM c""")
def txt13_joined(s, d):
    """What an agent is shown of each document: its marked lines joined, else its text."""
    from ..operators.catalogue import content_chunk
    from ..operators.retrieval import highlight

    marked = highlight(docs(s, d), "doc_id", F.col("text"), ["valve"])
    return docs(s, d).select("doc_id", "text").join(marked, "doc_id", "left").select("doc_id", content_chunk(F.col("fragments"), F.lit(""), F.col("text")).alias("chunk"))


@R.add("txt14_strip_description", r"SELECT zlibrary_id, regexp_replace(replace(replace(replace(replace(descr, '</p>', chr(10) || chr(10)), '</P>', chr(10) || chr(10)), '<br>', chr(10)), '<BR>', chr(10)), '<[^<]+?>', '', 'g') AS stripped FROM zlib_book WHERE descr IS NOT NULL")
def txt14(s, d):
    return table(s, d, "zlib_book").where("descr is not null").select("zlibrary_id", T.strip_description(F.col("descr")).alias("stripped"))


@R.add("txt15_keep_em", "SELECT doc_id, replace(replace(replace(replace(replace('<em>' || text || '</em>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;em&gt;', '<em>'), '&lt;/em&gt;', '</em>') AS safe FROM documents")
def txt15(s, d):
    return docs(s, d).select("doc_id", T.keep_em(F.concat(F.lit("<em>"), F.col("text"), F.lit("</em>"))).alias("safe"))


@R.add("txt16_slug", r"SELECT doc_id, rtrim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g')[1:50], '-') || '--' || source || '-' || doc_id || '.txt' AS file_name FROM documents WHERE title IS NOT NULL")
def txt16(s, d):
    slug = F.rtrim(F.substr(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", "-"), F.lit(1), F.lit(50)), F.lit("-"))
    return docs(s, d).where("title is not null").select("doc_id", F.concat(slug, F.lit("--"), F.col("source"), F.lit("-"), F.col("doc_id"), F.lit(".txt")).alias("file_name"))


@R.add("txt17_subsequence", r"SELECT doc_id, regexp_matches(lower(title), array_to_string(list_transform(string_split(source[1:4], ''), lambda c: c), '.*')) AS inside FROM documents WHERE title IS NOT NULL")
def txt17(s, d):
    return docs(s, d).where("title is not null").select("doc_id", T.is_subsequence(F.substr("source", F.lit(1), F.lit(4)), F.col("title")).alias("inside"))


_V = "(CASE WHEN upper(x[{i}]) = 'X' THEN 10 ELSE coalesce(try_cast(x[{i}] AS INTEGER), 0) END)"
_S10 = " + ".join(f"{_V.format(i=i + 1)} * {10 - i}" for i in range(10))
S13 = " + ".join(f"{_V.format(i=i + 1)} * {1 if i % 2 == 0 else 3}" for i in range(13))
_TO13 = " + ".join(f"CAST(('978' || x[1:9])[{i + 1}] AS INTEGER) * {1 if i % 2 == 0 else 3}" for i in range(12))
TO10 = " + ".join(f"CAST(x[{i + 4}] AS INTEGER) * {10 - i}" for i in range(9))


@R.add("txt18_isbns", rf"""WITH c AS (SELECT "ID" AS id, replace(replace(unnest(regexp_extract_all("ISBN", '[0-9][0-9 -]{{8,15}}[0-9Xx]')), '-', ''), ' ', '') AS x FROM libgenrs_updated WHERE "ISBN" IS NOT NULL),
ten AS (SELECT id, x FROM c WHERE regexp_full_match(x, '[0-9]{{9}}[0-9Xx]') AND ({_S10}) % 11 = 0), thirteen AS (SELECT id, x FROM c WHERE regexp_full_match(x, '[0-9]{{13}}') AND ({S13}) % 10 = 0),
u AS (SELECT id, x AS v FROM ten UNION SELECT id, '978' || x[1:9] || CAST((10 - ({_TO13}) % 10) % 10 AS VARCHAR) FROM ten UNION SELECT id, x FROM thirteen
UNION SELECT id, x[4:12] || CASE WHEN (11 - ({TO10}) % 11) % 11 = 10 THEN 'X' ELSE CAST((11 - ({TO10}) % 11) % 11 AS VARCHAR) END FROM thirteen WHERE x[1:3] = '978')
SELECT id, v AS isbn FROM u""")
def txt18(s, d):
    found = F.regexp_extract_all("ISBN", F.lit("[0-9][0-9 -]{8,15}[0-9Xx]"), F.lit(0))
    return table(s, d, "libgenrs_updated").where("ISBN is not null").select(F.col("ID").alias("id"), F.explode(T.all_isbns(found)).alias("isbn"))


@R.add("txt19_isbn_pairs", rf"""WITH c AS (SELECT "ID" AS id, replace(replace(unnest(regexp_extract_all("ISBN", '[0-9][0-9 -]{{8,15}}[0-9Xx]')), '-', ''), ' ', '') AS x FROM libgenrs_updated WHERE "ISBN" IS NOT NULL)
SELECT DISTINCT id, x AS isbn13, CASE WHEN x[1:3] = '978' THEN x[4:12] || CASE WHEN (11 - ({TO10}) % 11) % 11 = 10 THEN 'X' ELSE CAST((11 - ({TO10}) % 11) % 11 AS VARCHAR) END ELSE '' END AS isbn10 FROM c WHERE regexp_full_match(x, '[0-9]{{13}}') AND ({S13}) % 10 = 0""")
def txt19(s, d):
    found = F.explode(F.regexp_extract_all("ISBN", F.lit("[0-9][0-9 -]{8,15}[0-9Xx]"), F.lit(0)))
    rows = table(s, d, "libgenrs_updated").where("ISBN is not null").select(F.col("ID").alias("id"), found.alias("x")).select("id", F.regexp_replace("x", "[- ]", "").alias("isbn13"))
    return rows.where(T.is_isbn13(F.col("isbn13"))).select("id", "isbn13", F.coalesce(T.isbn10_of(F.col("isbn13")), F.lit("")).alias("isbn10")).distinct()


_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGE_NAMES.items()) + "}"


@R.add("txt20_language_codes", f"SELECT zlibrary_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(language), '[-_,;/]'), lambda w: {_LANG}[trim(w)]), lambda w: w IS NOT NULL))), ',') AS codes FROM zlib_book WHERE language IS NOT NULL")
def txt20(s, d):
    return table(s, d, "zlib_book").where("language is not null").select("zlibrary_id", F.array_join(T.language_codes(F.col("language")), ",").alias("codes"))


_VOTE = ", ".join(f"len(list_intersect(t, [{', '.join(repr(w) for w in ws)}])) AS n_{k}" for k, ws in T.STOP_WORDS.items())


@R.add("txt21_detect_language", rf"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM documents), v AS (SELECT doc_id, {_VOTE} FROM t)
SELECT doc_id, CASE WHEN greatest(n_de, n_en, n_es, n_fr) = 0 THEN NULL WHEN n_de = greatest(n_de, n_en, n_es, n_fr) THEN 'de' WHEN n_en = greatest(n_de, n_en, n_es, n_fr) THEN 'en' WHEN n_es = greatest(n_de, n_en, n_es, n_fr) THEN 'es' ELSE 'fr' END AS detected FROM v""")
def txt21(s, d):
    return docs(s, d).select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@R.add("txt22_varia", "SELECT e_id, concat_ws(', ', nullif(trim(volume), ''), nullif(trim(edition), ''), nullif(trim(pages), ''), nullif(trim(year), '')) AS varia FROM libgenli_editions")
def txt22(s, d):
    return table(s, d, "libgenli_editions").select("e_id", T.varia(F.col("volume"), F.col("edition"), F.col("pages"), F.col("year")).alias("varia"))


@R.add("txt23_field_name", "SELECT DISTINCT p_type, translate(lower(p_type || ' (No./A-1)'), ' -./()', '') AS field FROM part")
def txt23(s, d):
    return table(s, d, "part").select("p_type", T.field_name(F.concat(F.col("p_type"), F.lit(" (No./A-1)"))).alias("field")).distinct()


@R.add("txt24_valid_year", "SELECT zlibrary_id, coalesce(regexp_full_match(year, '[0-9]+') AND try_cast(year AS INTEGER) BETWEEN 1600 AND 2099, false) AS valid FROM zlib_book")
def txt24(s, d):
    return table(s, d, "zlib_book").select("zlibrary_id", T.valid_year(F.col("year")).alias("valid"))


@R.add("txt26_pdf_clean", r"SELECT ingest_seq, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12))), lambda x: x <> ''), chr(10)) AS clean FROM engineering_docs")
def txt26(s, d):
    lines = F.transform(F.split("body", "\n"), lambda x: F.trim(x, F.lit(" \t\r\f")))
    return eng(s, d).select("ingest_seq", F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("clean"))


@R.add("txt27_canonical_md5", "SELECT zlibrary_id, CASE WHEN regexp_full_match(lower(trim(md5)), '[0-9a-f]{32}') THEN lower(trim(md5)) END AS md5_canonical FROM zlib_book")
def txt27(s, d):
    return table(s, d, "zlib_book").select("zlibrary_id", T.canonical_md5(F.col("md5")).alias("md5_canonical"))


@R.add("mth01_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) ** 0.5, 5) AS norm, round(embedding[1]::DOUBLE / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) ** 0.5, 5) AS first_unit FROM embeddings")
def mth01(s, d):
    v = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(T.l2_norm(v), 5).alias("norm"), F.round(F.element_at(T.normalized(v), 1), 5).alias("first_unit"))


@R.add("mth02_cosine_distance", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS distance FROM embeddings, q")
def mth02(s, d):
    e = table(s, d, "embeddings")
    q = F.array(*map(F.lit, e.orderBy("vec_id").limit(1).collect()[0]["embedding"]))
    return e.select("vec_id", F.round(1 - T.cosine(F.col("embedding"), q), 5).alias("distance"))


@R.add("mth03_length_normalised", f"SELECT doc_id, round(len(list_filter({A}, lambda x: x IN ('sensor', 'valve'))) / sqrt(len({A})), 6) AS score FROM documents WHERE len({A}) > 0")
def mth03(s, d):
    t = T.ascii_tokens(F.col("text"))
    return docs(s, d).where(F.size(t) > 0).select("doc_id", F.round(F.size(F.filter(t, lambda x: x.isin("sensor", "valve"))) / F.sqrt(F.size(t)), 6).alias("score"))


@R.add("mth04_jaccard", f"WITH x AS (SELECT doc_id, list_distinct({A}) AS a, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')) AS b FROM documents) SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 4) AS similarity FROM x")
def mth04(s, d):
    return docs(s, d).select("doc_id", F.round(T.jaccard(T.ascii_tokens(F.col("text")), T.ascii_tokens(T.empty(F.col("title")))), 4).alias("similarity"))


@R.add("mth05_clamp", "SELECT p_partkey, greatest(1, least(p_size, 25)) AS clamped FROM part")
def mth05(s, d):
    return table(s, d, "part").select("p_partkey", F.greatest(F.lit(1), F.least("p_size", F.lit(25))).alias("clamped"))


@R.add("mth06_saturate", f"SELECT doc_id, round(len(list_filter({A}, lambda x: x = 'sensor')) / (len(list_filter({A}, lambda x: x = 'sensor')) + 1.5), 6) AS tf FROM documents")
def mth06(s, d):
    return docs(s, d).select("doc_id", F.round(T.saturate(F.size(F.filter(T.ascii_tokens(F.col("text")), lambda x: x == "sensor"))), 6).alias("tf"))


@R.add("prj03_search_text", r"SELECT ingest_seq, trim(concat_ws(chr(10), nullif(title, ''), nullif(array_to_string(authors, ' '), ''), nullif(abstract, ''), nullif(body, ''), nullif(array_to_string(categories, ' '), ''), nullif(array_to_string(tags, ' '), ''))) AS search_text FROM engineering_docs")
def prj03(s, d):
    from ..operators.documents import search_text

    return eng(s, d).select("ingest_seq", search_text().alias("search_text"))


@R.add("prj04_embedding_text", "SELECT ingest_seq, trim(concat_ws(chr(10), nullif(title, ''), nullif(abstract, ''), nullif(body[1:2000], ''))) AS embedding_text FROM engineering_docs")
def prj04(s, d):
    from ..operators.documents import embedding_text

    return eng(s, d).select("ingest_seq", embedding_text().alias("embedding_text"))


@R.add("prj05_document_id", "SELECT doc_id, source || ':' || sha1(source || ':' || doc_id)[1:16] AS id FROM documents")
def prj05(s, d):
    return docs(s, d).select("doc_id", T.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@R.add("prj06_flags", r"SELECT doc_id, regexp_matches(text, '(\$[^$]+\$|\\begin\{(equation|align|math)\})') AS has_equations, coalesce(kind IN ('repository', 'code'), false) AS has_code FROM documents")
def prj06(s, d):
    return docs(s, d).select("doc_id", F.col("text").rlike(T.EQUATION).alias("has_equations"), F.coalesce(F.col("kind").isin(*T.CODE_KINDS), F.lit(False)).alias("has_code"))


@R.add("prj07_lenient_date", r"""WITH p AS (SELECT ingest_seq, regexp_extract(published, '^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?', 1) AS y, regexp_extract(published, '^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?', 2) AS m, regexp_extract(published, '^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?', 3) AS dd FROM engineering_docs)
SELECT ingest_seq, CAST(coalesce(try_cast(y || '-' || CASE WHEN m = '' THEN '01' ELSE m END || '-' || CASE WHEN dd = '' THEN '01' ELSE dd END AS DATE), try_cast(y || '-01-01' AS DATE)) AS VARCHAR) AS published_date FROM p WHERE y <> '' AND y <> '0000'""")
def prj07(s, d):
    return eng(s, d).select("ingest_seq", T.lenient_date(F.col("published")).cast("string").alias("published_date")).where("published_date is not null")


@R.add("jsn01_json_fields", "SELECT event_id, CAST(props::JSON->>'k' AS BIGINT) AS k, coalesce(props::JSON->>'missing', props::JSON->>'k', '') AS fallback FROM events")
def jsn01(s, d):
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").select("event_id", k.cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), k, F.lit("")).alias("fallback"))


@R.add("jsn02_json_pairs", "WITH e AS (SELECT ingest_seq, unnest(map_entries(identifiers)) AS kv FROM engineering_docs) SELECT ingest_seq, kv.key AS id_type, kv.value AS id_value FROM e UNION ALL SELECT ingest_seq, 'batch' AS id_type, extra::JSON->>'batch' AS id_value FROM engineering_docs WHERE extra::JSON->>'batch' IS NOT NULL")
def jsn02(s, d):
    e = eng(s, d)
    batch = e.select("ingest_seq", F.lit("batch").alias("id_type"), F.get_json_object("extra", "$.batch").alias("id_value")).where("id_value is not null")
    return e.select("ingest_seq", F.explode("identifiers").alias("id_type", "id_value")).unionByName(batch)


@R.add("jsn03_complete_json", "SELECT event_id FROM events WHERE props::JSON->>'k' IS NOT NULL AND length(event_type) > 0")
def jsn03(s, d):
    return table(s, d, "events").where(F.get_json_object("props", "$.k").isNotNull() & (F.length("event_type") > 0)).select("event_id")


@R.add("prj08_vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.7g}', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def prj08(s, d):
    from ..operators.catalogue import vector_literal

    return table(s, d, "embeddings").select("vec_id", vector_literal(F.col("embedding")).alias("literal"))


QUERIES, SQL = R.queries, R.sql
