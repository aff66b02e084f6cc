"""Queries of search, ranking, filters, facets, answers and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as ans
from ..operators import documents as D
from ..operators import index as X
from ..operators import retrieval as S
from ..runtime import bounded_broadcast, table
from .registry import Registry

R = Registry()
Q4, Q2, Q1 = "calibrated sensor drift harness", "resonant valve", "gearbox"
docs = lambda s, d: table(s, d, "documents")
eng = lambda s, d: table(s, d, "engineering_docs")


def _fields() -> dict:
    t = T.empty(F.col("title"))
    return {"title": t, "search_text": F.concat(t, F.lit("\n"), F.col("text"))}


def _all_fields() -> dict:
    join = lambda c: F.array_join(F.col(c), " ")
    return {"title": F.col("title"), "abstract": F.col("abstract"), "authors": join("authors"), "equations": join("equations"), "search_text": D.search_text()}


def _bm25_sql(q: str, phrase: bool = True, need: int | None = None, src: str | None = None, boosts: dict | None = None) -> str:
    """CTEs ending in bm(id, lang, source, title, score)."""
    terms = list(dict.fromkeys(q.lower().split()))
    need = S.floor_of(len(terms)) if need is None else need
    lst = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    tok = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
    src = src or "SELECT doc_id AS id, lang, source, coalesce(title, '') AS title, coalesce(title, '') || chr(10) || text AS search_text FROM documents"
    boosts = boosts or {"title": 3.0, "search_text": 1.0}
    each = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {b} AS boost, {tok(f)} AS w FROM d" for f, b in boosts.items())
    # where each term stands, less the term's own place
    at = [f"list_transform(list_filter(range(1, len(w) + 1), lambda k: w[k] = '{t}'), lambda k: k - {i})" for i, t in enumerate(terms)]
    near = " AND ".join(f"len(list_filter(p{i}, lambda p: p >= a AND p <= a + 2)) > 0" for i in range(len(terms)))
    anywhere = " || ".join(f"p{i}" for i in range(len(terms)))
    places = ", ".join(f"{x} AS p{i}" for i, x in enumerate(at))
    return rf"""d AS ({src}), f AS ({each}),
st AS (SELECT field, count(*) AS n, avg(len(w)) AS av FROM f GROUP BY field), q AS (SELECT unnest({lst}) AS term),
h AS (SELECT id, field, boost, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS dl FROM f, q WHERE list_contains(w, term)),
dq AS (SELECT st.field, q.term, ln(1 + (st.n - coalesce(c.df, 0) + 0.5) / (coalesce(c.df, 0) + 0.5)) AS idf FROM st CROSS JOIN q LEFT JOIN (SELECT field, term, count(*) AS df FROM h GROUP BY ALL) c ON c.field = st.field AND c.term = q.term),
b AS (SELECT h.id, h.field, CASE WHEN count(*) >= {max(need, 1)} THEN any_value(boost) * sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) ELSE 0 END AS sc FROM h JOIN dq USING (field, term) JOIN st USING (field) GROUP BY h.id, h.field),
pp AS (SELECT id, field, {places} FROM f WHERE field IN ('title', 'abstract', 'search_text') AND list_has_all(w, {lst})),
ph AS (SELECT d.id, coalesce(x.extra, 0.0) AS extra FROM d LEFT JOIN (SELECT pp.id, max(boost * si) * {2.0 if phrase and len(terms) > 1 else 0.0} AS extra FROM pp JOIN (SELECT DISTINCT field, boost FROM f) USING (field) JOIN (SELECT field, sum(idf) AS si FROM dq GROUP BY field) USING (field) WHERE len(list_filter({anywhere}, lambda a: {near})) > 0 GROUP BY pp.id) x USING (id)),
bm AS (SELECT d.id, lang, source, title, round(m.sc + extra, 6) AS score FROM d JOIN (SELECT id, max(sc) AS sc FROM b GROUP BY id) m USING (id) JOIN ph USING (id) WHERE m.sc > 0)"""


def _index(s: SparkSession, d: str) -> X.TextIndex:
    """The stored index of documents; the first query of a session that needs it builds it."""
    return X.build(docs(s, d), "doc_id", _fields(), X.stored(s, f"{d}/documents.parquet", "postings"))


def _bm(s: SparkSession, d: str, q: str, keep=None, **how) -> DataFrame:
    allowed = None if keep is None else docs(s, d).where(keep).select(F.col("doc_id").alias("id"))
    return X.bm25(s, _index(s, d), q, allowed, **how)


def _near(s: SparkSession, d: str, q: str) -> DataFrame:
    """(id, score) by the stored hash vectors of the English documents."""
    path = X.stored(s, f"{d}/documents.parquet", "vectors-en")
    return S.hash_knn(X.build_vectors(docs(s, d).where("lang = 'en'"), "doc_id", F.col("text"), path), "doc_id", q)


for _name, _q, _short in (("ret02_bm25", Q4, "all"), ("ret02_bm25_one_term", Q1, "all"), ("ret03_floor_two_terms", Q2, "all"), ("ret03_floor_two_terms_any", Q2, "any")):

    @R.add(_name, f"WITH {_bm25_sql(_q, need=1 if _short == 'any' else None)} SELECT id, score FROM bm")
    def _run(s, d, q=_q, short=_short):
        return _bm(s, d, q, short=short)


@R.add("ret04_phrase_bonus", f"WITH {_bm25_sql('readings over')} SELECT id, score FROM bm")
def ret04(s, d):
    return _bm(s, d, "readings over")


_ALL = """SELECT ingest_seq AS id, language AS lang, source, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, coalesce(array_to_string(authors, ' '), '') AS authors, coalesce(array_to_string(equations, ' '), '') AS equations,
coalesce(title, '') || chr(10) || coalesce(array_to_string(authors, ' '), '') || chr(10) || coalesce(abstract, '') || chr(10) || coalesce(body, '') || chr(10) || coalesce(array_to_string(categories, ' '), '') || chr(10) || coalesce(array_to_string(tags, ' '), '') AS search_text FROM engineering_docs"""


@R.add("ret02_bm25_all_fields", f"WITH {_bm25_sql(Q2, src=_ALL, boosts={f: S.BOOSTS[f] for f in ('title', 'abstract', 'authors', 'equations', 'search_text')})} SELECT id, score FROM bm")
def ret02_all(s, d):
    """All five fields of the document model with their boosts; read row by row, without an index."""
    return S.bm25(eng(s, d), "ingest_seq", _all_fields(), Q2)


@R.add("ret02_bm25_row_by_row", f"WITH {_bm25_sql(Q4)} SELECT id, score FROM bm")
def ret02_rows(s, d):
    return S.bm25(docs(s, d), "doc_id", _fields(), Q4)


@R.add("ret05_fulltext", r"WITH p AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id FROM p WHERE contains(t, ' sensor ') AND (contains(t, ' valve ') OR contains(t, ' gearbox ')) AND NOT contains(t, ' gyroscope ') AND contains(t, ' for the ')")
def ret05(s, d):
    return docs(s, d).where(S.fulltext(F.col("text"), 'sensor valve or gearbox -gyroscope "for the"')).select("doc_id")


@R.add("ret06_weighted_rank", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS b FROM documents), r AS (SELECT doc_id, a, b, 1.0 * len(list_filter(a, lambda x: x IN ('resonant', 'valve'))) / (1 + ln(len(a) + 1.0)) + 0.2 * len(list_filter(b, lambda x: x IN ('resonant', 'valve'))) / (1 + ln(len(b) + 1.0)) AS t FROM w)
SELECT doc_id, round(CASE WHEN contains(' ' || array_to_string(a, ' ') || ' ', ' resonant valve ') OR contains(' ' || array_to_string(b, ' ') || ' ', ' resonant valve ') THEN 2 * t ELSE t END, 6) AS rank FROM r WHERE t > 0""")
def ret06(s, d):
    r = S.weighted_rank({"A": (F.col("title"), 1.0), "C": (F.col("text"), 0.2)}, Q2)
    return docs(s, d).select("doc_id", r.alias("rank")).where("rank > 0")


_EMB = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _first_vector(s, d):
    return list(table(s, d, "embeddings").orderBy("vec_id").select("embedding").limit(1).collect()[0][0])


@R.add("ret07_knn", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_EMB}::DOUBLE[]), 6) AS score FROM embeddings WHERE label < 8 ORDER BY score DESC, id LIMIT 50")
def ret07(s, d):
    return S.knn(table(s, d, "embeddings"), "vec_id", "embedding", _first_vector(s, d), 50, F.col("label") < 8)


@R.add("ret08_approximate_knn")
def ret08(s, d):
    """Candidates by one-byte codes, stored once; rows only, as its recall is tested and not certain."""
    e, path = table(s, d, "embeddings"), X.stored(s, f"{d}/embeddings.parquet", "codes")
    codes = X.stored_table(s, path, lambda: S.quantize(e, "vec_id", "embedding"))
    return S.approximate_knn(e, "vec_id", "embedding", _first_vector(s, d), 20, codes)


@R.add("ret09_browse", "SELECT doc_id AS id, CAST(added_at AS VARCHAR) AS added FROM documents WHERE lang = 'en' ORDER BY added_at DESC NULLS LAST, doc_id LIMIT 100")
def ret09(s, d):
    top = docs(s, d).where("lang = 'en'").orderBy(F.desc_nulls_last("added_at"), "doc_id").limit(100)
    return top.select(F.col("doc_id").alias("id"), F.col("added_at").cast("string").alias("added"))


def _hash_sql(q: str) -> str:
    v = S.hash_vector(q)
    lit = ", ".join(f"({b}, {x!r})" for b, x in v.items())
    return rf"""hv AS (SELECT doc_id, CAST(('0x' || md5(w)[1:8])::BIGINT % 64 AS INTEGER) AS bucket, sum(CASE WHEN ('0x' || md5(w)[9:10])::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS x FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents WHERE lang = 'en') GROUP BY ALL),
hn AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM hv GROUP BY doc_id), qv(bucket, qx) AS (VALUES {lit}),
kn AS (SELECT doc_id AS id, round(sum(x / norm * qx), 6) AS score FROM hv JOIN hn USING (doc_id) JOIN qv USING (bucket) WHERE x <> 0 GROUP BY doc_id)"""


def _hybrid_sql(q: str) -> str:
    return rf"""{_bm25_sql(q)}, {_hash_sql(q)},
l0 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT * FROM bm WHERE lang = 'en' ORDER BY score DESC, id LIMIT 100)),
l1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT * FROM kn ORDER BY score DESC, id LIMIT 100)),
fu AS (SELECT id, round(sum(1.0 / (60 + r + 1)), 6) AS score, min(l * 1000 + r) AS o FROM (SELECT id, r, 0 AS l FROM l0 UNION ALL SELECT id, r, 1 FROM l1) GROUP BY id)"""


def hybrid(s: SparkSession, d: str, q: str = Q4, page: int = 1, per_page: int = 20) -> DataFrame:
    """Lexical and vector candidates fused; the page's rows get their titles by a join of at most per_page rows."""
    lists = [S.ranked(_bm(s, d, q, F.col("lang") == "en"), S.CANDIDATES), S.ranked(_near(s, d, q), S.CANDIDATES)]
    fused = S.rrf([x.select("id", "rank") for x in lists])
    pg = S.page_of(fused, page, per_page, F.desc("score"), F.col("first_list"), F.col("first_rank"))
    top = pg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "first_list", "first_rank")))
    shown = docs(s, d).select(F.col("doc_id").alias("id"), "title")
    return shown.join(F.broadcast(top), "id").select("id", "rank", "score", S.relevance(F.col("score"), S.score_ceiling(2)).alias("relevance"), "title")


@R.add("ret01_hybrid_search", f"WITH {_hybrid_sql(Q4)}, p AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, o) AS rank FROM fu) SELECT p.id, CAST(rank AS INTEGER) AS rank, p.score, round(least(p.score / (2.0 / 61), 1), 4) AS relevance, dd.title FROM p JOIN documents dd ON dd.doc_id = p.id WHERE rank <= 20")
def ret01(s, d):
    return hybrid(s, d)


@R.add("srt02_second_page", f"WITH {_hybrid_sql(Q4)}, p AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, o) AS n FROM fu) SELECT id, score FROM p WHERE n > 20 AND n <= 40")
def srt02(s, d):
    return hybrid(s, d, page=2).select("id", "score")


@R.add("ret10_rrf", f"WITH {_hybrid_sql(Q4)} SELECT id, score FROM fu")
def ret10(s, d):
    lists = [S.ranked(_bm(s, d, Q4, F.col("lang") == "en"), 100), S.ranked(_near(s, d, Q4), 100)]
    return S.rrf(lists).select("id", "score")


@R.add("ret11_single_list", "SELECT vec_id AS id, round(1.0 / row_number() OVER (ORDER BY vec_id), 6) AS score FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100)")
def ret11(s, d):
    top = table(s, d, "embeddings").select(F.col("vec_id").alias("id")).orderBy("id").limit(100)
    return top.select("id", F.round(1 / F.row_number().over(Window.orderBy("id")), 6).alias("score"))


@R.add("ret12_score_ceiling", "SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 1.0::DOUBLE), (2, round(2.0::DOUBLE / 61, 8)), (3, round(3.0::DOUBLE / 61, 8))) t(n_lists, ceiling)")
def ret12(s, d):
    return s.createDataFrame([(n, round(S.score_ceiling(n), 8)) for n in range(4)], "n_lists int, ceiling double")


@R.add("ret13_candidate_merge", f"WITH {_hybrid_sql(Q4)} SELECT id, CAST(o // 1000 AS INTEGER) AS first_list FROM fu")
def ret13(s, d):
    lists = [S.ranked(_bm(s, d, Q4, F.col("lang") == "en"), 100), S.ranked(_near(s, d, Q4), 100)]
    return S.rrf(lists).select("id", "first_list")


@R.add("ret14_surviving_branch", f"WITH {_hybrid_sql(Q4)} SELECT id, score FROM fu")
def ret14(s, d):
    """Fuses the branches that work. One fails when planned, as documents carry no vector column, one while it runs."""
    broken = docs(s, d).select(F.col("doc_id").alias("id"), F.raise_error(F.lit("branch down")).cast("double").alias("score"))
    return X.fuse([lambda: _bm(s, d, Q4, F.col("lang") == "en"), lambda: S.knn(docs(s, d), "doc_id", "embedding", [1.0], 10), lambda: _near(s, d, Q4), lambda: broken])


@R.add("ret15_related", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_EMB}::DOUBLE[]), 6) AS score FROM embeddings WHERE vec_id <> (SELECT min(vec_id) FROM embeddings) ORDER BY score DESC, id LIMIT 8")
def ret15(s, d):
    e = table(s, d, "embeddings")
    return S.related(e, "vec_id", "embedding", e.agg(F.min("vec_id")).collect()[0][0])


@R.add("ret16_related_by_terms")
def ret16(s, d):
    """The document's 25 strongest terms of title and text as a query of any of them; rows only, as near-equal weights
    may swap terms."""
    of = docs(s, d).agg(F.min("doc_id")).collect()[0][0]
    return X.more_like(s, _index(s, d), docs(s, d), "doc_id", {"title": F.col("title"), "text": F.col("text")}, of)


@R.add("ret17_degrade_to_lexical", f"WITH {_bm25_sql(Q2)} SELECT id, score FROM bm")
def ret17(s, d):
    """A semantic search over a table without vectors is answered by the lexical one."""
    src = docs(s, d)
    return S.knn(src, "doc_id", "embedding", [1.0], 100) if "embedding" in src.columns else _bm(s, d, Q2)


_RR = """CASE WHEN contains(lower(coalesce(title, '')), 'resonant valve') THEN 1.35 WHEN contains(lower({b}), 'resonant valve') THEN 1.15 ELSE 1.0 END * CASE WHEN contains(lower(coalesce(title, '')), 'resonant') AND contains(lower(coalesce(title, '')), 'valve') THEN 1.25 ELSE 1.0 END"""


@R.add("ret18_rerank", f"SELECT doc_id, round(10.0 * {_RR.format(b='text')}, 6) AS score FROM documents")
def ret18(s, d):
    return docs(s, d).select("doc_id", F.round(S.rerank(F.lit(10.0), F.col("title"), F.col("text"), Q2), 6).alias("score"))


@R.add("ret19_acronyms", "SELECT * FROM (VALUES ('DMA buffer', 'DMA buffer direct memory access'), ('spi SPI serial', 'spi SPI serial peripheral interface'), ('plain', 'plain')) t(query, expanded)")
def ret19(s, d):
    q = s.createDataFrame([("DMA buffer",), ("spi SPI serial",), ("plain",)], "query string")
    return q.select("query", F.array_join(T.expand_acronyms(T.words(F.col("query"))), " ").alias("expanded"))


@R.add("ret20_relevance", f"WITH {_hybrid_sql(Q4)} SELECT id, round(least(score / (2.0 / 61), 1), 4) AS relevance FROM fu")
def ret20(s, d):
    return ret10(s, d).select("id", S.relevance(F.col("score"), S.score_ceiling(2)).alias("relevance"))


@R.add("ret21_agent_results", f"WITH {_hybrid_sql(Q4)}, a AS (SELECT id, round(least(score / (2.0 / 61), 1), 4) AS relevance FROM fu) SELECT id, relevance, dd.source, dd.title FROM a JOIN documents dd ON dd.doc_id = a.id WHERE relevance >= 0.3")
def ret21(s, d):
    a = ret20(s, d).where("relevance >= 0.3")
    return docs(s, d).select(F.col("doc_id").alias("id"), "source", "title").join(bounded_broadcast(a, 1000), "id").select("id", "relevance", "source", "title")


@R.add("ret23_three_tiers", r"""WITH p AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents), k AS (SELECT doc_id, CASE WHEN contains(t, ' sealed valve ') THEN 1 WHEN contains(t, ' sealed ') AND contains(t, ' valve ') THEN 2 WHEN contains(t, ' sealed ') OR contains(t, ' valve ') THEN 3 END AS tier FROM p)
SELECT doc_id, tier FROM k WHERE tier IS NOT NULL ORDER BY tier, doc_id LIMIT 200""")
def ret23(s, d):
    t = F.col("text")
    tiers = [S.fulltext(t, '"sealed valve"'), S.fulltext(t, "sealed valve"), S.fulltext(t, "sealed or valve")]
    out, seen = None, None
    for i, c in enumerate(tiers, 1):
        hit = docs(s, d).where(c).select("doc_id")
        new = hit if seen is None else hit.join(seen, "doc_id", "left_anti")
        seen = hit if seen is None else seen.unionByName(new)
        out = new.withColumn("tier", F.lit(i)) if out is None else out.unionByName(new.withColumn("tier", F.lit(i)))
    return out.orderBy("tier", "doc_id").limit(200)


@R.add("ret24_query_routing", "SELECT zlibrary_id, CASE WHEN regexp_full_match(md5, '[a-f0-9]{32}') THEN 'md5' WHEN regexp_full_match(md5, 'OL[0-9]+M') THEN 'edition' WHEN regexp_full_match(replace(md5, '-', ''), '[0-9]{9}[0-9X]|[0-9]{13}') THEN 'isbn' ELSE 'text' END AS route FROM zlib_book WHERE md5 IS NOT NULL")
def ret24(s, d):
    m = F.col("md5")
    route = F.when(m.rlike("^[a-f0-9]{32}$"), "md5").when(m.rlike("^OL[0-9]+M$"), "edition").when(F.regexp_replace(m, "-", "").rlike("^([0-9]{9}[0-9X]|[0-9]{13})$"), "isbn").otherwise("text")
    return table(s, d, "zlib_book").where("md5 is not null").select("zlibrary_id", route.alias("route"))


_TOK = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
_CR = "CASE WHEN x = '{t}' THEN 1.0 WHEN length(x) >= 4 AND (starts_with(x, '{t}') OR starts_with('{t}', x)) THEN 0.6 ELSE 0.0 END"


def _lex_sql(terms: list[str]) -> str:
    cols = {"title": "coalesce(title, '')", "abstract": "text", "tags": "coalesce(lang, '')", "meta": "source || ' ' || coalesce(kind, '')"}
    m = ", ".join(f"coalesce(list_sum(list_transform({_TOK.format(c=c)}, lambda x: {' + '.join(_CR.format(t=t) for t in terms)})), 0) AS m_{n}" for n, c in cols.items())
    cov = ", ".join(f"CAST(len(list_filter(list_concat({', '.join(_TOK.format(c=c) for c in cols.values())}), lambda x: {_CR.format(t=t)} > 0)) > 0 AS INTEGER) AS c_{i}" for i, t in enumerate(terms))
    total = " + ".join(f"{w} * m_{n} / (m_{n} + 1.5)" for n, w in S.FIELD_WEIGHTS.items())
    q = " ".join(terms)
    return f"WITH m AS (SELECT doc_id, coalesce(title, '') AS title, text, {m}, {cov} FROM documents) SELECT doc_id, title, text, ({total}) * (0.25 + 0.75 * ({' + '.join(f'c_{i}' for i in range(len(terms)))}) / {len(terms)}) * CASE WHEN contains(lower(title), '{q}') THEN 1.75 WHEN contains(lower(text), '{q}') THEN 1.35 ELSE 1.0 END AS score FROM m"


def _lex(s, d):
    f = {"title": F.col("title"), "abstract": F.col("text"), "tags": F.col("lang"), "meta": F.concat("source", F.lit(" "), T.empty(F.col("kind")))}
    return docs(s, d).withColumn("score", S.lexical_score(f, Q2))


for _name in ("ret26_field_score", "ret27_coverage_and_phrase"):

    @R.add(_name, f"SELECT doc_id, round(score, 6) AS score FROM ({_lex_sql(Q2.split())}) WHERE score > 0")
    def _lexq(s, d):
        return _lex(s, d).select("doc_id", F.round("score", 6).alias("score")).where("score > 0")


_JRR = "CASE WHEN contains(lower(title), 'resonant') AND contains(lower(title), 'valve') THEN 1.25 ELSE 1.0 END * CASE WHEN contains(lower(text), 'resonant') AND contains(lower(text), 'valve') THEN 1.15 ELSE 1.0 END"


@R.add("ret28_lexical_rerank", f"SELECT doc_id, round(score * {_JRR}, 6) AS score FROM ({_lex_sql(Q2.split())}) WHERE score > 0")
def ret28(s, d):
    return _lex(s, d).where("score > 0").select("doc_id", F.round(S.lexical_rerank(F.col("score"), F.col("title"), F.col("text"), Q2), 6).alias("score")).where("score > 0")


@R.add("ret29_offline_search", f"SELECT doc_id, round(score * {_JRR}, 6) AS score FROM ({_lex_sql(Q2.split())}) WHERE round(score, 6) > 0 ORDER BY score DESC, doc_id LIMIT 20")
def ret29(s, d):
    return ret28(s, d).orderBy(F.desc("score"), "doc_id").limit(20)


@R.add("ret30_paging", "SELECT lang, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, count(*) > 20 AS has_next FROM documents GROUP BY lang")
def ret30(s, d):
    n = F.count("*")
    return docs(s, d).groupBy("lang").agg(n.alias("total"), F.ceil(n / 20.0).alias("pages"), (n > 20).alias("has_next"))


# filters and projections -------------------------------------------------------------------------------------------
for _name, _f, _w in (
    ("flt01_in_lists", D.Filters(sources=["nevvenarchive", "pelmohub"], kinds=["paper", "report"], language=["en", "EN"]), "source IN ('nevvenarchive', 'pelmohub') AND kind IN ('paper', 'report') AND language IN ('en', 'EN')"),
    ("flt02_any_category", D.Filters(categories=["annealing", "filtering"]), "list_has_any(categories, ['annealing', 'filtering'])"),
    ("flt03_version", D.Filters(version="v2.7"), "version = 'v2.7'"),
    ("flt04_flags", D.Filters(has_code=True, has_equations=False), "has_code AND NOT has_equations"),
    ("flt06_all_filters", D.Filters(sources=["nevvenarchive", "ulporpress"], categories=["interpolation"], has_code=False), "source IN ('nevvenarchive', 'ulporpress') AND list_has_any(categories, ['interpolation']) AND NOT has_code"),
):

    @R.add(_name, f"SELECT ingest_seq, id FROM engineering_docs WHERE {_w}")
    def _flt(s, d, f=_f):
        return f.apply(eng(s, d)).select("ingest_seq", "id")


@R.add("flt05_years", r"SELECT ingest_seq FROM engineering_docs WHERE regexp_matches(published, '^(2018|2019|2020)') ")
def flt05(s, d):
    return D.Filters(year_from=2018, year_to=2020).apply(eng(s, d)).select("ingest_seq")


@R.add("flt07_domain_filter", "SELECT ingest_seq, 'kind:report' AS domain FROM engineering_docs WHERE kind = 'report' UNION ALL SELECT ingest_seq, 'pelmohub' FROM engineering_docs WHERE source = 'pelmohub' UNION ALL SELECT ingest_seq, 'annealing' FROM engineering_docs WHERE list_has_any(categories, ['annealing'])")
def flt07(s, d):
    e = eng(s, d)
    asked = s.createDataFrame([(q,) for q in ("kind:report", "pelmohub", "annealing", "")], "domain string")
    resolved = D.resolve_domains(asked, "domain", table(s, d, "source_profiles"))
    return D.in_domain(e, resolved).select("ingest_seq", "domain")


@R.add("flt08_exclusion_list", "SELECT zlibrary_id FROM zlib_book z WHERE NOT EXISTS (SELECT 1 FROM libgenrs_updated r WHERE lower(r.\"MD5\") = lower(z.md5))")
def flt08(s, d):
    bad = table(s, d, "libgenrs_updated").select(F.lower("MD5").alias("m"))
    z = table(s, d, "zlib_book").select("zlibrary_id", F.lower("md5").alias("m"))
    return z.join(bad, "m", "left_anti").select("zlibrary_id")


@R.add("flt09_case_insensitive", "SELECT ingest_seq FROM engineering_docs WHERE lower(language) IN ('en', 'eng', 'english') AND has_code")
def flt09(s, d):
    return eng(s, d).where(F.lower("language").isin("en", "eng", "english") & F.col("has_code")).select("ingest_seq")


@R.add("flt10_array_lookup", "SELECT ingest_seq FROM engineering_docs WHERE list_contains(tags, 'actuator') ORDER BY ingest_seq LIMIT 100")
def flt10(s, d):
    return eng(s, d).where(F.array_contains("tags", "actuator")).select("ingest_seq").orderBy("ingest_seq").limit(100)


@R.add("prj01_public_document", "SELECT ingest_seq, id, source, kind, title, array_to_string(authors, '|') AS authors, array_to_string(categories, '|') AS categories, published, has_code, round(popularity, 3) AS popularity FROM engineering_docs")
def prj01(s, d):
    j = lambda c: F.array_join(c, "|").alias(c)
    return D.public(eng(s, d)).select("ingest_seq", "id", "source", "kind", "title", j("authors"), j("categories"), "published", "has_code", F.round(F.col("popularity").cast("double"), 3).alias("popularity"))


@R.add("prj02_envelope", "SELECT doc_id, title, coalesce(kind, 'other') AS kind, CAST(n_chars AS DOUBLE) AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def prj02(s, d):
    hit = docs(s, d).orderBy(F.desc("n_chars"), "doc_id").limit(20).select(F.struct("doc_id", "title", F.coalesce("kind", F.lit("other")).alias("kind")).alias("document"), F.col("n_chars").cast("double").alias("score"))
    return hit.select("document.*", "score")


@R.add("prj09_compact_record", "SELECT zlibrary_id, title[1:30] AS title, publisher[1:20] AS publisher, array_to_string(string_split(authors, ' ')[1:2], ' ') AS lead, length(coalesce(descr, '')) > 0 AS has_description FROM zlib_book")
def prj09(s, d):
    z = table(s, d, "zlib_book")
    sub = lambda c, n: F.substr(c, F.lit(1), F.lit(n)).alias(c)
    return z.select("zlibrary_id", sub("title", 30), sub("publisher", 20), F.array_join(F.slice(F.split("authors", " "), 1, 2), " ").alias("lead"), (F.length(T.empty(F.col("descr"))) > 0).alias("has_description"))


# facets and counts ---------------------------------------------------------------------------------------------------
def _facet_sql(name: str, col: str, src: str, limit: str = "ORDER BY \"count\" DESC, value LIMIT 20") -> str:
    return f"SELECT * FROM (SELECT '{name}' AS facet, CAST({col} AS VARCHAR) AS value, count(*) AS count FROM {src} WHERE {col} IS NOT NULL GROUP BY ALL {limit})"


@R.add("agg01_terms_facets", " UNION ALL ".join(_facet_sql(c, c, "engineering_docs") for c in ("source", "kind", "language")))
def agg01(s, d):
    a, b, c = (S.facet(eng(s, d), x, F.col(x)) for x in ("source", "kind", "language"))
    return a.unionByName(b).unionByName(c)


@R.add("agg02_array_facet", _facet_sql("category", "c", "(SELECT unnest(categories) AS c FROM engineering_docs)"))
def agg02(s, d):
    return S.facet(eng(s, d).select(F.explode("categories").alias("c")), "category", F.col("c"))


@R.add("agg03_boolean_facets", "SELECT 'has_code' AS facet, CAST(has_code AS VARCHAR) AS value, count(*) AS count FROM engineering_docs GROUP BY ALL UNION ALL SELECT 'has_equations', CAST(has_equations AS VARCHAR), count(*) FROM engineering_docs GROUP BY ALL")
def agg03(s, d):
    one = lambda c: eng(s, d).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("count")).select(F.lit(c).alias("facet"), "value", "count")
    return one("has_code").unionByName(one("has_equations"))


@R.add("agg04_match_facets", f"WITH {_bm25_sql(Q4)} {_facet_sql('lang', 'lang', 'bm')} UNION ALL {_facet_sql('source', 'source', 'bm')}")
def agg04(s, d):
    hits = docs(s, d).join(_bm(s, d, Q4).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return S.facet(hits, "lang", F.col("lang")).unionByName(S.facet(hits, "source", F.col("source")))


@R.add("agg05_facets_with_total", f"WITH {_bm25_sql(Q4)} SELECT 'total' AS facet, '' AS value, count(*) AS count FROM bm UNION ALL {_facet_sql('lang', 'lang', 'bm')}")
def agg05(s, d):
    hits = docs(s, d).join(_bm(s, d, Q4).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    total = hits.agg(F.count("*").alias("count")).select(F.lit("total").alias("facet"), F.lit("").alias("value"), "count")
    return total.unionByName(S.facet(hits, "lang", F.col("lang")))


@R.add("agg06_count", "SELECT count(*) AS n FROM engineering_docs")
def agg06(s, d):
    return eng(s, d).agg(F.count("*").alias("n"))


@R.add("agg07_sorted_facet", "SELECT 'kind' AS facet, kind AS value, count(*) AS count FROM documents WHERE kind IS NOT NULL AND kind <> '' GROUP BY kind")
def agg07(s, d):
    return S.facet(docs(s, d).where("kind != ''"), "kind", F.col("kind"), None).orderBy("value")


@R.add("agg08_bookmark_counts", "SELECT s_id, count(e_id) AS n FROM libgenli_series LEFT JOIN libgenli_editions USING (s_id) GROUP BY s_id")
def agg08(s, d):
    return table(s, d, "libgenli_series").select("s_id").join(table(s, d, "libgenli_editions").select("s_id", "e_id"), "s_id", "left").groupBy("s_id").agg(F.count("e_id").alias("n"))


@R.add("agg09_distinct_keys", "SELECT count(DISTINCT lower(md5)) AS n FROM (SELECT md5 FROM zlib_book UNION ALL SELECT \"MD5\" FROM libgenrs_updated) WHERE md5 <> ''")
def agg09(s, d):
    keys = table(s, d, "zlib_book").select("md5").unionByName(table(s, d, "libgenrs_updated").select(F.col("MD5").alias("md5"))).where("md5 != ''")
    return keys.agg(F.countDistinct(F.lower("md5")).alias("n"))


@R.add("agg10_ingest_stats", "SELECT source, count(*) AS fetched, count(*) FILTER (WHERE length(coalesce(title, '')) > 0) AS indexed, count(*) FILTER (WHERE length(coalesce(title, '')) = 0) AS errors FROM engineering_docs GROUP BY source")
def agg10(s, d):
    good = F.length(T.empty(F.col("title"))) > 0
    return eng(s, d).groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(good).alias("indexed"), F.count_if(~good).alias("errors"))


@R.add("win01_list_rank", "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS INTEGER) AS rank FROM documents ORDER BY rank LIMIT 100")
def win01(s, d):
    top = docs(s, d).orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return top.select("doc_id", (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("rank"))


@R.add("srt01_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def srt01(s, d):
    return docs(s, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@R.add("srt03_stable_ties", f"WITH {_hybrid_sql(Q4)} SELECT id, CAST(row_number() OVER (ORDER BY score DESC, o) AS INTEGER) AS place FROM fu ORDER BY score DESC, o LIMIT 50")
def srt03(s, d):
    fused = S.rrf([S.ranked(_bm(s, d, Q4, F.col("lang") == "en"), 100), S.ranked(_near(s, d, Q4), 100)])
    order = [F.desc("score"), F.col("first_list"), F.col("first_rank")]
    return fused.orderBy(*order).limit(50).select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


# answers and comparison ----------------------------------------------------------------------------------------------
_S = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20)"
_CHOSEN = f"""WITH top AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 8),
sn AS (SELECT idx, unnest({_S.format(c='text[1:1500]')}) AS sent, generate_subscripts({_S.format(c='text[1:1500]')}, 1) AS pos FROM top),
sc AS (SELECT idx, pos, sent, round(len(list_filter(regexp_extract_all(lower(sent), '[a-z0-9]+'), lambda x: x IN ('resonant', 'valve'))) / sqrt(len(regexp_extract_all(lower(sent), '[a-z0-9]+'))) + 0.25 / (idx + 1), 9) AS score FROM sn WHERE len(regexp_extract_all(lower(sent), '[a-z0-9]+')) > 0),
u AS (SELECT *, row_number() OVER (PARTITION BY lower(sent[1:80]) ORDER BY score DESC, idx, pos) AS n FROM sc), c AS (SELECT idx, pos, sent, score FROM u WHERE n = 1 ORDER BY score DESC, idx, pos LIMIT 5)"""


@R.add("ans01_extractive_answer", f"{_CHOSEN} SELECT string_agg(sent || ' [' || (idx + 1) || ']', ' ' ORDER BY idx, score DESC, pos) AS answer FROM c")
def ans01(s, d):
    return ans.extractive(docs(s, d).where("lang = 'en'").orderBy("doc_id").limit(8), F.col("text"), F.col("doc_id"), Q2)


@R.add("ans02_citations", "SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS n, doc_id, title, source FROM (SELECT doc_id, title, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 8)")
def ans02(s, d):
    return ans.citations(docs(s, d).where("lang = 'en'").orderBy("doc_id").limit(8), F.col("doc_id")).select("n", "doc_id", "title", "source")


@R.add("ans03_fallback", f"SELECT doc_id, coalesce(nullif(array_to_string(list_transform(({_S.format(c='text')})[1:2], lambda x: x || ' [1]'), ' '), ''), title, 'No relevant documents were found.') AS answer FROM documents")
def ans03(s, d):
    return docs(s, d).select("doc_id", ans.fallback(F.col("text"), F.col("title")).alias("answer"))


@R.add("ans05_compare", r"""WITH x AS (SELECT ingest_seq, source, list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(abstract, '')), '[a-z0-9]+')) AS t, coalesce(categories, []) AS c FROM engineering_docs WHERE title IS NOT NULL), p AS (SELECT a.ingest_seq AS a, b.ingest_seq AS b, a.t AS ta, b.t AS tb, a.c AS ca, b.c AS cb FROM x a JOIN x b ON b.ingest_seq = a.ingest_seq + 1)
SELECT a, b, array_to_string(list_sort(list_distinct(list_intersect(ca, cb))), '|') AS shared_categories, array_to_string(list_sort(list_distinct(list_filter(ca, lambda v: NOT list_contains(cb, v)))), '|') AS only_a, array_to_string(list_sort(list_distinct(list_filter(cb, lambda v: NOT list_contains(ca, v)))), '|') AS only_b,
array_to_string(list_sort(list_intersect(ta, tb))[1:40], ' ') AS shared_terms, round(CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0 ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END, 4) AS similarity FROM p""")
def ans05(s, d):
    e = eng(s, d).where("title is not null").select("ingest_seq", "categories", F.concat("title", F.lit(" "), T.empty(F.col("abstract"))).alias("text"))
    return ans.compare(e, e.withColumn("ingest_seq", F.col("ingest_seq") - 1), "ingest_seq").withColumn("b", F.col("a") + 1)


@R.add("ans06_grounded_answer", f"""WITH sn AS (SELECT doc_id, text, unnest({_S.format(c='text')}) AS sent, generate_subscripts({_S.format(c='text')}, 1) AS pos FROM documents WHERE lang = 'en'),
sc AS (SELECT doc_id, pos, sent, len(list_filter(regexp_extract_all(lower(sent), '[a-z0-9]+'), lambda x: x IN ('resonant', 'valve'))) AS overlap FROM sn) SELECT doc_id, sent, CAST(overlap AS INTEGER) AS overlap FROM sc WHERE overlap > 0 AND len(list_distinct(regexp_extract_all(lower(sent), '[a-z0-9]+'))) >= 2 ORDER BY overlap DESC, doc_id, pos LIMIT 4""")
def ans06(s, d):
    return ans.grounded_sentences(docs(s, d).where("lang = 'en'"), "doc_id", F.col("text"), ["resonant", "valve"], 4)


QUERIES, SQL = R.queries, R.sql
