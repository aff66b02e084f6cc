"""Normalisers of harvested payloads: a JSON string column ``raw`` in, document columns out, without user code.

All give native, title, abstract, url, pdf_url, authors, published, categories, tags, language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Source, register

LINK = "struct<rel:string,href:string>"


def _e(c: str) -> Column:
    return F.coalesce(F.col(f"r.{c}"), F.lit(""))


def _list(c: Column) -> Column:
    return F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def _split(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def _parse(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("raw", schema).alias("r"), "raw").where("r is not null")


def repository(df: DataFrame) -> DataFrame:
    p = _parse(df, "full_name string, description string, html_url string, owner struct<login:string>, created_at string, language string, topics array<string>, stargazers_count double, license struct<spdx_id:string>")
    lang = F.col("r.language")
    return p.select(
        F.col("r.full_name").alias("native"), F.col("r.full_name").alias("title"), _e("description").alias("abstract"), _e("html_url").alias("url"), F.lit("").alias("pdf_url"),
        F.array(F.coalesce("r.owner.login", F.lit(""))).alias("authors"), F.col("r.created_at").alias("published"), _list(F.array(lang)).alias("categories"), _list(F.col("r.topics")).alias("tags"), lang.alias("language"),
        F.coalesce("r.stargazers_count", F.lit(0.0)).alias("popularity"), F.col("r.license.spdx_id").alias("license"),
    )


def code_file(df: DataFrame) -> DataFrame:
    p = _parse(df, "repository struct<full_name:string>, path string, html_url string")
    repo, path = F.coalesce("r.repository.full_name", F.lit("")), _e("path")
    return p.select(
        F.concat(repo, F.lit("/"), path).alias("native"), F.concat(path, F.lit(" — "), repo).alias("title"), F.concat(F.lit("Source file "), path, F.lit(" in "), repo).alias("abstract"), _e("html_url").alias("url"), F.lit("").alias("pdf_url"),
        F.array().cast("array<string>").alias("authors"), F.lit(None).cast("string").alias("published"), F.array(repo).alias("categories"), F.when(path.contains("."), F.array(F.substring_index(path, ".", -1))).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit(None).cast("string").alias("language"),
    )


def report(df: DataFrame, base: str = "https://reports.example") -> DataFrame:
    """Authors nested in affiliations; of the first download with one, the pdf, original or fulltext link."""
    p = _parse(df, "id string, title string, abstract string, authorAffiliations array<struct<meta:struct<author:struct<name:string>>>>, downloads array<struct<links:struct<pdf:string,original:string,fulltext:string>>>, distributionDate string, created string, subjectCategories array<string>, keywords array<string>")
    links = F.filter(F.transform("r.downloads", lambda x: F.coalesce(x["links"]["pdf"], x["links"]["original"], x["links"]["fulltext"])), lambda x: x.isNotNull())
    first = F.coalesce(F.try_element_at(links, F.lit(1)), F.lit(""))
    return p.select(
        F.col("r.id").alias("native"), F.trim(_e("title")).alias("title"), F.trim(_e("abstract")).alias("abstract"), F.concat(F.lit(base + "/citations/"), F.col("r.id")).alias("url"),
        F.when((first == "") | F.startswith(first, F.lit("http")), first).otherwise(F.concat(F.lit(base), first)).alias("pdf_url"), _list(F.transform("r.authorAffiliations", lambda x: x["meta"]["author"]["name"])).alias("authors"),
        F.coalesce("r.distributionDate", "r.created").alias("published"), _list(F.col("r.subjectCategories")).alias("categories"), _list(F.col("r.keywords")).alias("tags"), F.lit("en").alias("language"),
    )


def energy_report(df: DataFrame, base: str = "https://energy.example/biblio/") -> DataFrame:
    """Authors as one string; links by relation, the last one of a relation counting."""
    p = _parse(df, f"osti_id string, title string, description string, authors string, links array<{LINK}>, publication_date string, research_orgs string, subjects string, language string, doi string")
    last = lambda rel: F.try_element_at(F.transform(F.filter("r.links", lambda x: (x["rel"] == rel) & x["href"].isNotNull()), lambda x: x["href"]), F.lit(-1))
    return p.select(
        F.col("r.osti_id").alias("native"), F.trim(_e("title")).alias("title"), F.trim(_e("description")).alias("abstract"), F.coalesce(last("citation"), F.concat(F.lit(base), F.col("r.osti_id"))).alias("url"), F.coalesce(last("fulltext"), F.lit("")).alias("pdf_url"),
        _split(_e("authors")).alias("authors"), F.col("r.publication_date").alias("published"), _split(_e("research_orgs")).alias("categories"), _split(_e("subjects")).alias("tags"), F.substr(F.lower(F.coalesce(F.nullif("r.language", F.lit("")), F.lit("en"))), F.lit(1), F.lit(2)).alias("language"),
    )


def article(df: DataFrame, most: int = 30) -> DataFrame:
    """Index terms of all groups in one list of at most ``most``."""
    p = _parse(df, "article_number string, title string, abstract string, html_url string, pdf_url string, authors struct<authors:array<struct<full_name:string>>>, publication_date string, content_type string, index_terms map<string,struct<terms:array<string>>>")
    terms = F.flatten(F.transform(F.map_values("r.index_terms"), lambda x: F.coalesce(x["terms"], F.array().cast("array<string>"))))
    return p.select(
        F.col("r.article_number").alias("native"), F.trim(_e("title")).alias("title"), F.trim(_e("abstract")).alias("abstract"), _e("html_url").alias("url"), _e("pdf_url").alias("pdf_url"), _list(F.transform("r.authors.authors", lambda x: x["full_name"])).alias("authors"),
        F.col("r.publication_date").alias("published"), _list(F.array(F.col("r.content_type"))).alias("categories"), F.slice(F.coalesce(terms, F.array().cast("array<string>")), 1, most).alias("tags"), F.lit("en").alias("language"),
    )


def catalog_entry(df: DataFrame) -> DataFrame:
    """A library of a bundled catalogue: slugs of its type are added to its tags, its first language counts."""
    p = _parse(df, "id string, name string, access_method string, category string, url string, description string, formats array<string>, languages array<string>, tags array<string>")
    slug = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-"))
    tags = F.array_union(_list(F.col("r.tags")), _list(F.array(F.lit("library"), slug(_e("access_method")))))
    return p.select(
        F.coalesce(F.nullif("r.id", F.lit("")), F.trim(_e("name"))).alias("native"), F.trim(_e("name")).alias("title"), F.trim(_e("description")).alias("abstract"), F.trim(_e("url")).alias("url"), F.lit("").alias("pdf_url"), F.array().cast("array<string>").alias("authors"),
        F.lit(None).cast("string").alias("published"), F.array(F.trim(F.coalesce(F.nullif("r.category", F.lit("")), F.lit("Libraries")))).alias("categories"), tags.alias("tags"), F.try_element_at("r.languages", F.lit(1)).alias("language"),
    )


def matches(raw: Column, needle: str) -> Column:
    """Whether the needle stands in the catalogue entry's name, description, category, access, tags or formats."""
    schema = "name string, description string, category string, access_method string, tags array<string>, formats array<string>"
    r = F.from_json(raw, schema)
    return F.lower(F.concat_ws(" ", r["name"], r["description"], r["category"], r["access_method"], r["tags"], r["formats"])).contains(needle.strip().lower())


def merge_key(url: Column, id_: Column, name: Column) -> Column:
    u = F.rtrim(F.lower(F.trim(F.coalesce(url, F.lit("")))), F.lit("/"))
    return F.when(u != "", u).otherwise(F.lower(F.trim(F.coalesce(F.nullif(id_, F.lit("")), name, F.lit("")))))


def merge_catalog(known: DataFrame, found: DataFrame) -> DataFrame:
    """known and those of found whose key is new, the first by id of each key. Both: (id, name, url)."""
    key = merge_key(F.col("url"), F.col("id"), F.col("name"))
    k = known.withColumn("key", key)
    new = found.withColumn("key", key).where("key != ''").groupBy("key").agg(F.min(F.struct("id", "name", "url")).alias("e"))
    new = new.join(k.select("key"), "key", "left_anti").select("e.*", "key")
    return k.select("id", "name", "url", "key").unionByName(new)


for _s in (Source("repositories", repository, "repository"), Source("code", code_file, "code"), Source("reports", report, "report"), Source("energy_reports", energy_report, "report"), Source("articles", article, "paper"), Source("catalog", catalog_entry, "library")):
    register(_s)
