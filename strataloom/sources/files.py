"""Readers of dumps and pages: JSON lines, tab-separated dumps, SQL dumps, Atom feeds, HTML pages, binary files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): a line that is no JSON object becomes a reject and stops nothing."""
    raw = spark.read.text(path).where("length(trim(value)) > 0")
    parsed = raw.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select(F.col("value").alias("line"))


def tsv_dump(spark: SparkSession, path: str) -> DataFrame:
    """(type, ol_key, revision, last_modified, json) of lines with five fields or more; a revision that is no number is 0."""
    p = spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("p")).where(F.size("p") >= 5)
    rev = F.when(F.col("p")[2].rlike("^[0-9]+$"), F.col("p")[2].try_cast("int"))
    return p.select(F.col("p")[0].alias("type"), F.col("p")[1].alias("ol_key"), F.coalesce(rev, F.lit(0)).alias("revision"), F.col("p")[3].alias("last_modified"), F.replace(F.col("p")[4], F.lit("\\u0000"), F.lit("")).alias("json"))


ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def sql_rows(statement: str) -> Iterator[list[str | None]]:
    """The rows of an INSERT … VALUES statement; quotes double or are escaped, NULL is None."""
    at = statement.upper().find("VALUES")
    row: list[str | None] | None = None
    cur, quoted, was, i, n = [], False, False, at + 6 if at >= 0 else len(statement), len(statement)

    def close() -> None:
        text = "".join(cur) if was else "".join(cur).strip()
        row.append(None if not was and text.upper() == "NULL" else text)  # type: ignore[union-attr]

    while i < n:
        ch = statement[i]
        if quoted:
            if ch == "\\" and i + 1 < n:
                i += 1
                cur.append(ESCAPES.get(statement[i], statement[i]))
            elif ch == "'" and statement[i + 1 : i + 2] == "'":
                i += 1
                cur.append("'")
            elif ch == "'":
                quoted = False
            else:
                cur.append(ch)
        elif row is None:
            if ch == "(":
                row, cur, was = [], [], False
        elif ch == "'":
            quoted, was, cur = True, True, []
        elif ch in ",)":
            close()
            cur, was = [], False
            if ch == ")":
                yield row
                row = None
        elif not was:
            cur.append(ch)
        i += 1


def sql_dump(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of every INSERT statement of a dump, one statement a line, values named by position, all as strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [[*r[: len(fields)], *[None] * (len(fields) - len(r))] for s in b["value"] for r in sql_rows(s)]
            yield pd.DataFrame(rows, columns=fields)

    inserts = spark.read.text(path, lineSep=";\n").where(F.col("value").rlike(r"(?is)^\s*insert\s+into\b.*values"))
    return inserts.mapInPandas(run, ", ".join(f"{f} string" for f in fields))


def atom_entries(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(native, title, abstract, authors, categories, pdf_url, published, doi) of the entries of Atom feeds.

    whole_files: each file is one feed; else each line is one entry, and files can be split between tasks.
    """
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_title:string,_type:string>>, doi string"
    x = spark.read.schema(schema).option("rowTag", "entry").option("multiLine", str(whole_files).lower()).format("xml").load(path)
    pdf = F.filter("link", lambda v: (v["_title"] == "pdf") | (v["_type"] == "application/pdf"))
    named = lambda c, f: F.coalesce(F.filter(F.transform(c, lambda v: F.trim(v[f])), lambda v: v != ""), F.array().cast("array<string>"))
    return x.where("length(id) > 0").select(
        F.substring_index(F.trim("id"), "/abs/", -1).alias("native"), T.collapse(T.empty(F.col("title"))).alias("title"), F.trim(T.empty(F.col("summary"))).alias("abstract"), named("author", "name").alias("authors"), named("category", "_term").alias("categories"),
        F.coalesce(F.try_element_at(pdf, F.lit(-1))["_href"], F.lit("")).alias("pdf_url"), F.trim("published").alias("published"), F.trim("doi").alias("doi"),
    )


def page_documents(pages: DataFrame, source: str, least: int = 120) -> DataFrame:
    """(url, title, abstract, body, categories) of pages (url, html) with enough text."""
    p = pages.select("url", T.html_title(F.col("html")).alias("t"), T.html_text(F.col("html")).alias("text")).where(F.length("text") >= least)
    return p.select("url", F.coalesce(F.nullif("t", F.lit("")), "url").alias("title"), F.substr("text", F.lit(1), F.lit(500)).alias("abstract"), F.substr("text", F.lit(1), F.lit(20000)).alias("body"), F.array(F.lit(source)).alias("categories"))


def frontier(pages: DataFrame, domain: str, path_prefix: str = "/") -> DataFrame:
    """(url): different links of pages (url, html) into the domain and path, absolute and without fragments."""
    href = F.explode(F.regexp_extract_all("html", F.lit("(?i)href=[\"']([^\"'#?]+)"), F.lit(1)))
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    links = pages.select(site.alias("site"), href.alias("h"))
    full = F.when(F.col("h").rlike("^https?://"), F.col("h")).when(F.startswith("h", F.lit("/")), F.concat("site", "h")).otherwise(F.concat("site", F.lit("/"), "h"))
    u = links.select(full.alias("url"))
    return u.where((F.regexp_extract("url", "^https?://([^/]+)", 1) == domain) & F.startswith(F.regexp_extract("url", "^https?://[^/]+(/.*)?$", 1), F.lit(path_prefix))).distinct()


def version_of(url: Column) -> Column:
    """The version in a page's address, else ``latest``."""
    v = F.regexp_extract(url, r"/v?(\d+\.\d+(?:\.\d+)?)/", 1)
    return F.when(v != "", v).otherwise("latest")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, md5) of the files of a folder, read as bytes by the executors."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5"))


#: Sitemaps that one level of an index may name.
MAX_SITEMAPS = 1_000_000


def sitemap(spark: SparkSession, paths: list[str], resolve, depth: int = 5, whole_files: bool = True) -> DataFrame:
    """(loc): pages of sitemap files; an index is followed through ``resolve`` (locations to paths) up to ``depth`` times.

    whole_files: each file is one document; else each line is one entry, and files can be split between tasks.
    """

    def read(tag: str, ps: list[str]) -> DataFrame:
        if whole_files:
            return spark.read.schema("loc string").option("rowTag", tag).format("xml").load(ps)
        loc = F.regexp_extract("value", rf"<{tag}>\s*<loc>([^<]*)</loc>", 1)
        return spark.read.text(ps).select(T.unescape(loc).alias("loc")).where("loc != ''")

    out, seen = None, set()
    while paths and depth:
        depth -= 1
        seen |= set(paths)
        part = read("url", paths)
        out = part if out is None else out.unionByName(part)
        # the files an index names are paths to read, so they must come to the driver; too many are an error, none is dropped
        more = [r.loc.strip() for r in read("sitemap", paths).limit(MAX_SITEMAPS + 1).collect() if r.loc]
        if len(more) > MAX_SITEMAPS:
            raise ValueError(f"the index names more than {MAX_SITEMAPS} sitemaps")
        paths = sorted({p for p in map(resolve, more) if p} - seen)
    return out.select(F.trim("loc").alias("loc")).where("length(loc) > 0").distinct()


def pdf_text(spark: SparkSession, path: str, pages: int = 40) -> DataFrame:
    """(name, text) of PDF files; "" where the file cannot be read. Without the library pypdf it raises at once."""
    from pypdf import PdfReader

    def one(content: bytes, reader) -> str:
        import io

        try:
            raw = "\n".join((p.extract_text() or "") for p in reader(io.BytesIO(content)).pages[:pages])
        except Exception:  # noqa: BLE001 - an unreadable file has no text
            return ""
        return "\n".join(x for x in map(str.strip, raw.splitlines()) if x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "text": [one(bytes(c), PdfReader) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), "content").mapInPandas(run, "name string, text string")
