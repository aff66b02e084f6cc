"""Operators on book catalogues: record maps of the sources, works behind editions, ISBN matches, attribute maps, unified fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# For each source its key, then target field = source field; numbers default to 0, all others to "".
RECORD_MAPS = {
    "zlib": ("zlibrary_id=id", "title author=authors publisher year language extension md5 md5_reported description=descr", "filesize filesize_reported"),
    "rs": ("ID", "Title Authors Series Publisher Year Language Pages ISBN MD5 Size Extension TimeAdded TimeModified", ""),
    "rs_fiction": ("id", "title authors series publisher year language md5 extension", "filesize"),
    "li": ("f_id", "md5 sha1 crc32 file_name extension librarian_email added_date last_modified status libgen_topic", "file_size"),
    "isbndb": ("", "isbn13 isbn10", ""),
}
# Fields that one of must be present, by source: all of the first group, or one of the second.
REQUIRED = {"zlib": (("zlibrary_id", "title"), ()), "rs": (("ID", "Title"), ()), "rs_fiction": (("id", "title"), ()), "li": (("f_id", "md5"), ()), "isbndb": ((), ("isbn13", "isbn10"))}
# What the JSON of an ISBN record holds.
ISBN_FIELDS = "title title_long publisher year language isbn10 isbn13 pages weight dimensions price image link".split()


def map_record(df: DataFrame, source: str) -> DataFrame:
    """Rows of a source in its target schema; absent columns and nulls take the default, keys stay null."""
    key, texts, numbers = RECORD_MAPS[source]
    have = {c.lower(): c for c in df.columns}

    def fields(spec: str, default) -> list[Column]:
        out = []
        for f in spec.split():
            target, _, src = f.partition("=")
            c = F.col(f"`{have[(src or target).lower()]}`") if (src or target).lower() in have else F.lit(None)
            kind = "long" if default == 0 else "string"
            out.append((F.coalesce(c.cast(kind), F.lit(default)) if default is not None else c).alias(target))
        return out

    cols = fields(key, None) + fields(texts, "") + fields(numbers, 0)
    if source == "isbndb":
        authors = F.col("authors").cast("array<string>") if "authors" in have else F.lit(None).cast("array<string>")
        values = [F.coalesce(F.col(f).cast("string") if f in have else F.lit(None).cast("string"), F.lit("")).alias(f) for f in ISBN_FIELDS]
        cols.append(F.to_json(F.struct(*values, F.coalesce(authors, F.array().cast("array<string>")).alias("authors"))).alias("json"))
    return df.select(*cols)


def valid_record(source: str) -> Column:
    """Whether a mapped record has what its source requires: present, not empty and not zero."""
    full = lambda c: F.coalesce(~F.col(c).cast("string").isin("", "0"), F.lit(False))
    every, any_ = REQUIRED[source]
    return reduce(lambda a, b: a & b, map(full, every)) if every else reduce(lambda a, b: a | b, map(full, any_))


def editions_with_works(base: DataFrame) -> DataFrame:
    """(ol_key, json, work_key, work_json, author_keys, author_jsons) of every edition in base (ol_key, json).

    The work is the first that the edition names. The authors are the edition's own, else its work's, in the order they
    are named; those that base does not hold are left out, and JSON that cannot be read names nothing.
    """
    named = "struct<works:array<struct<key:string>>,authors:array<struct<key:string,author:struct<key:string>>>>"
    rows = base.select("ol_key", "json", F.from_json("json", named).alias("j"))
    ed = rows.where(F.startswith("ol_key", F.lit("/books/"))).select("ol_key", "json", "j", F.try_element_at("j.works", F.lit(1))["key"].alias("work_key"))
    works = rows.select(F.col("ol_key").alias("work_key"), F.col("json").alias("work_json"), F.col("j").alias("w"))
    both = ed.join(works, "work_key", "left")
    keys = lambda arr, get: F.filter(F.transform(F.coalesce(arr, F.array().cast("array<struct<key:string,author:struct<key:string>>>")), get), lambda k: k.isNotNull())
    own, inherited = keys(F.col("j.authors"), lambda a: a["key"]), keys(F.col("w.authors"), lambda a: a["author"]["key"])
    both = both.select("ol_key", "json", "work_key", "work_json", F.when(F.size(own) > 0, own).otherwise(inherited).alias("keys"))
    names = both.select("ol_key", F.posexplode("keys").alias("i", "author_key"))
    found = names.join(base.select(F.col("ol_key").alias("author_key"), F.col("json").alias("author_json")), "author_key")
    per = found.groupBy("ol_key").agg(F.array_sort(F.collect_list(F.struct("i", "author_key", "author_json"))).alias("a"))
    none = F.array().cast("array<string>")
    out = both.drop("keys").join(per, "ol_key", "left")
    return out.select("ol_key", "json", "work_key", "work_json", F.coalesce(F.transform("a", lambda x: x["author_key"]), none).alias("author_keys"), F.coalesce(F.transform("a", lambda x: x["author_json"]), none).alias("author_jsons"))


def isbn_matches(asked: DataFrame, records: DataFrame) -> DataFrame:
    """(isbn, isbn13, isbn10, match_type) of the records that each asked ISBN-13 (column isbn) meets.

    records: (isbn13, isbn10). The ISBN-10 of a record counts only if its ISBN-13 begins with 978, since sources chop the
    prefix off others too. A pair found both ways comes once, labelled so.
    """
    a = asked.select("isbn").where("isbn is not null").distinct().withColumn("ten", T.isbn10_of(F.col("isbn")))
    r = records.select("isbn13", F.coalesce("isbn10", F.lit("")).alias("isbn10")).where("isbn13 is not null").distinct()
    by13 = a.join(r, F.col("isbn") == F.col("isbn13")).select("isbn", "isbn13", "isbn10", F.lit(2).alias("way"))
    by10 = a.where("ten is not null").join(r.where("substr(isbn13, 1, 3) = '978'"), F.col("ten") == F.col("isbn10")).select("isbn", "isbn13", "isbn10", F.lit(1).alias("way"))
    label = F.when(F.col("w") == 3, "ISBN-10 and ISBN-13").when(F.col("w") == 2, "ISBN-13").otherwise("ISBN-10")
    return by13.unionByName(by10).groupBy("isbn", "isbn13", "isbn10").agg(F.sum(F.col("way")).alias("w")).select("isbn", "isbn13", "isbn10", label.alias("match_type"))


def attribute_map(descr: DataFrame, id_: str, order: str, meta: str = "meta") -> DataFrame:
    """(id, one, many): for each entity the maps from field name to its value and to all its values in order.

    descr: (id, order, value, value_add1..3, publisher_title, meta struct<name_en, name_add1_en..3>). Each value counts
    under the normalised name of its attribute, each additional value under that name and its own; a publisher's title
    counts as publisher_title. As in the source, the last value is the one that ``one`` keeps. Names without letters are
    left out.
    """
    norm = lambda c: T.field_name(F.coalesce(c, F.lit("")))
    base = norm(F.col(f"{meta}.name_en"))
    pairs = [F.struct(base.alias("f"), F.col("value").cast("string").alias("v"), F.lit(0).alias("n"))]
    for i in (1, 2, 3):
        extra = norm(F.col(f"{meta}.name_add{i}_en"))
        pairs.append(F.struct(F.when(F.length(extra) > 0, F.concat(base, F.lit("_"), extra)).alias("f"), F.col(f"value_add{i}").cast("string").alias("v"), F.lit(i).alias("n")))
    title = F.col("publisher_title")
    pairs.append(F.struct(F.when(F.length(T.empty(title)) > 0, F.lit("publisher_title")).alias("f"), title.cast("string").alias("v"), F.lit(4).alias("n")))
    rows = descr.select(F.col(id_), F.col(order).alias("__o"), F.explode(F.array(*pairs)).alias("p")).where("p.f is not null and p.f != ''")
    per = rows.groupBy(id_, F.col("p.f").alias("f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "p.n", "p.v"))), lambda x: x["v"]).alias("vs"))
    all_ = F.array_sort(F.collect_list(F.struct("f", "vs")))
    return per.groupBy(id_).agg(F.map_from_entries(F.transform(all_, lambda x: F.struct(x["f"], F.element_at(x["vs"], -1)))).alias("one"), F.map_from_entries(F.transform(all_, lambda x: F.struct(x["f"], x["vs"]))).alias("many"))


# Topic letters of the file catalogue and the content type each stands for.
TOPICS = {"l": "book_nonfiction", "f": "book_fiction", "r": "book_fiction", "a": "journal_article", "s": "standards_document", "m": "magazine", "c": "book_comic"}


def content_type(topic: Column, nonfiction: Column, fiction: Column) -> Column:
    """By the source if exactly one of two specialised ones has the file, else by its topic letter, else unknown."""
    by_topic = F.try_element_at(F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv]), topic)
    return F.when(nonfiction & ~fiction, "book_nonfiction").when(fiction & ~nonfiction, "book_fiction").otherwise(F.coalesce(by_topic, F.lit("book_unknown")))


def unified_search_text(title: Column, publisher: Column, varia: Column, author: Column, file_name: Column, extension: Column, language: Column, chars: int = 1000) -> Column:
    """Seven fields, one a line, empty ones kept as empty lines; the first five are cut to ``chars``."""
    cut = [F.substr(T.empty(c), F.lit(1), F.lit(chars)) for c in (title, publisher, varia, author, file_name)]
    return F.concat_ws("\n", *cut, T.empty(extension), T.empty(language))


def article_link(path: Column, extension: Column) -> Column:
    """The address behind an article's archive path: the one it encodes if it has no DOI of its own, else its DOI's."""
    p = F.replace(T.empty(path), F.lit("\\"), F.lit("/"))
    tail = F.concat(F.lit("."), T.empty(extension))
    p = F.when(F.endswith(p, tail), F.substr(p, F.lit(1), F.length(p) - F.length(tail))).otherwise(p)
    coded = F.startswith(p, F.lit("10.0000/")) & p.contains("%2F")
    return F.when(T.empty(path) == "", "").when(coded, F.concat(F.lit("http://"), F.replace(F.substr(p, F.lit(9)), F.lit("%2F"), F.lit("/")))).otherwise(F.concat(F.lit("https://doi.org/"), p))


def nested_documents(keys: DataFrame, key: str, parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row for each key with the rows of each part as an array of structs in the order of their fields.

    parts: name -> (table, its key column). One job: each part is grouped once and joined on the key; rows of null keys
    and of keys not asked for are left out, a key without rows has empty arrays.
    """
    out = keys.select(key).where(F.col(key).isNotNull()).distinct()
    for name, (df, k) in parts.items():
        fields = [c for c in df.columns if c != k]
        per = df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(per, key, "left").withColumn(name, F.coalesce(name, F.array().cast(per.schema[name].dataType)))
    return out


def content_chunk(highlights: Column, abstract: Column, body: Column) -> Column:
    """What an agent is shown of a hit: its highlights without marks, joined, else the abstract, else the body; cut at a word."""
    clean = F.filter(F.transform(F.coalesce(highlights, F.array().cast("array<string>")), lambda h: T.collapse(F.regexp_replace(h, "</?em>", ""))), lambda h: h != "")
    joined = F.array_join(clean, " … ")
    other = T.collapse(F.coalesce(F.nullif(abstract, F.lit("")), body, F.lit("")))
    return T.cut_at_word(F.when(joined != "", joined).otherwise(other))


def vector_literal(vector: Column) -> Column:
    """[a,b,c] with seven significant digits, as %.7g writes them; null for null and for an empty vector.

    Exact for single-precision entries, as vectors have; a double whose shortest decimal form ends in a 5 at the eighth
    digit is rounded by that form.
    """

    def short(x: Column) -> Column:
        # the JVM rounds a half up, %.7g to the even digit
        full = F.format_string("%.17e", x.cast("double"))
        cut = F.concat(F.regexp_extract(full, r"^-?\d\.\d{6}", 0), F.regexp_extract(full, "e.*$", 0))
        s = F.when(full.rlike(r"^-?\d\.\d{5}[02468]50*e"), cut).otherwise(F.format_string("%.6e", x.cast("double")))
        m, e = F.substring_index(s, "e", 1), F.substring_index(s, "e", -1)
        bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        plain = bare(s.cast("decimal(38,18)").cast("decimal(38,12)").cast("string"))
        return F.when(x == 0, "0").when(e.cast("int").between(-5 + 1, 6), plain).otherwise(F.concat(bare(m), F.lit("e"), e))

    return F.when(F.size(vector) > 0, F.concat(F.lit("["), F.array_join(F.transform(vector, short), ","), F.lit("]")))


def window_fragments(text: Column, terms: list[str], chars: int = 160, most: int = 2) -> Column:
    """Up to ``most`` windows of about ``chars`` signs, cut at blanks, each around a match that no window before it shows;
    whole words that begin with a term are marked."""
    rx = "|".join(rf"\Q{t}\E" for t in terms)
    word = rf"(?i)(?<![\p{{L}}\p{{N}}])((?:{rx})[\p{{L}}\p{{N}}]*)"
    around = rf"(?is)(?:(?<=^|\s).{{0,{chars // 2}}}?)?(?<![\p{{L}}\p{{N}}])(?:{rx})[\p{{L}}\p{{N}}]*(?:.{{0,{chars // 2}}}(?=\s|$))?"
    got = F.regexp_extract_all(T.collapse(T.empty(text)), F.lit(around), F.lit(0))
    return F.transform(F.slice(got, 1, most), lambda x: F.regexp_replace(F.trim(x), word, "<em>$1</em>"))
