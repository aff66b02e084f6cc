"""One surviving record for each group of duplicates: for each field the best value found in the group.

A single aggregation takes, for each field, the maximum of a struct (usable, quality, source priority, time, id, value).
Maxima merge pairwise before the shuffle, so a group that holds a third of all rows is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The digest of the empty file, which stands in for an unknown one.
EMPTY_FILE = "d41d8cd98f00b204e9800998ecf8427e"
# Wordings that stand for a missing text.
NOTHING = r"(?i)^[\W_]*(?:n/?a|none|null|nil|todo|tbd|unknown|untitled|description|summary|no (?:description|summary|abstract)\b.{0,60}|(?:description|summary) (?:is )?(?:not|un)\b.{0,40}|nbsp)?[\W_]*$"
# Phrases by which a seller's or a site's text shows.
PROMOTION = r"(?i)\b(?:click (?:the|here|on|below)|fast download|download (?:now|it|here|free|this)|no waiting|free (?:copy|download|ebook)|get your|join our|read (?:it )?online|books in this category|daily picks|buy now|sign up|subscribe)\b"


def file_hash(h: Column) -> Column:
    """32 lower-case digits of a hash however it is written; null if malformed, or if it stands for no real file."""
    s = F.regexp_replace(F.lower(h), r"^[\s\"'{(<\[]*(?:(?:urn:)?md5\s*[:=]?|0x)?", "")
    s = F.regexp_replace(s, r"[\s\-:.\"'{}()<>\[\] ]", "")
    ok = s.rlike(r"^[0-9a-f]{32}$") & ~s.rlike(r"^(.)\1{31}$") & ~s.rlike(r"^(.{2,8}?)\1+$") & (s != EMPTY_FILE) & ~s.rlike("^0123456789abcdef|^123456789")
    return F.when(ok, s)


def plain_text(d: Column) -> Column:
    """Without markup and with single blanks."""
    s = F.regexp_replace(d, r"(?i)</?(?:p|br|div|i|b|em|strong|span)\s*/?>|&nbsp;", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def usable_text(text: Column, title: Column) -> Column:
    """Whether plain ``text`` is a whole, undamaged description of the work that has this title."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) > 4))
    # its subtitle may be missing, and words may be misspelt
    mine, its = words(F.regexp_replace(title, r"(?:\s*[:;(\[]|\s+-+\s|(?<=\p{L}{6})\.\s+\p{L}).*$", "")), words(text)
    near = F.filter(mine, lambda w: F.exists(its, lambda v: F.levenshtein(w, v, 2) >= 0))
    about = (F.size(mine) == 0) | (F.size(F.array_intersect(mine, its)) >= 0.55 * F.size(mine)) | (F.size(near) >= 0.55 * F.size(mine))
    whole = text.rlike(r"[.!?][)\"'»”]*$") & ~text.rlike(r"(?:\.\.\.|…|\[more\]|\(more\)|read more)[.\s]*$")
    clean = ~text.rlike(r"�|\p{L}[#?]+\p{L}|(?:[#?]\p{L}+\s){2}") & ~text.rlike(PROMOTION)
    return text.isNotNull() & ~text.rlike(NOTHING) & whole & clean & about


def survive(df: DataFrame, group: str, order: list[Column], fields: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """One row for each value of ``group``, each field with the best value.

    fields: name -> (value, [rank columns, the most important first]). A null value never wins; ties in all ranks fall
    to ``order`` and then to the largest value. Rows with a null group are left out.
    """
    best = []
    for name, (value, ranks) in fields.items():
        cols = [value.isNotNull().alias("ok")] + [F.coalesce(r.cast("double"), F.lit(float("-inf"))).alias(f"r{i}") for i, r in enumerate(ranks)]
        cols += [o.alias(f"o{i}") for i, o in enumerate(order)] + [value.alias("v")]
        best.append(F.max(F.struct(*cols))["v"].alias(name))
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows"), *best)


def _missing(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.rlike(NOTHING), t)


def book_rows(zlib: DataFrame, rs: DataFrame) -> DataFrame:
    """The rows of both catalogues under common names; file_hash null where the hash is of no use."""
    size = lambda c: F.when(c.cast("string").rlike(r"^\s*\d+\s*$"), F.trim(c.cast("string")).try_cast("bigint"))
    num = F.regexp_extract("Size", r"(?i)^\s*([\d.]+)\s*(b|kb|mb|gb|kib|mib|gib)?\s*$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract("Size", r"(?i)^\s*([\d.]+)\s*(b|kb|mb|gb|kib|mib|gib)?\s*$", 2))
    mult = F.when(unit.startswith("K"), 1024).when(unit.startswith("M"), 1024**2).when(unit.startswith("G"), 1024**3).otherwise(1)
    z = zlib.select(
        file_hash(F.col("md5")).alias("md5"), F.lit(2).alias("trust"), F.col("zlibrary_id").alias("zlibrary_id"), F.col("zlibrary_id").alias("id"),
        *[_missing(F.col(c)).alias(c) for c in ("title", "authors", "publisher", "year", "language", "extension")],
        F.when(F.col("filesize") > 0, F.col("filesize")).alias("filesize"), plain_text(F.col("descr")).alias("descr"),
        F.coalesce("date_modified", "date_added").alias("changed"),
    )
    r = rs.select(
        file_hash(F.col("MD5")).alias("md5"), F.lit(1).alias("trust"), F.lit(None).cast("long").alias("zlibrary_id"), F.col("ID").alias("id"),
        *[_missing(F.col(c)).alias(c.lower()) for c in ("Title", "Authors", "Publisher", "Year", "Language", "Extension")],
        F.when(num * mult > 0, (num * mult).cast("long")).alias("filesize"), F.lit(None).cast("string").alias("descr"),
        F.coalesce("TimeModified", "TimeAdded").alias("changed"),
    )
    return z.unionByName(r)


def best_records(zlib: DataFrame, rs: DataFrame) -> DataFrame:
    """One record for each file that two or more rows of both catalogues name by the same hash.

    Titles, people and publishers prefer the more complete value, then the more trusted source, then the later change;
    sizes and dates the trusted and later one. ``descr`` is the longest undamaged description of the very book, and
    ``descr_id`` the row it comes from (of equal texts the smallest id); both are null if no row has one. Null, empty
    and placeholder values never survive against a real one. Hashes that are null, malformed or placeholders form no
    group; extra columns are ignored; empty tables give an empty result.
    """
    rows = book_rows(zlib, rs)
    good = F.col("zlibrary_id").isNotNull() & usable_text(F.col("descr"), F.coalesce("title", F.lit("")))
    # a value in mixed case is more complete than one that a careless import left in capitals
    cased = lambda c: (F.col(c) != F.upper(c)).cast("int")
    trust, changed = F.col("trust"), F.unix_micros(F.col("changed").cast("timestamp"))
    text = F.when(good, F.struct(F.col("descr").alias("text"), F.col("zlibrary_id").alias("id")))
    rec = survive(
        rows,
        "md5",
        [-F.col("id"), F.col("trust")],
        {
            "title": (F.col("title"), [cased("title"), F.length("title"), trust, changed]),
            "authors": (F.col("authors"), [cased("authors"), F.length("authors"), trust, changed]),
            "publisher": (F.col("publisher"), [cased("publisher"), F.length("publisher"), trust, changed]),
            "year": (F.col("year"), [F.col("year").rlike(r"^\d{4}$").cast("int"), trust, changed]),
            "language": (F.col("language"), [trust, changed]),
            "extension": (F.col("extension"), [trust, changed]),
            "filesize": (F.col("filesize"), [trust, changed]),
            "best_descr": (text, [F.length("descr")]),
        },
    )
    plain = [c for c in rec.columns if c != "best_descr"]
    return rec.where(F.col("n_rows") >= 2).select(*plain, F.col("best_descr.text").alias("descr"), F.col("best_descr.id").alias("descr_id"))
