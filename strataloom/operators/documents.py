"""The document model: derived columns, filters and projections over it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import bounded_broadcast

# The kinds of document.
KINDS = ("paper", "report", "standard", "repository", "code", "documentation", "datasheet", "library", "other")


def search_text() -> Column:
    """Everything a document is found by, one field a line, empty fields left out."""
    join = lambda c: F.array_join(c, " ")
    parts = [F.col("title"), join("authors"), F.col("abstract"), F.col("body"), join("categories"), join("tags")]
    return F.trim(F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts]))


def embedding_text(body_chars: int = 2000) -> Column:
    parts = [F.col("title"), F.col("abstract"), F.substr("body", F.lit(1), F.lit(body_chars))]
    return F.trim(F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts]))


@dataclass(frozen=True)
class Filters:
    """What a search is narrowed to; an empty list and None do not filter."""

    sources: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    language: list[str] = field(default_factory=list)
    version: str | None = None
    has_code: bool | None = None
    has_equations: bool | None = None
    year_from: int | None = None
    year_to: int | None = None

    def condition(self) -> Column:
        """One predicate, pushed below every retriever and facet."""
        c = [F.lit(True)]
        for col, values in (("source", self.sources), ("kind", self.kinds), ("language", self.language)):
            if values:
                c.append(F.col(col).isin(*values))
        if self.categories:
            c.append(F.arrays_overlap("categories", F.array(*map(F.lit, self.categories))))
        if self.version is not None:
            c.append(F.col("version") == self.version)
        for col, v in (("has_code", self.has_code), ("has_equations", self.has_equations)):
            if v is not None:
                c.append(F.col(col) == v)
        day = T.lenient_date(F.col("published"))
        if self.year_from is not None:
            c.append(day >= F.make_date(F.lit(self.year_from), F.lit(1), F.lit(1)))
        if self.year_to is not None:
            c.append(day <= F.make_date(F.lit(self.year_to), F.lit(12), F.lit(31)))
        return reduce(lambda a, b: a & b, c)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition())


# Prefixes of a domain filter and the facet each pins.
DOMAIN_PREFIXES = {"source": "sources", "kind": "kinds", "category": "categories", "topic": "categories"}


def resolve_domains(requests: DataFrame, text: str, sources: DataFrame) -> DataFrame:
    """The requests with (facet, value): the facet of Filters that each domain filter pins, and to which value.

    sources: (source), the known ones. A written prefix decides; else the name of a kind, else a known source, else it is
    taken as a category. An empty filter pins nothing: both are null. All but categories are compared in lower case.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    pinned = F.try_element_at(F.create_map(*[F.lit(x) for kv in DOMAIN_PREFIXES.items() for x in kv]), F.lower(F.trim(F.substring_index(t, ":", 1))))
    rest = F.trim(F.when(t.contains(":"), F.substr(t, F.instr(t, ":") + 1)).otherwise(""))
    rows = requests.withColumns({"__t": t, "__rest": rest, "__pin": F.when(rest != "", pinned)})
    known = sources.select(F.lower("source").alias("__source")).distinct()
    rows = rows.join(bounded_broadcast(known, 100_000), F.lower("__t") == F.col("__source"), "left")
    facet = F.coalesce("__pin", F.when(F.lower("__t").isin(*KINDS), F.lit("kinds")), F.when(F.col("__source").isNotNull(), F.lit("sources")), F.when(F.col("__t") != "", F.lit("categories")))
    rows = rows.withColumn("facet", facet)
    raw = F.when(F.col("__pin").isNotNull(), F.col("__rest")).otherwise(F.nullif("__t", F.lit("")))
    return rows.withColumn("value", F.when(F.col("facet") == "categories", raw).otherwise(F.lower(raw))).drop("__t", "__rest", "__pin", "__source")


def in_domain(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """docs joined to every request of resolve_domains() whose facet and value they have.

    A request that pins nothing needs no join, as it is answered by docs themselves; it is left out here.
    """
    r = bounded_broadcast(resolved, 100_000)
    part = lambda facet, on: docs.join(r.where(F.col("facet") == facet), on)
    out = part("sources", docs["source"] == F.col("value")).unionByName(part("kinds", docs["kind"] == F.col("value")))
    tagged = docs.withColumn("__c", F.explode(F.array_distinct("categories")))
    return out.unionByName(tagged.join(r.where("facet = 'categories'"), tagged["__c"] == F.col("value")).drop("__c"))


def domain_filters(facet: str | None, value: str | None) -> Filters:
    """The filters of one resolved request."""
    return Filters(**{facet: [value]}) if facet else Filters()


PUBLIC = ["id", "source", "kind", "title", "abstract", "url", "pdf_url", "authors", "published", "updated", "version", "categories", "tags", "language", "identifiers", "has_equations", "has_code", "popularity"]


def public(df: DataFrame, full: bool = False) -> DataFrame:
    """What may be shown of a document; never the vector."""
    return df.select("ingest_seq", *PUBLIC, *(["body", "equations", "extra"] if full else []))
