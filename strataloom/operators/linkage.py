"""Record linkage: joins on a content key, attribute pivots, best and additional values, heuristic ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import bounded_broadcast

#: Lookup tables up to this many rows are broadcast; larger ones are joined by shuffle.
MAX_LOOKUP = 100_000


def left_chain(base: DataFrame, key: str, others: list[tuple[DataFrame, str]]) -> DataFrame:
    """base left-joined with each table on its own key column; a key that repeats there repeats the row."""
    out = base
    for i, (df, k) in enumerate(others):
        right = df.withColumnRenamed(k, f"__k{i}")
        out = out.join(right, out[key] == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return out


def nest(parent: DataFrame, child: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """parent with its children as an array of structs in field order; none gives an empty array."""
    kids = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(kids.schema[name].dataType)
    return parent.join(kids, key, "left").withColumn(name, F.coalesce(name, empty))


def lookup(df: DataFrame, table: DataFrame, on: str | Column, how: str = "left") -> DataFrame:
    return df.join(bounded_broadcast(table, MAX_LOOKUP), on, how)


def pivot_attributes(df: DataFrame, id_: str, key: str, value: str, order: str) -> DataFrame:
    """(id, last, multiple): maps from attribute name to its last value and to all values in order."""
    per = df.groupBy(id_, T.field_name(F.col(key)).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("vs"))
    e = F.collect_list(F.struct("k", "vs"))
    return per.groupBy(id_).agg(F.map_from_entries(F.transform(e, lambda x: F.struct(x["k"], F.element_at(x["vs"], -1)))).alias("last"), F.map_from_entries(F.transform(e, lambda x: F.struct(x["k"], x["vs"]))).alias("multiple"))


def best_value(candidates: Column) -> Column:
    """The longest candidate, the first of equal ones; empty if all are."""
    c = F.filter(F.transform(candidates, lambda x: F.trim(T.empty(x))), lambda x: x != "")
    return F.aggregate(c, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def additional_values(candidates: Column) -> Column:
    """Other candidates, long ones first, without those whose letters the longest holds in order."""
    c = F.array_distinct(F.filter(candidates, lambda x: x.isNotNull() & (x != "")))
    by_len = F.transform(F.array_sort(F.transform(c, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("v")))), lambda s: s["v"])
    longest = F.try_element_at(by_len, F.lit(1))
    return F.filter(by_len, lambda x, i: (i > 0) & ~T.is_subsequence(x, longest))


def best_extension(candidates: Column) -> Column:
    return F.when(F.array_contains(candidates, "epub"), "epub").when(F.array_contains(candidates, "pdf"), "pdf").otherwise(best_value(candidates))


def best_size(measured: Column, others: list[Column]) -> Column:
    """The measured size if it is positive, else the largest known."""
    return F.when(measured > 0, measured).otherwise(F.greatest(*[F.coalesce(o, F.lit(0)) for o in others], F.coalesce(measured, F.lit(0))))


def heuristic_score(size: Column, language: Column, extension: Column, title: Column, presence: list[Column], priors: dict[str, float]) -> Column:
    """Sum of the weights a record earns: size, language by its prior, format, title and each other field present."""
    has = lambda c: F.length(T.empty(c)) > 0
    w = lambda c, n: F.when(c, n).otherwise(0)
    lang = reduce(lambda a, b: a + b, [w(language == k, p * 1000) for k, p in priors.items()], F.lit(0.0))
    return w(size > 500000, 10000) + lang + w(language == "", 100) + w(extension.isin("epub", "pdf"), 100) + w(has(title), 100) + sum((w(has(p), 10) for p in presence), F.lit(0))


def union_keys(frames: list[DataFrame], cols: list[str]) -> DataFrame:
    """(key): different non-empty keys of several tables in canonical form."""
    one = reduce(DataFrame.unionByName, [df.select(T.canonical_md5(F.col(c)).alias("key")) for df, c in zip(frames, cols)])
    return one.where("key is not null").distinct()
