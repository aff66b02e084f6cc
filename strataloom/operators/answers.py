"""Extractive answers with citations, and comparison of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOTHING = "No relevant documents were found."


def citations(top: DataFrame, order: Column) -> DataFrame:
    """The few documents of an answer, numbered from 1."""
    return top.withColumn("n", F.row_number().over(Window.orderBy(order)))


def extractive(top: DataFrame, text: Column, order: Column, query: str, most: int = 5, chars: int = 1500) -> DataFrame:
    """(answer): the best sentences of at most eight documents, by document, each with its number.

    A sentence scores its matching tokens over the root of its length, plus a little for an early document; of sentences
    that begin alike the best stays. The top documents are few, so one window over their sentences is small.
    """
    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    rows = top.select(text.alias("text"), (F.row_number().over(Window.orderBy(order)) - 1).alias("idx")).select("idx", F.posexplode(T.sentences(F.substr("text", F.lit(1), F.lit(chars)))).alias("pos", "sent"))
    tok = T.ascii_tokens(F.col("sent"))
    score = F.round(F.size(F.filter(tok, lambda x: x.isin(*terms))) / F.sqrt(F.size(tok)) + 0.25 / (F.col("idx") + 1), 9)
    rows = rows.where(F.size(tok) > 0).withColumn("score", score)
    best = [F.desc("score"), F.col("idx"), F.col("pos")]
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy(F.lower(F.substr("sent", F.lit(1), F.lit(80)))).orderBy(*best))).where("k = 1")
    pick = one.orderBy(*best).limit(most)
    s = F.array_sort(F.collect_list(F.struct("idx", (-F.col("score")).alias("neg"), "pos", F.concat("sent", F.lit(" ["), F.col("idx") + 1, F.lit("]")).alias("s"))))
    return pick.agg(F.array_join(F.transform(s, lambda x: x["s"]), " ").alias("answer"))


def fallback(text: Column, title: Column) -> Column:
    lead = F.array_join(F.transform(F.slice(T.sentences(text), 1, 2), lambda x: F.concat(x, F.lit(" [1]"))), " ")
    return F.coalesce(F.nullif(lead, F.lit("")), title, F.lit(NOTHING))


def grounded_sentences(df: DataFrame, id_: str, text: Column, terms: list[str], most: int) -> DataFrame:
    """(id, sent, overlap): the sentences with most query tokens that are grounded in their document."""
    rows = df.select(F.col(id_), F.posexplode(T.sentences(text)).alias("pos", "sent"))
    tok = T.ascii_tokens(F.col("sent"))
    rows = rows.withColumn("overlap", F.size(F.filter(tok, lambda x: x.isin(*terms)))).where((F.col("overlap") > 0) & (F.size(F.array_distinct(tok)) >= 2))
    return rows.orderBy(F.desc("overlap"), id_, "pos").limit(most).select(id_, "sent", "overlap")


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(a, …): shared and own categories, shared terms and similarity of documents with equal keys."""
    side = lambda df, n: df.select(F.col(key).alias("a"), F.coalesce("categories", F.array().cast("array<string>")).alias(f"c{n}"), F.array_distinct(T.ascii_tokens(F.col("text"))).alias(f"t{n}"))
    p = side(left, 1).join(side(right, 2), "a")
    join = lambda c: F.array_join(F.array_sort(c), "|")
    return p.select(
        "a", join(F.array_intersect("c1", "c2")).alias("shared_categories"), join(F.array_except("c1", "c2")).alias("only_a"), join(F.array_except("c2", "c1")).alias("only_b"),
        F.array_join(F.slice(F.array_sort(F.array_intersect("t1", "t2")), 1, 40), " ").alias("shared_terms"), F.round(T.jaccard(F.col("t1"), F.col("t2")), 4).alias("similarity"),
    )
