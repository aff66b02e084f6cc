"""Operator: several values packed in one field, as one row per value with its position.

Two passes. The first counts, over all rows, the shapes of values in fields that can be read one way only; shapes come
from a small alphabet, so the count is a small table whatever the corpus. The second reads every field with the dialect
of least description length under those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import multivalue as mv


#: Fields and values that a task remembers the reading of.
REMEMBERED = 100_000


def code_book(df: DataFrame, fields: dict[str, str]) -> dict[str, dict[str, float]]:
    """Code lengths of shapes by kind of value. fields: column -> "people" or "code"."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: dict[tuple[str, str], int] = {}
            for kind, text in zip(b["kind"], b["text"]):
                for v in mv.strong_values(text, kind):
                    k = kind, mv.SHAPES[kind][0](v)
                    c[k] = c.get(k, 0) + 1
            yield pd.DataFrame([(k, s, n) for (k, s), n in c.items()], columns=["kind", "shape", "n"])

    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for c, k in fields.items()])).alias("x")).select("x.*")
    counts = rows.where("length(trim(text)) > 0").mapInPandas(shapes, "kind string, shape string, n long").groupBy("kind", "shape").agg(F.sum("n").alias("n"))
    top = counts.collect()
    return {kind: mv.code_book({r["shape"]: r["n"] for r in top if r["kind"] == kind}) for kind in mv.SHAPES}


def split_values(df: DataFrame, key: str, fields: dict[str, str], tab: str, book: dict[str, dict[str, float]] | None = None, least: int = 2) -> DataFrame:
    """Rows (tab, row_key, field_name, pos, val) for each field that holds at least ``least`` values.

    Positions count from 0 over the values found; empty places between separators are no values. A null or empty field
    gives no row, repeated input rows repeat their values, an empty table gives an empty result, and columns other than
    key and fields are never read. Code values come out as digits and X.
    """
    book = book if book is not None else code_book(df, fields)
    span = {kind: mv.most_pieces(book.get(kind, {})) for kind in mv.SHAPES}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # what a task has read before it need not read again
        bits: dict[str, dict[str, float]] = {kind: {} for kind in mv.SHAPES}
        known: dict[tuple[str, str], list[str]] = {}
        for b in batches:
            out = []
            for k, f, kind, text in zip(b["k"], b["f"], b["kind"], b["text"]):
                if (vals := known.get((kind, text))) is None:
                    vals = mv.parse(text, kind, book.get(kind, {}), bits[kind], span[kind])
                    if kind == "code":
                        vals = [d for d in map(mv.code_digits, vals) if d]
                    if len(known) > REMEMBERED or len(bits[kind]) > REMEMBERED:
                        known.clear()
                        bits[kind].clear()
                    known[kind, text] = vals
                if len(vals) >= least:
                    out += [(k, f, i, v) for i, v in enumerate(vals)]
            yield pd.DataFrame(out, columns=["row_key", "field_name", "pos", "val"])

    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.lit(k).alias("kind"), F.col(c).alias("text")) for c, k in fields.items()])
    rows = df.select(F.col(key).cast("long").alias("k"), F.explode(pairs).alias("x")).select("k", "x.*").where("length(trim(text)) > 0")
    if least > 1:
        # a field without any separator is one value, which needs no reading
        rows = rows.where(F.col("text").rlike(mv.SEPARATED))
    got = rows.mapInPandas(run, "row_key long, field_name string, pos int, val string")
    return got.select(F.lit(tab).alias("tab"), "row_key", "field_name", "pos", "val")
