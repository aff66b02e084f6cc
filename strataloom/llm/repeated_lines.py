"""Lines that belong to a site and not to a document: found by within- against outside-source frequency, then removed.

One pass over the text turns every line into a 64-bit key of its wording (case, spacing, punctuation, numbers, dates
and personal names left out) and writes the keys, about a tenth of the text. All further passes read only keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import MONTHS
from ..runtime import bounded_broadcast, materialize

#: Candidates are at most (mean distinct lines of a row) / min_share for each source; broadcast up to this many.
MAX_BROADCAST = 200_000

#: Words that dates are filled with: month names and what may stand between the parts.
_FILLED = sorted({m for v in MONTHS.values() for m in v.split()} | {"de", "del", "st", "nd", "rd", "th", "er"})
#: Two to five words after a word that introduces a person, up to punctuation, a number or a word that ends the name.
_WHO = r"\p{L}[\p{L}.'’-]*(?:[\s\u00a0]+(?!(?:on|for|in|at|from|am|für|le|pour|el|para|and|und|et|y)(?!\p{L}))\p{L}[\p{L}.'’-]*){1,4}"


def line_key(line: Column) -> Column:
    """64-bit key of a line's fixed wording; null for a line without letters.

    Its words count in lower case and in order, without names of persons, numbers and the parts of dates.
    """
    s = F.lower(line)
    s = F.when(s.contains("by"), F.regexp_replace(s, r"(?<!\p{L})by[\s\u00a0]+" + _WHO, "by")).otherwise(s)
    s = F.when(s.rlike(r"^[^\p{L}]{0,8}(?:von|par|por)\s"), F.regexp_replace(s, r"^([^\p{L}]*)(von|par|por)[\s\u00a0]+" + _WHO, "$2")).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"[^\p{L}]+", " "))
    words = F.filter(F.split(s, " "), lambda w: ~w.isin(_FILLED))
    return F.when(s != "", F.xxhash64(words))


def _log_tail(g: Column) -> Column:
    """Natural log of the upper tail of chi-square with one degree of freedom at g (relative error below 2e-7)."""
    z = F.sqrt(g / 2)
    t = 1 / (1 + z / 2)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    return F.ln(t) - z * z - 1.26551223 + t * poly


def line_keys(df: DataFrame, key: str, source: str, body: str) -> DataFrame:
    """(k, s, h): row key, source and the array of line keys in order (null for a null body), written once."""
    lines = F.split(F.col(body), "\n")
    return materialize(df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.transform(lines, line_key).alias("h")))


def excess_lines(keys: DataFrame, min_rows: int = 5, min_share: float = 0.08, fdr: float = 0.01) -> DataFrame:
    """(s, x): the line keys significantly more frequent within a source than outside it.

    A line must occur in at least min_rows rows and min_share of the rows of its source. Its count there is compared
    with that in the sources which do not repeat it themselves, by the log-likelihood ratio; Benjamini-Hochberg over
    all lines seen twice in a source keeps the share of false findings below fdr.
    """
    size = keys.groupBy("s").agg(F.count("*").alias("n"))
    total = keys.count()
    # a row counts once, so equal keys are dropped inside the row; sums are then made before the shuffle
    once = keys.select("s", F.explode(F.array_distinct(F.filter("h", lambda x: x.isNotNull()))).alias("x"))
    counts = once.groupBy("s", "x").agg(F.count("*").alias("c")).where(F.col("c") >= 2)
    counts = materialize(counts.join(bounded_broadcast(size.select("s", "n"), MAX_BROADCAST), "s"))
    tests = counts.count()
    cand = counts.where((F.col("c") >= min_rows) & (F.col("c") >= F.col("n") * min_share))
    # rows of other sources with the line, single ones too, without the sources that repeat it themselves
    rep = cand.groupBy("x").agg(F.sum("c").alias("rc"), F.sum("n").alias("rn"))
    seen = once.join(bounded_broadcast(rep, MAX_BROADCAST), "x", "left_semi").groupBy("x").agg(F.count("*").alias("tc"))
    out = rep.join(seen, "x").select("x", (F.col("tc") - F.col("rc")).alias("oc"), (F.lit(total) - F.col("rn")).alias("on"))
    t = cand.join(bounded_broadcast(out, MAX_BROADCAST), "x")
    a, n1, b, n2 = F.col("c").cast("double"), F.col("n").cast("double"), F.col("oc").cast("double"), F.col("on").cast("double")
    p = (a + b) / (n1 + n2)

    def term(k: Column, n: Column) -> Column:
        part = lambda o, e: F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)
        return part(k, n * p) + part(n - k, n * (1 - p))

    g = F.when(p >= 1, F.lit(0.0)).otherwise(2 * (term(a, n1) + term(b, n2)))
    # where no other source is left to compare with, the line is tested against one occurrence in as many rows
    g = F.when(n2 > 0, g).otherwise(2 * a * F.ln(F.greatest(a, F.lit(2.0))))
    t = t.select("s", "x", "c", "n", "oc", "on", (a / n1 > b / F.greatest(n2, F.lit(1.0))).alias("up"), _log_tail(g).alias("lp"))
    t = materialize(t.where("up").drop("up"))
    # Benjamini-Hochberg on a grid of log p: the largest grid point e with tests * exp(e) <= fdr * #(lp <= e)
    grid = t.select(F.ceil(F.greatest("lp", F.lit(-200.0)) * 4).alias("e")).groupBy("e").agg(F.count("*").alias("c")).collect()
    import math

    cut, have = -math.inf, 0
    for r in sorted(grid, key=lambda r: r["e"]):
        have += r["c"]
        if math.log(max(tests, 1)) + r["e"] / 4 <= math.log(fdr) + math.log(have):
            cut = r["e"] / 4
    return t.where(F.col("lp") <= cut)


def _positions(keys: DataFrame, excess: DataFrame) -> DataFrame:
    """(k, at): rows that hold excess lines, with the positions of those lines."""
    ex = excess.select("s", "x")
    at = keys.select("k", "s", F.posexplode("h").alias("at", "x")).where(F.col("x").isNotNull())
    return at.join(bounded_broadcast(ex, MAX_BROADCAST), ["s", "x"], "left_semi").select("k", "at")


def find_repeated_lines(df: DataFrame, key: str = "ingest_seq", source: str = "source", body: str = "body", **how) -> DataFrame:
    """One row (key, line_no) for every line that is an instance of a line repeated in its source.

    Rows with a null source or body, and empty bodies, have no such line; equal rows each count; an empty table gives an
    empty result. Only the three named columns are read, so others may have any name.
    """
    keys = line_keys(df.where(F.col(source).isNotNull()), key, source, body)
    return _positions(keys, excess_lines(keys, **how)).select(F.col("k").alias(key), F.col("at").cast("int").alias("line_no"))


def remove_repeated_lines(df: DataFrame, key: str = "ingest_seq", source: str = "source", body: str = "body", out: str = "clean", **how) -> DataFrame:
    """df's key and source with the body less its repeated lines, the other lines in their order.

    A body of nothing but such lines becomes empty; a null body stays null; rows with equal keys are treated alike.
    """
    keys = line_keys(df.where(F.col(source).isNotNull()), key, source, body)
    gone = _positions(keys, excess_lines(keys, **how)).groupBy("k").agg(F.collect_set("at").alias("gone"))
    rows = df.select(F.col(key), F.col(source), F.col(body).alias("__body")).join(gone, F.col(key).eqNullSafe(F.col("k")), "left")
    kept = F.filter(F.split("__body", "\n"), lambda x, i: ~F.array_contains("gone", i))
    return rows.select(key, source, F.when(F.col("gone").isNull(), F.col("__body")).otherwise(F.array_join(kept, "\n")).alias(out), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
