"""Retrieval and ranking: inverted index, BM25, full-text match, exact vector search, fusion, re-ranking.

Ranking always works on (id, score) alone; documents are joined to the page that is shown. Statistics that a query needs
(counts of its few terms) are one small row; nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import bounded_broadcast, materialize

K1, B, RRF_K, CANDIDATES = 1.2, 0.75, 60, 100
# Boosts of the fields of a lexical query.
BOOSTS = {"title": 3.0, "abstract": 2.0, "search_text": 1.0, "authors": 2.0, "equations": 2.0}


#: Fields whose words are looked at as a phrase.
PHRASED = ("title", "abstract", "search_text")


def slop_phrase(positions: Column, slop: int = 2) -> Column:
    """Whether some choice of one position for each term, in the terms' order, departs from a phrase by ``slop`` at most.

    positions: an array for each term of where it stands. What counts is how far the positions less the terms' places lie
    apart, so neighbours may be swapped or words stand between.
    """
    moved = F.transform(positions, lambda ps, i: F.transform(ps, lambda p: p - i))
    fits = lambda all_, a: F.forall(all_, lambda ps: F.exists(ps, lambda p: p.between(a, a + slop)))
    return F.element_at(F.transform(F.array(moved), lambda m: F.exists(F.flatten(m), lambda a: fits(m, a))), 1)


def _places(words: Column, term: str) -> Column:
    """Where a term stands, from 0."""
    return F.filter(F.transform(words, lambda x, i: F.when(x == term, i)), lambda i: i.isNotNull())


def query_terms(q: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", q or "")


def floor_of(n: int, short: str = "all") -> int:
    """How many of n terms must match: all of one or two (any, if short is "any"), else 70 % rounded down."""
    return math.floor(0.7 * n) if n > 2 else n if short == "all" else min(n, 1)


def postings(df: DataFrame, id_: str, fields: dict[str, Column]) -> DataFrame:
    """(id, field, term, tf, positions, dl): the inverted index, to be written bucketed by term."""
    f = F.array(*[F.struct(F.lit(n).alias("field"), T.terms(T.empty(c)).alias("w")) for n, c in fields.items()])
    rows = df.select(F.col(id_).alias("id"), F.explode(f).alias("f")).select("id", "f.field", F.size("f.w").alias("dl"), F.posexplode("f.w").alias("pos", "term"))
    return rows.groupBy("id", "field", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))


def bm25(df: DataFrame, id_: str, fields: dict[str, Column], query: str, keep: Column | None = None, short: str = "all", phrase_boost: float = 2.0, slop: int = 2) -> DataFrame:
    """(id, score) of the documents that match: the best field's boosted BM25, plus a bonus for the whole phrase.

    Statistics cover all of df; ``keep`` narrows only the result. A field counts if it holds enough of the terms. No terms
    match nothing. Terms are counted inside each row, so the corpus is read once and no text is shuffled.
    """
    terms = list(dict.fromkeys(t.lower() for t in query_terms(query)))
    if not terms:
        return df.select(F.col(id_).alias("id"), F.lit(0.0).alias("score")).where("false")
    n, need = len(terms), floor_of(len(terms), short)
    phrase = n > 1 and phrase_boost != 1.0
    split = df.select(F.col(id_).alias("id"), (keep if keep is not None else F.lit(True)).alias("keep"), *[T.terms(T.empty(c)).alias(f"w_{f}") for f, c in fields.items()])
    # of a text's words only numbers are kept; they are written once, for the statistics and for the scores
    cols = []
    for f in fields:
        w = F.col(f"w_{f}")
        cols += [F.size(w).alias(f"dl_{f}"), F.filter(w, lambda x: x.isin(terms)).alias(f"hit_{f}")]
        every = reduce(lambda a, b: a & b, [F.array_contains(w, t) for t in terms])
        at = F.array(*[_places(w, t) for t in terms])
        cols.append((F.when(every, slop_phrase(at, slop)).otherwise(False) if phrase and f in PHRASED else F.lit(False)).alias(f"ph_{f}"))
    base = materialize(split.select("id", "keep", *cols))
    tf = lambda f, t: F.size(F.filter(f"hit_{f}", lambda x: x == t))
    aggs = [F.count("*").alias("n")] + [F.avg(f"dl_{f}").alias(f"avg_{f}") for f in fields]
    aggs += [F.sum(F.array_contains(f"hit_{f}", t).cast("long")).alias(f"df_{f}_{i}") for f in fields for i, t in enumerate(terms)]
    s = base.agg(*aggs).collect()[0]
    big_n = s["n"] or 0
    best, bonus = [], [F.lit(0.0)]
    for f in fields:
        idf = [math.log(1 + (big_n - (s[f"df_{f}_{i}"] or 0) + 0.5) / ((s[f"df_{f}_{i}"] or 0) + 0.5)) for i in range(n)]
        avg = s[f"avg_{f}"] or 1.0
        norm = K1 * (1 - B + B * F.col(f"dl_{f}") / avg)
        score = sum((F.lit(idf[i]) * tf(f, t) * (K1 + 1) / (tf(f, t) + norm) for i, t in enumerate(terms)), F.lit(0.0))
        found = F.size(F.array_distinct(f"hit_{f}"))
        best.append(F.when(found >= max(need, 1), BOOSTS.get(f, 1.0) * score).otherwise(0.0))
        if phrase and f in ("title", "abstract", "search_text"):
            bonus.append(F.when(F.col(f"ph_{f}"), BOOSTS[f] * sum(idf)).otherwise(0.0))
    top = F.greatest(*best) if len(best) > 1 else best[0]
    more = F.greatest(*bonus) * phrase_boost if len(bonus) > 1 else F.lit(0.0)
    some = reduce(lambda a, b: a | b, [F.size(f"hit_{f}") > 0 for f in fields])
    return base.where("keep").where(some).select("id", top.alias("top"), more.alias("more")).where("top > 0").select("id", F.round(F.col("top") + F.col("more"), 6).alias("score"))


def top_k(df: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best by score, ties by id; sorted and cut in each partition first."""
    return df.orderBy(F.desc("score"), *(tie or ("id",))).limit(k)


def ranked(df: DataFrame, k: int) -> DataFrame:
    """(id, score, rank) of the k best, rank from 0. The window runs over those k rows only."""
    return top_k(df, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def parse_web(q: str) -> list[tuple[bool, list[list[str]]]]:
    """Full-text query: bare words must all occur, "quotes" make a phrase, - excludes, or joins alternatives."""
    out: list[tuple[bool, list[list[str]]]] = []
    alt = False
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', q or ""):
        if m.group(4) and m.group(4).lower() == "or":
            alt = True
            continue
        neg = bool(m.group(1) or m.group(3))
        w = [t.lower() for t in query_terms(m.group(2) if m.group(2) is not None else m.group(4))]
        if w and alt and out and not neg and not out[-1][0]:
            out[-1][1].append(w)
        elif w:
            out.append((neg, [w]))
        alt = False
    return out


def fulltext(text: Column, q: str) -> Column:
    """Whether text answers the query of parse_web. No stemming, no stop words."""
    padded = F.concat(F.lit(" "), F.array_join(T.terms(text), " "), F.lit(" "))
    c = F.lit(True)
    for neg, alts in parse_web(q):
        any_ = reduce(lambda a, b: a | b, [padded.contains(f" {' '.join(w)} ") for w in alts])
        c = c & (~any_ if neg else any_)
    return c if parse_web(q) else F.lit(False)


def weighted_rank(fields: dict[str, tuple[Column, float]], q: str, phrase_boost: float = 2.0) -> Column:
    """A rank for full-text matches: weighted term frequency over length, times the phrase boost.

    Cover density is PostgreSQL's own; this simpler measure keeps its weights of A, B and C fields.
    """
    w = [t.lower() for t in query_terms(q)]
    total = F.lit(0.0)
    for c, weight in fields.values():
        t = T.terms(T.empty(c))
        total = total + F.lit(weight) * F.size(F.filter(t, lambda x: x.isin(w))) / (1 + F.log(F.size(t) + 1.0))
    whole = reduce(lambda a, b: a | b, [T.lower_phrase(c, w) for c, _ in fields.values()]) if len(w) > 1 else F.lit(False)
    return F.round(F.when(whole, total * phrase_boost).otherwise(total), 6)


def knn(df: DataFrame, id_: str, vector: str, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """(id, score) of the k nearest by cosine; rows without a vector are left out; the filter runs before the search."""
    q = F.array(*[F.lit(float(x)) for x in query])
    src = df if keep is None else df.where(keep)
    hit = src.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.round(T.cosine(F.col(vector), q), 6).alias("score"))
    return top_k(hit, k)


def hash_vectors(df: DataFrame, id_: str, text: Column, dims: int = 64) -> DataFrame:
    """(id, bucket, weight): the hash embedding in sparse form, made by one aggregation without user code."""
    t = df.select(F.col(id_), F.explode(T.terms(T.empty(text))).alias("t"))
    v = t.groupBy(id_, T.token_bucket(F.col("t"), dims).alias("bucket")).agg(F.sum(T.token_sign(F.col("t"))).alias("x")).where("x != 0")
    n = v.groupBy(id_).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return v.join(n, id_).select(id_, "bucket", (F.col("x") / F.col("norm")).alias("weight"))


def hash_vector(text: str, dims: int = 64) -> dict[int, float]:
    """The same for one query, on the driver."""
    import hashlib

    v: dict[int, float] = {}
    for t in re.findall(r"[^\W_]+", text.lower()):
        h = hashlib.md5(t.encode()).digest()
        b = int.from_bytes(h[:4], "big") % dims
        v[b] = v.get(b, 0.0) + (1.0 if h[4] & 1 else -1.0)
    n = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / n for b, x in v.items() if x} if n else {0: 1.0}


def hash_knn(vectors: DataFrame, id_: str, query: str, dims: int = 64) -> DataFrame:
    """(id, score): cosine of unit sparse vectors with the query's; the query is a literal of at most dims entries."""
    q = hash_vector(query, dims)
    w = F.create_map(*[x for b, v in q.items() for x in (F.lit(b), F.lit(v))])
    return vectors.where(F.col("bucket").isin(*q)).groupBy(F.col(id_).alias("id")).agg(F.round(F.sum(F.col("weight") * F.element_at(w, F.col("bucket"))), 6).alias("score"))


def rrf(lists: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(id, score, first_list, first_rank) of ranked lists (id, rank from 0): the sum of weight / (k + rank + 1)."""
    if weights is not None and len(weights) != len(lists):
        raise ValueError("one weight is needed for each list")
    w = weights or [1.0] * len(lists)
    parts = [df.select("id", F.lit(i).alias("l"), F.col("rank").alias("r"), F.lit(float(w[i])).alias("w")) for i, df in enumerate(lists)]
    one = reduce(DataFrame.unionByName, parts)
    first = F.min(F.struct("l", "r"))
    return one.groupBy("id").agg(F.round(F.sum(F.col("w") / (k + F.col("r") + 1)), 6).alias("score"), first["l"].alias("first_list"), first["r"].alias("first_rank"))


def score_ceiling(n_lists: int, k: int = RRF_K) -> float:
    return 0.0 if n_lists == 0 else 1.0 if n_lists == 1 else n_lists / (k + 1)


def relevance(score: Column, ceiling: float) -> Column:
    return F.lit(0.0) if ceiling <= 0 else F.round(F.least(score / ceiling, F.lit(1.0)), 4)


def page_of(df: DataFrame, page: int, per_page: int, *order: Column) -> DataFrame:
    """One page of a fused list, page from 1, at most 100 rows."""
    per_page = max(1, min(per_page, 100))
    return df.orderBy(*order).offset((max(1, page) - 1) * per_page).limit(per_page)


def rerank(score: Column, title: Column, abstract: Column, q: str) -> Column:
    """Score raised if the whole query stands in the title (else in the abstract), and if all its terms do."""
    t = query_terms(q)
    title, abstract = F.lower(T.empty(title)), F.lower(T.empty(abstract))
    m = F.lit(1.0)
    if len(t) > 1:
        m = F.when(title.contains(q.lower()), 1.35).when(abstract.contains(q.lower()), 1.15).otherwise(1.0)
    every = reduce(lambda a, b: a & b, [title.contains(x.lower()) for x in t]) if t else F.lit(False)
    return score * m * F.when(every, 1.25).otherwise(1.0)


def _credit(tok: Column, term: str) -> Column:
    """1 for an equal token, 0.6 if one begins the other and both have four letters or more."""
    begins = F.startswith(tok, F.lit(term)) | F.startswith(F.lit(term), tok)
    return F.when(tok == term, 1.0).when((F.length(tok) >= 4) & (len(term) >= 4) & begins, 0.6).otherwise(0.0)


def _met(tokens: Column, term: str) -> Column:
    return F.exists(tokens, lambda x: _credit(x, term) > 0)


# Weights of the fields of the offline scorer.
FIELD_WEIGHTS = {"title": 8.0, "abstract": 3.0, "tags": 2.0, "meta": 1.0}


def lexical_score(fields: dict[str, Column], q: str) -> Column:
    """The offline scorer: saturating matches of each field, times coverage, times a bonus for the phrase."""
    terms = re.findall("[a-z0-9]+", q.lower())
    if not terms:
        return F.lit(1.0)
    total = F.lit(0.0)
    seen = {t: F.lit(False) for t in terms}
    for name, weight in FIELD_WEIGHTS.items():
        tok = T.ascii_tokens(T.empty(fields[name]))
        m = F.aggregate(tok, F.lit(0.0), lambda a, x: a + sum((_credit(x, t) for t in terms), F.lit(0.0)))
        total = total + weight * m / (m + 1.5)
        seen = {t: c | _met(tok, t) for t, c in seen.items()}
    cover = sum((c.cast("int") for c in seen.values()), F.lit(0)) / len(seen)
    low = lambda c: F.lower(T.empty(c)).contains(q.lower())
    bonus = F.when(low(fields["title"]), 1.75).when(low(fields["abstract"]), 1.35).otherwise(1.0)
    return total * (0.25 + 0.75 * cover) * bonus


def lexical_rerank(score: Column, title: Column, body: Column, q: str) -> Column:
    terms = re.findall("[a-z0-9]+", q.lower())
    if not terms:
        return score
    all_in = lambda c: reduce(lambda a, b: a & b, [F.lower(T.empty(c)).contains(t) for t in terms])
    return score * F.when(all_in(title), 1.25).otherwise(1.0) * (F.when(all_in(body), 1.15).otherwise(1.0) if len(terms) > 1 else 1.0)


def highlight(df: DataFrame, id_: str, text: Column, terms: list[str], most: int = 2) -> DataFrame:
    """(id, fragments): the first lines that hold a term, with em marks; rows without one are left out."""
    rx = "|".join(re.escape(t) for t in terms)
    hit = F.filter(F.split(text, "\n+"), lambda x: x.rlike(f"(?i)({rx})"))
    marked = F.transform(F.slice(hit, 1, most), lambda x: F.regexp_replace(x, f"(?i)({rx})", "<em>$1</em>"))
    return df.select(F.col(id_), marked.alias("fragments")).where(F.size("fragments") > 0)


def snippets(df: DataFrame, id_: str, text: Column, terms: list[str], chars: int = 240, lead: int = 80) -> DataFrame:
    """(id, snippet) around the first match, cut at words, prefixes marked too; rows without a match are left out."""
    s = T.collapse(text)
    rx = "|".join(re.escape(t) for t in terms)
    word = rf"(?i)(?<![a-z0-9])((?:{rx})[a-z0-9]*)"
    at = F.regexp_instr(s, F.lit(word))
    rows = df.select(F.col(id_), s.alias("s"), at.alias("at")).where("at > 0")
    start = F.when(F.col("at") > lead, F.col("at") - lead).otherwise(1)
    head = F.substr("s", start, F.lit(chars))
    head = F.when(start > 1, F.regexp_replace(head, r"^\S*\s", "")).otherwise(head)
    body = F.when(F.length("s") > start + chars, F.regexp_replace(head, r"\s\S*$", "")).otherwise(head)
    marked = F.regexp_replace(body, word, "<em>$1</em>")
    return rows.select(id_, F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(F.length("s") > start + chars, "…").otherwise("")).alias("snippet"))


def facet(df: DataFrame, name: str, value: Column, most: int | None = 20) -> DataFrame:
    """(facet, value, count), nulls left out, the most frequent first, ties by value."""
    c = df.select(value.cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    c = c.select(F.lit(name).alias("facet"), "value", "count")
    return c if most is None else c.orderBy(F.desc("count"), "value").limit(most)


def quantize(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, code, scale): unit vectors with a byte for each entry, a quarter of the size; rows without a vector left out."""
    v = df.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v"))
    v = v.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.array_max(F.transform("v", lambda x: F.abs(x))).alias("top"))
    code = F.transform("v", lambda x: F.coalesce(F.round(x / F.nullif(F.col("top"), F.lit(0.0)) * 127), F.lit(0.0)).cast("byte"))
    return v.select("id", code.alias("code"), F.coalesce(F.try_divide(F.col("top") / 127, "norm"), F.lit(0.0)).alias("scale"))


def approximate_knn(df: DataFrame, id_: str, vector: str, query: list[float], k: int, codes: DataFrame | None = None, candidates: int | None = None) -> DataFrame:
    """(id, score): the k nearest by cosine, looked for among the ``candidates`` (3 k) nearest by their codes.

    Only the codes of all rows are read; the vectors of the candidates alone are ranked exactly. codes: as quantize()
    wrote them, once for all queries.
    """
    codes = materialize(quantize(df, id_, vector)) if codes is None else codes
    q = F.array(*[F.lit(float(x)) for x in query])
    rough = codes.select("id", (T.dot(F.col("code"), q) * F.col("scale")).alias("score"))
    few = top_k(rough, candidates or 3 * k).select(F.col("id").alias(id_))
    return knn(df.join(F.broadcast(few), id_, "left_semi"), id_, vector, query, k)


def related(df: DataFrame, id_: str, vector: str, of: int, k: int = 8) -> DataFrame:
    """(id, score): nearest neighbours of a stored vector, itself left out."""
    q = df.where(F.col(id_) == of).select(vector).limit(1).collect()
    return knn(df, id_, vector, q[0][0], k, F.col(id_) != of) if q and q[0][0] is not None else df.select(F.col(id_).alias("id"), F.lit(0.0).alias("score")).where("false")


def key_terms(df: DataFrame, id_: str, text: Column, of: int, most: int = 25) -> list[str]:
    """The terms of one document with the highest tf-idf, for a search without vectors."""
    mine = df.where(F.col(id_) == of).select(F.explode(T.terms(text)).alias("t")).groupBy("t").agg(F.count("*").alias("tf"))
    freq = df.select(F.explode(F.array_distinct(T.terms(text))).alias("t")).join(bounded_broadcast(mine, 100_000), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df"))
    n = df.count()
    best = mine.join(freq, "t").select("t", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("w")).orderBy(F.desc("w"), "t").limit(most)
    return [r["t"] for r in best.collect()]
