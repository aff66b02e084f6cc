"""A stored inverted index: postings in files by bucket of the term, with the statistics that ranking needs.

Built once by one shuffle of the tokens; a query then reads only the buckets and row groups of its own terms. A frequent
term fills its bucket, so each bucket is written in slices by document.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import shared_dir
from .retrieval import B, BOOSTS, K1, PHRASED, hash_vectors, floor_of, query_terms, slop_phrase

#: Buckets of terms, and slices of a bucket by document.
BUCKETS, SLICES = 64, 8


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies, and the number of documents and mean length of each field."""

    path: str
    stats: dict[str, tuple[int, float]]
    id_type: str

    def postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(id, field, term, tf, positions, dl) of the terms; other buckets are not read."""
        df = spark.read.schema(f"term string, id {self.id_type}, field string, tf long, positions array<int>, dl int, bucket int, slice int").parquet(f"{self.path}/postings")
        if not terms:
            return df.where("false").drop("bucket", "slice")
        rows = spark.range(1).select(*[_bucket(F.lit(t)).alias(f"b{i}") for i, t in enumerate(terms)]).collect()[0]
        return df.where(F.col("bucket").isin(*sorted(set(rows))) & F.col("term").isin(*terms)).drop("bucket", "slice")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build(df: DataFrame, id_: str, fields: dict[str, Column], path: str) -> TextIndex:
    """Writes the index of df's fields to path, unless it stands there whole; null and empty fields have no terms but count.

    Ids should be unique: rows of one id count as one document's.
    """
    spark = df.sparkSession
    if not _exists(spark, f"{path}/stats/_SUCCESS"):
        split = df.select(F.col(id_).alias("id"), *[T.terms(T.empty(c)).alias(f) for f, c in fields.items()])
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("w")) for f in fields]))
        rows = split.select("id", each.alias("f")).select("id", "f.field", F.size("f.w").alias("dl"), F.posexplode("f.w").alias("pos", "term"))
        rows = rows.withColumns({"bucket": _bucket(F.col("term")), "slice": F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int")})
        # grouped where the bucket is written: tokens are shuffled once
        got = rows.repartition("bucket", "slice").groupBy("bucket", "slice", "term", "id", "field").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))
        got.sortWithinPartitions("bucket", "slice", "term").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("bucket", "slice").parquet(f"{path}/postings")
        one = split.agg(F.count("*").alias("n"), *[F.avg(F.size(f)).alias(f) for f in fields])
        stats = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n"), F.coalesce(F.col(f), F.lit(0.0)).alias("mean")) for f in fields])).alias("s")).select("s.*")
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    rows = spark.read.parquet(f"{path}/stats").collect()
    return TextIndex(path, {r["field"]: (r["n"], r["mean"]) for r in rows}, df.select(id_).schema[0].dataType.simpleString())


def stored_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, which is made and written if it does not stand there whole."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def build_vectors(df: DataFrame, id_: str, text: Column, path: str, dims: int = 64) -> DataFrame:
    """The hash vectors of df's texts as (id, weight, bucket), written once by bucket; a query reads its own buckets."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        hash_vectors(df, id_, text, dims).repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path)


def stored(spark: SparkSession, source: str, what: str) -> str:
    """The path in the shared folder of what is derived from the table at ``source`` in its present state."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(p)
    state = ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
    return f"{shared_dir(spark)}/strataloom-{what}-{hashlib.md5(f'{source},{state}'.encode()).hexdigest()}"


def bm25(spark: SparkSession, index: TextIndex, query: str, keep: DataFrame | None = None, short: str = "all", least: int | None = None, phrase_boost: float = 2.0, slop: int = 2) -> DataFrame:
    """(id, score) of the documents that match, as retrieval.bm25 gives it, from the terms' postings alone.

    keep: the ids (column id) a filter allows; statistics cover all documents. least: how many terms a field must hold,
    in place of the floor. No terms match nothing.
    """
    terms = list(dict.fromkeys(t.lower() for t in query_terms(query)))
    hits = index.postings(spark, terms)
    if not terms:
        return hits.select("id", F.lit(0.0).alias("score"))
    n, need = len(terms), max(1, least or floor_of(len(terms), short))
    seen = {(r["field"], r["term"]): r["n"] for r in hits.groupBy("field", "term").agg(F.count("*").alias("n")).collect()}
    idf = {(f, t): math.log(1 + (total - seen.get((f, t), 0) + 0.5) / (seen.get((f, t), 0) + 0.5)) for f, (total, _) in index.stats.items() for t in terms}
    lit_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    key = F.concat_ws("\n", "field", "term")
    weight = F.element_at(lit_map({f"{f}\n{t}": v for (f, t), v in idf.items()}), key)
    mean = F.element_at(lit_map({f: m or 1.0 for f, (_, m) in index.stats.items()}), F.col("field"))
    boost = F.element_at(lit_map({f: BOOSTS.get(f, 1.0) for f in index.stats}), F.col("field"))
    if keep is not None:
        hits = hits.join(keep.select("id"), "id", "left_semi")
    norm = K1 * (1 - B + B * F.col("dl") / mean)
    place = F.element_at(lit_map({t: i for i, t in enumerate(terms)}), F.col("term"))
    phrase = n > 1 and phrase_boost != 1.0
    # both groupings follow the partitioning by id
    by = hits.select("id", "field", boost.alias("boost"), (weight * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("s"), F.struct(place.alias("i"), "positions").alias("at")).repartition("id").groupBy("id", "field")
    by = by.agg(F.sum("s").alias("s"), F.count("*").alias("found"), F.first("boost").alias("boost"), *([F.array_sort(F.collect_list("at")).alias("at")] if phrase else []))
    best = F.when(F.col("found") >= need, F.col("boost") * F.col("s")).otherwise(0.0)
    extra = F.lit(0.0)
    if phrase:
        whole = F.element_at(lit_map({f: sum(idf[f, t] for t in terms) if f in PHRASED else 0.0 for f in index.stats}), F.col("field"))
        near = (F.col("found") == n) & slop_phrase(F.transform("at", lambda a: a["positions"]), slop)
        extra = F.when(near, F.col("boost") * whole * phrase_boost).otherwise(0.0)
    out = by.groupBy("id").agg(F.max(best).alias("top"), F.max(extra).alias("more"))
    return out.where("top > 0").select("id", F.round(F.col("top") + F.col("more"), 6).alias("score"))


def fuse(branches: list, k: int = 100) -> DataFrame:
    """(id, score) of what the branches that work find: each is called and its k best are taken at once.

    One that fails, while it is planned or while it runs, is left out; if all fail, the first error is raised. Several
    lists are fused by reciprocal rank, one list scores 1 / (rank + 1).
    """
    from ..runtime import materialize
    from .retrieval import ranked, rrf

    lists, errors = [], []
    for b in branches:
        try:
            lists.append(materialize(ranked(b(), k).select("id", "rank")))
        except Exception as e:  # noqa: BLE001 - whatever fails, the others answer
            errors.append(e)
    if not lists:
        raise errors[0] if errors else ValueError("no retriever is given")
    if len(lists) == 1:
        return lists[0].select("id", F.round(1 / (F.col("rank") + 1), 6).alias("score"))
    return rrf(lists).select("id", "score")


def more_like(spark: SparkSession, index: TextIndex, df: DataFrame, id_: str, fields: dict[str, Column], of, k: int = 8, most: int = 25) -> DataFrame:
    """(id, score): documents that share any of the strongest terms of one document in the index's fields, itself left out."""
    mine = df.where(F.col(id_) == of)
    words = reduce(lambda a, b: F.concat(a, b), [T.terms(T.empty(c)) for c in fields.values()])
    tf = {r["t"]: r["tf"] for r in mine.select(F.explode(words).alias("t")).groupBy("t").agg(F.count("*").alias("tf")).collect()}
    total = max((n for n, _ in index.stats.values()), default=0)
    freq = {r["term"]: r["df"] for r in index.postings(spark, sorted(tf)).groupBy("term").agg(F.countDistinct("id").alias("df")).collect()}
    best = sorted(tf, key=lambda t: (-tf[t] * math.log(total / freq[t]) if freq.get(t) else 0.0, t))[:most]
    hits = bm25(spark, index, " ".join(best), least=1, phrase_boost=1.0).where(F.col("id") != of)
    return hits.orderBy(F.desc("score"), "id").limit(k)
