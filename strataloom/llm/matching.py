"""Records of several catalogues that describe the same book, matched without a shared key, each with a confidence.

1. Every record is brought into one comparable form (normal.py): title without subtitle, volume and edition; people as a
   bag of names; year, language, publisher, volume and edition as codes.
2. Candidates share a band of MinHash values: of title trigrams, or of one title word and one name in the same year.
   Titles are banded once for each different title, so a hot title costs one row, and pairs come out without repeats.
3. Pairs get similarity features; a logistic model trained on pairs whose file hashes agree (and on pairs that contradict
   each other) turns them into a probability, calibrated on rows it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from .edits import distances
from .learn import bounded_sample, logistic
from .normal import FORM, normal_forms, strings

#: Title bands and values in a band; bands of title word, name and year.
BANDS, ROWS, JOINT = 7, 5, 4
#: Labelled pairs the model is fitted on at most.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Titles less similar than this are no candidates.
LEAST_TITLE = 0.6
_SALTS = np.random.default_rng(7).integers(1, 2**62, BANDS * ROWS).astype(np.uint64) | np.uint64(1)


def comparable(df: DataFrame, tab: str, rec: Column, title: str, people: str, year: str, language: str, publisher: str | None = None, hash_: str | None = None, subtitle: str | None = None, volume: str | None = None, edition: str | None = None) -> DataFrame:
    """The catalogue's rows in the common form; fields it lacks are not named.

    rec, tab; t, cut: title without subtitle, volume and edition, and whether it was cut short; people: the words of their
    names, sorted; names: hashes of them; y; lang: bits of languages; pub; vol; ed; hash.
    """
    fields = [title, people, year, language, publisher, volume, edition, hash_]
    raw = df.select(rec.alias("rec"), F.lit(tab).alias("tab"), *[(F.col(c) if c else F.lit(None)).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    return raw.mapInArrow(normal_forms, FORM)


def with_grams(rows: DataFrame) -> DataFrame:
    """The rows with ``grams``, of which the trigrams of people's names are made where two records meet: the words of the
    names, since the trigrams are larger and would be shuffled with every record."""
    return rows.withColumnRenamed("people", "grams")


def books(li: DataFrame, rs: DataFrame, zl: DataFrame) -> DataFrame:
    """The three catalogues in the common form, each named by its tab and key."""
    a = comparable(li, "li", F.concat(F.lit("li:"), F.col("e_id")), "title", "authors", "year", "language", None, None, "subtitle", "volume", "edition")
    b = comparable(rs, "rs", F.concat(F.lit("rs:"), F.col("ID")), "Title", "Authors", "Year", "Language", "Publisher", "MD5")
    c = comparable(zl, "zl", F.concat(F.lit("zl:"), F.col("zlibrary_id")), "title", "authors", "year", "language", "publisher", "md5")
    return a.unionByName(b).unionByName(c)


def _title_bands(titles: DataFrame) -> DataFrame:
    """(key, c, t, cut): a row for each band of each different title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = [f" {x} " for x in strings(b.column(0))]
            if not ts:
                continue
            raw = np.frombuffer("".join(ts).encode("utf-32-le"), np.uint32).astype(np.uint64)
            n = np.array([len(x) for x in ts])
            start = np.concatenate([[0], np.cumsum(n)])[:-1]
            g = raw.copy()
            g[:-2] = raw[:-2] * np.uint64(1315423911) + raw[1:-1] * np.uint64(2654435761) + raw[2:] * np.uint64(97)
            # the last two positions of a title would reach into the next: they repeat its last trigram
            for back in (1, 2):
                at = start + n - back
                g[at] = g[np.maximum(start, start + n - 3)]
            mins = []
            for salt in _SALTS:
                h = (g ^ salt) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                mins.append(np.minimum.reduceat(h * np.uint64(0xBF58476D1CE4E5B9), start))
            for band in range(BANDS):
                key = np.full(len(ts), band + 1, np.uint64)
                for m in mins[band * ROWS : (band + 1) * ROWS]:
                    key = (key ^ m) * np.uint64(0xFF51AFD7ED558CCD)
                    key ^= key >> np.uint64(33)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), b.column(1), b.column(0), b.column(2)], ["key", "c", "t", "cut"])

    return titles.select("t", "c", "cut").mapInArrow(run, "key long, c long, t string, cut boolean")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _joint_keys(records: DataFrame) -> DataFrame:
    """(key, c): for records (c, y, t, names) with names, one title word, one name and the year, for titles that are damaged
    or cut short; or two title words and one name, where no year is known. The words are those of least hash."""

    def lows(flat: np.ndarray, n: np.ndarray, salts: range) -> list[np.ndarray]:
        # each row begins with a value of its own, for where it has no word
        start = np.cumsum(n + 1) - n - 1
        full = np.zeros(len(flat) + len(n), np.uint64)
        place = np.ones(len(full), bool)
        place[start] = False
        full[place] = flat
        out = []
        for i in salts:
            h = _mix(full + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
            h[start] = np.uint64(2**64 - 1)
            out.append(np.minimum.reduceat(h, start))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            dated = b.column(1).is_valid()
            y = b.column(1).fill_null(0).to_numpy().astype(np.uint64)
            words = [[crc32(x.encode()) for x in t.split(" ") if len(x) > 3] for t in strings(b.column(2))]
            w = lows(np.array([x for r in words for x in r], np.uint64), np.array([len(r) for r in words]), range(2 * JOINT))
            p = lows(b.column(3).flatten().to_numpy().astype(np.uint64), b.column(3).value_lengths().to_numpy(), range(2 * JOINT, 3 * JOINT))
            key = lambda i, one, two: pa.array(_mix(_mix(_mix(one + np.uint64(i)) ^ two) ^ p[i % JOINT]).astype(np.int64))  # noqa: B023, E731
            for i in range(JOINT):
                yield pa.RecordBatch.from_arrays([key(i, y, w[i]).filter(dated), b.column(0).filter(dated)], ["key", "c"])
                yield pa.RecordBatch.from_arrays([key(JOINT + i, w[i], w[JOINT + i]), b.column(0)], ["key", "c"])

    return records.where("size(names) > 0").select("c", "y", "t", "names").mapInArrow(run, "key long, c long")


#: Pairs worked on at a time.
CHUNK = 16_384


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in the order of their first column, the key, and the numbers i, j of every two of them of equal key, some at a
    time. A key's rows may be spread over batches; of them alone more than a batch is held."""
    rest = None
    for b in batches:
        if not len(b):
            continue
        one = pa.Table.from_batches([b])
        rows = one if rest is None else pa.concat_tables([rest, one])
        last = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py(), "left"))
        yield from _within(rows.slice(0, last))
        rest = rows.slice(last)
    if rest is not None:
        yield from _within(rest)


def _within(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    if not len(rows):
        return
    key = rows.column(0).to_numpy()
    end = np.searchsorted(key, key, "right")
    held, n = [], 0
    rows = rows.combine_chunks()
    live, k = np.arange(len(key)), 1
    while len(live := live[live + k < end[live]]):
        for at in range(0, len(live), CHUNK):
            i = live[at : at + CHUNK]
            held.append((i, i + k))
            n += len(i)
            if n >= CHUNK:
                yield rows, *map(np.concatenate, zip(*held))
                held, n = [], 0
        k += 1
    if held:
        yield rows, *map(np.concatenate, zip(*held))


def _flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of strings, the start and the length of each in them."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8), at[:-1], np.diff(at)


def _similarity(one: tuple, two: tuple, short: np.ndarray) -> np.ndarray:
    (d1, at1, n1), (d2, at2, n2) = one, two
    n = np.minimum(n1, n2)
    m1, m2 = np.where(short, n, n1), np.where(short, n, n2)
    d = distances((d1, d2), (at1, at2), (m1, m2))
    sim = 1 - d / np.maximum(np.maximum(m1, m2), 1)
    # one begins with the other: as many edits as it is longer, and equal as far as the shorter one goes
    lacks = np.flatnonzero((n >= 20) & (d == np.abs(m1 - m2)) & (sim < 0.9))
    for i in lacks.tolist():
        k = int(n[i])
        if np.array_equal(d1[at1[i] : at1[i] + k], d2[at2[i] : at2[i] + k]):
            sim[i] = 0.9
    return sim


def _meet_titles(bands: DataFrame) -> DataFrame:
    """(c1, c2 and TITLE): the pairs of titles that share a band and are similar, once for each band.

    A band's titles are brought together once, in the order of their keys, and compared where they lie: pairs of titles that
    turn out not to be similar, most of them, are never written out as rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows, i, j in _met(batches):
            if rows is not held:
                held, c, t, cut, flat = rows, rows.column(1).to_numpy(), rows.column(2), rows.column(3).to_numpy(), _flat(rows.column(2))
            i, j = np.where(c[i] < c[j], i, j), np.where(c[i] < c[j], j, i)
            data, at, n = flat
            # only the titles that meet are handed on
            meets = np.zeros(len(c), bool)
            meets[i] = meets[j] = True
            used, number = np.flatnonzero(meets), np.cumsum(meets) - 1
            i2, j2 = number[i], number[j]
            lo, hi = at[used[0]], at[used[-1]] + n[used[-1]]
            data, at, n = data[lo:hi], at[used] - lo, n[used]
            sim = _similarity((data, at[i2], n[i2]), (data, at[j2], n[j2]), cut[i] | cut[j])
            ok = np.flatnonzero((sim >= LEAST_TITLE) & (c[i] != c[j]))
            text = strings(t.take(pa.array(used)))
            yield _titles_batch(c[i[ok]], c[j[ok]], [text[x] for x in i2[ok].tolist()], [text[x] for x in j2[ok].tolist()], sim[ok])

    return bands.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"c1 long, c2 long, {', '.join(f'{f} float' for f in TITLE)}")


def _meet_names(keys: DataFrame) -> DataFrame:
    """(c1, c2): the different pairs of titles that share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i, j in _met(batches):
            c = rows.column(1).to_numpy()
            a, b = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
            ok = np.flatnonzero(a != b)
            order = ok[np.lexsort((b[ok], a[ok]))]
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["c1", "c2"])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "c1 long, c2 long").distinct()


def similar(pairs: DataFrame, least: float = LEAST_TITLE) -> DataFrame:
    """(c1, c2, t1, t2, sim): the pairs (c1, c2, t1, t2, cut1, cut2) of titles of edit similarity ``least`` or more.

    A title that was cut short is compared with as much of the other; what a title of twenty letters or more lacks at its
    end counts as a tenth at most. Titles are plain ASCII.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = b.column(4).to_numpy(zero_copy_only=False) | b.column(5).to_numpy(zero_copy_only=False)
            sim = _similarity(_flat(b.column(2)), _flat(b.column(3)), short)
            ok = pa.array(sim >= least)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(ok) for i in range(4)), pa.array(sim).filter(ok)], ["c1", "c2", "t1", "t2", "sim"])

    return pairs.select("c1", "c2", "t1", "t2", "cut1", "cut2").mapInArrow(run, "c1 long, c2 long, t1 string, t2 string, sim double")


#: What is compared of two records besides their titles.
ATTRS = ["grams", "y", "lang", "pub", "vol", "ed", "hash"]


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, tf, fields of both): different pairs of classes from two catalogues that share a band and have similar titles.

    rows: (n, tab, t, cut, names and ATTRS). Titles are compared where they meet, once for each pair of different titles and
    band, so that only similar ones are shuffled on.
    """
    titled = rows.where(F.length("t") >= 3).withColumn("c", F.xxhash64("t", "cut"))
    titles = materialize(titled.select("c", "t", "cut").distinct(), free=True)
    side = lambda i: titles.select(*[F.col(c).alias(f"{c}{i}") for c in titles.columns])
    near = _meet_titles(_title_bands(titles))
    named = with_title_features(similar(_meet_names(_joint_keys(titled)).join(side(1), "c1").join(side(2), "c2")))
    # written, so that what it took to find them is off the disk before records are shuffled
    return records_of(materialize(near.unionByName(named), free=True), titles, titled)


def records_of(similar_titles: DataFrame, titles: DataFrame, titled: DataFrame) -> DataFrame:
    """The pairs of records of similar or equal titles, with the features of the titles and the fields of both records.

    similar_titles: (c1, c2) with TITLE, or as from similar().
    """
    side = lambda i: titled.select(*[F.col(c).alias(f"{c}{i}") for c in ("n", "tab", "c", *ATTRS)])
    # features are numbers, so a pair that several bands found is brought together without its strings
    feats = similar_titles if "sim" not in similar_titles.columns else with_title_features(similar_titles)
    close = feats.groupBy("c1", "c2").agg(*[F.max(f).alias(f) for f in TITLE]).select("c1", "c2", F.struct(*TITLE).alias("tf"))
    same = titles.select(F.col("c").alias("c1"), F.col("c").alias("c2"), F.struct(*[F.lit(float(f in ("title", "title_exact", "title_near"))).cast("float").alias(f) for f in TITLE]).alias("tf"))
    hit = close.unionByName(same).join(side(1), "c1").join(side(2), "c2").where("tab1 != tab2 and (c1 != c2 or n1 < n2)")
    return hit.withColumnsRenamed({"n1": "a", "n2": "b"})


TITLE = ["title", "title_exact", "title_near", "word_swap", "word_extra"]
RECORD = ["names", "names_hit", "names_none", "year_same", "year_none", "year_far", "lang_clash", "pub_same", "pub_clash", "vol_same", "vol_one", "vol_clash", "ed_same", "ed_one", "ed_clash"]
FEATURES = TITLE + RECORD


@lru_cache(100_000)
def _letters(w: str) -> int:
    return sum({1 << (ord(x) & 63) for x in w})


def _foreign(t1: list[str], t2: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each title's words of more than three letters that nothing like them (two edits) stands in the other."""
    own, ask = [], {}
    for x, y in zip(t1, t2):
        w1, w2 = x.split(" "), y.split(" ")
        r1, r2 = [(w, len(w), _letters(w)) for w in w1 if w not in w2], [(w, len(w), _letters(w)) for w in w2 if w not in w1]
        alone1, alone2 = {w for w, n, _ in r1 if n > 3}, {w for w, n, _ in r2 if n > 3}
        near = []
        for a, n, p in r1:
            for b, k, q in r2:
                # two edits bring at most two new letters to either word
                if -3 < n - k < 3 and (n > 3 or k > 3) and (p & ~q).bit_count() < 3 and (q & ~p).bit_count() < 3:
                    near.append((a, b))
        if near:
            ask.update(dict.fromkeys(near))
        own.append((alone1, alone2, near))
    if ask:
        d = distances(*zip(*(_flat(pa.array([p[i] for p in ask], pa.large_string())) for i in (0, 1))))
        ask = dict(zip(ask, (d <= 2).tolist()))
    for alone1, alone2, near in own:
        for a, b in near:
            if ask[a, b]:
                alone1.discard(a)
                alone2.discard(b)
    return np.array([len(o[0]) for o in own], np.int64), np.array([len(o[1]) for o in own], np.int64)


def _titles_batch(c1: np.ndarray, c2: np.ndarray, t1: list[str], t2: list[str], sim: np.ndarray) -> pa.RecordBatch:
    """(c1, c2 and TITLE). Words that stand in one title alone: on both sides, another work; on one, a cut title."""
    a1, a2 = _foreign(t1, t2)
    less = np.minimum(a1, a2)
    feats = [sim, sim >= 0.999, sim >= 0.85, less, np.maximum(a1, a2) - less]
    return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), *(pa.array(f.astype(np.float32)) for f in feats)], ["c1", "c2", *TITLE])


def with_title_features(pairs: DataFrame) -> DataFrame:
    """(c1, c2 and TITLE) of two titles t1, t2 of similarity sim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _titles_batch(b.column(0).to_numpy(), b.column(1).to_numpy(), strings(b.column(2)), strings(b.column(3)), b.column(4).to_numpy())

    return pairs.select("c1", "c2", "t1", "t2", "sim").mapInArrow(run, f"c1 long, c2 long, {', '.join(f'{f} float' for f in TITLE)}")


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of the letters a to z, with single blanks between them: the different trigrams within words, as row * 2^15 +
    trigram in order; and the words, as hashes with the row mixed in, and their rows."""
    data, at, n = _flat(col)
    row = np.repeat(np.arange(len(n)), n)
    x = data[at[0] : at[-1] + n[-1]].astype(np.int64) & 31  # the letters as 1 to 26, a blank as 0
    # a gap after each row, so that nothing reaches into the next
    place = np.arange(len(x)) + 2 * row
    full = np.zeros(len(x) + 2 * len(n) + 2, np.int64)
    full[place] = x
    a, b, c = full[place], full[place + 1], full[place + 2]
    ok = (a > 0) & (b > 0) & (c > 0)
    grams = np.sort((row << 15 | a << 10 | b << 5 | c)[ok])
    if len(grams):
        grams = grams[np.append(True, grams[1:] != grams[:-1])]
    begins = np.flatnonzero((x > 0) & (full[place - 1] == 0)) if len(x) else np.zeros(0, np.int64)
    if not len(begins):
        return grams, np.zeros(0, np.uint64), begins
    # letters weighted by their place in the word; blanks, at its end, weigh nothing
    length = np.diff(np.append(begins, len(x)))
    weight = _mix(np.arange(int(length.max())).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    letters = _mix(x.astype(np.uint64) * weight[np.arange(len(x)) - np.repeat(begins, length)])
    letters[x == 0] = 0
    return grams, _mix(np.add.reduceat(letters, begins)) ^ _mix(row[begins].astype(np.uint64) + np.uint64(7)), row[begins]


def name_features(one: pa.Array, two: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two records' words of names: the share of the fewer trigrams that both have, whether they have a word in common, and
    whether either has none."""
    (g1, w1, r1), (g2, w2, _) = _grams(one), _grams(two)
    count = lambda g: np.bincount(g >> 15, minlength=len(one))
    n1, n2 = count(g1), count(g2)
    over = count(np.intersect1d(g1, g2, assume_unique=True)) / np.maximum(np.minimum(n1, n2), 1)
    hit = np.zeros(len(one), bool)
    hit[r1[np.isin(w1, w2, assume_unique=True)]] = True
    return over, hit, (n1 == 0) | (n2 == 0)


def record_features() -> list[Column]:
    """Similarities of the other fields besides names; columns of the two records end in 1 and 2."""
    one = lambda x, y: F.col(x).isNull() != F.col(y).isNull()
    same = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) == F.col(y))
    clash = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))
    pubs = F.col("pub1").isNotNull() & F.col("pub2").isNotNull()
    pub_same = pubs & (F.levenshtein("pub1", "pub2", 2) >= 0)
    out = [
        same("y1", "y2"), F.col("y1").isNull() | F.col("y2").isNull(),
        F.coalesce(F.abs(F.col("y1") - F.col("y2")) > 1, F.lit(False)), (F.col("lang1") != 0) & (F.col("lang2") != 0) & (F.col("lang1").bitwiseAND(F.col("lang2")) == 0), pub_same, pubs & ~pub_same,
        same("vol1", "vol2"), one("vol1", "vol2"), clash("vol1", "vol2"), same("ed1", "ed2"), one("ed1", "ed2"), clash("ed1", "ed2"),
    ]
    return [F.coalesce(c.cast("float"), F.lit(0.0).cast("float")).alias(f) for f, c in zip(RECORD[3:], out)]


def train(pairs: DataFrame, sample: int = SAMPLE) -> tuple[list[float], float]:
    """Weights and intercept of the calibrated model.

    A pair of agreeing file hashes is taken as a match; one that contradicts itself in title, people, year, volume or
    edition as none. Each side gives at most half of the sample, drawn by hash.
    """
    lab = pairs.where("label is not null").select("x", F.xxhash64("a", "b").alias("h"), "label")
    total = dict(lab.groupBy("label").count().collect())
    half = [bounded_sample(lab.where(F.col("label") == v), "h", sample // 2, total.get(v, 0)) for v in (1.0, 0.0)]
    if min(map(len, half)) < 20:
        # too little to learn from: a plain rule of the same form, saying that title, people and year must agree
        w = dict(title=10.0, title_near=2.0, word_swap=-5.0, names=4.0, names_none=2.0, year_same=2.0, year_none=1.0, pub_same=1.0, pub_clash=-1.0, lang_clash=-1.0, vol_clash=-8.0, vol_one=-3.0, ed_clash=-8.0, year_far=-3.0)
        return [w.get(f, 0.0) for f in FEATURES], -12.5
    x = np.frombuffer(b"".join(v for h in half for v in h["x"]), np.float32).reshape(-1, len(FEATURES)).astype(float)
    y = np.concatenate([np.ones(len(half[0])), np.zeros(len(half[1]))])
    hold = np.arange(len(y)) % 4 == 3
    w, b = logistic(x[~hold], y[~hold])
    a, c = logistic((x[hold] @ w + b)[:, None], y[hold], l2=1e-2)
    return (w * a[0]).tolist(), float(b * a[0] + c)


def scored(pairs: DataFrame) -> DataFrame:
    """(a, b, same, label, x) of the pairs that candidates() gives: whether their file hashes agree, what train() takes them
    for, and the numbers of FEATURES in one value, since twenty columns cost more to write and read than to compute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            f = {name: b.column(i + 5).to_numpy() for i, name in enumerate(TITLE + RECORD[3:])} | dict(zip(RECORD[:3], name_features(b.column(3), b.column(4))))
            x = np.column_stack([f[name] for name in FEATURES]).astype("<f4")
            same = b.column(2).to_numpy(zero_copy_only=False)
            against = (f["title"] < 0.7) | (f["word_swap"] > 0) | ((f["names"] < 0.35) & ~f["names_hit"] & ~f["names_none"]) | ((f["year_same"] == 0) & (f["year_none"] == 0)) | (f["vol_clash"] == 1) | (f["ed_clash"] == 1)
            ends = np.arange(len(b) + 1, dtype=np.int32) * x.itemsize * len(FEATURES)
            packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(same.astype(float), mask=~same & ~against), packed], ["a", "b", "same", "label", "x"])

    same = F.coalesce(F.col("hash1") == F.col("hash2"), F.lit(False)).alias("same")
    flat = pairs.select("a", "b", same, "grams1", "grams2", *[F.col(f"tf.{f}").alias(f) for f in TITLE], *record_features())
    return flat.mapInArrow(run, "a long, b long, same boolean, label double, x binary")


def accepted(pairs: DataFrame, w: list[float], b: float, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, confidence) of the scored pairs that the model holds for the same book; those of agreeing hashes are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_numpy(zero_copy_only=False)), "<f4").reshape(-1, len(FEATURES))
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(x.astype(float) @ np.array(w) + b)))
            ok = pa.array(p >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(p).filter(ok)], ["a", "b", "confidence"])

    return pairs.where("not same").select("a", "b", "x").mapInArrow(run, "a long, b long, confidence double")


def match(rows: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(rec_a, rec_b, confidence): pairs of records of two catalogues that describe the same book, smaller name first.

    rows: as from books(). Records alike in every compared field form one class, and classes are matched; their members
    are paired only in the result. Pairs whose file hashes agree are left out, as the hash already joins them. A record
    without a title matches nothing; nulls elsewhere count as unknown; an empty catalogue gives no pairs.
    """
    rows = materialize(rows.withColumn("n", F.xxhash64("tab", "t", "cut", "people", "y", "lang", "pub", "vol", "ed", "hash")))
    reps = materialize(with_grams(rows.drop("rec").distinct()), free=True)
    mem = materialize(rows.select("n", "rec"))
    discard(rows)
    pairs = candidates(reps)
    pairs = materialize(scored(pairs), free=True)
    hit = accepted(pairs, *train(pairs, sample), threshold)
    out = hit.join(mem.select(F.col("n").alias("a"), F.col("rec").alias("ra")), "a").join(mem.select(F.col("n").alias("b"), F.col("rec").alias("rb")), "b")
    return out.select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"), F.round("confidence", 6).alias("confidence"))
