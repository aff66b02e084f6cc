"""Text of scanned pages made readable: page furniture out, broken words joined, misread letters put right.

1. Bodies that are hard-wrapped page text are told apart by their lines, in the JVM.
2. Of those, Python reads the lines: running heads by fuzzy repetition at page edges, page numbers by their sequence,
   halves of words at line ends. It yields one row for each finding and each token.
3. The words of all texts are counted once (texts a word occurs in). Joins with these counts decide whether a broken word
   has a hyphen of its own, and which frequent word a rare one is a misreading of; both are joins of distinct words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: Longest line of a page, and least number of lines that run on into the next.
PAGE_WIDTH, RUN_ON = 100, 2
#: A word counts as a misreading if a word it may be a misreading of occurs in so many more texts, and in so many at all.
RATIO, LEAST = 20, 4
#: The same for words of up to three letters, which are often words of another language.
RATIO_SHORT = 400
#: Letters of a word at most; longer runs of letters are no words.
LONGEST = 60
# Letters and what scanners read in their place.
CONFUSIONS = [
    ("m", "rn"), ("rn", "m"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("b", "li"), ("n", "ii"), ("n", "ri"), ("ri", "n"),
    ("u", "ii"), ("u", "li"), ("ti", "h"), ("in", "m"), ("ni", "m"), ("nn", "m"), ("m", "nn"), ("m", "in"), ("k", "lc"), ("e", "c"), ("c", "e"), ("t", "f"),
    ("f", "t"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("t", "l"), ("l", "t"), ("u", "v"), ("v", "u"), ("v", "y"),
    ("y", "v"), ("a", "@"), ("a", "o"), ("o", "a"), ("o", "0"), ("s", "5"), ("b", "6"), ("g", "9"), ("q", "9"), ("z", "2"), ("b", "8"), ("s", "8"),
    ("e", "3"), ("a", "4"), ("t", "7"), ("g", "q"), ("q", "g"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("s", "$"), ("i", "!"), ("l", "!"),
    ("c", "("), ("r", "n"), ("ß", "b"), ("ö", "o"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("e", "é"), ("o", "c"), ("c", "o"),
]
HYPHENS = "-‐‑¬­"
_EDGE = "\"'“”‘’«»„()[]{}<>.,;:!?…*|•·–—=~`_/\\"
_LETTER = re.compile(r"[^\W\d_]")
_CODE = re.compile(r"[A-Z]\d+[A-Z]?|\d+(?:[.,]\d+)*|[A-Z]{2,}\d*")
_NUM = r"(?:[0-9lIOoSs](?:\s?[0-9lIOoSs]){0,3}|[ivxlc]{1,7}|[IVXLC]{1,7})"
_PAGE = re.compile(rf"^[\W_]*(?:(?:page|pages|p|pp|pag|pág|página|seite|s|folio)\b\.?)?[\W_]*({_NUM})[\W_]*(?:(?:of|de|von|sur|/)\s*[0-9lO]{{1,4}})?[\W_]*$", re.I)
_SAID = re.compile(r"^[\W_]*(?:page|pages|p|pp|pag|pág|página|seite|s|folio)\b|^[-–—]\s*\w+\s*[-–—]$", re.I)
_ROMAN = re.compile(r"(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_DIGITS = str.maketrans("lIOoSs", "110055")
#: Lines of a page at least and at most, and pages that a sequence of numbers may miss in a row, the next one included.
PAGE_LINES, MISSED = (4, 90), 9
_HEAD_NUM = re.compile(rf"^(?:[\W_]*(?:p\.|page)?\s*({_NUM})(?:[\W_]*\s{{2,}}|\s*[|·•–—]\s*)(.+)|(.+?)(?:\s{{2,}}[\W_]*|\s*[|·•–—]\s*)(?:p\.|page)?\s*({_NUM})[\W_]*)$", re.I)


def scanned(body: Column) -> Column:
    """Whether ``body`` is page text: narrow lines, several of which run on into the next."""
    # cells of a table and lines of code run on as little as a full stop does
    run_on = F.regexp_count(body, F.lit(r"[^\s.!?:;{}|>][ \t]?\r?\n(?<=[^\n|]{16}[ \t]{0,1}\r?\n)\p{Ll}"))
    wide = F.regexp_count(body, F.lit(rf"[^\n]{{{PAGE_WIDTH + 1},}}"))
    lines = F.regexp_count(body, F.lit(r"\n"))
    return (run_on >= RUN_ON) & (wide * 5 <= run_on) & (run_on * 5 >= lines)


def _bare(s: str) -> str:
    return re.sub(r"[^a-zà-ÿ]+", " ", s.lower()).strip()


_letters = lru_cache(10_000)(Counter)


def _ratio(a: str, b: str) -> bool:
    """Whether SequenceMatcher's ratio reaches 0.85. It is dear, so its upper bounds come first: lengths, then letters."""
    n = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / n < 0.85:
        return False
    have = _letters(b)
    if 2.0 * sum(min(k, have[c]) for c, k in _letters(a).items()) / n < 0.85:
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85


def _like(a: str, b: str) -> bool:
    """Equal but for a few signs, or one the beginning of the other."""
    if not a or not b:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    # a head may be cut short, but to no less than a third
    if n >= 8 and 3 * n >= max(len(a), len(b)) and _ratio(a[:n], b[:n]):
        return True
    return _ratio(a, b)


def page_value(text: str) -> int:
    """The number that a page mark shows, misread digits and canonical Roman numerals included; 0 for none."""
    t = re.sub(r"\s", "", text)
    if re.search(r"\d", t) or not (t.islower() or t.isupper()) or not _ROMAN.fullmatch(t.lower()):
        t = t.translate(_DIGITS)
        return int(t) if t.isdecimal() else 0
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in t.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def sequence(marks: list[tuple[int, int]]) -> set[int]:
    """Lines of the longest run of page numbers: each is so much higher than the one before as pages lie between them.

    marks: (line, number) in the order of lines. One mark alone is no sequence.
    """
    last: dict[int, int] = {}
    length, before = [1] * len(marks), [-1] * len(marks)
    for n, (i, v) in enumerate(marks):
        for d in range(1, MISSED + 1):
            j = last.get(v - d, -1)
            if j >= 0 and PAGE_LINES[0] * d <= i - marks[j][0] <= PAGE_LINES[1] * d and length[j] >= length[n]:
                length[n], before[n] = length[j] + 1, j
        last[v] = n
    at = max(range(len(marks)), key=length.__getitem__, default=-1)
    # two marks prove little, unless they are of pages that follow each other
    if at < 0 or length[at] < 2 or length[at] == 2 and marks[at][1] - marks[before[at]][1] > 1:
        return set()
    out = set()
    while at >= 0:
        out.add(marks[at][0])
        at = before[at]
    return out


def furniture(lines: list[str], title: str) -> set[int]:
    """Numbers of the lines that are running heads, feet or page numbers."""
    t = _bare(title or "")
    marks: list[tuple[int, int]] = []
    number, plain_mark = set(), set()
    heads: list[tuple[int, str, bool]] = []
    for i, s in enumerate(lines):
        u = s.strip()
        m = _PAGE.match(u) if u and len(s) < 40 else None
        if m and (v := page_value(m.group(1))):
            number.add(i)
            marks.append((i, v))
            if not _SAID.match(u):
                plain_mark.add(i)
            continue
        if not 6 <= len(u) <= PAGE_WIDTH:
            continue
        m = _HEAD_NUM.match(u)
        if m and (v := page_value(m.group(1) or m.group(4))):
            marks.append((i, v))
        heads.append((i, _bare((m.group(2) or m.group(3)) if m else u), bool(m)))
    paged = sequence(marks)
    out = {i for i in number if i in paged or i not in plain_mark}

    def of_title(text: str) -> bool:
        if _like(text, t):
            return True
        words = text.split()
        # a chapter mark or a surname may stand before the title
        return any(len(words) > k + 1 and _like(" ".join(words[k:]), t) for k in (1, 2))

    for i, text, has in heads:
        near = i - 1 in number or i + 1 in number
        if not (has or near):
            continue
        if of_title(text):
            out.add(i)
            continue
        # a running head has no sentence end, does not run on from the line before, and repeats
        if lines[i].rstrip().endswith((".", ",", ";")) or not (has or lines[i].strip()[:1].isupper()):
            continue
        if any(j != i and abs(len(other) - len(text)) < 12 and _like(text, other) for j, other, _ in heads):
            out.add(i)
    # heads without a number: as a line already found, in capitals or as a repeated title amid the text
    known = list(dict.fromkeys(text for i, text, _ in heads if i in out))
    first = next((i for i, s in enumerate(lines) if s.strip()), 0)
    for i, text, _ in heads:
        if i in out or i == first:
            continue
        if not re.search(r"[A-ZÀ-Þ]", lines[i]):
            continue
        alone = not (i > 0 and lines[i - 1].strip() or i + 1 < len(lines) and lines[i + 1].strip())
        if not alone and any(abs(len(text) - len(k)) < 4 and _like(text, k) for k in known):
            out.add(i)
    # a number that continues no sequence is a page number only beside a running head
    found = {i for i, *_ in heads if i in out}
    return out | {i for i in number if i - 1 in found or i + 1 in found}


def token(w: str) -> str:
    return w.strip(_EDGE).strip(_EDGE + HYPHENS).lower()


def read_page(body: str, title: str, safe: frozenset[str] = frozenset(), seen: dict | None = None) -> list[tuple[int, str, str, str]]:
    """(line, kind, a, b): "furniture"; "break" with the halves of a word; "word" with a word and its original form.

    Words in ``safe`` are left out. ``seen`` keeps what other pages of the task said about a form.
    """
    seen = {} if seen is None else seen
    if len(seen) > 200_000:
        seen.clear()
    lines = [s.rstrip("\r") for s in body.split("\n")]
    gone = furniture(lines, title)
    out: list[tuple[int, str, str, str]] = [(i, "furniture", "", "") for i in sorted(gone)]
    live = [i for i, s in enumerate(lines) if i not in gone and s.strip()]
    tail: dict[int, bool] = {}
    for n, i in enumerate(live):
        words = lines[i].split()
        if tail.get(i):
            words = words[1:]
        if words and words[-1][-1] in HYPHENS and len(words[-1]) > 1 and n + 1 < len(live):
            nxt = lines[live[n + 1]].split()
            a, b = words[-1][:-1].lstrip(_EDGE), nxt[0].rstrip(_EDGE)
            if _LETTER.search(a[-1:]) and b[:1] and (b[0].islower() or b[0] in "0156@9(|ﬁﬂ") and _LETTER.search(b):
                out.append((i, "break", a.lower(), b.lower()))
                tail[live[n + 1]] = True
                words = words[:-1]
        for w in words:
            if w not in seen:
                core, t = w.strip(_EDGE), token(w)
                seen[w] = (t, core) if len(core) > 1 and t not in safe and _LETTER.search(core) and not _CODE.fullmatch(core) else None
            if (got := seen[w]) is not None:
                out.append((i, "word", *got))
    return out


def candidates(w: str) -> list[str]:
    """Words that w may be a misreading of: one or two confusions undone, or all of one kind."""
    seen = {w}
    ring = [w]
    for _ in range(2):
        nxt = []
        for s in ring:
            for right, wrong in CONFUSIONS:
                at = s.find(wrong)
                while at >= 0:
                    c = s[:at] + right + s[at + len(wrong) :]
                    if c not in seen:
                        seen.add(c)
                        nxt.append(c)
                    at = s.find(wrong, at + 1)
        ring = nxt
    seen.discard(w)
    return sorted(seen)


_SPLIT = "\"“”„«»()[]{}<>.,;:!?…*|•=~`_/\\\f\n\r\t "


def vocabulary(df: DataFrame, body: str) -> DataFrame:
    """(word, n): in how many texts a word occurs, lower case, compounds with their hyphens; words of one text left out."""
    # blanks and punctuation split; the words of a text are made distinct before they leave it
    s = F.translate(F.lower(F.col(body)), _SPLIT, " " * len(_SPLIT))
    return df.select(F.explode(F.array_distinct(F.split(s, " +"))).alias("word")).where(F.length("word").between(2, LONGEST) & F.col("word").rlike(r"^\p{L}[\p{L}'’-]*\p{L}$")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


def _best_readings(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(w, right): for each distinct rare word the frequent word it is most likely a misreading of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, c, n) for w, n in zip(b["w"], b["n"]) for c in candidates(w)]
            yield pd.DataFrame(rows, columns=["w", "c", "n"])

    types = words.distinct().join(vocab.withColumnRenamed("word", "w"), "w", "left").select("w", F.coalesce("n", F.lit(1)).alias("n"))
    # spread over the tasks by hash: reading a word is work, however few bytes it has; no confusion alters a length by more
    # than two, so longer words have no reading among the words counted
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = types.where(F.length("w").between(2, LONGEST + 4)).repartition(width, "w").mapInPandas(run, "w string, c string, n long")
    hit = pairs.join(vocab.select(F.col("word").alias("c"), F.col("n").alias("cn")), "c").where((F.col("cn") >= LEAST) & (F.col("cn") >= F.col("n") * F.when(F.length("w") <= 3, RATIO_SHORT).otherwise(RATIO)))
    # of several, the one with fewer signs changed counts first through its frequency; ties fall to the smaller word
    return hit.groupBy("w").agg(F.max_by("c", F.struct("cn", "c")).alias("right"))


def safe_words(vocab: DataFrame) -> list[str]:
    """Words so frequent that no word is RATIO times as frequent, which therefore cannot be misreadings.

    They occur in at least one in RATIO of the texts the most frequent word occurs in, so there are at most RATIO times
    as many as a text has different words: a list that does not grow with the corpus.
    """
    top = vocab.agg(F.max("n")).collect()[0][0] or 0
    return [r[0] for r in vocab.where(F.col("n") * RATIO > top).select("word").collect()]


def _analyse(df: DataFrame, key: str, body: str, title: str, safe: list[str]) -> DataFrame:
    known = df.sparkSession.sparkContext.broadcast(frozenset(safe))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in batches:
            rows = [(k, *r) for k, t, s in zip(b["k"], b["t"], b["s"]) for r in read_page(s, t, known.value, seen)]
            yield pd.DataFrame(rows, columns=["k", "line_no", "kind", "a", "b"])

    pages = df.where(scanned(F.col(body))).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.col(body).alias("s"))
    return materialize(pages.mapInPandas(run, "k long, line_no int, kind string, a string, b string"))


def find_defects(df: DataFrame, key: str = "ingest_seq", body: str = "body", title: str = "title") -> DataFrame:
    """Rows (key, line_no, kind, original, repaired), one for each defect in a scanned body.

    kind "furniture": a running head or page number, repaired empty. "break": a word broken at the end of this line, with
    the whole word; a hyphen the corpus writes stays. "word": a misread word with the right one. Words are in lower case
    without surrounding punctuation. Null and empty bodies, and bodies that are no page text, have no defects; an empty
    table gives an empty result; equal rows count each; other columns are never read.
    """
    vocab = materialize(vocabulary(df.where(F.col(body).isNotNull()), body))
    found = _analyse(df, key, body, title, safe_words(vocab))
    joined, kept = F.concat("a", "b"), F.concat("a", F.lit("-"), "b")
    breaks = found.where("kind = 'break'").select("k", "line_no", "a", "b", joined.alias("w1"), kept.alias("w2"))
    # a joined word may itself be misread, so both forms look for a reading like any other word
    tokens = found.where("kind = 'word'").select("k", "line_no", F.col("a").alias("w"), F.col("b").alias("original"))
    forms = breaks.select(F.explode(F.array("w1", "w2")).alias("w")).distinct()
    read = materialize(_best_readings(tokens.select("w").unionByName(forms), vocab))
    count = vocab.withColumnRenamed("word", "w")
    known = forms.join(count, "w", "left").join(read, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"), "right")
    known = known.join(count.select(F.col("w").alias("right"), F.col("n").alias("rn")), "right", "left").select("w", "right", F.greatest("n", F.coalesce("rn", F.lit(0))).alias("n"))
    side = lambda i: known.select(F.col("w").alias(f"w{i}"), F.col("n").alias(f"n{i}"), F.coalesce("right", "w").alias(f"r{i}"))
    both = breaks.join(side(1), "w1", "left").join(side(2), "w2", "left")
    whole = both.select("k", "line_no", F.lit("break").alias("kind"), F.col("w2").alias("original"), F.when(F.col("n2") > F.col("n1"), F.col("r2")).otherwise(F.col("r1")).alias("repaired"))
    wrong = tokens.join(read, "w").select("k", "line_no", F.lit("word").alias("kind"), "original", F.col("right").alias("repaired"))
    heads = found.where("kind = 'furniture'").select("k", "line_no", "kind", F.lit("").alias("original"), F.lit("").alias("repaired"))
    return heads.unionByName(whole).unionByName(wrong).withColumnRenamed("k", key)


def repair(df: DataFrame, key: str = "ingest_seq", body: str = "body", title: str = "title", out: str = "repaired") -> DataFrame:
    """(key, out): every scanned body as continuous paragraphs; other bodies as they are, null for null.

    A row key must name one row. A body that is all furniture becomes empty.
    """
    fix = find_defects(df, key, body, title)
    per = fix.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct("line_no", "kind", "original", "repaired")).alias("d"))
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(body).alias("s"), scanned(F.col(body)).alias("page")).join(per, "k", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [s if not page or s is None else rebuild(s, [] if d is None else list(d)) for s, page, d in zip(b["s"], b["page"], b["d"])]
            yield pd.DataFrame({"k": b["k"], "r": texts})

    return rows.mapInPandas(run, "k long, r string").select(F.col("k").alias(key), F.col("r").alias(out))


def rebuild(body: str, defects: list) -> str:
    """Paragraphs of a page with its defects repaired."""
    lines = [s.rstrip("\r") for s in body.split("\n")]
    gone = {d["line_no"] for d in defects if d["kind"] == "furniture"}
    words: dict[int, list[tuple[str, str]]] = {}
    whole = {d["line_no"]: d["repaired"] for d in defects if d["kind"] == "break"}
    for d in defects:
        if d["kind"] == "word":
            words.setdefault(d["line_no"], []).append((d["original"], d["repaired"]))
    paras: list[list[str]] = [[]]
    join: str | None = None
    for i, s in enumerate(lines):
        if i in gone:
            continue
        if not s.strip():
            if join is None:
                paras.append([])
            continue
        for a, b in words.get(i, ()):
            s = s.replace(a, b.capitalize() if a[:1].isupper() else b)
        parts = s.split()
        if join is not None:
            rest = parts[0][len(parts[0].rstrip(_EDGE)) :]
            parts[0] = join + rest
            join = None
        if i in whole:
            lead = parts[-1][: len(parts[-1]) - len(parts[-1].lstrip(_EDGE))]
            w = whole[i]
            join = lead + (w.capitalize() if parts[-1].lstrip(_EDGE)[:1].isupper() else w)
            parts = parts[:-1]
        paras[-1] += parts
    if join:
        paras[-1].append(join)
    return "\n\n".join(" ".join(p) for p in paras if p)
