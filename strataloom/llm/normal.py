"""The comparable form of one catalogue record: plain functions of strings, run on the executors in Arrow batches.

They say the same as words.plain() and survivorship.file_hash(), which are expressions. A record takes a dozen patterns,
each behind a sign that it may match; here each step's result is a variable, and fields of few values are looked up.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa

from .survivorship import EMPTY_FILE
from .words import _FROM, _TO, INVISIBLE

# Names and codes of languages.
LANGUAGES = {
    "en": "en eng english anglais englisch inglés ingles", "de": "de ger deu german deutsch allemand alemán", "fr": "fr fre fra french français francais französisch francés",
    "es": "es esl spa spanish español espanol castellano espagnol spanisch", "it": "it ita italian italiano", "pt": "pt por portuguese português", "nl": "nl dut nld dutch nederlands",
    "ru": "ru rus russian", "pl": "pl pol polish", "sv": "sv swe swedish",
}
_BITS = {w: 1 << i for i, v in enumerate(LANGUAGES.values()) for w in v.split()}
_ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10}
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_NUMBERS = _ORDINALS | _ROMAN
# Words that titles shorten, up to their stop.
_SHORT = {
    "princ": "principles", "intro": "introduction", "introd": "introduction", "found": "foundations", "fdns": "foundations", "handb": "handbook", "hdbk": "handbook",
    "adv": "advances", "prob": "problems", "probs": "problems", "fund": "fundamentals", "elem": "elements", "th": "theory", "pract": "practice", "gd": "guide", "proc": "proceedings",
}
_re = lambda p: re.compile(p, re.ASCII)
_VOL = _re(r"(?:[\s,;:(\[-]+(?:vol(?:ume)?|v|bd|band|tome|tomo|part|pt|book)\.?\s*(\d{1,3}|[ivx]{1,5})\b[\])]?|[\s,]*[(\[](\d{1,2}|[ivx]{1,5})[\])](?=\W*$|\W+\d?\w*\W*ed)|,\s*(\d{1,2}|[ivx]{1,5})(?=\W*$))")
_VOL_NUMBER = _re(r"(\d{1,3}|[ivx]{1,5})\W*$")
_ED = _re(r"[\s,;:(\[-]*\b(\d{1,2}(?=st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)(?:st|nd|rd|th)?\s+(?:rev(?:ised|\.)?\s+)?ed(?:ition|n)?\b\.?[\])]?")
_MEDIA = _re(r"[\s-]*[(\[]?\b(?:pdf|e-?book|scan(?:ned)?|epub|djvu|mobi|retail|ocr)\b[)\]]?\s*$")
_BLANKS = _re(r"[_\s]+")
_ARTICLE = _re(r",\s*(?:the|an?)\s*$")
_STOPPED = _re(rf"\b({'|'.join(_SHORT)})\.")
_SUBTITLE = _re(r"(?:\s*[:;]\s*|\s+-+\s+|\.{3}.*$|…|\.\s+|\s*[(\[]).*$")
_WORD, _NAME, _YEAR = _re("[a-z0-9]+"), _re("[a-z]{3,}"), _re(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")
_SMALL = frozenset(("and", "of", "in", "the", "a", "an"))
_NO_NAME = frozenset(("and", "transl", "edited", "editor", "eds", "ltd", "sons", "the"))
_PUB = _re(r"\b(?:press|publishing|publishers?|verlag|editions?|books|academic|ltd|inc|co|gmbh|company|and|the|limited)\b|[^a-z0-9]")
_TAG, _ENTITY = _re(r"</?[A-Za-z][^<>\n]{0,200}>"), _re(r"&(?:[a-zA-Z]{2,8}|#\d{1,6});")
_MARKS = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"}
_FOLD = _MARKS | dict.fromkeys(map(ord, INVISIBLE)) | {ord("ﬁ"): "fi", ord("ﬂ"): "fl", ord("ﬀ"): "ff"} | str.maketrans(_FROM, _TO)
_HASH_HEAD, _HASH_SIGNS = _re(r"^[\s\"'{(<\[]*(?:(?:urn:)?md5\s*[:=]?|0x)?"), _re(r"[\s\-:.\"'{}()<>\[\] ]")
_HASH, _REPEATS = _re("[0-9a-f]{32}"), _re(r"(.)\1{31}|(.{2,8}?)\2+")


def plain_text(s: str) -> str:
    """words.plain() of a string."""
    if "<" in s:
        s = _TAG.sub(" ", s)
    if "&" in s:
        s = _ENTITY.sub(" ", s)
    s = s.lower()
    return s if s.isascii() else s.translate(_FOLD)


def hash_digits(h: str | None) -> str | None:
    """survivorship.file_hash() of a string."""
    if h is None:
        return None
    s = h.lower()
    if not _HASH.fullmatch(s):
        s = _HASH_SIGNS.sub("", _HASH_HEAD.sub("", s, count=1))
        if not _HASH.fullmatch(s):
            return None
    return None if _REPEATS.fullmatch(s) or s == EMPTY_FILE or s.startswith(("0123456789abcdef", "123456789")) else s


@lru_cache(10_000)
def _number(s: str | None) -> int | None:
    """Digits, a Roman numeral to ten or an ordinal in words."""
    if not s:
        return None
    if s in _NUMBERS:
        return _NUMBERS[s]
    s = s.strip()
    n = int(s) if s.isascii() and s[s[:1] in ("+", "-") :].isdigit() and len(s) < 12 else None
    return n if n is not None and -(2**31) <= n < 2**31 else None


@lru_cache(10_000)
def _language(s: str) -> int:
    out = 0
    for w in re.findall(r"[^\W\d_]+", s.lower()):
        out |= _BITS.get(w, 0)
    return out


@lru_cache(10_000)
def _year(s: str) -> int | None:
    m = _YEAR.search(s)
    return int(m[1]) if m else None


@lru_cache(50_000)
def _publisher(s: str) -> str | None:
    return _PUB.sub("", plain_text(s)) or None


def title_form(title: str) -> tuple[str, bool, str | None, str | None]:
    """The title without subtitle, volume and edition; whether it was cut short; what it says of volume and edition."""
    t = plain_text(title)
    if "_" in t or "  " in t or "\t" in t or "\n" in t or "\r" in t:
        t = _BLANKS.sub(" ", t)
    t = t.strip(" ")
    if "pdf" in t or "book" in t or "scan" in t or "epub" in t or "djvu" in t or "mobi" in t or "retail" in t or "ocr" in t:
        t = _MEDIA.sub("", t)
    # the edition goes first, since a volume stands at the end of what is left
    cut, vol, ed = "..." in t or "…" in t, None, None
    if " ed" in t and (m := _ED.search(t)):
        ed = m[1]
        t = _ED.sub(" ", t).strip(" ")
    if ("," in t or "(" in t or "[" in t or " v" in t or "-v" in t or "vol" in t or "bd" in t or "band" in t or "tom" in t or "part" in t or "pt" in t or "book" in t) and (m := _VOL.search(t)):
        if n := _VOL_NUMBER.search(m[0]):
            vol = n[1]
        t = _VOL.sub(" ", t)
    # an article moved to the end falls away; a shortened word loses its stop before stops end the title
    if "," in t:
        t = _ARTICLE.sub("", t)
    if "." in t:
        t = _STOPPED.sub(r"\1", t)
    if ":" in t or ";" in t or "." in t or "…" in t or "(" in t or "[" in t or " -" in t:
        t = _SUBTITLE.sub("", t)
    words = [w for w in _WORD.findall(t) if w not in _SMALL]
    if words:
        words[0] = _SHORT.get(words[0], words[0])
    return " ".join(words), cut, vol, ed


def strings(col: pa.Array) -> list[str | None]:
    """The strings of a column; to_pylist() takes ten times as long."""
    return col.to_numpy(zero_copy_only=False).tolist()


def normal_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (rec, tab, title, people, year, language, pub, volume, edition, hash) as those of FORM."""
    for b in batches:
        rec, tab, title, people, year, language, pub, volume, edition, digest = b.columns
        forms = [title_form(x or "") for x in strings(title)]
        named = [sorted({w for w in _NAME.findall(plain_text(x)) if w not in _NO_NAME}) if x else [] for x in strings(people)]
        low = lambda c: [x and x.strip(" ").lower() for x in strings(c)]
        hashes = [None if x is None else int(x[:16], 16) ^ int(x[16:], 16) for x in map(hash_digits, strings(digest))]
        first = lambda x, y: n if (n := _number(x)) is not None else _number(y)
        cols = [
            rec, tab, pa.array([f[0] for f in forms], pa.string()), pa.array([f[1] for f in forms], pa.bool_()), pa.array([[crc32(w.encode()) >> 1 for w in x] for x in named], pa.list_(pa.int32())),
            pa.array([" ".join(x) for x in named], pa.string()), pa.array([_year(x or "") for x in strings(year)], pa.int32()), pa.array([_language(x or "") for x in strings(language)], pa.int32()),
            pa.array([_publisher(x or "") for x in strings(pub)], pa.string()), pa.array([first(x, f[2]) for x, f in zip(low(volume), forms)], pa.int32()), pa.array([first(x, f[3]) for x, f in zip(low(edition), forms)], pa.int32()),
            pa.array([x if x is None or x < 2**63 else x - 2**64 for x in hashes], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["rec", "tab", "t", "cut", "names", "people", "y", "lang", "pub", "vol", "ed", "hash"])


FORM = "rec string, tab string, t string, cut boolean, names array<int>, people string, y int, lang int, pub string, vol int, ed int, hash long"
