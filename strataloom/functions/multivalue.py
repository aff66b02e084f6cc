"""Pure parsing of fields that pack several values: dialects, code lengths and the cheapest parse.

A dialect says whether double quotes group, and which separators may end a value. A parse's description length is the
bits that name the dialect, plus for each value the code length of its shape, -log2 of the shape's share in the corpus.
Shapes are strings over a small alphabet, so the code book stays small however large the corpus is.
"""

from __future__ import annotations

import json
import math
import re
from itertools import product

SUFFIX = re.compile(r"(?:jr|sr|ph\.? ?d|m\.?d|esq|ii|iii|iv)\.?", re.I)
#: Bits of a shape that the corpus never shows, and bits more for each of its symbols.
UNSEEN, PER_SYMBOL = 14.0, 3.0
#: Bits of a value that is none by itself.
ALONE = 100.0

_PEOPLE_SEP = re.compile(r"\s*(?:(?P<strong>[;|\t\n\r]+(?:\s*[;|\t\n\r]+)*|\s/\s|/)|(?P<comma>,(?:\s*,)*)|(?P<conj>\s(?:and|und|et|y)\s|\s?&\s?))\s*")
_CODE_SEP = re.compile(r"\s*(?:(?P<strong>[;|\t\n\r/]+(?:\s*[;|\t\n\r/]+)*)|(?P<comma>,(?:\s*,)*))\s*|(?P<conj>\s+)")
#: What any field of two values holds, in the JVM's syntax: a separator of either kind of value.
SEPARATED = r"[;|,/&\s\u0085\p{Z}\[]"
_WORD = re.compile(r"\([^)]*\)|\[[^\]]*\]|[^\W\d_](?:\.-?[^\W\d_])*\.(?=\s|,|$)|[\w'’.\-]+|[^\w\s]")
_SMALL = {"of", "for", "the", "and", "und", "et", "y", "de", "des", "du", "für", "del", "la"}
_FIRM = {"ltd", "inc", "gmbh", "co", "llc", "corp", "plc", "sons", "group"}


def person_shape(v: str) -> str:
    """W word, I initial, R role in brackets, J suffix, F firm word, o small word; other signs as they are."""
    out = []
    for m in _WORD.findall(re.sub(r"[\t\r\n]+", " ¶ ", v)):
        low = m.lower().strip(".")
        if m[0] in "([":
            out.append("R")
        elif SUFFIX.fullmatch(m):
            out.append("J")
        elif low in _FIRM:
            out.append("F")
        elif m in _SMALL:
            out.append("o")
        elif low in ("al",):
            out.append("e")
        elif m.endswith(".") and len(low) == 1 or len(low) == 1 and low.isalpha() or re.fullmatch(r"(?:[^\W\d_]\.-?)+", m):
            out.append("I")
        elif m[0].isalnum():
            out.append("W")
        else:
            out.append(m)
    return re.sub(r"I{2,}", "I", re.sub(r"W{4,}", "WWWW", "".join(out)))


def code_digits(v: str) -> str:
    v = re.sub(r"(?i)isbn(?:[-\s]?1[03])?(?![\dx])\s*:?", " ", v)
    return re.sub(r"[^0-9X]", "", re.sub(r"\([^)]*\)", " ", v).upper())


def isbn_ok(d: str) -> bool:
    if re.fullmatch(r"\d{9}[\dX]", d):
        return sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(d)) % 11 == 0
    if re.fullmatch(r"\d{13}", d):
        return sum((1, 3)[i % 2] * int(c) for i, c in enumerate(d)) % 10 == 0
    return False


def code_shape(v: str) -> str:
    """Number of digits, whether the check digit agrees, and v if letters other than a label or a note remain."""
    d = code_digits(v)
    rest = re.sub(r"(?i)isbn(?:[-\s]?1[03])?(?![\dx])|\([^)]*\)|[\dx\s.:\-]", "", v)
    return f"{len(d)}{'+' if isbn_ok(d) else '-'}{'v' if rest else ''}"


SHAPES = {"people": (person_shape, _PEOPLE_SEP), "code": (code_shape, _CODE_SEP)}


def _unquote(v: str) -> str:
    v = v.strip().strip(";|,/").strip()
    while len(v) > 1 and v[0] == v[-1] == '"':
        v = v[1:-1].strip()
    return v.strip('"').strip()


def _pieces(text: str, sep: re.Pattern, quoted: bool) -> list[tuple[str, str, str]]:
    """(piece, kind of the separator before it, that separator); separators inside quotes do not count if quoted."""
    spans = [m.span() for m in re.finditer(r'"[^"]*"', text)] if quoted else []
    out, at, kind, raw = [], 0, "", ""
    for m in sep.finditer(text):
        if any(a <= m.start() and m.end() <= b for a, b in spans) or m.start() == m.end():
            continue
        out.append((text[at : m.start()], kind, raw))
        at, kind, raw = m.end(), m.lastgroup, m.group()
    out.append((text[at:], kind, raw))
    return out


def as_list(text: str) -> list[str] | None:
    if text[:1] == "[" and text[-1:] == "]":
        try:
            got = json.loads(text)
        except ValueError:
            return None
        if isinstance(got, list) and all(isinstance(x, str) for x in got):
            return [x.strip() for x in got if x.strip()]
    return None


def strong_values(text: str | None, kind: str) -> list[str]:
    """Values of a field whose reading is beyond doubt (a list literal or strong separators): they make the code book."""
    text = (text or "").strip()
    if (got := as_list(text)) is not None:
        return got
    parts, cur = [], ""
    for p, k, raw in _pieces(text, SHAPES[kind][1], True):
        if k == "strong":
            parts.append(cur)
            cur = p
        else:
            cur = cur + raw + p
    parts.append(cur)
    parts = [x for x in map(_unquote, parts) if x]
    return parts if len(parts) > 1 else []


def code_book(counts: dict[str, int]) -> dict[str, float]:
    """Code lengths. A shape that merely strings commoner shapes together at separators earns no code of its own."""

    def strung(s: str, n: int) -> bool:
        for sep in ("[&o]", "[,&o]"):
            parts = re.split(sep, s)
            if len(parts) > 1 and all(counts.get(p, 0) >= 2 * n for p in parts):
                return True
        return False

    counts = {s: n for s, n in counts.items() if not strung(s, n)}
    total = sum(counts.values()) or 1
    return {s: -math.log2(n / total) for s, n in counts.items()}


def most_pieces(book: dict[str, float]) -> int:
    """Pieces between separators that a value may consist of: as many as any value of the corpus, and twelve at least."""
    return max(12, *(1 + len(re.findall(r"[,&o;/|¶]", s)) for s in book), 0)


def parse(text: str | None, kind: str, book: dict[str, float], memo: dict[str, float] | None = None, pieces_at_most: int | None = None) -> list[str]:
    """Values of the cheapest dialect, in order. Null, empty and separator-only fields give an empty list.

    memo keeps the code lengths of values from call to call; pieces_at_most: as most_pieces() of the book.
    """
    text = (text or "").strip()
    if not text:
        return []
    if (got := as_list(text)) is not None:
        return got
    shape, sep = SHAPES[kind]
    memo = {} if memo is None else memo
    span = pieces_at_most or most_pieces(book)

    def bits(v: str) -> float:
        if v not in memo:
            s = shape(v)
            # a suffix or role never begins a value, nor does a firm word make one
            alone = kind == "people" and (s[:1] in ("J", "R") or not set(s) - set("JRFe,&."))
            memo[v] = ALONE if alone else book.get(s, UNSEEN + PER_SYMBOL * len(s))
        return memo[v]

    best: tuple[float, list[str]] | None = None
    for quoted in (True, False) if '"' in text else (False,):
        pieces = [p for p in _pieces(text, sep, quoted)]
        kinds = sorted({k for _, k, _ in pieces if k})
        for allowed in product(*[((k, None)) for k in kinds]):
            cut = {k for k in allowed if k}
            # join what this dialect keeps together, then find the cheapest segmentation at its separators
            atoms: list[list[tuple[str, str]]] = [[]]
            for p, k, raw in pieces:
                if k and "strong" in cut and k == "strong":
                    atoms.append([])
                atoms[-1].append((p, raw if k and k != "strong" or k and "strong" not in cut else "", k))  # type: ignore[arg-type]
            values, cost = [], 2.0 * len(cut) + (1.0 if quoted else 0.0)
            for chunk in atoms:
                c, vs = _segment(chunk, cut, bits, span)
                cost += c
                values += vs
            if values and (best is None or cost < best[0] - 1e-9):
                best = (cost, values)
    return best[1] if best else []


def _segment(chunk: list, cut: set[str], bits, span: int) -> tuple[float, list[str]]:
    n = len(chunk)
    cost: list[float] = [0.0] + [math.inf] * n
    back = [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - span), j):
            if cost[i] == math.inf or i and chunk[i][2] not in cut:
                continue
            v = _unquote(chunk[i][0] + "".join(r + p for p, r, _ in chunk[i + 1 : j]))
            c = cost[i] + (bits(v) if v else 0.0)
            if c < cost[j] - 1e-9:
                cost[j], back[j] = c, i
    if cost[n] == math.inf:  # more pieces than a value has, which nothing may separate
        v = _unquote(chunk[0][0] + "".join(r + p for p, r, _ in chunk[1:]))
        return bits(v), [v] if v else []
    out, j = [], n
    while j:
        i = back[j]
        out.append(_unquote(chunk[i][0] + "".join(r + p for p, r, _ in chunk[i + 1 : j])))
        j = i
    return cost[n], [v for v in reversed(out) if v]
