"""Words of a text without case, punctuation, spacing, markup and look-alike characters, as one column expression."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts and signs that look like a Latin letter or digit (lower case).
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ɑ": "a", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
}
#: Signs inside a word that are no part of it: soft hyphen, joiners, byte-order mark.
INVISIBLE = "­​‌‍⁠﻿᠎"


def _folding() -> tuple[str, str]:
    """Accented and compatibility letters to their plain letter, from the Unicode tables, then the look-alikes."""
    table = {}
    for cp in [*range(0xAA, 0x250), *range(0x1D00, 0x1EFF), *range(0x2070, 0x2190), *range(0x24B6, 0x24EA), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)]:
        ch = chr(cp)
        if cp > 0xFFFF or len(ch.lower()) != 1 or not (ch.isalpha() or ch.isdigit()):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            table[ch.lower()] = plain
    table |= LOOK_ALIKES
    return "".join(table), "".join(table.values())


_FROM, _TO = _folding()


def plain(text: Column) -> Column:
    """Lower case, without tags, entities, accents, look-alikes and invisible signs."""
    s = F.when(text.contains("<"), F.regexp_replace(text, r"</?[A-Za-z][^<>\n]{0,200}>", " ")).otherwise(text)
    s = F.when(s.contains("&"), F.regexp_replace(s, r"&(?:[a-zA-Z]{2,8}|#\d{1,6});", " ")).otherwise(s)
    s = F.lower(s)
    odd = F.octet_length(s) != F.length(s)
    t = F.translate(s, _FROM + INVISIBLE, _TO)
    t = F.replace(F.replace(F.replace(t, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))
    t = F.regexp_replace(t, r"\p{M}", "")
    return F.when(odd, t).otherwise(s)


def words(text: Column) -> Column:
    """Array of words; null for null, empty for a text without letters and digits."""
    return F.array_remove(F.split(plain(text), r"[^\p{L}\p{N}]+"), "")
