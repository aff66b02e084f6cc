"""Text, number and code expressions, all inside the JVM.

Every function takes and returns columns; null in gives null out unless the docstring says otherwise. Missing text is the
empty string in the reference's model, so callers coalesce first where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Technical acronyms and their long forms.
ACRONYMS = {
    "dma": "direct memory access",
    "i2c": "inter integrated circuit",
    "spi": "serial peripheral interface",
    "gpio": "general purpose input output",
    "rtos": "real time operating system",
    "riscv": "risc v reduced instruction set computer",
    "adc": "analog to digital converter",
    "pwm": "pulse width modulation",
    "uart": "universal asynchronous receiver transmitter",
    "ble": "bluetooth low energy",
    "rrf": "reciprocal rank fusion",
    "soc": "system on chip",
}
# The pattern that flags equations, and the kinds that count as code.
EQUATION = r"(\$[^$]+\$|\\begin\{(equation|align|math)\})"
CODE_KINDS = ("repository", "code")


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Runs of letters and digits, case kept."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def terms(c: Column) -> Column:
    return words(F.lower(c))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def lower_phrase(c: Column, words_: list[str]) -> Column:
    """Whether the words stand next to each other in c, in this order."""
    return F.concat(F.lit(" "), F.array_join(terms(empty(c)), " "), F.lit(" ")).contains(f" {' '.join(words_)} ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sentences(c: Column) -> Column:
    """Sentences of more than 20 characters, blanks collapsed."""
    return F.filter(F.transform(F.split(collapse(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def chunks(c: Column, size: int = 250, overlap: int = 50) -> Column:
    """Overlapping windows of words; those of at most 20 characters are dropped."""
    step = max(1, size - overlap)
    w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")

    def cut(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(step))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, F.lit(size)), " ")), lambda x: F.length(x) > 20)

    # the words are bound once, not split again for each window
    return F.flatten(F.transform(F.array(w), cut))


def grounded(sentence: Column, text: Column) -> Column:
    """Whether two different tokens of the sentence stand in the text."""
    return F.size(F.array_intersect(ascii_tokens(sentence), ascii_tokens(text))) >= 2


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def expand_acronyms(t: Column) -> Column:
    """Terms with the long forms of acronyms added, each word once and only if no equal term is there."""
    table = F.create_map(*[F.lit(x) for k, v in ACRONYMS.items() for x in (k, v)])
    more = F.flatten(F.transform(t, lambda w: F.split(F.coalesce(F.try_element_at(table, F.lower(w)), F.lit("")), " ")))
    return F.concat(t, F.array_distinct(F.filter(more, lambda w: (w != "") & ~F.array_contains(t, w))))


def document_id(source: Column, native: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substr(F.sha1(F.concat(source, F.lit(":"), F.trim(native))), F.lit(1), F.lit(16)))


def lenient_date(c: Column) -> Column:
    """YYYY[-MM[-DD]] at the start; missing parts are 1, an impossible month or day gives 1 January of the year."""
    p = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?"
    part = lambda i: F.regexp_extract(c, p, i)
    y = F.when(part(1).rlike("^(?!0000)"), part(1))
    full = F.concat_ws("-", y, F.when(part(2) == "", "01").otherwise(part(2)), F.when(part(3) == "", "01").otherwise(part(3)))
    return F.when(y != "", F.coalesce(F.try_to_date(full, "yyyy-MM-dd"), F.try_to_date(F.concat(y, F.lit("-01-01")), "yyyy-MM-dd")))


def html_text(html: Column) -> Column:
    """Readable text of a page. Named entities beyond the five of XML, nbsp, copy and middot stay as they are."""
    s = html
    for tag in ("script", "style", "nav", "footer", "header", "svg", "noscript"):
        s = F.regexp_replace(s, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    s = F.regexp_replace(s, r"(?i)</(p|div|li|h[1-6]|section|article|tr)>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", " ")
    s = F.regexp_replace(unescape(s), r"[ \t]+", " ")
    s = F.array_join(F.transform(F.split(s, r"\r?\n"), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def unescape(c: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def html_title(html: Column) -> Column:
    """The title element, else the first h1, else empty."""
    get = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    t = F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), get("title")).otherwise(get("h1"))
    return F.trim(unescape(F.regexp_replace(t, r"<[^>]+>", " ")))


def strip_description(c: Column) -> Column:
    for tag, to in (("</p>", "\n\n"), ("</P>", "\n\n"), ("<br>", "\n"), ("<BR>", "\n")):
        c = F.replace(c, F.lit(tag), F.lit(to))
    return F.regexp_replace(c, "<[^<]+?>", "")


def keep_em(c: Column) -> Column:
    """Markup escaped, but for the em marks of a highlighter."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("&lt;em&gt;", "<em>"), ("&lt;/em&gt;", "</em>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cut_at_word(c: Column, limit: int = 1200) -> Column:
    """At most ``limit`` characters, cut at a blank, with an ellipsis if cut."""
    head = F.substr(c, F.lit(1), F.lit(limit))
    at = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when(F.locate(" ", F.reverse(head)) > 0, F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(cut), F.lit(" …")))


def _weighted(digits: Column, weights: list[int]) -> Column:
    d = lambda i: F.substr(digits, F.lit(i + 1), F.lit(1))
    val = lambda i: F.when(F.upper(d(i)) == "X", 10).otherwise(F.coalesce(d(i).try_cast("int"), F.lit(0)))
    return sum((val(i) * w for i, w in enumerate(weights)), F.lit(0))


def is_isbn10(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{9}[0-9Xx]$") & (_weighted(c, list(range(10, 0, -1))) % 11 == 0), F.lit(False))


def is_isbn13(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{13}$") & (_weighted(c, [1, 3] * 6 + [1]) % 10 == 0), F.lit(False))


def isbn13_of(c: Column) -> Column:
    body = F.concat(F.lit("978"), F.substr(c, F.lit(1), F.lit(9)))
    return F.concat(body, ((10 - _weighted(body, [1, 3] * 6) % 10) % 10).cast("string"))


def isbn10_of(c: Column) -> Column:
    """Ten-digit form; null outside the 978 range, which alone has one."""
    body = F.substr(c, F.lit(4), F.lit(9))
    check = (11 - _weighted(body, list(range(10, 1, -1))) % 11) % 11
    return F.when(F.startswith(c, F.lit("978")), F.concat(body, F.when(check == 10, "X").otherwise(check.cast("string"))))


def all_isbns(candidates: Column) -> Column:
    """Sorted set of the valid numbers among ``candidates`` in both lengths."""
    plain = F.transform(candidates, lambda x: F.regexp_replace(x, "[- ]", ""))
    ten, thirteen = F.filter(plain, is_isbn10), F.filter(plain, is_isbn13)
    both = F.concat(ten, F.transform(ten, isbn13_of), thirteen, F.filter(F.transform(thirteen, isbn10_of), lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(both))


def is_subsequence(needle: Column, haystack: Column) -> Column:
    """Whether the letters of needle stand in haystack in order, whatever their case."""
    n = F.lower(needle)
    at = F.aggregate(
        F.split(F.lower(haystack), ""), F.lit(1), lambda acc, ch: F.when((acc <= F.length(n)) & (F.substr(n, acc, F.lit(1)) == ch) & (ch != ""), acc + 1).otherwise(acc)
    )
    return at > F.length(n)


def field_name(c: Column) -> Column:
    return F.translate(F.lower(c), " -./()", "")


def valid_year(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$") & c.try_cast("int").between(1600, 2099), F.lit(False))


def canonical_md5(c: Column) -> Column:
    """Trimmed lower-case 32 hexadecimal digits, else null."""
    s = F.lower(F.trim(c))
    return F.when(s.rlike("^[0-9a-f]{32}$"), s)


def varia(*parts: Column) -> Column:
    """Non-empty trimmed parts joined by a comma."""
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


# Names and codes of languages, and the code each stands for.
LANGUAGE_NAMES = {
    "english": "en", "eng": "en", "en": "en", "french": "fr", "français": "fr", "fre": "fr", "fra": "fr", "fr": "fr", "german": "de", "deutsch": "de",
    "ger": "de", "deu": "de", "de": "de", "spanish": "es", "español": "es", "spa": "es", "esl": "es", "es": "es", "italian": "it", "ita": "it", "it": "it",
}


def language_codes(c: Column) -> Column:
    """Sorted set of language codes named in a field, split at - _ , ; and /."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    parts = F.transform(F.split(F.lower(c), "[-_,;/]"), lambda w: F.try_element_at(table, F.trim(w)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: w.isNotNull())))


# Frequent words that tell the four languages of the corpus apart.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "nicht", "mit", "wird", "ein", "von", "auf"), "en": ("the", "of", "and", "to", "is", "that", "for", "with", "was", "by"),
    "es": ("el", "los", "las", "que", "del", "una", "por", "con", "se", "no"), "fr": ("le", "les", "des", "que", "du", "une", "pas", "est", "et", "dans"),
}


def detect_language(c: Column) -> Column:
    """The language with most different stop words; ties to the first by code; null if there are none."""
    t = F.array_distinct(terms(c))
    votes = [F.struct(F.size(F.array_intersect(t, F.array(*map(F.lit, ws)))).alias("n"), F.lit(-i).alias("o"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(STOP_WORDS.items())]
    best = F.greatest(*votes)
    return F.when(best["n"] > 0, best["code"])


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector becomes the first unit vector."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0)))


def token_bucket(t: Column, dims: int) -> Column:
    return (F.conv(F.substr(F.md5(t), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % dims).cast("int")


def token_sign(t: Column) -> Column:
    return F.when(F.conv(F.substr(F.md5(t), F.lit(9), F.lit(2)), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)


def saturate(m: Column, k: float = 1.5) -> Column:
    return m / (m + k)
