"""Personal information in free text: found by generous generators, kept by boosted trees, replaced by placeholders.

1. Generators propose spans of five types, overlapping and too many, with features of their form and surroundings.
2. How often each word stands where only a name can stand is counted over all texts.
3. Trees for each type are trained on a bounded sample of candidates labelled by wording around them ("Contact:",
   "serial number"). Half of the training rows hide that wording, so form and counts must carry the decision.
4. Candidates of calibrated probability above the threshold of their type stay; of overlapping ones the likelier.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, materialize
from .learn import Boosted

TYPES = ("email", "phone", "id_number", "address", "person")
#: Labelled candidates of a type that its trees see at most.
SAMPLE = 20_000
#: Parts of a hash by which the sample is drawn.
GRAIN = 1_000_003
#: Words with counts that are broadcast at most; beyond it they are joined by shuffle.
MAX_WORDS = 100_000



def _letters(category: str) -> str:
    """The letters of a Unicode category in the scripts that have case (Latin, Greek, Cyrillic, Armenian), as a class."""
    cps = [c for a, b in ((0x41, 0x588), (0x1E00, 0x2000)) for c in range(a, b) if unicodedata.category(chr(c)) == category]
    runs = [[cps[0], cps[0]]]
    for c in cps[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


# combining marks stand inside words that are not in composed form
_U, _L = _letters("Lu"), _letters("Ll") + "\u0300-\u036f"
_HAN = "\u4e00-\u9fff"
_W = rf"[{_U}][{_L}'’]+(?:-[{_U}]?[{_L}]+)*"
_C = rf"[{_U}]{{2,}}(?:-[{_U}]{{2,}})*"
_I = rf"[{_U}]\."
_TOWN = rf"(?:{_W}|{_C})(?:[ -](?:{_W}|[{_U}]{{3,}}))?"
_POST = r"(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{5}(?:-\d{4})?)"
_ST = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Way|Close|Place|Pl|Square|Sq|Terrace|Crescent|Hill|Row|Gardens|Park|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|COURT|DRIVE)\b\.?"
_FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|FLAT|APT)\.? ?\d+[A-Za-z]?,? )"
_N = rf"(?:{_W}|{_C})(?: (?:{_W}|{_C})){{0,2}}"
_FLOOR = r"(?:, ?(?:\d+ ?\.?[ºªo°]\.?(?: ?[A-Z]\b| izq\.?| dcha\.?)?|bajo|piso \d+|esc\. ?\w+|\d+\. OG|App\. ?\d+|apt\. ?\d+))*"
GENERATORS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+(?:(?:@| ?[\[(] ?(?:at|AT|At|@|arroba) ?[\])] ?)[\w-]+(?:(?:\.| ?[\[(] ?(?:dot|DOT|punto) ?[\])] ?| (?:dot|DOT) )[\w-]+)*| (?:at|AT) [\w-]+(?:(?:\.| (?:dot|DOT) )[\w-]+)+)"),
    "phone": re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(0?\d{0,4}\)[ .-]?)?\d{1,5}(?:(?: / |[ ./-])\d{1,9}){0,6}(?![\w])"),
    "id_number": re.compile(r"(?<![\w.+-])(?!ID\b|No\b|NO\b|IP\b)(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[12 0] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|\d{13,15}|[A-Z]{1,2}[ -]?\d{6,9}(?:[ -]?[A-Z])?|\d{8}[- ]?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\w])(?!-\d)"),
    "address": re.compile(
        rf"(?<![\w])(?:{_FLAT}?\d{{1,4}}[a-z]?,? {_N} {_ST}(?:,? (?:Apt|Unit|Suite|Flat|APT)\.? ?\d+)?,? {_TOWN}(?:,? {_POST})?"
        rf"|(?:P\. ?O\. ?|PO |P\.O\.|p\.o\. )(?:Box|BOX|box) \d+,? {_TOWN}(?:,? {_POST})?|(?:Postfach|Apartado(?: de Correos)?|B\. ?P\.|BP) \d+,? (?:{_POST} )?{_TOWN}"
        rf"|(?:Calle|C/|C/ ?|Avenida|Avda\.?|Plaza|Paseo|Camino|CALLE|AVENIDA) ?(?:de (?:la |los |las )?|del )?{_N},? (?:n\.?º ?)?\d+{_FLOOR},? {_POST} {_TOWN}"
        rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|impasse|boulevard|place|chemin|allée|quai|route|Rue|Avenue|RUE|AVENUE|IMPASSE) (?:de (?:la |l'|l’)?|du |des )?{_N}{_FLOOR},? {_POST} {_TOWN}"
        rf"|(?:[{_U}][{_L}-]*(?:straße|strasse|str\.|allee|weg|platz|gasse|ufer|ring|damm)|[{_U}]+(?:STRASSE|STR\.|ALLEE|WEG|PLATZ|GASSE)|{_W} (?:Straße|Allee|Weg|Platz|Gasse|Str\.)) \d+ ?[a-z]?\b{_FLOOR},? {_POST} {_TOWN})"
    ),
    "person": re.compile(rf"(?<![\w@.'’-])(?:(?:{_W}|{_I})(?: (?:{_W}|{_I})){{0,2}} {_W}|{_W}, (?:{_W}|{_I})(?: (?:{_W}|{_I}))?|(?:{_C}|{_I})(?: (?:{_C}|{_I})){{0,2}} {_C}|{_C}, (?:{_C}|{_I})(?: (?:{_C}|{_I}))?)(?![\w@'’])|(?<![{_HAN}])[{_HAN}]{{2,4}}(?![{_HAN}])"),
}
# Common labels before a value that tell what it is, or that it is no personal value.
CUES = {
    "email": (r"(?:\b(?:contact\w*|e-?mail\w*|mail|write to|reach|kontakt|schreib\w*|écri\w+|contacto|escrib\w+|correo)\b|mailto:|\bmail=)[^\n]{0,60}$", r"\b(?:clone|install|pip|make|ssh|scp|rsync|git|pkg|host|server)\b[^\n]{0,30}$"),
    "phone": (r"(?:\b(?:tel|phone|telephone|mobile|cell|fax|téléphone|portable|telefon|handy|teléfono|móvil|(?<!serial )(?<!part )(?<!order )(?<!security )number)\b|\b(?:call|dial|reach|ring|appel\w+|anruf\w*|rufen|llam\w+)(?: \w+)?(?: on| at| under| au| unter| al| a)?|\b(?:call|appel\w+|anruf\w*|llam\w+) [^\n.:;]{3,60} (?:on|at|au|unter|al))[^\w\n]{0,5}$", r"\b(?:serial(?: number)?|key|code|isbn|issn|doi|address|port|firmware|figure|table|section|version|order|part|ref\w*|invoice|account|id|id number|security number|passport\w*|document\w*|ausweis\w*|numéro)\W{0,3}$"),
    "id_number": (r"\b(?:security number|passport\w*|pass(?: |-)?(?:nummer|nr)|id|id number|identity \w+|national \w+|tax \w+|licen[cs]e\w*|ssn|nino|nif|dni|nie|nir|iban|badge|payroll \w+|documento|document|ausweis\w*|numéro|matricule)\W{0,4}$", r"\b(?:serial(?: number)?|key|code|isbn|issn|doi|address|port|firmware|order|part|version|tel|phone|call|dial|fax|mobile)\W{0,3}$"),
    "address": (r"(?:\b(?:to|at|address|post|mail|home|live\w*|vers|à|adresse|chez|an|in|a|en|dirección|domicilio)|[:=,\n])\s*$", r"\b(?:see|section|figure|table|step)\s*$"),
    "person": (r"(?:\b(?:contact|contacto|kontakt|ansprechpartner(?:in)?|author|owner|maintainer|name|by|from|attn|signed|nombre|nom|autor|auteur)\b\W{1,4}|\w-by: |\bname(?: is|=)\s?|\b(?:signed|written|reported|approved|reviewed) by (?:\w+\. )?|\b(?:Dr|Prof|Mr|Mrs|Ms|Herrn?|Frau|Mme|Sra?|Don|Doña)\b\.? |(?:^|\n)-- ?\n)$", r"\b(?:on the|of the|the|in|der|die|das|des|la|le|el|serial|bus|set|load|see|section)\s*$"),
}
_POS = {t: re.compile(p, re.I) for t, (p, _) in CUES.items()}
_NEG = {t: re.compile(n, re.I) for t, (_, n) in CUES.items()}
_TITLE = re.compile(r"^(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|M|Sr|Sra|Don|Doña|DR|PROF|MR|MRS)\.? ")
#: First words of sentences and labels that run into a capitalised word.
_OPENERS = set("As The By Dr Contact Phone Note See My Reported Signed Clone Please Questions Selon Según Wie Laut Das Der Die Den Dem Ein Eine Ohne Nach Für Im Wenn Bei Zusammengefasst Le La Les Un Une El Los Las En Si Nos Se Il Par Après Constat Remarque Observación Nota Hinweis Anmerkung Beobachtung Ship Reach Run Install Bus Serial Payroll Order Part Firmware Figure Table Section Set Version Access Keywords Street".split())
FEATURES = 16


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _shape_ok(t: str, s: str) -> bool:
    if t == "phone":
        return 8 <= _digits(s) <= 14 and not re.search(r"\d{4}-\d\d-\d\d|^\d+(?:\.\d+)?$" if not re.fullmatch(r"0?\d{9,11}|\d{9}", s) else r"^$", s)
    if t == "email":
        return "@" not in s or bool(re.search(r"@[^@]*[A-Za-z]", s))
    if t == "person":
        first = re.split(r"[ ,]", s)[0]
        return first not in _OPENERS and not first.rstrip(".") in _OPENERS
    return True


def propose(text: str) -> list[tuple]:
    """(type, start, end, surface, cue, against, features) of every candidate span."""
    out: list[tuple] = []
    for t, rx in GENERATORS.items():
        at = 0
        while m := rx.search(text, at):
            at = m.end()
            a, b = m.span()
            s = m.group()
            if t == "person":
                # labels and titles that the pattern took for a given name
                while (w := _TITLE.match(s)) or (s.split(" ")[0].rstrip(",") in _OPENERS and " " in s):
                    cut = w.end() if w else len(s.split(" ")[0]) + 1
                    s, a = s[cut:], a + cut
                if s[0] < "\u4e00" and not re.search(r"[ ,]", s) or not rx.fullmatch(s):
                    at = max(a, m.start() + 1) if s != m.group() and a < m.end() else m.end()
                    continue
            if t == "phone":
                s = s.rstrip(" ./-")
                if s.startswith("(") and ")" not in s:
                    s, a = s[1:], a + 1
                b = a + len(s)
            if t == "email":
                s = s.rstrip(".-_+")
                b = a + len(s)
            if not _shape_ok(t, s):
                continue
            out.append((t, a, b, s))
    rows = []
    for t, a, b, s in out:
        before, after = text[max(0, a - 80) : a], text[b : b + 30]
        pos, neg = bool(_POS[t].search(before)), bool(_NEG[t].search(before))
        # what stands after a value may label it, and a number may prove itself
        if t == "person" and re.match(r" *<[^>\s]+@| ?\((?:tel|mail|e-?mail)|[,;] ?(?:tel|mail|e-?mail|ID)\b| (?:said|says|noted|wrote|writes|reported|explained|added|argued|sagte|schrieb|erklärte|meinte|bemerkte|dit|écrit|explique|dijo|escribió|explicó)\b", after):
            pos = True
        if t == "phone" and re.match(r"\+[1-9]", s) or t == "id_number" and proven(s):
            pos, neg = True, False
        if t == "email":
            pos = pos or before.endswith(("<", "mailto:"))
            neg = neg or not re.search(r"(?:\.|dot|punto)[^\w]*[A-Za-z]{2,}$", s) or bool(re.match(r":\S|[:~]", after)) or bool(re.match(r"(?:git|node|pkg|no-?reply|ci|bot|build|root|admin|ftp|svn)\W", s, re.I))
        near = sum(1 for u, c, d, _ in out if u != t and u != "person" and (0 <= c - b < 60 or 0 <= a - d < 60))
        whole = text[max(0, a - 1) : a]
        f = [
            _digits(s), len(s), s.count(" "), s.count("-"), s.count("."), s.count(","), float(s.upper() == s), float("+" in s or "(" in s),
            float(bool(re.search(rf"(?:^|[ ,]){_I}", s))), float(whole in "\"=:<(" and whole != ""), float(bool(re.match(r"[\s]*[(<,;\"]", after))),
            float(bool(re.match(rf" [{_L}]", after))), float(not before.strip() or before.rstrip()[-1:] in ".!?:\n"), float(near),
            float(s[:1].isdigit()), float(s[-1:].isalpha()),
        ]
        rows.append((t, a, b, s, pos, neg, f))
    return rows


def proven(s: str) -> bool:
    """Whether the check digits of an account, identity or tax number agree (IBAN, NIR, DNI, NIE)."""
    v = re.sub(r"[^0-9A-Z]", "", s.upper())
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", v):
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    if re.fullmatch(r"[12]\d{14}", v):
        return 97 - int(v[:13]) % 97 == int(v[13:])
    if m := re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", v):
        return len(m[1]) + len(m[2]) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(str("XYZ".find(m[1])) * (m[1] != "") + m[2]) % 23] == m[3]
    return False


def name_parts(s: str) -> tuple[str, str]:
    """Given and family name as counted: lower case, without initials."""
    if s and s[0] >= "\u4e00" and s[0] <= "\u9fff":
        return s[1:], s[:1]
    if "," in s:
        fam, given = s.split(",", 1)
        given = given.split()[0] if given.split() else ""
    else:
        w = s.split(" ")
        given, fam = w[0], w[-1]
    return ("" if len(given) <= 2 else given.lower()), fam.lower().strip()


def _matrix(b: pd.DataFrame, hide: bool) -> np.ndarray:
    f = np.stack(b["f"].to_numpy()) if len(b) else np.zeros((0, FEATURES))
    cue, against = b["pos"].to_numpy(float), b["neg"].to_numpy(float)
    if hide:
        shown = (np.arange(len(b)) // 2) % 2 == 0
        cue, against = cue * shown, against * shown
    # counts leave out the candidate's own occurrence, so that training sees what a new text would
    own = b["pos"].to_numpy(float)
    odds = []
    for p in ("g", "l"):
        strong, total = b[f"{p}s"].fillna(0).to_numpy(float), b[f"{p}n"].fillna(0).to_numpy(float)
        odds += [np.log((np.maximum(strong - own, 0) + 0.05) / (np.maximum(total - 1, 0) + 1.0)), np.log1p(np.maximum(total - 1, 0))]
    return np.column_stack([f, cue, against, *odds])


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every candidate span with its features and the counts of its words as names, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, s in zip(b["k"], b["t"]):
                for t, a, e, v, pos, neg, f in propose(s):
                    g, fam = name_parts(v) if t == "person" else ("", "")
                    rows.append((k, t, a, e, v, pos, neg, f, g, fam))
            yield pd.DataFrame(rows, columns=["k", "pii_type", "start", "stop", "surface", "pos", "neg", "f", "given", "family"])

    schema = "k long, pii_type string, start int, stop int, surface string, pos boolean, neg boolean, f array<float>, given string, family string"
    raw = materialize(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("length(t) > 0").mapInPandas(run, schema))
    people = raw.where("pii_type = 'person'")
    strong = (F.col("pos") & ~F.col("neg")).cast("long")
    count = lambda c: people.where(F.col(c) != "").groupBy(c).agg(F.sum(strong).alias("s"), F.count("*").alias("n")).where("s > 0")
    g = count("given").select("given", F.col("s").alias("gs"), F.col("n").alias("gn"))
    fam = count("family").select("family", F.col("s").alias("ls"), F.col("n").alias("ln"))
    # only names are joined: other types have no words, and would all meet in one key
    named = people.join(bounded_broadcast(g, MAX_WORDS), "given", "left").join(bounded_broadcast(fam, MAX_WORDS), "family", "left")
    rest = raw.where("pii_type != 'person'").select("*", *[F.lit(None).cast("long").alias(c) for c in ("gs", "gn", "ls", "ln")])
    return materialize(named.unionByName(rest))


def train(cand: DataFrame, sample: int = SAMPLE) -> dict[str, Boosted]:
    """Trees of each type from at most ``sample`` labelled candidates, drawn by hash of their place."""
    label = F.when(F.col("pos") & ~F.col("neg"), 1).when(F.col("neg") & ~F.col("pos"), 0)
    # a capitalised pair that never stands where a name must, in words seen often, is no name
    unnamed = (F.col("pii_type") == "person") & ~F.col("pos") & F.col("gs").isNull() & F.col("ls").isNull()
    rows = cand.withColumn("y", F.when(unnamed, 0).otherwise(label)).where(F.col("y").isNotNull()).withColumn("h", F.pmod(F.xxhash64("k", "start", "pii_type"), F.lit(GRAIN)))
    have = {r["pii_type"]: r["n"] for r in rows.groupBy("pii_type").agg(F.count("*").alias("n")).collect()}
    # one pass for all types; the executors thin the rows out before any is sent on
    share = F.create_map(*[F.lit(x) for t in TYPES for x in (t, int(GRAIN * min(1.0, 1.1 * sample / max(have.get(t, 0), 1) + 1e-4)))])
    drawn = rows.where(F.col("h") <= F.element_at(share, F.col("pii_type"))).toPandas().sort_values(["h", "k", "start"])
    models = {}
    for t in TYPES:
        b = drawn[drawn["pii_type"] == t].head(sample)
        if len(b) >= 20 and 0 < b["y"].mean() < 1:
            models[t] = Boosted().fit(_matrix(b, True), b["y"].to_numpy(float))
    return models


def keep_spans(rows: list[tuple[int, int, str, str, float]]) -> list[tuple[int, int, str, str, float]]:
    """Of overlapping spans the likelier (to a tenth), then the longer, then the earlier."""
    out: list[tuple[int, int, str, str, float]] = []
    for r in sorted(rows, key=lambda r: (-round(r[4], 1), r[0] - r[1], -r[4], r[0], r[2])):
        if all(r[1] <= o[0] or o[1] <= r[0] for o in out):
            out.append(r)
    return sorted(out)


def _scored(cand: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # a type of which too few could be labelled goes by form, unless wording speaks against it
            p = np.where(b["neg"].to_numpy(bool) & ~b["pos"].to_numpy(bool), 0.1, 0.9)
            least = np.full(len(b), 0.5)
            for t, m in models.items():
                at = np.flatnonzero((b["pii_type"] == t).to_numpy())
                if len(at):
                    p[at] = m.prob(_matrix(b.iloc[at], False))
                    least[at] = m.threshold
            got = b.assign(p=p)[["k", "start", "stop", "pii_type", "surface", "p"]]
            yield got[p >= least]

    return cand.mapInPandas(run, "k long, start int, stop int, pii_type string, surface string, p double")


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, spans): for each text with personal values its spans (start, stop, pii_type, surface, p), none overlapping.

    Positions count characters. Each type has the threshold that was best on labelled candidates its trees had not seen.
    Null and empty texts have no spans; where too few candidates can be labelled to train a type, form decides unless
    wording speaks against it; an empty table gives an empty result; other columns are never read.
    """
    cand = candidates(docs, key, text)
    scored = _scored(cand, train(cand, sample))
    best = F.udf(lambda s: keep_spans([tuple(x) for x in s]), "array<struct<start:int,stop:int,pii_type:string,surface:string,p:double>>", useArrow=True)
    return scored.groupBy("k").agg(F.collect_list(F.struct("start", "stop", "pii_type", "surface", "p")).alias("s")).select(F.col("k").alias(key), best("s").alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "redacted", **how) -> DataFrame:
    """(key, out): every text with typed placeholders, [EMAIL] and so on, in place of its personal values; null stays null."""
    spans = find_spans(docs, key, text, **how)
    rows = docs.select(F.col(key), F.col(text).alias("__t")).join(spans, key, "left")

    def cut(t, spans):
        if t is None or spans is None:
            return t
        for s in sorted(spans, key=lambda s: -s["start"]):
            t = t[: s["start"]] + f"[{s['pii_type'].upper()}]" + t[s["stop"] :]
        return t

    return rows.select(key, F.udf(cut, "string", useArrow=True)("__t", "spans").alias(out))
