"""Mixed timestamp formats and zones to one unambiguous form, as one cascade of column expressions.

Every format is an anchored pattern that yields the same struct of text parts; the first that matches wins. Then the
parts are checked as a real calendar date and clock time, and the zone is resolved: written offset, abbreviation,
zone name, or the source's default. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as written in English, French, German and Spanish sources.
MONTHS = {
    1: "january jan janvier janv januar jänner enero ene",
    2: "february feb février fevrier févr fev februar febrero",
    3: "march mar mars märz maerz marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juin juni junio",
    7: "july jul juillet juil juli julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct octobre oktober okt octubre",
    11: "november nov novembre noviembre",
    12: "december dec décembre decembre déc dezember dez diciembre dic",
}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Abbreviations that mean something else in some home zones (zone-name prefix, abbreviation, minutes).
LOCAL_ABBREVIATIONS = [
    ("Australia/", "EST", 600), ("Australia/", "EDT", 660), ("Australia/", "CST", 570), ("Australia/", "CDT", 630),
    ("Europe/Dublin", "IST", 60), ("Asia/Jerusalem", "IST", 120), ("Asia/Shanghai", "CST", 480),
    ("Asia/Taipei", "CST", 480), ("Asia/Manila", "PST", 480), ("Asia/Dhaka", "BST", 360),
]

_MON = "(" + "|".join(sorted({m for v in MONTHS.values() for m in v.split()}, key=lambda m: (-len(m), m))) + r")\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_ZONE = r"(?:\s*([a-z]{1,5}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[\[(]?(?:[a-z]+/[a-z_+-]+(?:/[a-z_]+)?|utc|gmt)[\])]?))?"
_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?:\s?(am|pm|a\.m\.|p\.m\.)(?!\w))?(?:\s?(?:uhr|h|hrs))?" + _ZONE
_T = r"(?:,?\s+(?:à|a|um|at|las)?\s*" + _CLOCK + ")?"

#: name, pattern, group numbers of (y, mo, d, h, mi, sec, frac, ampm, zone); 0: absent. Matched on lower case.
FORMATS = [
    ("iso", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[t\s]\s*" + _CLOCK + ")?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,12}))?)?()" + _ZONE + ")?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    ("month_first_name", "^" + _DAY + _MON + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _T + "$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    ("day_first_name", "^" + _DAY + r"(\d{1,2})(?:st|nd|rd|th|er|\.)?(?:\s+de)?[\s-]+" + _MON + r",?(?:\s+de|\s+del)?[\s-]+(\d{4})" + _T + "$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    ("month_name", "^" + _MON + r",?(?:\s+de)?\s+(\d{4})$", (2, 1, 0, 0, 0, 0, 0, 0, 0)),
    ("year_month", r"^(\d{4})[-/](\d{1,2})$", (1, 2, 0, 0, 0, 0, 0, 0, 0)),
    ("month_year", r"^(\d{1,2})[/.](\d{4})$", (2, 1, 0, 0, 0, 0, 0, 0, 0)),
    ("year", r"^(?:c|©|\(c\)|ca\.?|cop\.?|copyright)?\s*[\[(]?\s*(?:c|©)?\s*(\d{4})\s*[\])]?(?:\.0*)?$", (1, 0, 0, 0, 0, 0, 0, 0, 0)),
]
_NUMERIC = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?:,?\s+" + _CLOCK + ")?$"
_ORDINAL = r"^(\d{4})-(\d{3})$"
_WEEK = r"^(\d{4})-?w(\d{2})(?:-?(\d))?$"
_EPOCH = r"^(\d{9,10}|\d{13}|\d{16}|\d{19})$"
_ROMAN = r"^m{1,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"


def _nz(c: Column) -> Column:
    return F.when(c != "", c)


def _parts(s: Column, rx: str, g: tuple[int, ...], year=None) -> Column:
    """The struct of text parts of one format; absent parts are null."""
    names = ("y", "mo", "d", "h", "mi", "sec", "frac", "ampm", "zone")
    return F.struct(*[(_nz(F.regexp_extract(s, rx, i)) if i else F.lit(None).cast("string")).alias(n) for n, i in zip(names, g)])


def _roman(s: Column) -> Column:
    """Value of a numeral already known to be canonical: expand subtractive pairs, then count letters."""
    for pair, plain in (("cm", "dcccc"), ("cd", "cccc"), ("xc", "lxxxx"), ("xl", "xxxx"), ("ix", "viiii"), ("iv", "iiii")):
        s = F.replace(s, F.lit(pair), F.lit(plain))
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    return sum((count(ch) * v for ch, v in (("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5))), count("i"))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _month(c: Column) -> Column:
    """Month number of a numeral or a month name."""
    names = F.create_map(*[F.lit(x) for n, ws in MONTHS.items() for w in ws.split() for x in (w, n)])
    return F.coalesce(_int(c), F.try_element_at(names, c))


def _offset_minutes(zone: Column, home: Column) -> Column:
    """Minutes east of UTC for a written offset or abbreviation (lower case), else null."""
    z = F.regexp_replace(zone, "^(utc|gmt)(?=[+-])", "")
    num = r"^([+-])(\d{1,2}):?(\d{2})?$"
    hh, mm = _int(_nz(F.regexp_extract(z, num, 2))), F.coalesce(_int(_nz(F.regexp_extract(z, num, 3))), F.lit(0))
    written = F.when((hh <= 18) & (mm < 60), (hh * 60 + mm) * F.when(F.startswith(z, F.lit("-")), -1).otherwise(1))
    up = F.upper(F.regexp_replace(z, r"[\[\]()]", ""))
    local = F.coalesce(*[F.when((up == a) & F.startswith(home, F.lit(p)), F.lit(m)) for p, a, m in LOCAL_ABBREVIATIONS])
    general = F.try_element_at(F.create_map(*[F.lit(x) for a, m in ABBREVIATIONS.items() for x in (a, m)]), up)
    return F.coalesce(written, local, general)


def local_to_utc(local: Column, zone: Column, ambiguous: str = "earlier", nonexistent: str = "before") -> Column:
    """A zone-less timestamp read as local to ``zone``, in UTC (also zone-less).

    ambiguous: "earlier" | "later" | "null" instant of a time that occurs twice. nonexistent: a skipped time takes the
    offset "before" the change, or "after" it, or is "null".
    """
    # The JVM reads an overlap with the offset before the change (the earlier instant) and a gap likewise.
    base = F.convert_timezone(zone, F.lit("UTC"), local)
    back = lambda t: F.convert_timezone(F.lit("UTC"), zone, t)
    out = base
    if ambiguous != "earlier":
        shift = [F.when(back(base + F.expr(f"INTERVAL {m} MINUTES")) == local, base + F.expr(f"INTERVAL {m} MINUTES")) for m in (30, 60, 120)]
        out = F.coalesce(*shift, base) if ambiguous == "later" else F.when(F.coalesce(*shift).isNull(), base)
    if nonexistent != "before":
        gap = F.timestamp_diff("MINUTE", local, back(base))
        fixed = base - F.make_dt_interval(mins=gap) if nonexistent == "after" else F.lit(None).cast("timestamp_ntz")
        out = F.when(back(base) == local, out).otherwise(fixed)
    return out


def normalize_timestamp(
    value: Column, home_zone: Column | str = "UTC", day_first: Column | bool = True, ambiguous: str = "earlier", nonexistent: str = "before"
) -> Column:
    """``value`` in one unambiguous form, or null if it denotes no date.

    With a time of day: the UTC instant ``YYYY-MM-DDTHH:MM:SS.ffffffZ``. Otherwise as precise as written: ``YYYY-MM-DD``,
    ``YYYY-MM`` or ``YYYY``. A time without zone is local to ``home_zone``; numeric dates follow ``day_first``. Null,
    empty, "unknown" in any wording, impossible dates and unknown zones give null.
    """
    home = F.coalesce(home_zone if isinstance(home_zone, Column) else F.lit(home_zone), F.lit("UTC"))
    dayf = F.coalesce(day_first if isinstance(day_first, Column) else F.lit(day_first), F.lit(True))
    raw = F.regexp_replace(F.regexp_replace(value, r"[\s   ]+", " "), "^ | $", "")
    s = F.lower(raw)
    null = F.lit(None).cast("string")
    empty = {n: null for n in ("y", "mo", "d", "h", "mi", "sec", "frac", "ampm", "zone")}
    st = lambda **k: F.struct(*[c.cast("string").alias(n) for n, c in (empty | k).items()])

    ep = F.when(F.length(s) <= 10, s.try_cast("bigint")).otherwise(F.substr(s, F.lit(1), F.lit(10)).try_cast("bigint"))
    clock = F.timestamp_seconds(ep)  # split into parts in UTC whatever the session zone is
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), clock.cast("timestamp_ntz"))
    part = lambda f: F.date_part(F.lit(f), utc).cast("int")
    num = lambda i: F.regexp_extract(s, _NUMERIC, i)
    cases = [
        (_EPOCH, st(y=part("YEAR"), mo=part("MONTH"), d=part("DAY"), h=part("HOUR"), mi=part("MINUTE"), sec=part("SECOND"), frac=_nz(F.substr(s, F.lit(11), F.lit(9))), zone=F.lit("utc"))),
        (_NUMERIC, st(y=num(4), mo=F.when(dayf, num(3)).otherwise(num(1)), d=F.when(dayf, num(1)).otherwise(num(3)), h=_nz(num(5)), mi=_nz(num(6)), sec=_nz(num(7)), frac=_nz(num(8)), ampm=_nz(num(9)), zone=_nz(num(10)))),
    ]
    y = lambda rx: F.regexp_extract(s, rx, 1)
    nday = F.regexp_extract(s, _ORDINAL, 2).try_cast("int")
    jan1 = lambda rx: F.to_date(F.concat(y(rx), F.lit("-01-01")))
    odate = F.when((nday >= 1) & (F.year(F.date_add(jan1(_ORDINAL), nday - 1)) == y(_ORDINAL).try_cast("int")), F.date_add(jan1(_ORDINAL), nday - 1))
    cases.append((_ORDINAL, st(y=F.year(odate), mo=F.month(odate), d=F.dayofmonth(odate))))
    # ISO week 1 holds 4 January; Monday is day 1.
    week, dow = F.regexp_extract(s, _WEEK, 2).try_cast("int"), F.regexp_extract(s, _WEEK, 3).try_cast("int")
    jan4 = F.date_add(jan1(_WEEK), 3)
    wdate = F.date_add(jan4, (week - 1) * 7 + F.coalesce(dow, F.lit(1)) - 1 - F.weekday(jan4))
    wdate = F.when((week >= 1) & (F.weekofyear(wdate) == week) & F.coalesce(dow, F.lit(1)).between(1, 7), wdate)
    cases.append((_WEEK, st(y=F.year(wdate), mo=F.month(wdate), d=F.dayofmonth(wdate))))
    cases += [(rx, _parts(s, rx, g)) for _, rx, g in FORMATS]
    cases.append((_ROMAN, st(y=_roman(s))))
    p = F.lit(None)
    for rx, built in reversed(cases):
        p = F.when(s.rlike(rx), built).otherwise(p)
    return _bind(p, lambda q: _render(q, home, ambiguous, nonexistent))


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _render(q: Column, home: Column, ambiguous: str, nonexistent: str) -> Column:
    h0 = _int(q["h"])
    pm, half = F.startswith(q["ampm"], F.lit("p")), q["ampm"].isNotNull()
    h = F.when(~half, h0).when(h0.between(1, 12), h0 % 12 + F.when(pm, 12).otherwise(0))
    numbers = F.struct(_int(q["y"]).alias("y"), _month(q["mo"]).alias("mo"), _int(q["d"]).alias("d"), h.alias("h"), _int(q["mi"]).alias("mi"), F.coalesce(_int(q["sec"]), F.lit(0)).alias("sec"))
    return _bind(numbers, lambda n: _checked(q, n, home, ambiguous, nonexistent))


def _checked(q: Column, n: Column, home: Column, ambiguous: str, nonexistent: str) -> Column:
    y, mo, d = n["y"], n["mo"], n["d"]
    good_y = y.between(1000, 2999)
    good_m = good_y & mo.between(1, 12)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    good_d = good_m & d.between(1, last)
    good_t = good_d & n["h"].between(0, 23) & n["mi"].between(0, 59) & n["sec"].between(0, 59)
    ym = F.concat(_pad(y, 4), F.lit("-"), _pad(mo, 2))
    date = F.concat(ym, F.lit("-"), _pad(d, 2))
    ntz = F.when(good_t, F.make_timestamp_ntz(y, mo, d, n["h"], n["mi"], n["sec"].cast("decimal(8,6)")))
    return (
        F.when(q["h"].isNotNull(), _bind(ntz, lambda t: _instant(q, t, home, ambiguous, nonexistent)))
        .when(q["d"].isNotNull(), F.when(good_d, date))
        .when(q["mo"].isNotNull(), F.when(good_m, ym))
        .when(good_y, _pad(y, 4))
    )


def _instant(q: Column, ntz: Column, home: Column, ambiguous: str, nonexistent: str) -> Column:
    z = q["zone"]
    bare = F.regexp_replace(z, r"[\[\]()]", "")
    named = F.when(bare.contains("/"), F.try_element_at(F.create_map(*[F.lit(x) for z in KNOWN_ZONES for x in (z.lower(), z)]), bare))

    def placed(k: Column) -> Column:
        utc = (
            F.when(z.isNull(), local_to_utc(ntz, home, ambiguous, nonexistent))
            .when(k["minutes"].isNotNull(), ntz - F.make_dt_interval(mins=k["minutes"]))
            .when(k["named"].isNotNull(), local_to_utc(ntz, F.coalesce(k["named"], F.lit("UTC")), ambiguous, nonexistent))
        )
        return _bind(utc.cast("string"), lambda text: F.concat(F.substr(text, F.lit(1), F.lit(10)), F.lit("T"), F.substr(text, F.lit(12), F.lit(8)), F.lit("."), micros, F.lit("Z")))

    micros = F.rpad(F.substr(F.coalesce(q["frac"], F.lit("")), F.lit(1), F.lit(6)), 6, "0")
    return F.when(ntz.isNotNull(), _bind(F.struct(_offset_minutes(z, home).alias("minutes"), named.alias("named")), placed))


def _known_zones() -> list[str]:
    import zoneinfo

    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith("Etc/"))


KNOWN_ZONES = _known_zones()
