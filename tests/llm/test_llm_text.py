"""Leaks, scanned pages, personal values, matching: brute force, planted cases and bad input."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import contamination as C
from strataloom.llm import matching as M
from strataloom.llm import personal as P
from strataloom.llm import scanned as S
from strataloom.llm.words import words

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "sol", "var", "pid", "gos") for c in ("a", "er", "ing", "ed", "um")]


def texts(seed, n, size):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(size)) for _ in range(n)]


def planted(item, rnd, share=0.5, swaps=0, insert=0):
    w = item.split()
    n = -(-len(w) // 2) if share == 0.5 else int(len(w) * share)
    a = rnd.randrange(len(w) - n + 1)
    part = w[a : a + n]
    for i in rnd.sample(range(n), swaps):
        part[i] = "otherword"
    if insert:
        c = rnd.randrange(4, n - 4)
        part[c:c] = ["filler"] * insert
    return " ".join(part)


def test_words(spark):
    df = spark.createDataFrame([(1, "A <b>Réal‑time</b> vаlue &amp; ﬁn­e CAFÉ"), (2, None), (3, "…")], "k int, t string")
    got = {r.k: r.w for r in df.select("k", words(F.col("t")).alias("w")).collect()}
    assert got == {1: ["a", "real", "time", "value", "fine", "cafe"], 2: None, 3: []}


def test_leaks(spark):
    rnd = random.Random(3)
    items, docs = texts(1, 30, 60), texts(2, 120, 150)
    rows, want = [], set()
    for d, t in enumerate(docs):
        if d % 3 == 0:
            i = d % 30
            part = planted(items[i], rnd, swaps=rnd.randrange(0, 4), insert=rnd.choice((0, 20)))
            w = t.split()
            t = " ".join(w[:70] + [part.upper().replace(" ", " , ", 3)] + w[70:])
            want.add((d, i))
        elif d % 3 == 1:
            # too little of an item, and too many other words
            t = t + " " + planted(items[d % 30], rnd, share=0.3) + " x " + planted(items[(d + 1) % 30], rnd, swaps=15)
        rows.append((d, t, 0))
    rows += [(500, None, 0), (501, "", 0), (502, "x " * 50_000, 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(900, None), (901, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in C.find_leaks(df, it).collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want, (sorted(want - got), sorted(got - want))
    assert C.find_leaks(df.limit(0), it).count() == 0 and C.find_leaks(df, it.limit(0)).count() == 0


PAGE = """THE SEALED VALVE    47
When the valve restarts its subsystem is rebuilt and
bandwidth rarcly returns to normal. With the register
disconnected cheap clones copy the platform of D60X, wha-
tever the staff may claim. The dual-
channel driver drops support for the inte-
THE SEALED VALVE    48
rrupt and nothing else in the register changed at all
because the platform returns whatever the valve may do."""


def page_rows():
    plain = "When the valve restarts its subsystem is rebuilt. Bandwidth rarely returns to normal, whatever the staff may claim. The dual-channel driver drops support for the interrupt."
    return [(i, "t", plain + f" Number {i} stays.", 1) for i in range(60)] + [(100, "The sealed valve", PAGE, 1)]


def test_scanned(spark):
    df = spark.createDataFrame(page_rows() + [(200, None, None, 1), (201, "", "", 1), (202, "x", "y" * 300_000, 1)], "ingest_seq long, title string, body string, k int")
    got = {(r.ingest_seq, r.line_no, r.repaired) for r in S.find_defects(df).collect()}
    assert got == {(100, 0, ""), (100, 2, "rarely"), (100, 3, "whatever"), (100, 4, "dual-channel"), (100, 5, "interrupt"), (100, 6, "")}
    text = {r.ingest_seq: r.repaired for r in S.repair(df).collect()}
    assert "whatever the staff may claim. The dual-channel driver drops support for the interrupt and nothing" in text[100] and "rarely returns" in text[100] and "SEALED" not in text[100]
    assert text[5] == page_rows()[5][2] and text[200] is None and text[201] == ""
    assert S.find_defects(df.limit(0)).count() == 0


def test_furniture():
    lines = ["- 12 -", "LUND  On the valve", "text goes on and on", "- 13 -", "LUND  On the valve", "more of it, and", "12   13   14", "Figure 3. A pump", "p. 14"]
    assert S.furniture(lines, "On the valve") == {0, 1, 3, 4, 8}


PEOPLE = [("Ada", "Lundmark"), ("Bea", "Holtberg"), ("Cyra", "Nessdale"), ("Dora", "Krogvik"), ("Elin", "Varmoor"), ("Finn", "Ostwick"), ("Gerd", "Selholt"), ("Hans", "Jorvane")]


def personal_rows(n=160):
    rnd = random.Random(4)
    rows, want = [], set()
    for k in range(n):
        g, f = rnd.choice(PEOPLE)
        name, mail, phone = f"{g} {f}", f"{g.lower()}.{f.lower()}@torton.example", f"+1 415 555 0{rnd.randrange(100, 200)}"
        home, num = f"{rnd.randrange(1, 99)} Elm Street, Torton", f"9{rnd.randrange(10, 99)}-0{rnd.randrange(1, 9)}-{rnd.randrange(1000, 9999)}"
        parts = [(f"Contact: {name} <{mail}>\n", {("person", name), ("email", mail)}), (f"Questions go to {name} (tel. {phone}). ", {("person", name), ("phone", phone)}), (f"Ship the boards to {home}. ", {("address", home)}), (f"My social security number {num} was in the log. ", {("id_number", num)})]
        noise = [f"Serial number QX-{rnd.randrange(1000, 9999)}-1016 is on the Granite Falls board. ", "Clone git@mirror.example:drivers/x.git first. ", f"Firmware 9.02.{rnd.randrange(1000, 9999)} is signed with key 4611636613. ", "Install it with pip as pkg@0.3.7 on the Marlow Ridge board. ", "See ISBN 978-699-246-944-5 for the tables. "]
        part, true = rnd.choice(parts)
        rows.append((k, rnd.choice(noise) + "The valve was open. " + part + rnd.choice(noise), 1))
        want |= {(k, *v) for v in true}
    return rows, want


def test_personal(spark):
    rows, want = personal_rows()
    df = spark.createDataFrame(rows + [(900, None, 1), (901, "", 1), (902, "word " * 60_000, 1)], "doc_id long, text string, surface int")
    got = {(r.doc_id, s.pii_type, s.surface) for r in P.find_spans(df).collect() for s in r.spans}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want), (sorted(want - got)[:5], sorted(got - want)[:5])
    red = {r.doc_id: r.redacted for r in P.redact(df).collect()}
    assert red[900] is None and red[901] == "" and all(v not in red[k] for k, t, v in got)
    assert P.find_spans(df.limit(0)).count() == 0


def test_spans_do_not_overlap():
    rows = [(0, 10, "a", "x", 0.9), (5, 8, "b", "y", 0.99), (10, 12, "c", "z", 0.6), (10, 12, "d", "z", 0.7)]
    assert P.keep_spans(rows) == [(5, 8, "b", "y", 0.99), (10, 12, "d", "z", 0.7)]
    # of about equal ones the longer
    assert P.keep_spans([(0, 10, "a", "x", 0.9), (5, 8, "b", "y", 0.94)]) == [(0, 10, "a", "x", 0.9)]


def book_tables(spark, n=160):
    rnd = random.Random(8)
    adj, noun, place = ["Sealed", "Thermal", "Hybrid", "Optical", "Linear"], ["Valve", "Sensor", "Gearbox", "Turbine", "Encoder"], ["Harbour", "Foundry", "Tunnel", "Quarry"]
    z, r, li, want = [], [], [], set()
    seen = set()
    for i in range(n):
        t = f"{rnd.choice(adj)} {rnd.choice(noun)} Drift and {rnd.choice(adj)} {rnd.choice(noun)} Control in the {rnd.choice(place)} of {rnd.choice(WORDS)}ton"
        if t in seen:
            continue
        seen.add(t)
        g, f = rnd.choice(PEOPLE)
        y = str(rnd.randrange(1960, 2020))
        h = f"{rnd.getrandbits(128):032x}" if i % 2 else None
        z.append((i, t + ", Vol. 2", f"{g} {f}", "Torton Press", y, "en", h))
        r.append((i, t.replace(" and ", " & ") + " (2)", f"{f}, {g}", "Torton", f"c{y}", "English", h))
        li.append((i, t.upper() + ": a field manual, v. 2", f"{g[0]}. {f}", y, "eng", None, None, None))
        # the next volume of the same work is another book
        li.append((10_000 + i, t, f"{f}, {g}", y, "en", None, "3", None))
        want |= {(f"li:{i}", f"rs:{i}"), (f"li:{i}", f"zl:{i}")} | (set() if h else {(f"rs:{i}", f"zl:{i}")})
    zl = spark.createDataFrame(z, "zlibrary_id long, title string, authors string, publisher string, year string, language string, md5 string")
    rs = spark.createDataFrame(r, "ID long, Title string, Authors string, Publisher string, Year string, Language string, MD5 string")
    ed = spark.createDataFrame(li, "e_id long, title string, authors string, year string, language string, subtitle string, volume string, edition string")
    return ed, rs, zl, want


def test_matching(spark):
    ed, rs, zl, want = book_tables(spark)
    got = {(r.rec_a, r.rec_b): r.confidence for r in M.match(M.books(ed, rs, zl)).collect()}
    assert len(set(got) & want) >= 0.95 * len(want) and len(set(got) - want) <= 0.05 * len(want), (sorted(want - set(got))[:5], sorted(set(got) - want)[:5])
    assert all(0 <= c <= 1 for c in got.values())


def test_matching_edges(spark):
    ed, rs, zl, _ = book_tables(spark, 3)
    blank = zl.limit(1).select("zlibrary_id", *[F.lit(None).cast("string").alias(c) for c in ("title", "authors", "publisher", "year", "language", "md5")])
    assert M.match(M.books(ed.limit(0), rs.limit(0), blank)).count() == 0
    twice = M.match(M.books(ed, rs.unionByName(rs.withColumn("ID", F.col("ID") + 500)), zl)).collect()
    assert {r.rec_b.split(":")[1] for r in twice if r.rec_b.startswith("rs:")} >= {"0", "500"}
