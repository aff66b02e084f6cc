"""Personal values beyond the wording that labels them: other alphabets, check digits, unseen sentences, thresholds."""

import random

import numpy as np
import pytest

from strataloom.llm import personal as P
from strataloom.llm.learn import Boosted, best_threshold


@pytest.mark.parametrize("name", ["Nguyễn Văn An", "Ivan Петров", "Ελένη Παπαδοπούλου", "李明", "Łucja Żak", "Jo\u0308rg Weiß", "Maximiliana Konstantinopolitanowna Abcdefghijklmnopqrstuvwxyzabcdefgh"])
def test_every_alphabet_is_proposed(name):
    got = [(r[0], r[3]) for r in P.propose(f"we met {name}, who left early.")]
    assert ("person", name) in got


def test_check_digits():
    assert P.proven("DE89 3704 0044 0532 0130 00") and not P.proven("DE88 3704 0044 0532 0130 00")
    assert P.proven("12345678Z") and P.proven("X1234567L") and not P.proven("12345678A")
    key = 97 - 2850699123456 % 97
    assert P.proven(f"2850699123456{key:02d}") and not P.proven(f"2850699123456{(key + 1) % 97:02d}")
    assert not P.proven("") and not P.proven("no digits")


def test_threshold_of_a_type():
    assert best_threshold(np.array([0.1, 0.35, 0.4, 0.9]), np.array([0, 1, 1, 1.0])) == pytest.approx(0.35)
    assert best_threshold(np.array([0.1, 0.9]), np.array([0, 1.0])) == pytest.approx(0.5)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    m = Boosted().fit(x, y)
    p = m.prob(x)
    for lo in (0.1, 0.3, 0.5, 0.7):
        at = (p >= lo) & (p < lo + 0.2)
        assert abs(p[at].mean() - y[at].mean()) < 0.08
    assert 0.2 <= m.threshold <= 0.8


def test_wording_never_seen(spark):
    """Names learnt where a label names them are found in sentences that no label covers; other capitals are not."""
    rnd = random.Random(5)
    given = [a + b for a in ("Al", "Bre", "Cor", "Den", "El") for b in ("an", "mir", "tha", "wyn")]
    family = [a + b for a in ("Holt", "Mar", "Quin", "Thorn") for b in ("berg", "ley", "wick", "sen")]
    rows, want, no = [], set(), set()
    for i in range(900):
        n = f"{rnd.choice(given)} {rnd.choice(family)}"
        thing = f"{rnd.choice(('Thermal', 'Hybrid', 'Optical'))} {rnd.choice(('Valve', 'Sensor', 'Encoder'))}"
        if i % 3 == 0:
            rows.append((i, f"All parts passed. Contact: {n}. We replaced the {thing} twice."))
        elif i % 3 == 1:
            rows.append((i, f"It was late when {n} had inspected everything again, and nobody objected."))
            want.add((i, n))
        else:
            rows.append((i, f"Every {thing} drifts a little, which the {thing} log confirms."))
            no.add((i, thing))
    got = {(r.doc_id, s.surface) for r in P.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans}
    assert len(got & want) >= 0.9 * len(want), sorted(want - got)[:5]
    assert len(got & no) <= 0.02 * len(no)
