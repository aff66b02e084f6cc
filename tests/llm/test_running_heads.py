"""Running heads with a misread letter in each word."""

import random
from difflib import SequenceMatcher

from strataloom.llm import scanned as S


def test_like_with_no_word_in_common():
    assert S._like("vibration damping", "vibrotion dampinq") and S._like("oscillator", "oscillotor")
    assert not S._like("vibration damping", "gear lubrication")


def test_bounds_are_exact():
    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choice("abc d") for _ in range(rnd.randint(1, 20)))
        b = "".join(rnd.choice("abcde ") if rnd.random() < 0.12 else c for c in a)
        assert S._ratio(a, b) == (SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)
