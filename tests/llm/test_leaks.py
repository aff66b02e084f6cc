"""Leak search against an independent brute force, over item lengths, insertions, edits and clean texts."""

import numpy as np
import pytest

from strataloom.llm import contamination as C


def brute(item, text):
    """The definition, start by start: row by row edit distances with one free insertion."""
    n, m = len(item), len(text)
    half = (n + 1) // 2
    for a in range(n - half + 1):
        d0, d1 = [0] * (m + 1), [0] * (m + 1)
        for i in range(a, n):
            e0, e1 = [d0[0] + 1], [d1[0] + 1]
            for j in range(1, m + 1):
                e0.append(min(d0[j - 1] + (item[i] != text[j - 1]), d0[j] + 1, e0[-1] + 1))
                e1.append(min(d1[j - 1] + (item[i] != text[j - 1]), d1[j] + 1, e1[-1] + 1))
            low = 10**9
            for j in range(m + 1):
                low = min(low, e0[j])
                e1[j] = min(e1[j], low, (e1[j - 1] + 1) if j else 10**9)
            d0, d1 = e0, e1
            if i - a + 1 >= half and min(d1) <= (i - a + 1) // 8:
                return True
    return False


def index(items):
    return C.Index(list(range(len(items))), np.concatenate(items), np.array([len(x) for x in items]))


def search(items, texts):
    return index(items).search(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def word(rng, n):
    return rng.integers(0, 2**62, n)


@pytest.mark.parametrize("texts", [1, 200])
def test_no_leak(texts):
    rng = np.random.default_rng(1)
    assert search([word(rng, int(n)) for n in rng.integers(1, 80, 240)], [word(rng, int(n)) for n in rng.integers(0, 200, texts)]) == []


def test_verification_is_the_definition():
    rng = np.random.default_rng(2)
    yes = 0
    for _ in range(400):
        item, text = rng.integers(0, 9, int(rng.integers(1, 22))), rng.integers(0, 9, int(rng.integers(0, 30)))
        if rng.random() < 0.6 and len(item) > 2:
            p = item[: (len(item) + 1) // 2 + 1].copy()
            p[rng.integers(0, len(p))] = 99
            text = np.concatenate([text, p[:2], word(rng, 7), p[2:]])
        yes += (want := brute(item.tolist(), text.tolist()))
        assert C.contains_passage(item, text) == want, (item, text)
    assert 50 < yes < 350


def planted(rng, item, whole, gap, edits=True):
    n = len(item)
    half = (n + 1) // 2
    size = n if whole else half
    a = int(rng.integers(0, n - size + 1))
    p = item[a : a + size].copy()
    if edits:
        p[rng.choice(size, size // 8, replace=False)] = word(rng, size // 8)
    cut = int(rng.integers(1, size)) if size > 1 and gap else size
    return np.concatenate([word(rng, int(rng.integers(0, 40))), p[:cut], word(rng, gap), p[cut:], word(rng, int(rng.integers(0, 40)))])


@pytest.mark.parametrize("gap", [0, 1, 119, 121, 1000])
@pytest.mark.parametrize("n", [2, 5, 8, 12, 16, 20, 24, 40, 96, 120])
def test_recall(n, gap):
    rng = np.random.default_rng(n * 1000 + gap)
    items = [word(rng, n) for _ in range(60)]
    for whole in (True, False):
        texts = [planted(rng, x, whole, gap) for x in items]
        got = set(search(items, texts))
        assert sum((i, i) in got for i in range(60)) >= 58
        assert all(i == t for t, i in got)


def test_edits_leave_out_and_put_in():
    rng = np.random.default_rng(5)
    item = word(rng, 60)
    texts = [np.delete(item[:32], [9, 20]), np.insert(item[:32], [9, 20], word(rng, 2)), np.delete(item[:30], [3, 9, 14, 20, 25]), item[:26], item[::-1]]
    assert [t for t, _ in search([item], texts)] == [0, 1]


def test_more_edits_where_more_is_leaked():
    """A longer passage may hold more edits, even if no half of it would pass alone."""
    rng = np.random.default_rng(6)
    item = word(rng, 40)
    p = item[:30].copy()
    p[[12, 14, 16]] = word(rng, 3)
    assert brute(item.tolist(), p.tolist()) and C.contains_passage(item, p)


def test_long_texts_and_ties():
    rng = np.random.default_rng(7)
    item = rng.integers(0, 500, 60)
    text = rng.integers(0, 500, 30_000)
    leak = np.concatenate([text, item[:40], text])
    assert (0, 0) in search([item, item], [leak]) and (0, 1) in search([item, item], [leak])
    assert not C.contains_passage(item, rng.integers(1000, 2000, 30_000))


def test_frame(spark):
    docs = spark.createDataFrame([(1, "Alpha beta, GAMMA delta epsilon zeta", "x"), (2, None, "x"), (3, "", "x"), (1, "Alpha beta, GAMMA delta epsilon zeta", "x"), (4, "nothing of it", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta theta"), (8, None), (9, ""), (10, "one two three four five six")], "item_id long, text string")
    assert [tuple(r) for r in C.find_leaks(docs, items).collect()] == [(1, 7)]
    assert sorted(tuple(r) for r in C.find_leaks(docs, items, block_words=5).collect()) == [(1, 7)]
    assert C.find_leaks(docs.limit(0), items).count() == 0 and C.find_leaks(docs, items.limit(0)).count() == 0


def test_slices_change_nothing():
    rng = np.random.default_rng(8)
    items = [rng.integers(0, 300, int(n)) for n in rng.integers(5, 90, 30)]
    texts = [np.concatenate([rng.integers(0, 300, int(n)), items[i % 30][: len(items[i % 30]) * 3 // 4], rng.integers(0, 300, 20)]) for i, n in enumerate(rng.integers(0, 900, 80))] + [np.empty(0, np.int64)] * 3
    flat, base = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    whole = index(items).search(flat, base)
    was, C.SLICE_WORDS = C.SLICE_WORDS, 700
    try:
        assert sorted(index(items).search_all(flat, base)) == sorted(whole) and len(whole) >= 80
    finally:
        C.SLICE_WORDS = was
    assert index(items).search_all(np.empty(0, np.int64), np.zeros(1, np.int64)) == []
