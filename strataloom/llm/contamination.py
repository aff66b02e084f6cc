"""Evaluation items leaking into training texts, by embedding edit distance into Hamming distance.

Windows of words are walked by shared random bits (Chakraborty, Goldenberg, Koucky 2016): at each step the walk emits the
word it stands on and moves on or stays, as a bit of that word's hash for that step says. Windows at small edit distance
give walks at small Hamming distance, so sampling a few steps makes a locality-sensitive key. Windows are sized by the
item: short items have short windows. Items are windowed at every word and texts at every second to fourth, so a leaked
passage meets several windows; each is keyed under several walks and samples. Items too short for sampling are keyed by
whole runs of words, of the length that every leaked passage keeps unchanged somewhere.
Texts that share a key with an item are verified exactly, by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .words import words

#: Words of items that are indexed at a time: the query set is worked off in blocks against all rows.
BLOCK_WORDS = 250_000
#: Items of fewer words are found by runs of whole words.
SHORT = 24
#: Items of fewer words have every text that shares a key with them looked at, whatever else agrees.
FEW = 32
#: Least words of an item, then width and stride of its windows and the steps in a sample of their walks.
SIZES = [(24, 6, 1, 8), (32, 8, 2, 9), (64, 12, 3, 9)]
WALKS, SAMPLES = 2, 4
#: Words of a text from which its words are looked up once for all items, and words of texts searched at a time.
LONG, SLICE_WORDS = 500, 150_000
#: Cells of the tables of edit distances that are held at once.
CELLS = 2_000_000
_PAD = np.int64(-7046029254386353131)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _fold(key: np.ndarray, c: np.ndarray) -> np.ndarray:
    key = (key ^ c) * np.uint64(0xFF51AFD7ED558CCD)
    return key ^ (key >> np.uint64(32))


@dataclass(frozen=True)
class Scheme:
    """How windows of one width are keyed; ``take`` 0 stands for all their words, without a walk."""

    width: int
    stride: int
    take: int = 0
    seed: int = 20240229
    plan: list[tuple[int, list[list[int]]]] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        # a fixed seed, so that all tasks agree
        rng = np.random.default_rng(self.seed)
        walk = lambda: (int(rng.integers(1, 2**62)), [sorted(rng.choice(2 * self.width, self.take, replace=False).tolist()) for _ in range(SAMPLES)])
        object.__setattr__(self, "plan", [walk() for _ in range(WALKS if self.take else 0)])

    def keys(self, seq: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(keys of a window, windows) of 64 bits. ends: where each window's text ends; beyond it a pad stands."""
        padded = np.append(seq, _PAD)
        stop = np.minimum(starts + self.width, ends)
        if not self.take:
            key = np.full(len(starts), self.width, np.uint64)
            coin = _mix(padded, 0x5851F42D4C957F2D)
            for j in range(self.width):
                key = _fold(key, coin[np.where(starts + j < stop, starts + j, len(seq))])
            return key[None, :]
        out = np.empty((WALKS * SAMPLES, len(starts)), np.uint64)
        row = 0
        for salt, samples in self.plan:
            coin = _mix(padded, salt)
            key = np.full((SAMPLES, len(starts)), salt & 0xFFFF, np.uint64)
            at = starts.copy()
            for j in range(max(s[-1] for s in samples) + 1):
                c = coin[np.where(at < stop, at, len(seq))]
                for n, s in enumerate(samples):
                    if j in s:
                        key[n] = _fold(key[n], c)
                at += ((c >> np.uint64(j + 8)) & np.uint64(1)).astype(np.int64)
            for n in range(SAMPLES):
                out[row] = key[n] * np.uint64(2 * row + 1) + np.uint64(row)
                row += 1
        return out


def _least(n):
    """Words of the shortest passage that counts as a leak of an item of n words."""
    return (n + 1) // 2


def scheme_of(n: int) -> Scheme:
    """The windows of items of n words."""
    if n >= SHORT:
        return Scheme(*next(s[1:] for s in reversed(SIZES) if n >= s[0]))
    # k edits and one insertion leave at most k + 2 stretches, one of which has this many words
    half = _least(n)
    k = half // 8
    return Scheme(-(-(half - k) // (k + 2)), 1)


def _sorted(item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The item's different words in order, where each begins among its sorted places and how often it stands, and the places."""
    order = np.argsort(item, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(item[order]) != 0))
    return item[order][new], new, np.diff(np.append(new, len(item))), order


def _meeting(own: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, j) of every equal pair of words item[x], text[j]; own: _sorted(item)."""
    word = own[0]
    at = np.minimum(np.searchsorted(word, text), len(word) - 1)
    j = np.flatnonzero(word[at] == text)
    return _spread(own, at[j], j)


def _spread(own: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, j) for the words of the text at j, each of which is the item's different word number at."""
    _, new, often, order = own
    lo, num = new[at], often[at]
    j = np.repeat(j, num)
    return order[np.repeat(lo - np.cumsum(num) + num, num) + np.arange(len(j))], j


def _on_two_diagonals(item: np.ndarray, text: np.ndarray, diagonals: np.ndarray, at: int) -> bool:
    """Whether half of the item's words, less one in eight, stand in order on the diagonal ``at`` or on it and one other.

    diagonals: of every equal pair of words. A quick proof of most leaks; that it fails proves nothing.
    """
    n, m = len(item), len(text)
    half = _least(n)
    need = half - half // 8
    d, count = np.unique(diagonals, return_counts=True)
    d = d[np.argsort(-count, kind="stable")[:64]]

    def line(d: np.ndarray) -> np.ndarray:
        """Running counts of equal words along the diagonals that start at d."""
        i = np.arange(n)
        j = i[:, None] + d[None, :]
        ok = (j >= 0) & (j < m)
        eq = ok & (text[np.where(ok, j, 0)] == item[:, None])
        return np.concatenate([np.zeros((1, len(d)), np.int32), np.cumsum(eq, 0, dtype=np.int32)])

    here = line(np.array([at]))
    for others, after in ((d[d >= at], True), (d[d < at], False)):
        if not len(others):
            continue
        there = line(others)
        first, second = (here, there) if after else (there, here)
        gain = first - second
        for a in range(n - half + 1):
            b = a + half
            if (second[b] - first[a] + gain[a : b + 1].max(0)).max() >= need:
                return True
    return False


def _condensed(text: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """text with every run of words that are not ``own`` replaced by ``size`` words that occur nowhere.

    No alignment of fewer edits crosses such a run but by the free insertion.
    """
    last = np.maximum.accumulate(np.where(own, np.arange(len(text)), -1))
    gap = np.arange(len(text)) - last
    return np.where(own, text, _PAD)[own | (gap <= size)]


def contains_passage(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether a stretch of at least half of the item's words stands in the text with at most one edit for eight words.

    An edit puts in, leaves out or replaces one word; at one place words may be put in without limit and without cost.
    """
    n = len(item)
    half = _least(n)
    text = _condensed(text, np.isin(text, item), n // 8 + 1)
    m = len(text)
    kind = np.int16 if m + n < 2**15 else np.int32
    ramp = np.arange(m + 1, dtype=kind)
    size = max(1, CELLS // (m + 1))
    for s0 in range(0, n - half + 1, size):
        starts = np.arange(s0, min(n - half + 1, s0 + size))
        # edits of the words so far against stretches that end at each place: before and after the free insertion
        before = np.zeros((len(starts), m + 1), kind)
        after = np.zeros_like(before)
        for r in range(n - int(starts[0])):
            live = starts + r < n
            starts, before, after = starts[live], before[live], after[live]
            other = (item[starts + r][:, None] != text[None, :]).astype(kind)

            def step(old: np.ndarray, floor: np.ndarray | None = None) -> np.ndarray:
                new = old + 1
                np.minimum(new[:, 1:], old[:, :-1] + other, out=new[:, 1:])
                if floor is not None:
                    np.minimum(new, floor, out=new)
                return np.minimum.accumulate(new - ramp, 1) + ramp

            before = step(before)
            after = step(after, np.minimum.accumulate(before, 1))
            got = after.min(1)
            if r + 1 >= half and (got <= (r + 1) // 8).any():
                return True
            # edits never become fewer: a start beyond what even the whole rest would allow is done with
            hope = got <= (n - starts) // 8
            if not hope.any():
                break
            starts, before, after = starts[hope], before[hope], after[hope]
    return False


def _stretches(first: np.ndarray, count: np.ndarray, x: np.ndarray, n: int, most: int, least: int = 0) -> np.ndarray:
    """(edits, band): how many words of an item of n words one band holds in a row with at most ``least`` … ``most`` lacking.

    x: the item's words that are equal somewhere, by diagonal; a band has those from first to first + count.
    """
    row = np.repeat(np.arange(len(first)), count)
    lacks = np.ones((len(first), n + 2), bool)
    lacks[row, x[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))] + 1] = False
    r, at = np.nonzero(lacks)
    begins = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    lacking = np.diff(np.append(begins, len(r))) - 2
    out = np.zeros((most + 1 - least, len(first)), np.int64)
    for e in range(least, most + 1):
        size = np.zeros(len(r), np.int64)
        np.multiply(at[e + 1 :] - at[: -e - 1] - 1, r[e + 1 :] == r[: -e - 1], out=size[: -e - 1])
        out[e - least] = np.where(lacking <= e, n, np.maximum.reduceat(size, begins))
    return out


def leaks(item: np.ndarray, text: np.ndarray, at: int, met: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """contains_passage(), after what proves or disproves it at less cost; ``at``: a diagonal where both agree much; met: as _meeting() gives it."""
    n, half = len(item), _least(len(item))
    need = half - half // 8
    x, j = _meeting(_sorted(item), text) if met is None else met
    # enough of the words of some half of the item must stand in the text at all
    there = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n) > 0)])
    if (there[half:] - there[:-half]).max() < need:
        return False
    order = np.argsort(j - x, kind="stable")
    x, d = x[order], (j - x)[order]
    begins = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    slot = d[begins] + n
    upto = np.cumsum(np.bincount(d + n, minlength=int(slot[-1]) + n // 8 + 1))
    inside = np.zeros(len(text) + 1, np.int64)
    for k in range(half // 8, n // 8 + 1):
        # k edits need so long a passage, and leave each of its two stretches on k + 1 neighbouring diagonals: a band
        size = max(half, 8 * k)
        count = upto[slot + k] - begins
        # one stretch has half of the equal words, and what the best band lacks the other must have
        big, rich = 2 * count >= size - k, count >= size - k - count.max()
        if not big.any():
            continue
        first = begins[rich]
        if big.sum() * n <= CELLS and 2 * _stretches(begins[big], count[big], x, n, k, k).max() < size:
            continue
        if len(first) * n <= CELLS:
            each = _stretches(first, count[rich], x, n, k)
            longest = each.max(1)
            if not any(longest[e] + longest[k - e] >= size for e in range(k + 1)):
                continue
            first = first[each[k] + longest[k] >= size]
        np.add.at(inside, np.clip(d[first], 0, len(text)), 1)
        np.add.at(inside, np.clip(d[first] + n + k + 1, 0, len(text)), -1)
    near = np.cumsum(inside[:-1]) > 0
    return bool(near.any()) and (_on_two_diagonals(item, text, d, at) or contains_passage(item, _condensed(text, near, n // 8 + 1)))


@dataclass
class _Keys:
    """The different keys of the windows of all items of one scheme in order, and the windows by key."""

    scheme: Scheme
    key: np.ndarray
    first: np.ndarray
    often: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    bits: int
    seen: np.ndarray


class Index:
    """Keys of all windows of a block of items."""

    def __init__(self, ids: list[int], flat: np.ndarray, n: np.ndarray):
        self.ids, self.flat, self.n = ids, flat, n
        self.base = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        groups: dict[Scheme, list[int]] = {}
        for i, k in enumerate(n.tolist()):
            if k:
                groups.setdefault(scheme_of(k), []).append(i)
        self.sorted: dict[int, tuple] = {}
        self.vocabulary = np.unique(flat)
        # of each different word of the items, its number among those of the item at hand; none otherwise
        self.place = np.full(len(self.vocabulary) + 1, -1, np.int32)
        self.tables = [self._table(s, np.array(own)) for s, own in groups.items()]

    def _table(self, scheme: Scheme, own: np.ndarray) -> _Keys:
        per = np.maximum(1, self.n[own] - scheme.width + 1)
        owner = np.repeat(own, per)
        offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        k = scheme.keys(self.flat, self.base[owner] + offset, self.base[owner + 1])
        key = k.ravel()
        order = np.argsort(key, kind="stable")
        key, first, often = np.unique(key[order], return_index=True, return_counts=True)
        bits = max(16, int(np.ceil(np.log2(len(key) * 16))))
        seen = np.zeros(1 << bits, bool)
        seen[key >> np.uint64(64 - bits)] = True
        return _Keys(scheme, key, first, often, np.tile(owner, len(k))[order], np.tile(offset, len(k))[order], bits, seen)

    def _meets(self, flat: np.ndarray, base: np.ndarray) -> Iterator[np.ndarray]:
        """(text, item, diagonal) of the windows that share a key."""
        n = np.diff(base)
        for t in self.tables:
            w, stride = t.scheme.width, t.scheme.stride
            per = np.where(n > 0, np.maximum(1, -(-(n - w + 1) // stride)), 0)
            text = np.repeat(np.arange(len(n)), per)
            starts = (base[text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))).astype(np.int64)
            for row in t.scheme.keys(flat, starts, base[text + 1]):
                hit = np.flatnonzero(t.seen[row >> np.uint64(64 - t.bits)])
                at = np.searchsorted(t.key, row[hit])
                same = t.key[np.minimum(at, len(t.key) - 1)] == row[hit]
                hit, at = hit[same], at[same]
                if not len(hit):
                    continue
                lo, num = t.first[at], t.often[at]
                at = np.repeat(lo - np.cumsum(num) + num, num) + np.arange(num.sum())
                who = np.repeat(hit, num)
                yield np.stack([text[who], t.owner[at], starts[who] - base[text[who]] - t.offset[at]])

    def _equal_words(self, flat: np.ndarray, base: np.ndarray, t: np.ndarray, o: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many of any half of the item's words at most are equal to those of the text on the diagonal, for each triple."""
        out = np.zeros(len(t), np.int64)
        order = np.argsort(o, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(o[order]) != 0))
        for rows in np.split(order, cut[1:]):
            item = self.flat[self.base[o[rows[0]]] : self.base[o[rows[0]] + 1]]
            half = _least(len(item))
            size = max(1, CELLS // len(item))
            for i in range(0, len(rows), size):
                r = rows[i : i + size]
                j = (base[t[r]] + d[r])[:, None] + np.arange(len(item))
                ok = (j >= base[t[r]][:, None]) & (j < base[t[r] + 1][:, None])
                upto = np.cumsum(ok & (flat[np.where(ok, j, 0)] == item), 1, dtype=np.int32)
                out[r] = np.maximum(upto[:, half - 1], (upto[:, half:] - upto[:, :-half]).max(1, initial=0))
        return out

    def search_all(self, flat: np.ndarray, base: np.ndarray) -> list[tuple[int, int]]:
        """As search(), a slice of texts at a time that stays in the processor's cache."""
        out = []
        a = 0
        while a < len(base) - 1:
            b = max(a + 1, int(np.searchsorted(base, base[a] + SLICE_WORDS, "right")) - 1)
            out += [(a + t, o) for t, o in self.search(flat[base[a] : base[b]], base[a : b + 1] - base[a])]
            a = b
        return out

    def search(self, flat: np.ndarray, base: np.ndarray) -> list[tuple[int, int]]:
        """(text number, item number) of verified leaks among the texts flat[base[t]:base[t + 1]]."""
        met = list(self._meets(flat, base))
        if not met:
            return []
        t, o, d = np.concatenate(met, axis=1)
        edge = int(self.n.max())
        span = int((base[1:] - base[:-1]).max()) + 2 * edge + 2
        # text, item and diagonal in one number, so that sorting makes them distinct
        met_at = np.unique((t * len(self.n) + o) * span + d + edge)
        pair, d = met_at // span, met_at % span - edge
        t, o = pair // len(self.n), pair % len(self.n)
        same = self._equal_words(flat, base, t, o, d)
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        n = self.n[o[new]]
        half = _least(n)
        # the larger of two stretches holds half of the words that must be equal; edits spread them over neighbouring diagonals
        upto = np.searchsorted(met_at, met_at + self.n[o] // 8, "right")
        total = np.append(0, np.cumsum(same))
        keep = np.maximum.reduceat(total[upto] - total[:-1], new) >= np.where(n < FEW, 1, (half - half // 8 + 1) // 2)
        found: list[tuple[int, int]] = []
        coded, codes = -1, None
        for a, b in zip(new[keep].tolist(), np.append(new[1:], len(t))[keep].tolist()):
            item = self.flat[self.base[o[a]] : self.base[o[a] + 1]]
            text = flat[base[t[a]] : base[t[a] + 1]]
            if (own := self.sorted.get(int(o[a]))) is None:
                own = self.sorted[int(o[a])] = _sorted(item)
            if len(text) > LONG and t[a] != coded:
                # looked up once for all items
                coded, codes = t[a], np.searchsorted(self.vocabulary, text)
                codes[self.vocabulary[np.minimum(codes, len(self.vocabulary) - 1)] != text] = len(self.vocabulary)

            def meeting(own=own, text=text, codes=codes):
                if len(text) <= LONG:
                    return _meeting(own, text)
                ids = np.searchsorted(self.vocabulary, own[0])
                self.place[ids] = np.arange(len(ids))
                at = self.place[codes]
                self.place[ids] = -1
                j = np.flatnonzero(at >= 0)
                return _spread(own, at[j], j)

            top = a + int(same[a:b].argmax())
            # enough equal words on one diagonal are a passage without further proof
            if same[top] >= _least(len(item)) - _least(len(item)) // 8 or leaks(item, text, int(d[top]), meeting()):
                found.append((int(t[a]), int(o[a])))
        return found


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id): the text holds at least half of the item as one passage.

    Up to one word in eight of the passage may be replaced, left out or put in, and one insertion of any length may
    interrupt it. Null and empty texts and items match nothing; equal rows give equal results once; an empty table gives
    an empty result; only the named columns are read. Items come in blocks of about block_words words, each searched
    against all texts, whose words are then hashed once and written; an item longer than that is a block of its own.
    """
    spark = docs.sparkSession
    hashed = lambda c: F.transform(words(F.col(c)), lambda w: F.xxhash64(w))
    seqs = docs.select(F.col(doc_id).cast("long").alias("k"), hashed(text).alias("w")).where("size(w) > 0")
    rows = items.select(F.col(item_id).cast("long").alias("i"), hashed(item_text).alias("w")).where("size(w) > 0").distinct()
    total = rows.agg(F.sum(F.size("w"))).collect()[0][0] or 0
    blocks = max(1, -(-total // block_words))
    if blocks > 1:
        seqs, rows = materialize(seqs), materialize(rows)
    out = None
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").toArrow()
        lists = part.column("w").combine_chunks()
        n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # built once here, so that no task builds it again
        index = spark.sparkContext.broadcast(Index(part.column("i").to_pylist(), lists.flatten().to_numpy(zero_copy_only=False), n))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                ks = batch.column(0).to_numpy(zero_copy_only=False)
                col = batch.column(1)
                flat = col.flatten().to_numpy(zero_copy_only=False)
                base = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False))]).astype(np.int64)
                got = ix.search_all(flat, base) if ix.ids else []
                yield pa.RecordBatch.from_arrays([pa.array([int(ks[t]) for t, _ in got], pa.int64()), pa.array([ix.ids[o] for _, o in got], pa.int64())], ["doc_id", "item_id"])

        found = seqs.mapInArrow(run, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
