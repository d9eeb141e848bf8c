"""Periodic runs of words, found by internal pattern matching.

The words of many texts form one sequence of numbers, with a number of its own behind each text. Prefix doubling gives, for each
power of two, the classes of equal factors of that length, and in the end the suffix array. A run of period q and of at least
max(24, 3 q) words holds a block of b words at a multiple of b, where b is the power of two with b <= q < 2 b (8 for shorter
periods), and holds it again q words on. All blocks ask at once where they occur again in the window next to them: their factors
are an interval of the suffix array, and a wavelet tree over that array answers range successors. Occurrences in a window of b
starts are one or two, or an arithmetic progression. A progression of difference d lies in a stretch of period d, and the run's
period is the distance of the left or of the right ends of the stretches around the block and around the progression. Each
candidate is extended both ways by the classes of factors, longest first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text

#: A run has at least this many words, and at least this many periods
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The shortest block has 2^3 words: a third of the shortest run
FIRST_LEVEL = 3
#: So many words are searched together, at least; a text is never cut
GROUP_WORDS = 1 << 18
#: A place behind every sequence
NONE = 1 << 60

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split_words(doc_id: int | None, raw: bytes) -> list[bytes]:
    """Runs of bytes other than the six ASCII blanks."""
    return raw.split()


class Factors:
    """Classes of equal factors of each power-of-two length, and the suffix array. The last number of the sequence is unique.

    ``levels[k][i]`` is the place in the suffix array where the suffixes that share the 2^k numbers from i on begin.
    """

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        order = np.argsort(codes, kind="stable")
        place, _ = self._places(codes[order], np.zeros(n, np.int64))
        rank = np.empty(n, np.int64)
        rank[order] = place
        self.array, self.levels = order, [rank]
        alone = np.bincount(rank, minlength=n) == 1
        active = order[~alone[place]]
        while len(active):
            step = 1 << (len(self.levels) - 1)
            old = rank[active]
            key = old * n + rank[active + step]
            by = np.argsort(key)
            active, key, old = active[by], key[by], old[by]
            place, slot = self._places(key, old)
            self.array[slot] = active
            rank = rank.copy()
            rank[active] = place
            self.levels.append(rank)
            last = np.r_[place[1:] != place[:-1], True]
            first = np.r_[True, last[:-1]]
            active = active[~(first & last)]

    @staticmethod
    def _places(key: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys: the place at which the class of each begins, and each one's own; ``base`` is where its old class begins."""
        at = np.arange(len(key))
        opens = np.r_[True, key[1:] != key[:-1]]
        outer = np.r_[True, base[1:] != base[:-1]]
        slot = base + at - np.maximum.accumulate(np.where(outer, at, 0))
        return slot[np.maximum.accumulate(np.where(opens, at, 0))], slot

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers agree from i and from j > i on."""
        size = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            size += (self.levels[k][i + size] == self.levels[k][j + size]).astype(np.int64) << k
        return size

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers agree before i and before j > i."""
        size = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            at = i - size - (1 << k)
            same = self.levels[k][np.maximum(at, 0)] == self.levels[k][np.maximum(j - size - (1 << k), 0)]
            size += (same & (at >= 0)).astype(np.int64) << k
        return size


class WaveletTree:
    """Numbers below ``top``; counts and range successors for arrays of intervals. One level a bit, zeros before ones."""

    def __init__(self, values: np.ndarray, top: int):
        self.top, self.levels = top, []
        for bit in reversed(range(max(1, int(top - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~ones)]
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers in [lo, hi) are less than x, which is below ``top``."""
        count = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            one = (x >> bit & 1).astype(bool)
            zlo, zhi = zeros[lo], zeros[hi]
            count += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, zeros[-1] + lo - zlo, zlo), np.where(one, zeros[-1] + hi - zhi, zhi)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number of rank k (from 0) in [lo, hi), where k < hi - lo."""
        value = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            zlo, zhi = zeros[lo], zeros[hi]
            one = k >= zhi - zlo
            value += one.astype(np.int64) << bit
            k = np.where(one, k - (zhi - zlo), k)
            lo, hi = np.where(one, zeros[-1] + lo - zlo, zlo), np.where(one, zeros[-1] + hi - zhi, zhi)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least number of [lo, hi) that is x or more; ``NONE`` if there is none."""
        found = np.full(len(lo), NONE, np.int64)
        at = np.flatnonzero((hi > lo) & (x < self.top))
        rank = self.below(lo[at], hi[at], x[at])
        has = rank < (hi - lo)[at]
        at = at[has]
        found[at] = self.smallest(lo[at], hi[at], rank[has])
        return found


def _candidates(factors: Factors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (their starts) and a period for each that a run around it may have."""
    n, levels = factors.n, factors.levels
    if len(levels) <= FIRST_LEVEL:
        return
    # only suffixes that share a shortest block with another one are ever asked for
    shared = np.bincount(levels[FIRST_LEVEL], minlength=n)
    asked = shared[levels[FIRST_LEVEL][factors.array]] > 1
    slots = np.r_[0, np.cumsum(asked)]
    tree = WaveletTree(factors.array[asked], n)
    for k in range(FIRST_LEVEL, len(levels)):
        b = 1 << k
        sizes = np.bincount(levels[k], minlength=n)
        i = np.arange(0, n, b)
        i = i[sizes[levels[k][i]] > 1]
        if not len(i):
            continue
        lo = levels[k][i]
        lo, hi = slots[lo], slots[lo + sizes[lo]]
        if k == FIRST_LEVEL:
            near = tree.successor(lo, hi, i + 1)
            ok = near - i < b
            yield i[ok], (near - i)[ok]
        first = tree.successor(lo, hi, i + b)
        ok = first - i < 2 * b
        i, lo, hi, first = i[ok], lo[ok], hi[ok], first[ok]
        yield i, first - i
        second = tree.successor(lo, hi, first + 1)
        ok = second - i < 2 * b
        i, lo, hi, first, second = i[ok], lo[ok], hi[ok], first[ok], second[ok]
        yield i, second - i
        third = tree.successor(lo, hi, second + 1)
        ok = third - i < 2 * b
        i, first, d = i[ok], first[ok], (second - first)[ok]
        ends = [(x - factors.behind(x, x + d), x + d + factors.ahead(x, x + d)) for x in (i, first)]
        for side in (0, 1):
            q = ends[1][side] - ends[0][side]
            ok = (q >= b) & (q < 2 * b)
            yield i[ok], q[ok]


def runs_of(codes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period. The last number must be unique, so that no run reaches it."""
    factors = Factors(codes)
    made = [np.zeros((0, 3), np.int64)]
    for i, q in _candidates(factors):
        start = i - factors.behind(i, i + q)
        end = i + q + factors.ahead(i, i + q)
        ok = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        made.append(np.stack([start[ok], end[ok], q[ok]], 1))
    rows = np.unique(np.concatenate(made), axis=0)
    # a multiple of the smallest period gives the same stretch: the least period stays
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]] if len(rows) else rows


def _group(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """The runs of each text (lists of words), and each text without the repetitions."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    codes = np.empty(starts[-1], np.int64)
    for k, words in enumerate(texts):
        codes[starts[k] : starts[k + 1] - 1] = [number(w, len(numbers)) for w in words]
    codes[starts[1:] - 1] = len(numbers) + np.arange(len(texts))
    rows = runs_of(codes)
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
    np.add.at(cover, rows[:, 1], -1)
    kept = np.cumsum(cover) == 0
    runs: list[list[dict]] = [[] for _ in texts]
    for k, start, end, period in zip(owner.tolist(), (rows[:, 0] - starts[owner]).tolist(), (rows[:, 1] - starts[owner]).tolist(), rows[:, 2].tolist()):
        runs[k].append({"start": start, "length": end - start, "period": period})
    left = []
    for k, words in enumerate(texts):
        if runs[k]:
            words = [w for w, keep in zip(words, kept[starts[k] : starts[k + 1] - 1].tolist()) if keep]
        left.append(b" ".join(words))
    return runs, left


def find_runs(docs: DataFrame, words_of: Callable[[int | None, bytes], list[bytes]] = split_words, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed.

    A run is a stretch of consecutive words with smallest period q and at least max(24, 3 q) words that no neighbouring word
    extends. ``collapsed`` is the text without the words that a run holds after its first q, joined by one blank. Runs are
    maximal, so ties do not arise; rows that are alike each give a row. A null or empty text has no words, no runs and an
    empty ``collapsed``; an empty table gives no rows. Texts are searched whole, however long. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw = batch.column(1).cast(pa.binary())
            group, held, at = [], 0, 0
            for k in range(len(ids)):
                group.append(words_of(ids[k], raw[k].as_py()))
                held += len(group[-1]) + 1
                if held >= group_words or k == len(ids) - 1:
                    runs, left = _group(group)
                    sizes = pa.array([len(g) for g in group], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(group)), sizes, pa.array(runs, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    group, held, at = [], 0, k + 1

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones that of the smallest start, then period. Null without runs."""

    def better(a, x):
        more, less = x["length"] * a["period"], a["length"] * x["period"]
        return F.when(a.isNull() | (more > less), x).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
