"""Periodic runs against a search that tries every period."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from tallyloom.llm import periodic_runs
from tallyloom.llm.queries import QUERIES
from tests.llm import cases


def plain_runs(words):
    """Every period by itself: stretches in which words that far apart are equal; the least period of a stretch stays."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_words(doc_id, text):
    """The contract's words, each taken by its own rule."""
    words = (text or "").encode().split()
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text, words=None):
    words = plain_words(doc_id, text) if words is None else words
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    spelt = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(spelt.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def fill(part, n):
    return (part * (n // len(part) + 1))[:n]


def sequence(rng):
    """Stretches of many periods side by side, periodic periods among them."""
    words, size, letters = [], rng.randint(0, 240), rng.choice([1, 2, 3, 50])
    while len(words) < size:
        part = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 33, 40]))]
        if rng.random() < 0.4:
            part = fill(part[: rng.randint(1, 4)], rng.randint(5, 30)) + part[: rng.randint(0, 3)]
        words += part if rng.random() < 0.3 else fill(part, rng.randint(10, 150))
    return words


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        words = sequence(rng)
        codes = np.unique(words + [10**6], return_inverse=True)[1].astype(np.int64)
        assert [(s, e - s, q) for s, e, q in periodic_runs.runs_of(codes).tolist()] == plain_runs(words)


def test_texts_side_by_side_do_not_meet():
    a, b = [b"x"] * 23, [b"x"] * 24
    runs, left = periodic_runs._group([a, a, b, [], b])
    assert [len(r) for r in runs] == [0, 0, 1, 0, 1] and left == [b" ".join(a)] * 2 + [b"x", b"", b"x"]


def test_wavelet_tree_successors():
    rng = np.random.default_rng(3)
    values = rng.permutation(97)
    tree = periodic_runs.WaveletTree(values, 97)
    lo = rng.integers(0, 98, 500)
    hi = rng.integers(0, 98, 500)
    x = rng.integers(0, 105, 500)
    plain = [min([v for v in values[a:b] if v >= y], default=periodic_runs.NONE) for a, b, y in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x).tolist() == plain


def test_op13_equals_plain(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, folder).collect())) == sorted(plain_row(*r) for r in rows)


@pytest.mark.parametrize("group", [1, 1 << 18])
def test_odd_rows(spark, group):
    extra = [(100 + i, t, "clash", "clash", 1, "clash") for i, t in enumerate(["la " * 5000, "a b c " * 8, "one two three four five six seven " * 400 + "end"])]
    docs = spark.createDataFrame(cases.rows() + extra, cases.SCHEMA)
    got = periodic_runs.find_runs(docs, group_words=group).collect()
    plain = []
    for r in cases.rows() + extra:
        words = (r[1] or "").encode().split()
        runs = plain_runs(words) if len(words) < 20_000 else periodic_runs_of_cycle(words, 977)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        plain.append((r[0], len(words), runs, " ".join(w.decode() for i, w in enumerate(words) if i not in dropped)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=cases.key) == sorted(plain, key=cases.key)
    assert periodic_runs.find_runs(cases.empty(spark)).collect() == []


def periodic_runs_of_cycle(words, period):
    """The long text of the cases is one cycle from its first word to its last."""
    assert all(a == b for a, b in zip(words, words[period:])) and len(set(words)) == period
    return [(0, len(words), period)]
