"""Against a plain model in dictionaries, and the sum of probabilities after each word."""

import re
import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import numpy as np
import pytest

from tallyloom.llm import katz

SCHEMA = "doc_id long, text string, score string, block long"


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


class Plain:
    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for text in texts:
            now = tokens_of(text)
            self.one.update(now)
            self.two.update(zip(["<s>", *now], now))
        self.n, self.v = self.one.total(), len(self.one)
        of = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, katz.RELIABLE + 2)], float)
        self.d1, self.d2 = katz.discounts(of(self.one), self.n), katz.discounts(of(self.two), self.n)
        self.after, self.followers = Counter(), defaultdict(set)
        for (v, w), c in self.two.items():
            self.after[v] += c
            self.followers[v].add(w)

    def mass(self, d, c):
        return d[min(c, katz.RELIABLE + 1)] * c

    def p1(self, w):
        if not self.n:
            return 1.0
        if w in self.one:
            return self.mass(self.d1, self.one[w]) / self.n
        return 1 - sum(self.mass(self.d1, c) for c in self.one.values()) / self.n

    def p2(self, v, w):
        if not self.after[v]:
            return self.p1(w)
        if (v, w) in self.two:
            return self.mass(self.d2, self.two[v, w]) / self.after[v]
        left = 1 - sum(self.mass(self.d2, self.two[v, x]) for x in self.followers[v]) / self.after[v]
        return left / (1 - sum(self.p1(x) for x in self.followers[v])) * self.p1(w)


def expect(rows, model, held):
    for r in rows:
        now = tokens_of(r["text"])
        base = sum(log10((model.one[w] + 1) / (model.n + model.v + 1)) for w in now)
        score = sum(log10(model.p2(v, w)) for v, w in zip(["<s>", *now], now))
        yield r["doc_id"], held(r["doc_id"]), len(now), sum(w in model.one for w in now), model.n, base, score


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % katz.FOLDS == katz.HELD_OUT


def compare(frame, rows):
    model = Plain([r["text"] for r in rows if not is_held(r["doc_id"])])
    order = lambda r: tuple((x is None, x or 0) if i == 0 else x for i, x in enumerate(r))
    got = sorted((tuple(r) for r in frame.collect()), key=order)
    want = sorted(expect(rows, model, is_held), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))
    return model


def test_small_cases(spark):
    words = "the cat sat on a mat and the dog ate it".split()
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(60)] + [None, "", "  \n", "new words only", "THE Cat", "x " * 5000, "é b É"]
    rows = [{"doc_id": i, "text": t, "score": "clash", "block": 1} for i, t in enumerate(texts)] + [{"doc_id": None, "text": "no id", "score": None, "block": None}] * 2
    rows += [{"doc_id": 3, "text": texts[3], "score": "again", "block": 2}]
    compare(katz.score(spark.createDataFrame(rows, SCHEMA)), rows)


def test_blocks_and_ranges_change_nothing(spark, monkeypatch, folder):
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    whole = {r["doc_id"]: r["score"] for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(katz, "RANGE_ENTRIES", 1000)
    cut = {r["doc_id"]: r["score"] for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert whole.keys() == cut.keys() and all(isclose(whole[k], cut[k], rel_tol=1e-9) for k in whole)
    model = compare(katz.score(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    for v in ["<s>", *list(model.after)[:5]]:
        total = sum(model.p2(v, w) for w in model.one) + model.p2(v, "a word never seen")
        assert isclose(total, 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if is_held(i))
    (row,) = katz.score(spark.createDataFrame([{"doc_id": held, "text": "a b"}], "doc_id long, text string")).collect()
    assert tuple(row)[:5] == (held, True, 3, 0, 0) and row["base_score"] == 0 and row["score"] == 0
    assert katz.score(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("of", [[0] * 6, [5, 0, 0, 0, 0, 0], [10, 6, 4, 3, 2, 1], [1, 9, 1, 9, 1, 9]])
def test_discounts_leave_something_over(of):
    d = katz.discounts(np.array(of, float), 50)
    assert d[0] == 0 and ((d[1:] > 0) & (d[1:] < 1)).all()
