"""The random field against sums over all taggings, its scores against held-out labels."""

from itertools import product

import numpy as np
import pytest

from tallyloom.llm import toxicity
from tallyloom.llm.queries import QUERIES
from tests.llm import cases


def plain_marginals(x, step, start):
    """Every tagging of one text by itself."""
    total, toxic = 0.0, np.zeros(len(x))
    for tags in product((0, 1), repeat=len(x)):
        w = start[tags[0]] * np.prod([x[i] for i, t in enumerate(tags) if t]) * np.prod([step[a, b] for a, b in zip(tags, tags[1:])])
        total += w
        toxic += w * np.array(tags)
    return toxic / total, total


@pytest.mark.parametrize("lengths", [[1], [3], [2, 1, 5], [7, 1, 1, 4, 6]])
def test_marginals_are_sums_over_taggings(lengths):
    rng = np.random.default_rng(len(lengths))
    x = np.exp(rng.normal(0, 2, sum(lengths)))
    step, start = np.exp(rng.normal(0, 1, (2, 2))), np.array([1.0, 0.3])
    starts = np.r_[0, np.cumsum(lengths)]
    opens = np.zeros(len(x), bool)
    opens[starts[:-1]] = True
    _, _, logs, marginal = toxicity.chain(x, opens, step, start)
    plain = [plain_marginals(x[a:z], step, start) for a, z in zip(starts, starts[1:])]
    assert np.allclose(marginal, np.concatenate([p for p, _ in plain]))
    assert np.isclose(logs.sum(), sum(np.log(t) for _, t in plain))


def test_long_chains_stay_in_range():
    x = np.where(np.arange(200_000) % 7 == 0, 1e9, 1e-9)
    opens = np.arange(len(x)) == 0
    marginal = toxicity.chain(x, opens, np.array([[1, 0.1], [0.1, 1]]), np.array([1.0, 0.1]))[3]
    assert np.isfinite(marginal).all() and (marginal[7::7] > 0.9).all()


def test_minimum_of_a_bowl():
    centre = np.array([3.0, -2.0, 0.5])
    found = toxicity.least(lambda v: (float(((v - centre) ** 2 @ [1, 10, 100])), 2 * (v - centre) * [1, 10, 100]), np.zeros(3), 60)
    assert np.allclose(found, centre, atol=1e-2)


def made(n, toxic_words, rng, plain=("lorem", "ipsum", "dolor", "sit", "amet", "magna", "aliqua")):
    texts, toxic = [], []
    for k in range(n):
        words = list(rng.choice(plain, 30))
        toxic.append(k % 3 == 0)
        for at in rng.choice(30, 4, replace=False) if toxic[-1] else []:
            words[at] = rng.choice(toxic_words)
        texts.append(" ".join(words))
    return texts, toxic


def test_learns_words_and_marks_their_places(spark):
    texts, toxic = made(300, ["vileness", "scummy"], np.random.default_rng(1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    field = toxicity.train(docs, labels)
    asked = [(1, "A scummy, VILENESS of it. Fine."), (2, "lorem ipsum dolor"), (3, None), (4, ""), (5, "Ünï 😀 (vileness)")]
    got = {r.doc_id: r for r in toxicity.tag(spark.createDataFrame(asked, "doc_id long, text string"), field).collect()}
    assert [asked[0][1][s.start : s.end] for s in got[1].spans] == ["scummy, VILENESS"]
    assert [asked[4][1][s.start : s.end] for s in got[5].spans] == ["(vileness)"]
    assert got[1].score > 0.5 and got[2].score < 0.3 and got[3].score == got[4].score < 0.3 and got[2].spans == []


def test_copies_do_not_teach_their_words():
    rng = np.random.default_rng(2)
    texts, toxic = made(200, ["vileness"], rng)
    copied = "an unusual sentence about gardens and boats"
    texts += [copied] * 150
    toxic += [True] * 150
    split = [t.split() for t in texts]
    words = sorted({w for s in split for w in s})
    codes = np.array([words.index(w) for s in split for w in s])
    field = toxicity.fit(words, codes, np.r_[0, np.cumsum([len(s) for s in split])], np.array(toxic))
    odds = dict(zip(words, field.odds(words)))
    assert odds["vileness"] > 100 * odds["gardens"]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(None, 1)], [(1, None)], [(2, 1)]):
        field = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(0 <= r.score <= 1 and r.spans == [] for r in toxicity.tag(docs, field).collect())


def test_odd_rows(spark):
    texts, toxic = made(60, ["vileness"], np.random.default_rng(4))
    split = [t.split() for t in texts]
    words = sorted({w for s in split for w in s})
    field = toxicity.fit(words, np.array([words.index(w) for s in split for w in s]), np.arange(0, 1801, 30), np.array(toxic))
    got = toxicity.tag(cases.frame(spark), field).collect()
    assert sorted(((r.doc_id, r.n_words) for r in got), key=cases.key) == sorted(((r[0], len((r[1] or "").split())) for r in cases.rows()), key=cases.key)
    assert all(r.score < 0.3 for r in got)
    assert toxicity.tag(cases.empty(spark), field).collect() == []


def test_op11_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op11_toxic_spans"](spark, folder).collect()}
    labels = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(r.predicted, t) for r, t in labels if r.held_out]
    caught, false = [p for p, t in held if t], [p for p, t in held if not t]
    assert np.mean(caught) > 0.85 and np.mean(false) < 0.02
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
