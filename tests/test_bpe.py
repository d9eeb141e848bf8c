"""Vocabularies over arrays of letters against the word-by-word way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import bpe as V
from tallyloom.plans import learned
from tests.test_text import learn_plainly, merged

MERGES = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("ca", "ab"), ("a", "a"), ("aa", "a"), ("abc", "aa"), ("a", "bc"), ("aa", "aa"), (" ", "a"), (" a", "b"), ("!", "a"), ("!", "!")]


def word_by_word(coder, text):
    import re

    shape = re.compile(V.LOSSLESS if coder.vocab.lossless else V.PLAIN)
    return b"".join(coder.word(m.group()) for m in shape.finditer(text))


@pytest.mark.parametrize("lossless", [False, True])
def test_texts_together_and_word_by_word(lossless, monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    for size in (7, 30, 1 << 18) * 30:
        monkeypatch.setattr(V, "BLOCK_LETTERS", size)
        merges = rng.sample(MERGES, len(MERGES))
        tokens = {t: i for i, t in enumerate(["[UNK]", *(V.BYTES if lossless else ()), *sorted({x for a, b in merges for x in (a, b, a + b)})])}
        coder = V._Encoder(V.Vocabulary(tokens, merges, lossless), "[UNK]")
        texts = ["".join(rng.choice("aaabbcd !? \té \U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(6)]
        got = [b""] * len(texts)
        for part, at in V._stretches(pa.array(texts)):
            assert sum(map(len, part)) < size + 61
            ids, each = coder.together(part)
            for i, piece in zip(at, np.split(ids, np.cumsum(each)[:-1])):
                got[i] += piece.tobytes()
        assert got == [word_by_word(coder, t) for t in texts]


def test_many_merges_go_by_words(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, ""] + [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(20)) for _ in range(30)]
    tokens, merges = learn_plainly([t for t in texts if t], 40, V.SPECIALS)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = []
    for passes in (V.PASSES, 0):
        monkeypatch.setattr(V, "PASSES", passes)
        found.append(sorted(map(tuple, df.select("id", V.encode(F.col("text"), V.Vocabulary(tokens, merges)).cast("string").alias("ids")).collect())))
    assert found[0] == found[1] and found[0][0][1] is None and found[0][1][1] == "[]"


def test_an_audit_reads_each_text_once(spark, tmp_path):
    texts = ["banana", "the hen", " ab ", None, "a", "x y  z!"]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts")
    vocab = V.train_bpe(df, 40)
    audit = V.roundtrip_audit(df, {"small": vocab.first(15), "large": vocab})
    plan = audit._jdf.queryExecution().executedPlan().toString()
    # one scan and one Python pass for both, in which the ids stay: there were two scans and four passes
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1
    same = {n: sum(" ".join(merged(t, learn_plainly([t for t in texts if t], n, V.SPECIALS)[1])) == t.strip() for t in texts if t) for n in (15, 40)}
    assert sorted(map(tuple, audit.collect())) == [("large", 6, same[40], 5, "BROKEN"), ("small", 6, same[15], 5, "BROKEN")] and same[15] < same[40]
    assert V.roundtrip_audit(df.where("false"), {"large": vocab}).collect() == []


def test_a_round_of_training_is_one_job(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(9)) for _ in range(30)]
    monkeypatch.setattr(V, "BLOCK_LETTERS", 40)
    monkeypatch.setattr(V, "ROUNDS_PER_CHECKPOINT", 3)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    stored = []
    monkeypatch.setattr(V, "_stored", lambda rows, name, keep=V._stored: stored.append(name) or keep(rows, name))
    rounds = []
    monkeypatch.setattr(V, "independent_prefix", lambda *a, keep=V.independent_prefix, **k: rounds.append(1) or keep(*a, **k))
    vocab = V.train_bpe(df, 60)
    assert (vocab.tokens, vocab.merges) == learn_plainly(texts, 60, V.SPECIALS)
    # only the words are written, every few rounds: the table of pairs was written in each
    assert set(stored) == {"words"} and len(stored) <= 1 + len(rounds) // 3


def test_encode_trains_and_gives_the_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(learned, "VOCAB", 22)
    texts = ["banana", "the hen", "then ananas ban", "", None, "nab the banana"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    trained = []
    monkeypatch.setattr(V, "train_bpe", lambda *a, keep=V.train_bpe, **k: trained.append(1) or keep(*a, **k))
    entry.queries()["roundtrip_audit_trained"](spark, str(tmp_path))
    got = {r["doc_id"]: r for r in entry.queries()["encode"](spark, str(tmp_path)).collect()}
    # it took the vocabulary that the audit had trained
    assert len(trained) == 2
    tokens, merges = learn_plainly([t for t in texts if t], 22, V.SPECIALS)
    assert merges and len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = None if text is None else [tokens[p] for p in merged(text, merges)]
        # the ids themselves were left out
        assert got[i]["ids"] == ids
        if ids:
            assert (got[i]["n_ids"], got[i]["low"], got[i]["high"]) == (len(ids), min(ids), max(ids))
