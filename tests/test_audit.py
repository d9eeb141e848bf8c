"""The round-trip audit of trained vocabularies against a plain encoder."""

import re

import __spark_entry__ as entry

from tallyloom.operators import bpe as V
from tallyloom.plans import learned
from tests.test_text import learn_plainly

TEXTS = ["banana", "the hen", " ab ", "then ananas ban", "a", "nab the banana", "x y z", "b"]


def plain_words(text, tokens, merges):
    for word in re.findall(r"\w+|[^\w\s]+", text):
        parts = list(word)
        for pair in merges:
            out, i = [], 0
            while i < len(parts):
                both = tuple(parts[i : i + 2]) == pair
                out.append("".join(parts[i : i + 2]) if both else parts[i])
                i += 2 if both else 1
            parts = out
        yield from (p if p in tokens else "[UNK]" for p in parts)


def test_trained_vocabularies_are_audited(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(learned, "VOCAB", 22)
    monkeypatch.setattr(learned, "SMALL_VOCAB", 16)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["tokenizer"]: r for r in entry.queries()["roundtrip_audit_trained"](spark, str(tmp_path)).collect()}
    assert set(got) == {"small", "large"}
    for name, size in (("small", 16), ("large", 22)):
        tokens, merges = learn_plainly(TEXTS, size, V.SPECIALS)
        same = sum(" ".join(plain_words(t, tokens, merges)) == t.strip() for t in TEXTS)
        r = got[name]
        assert (r["n"], r["n_same"], r["verdict"]) == (len(TEXTS), same, "OK" if same == len(TEXTS) else "BROKEN")
        assert merges
    assert got["large"]["n_same"] > got["small"]["n_same"]
