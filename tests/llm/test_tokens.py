"""Encoding, prefix counts and packing against the tokenizers library."""

import hashlib
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import bpe_backtrack, packing, prefix_counts
from tallyloom.llm.wordbpe import Memo, public_path, vocabulary
from tests.llm import cases

LIBRARY = Tokenizer.from_file(public_path())
TEXT = st.text(st.one_of(st.sampled_from("aabehinrst lwvm'\"!?.,-019éüñßΣσİ́̈\xa0\x85\x1c\t\n<|>"), st.characters(exclude_categories=("Cs",))), max_size=40)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text):
    return np.frombuffer(bpe_backtrack.codec(public_path())[0].encode(text.encode()), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoding_is_exact(text):
    ids = library(text)
    assert own(text) == ids
    assert bpe_backtrack.codec(public_path())[1].decode(np.array(ids, np.int64)).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_every_prefix_is_counted(text):
    table = prefix_counts.counter(public_path())
    want = [len(library(text[:i])) for i in range(len(text) + 1)]
    assert table.prefixes(text.encode()).tolist() == want
    for limit in (0, 1, 5):
        assert table.kept(text.encode(), table.counts(text.encode()), limit) == max(i for i, c in enumerate(want) if c <= limit)


def test_prefixes_of_texts_without_blanks_end_in_time():
    import time

    rng = np.random.default_rng(4)
    table = prefix_counts.counter(public_path())
    han = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 1500)) + "\u3002" + "\u0441\u043b\u043e\u0432\u043e" * 40 + "\u0130\u03a3\uac00\u3042\u30ab" * 20
    want = [0, *(len(library(han[:to])) for to in range(1, len(han) + 1))]
    assert table.prefixes(han.encode()).tolist() == want
    assert table.kept(han.encode(), table.counts(han.encode()), 700) == max(i for i, c in enumerate(want) if c <= 700)
    long = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 300_000)).encode()
    started = time.time()
    counts = table.counts(long)
    kept = table.kept(long, counts, 2048)
    assert len(library(long.decode()[:kept])) <= 2048 < len(library(long.decode()[: kept + 1])) and time.time() - started < 30


def test_compatibility_is_what_merging_gives():
    words = vocabulary(public_path())
    rng = np.random.default_rng(3)
    open_tokens = [t for t, a in enumerate(words.atoms) if a and a.isascii() and a.isalpha()]
    for left, right in rng.choice(open_tokens, (400, 2)):
        text = words.atoms[left] + words.atoms[right]
        merged = [t.id for t in words.rules.model.tokenize(text + "zq")]
        if words.fits(int(left), int(right)) and words.atoms[merged[0]] == words.atoms[left]:
            assert merged[0] == left
    a = words.token["a"]
    assert ("aa" in words.token) != words.fits(a, a)


def test_memo_forgets_but_never_errs():
    asked = []

    def make(chunks):
        asked.extend(chunks)
        return [c * 2 for c in chunks]

    memo = Memo(make, 3)
    for chunks in ([b"a", b"b"], [b"c", b"d"], [b"a", b"b"], [b"a"], [b"e", b"f", b"g", b"h"], [], [b"a", b"h"]):
        assert memo.all_of(chunks) == [c * 2 for c in chunks]
    assert len(memo.new) <= 3 and len(memo.old) <= 3


def test_codec_rows(spark):
    got = sorted((tuple(r) for r in bpe_backtrack.digests(cases.frame(spark)).collect()), key=cases.key)
    want = []
    for r in cases.rows():
        ids = library(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=cases.key)
    assert bpe_backtrack.digests(cases.empty(spark)).count() == 0
    back = bpe_backtrack.decode(bpe_backtrack.encode(cases.frame(spark))).where("doc_id = 4").first()
    assert back["text"] == LIBRARY.decode(library(cases.TEXTS[4]))


def test_token_count_rows(spark):
    got = sorted((tuple(r) for r in prefix_counts.token_counts(cases.frame(spark), limit=10).collect()), key=cases.key)
    want = []
    for r in cases.rows():
        text = r[1] or ""
        n = len(library(text))
        kept = len(text) if n <= 10 else next(i for i in range(min(len(text), 400), -1, -1) if len(library(text[:i])) <= 10)
        want.append((r[0], len(text.encode()), n, n > 10, kept))
    assert got == sorted(want, key=cases.key)
    assert prefix_counts.token_counts(cases.empty(spark)).count() == 0
    table = prefix_counts.prefix_table(cases.frame(spark).where("doc_id = 4"))
    row = table.select(prefix_counts.longest_within("counts", 10).alias("kept")).first()
    assert row["kept"] == next(g[4] for g in got if g[0] == 4)


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_binary_lengths(n):
    sizes = packing.binary_lengths(n)
    assert sum(sizes) == n and all(s & (s - 1) == 0 and s <= packing.LIMIT for s in sizes) and sizes == sorted(sizes, reverse=True)
    assert len({s for s in sizes if s < packing.LIMIT}) == sum(s < packing.LIMIT for s in sizes)


def test_packing_rows(spark):
    docs = cases.frame(spark).repartition(3)
    got = packing.pack(docs, with_ids=True).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and all(r["offset"] == 0 for r in got)
    by_sequence = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_sequence] == sorted((r["length"] for r in got), reverse=True)
    want = []
    for r in cases.rows():
        ids = [*library(r[1] or ""), packing.END]
        at = 0
        for size in packing.binary_lengths(len(ids)):
            want.append((r[0], at, size, crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids), ids[at : at + size]))
            at += size
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]) for r in got), key=cases.key) == sorted(want, key=cases.key)
    assert packing.pack(cases.empty(spark)).count() == 0
