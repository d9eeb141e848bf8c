import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.functions.text import pretokens, strip
from tallyloom.operators import augment as A
from tallyloom.operators import bpe as V
from tallyloom.operators import corpus as C


def test_word_freq_example(spark):
    df = spark.createDataFrame([("The cat sat. The CAT ran! A dog, the dog?",)], "text string")
    assert [(r["word"], r["n"]) for r in C.word_freq(df, 3).collect()] == [("the", 3), ("cat", 2), ("dog", 2)]


def test_strip_and_pretokens_know_unicode(spark):
    df = spark.createDataFrame([("  café!? naïve_1\t\n",)], "t string")
    row = df.select(strip(F.col("t")).alias("s"), pretokens(F.col("t")).alias("p")).first()
    assert row["s"] == "café!? naïve_1" and row["p"] == ["café", "!?", "naïve_1"]


def test_discount(spark):
    df = spark.createDataFrame([(999, 15), (150, 25), (100, 0)], "c long, p long")
    assert [r[0] for r in df.select(C.half_up_discount(F.col("c"), F.col("p"))).collect()] == [849, 113, 100]


def test_padding_mask_and_pairs(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), ([5, 6, 7, 8, 9, 10],)], "ids array<int>")
    source, target = C.lm_pairs(F.col("ids"), 2, 3)
    rows = df.select(C.truncate_pad(F.col("ids"), 4, F.lit(0)).alias("p"), C.attention_mask(F.col("ids"), 4).alias("m"), source.alias("s"), target.alias("t")).collect()
    assert [r["p"] for r in rows] == [[1, 2, 3, 0], [0] * 4, [5, 6, 7, 8]]
    assert [r["m"] for r in rows] == [[1, 1, 1, 0], [0] * 4, [1] * 4]
    assert rows[0]["s"] == [2, 1, 2, 3] and rows[0]["t"] == [1, 2, 3, 3] and rows[1]["s"] == [2] and rows[1]["t"] == [3]


def test_recommend_length(spark):
    rows = [("a", 1, 128, 1.0, 10.0), ("a", 2, 256, 3.0, 100.0), ("a", 3, 512, 12.0, 120.0), ("b", 1, 128, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "cfg string, ord int, len int, secs double, mem double")
    assert {r["cfg"]: r["recommended"] for r in C.recommend_length(df, ["cfg"]).collect()} == {"a": 256, "b": None}


def test_memory_is_added_exactly(spark, tmp_path):
    # 1.50 in cents, which a running sum of doubles takes for 1.4999999999999998
    rows = [(1, 1, 1.0, p) for p in (0.35, 0.30, 0.18, 0.06, 0.12, 0.49)] + [(1, 2, 2.0, 2.0)]
    schema = "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in entry.queries()["recommend_length"](spark, str(tmp_path)).collect()] == [(1, 128)]


def test_word_positions(spark):
    text = "café, the café  the."
    row = spark.createDataFrame([(text,)], "t string").select(C.word_positions(F.col("t")).alias("w")).first()["w"]
    assert [(r["word"], r["start"]) for r in row] == [("café", 0), (",", 4), ("the", 6), ("café", 10), ("the", 16), (".", 19)]
    assert all(text[r["start"] : r["end"]] == r["word"] for r in row)


def test_word_positions_hold_few_objects(spark):
    import tracemalloc

    texts = ["ab, cd " * 100_000, None, "", "é ü"]
    tracemalloc.start()
    found = C.locate_words(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 300,000 words; an object for each, with its two numbers, took 83 MB
    assert peak < 40e6 and [len(f) for f in found] == [300_000, 0, 0, 2]
    assert found[3].as_py() == [{"word": "é", "start": 0, "end": 1}, {"word": "ü", "start": 2, "end": 3}]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(C.word_positions(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in rows] == [300_000, 0, 0, 2]


def learn_plainly(texts, size, specials):
    """One merge at a time."""
    counts = Counter(w for t in texts for w in re.findall(r"\w+|[^\w\s]+", t))
    words = {w: list(w) for w in counts}
    tokens = {t: i for i, t in enumerate([*specials, *sorted({c for w in counts for c in w})])}
    merges = []
    while len(tokens) < size:
        pairs = Counter()
        for w, parts in words.items():
            for pair in zip(parts, parts[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        tokens.setdefault(best[0] + best[1], len(tokens))
        for w, parts in words.items():
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            words[w] = out
    return tokens, merges


def test_bpe_equals_one_merge_at_a_time(spark):
    rng = random.Random(1)
    stems = ["an", "ban", "ana", "aaa", "nab", "the", "then", "he", "hen", "x!?!", "aab"]
    texts = [" ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(8)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens, merges = learn_plainly(texts, 60, V.SPECIALS)
    vocab = V.train_bpe(df, 60)
    assert vocab.merges == merges and vocab.tokens == tokens
    small_tokens, small_merges = learn_plainly(texts, 30, V.SPECIALS)
    assert vocab.first(30).tokens == small_tokens and vocab.first(30).merges == small_merges
    back = df.select("text", V.decode(V.encode(F.col("text"), vocab), vocab).alias("b")).collect()
    assert all(r["b"].replace(" ", "") == r["text"].replace(" ", "") for r in back)
    audit = V.roundtrip_audit(df, {"v": vocab}).first()
    same = sum(" ".join(p for w in t.split() for p in merged(w, merges)) == t for t in texts)
    # merges cut words, and decoding sets the parts apart
    assert (audit["n_same"], audit["n_same_letters"], audit["verdict"]) == (same, len(texts), "OK" if same == len(texts) else "BROKEN") and same < len(texts)


def merged(word, merges):
    out = []
    for run in re.findall(r"\w+|[^\w\s]+", word):
        parts = list(run)
        for pair in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == pair:
                    parts[i : i + 2] = ["".join(pair)]
                i += 1
        out += parts
    return out


def test_lossless_vocabulary_gives_every_text_back(spark):
    texts = ["the hen, then  the ban!?", " ban\tan\n\nana ", "", "nab the then", "  ", "x!?! x!?!\u00a0the"]
    unseen = ["\u6771\u4eac \U0001f600 the hen", "<0x41> caf\u00e9", "A\r\nB"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = V.train_bpe(df, 320, lossless=True)
    assert vocab.merges and any(t.startswith(" ") and len(t) > 1 for t in vocab.tokens)
    both = spark.createDataFrame([(t,) for t in texts + unseen], "text string")
    back = both.select("text", V.decode(V.encode(F.col("text"), vocab), vocab).alias("back"), V.encode(F.col("text"), vocab).alias("ids")).collect()
    assert all(r["back"] == r["text"] for r in back) and all(1 not in r["ids"] for r in back)
    assert tuple(V.roundtrip_audit(both, {"v": vocab}).first()) == ("v", 9, 9, 9, "OK")
    # one that loses blanks is found out
    torn = V.Vocabulary({t: i for t, i in vocab.tokens.items()}, vocab.merges, False)
    assert V.roundtrip_audit(both, {"v": torn}).first()["verdict"] == "BROKEN"
    small = vocab.first(290)
    assert small.lossless and V.roundtrip_audit(both, {"v": small}).first()["verdict"] == "OK"


def test_encode_marks_unknown_letters(spark):
    vocab = V.Vocabulary({"[PAD]": 0, "[UNK]": 1, "a": 2, "b": 3, "ab": 4}, [("a", "b")])
    df = spark.createDataFrame([("abab zb",)], "t string")
    assert df.select(V.encode(F.col("t"), vocab)).first()[0] == [4, 4, 1, 3]


def test_merges_of_a_long_word():
    import time

    rng = random.Random(4)
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("ca", "ab"), ("a", "a"), ("aa", "a"), ("abc", "aa")]
    rank = {pair: i for i, pair in enumerate(merges)}

    def plainly(parts):
        while found := [pair for pair in zip(parts, parts[1:]) if pair in rank]:
            pair, out, i = min(found, key=rank.get), [], 0
            while i < len(parts):
                both = tuple(parts[i : i + 2]) == pair
                out.append("".join(parts[i : i + 2]) if both else parts[i])
                i += 2 if both else 1
            parts = out
        return parts

    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))
        assert V.merged(word, rank) == plainly(list(word))
    # 8,000 different merges in one word: looking through all pairs for each took 60 s for the first 2,000
    letters = [chr(0x4E00 + i) for i in range(16_000)]
    ranks = {(x, y): i for i, (x, y) in enumerate(zip(letters[::2], letters[1::2]))}
    started = time.process_time()
    assert len(V.merged("".join(letters), ranks)) == 8_000 and time.process_time() - started < 5


def test_ids_take_four_bytes(spark):
    vocab = V.Vocabulary({t: i for i, t in enumerate([*V.SPECIALS, *V.BYTES, " ", "\u4e00"])}, [], True)
    texts = [None, "", "\u4e00 \u4e01", "\ufffd x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("ids", V.encode(F.col("t"), vocab))
    got = rows.select("id", "ids", V.decode(F.col("ids"), vocab, skip=()).alias("back")).orderBy("id").collect()
    assert [r["back"] for r in got] == texts and got[0]["ids"] is None and got[1]["ids"] == [] and got[2]["ids"] == [261, 260, *(4 + b for b in "\u4e01".encode())]


def test_synonyms_keep_the_rest_of_the_text(spark):
    docs = spark.createDataFrame([(1, "The big  house, a BIG house-boat!"), (2, "nothing to do"), (3, "house " * 300)], "id long, text string")
    tags = spark.createDataFrame([("big", "JJ"), ("house", "NN"), ("BIG", "NNP"), ("boat", "NN"), ("to", "NN")], "word string, tag string")
    lexicon = spark.createDataFrame(
        [("big", "a", "large"), ("big", "a", "very_large"), ("big", "a", "big"), ("house", "n", "home"), ("house", "n", "open house")], "word string, pos string, synonym string")
    got = {r["id"]: r for r in A.synonym_augment(docs, tags, lexicon, "id").collect()}
    assert got[1]["text"] == "The large  home, a BIG home-boat!" and got[1]["n_replaced"] == 3
    assert got[2]["text"] == "nothing to do" and got[2]["n_replaced"] == 0
    assert got[3]["n_replaced"] == 200 and got[3]["text"].count("home ") == 200 and got[3]["text"].count("house ") == 100
    # two slots: boat may use one up and gets nothing
    few = {r["id"]: r["n_replaced"] for r in A.synonym_augment(docs, tags, lexicon, "id", most=2).collect()}
    assert few[3] == 2 and few[1] in (1, 2)
    stats = {r["id"]: r["avg_replaced"] for r in A.augment_stats(spark.createDataFrame([(1, 3), (2, 0), (3, 6)], "id long, n_replaced int"), "id").collect()}
    assert stats == {1: 3.0, 2: 1.5, 3: 3.0}


def test_many_synonyms_in_a_long_text(spark):
    import time

    text = "house, " * 60_000
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    tags, lexicon = spark.createDataFrame([("house", "NN")], "word string, tag string"), spark.createDataFrame([("house", "n", "home")], "word string, pos string, synonym string")
    started = time.time()
    got = A.synonym_augment(docs, tags, lexicon, "id", most=6000).first()
    assert got["text"].count("home, ") == got["n_replaced"] == 6000 and got["text"].replace("home", "house") == text
    # looking through all replacements at each piece took longer
    assert time.time() - started < 12


def test_chat_layout(spark):
    df = spark.createDataFrame([("1+1?",)], "q string")
    row = df.select(C.chat_prompt(F.col("q"), "no_think").alias("p"), C.render_chat(C.chat_prompt(F.col("q"), "plain"), False).alias("r")).first()
    assert [m["role"] for m in row["p"]] == ["user"] and row["p"][0]["content"].startswith("1+1?")
    assert row["r"] == "<|system|>\nYou solve math problems.<|end|>\n<|user|>\n1+1?<|end|>\n"
