"""SimHash, SpotSigs and nearest neighbours against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import ann, components, simhash, spotsigs
from tests.llm import cases


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.DISTANCE
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprints(spark):
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(cases.frame(spark)).where("doc_id IS NOT NULL").collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(cases.TEXTS)}


def test_links_are_complete(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = lambda f, n: f ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    fps = np.unique(np.r_[base, [flips(f, n) for f in base for n in (1, 2, 3, 4)], [flips(base[0], n) for n in (1, 2) for _ in range(300)], [base[1] ^ np.uint64(x) for x in range(500)]])
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    got = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")).collect()
    pairs = [tuple(sorted(((r["a"] & (1 << 64) - 1), (r["b"] & (1 << 64) - 1)))) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(int(fps[i]), int(fps[j])) for i, j in near}


def test_near_duplicates(spark):
    got = simhash.near_duplicates(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows())
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert of[0] == of[1] == of[2] == 0 and of[4] == of[5] == 4 and of[8] == 8
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["0", "None"]
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(300)
    edges = [(int(a), int(b)) for a, b in zip(order[:199], order[1:200])] + [(int(a), int(b)) for a, b in zip(order[200:], order[201:])]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {int(n): int(min(part)) for part in (order[:200], order[200:]) for n in part}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures():
    of = lambda t: set(spotsigs.signatures(t.encode()).tolist())
    assert not of("") and not of(" ... \n")
    assert of("the big dog barks") == of("THE big, dog! barks") != of("a big dog barks")
    assert len(of("lone")) == 1 and len(of("two words")) == 1
    text = "the cat sat on the mat and the dog ran to a house in the big old town"
    assert spotsigs.likeness(spotsigs.signatures(text.encode()), spotsigs.signatures((text + " again").encode())) > 0.6
    none = spotsigs.signatures(b"")
    assert spotsigs.likeness(none, none) == 1 and spotsigs.likeness(none, spotsigs.signatures(b"a b")) == 0
    a, b = np.arange(10, dtype=np.uint32), np.arange(4, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == 0.4 and spotsigs.likeness(a, b, 0.5) == 0


def test_beside_the_next_document(spark):
    got = [tuple(r)[:3] + (r["fingerprint"], r["near_next"]) for r in spotsigs.compare_with_next(cases.frame(spark).repartition(3)).collect()]
    placed = sorted((r[0], r[1] or "") for r in cases.rows() if r[0] is not None)
    want = []
    sig = lambda t: spotsigs.signatures(t.encode())
    for (i, text), (_, after) in zip(placed, placed[1:] + placed[:1]):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.spelt(sig(text)), spotsigs.likeness(sig(text), sig(after))))
    for text in ("no id", ""):
        edited = text[: len(text) - len(text) // 2]
        want.append((None, len(text), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.spelt(sig(text)), spotsigs.likeness(sig(text), sig(""))))
    assert sorted(got, key=cases.key) == sorted(want, key=cases.key)
    assert spotsigs.compare_with_next(cases.empty(spark)).count() == 0
    one = spotsigs.compare_with_next(spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def plain_signatures(text):
    """Chains as words, place by place."""
    words = [w.decode().lower().strip(spotsigs.MARKS) for w in text.encode().split()]
    words = [w for w in words if w]
    found = set()
    for i, word in enumerate(words):
        near = [w for w in words[max(0, i - spotsigs.GAP) : i] if w in spotsigs.ANCHORS]
        after = [w for w in words[i + 1 :] if w not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if (word in spotsigs.ANCHORS or not near) and len(after) == spotsigs.CHAIN:
            found.add((word, *after))
    if found or not words:
        return found
    n = spotsigs.CHAIN + 1
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_op2_equals_plain(spark, folder):
    from tallyloom.llm.queries import QUERIES

    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in QUERIES["op2_spotsigs"](spark, folder).collect()}
    assert len(got) == len(rows)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    spelt = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, other = map(plain_signatures, (text, edited, after))
        r = got[i]
        assert r["near_edited"] == pytest.approx(alike(own, changed)) and r["near_next"] == pytest.approx(alike(own, other))
        for sets, name in ((own, r["fingerprint"]), (changed, r["edited_fingerprint"])):
            assert spelt.setdefault(name, sets) == sets
    assert len(spelt) == len({frozenset(s) for s in spelt.values()})


def test_similar_sets(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [str(x) for x in rng.choice(words, 80)]
        texts += [" the ".join(base), " the ".join([*base[:-1], "changed"]), " the ".join(base[:40])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100, None), (101, texts[0])], "doc_id long, text string")
    classes, pairs = spotsigs.near_pairs(docs, 0.8)
    sets = [spotsigs.signatures(t.encode()) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if spotsigs.likeness(sets[i], sets[j]) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    of = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert of[101] == 0 and of[100] is None and len(of) == len(texts) + 2


def brute(vectors, k):
    fine = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    for q in (i for i in fine if i % 5 == 0):
        near = sorted(((-float(sum(a * b for a, b in zip(fine[q], fine[c]))), c) for c in fine if c != q))[:k]
        yield from ((q, r, c, -s) for r, (s, c) in enumerate(near, 1))


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    vectors += [(60 + i, vectors[3][1]) for i in range(6)] + [(70, None), (75, [0.0] * 8), (80, [1.0, None, *[0.0] * 6]), (85, [float("nan")] * 8), (90, [float("inf")] * 8), (95, [1.0] * 7), (100, []), (None, vectors[0][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in ann.search(frame, F.col("vec_id") % 5 == 0, 65).collect())
    want = sorted(brute(vectors, 65))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    assert ann.search(frame.where("vec_id < 0"), F.lit(True)).count() == 0
    assert ann.search(frame.where("vec_id = 5"), F.lit(True)).count() == 0


def test_recall(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0)
    rows = vectors.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    share = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        share.append(len(found[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(share) >= 0.9 and all(len(f) == 20 for f in found.values())


def test_retrieval_is_complete_within_the_radius():
    rng = np.random.default_rng(6)
    index, asked = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    for first, query, row in ann.retrieve(index, asked, 27, 3):
        apart = np.bitwise_count(index ^ asked[first : first + ann.STEP, None])
        got = np.zeros(apart.shape, bool)
        got[query, row] = True
        assert not (~got & (apart <= 27)).any() and (got.sum(1) >= 4).all()
