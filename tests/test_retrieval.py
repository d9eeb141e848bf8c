import hashlib

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import retrieval as R
from tallyloom.operators.splits import scope_filter


def docs(spark, rows):
    return spark.createDataFrame(rows, "path string, content string, scope string, mtime long")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_content_is_kept_once(spark):
    d = docs(spark, [("/b", "same", "x", 2), ("/a", "same", None, 3), ("/c", "other", "", 1)])
    files = {r["sha256"]: (r["path"], r["n_paths"], r["scope"]) for r in R.content_files(d).collect()}
    assert files == {sha("same"): ("/a", 2, None), sha("other"): ("/c", 1, "")}
    assert {r["path"] for r in R.unique_contents(d).collect()} == {"/a", "/c"}
    left = R.content_locations(d.filter("path <> '/a'"))
    assert R.gc_content(R.content_files(d), left).count() == 0
    assert [r["path"] for r in R.gc_content(R.content_files(d), left.filter("path <> '/c'")).collect()] == ["/c"]


def test_index_status_and_reindex(spark):
    known = docs(spark, [("/a", "one two", None, 1), ("/gone", "old", None, 1), ("/chg", "before", None, 1)])
    new = docs(spark, [("/a", "one two", None, 1), ("/copy", "one two", None, 1), ("/chg", "w " * 5, None, 1), ("/empty", "", None, 1)])
    got = {r["path"]: r["status"] for r in R.index_status(new, known, 3, 1).collect()}
    assert got == {"/a": -1, "/copy": -2, "/chg": 2, "/empty": 0}
    compared = R.reindex(new, known)
    assert {r["path"]: r["status"] for r in compared.collect()} == {"/a": "unchanged", "/copy": "new", "/chg": "changed", "/gone": "dropped", "/empty": "new"}
    both = R.content_files(new.unionByName(known)).select("sha256")
    locations, files = R.apply_reindex(compared, both)
    assert locations.count() == 4 and {r["sha256"] for r in files.collect()} == {sha("one two"), sha("w " * 5), sha("")}


def test_chunks_overlap(spark):
    text = " ".join(str(i) for i in range(10))
    out = R.chunk(spark.createDataFrame([(1, text), (2, "a b"), (3, "")], "doc_id long, content string"), 4, 1)
    got = {(r["doc_id"], r["pos"]): r["chunk_text"] for r in out.collect()}
    assert got == {(1, 0): "0 1 2 3", (1, 1): "3 4 5 6", (1, 2): "6 7 8 9", (2, 0): "a b"}


def test_longest_root_wins(spark):
    paths = spark.createDataFrame([("/m/fr/a",), ("/m/x",), ("/q",), ("/mm/y",)], "path string")
    roots = spark.createDataFrame([("/m", "shared"), ("/m/fr", "fr"), ("/q", None)], "root string, scope string")
    got = {r["path"]: (r["root"], r["scope"]) for r in R.root_scopes(paths, roots).collect()}
    assert got == {"/m/fr/a": ("/m/fr", "fr"), "/m/x": ("/m", "shared"), "/q": ("/q", None), "/mm/y": (None, None)}


def test_scopes(spark):
    d = docs(spark, [("/a", "x", None, 1), ("/b", "x", "", 1), ("/c", "x", "agent1", 1), ("/d", "x", "agent2", 1)])
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(scope_filter(d, None)) == ["/a", "/b", "/c", "/d"]
    assert paths(scope_filter(d, "agent2")) == ["/a", "/b", "/d"]


def test_vector_topk_equals_brute_force_with_many_copies(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(400, 8))
    m[:150] = m[0]  # a third are copies of one vector
    m[399] = 0
    q = np.vstack([m[0], rng.normal(size=(4, 8))])
    chunks = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "chunk_id long, vec array<float>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "q_id long, q_vec array<float>")
    m32, q32 = m.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    norms = np.linalg.norm(m32, axis=1)
    unit = np.divide(m32, norms[:, None], out=np.zeros_like(m32), where=norms[:, None] > 0)
    scores = np.round((q32 / np.linalg.norm(q32, axis=1, keepdims=True)) @ unit.T, 6)
    want = {(i, int(c)): float(s[c]) for i, s in enumerate(scores) for c in np.lexsort((np.arange(400), -s))[:7]}
    got = {(r["q_id"], r["chunk_id"]): r["score"] for r in R.vector_topk(queries, chunks, 7).collect()}
    assert got == want


def test_blocked_search_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "CHUNK_BLOCK", 20)
    rng = np.random.default_rng(1)
    chunks = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(70)], "chunk_id long, vec array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(8)], "q_id long, q_vec array<float>")
    blocked = {(r["q_id"], r["rank"]): r["chunk_id"] for r in R.vector_topk(queries, chunks, 4).collect()}
    monkeypatch.undo()
    assert blocked == {(r["q_id"], r["rank"]): r["chunk_id"] for r in R.vector_topk(queries, chunks, 4).collect()} and len(blocked) == 32


def test_keyword_search_fusion_and_rerank(spark):
    texts = ["red fox", "red red dog", "blue dog", "green cat sat", "fox fox fox den", "old tree", "grey rock", "deep sea"]
    chunks = spark.createDataFrame([(i, t, [float(i == j) for j in range(8)], "" if i else "s", f"/{i}") for i, t in enumerate(texts)],
                                   "chunk_id long, chunk_text string, vec array<float>, scope string, path string")
    queries = spark.createDataFrame([(1, "Fox?", [1.0] + [0.0] * 7)], "q_id long, q_text string, q_vec array<float>")
    ranked = [r["chunk_id"] for r in R.bm25(queries, chunks, 5).orderBy("rank").collect()]
    assert ranked == [4, 0]
    silent = spark.createDataFrame([(7, None, None)], queries.schema)
    assert R.bm25(queries.unionByName(silent), chunks, 5).count() == 2 and R.vector_topk(queries.unionByName(silent), chunks, 5).count() == 5
    fused = R.hybrid_query(queries, chunks, 2)
    assert [r["chunk_id"] for r in fused.orderBy("place").collect()] == [0, 4]
    assert R.hybrid_query(queries, chunks, 9, scope="t").filter("chunk_id = 0").count() == 0
    assert {r["path"] for r in R.hybrid_query(queries, chunks, 2, sources_only=True).collect()} == {"/0", "/4"}

    def shortest(q_text, chunk_text):
        return -chunk_text.str.len().astype("float64")

    import pandas as pd

    shortest.__annotations__.update({"q_text": pd.Series, "chunk_text": pd.Series, "return": pd.Series})
    assert [r["chunk_id"] for r in R.hybrid_query(queries, chunks, 2, scorer=shortest).orderBy("reranked").collect()] == [0, 2]


def test_more_queries_than_a_block(spark):
    n = R.QUERY_BLOCK + 76
    chunks = spark.createDataFrame([(i, f"word{i} common", [float(i == j) for j in range(6)]) for i in range(6)], "chunk_id long, chunk_text string, vec array<float>")
    queries = spark.createDataFrame([(i, f"word{i % 6}", [float(i % 6 == j) for j in range(6)]) for i in range(n)], "q_id long, q_text string, q_vec array<float>")
    for found in (R.bm25(queries.select("q_id", "q_text"), chunks.select("chunk_id", "chunk_text"), 1), R.vector_topk(queries.select("q_id", "q_vec"), chunks.select("chunk_id", "vec"), 1)):
        assert {(r["q_id"], r["chunk_id"]) for r in found.collect()} == {(i, i % 6) for i in range(n)}


def test_chunks_of_a_very_long_document_have_ids_of_their_own(spark, tmp_path):
    from tallyloom.plans.retrieval import _chunks
    from tallyloom.plans.tables import Tables

    long = " ".join(f"w{i}" for i in range(220_000))
    spark.createDataFrame([(1, long, "en", "s"), (2, "one more", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = [r["chunk_id"] for r in _chunks(Tables(spark, str(tmp_path))).select("chunk_id").collect()]
    assert len(ids) > 1200 and len(set(ids)) == len(ids)


def test_sessions_and_feedback(spark):
    log = spark.createDataFrame([(1, 10, "q", "agent1", "u1"), (2, 11, "q", "agent1", "u1"), (3, 12, "q", "agent1", "u2"), (4, 13, "q", "agent2", "u3"), (5, 14, "q", "cli", None)],
                                "id long, ts long, text string, source string, session_id string")
    labels = {r["id"]: r["label"] for r in R.label_queries(log, R.number_sessions(log)).collect()}
    assert labels == {1: "agent1#1", 2: "agent1#1", 3: "agent1#2", 4: "agent2#1", 5: "cli"}
    fb = spark.createDataFrame([(3, "good", "a", 1), (3, "bad", "b", 2), (4, "good", "c", 1)], "query_id long, verdict string, note string, ts long")
    last = {r["id"]: r["verdict"] for r in R.recent_log(log, fb, 3).collect()}
    assert last == {5: None, 4: "good", 3: "bad"}
    usage = spark.createDataFrame([(1, "agent1", "s"), (2, "agent1-hook", "s"), (3, "cli", None)], "id long, source string, session_id string")
    assert {r["agent"]: (r["own"], r["hooked"]) for r in R.usage_by_source(usage).collect()} == {"agent1": (1, 1), "cli": (1, 0)}
