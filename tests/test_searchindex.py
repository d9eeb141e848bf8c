"""The stored index against the searches over plain frames, and its versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import retrieval as R
from tallyloom.operators.contentindex import ContentIndex
from tallyloom.operators.searchindex import CELL_CHUNKS, SearchIndex

CHUNKS = "unit string, pos int, chunk_id long, chunk_text string, vec array<double>, scope string, path string"


def rows(n, seed=0):
    """Texts with one word that nearly all hold, words of all frequencies, and copies; vectors in clusters, some missing or of another length."""
    rng, nums = random.Random(seed), np.random.default_rng(seed)
    centres = nums.normal(size=(6, 5)) * 4
    made = []
    for i in range(n):
        text = " ".join(["common"] * rng.randint(0, 2) + [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 12))]) if i % 7 else "common w1 w2"
        vec = (centres[i % 6] + nums.normal(size=5) * 0.2).tolist() if i % 5 else None if i % 10 else [1.0, 2.0] if i % 20 else [0.0] * 5
        made.append((f"u{i // 3}", i % 3, i * 7919 % 1_000_003, text if i % 11 else None, vec, [None, "", "fr", "de"][i // 3 % 4], f"/{i // 3}"))
    return made


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    frame = spark.createDataFrame(rows(4000), CHUNKS)
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), 2)
    index.write(frame)
    return frame.cache(), index


def queries(spark):
    made = [(1, "common w1", [1.0, 0.0, 0.0, 0.0, 0.0]), (2, "w1 w2 w3 w4 w5 w1", [0.0, -1.0, 2.0, 0.0, 1.0]), (3, "w40 w41 w42", [1.0, 1.0]), (4, None, None), (5, "unheard", [0.0] * 5), (6, "Common, W17!", [3.0, 1.0, 1.0, 1.0, 1.0])]
    return spark.createDataFrame(made, "q_id long, q_text string, q_vec array<double>")


def same(got, want):
    assert sorted((r.q_id, r["rank"], r.chunk_id, r.score) for r in got.collect()) == sorted((r.q_id, r["rank"], r.chunk_id, r.score) for r in want.collect())


@pytest.mark.parametrize("scope", [None, "fr", "nobody"])
def test_keyword_search_is_exact(spark, stored, scope):
    frame, index = stored
    q = queries(spark).select("q_id", "q_text")
    seen = frame.where("chunk_text IS NOT NULL")
    seen = seen if scope is None else seen.where(F.coalesce("scope", F.lit("")).isin("", scope))
    same(index.keyword(q, 9, scope), R.bm25(q, seen.select("chunk_id", "chunk_text"), 9))


@pytest.mark.parametrize("scope", [None, "fr"])
def test_vector_search_is_exact(spark, stored, scope):
    frame, index = stored
    seen = frame if scope is None else frame.where(F.coalesce("scope", F.lit("")).isin("", scope))
    for size in (2, 5):
        q = queries(spark).select("q_id", "q_vec").where(F.size("q_vec") == size)
        same(index.nearest(q, 8, scope), R.vector_topk(q, seen.where(F.size("vec") == size).select("chunk_id", "vec"), 8))
    assert index.nearest(queries(spark).select("q_id", "q_vec"), 8).where("q_id = 4").isEmpty()


def test_hybrid_equals_the_plain_one(spark, stored):
    frame, index = stored
    whole = frame.where("chunk_text IS NOT NULL AND (vec IS NULL OR size(vec) = 5)").select("chunk_id", "chunk_text", "vec", "scope", "path")
    small = SearchIndex(spark, index.store.folder + "-whole", 3)
    small.write(frame.where("chunk_text IS NOT NULL AND (vec IS NULL OR size(vec) = 5)"))
    q = queries(spark).where("q_id in (1, 2, 6)")
    got, want = small.hybrid(q, 5, scope="fr"), R.hybrid_query(q, whole, 5, scope="fr")
    assert sorted((r.q_id, r.place, r.chunk_id, r.fused, r.n_lists) for r in got.collect()) == sorted((r.q_id, r.place, r.chunk_id, r.fused, r.n_lists) for r in want.collect())


def test_searches_skip_cells_and_read_no_text(spark, stored):
    _, index = stored
    q = queries(spark)
    shares = {r.q_id: (r.n_scored, r.n_cells) for r in index.keyword_share(q.select("q_id", "q_text"), 3).collect()}
    assert set(shares) == {1, 2, 3, 6} and sum(s for s, _ in shares.values()) < sum(c for _, c in shares.values()), shares
    compared, skipped = index.nearest_share(q.where("q_id in (1, 2, 6)").select("q_id", "q_vec"), 3).first()
    assert skipped > compared > 0
    for found in (index.keyword(q.select("q_id", "q_text"), 3), index.nearest(q.select("q_id", "q_vec"), 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "chunk_text" not in plan and "/chunks/" not in plan


def test_a_common_term_is_many_rows(stored):
    _, index = stored
    lists = index.store.read("postings").where("term = 'common'")
    assert lists.count() >= lists.agg(F.sum("n")).first()[0] / CELL_CHUNKS and lists.agg(F.max("n")).first()[0] <= CELL_CHUNKS


def test_terms_equal_plain_postings(stored):
    frame, index = stored
    want = R.postings(frame.where("chunk_text IS NOT NULL")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("n_terms").alias("longest"))
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, want.collect()))


def test_empty_index(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), 2)
    assert not index.exists() and index.chunks().count() == 0
    index.write(spark.createDataFrame([], CHUNKS))
    q = queries(spark)
    assert index.exists() and index.keyword(q.select("q_id", "q_text"), 3).count() == 0 and index.nearest(q.select("q_id", "q_vec"), 3).count() == 0
    index.write(spark.createDataFrame(rows(30), CHUNKS))
    assert index.keyword(q.select("q_id", "q_text").limit(0), 3).count() == 0 and index.nearest(q.select("q_id", "q_vec").limit(0), 3).count() == 0


# ---- versions

FILES = "path string, content string, mtime long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def state(index):
    return {r.sha256: (r.path, r.n_paths, r.scope, r.n_chunks) for r in index.contents().collect()}


def words_of(index):
    return {r.term: r.df for r in index.terms().collect()}


def test_walks_update_and_drop(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path), 8, 3, 1)
    roots = spark.createDataFrame([("/a", None), ("/a/x", "x"), ("/b", "b")], "root string, scope string")
    first = [("/a/1", "one two three four", 1), ("/a/x/2", "one two three four", 2), ("/b/3", "five", 3), ("/b/4", "", 4), ("/c/5", "outside", 5)]
    status = {r.path: r.status for r in index.index(spark.createDataFrame(first, FILES), roots).collect()}
    assert status == dict.fromkeys(["/a/1", "/a/x/2", "/b/3", "/b/4"], "new")
    assert state(index) == {sha("one two three four"): ("/a/1", 2, None, 2), sha("five"): ("/b/3", 1, "b", 1), sha(""): ("/b/4", 1, "b", 0)}
    assert words_of(index) == {"one": 1, "two": 1, "three": 2, "four": 1, "five": 1}
    reader = ContentIndex(spark, str(tmp_path), 8, 3, 1)
    before = words_of(reader)
    # a plain walk of one root keeps what it does not see; a copy elsewhere keeps its content and its scope
    more = spark.createDataFrame([("/b/3", "six", 9), ("/b/9", "one two three four", 9)], FILES)
    status = {r.path: r.status for r in index.index(more, spark.createDataFrame([("/b", "other")], "root string, scope string")).collect()}
    assert status == {"/b/3": "changed", "/b/9": "new"}
    assert state(index) == {sha("one two three four"): ("/a/1", 3, None, 2), sha("six"): ("/b/3", 1, "other", 1), sha(""): ("/b/4", 1, "b", 0)}
    assert "five" not in words_of(index) and words_of(reader) == before
    # a second walk of all recorded roots drops what has gone
    now = spark.createDataFrame([("/a/x/2", "one two three four", 2), ("/b/3", "six", 9)], FILES)
    status = {r.path: r.status for r in index.reindex(now).collect()}
    assert status == {"/a/1": "dropped", "/a/x/2": "unchanged", "/b/3": "unchanged", "/b/4": "dropped", "/b/9": "dropped"}
    assert state(index) == {sha("one two three four"): ("/a/x/2", 1, None, 2), sha("six"): ("/b/3", 1, "other", 1)}
    index.reindex(now.limit(0))
    assert state(index) == {} and words_of(index) == {} and index.chunks().count() == 0


def test_only_touched_buckets_are_written_and_broken_runs_are_ignored(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path), 16, 5, 1)
    roots = spark.createDataFrame([("/a", None)], "root string, scope string")
    files = [(f"/a/{i}", f"text {i} of many", 1) for i in range(60)]
    index.index(spark.createDataFrame(files, FILES), roots)
    files[7] = ("/a/7", "another text", 2)
    # what a run that broke off left in the version to come
    index.store.write("postings", index.store.read("postings"), 2)
    index.reindex(spark.createDataFrame(files, FILES))
    version, written = index.store.versions()
    changed = {b for b, v in written["postings"].items() if v == 2}
    assert version == 2 and len(changed) <= 2 and [b for b, v in written["locations"].items() if v == 2] != [] and len(written["postings"]) == 16
    assert words_of(index)["another"] == 1 and words_of(index)["text"] == 60 and "7" not in words_of(index)
    # nothing differs: no bucket is written
    index.reindex(spark.createDataFrame(files, FILES))
    version, written = index.store.versions()
    assert version == 3 and 3 not in written["postings"].values() and 3 not in written["locations"].values()
    kept = words_of(index)
    assert index.store.vacuum() > 0 and words_of(index) == kept and index.store.manifests().select("version").distinct().count() == 1


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        rows = spark.range(400).selectExpr("CAST(id AS string) AS unit", "0 AS pos", "id AS chunk_id", "concat('common w', id) AS chunk_text", "CAST(NULL AS array<double>) AS vec", "'' AS scope", "CAST(NULL AS string) AS path")
        index = SearchIndex(spark, str(tmp_path / "i"), 1)
        index.write(rows)
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "i" / "chunks").rglob("*.parquet"))) > 1
    assert {r.term: r.df for r in index.terms().collect()} == {"common": 400, **{f"w{i}": 1 for i in range(400)}}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_dealt_out_to_meet_the_asked_terms(spark, stored):
    _, index = stored
    (asked,) = index._asked(queries(spark).select("q_id", "q_text"))
    cells, block = index._bounds(asked, 5, None)
    met = plan(index._scores(cells, block, None))
    assert "SortMergeJoin" not in met and "hashpartitioning(term" not in met
    # what is dealt out: the names of the cells, the postings there that were asked for, and the queries that want a cell
    assert met.count("hashpartitioning(bucket") == 3


def test_texts_are_looked_up_where_they_lie(spark, stored, monkeypatch):
    from tallyloom.operators import searchindex

    _, index = stored
    hits = index.keyword(queries(spark).select("q_id", "q_text"), 5)
    near = index.with_texts(hits)
    assert "Exchange hashpartitioning" not in plan(near)
    monkeypatch.setattr(searchindex, "FEW_ROWS", 0)
    far = index.with_texts(hits)
    key = lambda r: (r.q_id, r["rank"], r.chunk_id, r.chunk_text)
    assert sorted(map(key, near.collect())) == sorted(map(key, far.collect())) and near.count() == hits.count()


@pytest.mark.parametrize("most", [None, 0])
def test_a_walk_deals_out_no_text_to_meet_few_names(spark, tmp_path, monkeypatch, most):
    from tallyloom.operators import contentindex

    if most is not None:
        monkeypatch.setattr(contentindex, "FEW_NEW", most)
        monkeypatch.setattr(contentindex, "FEW_GONE", most)
    index = ContentIndex(spark, str(tmp_path), 4, 3, 1)
    plans, write = [], index.write_buckets
    monkeypatch.setattr(index, "write_buckets", lambda chunks, version: (plans.append(plan(chunks)), write(chunks, version)))
    files = [(f"/a/{i}", f"text {i} of some", 1) for i in range(20)]
    index.index(spark.createDataFrame(files, FILES), spark.createDataFrame([("/a", None)], "root string, scope string"))
    index.reindex(spark.createDataFrame(files[:9] + [("/a/9", "a new one", 2)], FILES))
    assert state(index) == {sha(t): (p, 1, None, 2 if " of " in t else 1) for p, t, _ in [*files[:9], ("/a/9", "a new one", 2)]}
    assert words_of(index)["text"] == 9 and "12" not in words_of(index)
    assert len(plans) == 2 and (most == 0 or not any("SortMergeJoin" in p for p in plans))
