"""Index maintenance and search over documents, embeddings and the event log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyloom.operators import retrieval as R
from tallyloom.operators.contentindex import ContentIndex
from tallyloom.operators.searchindex import SearchIndex
from tallyloom.plans.registry import query
from tallyloom.plans.tables import Tables
from tallyloom.session import ensure_checkpoint_dir, scratch_dir

SIZE, OVERLAP = 200, 20
N_WORDS = r"len(regexp_extract_all(content, '\S+'))"
N_CHUNKS = f"CAST(CASE WHEN {N_WORDS} = 0 THEN 0 ELSE greatest(1, ceil(({N_WORDS} - {OVERLAP}) / {SIZE - OVERLAP}.0)) END AS BIGINT)"


@query("dedup_content", """
WITH d AS (SELECT *, sha256(content) AS sha FROM @rag_files)
SELECT sha AS sha256, min(path) AS path, count(*) AS n_paths, min(mtime) AS mtime, arg_min({'s': scope}, path).s AS scope FROM d GROUP BY sha""")
def _(t: Tables):
    return R.content_files(t.view("rag_files"))


@query("unique_contents", """
SELECT path, doc_id, sha256(content) AS sha256, length(content) AS n FROM @rag_files QUALIFY row_number() OVER (PARTITION BY sha256(content) ORDER BY path) = 1""")
def _(t: Tables):
    return R.unique_contents(t.view("rag_files")).select("path", "doc_id", "sha256", F.length("content").cast("long").alias("n"))


@query("canonical_path", "SELECT sha256(content) AS sha256, min(path) AS path FROM @rag_files GROUP BY 1")
def _(t: Tables):
    return R.canonical_path(R.content_locations(t.view("rag_files")))


@query("index_status", f"""
WITH o AS (SELECT path, sha256(content) AS sha FROM @rag_before), n AS (SELECT path, sha256(content) AS sha, {N_CHUNKS} AS n FROM @rag_files)
SELECT n.path, CASE WHEN o.sha = n.sha THEN -1 WHEN n.sha IN (SELECT sha FROM o) THEN -2 ELSE n.n END AS status FROM n LEFT JOIN o ON n.path = o.path""")
def _(t: Tables):
    return R.index_status(t.view("rag_files"), t.view("rag_before"), SIZE, OVERLAP)


@query("reindex", """
WITH o AS (SELECT path, sha256(content) AS was FROM @rag_before), n AS (SELECT path, sha256(content) AS now FROM @rag_files)
SELECT coalesce(n.path, o.path) AS path, now, was,
       CASE WHEN now IS NULL THEN 'dropped' WHEN was IS NULL THEN 'new' WHEN now = was THEN 'unchanged' ELSE 'changed' END AS status
FROM n FULL JOIN o ON n.path = o.path""")
def _(t: Tables):
    return R.reindex(t.view("rag_files"), t.view("rag_before")).select("path", "now", "was", "status")


@query("gc_content", """
SELECT sha256(content) AS sha256, min(path) AS path FROM @rag_files GROUP BY 1 HAVING count(*) FILTER (path LIKE '/mirror/%') = 0""")
def _(t: Tables):
    docs = t.view("rag_files")
    left = R.content_locations(docs).filter("path LIKE '/mirror/%'")
    return R.gc_content(R.content_files(docs), left).select("sha256", "path")


@query("chunk", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM @documents),
c AS (SELECT doc_id, ws, unnest(range(CAST(greatest(1, ceil((len(ws) - {OVERLAP}) / {SIZE - OVERLAP}.0)) AS BIGINT))) AS pos FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(pos AS INT) AS pos, array_to_string(ws[pos * {SIZE - OVERLAP} + 1 : pos * {SIZE - OVERLAP} + {SIZE}], ' ') AS chunk_text FROM c""")
def _(t: Tables):
    return R.chunk(t.documents.select("doc_id", F.col("text").alias("content")), SIZE, OVERLAP)


@query("root_scopes", """
SELECT p.path, arg_max({'r': root, 's': r.scope}, length(root)).r AS root, arg_max({'r': root, 's': r.scope}, length(root)).s AS scope
FROM @rag_files p LEFT JOIN @rag_roots r ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY p.path""")
def _(t: Tables):
    return R.root_scopes(t.view("rag_files").select("path"), t.view("rag_roots"))


@query("embedder_guard", """
WITH e AS (SELECT label, CASE WHEN label = 4 AND embedding[1] > 0 THEN 'large' ELSE 'small' END AS embedder FROM @embeddings)
SELECT label, count(DISTINCT embedder) AS n_embedders, count(DISTINCT embedder) = 1 AS valid FROM e GROUP BY label""")
def _(t: Tables):
    used = F.when((F.col("label") == 4) & (F.col("embedding")[0] > 0), "large").otherwise("small")
    return R.embedder_guard(t.embeddings.select("label", used.alias("embedder")), ["label"], "embedder")


COSINE = """s AS (SELECT q_id, vec_id AS chunk_id, round(list_cosine_similarity(CAST(q_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM @search_queries, @embeddings WHERE q_vec IS NOT NULL)"""


def _stored(t: Tables, name: str, tables: list[str], rows) -> SearchIndex:
    """The index of given tables below the shared folder, written when their files (names, sizes, times) are first met."""
    index = SearchIndex(t.spark, f"{ensure_checkpoint_dir(t.spark)}/{name}-{t.state(*tables)}")
    if not index.exists():
        index.write(rows(t))
    return index


def _vectors(t: Tables) -> SearchIndex:
    def rows(t):
        return t.embeddings.select(F.col("vec_id").cast("string").alias("unit"), F.lit(0).alias("pos"), F.col("vec_id").alias("chunk_id"), F.lit(None).cast("string").alias("chunk_text"),
                                   F.col("embedding").alias("vec"), F.lit("").alias("scope"), F.lit(None).cast("string").alias("path"))

    return _stored(t, "vectors", ["embeddings"], rows)


def _index(t: Tables) -> SearchIndex:
    return _stored(t, "search", ["documents", "embeddings"], _units)


@query("vector_topk", f"WITH {COSINE} SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10")
def _(t: Tables):
    return _vectors(t).nearest(t.view("search_queries").select("q_id", "q_vec"), 10).drop("bucket")


# one vector per label: the mean of its members
@query("centroid_topk", """
WITH p AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM @embeddings),
m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT label AS q_id, list(x ORDER BY i) AS q_vec FROM m GROUP BY label),
s AS (SELECT CAST(q_id AS BIGINT) AS q_id, vec_id AS chunk_id, round(list_cosine_similarity(q_vec, CAST(embedding AS DOUBLE[])), 6) AS score FROM c, @embeddings)
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""")
def _(t: Tables):
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = cells.groupBy(F.col("label").cast("long").alias("q_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q_vec"))
    return _vectors(t).nearest(means, 10).drop("bucket")


def _units(t: Tables):
    """Chunks of all documents, a document at a time; a document's vector stands for its first chunk."""
    docs = t.documents.select("doc_id", "lang", "source", F.col("text").alias("content"))
    pieces = R.chunk(docs, SIZE, OVERLAP)
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.lit(0).alias("pos"))
    scope = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return pieces.join(vectors, ["doc_id", "pos"], "left").select(
        F.col("doc_id").cast("string").alias("unit"), "pos",
        F.conv(F.substring(F.md5(F.concat_ws("/", "doc_id", "pos").cast("binary")), 1, 15), 16, 10).cast("long").alias("chunk_id"), "chunk_text", "vec", scope.alias("scope"),
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


def _chunks(t: Tables):
    return _units(t).select("chunk_id", "chunk_text", "vec", "scope", "path")


CHUNKS = rf"""w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '\S+') AS ws FROM @documents),
c0 AS (SELECT doc_id, lang, source, ws, unnest(range(CAST(greatest(1, ceil((len(ws) - {OVERLAP}) / {SIZE - OVERLAP}.0)) AS BIGINT))) AS pos FROM w WHERE len(ws) > 0),
chunks AS (SELECT CAST('0x' || substr(md5(doc_id || '/' || pos), 1, 15) AS BIGINT) AS chunk_id, array_to_string(ws[pos * {SIZE - OVERLAP} + 1 : pos * {SIZE - OVERLAP} + {SIZE}], ' ') AS chunk_text,
  embedding AS vec, CASE WHEN lang = 'en' THEN '' ELSE lang END AS scope, '/' || source || '/' || doc_id || '.txt' AS path
  FROM c0 LEFT JOIN @embeddings e ON e.vec_id = doc_id AND pos = 0)"""


def bm25_sql(source: str, k: int) -> str:
    term = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
    return f"""b1 AS (SELECT chunk_id, {term.format('chunk_text')} AS ts FROM {source}),
b2 AS (SELECT chunk_id, len(ts) AS n_terms, unnest(ts) AS term FROM b1),
b3 AS (SELECT chunk_id, term, count(*) AS tf, max(n_terms) AS n_terms FROM b2 GROUP BY ALL),
bq AS (SELECT q_id, unnest(list_distinct({term.format('q_text')})) AS term FROM @search_queries),
bt AS (SELECT count(*) AS n_all, avg(len(ts)) AS avg_len FROM b1),
bd AS (SELECT term, greatest(ln((n_all - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM b3, bt GROUP BY term, n_all),
bs AS (SELECT q_id, chunk_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms / avg_len))), 6) AS score
  FROM bq JOIN b3 USING (term) JOIN bd USING (term), bt GROUP BY q_id, chunk_id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM bs QUALIFY rank <= {k})"""


@query("bm25", f"WITH {CHUNKS}, {bm25_sql('chunks', 10)} SELECT q_id, chunk_id, score, rank FROM lexical")
def _(t: Tables):
    return _index(t).keyword(t.view("search_queries").select("q_id", "q_text"), 10).drop("bucket")


# always written anew: what the searches find when they first meet a folder
@query("build_index", f"WITH {CHUNKS}, " + r"""b1 AS (SELECT scope, len(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}_]+')) AS n FROM chunks)
SELECT coalesce(scope, '') AS scope, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_terms FROM b1 GROUP BY 1""")
def _(t: Tables):
    index = SearchIndex(t.spark, scratch_dir(t.spark, "index"))
    index.write(_units(t))
    return index.store.read("totals").groupBy("scope").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_terms").alias("n_terms"))


@query("postings", f"WITH {CHUNKS}, " + r"""b1 AS (SELECT chunk_id, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}_]+') AS ts FROM chunks),
b2 AS (SELECT chunk_id, len(ts) AS n_terms, unnest(ts) AS term FROM b1),
b3 AS (SELECT chunk_id, term, count(*) AS tf, max(n_terms) AS n_terms FROM b2 GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(n_terms) AS INT) AS longest FROM b3 GROUP BY term""")
def _(t: Tables):
    return _index(t).terms()


def hybrid_sql(source: str, k: int) -> str:
    return f"""vs AS (SELECT q_id, chunk_id, round(list_cosine_similarity(CAST(q_vec AS DOUBLE[]), CAST(vec AS DOUBLE[])), 6) AS score FROM @search_queries, {source} WHERE vec IS NOT NULL AND q_vec IS NOT NULL),
near AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 50),
{bm25_sql(source, 50)},
fu AS (SELECT q_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, count(*) AS n_lists FROM (SELECT q_id, chunk_id, rank FROM near UNION ALL SELECT q_id, chunk_id, rank FROM lexical) u GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY fused DESC, chunk_id) AS place FROM fu QUALIFY place <= {k})"""


@query("rrf", f"WITH {CHUNKS}, {hybrid_sql('chunks', 10)} SELECT q_id, chunk_id, fused, n_lists, place FROM fused")
def _(t: Tables):
    return _index(t).hybrid(t.view("search_queries"), 10).drop("bucket")


VISIBLE = "visible AS (SELECT * FROM chunks WHERE scope IN ('', 'fr'))"


@query("hybrid_query", f"WITH {CHUNKS}, {VISIBLE}, {hybrid_sql('visible', 6)} SELECT q_id, chunk_id, fused, n_lists, place FROM fused")
def _(t: Tables):
    return _index(t).hybrid(t.view("search_queries"), 6, scope="fr").drop("bucket")


@query("hybrid_sources", f"WITH {CHUNKS}, {hybrid_sql('chunks', 6)} SELECT DISTINCT q_id, path FROM fused JOIN chunks USING (chunk_id)")
def _(t: Tables):
    index = _index(t)
    return index.with_texts(index.hybrid(t.view("search_queries"), 6), "path").select("q_id", "path").distinct()


def shared_words(q_text: pd.Series, chunk_text: pd.Series) -> pd.Series:
    """Share of a query's words that the chunk has: a stand-in for a model that scores pairs."""
    def one(q, c):
        asked = set(q.lower().split())
        return len(asked & set(c.lower().split())) / max(1, len(asked))

    return pd.Series([one(q, c) for q, c in zip(q_text, chunk_text)], dtype="float64")


@query("rerank", f"WITH {CHUNKS}, {hybrid_sql('chunks', 20)}, " + r"""
p AS (SELECT q_id, chunk_id, fused, n_lists, place, list_distinct(regexp_extract_all(lower(q_text), '\S+')) AS qs, regexp_extract_all(lower(chunk_text), '\S+') AS cs
  FROM fused JOIN @search_queries USING (q_id) JOIN chunks USING (chunk_id)),
s AS (SELECT q_id, chunk_id, fused, n_lists, place, round(len([x for x in qs if list_contains(cs, x)]) / greatest(1, len(qs)), 6) AS second FROM p)
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY second DESC, chunk_id) AS reranked FROM s QUALIFY reranked <= 6""")
def _(t: Tables):
    return _index(t).hybrid(t.view("search_queries"), 6, scorer=shared_words).drop("bucket")


SESSIONS = """sess AS (SELECT source, session_id, min(ts) AS first_ts, min(id) AS first_id FROM @rag_queries WHERE session_id IS NOT NULL GROUP BY ALL),
seqs AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_ts, first_id) AS seq FROM sess),
labels2 AS (SELECT q.*, seq, CASE WHEN seq IS NULL THEN q.source ELSE q.source || '#' || seq END AS label FROM @rag_queries q LEFT JOIN seqs s ON q.source = s.source AND q.session_id = s.session_id)"""
LATEST = "latest AS (SELECT query_id, verdict, note FROM @rag_feedback QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, verdict DESC, note DESC) = 1)"


@query("number_sessions", f"WITH {SESSIONS} SELECT source, session_id, first_ts, first_id, seq FROM seqs")
def _(t: Tables):
    return R.number_sessions(t.view("rag_queries"))


@query("label_queries", f"WITH {SESSIONS} SELECT id, label FROM labels2")
def _(t: Tables):
    log = t.view("rag_queries")
    return R.label_queries(log, R.number_sessions(log)).select("id", "label")


@query("feedback", f"WITH {LATEST} SELECT * FROM latest")
def _(t: Tables):
    return R.latest_feedback(t.view("rag_feedback"))


@query("recent_log", f"WITH {SESSIONS}, {LATEST} SELECT id, ts, label, verdict, text FROM labels2 LEFT JOIN latest ON id = query_id ORDER BY ts DESC, id DESC LIMIT 50")
def _(t: Tables):
    return R.recent_log(t.view("rag_queries"), t.view("rag_feedback"), 50)


@query("usage_by_source", """
SELECT regexp_replace(source, '-hook$', '') AS agent, count(*) FILTER (NOT ends_with(source, '-hook')) AS own, count(*) FILTER (ends_with(source, '-hook')) AS hooked,
       count(DISTINCT session_id) AS sessions FROM @rag_queries GROUP BY 1""")
def _(t: Tables):
    return R.usage_by_source(t.view("rag_queries"))


@query("index_stats", f"""
WITH d AS (SELECT *, sha256(content) AS sha, {N_CHUNKS} AS n FROM @rag_files),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sha ORDER BY path) = 1)
SELECT 'paths' AS metric, '' AS key, count(*) AS value FROM d UNION ALL SELECT 'contents', '', count(*) FROM u
UNION ALL SELECT 'chunks', coalesce(scope, ''), CAST(sum(n) AS BIGINT) FROM u GROUP BY 2 UNION ALL SELECT 'queries', '', count(*) FROM @rag_queries
UNION ALL SELECT 'sessions', '', count(DISTINCT source || '|' || session_id) FROM @rag_queries UNION ALL SELECT 'source', source, count(*) FROM @rag_queries GROUP BY 2""")
def _(t: Tables):
    return R.index_stats(t.view("rag_files"), t.view("rag_queries"), SIZE, OVERLAP)


@query("export_queries", f"WITH {CHUNKS}, {hybrid_sql('chunks', 5)} " + """
SELECT q_id, q_text, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY place) AS chunk_ids FROM fused JOIN @search_queries USING (q_id) GROUP BY ALL""")
def _(t: Tables):
    q, index = t.view("search_queries"), _index(t)
    rows = R.nested(q, index.with_texts(index.hybrid(q, 5)))
    return rows.select("q_id", "q_text", F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.col("chunks.chunk_id").cast("array<string>"), ",").alias("chunk_ids"))


@query("sft_seed", f"WITH {CHUNKS}, {hybrid_sql('chunks', 5)}, {LATEST} " + """
SELECT q_id, q_text, string_agg(chunk_text, '|' ORDER BY place) AS context FROM fused JOIN @search_queries USING (q_id) JOIN chunks USING (chunk_id)
WHERE q_id IN (SELECT query_id FROM latest WHERE verdict = 'good') GROUP BY ALL""")
def _(t: Tables):
    # only queries rated good are searched
    q, index = R.rated_good(t.view("search_queries"), t.view("rag_feedback")), _index(t)
    rows = R.nested(q, index.with_texts(index.hybrid(q, 5)))
    return rows.select("q_id", "q_text", F.array_join(F.col("chunks.chunk_text"), "|").alias("context"))


# written as JSON lines and read back; the log's queries with these ids stand for the asked ones
@query("export_jsonl", f"WITH {CHUNKS}, {hybrid_sql('chunks', 5)}, {SESSIONS}, {LATEST}, " + """
lists AS (SELECT q_id, count(*) AS n, string_agg(chunk_id, ',' ORDER BY place) AS ids, md5(string_agg(chunk_text, '|' ORDER BY place)) AS texts FROM fused JOIN chunks USING (chunk_id) GROUP BY q_id)
SELECT l.id, l.ts, l.source, l.session_id, l.seq AS session_seq, l.label, verdict, note, coalesce(n, 0) AS n_chunks, coalesce(ids, '') AS chunk_ids, coalesce(texts, md5('')) AS texts_md5
FROM labels2 l LEFT JOIN latest ON l.id = query_id LEFT JOIN lists ON q_id = l.id WHERE l.id IN (SELECT q_id FROM @search_queries)""")
def _(t: Tables):
    log, q, index = t.view("rag_queries"), t.view("search_queries"), _index(t)
    found = index.with_texts(index.hybrid(q, 5))
    asked = log.join(q.select(F.col("q_id").alias("id")), "id", "left_semi")
    folder = scratch_dir(t.spark, "export")
    R.write_records(R.export_records(asked, R.number_sessions(log), found, t.view("rag_feedback")), folder)
    back = R.read_records(t.spark, folder)
    return back.select("id", "ts", "source", "session_id", "session_seq", "label", "verdict", "note", F.size("chunks").cast("long").alias("n_chunks"),
                       F.array_join(F.col("chunks.chunk_id").cast("array<string>"), ",").alias("chunk_ids"), F.md5(F.array_join("chunks.chunk_text", "|").cast("binary")).alias("texts_md5"))


# ---- an index of files, walked twice


def _walked(t: Tables, before, n_buckets: int = 16) -> ContentIndex:
    """The files of an earlier day are indexed, then the roots are walked again and find those of today."""
    index = ContentIndex(t.spark, scratch_dir(t.spark, "files"), n_buckets, SIZE, OVERLAP)
    roots = t.view("rag_roots")
    gone = roots.select(F.lit("/gone").alias("root"), F.lit(None).cast("string").alias("scope")).limit(1)
    index.index(before, roots.unionByName(gone))
    index.reindex(t.view("rag_files"))
    return index


ROOTED = """roots AS (SELECT root, scope FROM @rag_roots UNION ALL SELECT '/gone', NULL),
now AS (SELECT path, sha256(content) AS sha256, content FROM @rag_files WHERE EXISTS (SELECT 1 FROM roots WHERE starts_with(path, root || '/'))),
old AS (SELECT path, sha256(content) AS sha256 FROM @rag_before WHERE EXISTS (SELECT 1 FROM roots WHERE starts_with(path, root || '/'))),
scopes AS (SELECT p.path, arg_max({'s': r.scope}, length(root)).s AS scope FROM (SELECT path FROM now UNION SELECT path FROM old) p JOIN roots r ON starts_with(p.path, root || '/') GROUP BY p.path),
firsts AS (SELECT sha256, min(path) AS path FROM old GROUP BY 1 UNION ALL SELECT sha256, min(path) FROM now WHERE sha256 NOT IN (SELECT sha256 FROM old) GROUP BY 1)"""


# a content that was there keeps its scope; a new one takes that of its least path's root
@query("reindex_contents", f"""WITH {ROOTED}
SELECT n.sha256, min(n.path) AS path, count(*) AS n_paths, any_value(s.scope) AS scope, any_value({N_CHUNKS}) AS n_chunks
FROM now n JOIN firsts f ON n.sha256 = f.sha256 JOIN scopes s ON s.path = f.path GROUP BY n.sha256""")
def _(t: Tables):
    found = _walked(t, t.view("rag_before")).contents()
    return found.select("sha256", "path", "n_paths", "scope", F.col("n_chunks").cast("long").alias("n_chunks"))


@query("reindex_terms", rf"""WITH {ROOTED}, u AS (SELECT sha256, any_value(content) AS text FROM now GROUP BY 1),
w AS (SELECT sha256, regexp_extract_all(text, '\S+') AS ws FROM u),
c AS (SELECT sha256, ws, unnest(range(CAST(greatest(1, ceil((len(ws) - {OVERLAP}) / {SIZE - OVERLAP}.0)) AS BIGINT))) AS pos FROM w WHERE len(ws) > 0),
b1 AS (SELECT sha256, pos, regexp_extract_all(lower(array_to_string(ws[pos * {SIZE - OVERLAP} + 1 : pos * {SIZE - OVERLAP} + {SIZE}], ' ')), '[\p{{L}}\p{{N}}_]+') AS ts FROM c),
b2 AS (SELECT sha256, pos, len(ts) AS n, unnest(ts) AS term FROM b1), b3 AS (SELECT sha256, pos, term, count(*) AS tf, max(n) AS n FROM b2 GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(n) AS INT) AS longest FROM b3 GROUP BY term""")
def _(t: Tables):
    return _walked(t, t.view("rag_before")).terms()


# a few files differ: only the buckets of their contents are written again
FEW = "doc_id % 211 = 5"
BUCKET = "CAST('0x' || substr(md5(sha256), 1, 15) AS BIGINT) % 64"


@query("reindex_buckets", f"""WITH o AS (SELECT DISTINCT sha256(CASE WHEN {FEW} THEN content || ' draft' ELSE content END) AS sha256 FROM @rag_files),
n AS (SELECT DISTINCT sha256(content) AS sha256 FROM @rag_files),
d AS (SELECT DISTINCT {BUCKET} AS bucket FROM (SELECT sha256 FROM o WHERE sha256 NOT IN (SELECT sha256 FROM n) UNION ALL SELECT sha256 FROM n WHERE sha256 NOT IN (SELECT sha256 FROM o)) x)
SELECT CAST(b AS INT) AS bucket, CASE WHEN b IN (SELECT bucket FROM d) THEN 2 ELSE 1 END AS written FROM range(64) r(b)""")
def _(t: Tables):
    files = t.view("rag_files")
    before = files.withColumn("content", F.when(F.expr(FEW), F.concat("content", F.lit(" draft"))).otherwise(F.col("content")))
    index = _walked(t, before, 64)
    newest = index.store.manifests().where("of = 'postings'").groupBy("bucket").agg(F.max_by("written", "version").alias("written"))
    return newest.select("bucket", "written")
