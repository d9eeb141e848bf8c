"""A deduplicated document index with keyword and vector search for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import words
from tallyloom.operators.ordered import number_rows
from tallyloom.operators.splits import scope_filter

RRF_CONSTANT = 60
K1, B = 1.2, 0.75
QUERY_BLOCK, CHUNK_BLOCK = 1024, 65_536

# ---- content and locations ----------------------------------------------------------------------


def with_sha(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sha256", F.sha2("content", 256))


def content_files(docs: DataFrame) -> DataFrame:
    """One row per distinct content. The texts stay out of the aggregation: many copies cost a count."""
    return with_sha(docs).groupBy("sha256").agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("n_paths"), F.min("mtime").alias("mtime"),
        F.min_by(F.struct("scope"), "path")["scope"].alias("scope"))


def content_locations(docs: DataFrame) -> DataFrame:
    return with_sha(docs).select("path", "sha256")


def unique_contents(docs: DataFrame) -> DataFrame:
    """Text of each distinct content, read from its canonical path (a unique key, so no skew)."""
    kept = content_files(docs).select("path")
    return with_sha(docs).join(kept, "path", "left_semi")


def canonical_path(locations: DataFrame) -> DataFrame:
    return locations.groupBy("sha256").agg(F.min("path").alias("path"))


def n_chunks(text: Column, size: int, overlap: int) -> Column:
    n = F.regexp_count(text, F.lit(r"(?U)\S+"))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / (size - overlap)))).cast("long")


def chunk(docs: DataFrame, size: int, overlap: int, text: str = "content") -> DataFrame:
    """Content to ordered, overlapping runs of words."""
    step = size - overlap
    # looks at the first word only; a filter on the split words would make Spark split each text twice
    split = docs.filter(F.col(text).rlike(r"(?U)\S")).withColumn("_words", words(F.col(text)))
    count = F.greatest(F.lit(1), F.ceil((F.size("_words") - overlap) / step)).cast("int")
    # cut inside the row: exploding numbers first would copy all words into every chunk's row
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("_words", i * step + 1, F.lit(size)), " "))
    kept = [c for c in docs.columns if c != text]
    return split.select(*kept, F.posexplode(pieces).alias("pos", "chunk_text"))


def index_status(new: DataFrame, known: DataFrame, size: int, overlap: int) -> DataFrame:
    """Per path: -1 unchanged, -2 linked to known content, else the number of chunks to embed."""
    now = with_sha(new).withColumn("_chunks", n_chunks(F.col("content"), size, overlap)).select("path", "sha256", "_chunks")
    old = with_sha(known).select("path", F.col("sha256").alias("_old"))
    have = old.select(F.col("_old").alias("sha256")).distinct().withColumn("_known", F.lit(True))
    both = now.join(old, "path", "left").join(have, "sha256", "left")
    status = F.when(F.col("_old") == F.col("sha256"), -1).when(F.col("_known"), -2).otherwise(F.col("_chunks"))
    return both.select("path", status.cast("long").alias("status"))


def reindex(new: DataFrame, known: DataFrame) -> DataFrame:
    """Compare a fresh walk of the roots with the index: per path unchanged, changed, new or dropped."""
    now = with_sha(new).select("path", F.col("sha256").alias("now"))
    old = with_sha(known).select("path", F.col("sha256").alias("was"))
    status = (
        F.when(F.col("now").isNull(), "dropped").when(F.col("was").isNull(), "new")
        .when(F.col("now") == F.col("was"), "unchanged").otherwise("changed"))
    return now.join(old, "path", "full_outer").withColumn("status", status)


def apply_reindex(compared: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New locations, and the contents some location still points to."""
    locations = compared.filter("status <> 'dropped'").select("path", F.col("now").alias("sha256"))
    return locations, files.join(locations.select("sha256").distinct(), "sha256", "left_semi")


def gc_content(files: DataFrame, locations: DataFrame) -> DataFrame:
    """Contents that no location points to any more."""
    return files.join(locations.select("sha256").distinct(), "sha256", "left_anti")


def root_scopes(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Scope of the longest root above each path. Paths list their own ancestors, so it is an equi-join."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = paths.select("path", F.explode(ups).alias("root"))
    found = ancestors.join(roots, "root").groupBy("path").agg(
        F.max_by(F.struct("root", "scope"), F.length("root")).alias("_r"))
    return paths.select("path").join(found, "path", "left").select("path", F.col("_r.root").alias("root"), F.col("_r.scope").alias("scope"))


def embedder_guard(df: DataFrame, by: list[str], embedder: str) -> DataFrame:
    """Indexes must hold vectors of one embedder only."""
    return df.groupBy(*by).agg(F.count_distinct(embedder).alias("n_embedders"), (F.min(embedder) == F.max(embedder)).alias("valid"))


# ---- ranking ------------------------------------------------------------------------------------


def _top(scored: DataFrame, k: int, score: str, rank: str) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k for queries (q_id, q_vec) over chunks (chunk_id, vec).

    Both sides are cut into blocks, and each pair of blocks is one matrix product that gives k rows per query: one way for
    any number of queries. A query or chunk without a vector has no hits.
    """
    return _top(_topk_blocked(queries, chunks, k), k, "score", "rank")


SCORED = "q_id long, chunk_id long, score double"


def _topk_blocked(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    n_c = max(1, -(-chunks.count() // CHUNK_BLOCK))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    vec = "array<double>"
    left = queries.filter("q_vec IS NOT NULL").select("q_id", F.col("q_vec").cast(vec).alias("vec"), block("q_id", n_q).alias("qb"), copies(n_c).alias("cb"))
    right = chunks.filter("vec IS NOT NULL").select(
        "chunk_id", F.col("vec").cast(vec).alias("vec"), block("chunk_id", n_c).alias("cb"), copies(n_q).alias("qb"))

    def multiply(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"q_id": [], "chunk_id": [], "score": []}
        if len(q) and len(c):
            right_t, ids = _unit(np.array(c["vec"].tolist(), dtype=np.float64)).T, c["chunk_id"].to_numpy()
            for q_id, row in zip(q["q_id"], _unit(np.array(q["vec"].tolist(), dtype=np.float64))):
                s = np.round(row @ right_t, 6)
                keep = np.lexsort((ids, -s))[:k]
                out["q_id"] += [q_id] * len(keep)
                out["chunk_id"] += ids[keep].tolist()
                out["score"] += s[keep].tolist()
        return pd.DataFrame(out).astype({"q_id": "int64", "chunk_id": "int64", "score": "float64"})

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(multiply, SCORED)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """Term counts per chunk with the chunk's length: the stored keyword side of an index."""
    listed = chunks.select("chunk_id", terms(F.col("chunk_text")).alias("_t")).withColumn("n_terms", F.size("_t"))
    return listed.select("chunk_id", "n_terms", F.explode("_t").alias("term")).groupBy("chunk_id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.max("n_terms").alias("n_terms"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Keyword top-k for queries (q_id, q_text) over chunks (chunk_id, chunk_text).

    Postings of the asked terms are joined to the queries that ask them: one way for any number of queries. A query without
    a text has no hits.
    """
    return _top(_bm25_joined(queries, chunks), k, "score", "rank")


def _bm25_joined(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    asked = queries.select("q_id", F.explode(F.array_distinct(terms(F.col("q_text")))).alias("term"))
    sized = chunks.select("chunk_id", terms(F.col("chunk_text")).alias("_t")).withColumn("n_terms", F.size("_t"))
    n_all, avg_len = sized.agg(F.count(F.lit(1)), F.avg("n_terms")).first()
    counts = (
        sized.select("chunk_id", "n_terms", F.explode("_t").alias("term"))
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("n_terms").alias("n_terms")))
    seen_in = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarity = F.greatest(F.log((F.lit(n_all) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    asked = asked.join(seen_in.select("term", rarity.alias("idf")), "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.lit(avg_len)))
    return counts.join(asked, "term").groupBy("q_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def rrf(lists: list[DataFrame], k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Fuse ranked lists (q_id, chunk_id, rank): sum of 1 / (constant + rank)."""
    pooled = lists[0].select("q_id", "chunk_id", "rank")
    for other in lists[1:]:
        pooled = pooled.unionByName(other.select("q_id", "chunk_id", "rank"))
    fused = pooled.groupBy("q_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"), F.count(F.lit(1)).alias("n_lists"))
    return _top(fused, k, "fused", "place")


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def rerank(top: DataFrame, scorer: Scorer, k: int, pool: int = 20) -> DataFrame:
    """Reorder the best ``pool`` rows per query (q_id, chunk_id, place, q_text, chunk_text) by a second scorer."""
    score = F.pandas_udf(scorer, "double")
    scored = top.filter(F.col("place") <= pool).withColumn("second", F.round(score("q_text", "chunk_text"), 6))
    return _top(scored, k, "second", "reranked")


def hybrid_query(queries: DataFrame, chunks: DataFrame, k: int, *, scope: str | None = None, pool: int = 50,
                 sources_only: bool = False, scorer: Scorer | None = None) -> DataFrame:
    """Vector and keyword search fused, inside one scope; optionally reranked or reduced to paths."""
    visible = scope_filter(chunks, scope)
    near = vector_topk(queries.select("q_id", "q_vec"), visible.select("chunk_id", "vec"), pool)
    lexical = bm25(queries.select("q_id", "q_text"), visible.select("chunk_id", "chunk_text"), pool)
    if scorer is None:
        top = rrf([near, lexical], k)
    else:
        fused = rrf([near, lexical], 20)
        # at most 20 rows per query go back for their texts
        full = fused.join(queries.select("q_id", "q_text"), "q_id").join(visible.select("chunk_id", "chunk_text"), "chunk_id")
        top = rerank(full, scorer, k).drop("q_text", "chunk_text")
    if not sources_only:
        return top
    return top.join(visible.select("chunk_id", "path"), "chunk_id").select("q_id", "path").distinct()


# ---- query log ----------------------------------------------------------------------------------


def number_sessions(log: DataFrame) -> DataFrame:
    """Sessions of each source numbered by their first query. A busy source is numbered in pieces."""
    sessions = log.filter("session_id IS NOT NULL").groupBy("source", "session_id").agg(F.min("ts").alias("first_ts"), F.min("id").alias("first_id"))
    return number_rows(sessions, ["source"], ["first_ts", "first_id"], "seq")


def label_queries(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """``source#seq``, or the bare source without a session."""
    seqs = sessions.select("source", F.col("session_id").alias("_session"), "seq")
    # queries without a session get a key of their own: as NULLs they would all meet in one task
    keyed = log.withColumn("_session", F.coalesce("session_id", F.concat(F.lit("none "), F.col("id").cast("string"))))
    label = F.when(F.col("seq").isNull(), F.col("source")).otherwise(F.concat("source", F.lit("#"), F.col("seq").cast("string")))
    return keyed.join(seqs, ["source", "_session"], "left").withColumn("label", label).drop("_session")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last verdict on each query wins."""
    return feedback.groupBy("query_id").agg(F.max_by(F.struct("verdict", "note"), F.struct("ts", "verdict", "note")).alias("_f")).select("query_id", "_f.*")


def recent_log(log: DataFrame, feedback: DataFrame, n: int) -> DataFrame:
    """The last n queries with their label and feedback."""
    last = log.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    # sessions are numbered over the whole log; only n rows look theirs up
    named = label_queries(last, number_sessions(log))
    return named.join(latest_feedback(feedback), named["id"] == F.col("query_id"), "left").select("id", "ts", "label", "verdict", "text")


def usage_by_source(log: DataFrame) -> DataFrame:
    """Queries of each agent, asked by itself or injected by its hook."""
    hook = F.col("source").endswith("-hook")
    return log.groupBy(F.regexp_replace("source", "-hook$", "").alias("agent")).agg(
        F.count_if(~hook).alias("own"), F.count_if(hook).alias("hooked"), F.count_distinct("session_id").alias("sessions"))


def index_stats(docs: DataFrame, log: DataFrame, size: int, overlap: int) -> DataFrame:
    """Long table of (metric, key, value)."""
    files = content_files(docs).select("sha256", "scope", "path")
    texts = unique_contents(docs).select("sha256", n_chunks(F.col("content"), size, overlap).alias("n"))
    per_scope = files.join(texts, "sha256").groupBy(F.coalesce("scope", F.lit("")).alias("key")).agg(F.sum("n").alias("value"))

    def one(df: DataFrame, metric: str, value: Column) -> DataFrame:
        return df.agg(value.cast("long").alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "value")

    parts = [
        one(content_locations(docs), "paths", F.count(F.lit(1))),
        one(files, "contents", F.count(F.lit(1))),
        per_scope.select(F.lit("chunks").alias("metric"), "key", "value"),
        one(log, "queries", F.count(F.lit(1))),
        one(log.filter("session_id IS NOT NULL").select("source", "session_id").distinct(), "sessions", F.count(F.lit(1))),
        log.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("source").alias("metric"), "key", "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def export_rows(queries: DataFrame, retrieved: DataFrame, chunks: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """One row per query with its retrieved chunks nested in rank order (at most k of them).

    With feedback given, only queries rated good are kept: seeds of later training.
    """
    out = nested(queries, retrieved.join(chunks.select("chunk_id", "chunk_text"), "chunk_id"))
    return out if feedback is None else rated_good(out, feedback)


def nested(queries: DataFrame, full: DataFrame) -> DataFrame:
    """Queries with their rows (place, chunk_id, chunk_text) nested in rank order."""
    lists = full.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "chunk_text"))).alias("chunks"))
    return queries.select("q_id", "q_text").join(lists, "q_id")


def rated_good(queries: DataFrame, feedback: DataFrame) -> DataFrame:
    good = latest_feedback(feedback).filter("verdict = 'good'").select(F.col("query_id").alias("q_id"))
    return queries.join(good, "q_id", "left_semi")


def export_records(queries: DataFrame, sessions: DataFrame, retrieved: DataFrame, feedback: DataFrame) -> DataFrame:
    """One nested record per logged query: (id, ts, text, source, session_id, session_seq, label, verdict, note, chunks).

    ``queries`` are rows of the log, ``sessions`` their numbers, ``retrieved`` the chunks found for them (q_id, place, chunk_id, chunk_text). A
    query without a session has no number, one without feedback no verdict, one without hits an empty list.
    """
    named = label_queries(queries, sessions).withColumnRenamed("seq", "session_seq")
    rated = named.join(latest_feedback(feedback), named["id"] == F.col("query_id"), "left").drop("query_id")
    lists = retrieved.groupBy(F.col("q_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "chunk_text"))).alias("chunks"))
    none = F.array().cast("array<struct<place:long,chunk_id:long,chunk_text:string>>")
    return rated.join(lists, "id", "left").select(
        "id", "ts", "text", "source", "session_id", "session_seq", "label", "verdict", "note", F.coalesce("chunks", none).alias("chunks"))


RECORD = ("id long, ts long, text string, source string, session_id string, session_seq long, label string, verdict string, note string, "
          "chunks array<struct<place:long,chunk_id:long,chunk_text:string>>")


def write_records(records: DataFrame, folder: str, batch: int = 0) -> None:
    """JSON lines, one record each with its nulls spelt out; a batch is a folder of its own, replaced as a whole when it is written again."""
    lines = records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").text(f"{folder}/batch={batch:08d}")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECORD).json(f"{folder}/batch=*")
