"""Corpus preparation, filters and splits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import n_words, pretokens
from tallyloom.operators import corpus as C
from tallyloom.operators import splits as S
from tallyloom.plans.registry import hash_sql, query
from tallyloom.plans.tables import Tables
from tallyloom.session import scratch_dir
from tallyloom.sources.files import read_split

PRE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


@query("head_rows", "SELECT doc_id, lang, text FROM @documents ORDER BY doc_id LIMIT 100")
def _(t: Tables):
    return S.head_rows(t.documents.select("doc_id", "lang", "text"), "doc_id", 100)


@query("select_columns", "SELECT doc_id, lang, n_chars FROM @documents")
def _(t: Tables):
    return t.documents.select("doc_id", "lang", "n_chars")


@query("read_split", "SELECT id, split, label, length(text) AS n_chars FROM @sentiment WHERE split = 'test'")
def _(t: Tables):
    folder = scratch_dir(t.spark, "sentiment")
    t.view("sentiment").write.partitionBy("split").parquet(folder)
    return read_split(t.spark, folder, "test").select("id", "split", "label", F.length("text").cast("long").alias("n_chars"))


@query("scope_filter", "SELECT path, scope, doc_id FROM @rag_files WHERE coalesce(scope, '') IN ('', 'fr')")
def _(t: Tables):
    return S.scope_filter(t.view("rag_files"), "fr").select("path", "scope", "doc_id")


@query("exclude_recent", """
WITH n AS (SELECT user_id, coalesce(prefs, []) AS prefs, coalesce(seen, []) AS seen FROM @learners),
p AS (SELECT user_id, prefs, list_slice(seen, greatest(1, len(seen) - 2), len(seen)) AS recent FROM n),
q AS (SELECT user_id, prefs, [x for x in prefs if NOT list_contains(recent, x)] AS fresh FROM p)
SELECT user_id, array_to_string(CASE WHEN len(fresh) = 0 THEN prefs ELSE fresh END, ',') AS available FROM q""")
def _(t: Tables):
    return t.view("learners").select("user_id", F.array_join(S.exclude_recent(F.col("prefs"), F.col("seen")), ",").alias("available"))


@query("truncation_filter", r"""
SELECT doc_id, model, len(regexp_extract_all(completion, '\S+')) AS n_tokens FROM @completions
WHERE len(regexp_extract_all(completion, '\S+')) >= 200 AND NOT contains(completion, '</answer>')""")
def _(t: Tables):
    cut = S.truncation_filter(t.view("completions"), "completion", n_words(F.col("completion")), 200)
    return cut.select("doc_id", "model", n_words(F.col("completion")).cast("long").alias("n_tokens"))


@query("seeded_shuffle", f"SELECT doc_id, lang, row_number() OVER (ORDER BY {hash_sql(42, 'doc_id')}, doc_id) AS position FROM @documents")
def _(t: Tables):
    return S.seeded_shuffle(t.documents.select("doc_id", "lang"), "doc_id", 42)


@query("shuffle_positions", "SELECT row_number() OVER (ORDER BY doc_id) AS position FROM @documents")
def _(t: Tables):
    return S.seeded_shuffle(t.documents.select("doc_id"), "doc_id", 42).select("position")


@query("split_sizes", """
SELECT unnest(['train', 'validation', 'test']) AS part, unnest([least(100, n), greatest(0, least(140, n) - 100), least(30, m)]) AS n, unnest([least(100, n), greatest(0, least(140, n) - 100), least(30, m)]) AS n_ids
FROM (SELECT count(*) FILTER (split = 'train') AS n, count(*) FILTER (split = 'test') AS m FROM @sentiment) c""")
def _(t: Tables):
    rows = t.view("sentiment").select("id", "split", "label")
    parts = S.train_val_test(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "id", 100, 40, 30, 42)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("train_val_test", f"""
WITH s AS (SELECT id, split, label, row_number() OVER (PARTITION BY split ORDER BY {hash_sql(42, 'id')}, id) AS position FROM @sentiment WHERE split IN ('train', 'test'))
SELECT *, CASE WHEN split = 'test' THEN 'test' WHEN position <= 100 THEN 'train' ELSE 'validation' END AS part FROM s WHERE position <= CASE WHEN split = 'test' THEN 30 ELSE 140 END""")
def _(t: Tables):
    rows = t.view("sentiment").select("id", "split", "label")
    return S.train_val_test(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "id", 100, 40, 30, 42)


@query("hash_choice", f"""
SELECT user_id, CASE WHEN len(prefs) > 0 THEN prefs[{hash_sql(7, 'user_id')} % len(prefs) + 1] END AS choice,
  array_to_string([x.x FOR x IN list_sort([{{'h': {hash_sql(7, 'user_id', '(i - 1)')}, 'i': i, 'x': prefs[i]}} FOR i IN range(1, len(prefs) + 1)])], ',') AS shuffled FROM @learners""")
def _(t: Tables):
    return t.view("learners").select("user_id", S.hash_choice(F.col("prefs"), F.col("user_id"), 7).alias("choice"),
                                     F.array_join(S.hash_shuffle(F.col("prefs"), F.col("user_id"), 7), ",").alias("shuffled"))


@query("pretokenize", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{PRE}'), ' ') AS tokens FROM @documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(pretokens(F.col("text")), " ").alias("tokens"))


@query("word_counts", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{PRE}')) AS word FROM @documents) w GROUP BY word")
def _(t: Tables):
    return C.word_counts(t.documents)


@query("word_freq", r"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\S+')) AS word FROM @documents) w
GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def _(t: Tables):
    return C.word_freq(t.documents, 25)


# token ids of a document for the array operators: the code points of its language and source names
IDS = "[ascii(c) for c in string_split(source || lang || source, '')]"


def _ids(t: Tables):
    name = F.concat("source", "lang", "source")
    return t.documents.select("doc_id", F.transform(F.split(name, ""), F.ascii).alias("ids"))


@query("truncate_pad", f"""
WITH i AS (SELECT doc_id, {IDS} AS ids FROM @documents)
SELECT doc_id, array_to_string(list_concat(ids[1:11], [0 for x in range(greatest(0, 11 - len(ids)))]), ',') AS padded FROM i""")
def _(t: Tables):
    return _ids(t).select("doc_id", F.array_join(C.truncate_pad(F.col("ids"), 11, F.lit(0)).cast("array<string>"), ",").alias("padded"))


@query("attention_mask", f"""
WITH i AS (SELECT doc_id, len({IDS}) AS n FROM @documents)
SELECT doc_id, repeat('1', CAST(least(n, 11) AS INT)) || repeat('0', CAST(11 - least(n, 11) AS INT)) AS mask FROM i""")
def _(t: Tables):
    return _ids(t).select("doc_id", F.array_join(C.attention_mask(F.col("ids"), 11).cast("array<string>"), "").alias("mask"))


@query("lm_pairs", f"""
WITH i AS (SELECT doc_id, list_concat([2], list_concat({IDS}, [3])) AS w FROM @documents)
SELECT doc_id, array_to_string(w[1:len(w) - 1], ',') AS inputs, array_to_string(w[2:len(w)], ',') AS targets FROM i""")
def _(t: Tables):
    source, target = C.lm_pairs(F.col("ids"), 2, 3)
    return _ids(t).select("doc_id", F.array_join(source.cast("array<string>"), ",").alias("inputs"), F.array_join(target.cast("array<string>"), ",").alias("targets"))


LENS = r"WITH l AS (SELECT len(regexp_extract_all(text, '\S+')) AS len FROM @documents)"


@query("length_stats", LENS + """
SELECT count(*) AS n, round(avg(len), 6) AS mean, round(quantile_cont(len, 0.5), 6) AS median, round(quantile_cont(len, 0.95), 6) AS p95,
       round(quantile_cont(len, 0.99), 6) AS p99, max(len) AS max_len, min(len) AS min_len, round(stddev_pop(len), 6) AS std FROM l""")
def _(t: Tables):
    out = C.length_stats(t.documents)
    return out.select("n", "max_len", "min_len", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99", "std")])


@query("length_histogram", LENS + """
, b AS (SELECT min(len) AS low, max(len) AS high FROM l)
SELECT CAST(least(floor((len - low) * 50.0::DOUBLE / (high - low)), 49) AS BIGINT) AS bin, count(*) AS n FROM l, b GROUP BY 1""")
def _(t: Tables):
    return C.length_histogram(t.documents, 50)


@query("length_ablation", LENS + """
, m AS (SELECT unnest([128, 256, 384, 512, 768, 1024]) AS max_len),
a AS (SELECT max_len, count(*) AS n, count(*) FILTER (len > max_len) AS n_cut, CAST(sum(least(len, max_len)) AS BIGINT) AS kept FROM l, m GROUP BY max_len)
SELECT CAST(max_len AS BIGINT) AS max_len, n_cut, kept, round(n_cut / n, 8) AS cut_share, round(1 - kept / (n * max_len), 8) AS pad_share FROM a""")
def _(t: Tables):
    out = C.length_ablation(t.documents, [128, 256, 384, 512, 768, 1024])
    return out.select("max_len", "n_cut", "kept", F.round("cut_share", 8).alias("cut_share"), F.round("pad_share", 8).alias("pad_share"))


# measured time and memory per candidate length come from the benchmark rows of each part supplier
@query("recommend_length", """
WITH r AS (SELECT l_suppkey AS cfg, l_linenumber AS ord, 128 * l_linenumber AS len, CAST(round(avg(l_quantity)) AS BIGINT) AS secs, CAST(round(sum(l_extendedprice)) AS BIGINT) AS mem FROM @lineitem GROUP BY 1, 2),
g AS (SELECT cfg, ord, len, secs * max(mem) OVER w / mem < max(secs) OVER w AS good FROM r WINDOW w AS (PARTITION BY cfg))
SELECT cfg, arg_min(len, ord) FILTER (good) AS recommended FROM g GROUP BY cfg""")
def _(t: Tables):
    # cents are added exactly: a sum of doubles depends on its order, and half a unit then rounds either way
    results = t.lineitem.groupBy(F.col("l_suppkey").alias("cfg"), F.col("l_linenumber").alias("ord")).agg(
        F.round(F.avg("l_quantity")).cast("long").alias("secs"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("mem")
    ).withColumn("len", 128 * F.col("ord"))
    return C.recommend_length(results, ["cfg"])


@query("check_lengths", r"""
SELECT lang, count(*) AS n, count(*) FILTER (len(regexp_extract_all(text, '\S+')) > 384) AS over_prompt,
       count(*) FILTER (len(regexp_extract_all(text, '\S+')) > 1024) AS over_seq FROM @documents GROUP BY lang""")
def _(t: Tables):
    return C.check_lengths(t.documents, 384, 1024, by=["lang"])


@query("word_positions", r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s+') AS pieces FROM @documents),
u AS (SELECT doc_id, unnest(pieces) AS word, generate_subscripts(pieces, 1) AS i FROM p),
o AS (SELECT doc_id, word, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS past FROM u)
SELECT doc_id, word, CAST(past - length(word) AS INT) AS start, CAST(past AS INT) AS "end" FROM o WHERE NOT regexp_matches(word, '^\s')""")
def _(t: Tables):
    return t.documents.select("doc_id", F.explode(C.word_positions(F.col("text"))).alias("w")).select("doc_id", "w.*")


TAGS_SYSTEM, TAGS_BEFORE = C.TEMPLATES["tags"][0], C.TEMPLATES["tags"][1].replace("\n", "' || chr(10) || '")


@query("chat_prompt", f"""
SELECT split, idx, 'system' AS role0, '{TAGS_SYSTEM}' AS content0, 'user' AS role1, '{TAGS_BEFORE}' || question AS content1 FROM @math_rows""")
def _(t: Tables):
    rows = t.view("math_rows").withColumn("p", C.chat_prompt(F.col("question"), "tags"))
    return rows.select("split", "idx", *[F.col("p")[i][f].alias(f"{f}{i}") for i in (0, 1) for f in ("role", "content")])


@query("render_chat", f"""
SELECT split, idx, '<|system|>' || chr(10) || '{TAGS_SYSTEM}' || '<|end|>' || chr(10) || '<|user|>' || chr(10) || '{TAGS_BEFORE}' || question || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM @math_rows""")
def _(t: Tables):
    return t.view("math_rows").select("split", "idx", C.render_chat(C.chat_prompt(F.col("question"), "tags")).alias("prompt"))


@query("half_up_discount", """
SELECT l_orderkey, l_linenumber, CAST(floor((CAST(round(l_extendedprice * 100) AS HUGEINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * 2 + 100) / 200) AS BIGINT) AS discounted FROM @lineitem""")
def _(t: Tables):
    cents, pct = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    return t.lineitem.select("l_orderkey", "l_linenumber", C.half_up_discount(cents, pct).alias("discounted"))
