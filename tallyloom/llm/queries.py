"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from math import log2
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import ann, bpe_backtrack, chat, katz, packing, periodic_runs, prefix_counts, quality, repair, secret_scan, simhash, spotsigs, toxicity
from tallyloom.llm.common import crc_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


@query("op1_katz_backoff")
def op1_katz_backoff(spark, folder):
    return katz.score(table(spark, folder, "documents"))


@query("op2_spotsigs")
def op2_spotsigs(spark, folder):
    return spotsigs.compare_with_next(table(spark, folder, "documents"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    scored = quality.scores(docs, quality.train(docs, table(spark, folder, "labels")))
    held_out = F.coalesce(crc_of_id(quality.FOLDS) == quality.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _secret_sql() -> str:
    """The scan as SQL: places from the lengths of pieces and matches, entropy of every window from the counts of its characters."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = ((0, secret_scan.ASSIGN), (1, secret_scan.ACCESS), (2, secret_scan.HEX), (9, secret_scan.CANDIDATE))
    found = " UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, regexp_extract_all(text, {quoted(p)}) AS m, string_split_regex(text, {quoted(p)}) AS g FROM d WHERE regexp_matches(text, {quoted(p)})" for rank, p in patterns
    )
    w = secret_scan.WINDOW
    most = lambda least: int(secret_scan.UNIT * w * (log2(w) - least))
    whole = [p for p in secret_scan.ALLOWED if p not in secret_scan.SAMPLES]
    allowed = " OR ".join(f"regexp_matches(s, {quoted(p)})" for p in whole)
    # samples give way to blanks, one after the other; of ten equal characters, each character by itself
    cleared = "rest"
    for sample in secret_scan.SAMPLES:
        for one in sample.split("|"):
            if "\\1" in one:
                cleared = f"list_reduce(list_prepend({cleared}, list_distinct(string_split(rest, ''))), lambda p, c: replace(p, repeat(c, 10), repeat(' ', 10)))"
            else:
                cleared = f"replace({cleared}, {quoted(one)}, '{' ' * len(one)}')"
    classes = secret_scan.CLASSES
    case = lambda make: "CASE " + " ".join(f"WHEN regexp_matches(s, {quoted(c[1])}) THEN {make(c)}" for c in classes) + " END"
    spelt = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank, z)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
p AS (SELECT doc_id, rank, m, g, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT doc_id, rank, m[i] AS s, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS a FROM p),
base AS (SELECT doc_id, rank, a, a + length(s) AS z, ['assign', 'access', 'hex'][rank + 1] AS kind FROM s
  WHERE rank IN (1, 2) OR (rank = 0 AND length(regexp_extract(s, {quoted(secret_scan.ASSIGN)}, 2)) >= {secret_scan.ASSIGN_LEAST})),
run AS (SELECT doc_id, a, s, row_number() OVER () AS id FROM s WHERE rank = 9 AND NOT ({allowed})),
cut AS (SELECT run.id, any_value(run.doc_id) AS doc_id, any_value(run.a) AS a, any_value(run.s) AS s,
    list({{'s': '', 'a': greatest(b.a, run.a) - run.a, 'z': least(b.z, run.a + length(run.s)) - run.a}} ORDER BY b.a, b.rank) FILTER (b.a IS NOT NULL) AS bs
  FROM run LEFT JOIN base b ON b.doc_id = run.doc_id AND b.a < run.a + length(run.s) AND run.a < b.z GROUP BY run.id),
bare AS (SELECT doc_id, a, list_reduce(list_prepend({{'s': s, 'a': CAST(0 AS BIGINT), 'z': CAST(0 AS BIGINT)}}, coalesce(bs, [])),
    lambda p, x: {{'s': substr(p.s, 1, x.a) || repeat(' ', x.z - x.a) || substr(p.s, x.z + 1), 'a': CAST(0 AS BIGINT), 'z': CAST(0 AS BIGINT)}}).s AS rest FROM cut),
clear AS (SELECT doc_id, a, {cleared} AS rest FROM bare),
hits AS (SELECT doc_id, a AS a0, regexp_extract_all(rest, {quoted(secret_scan.CANDIDATE)}) AS m, string_split_regex(rest, {quoted(secret_scan.CANDIDATE)}) AS g FROM clear),
one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits),
part AS (SELECT doc_id, m[i] AS s, a0 + CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS a FROM one),
r AS (SELECT *, {case(lambda c: secret_scan.KINDS.index(c[0]))} AS k, {case(lambda c: most(c[3]))} AS most,
    {case(lambda c: "lower(s)" if c[0] == "entropy_hex" else "s")} AS t FROM part WHERE NOT ({allowed})),
w AS (SELECT doc_id, k, most, a, i, substr(t, i + 1, {w}) AS w FROM (SELECT *, unnest(range(length(t) - {w - 1})) AS i FROM r)),
h AS (SELECT *, list_sum([CAST(round({secret_scan.UNIT} * n * log2(n)) AS BIGINT) FOR n IN [length(w) - length(replace(w, c, '')) FOR c IN list_distinct(string_split(w, ''))]]) AS total FROM w),
e AS (SELECT doc_id, k AS rank, a + min(i) AS a, a + max(i) + {w} AS z, {list(secret_scan.KINDS)}[k + 1] AS kind FROM h WHERE total <= most GROUP BY doc_id, k, h.a),
every AS (SELECT * FROM base UNION ALL SELECT * FROM e),
b AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, {spelt} AS spans FROM base GROUP BY doc_id),
x AS (SELECT doc_id, {spelt} AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(x.spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)"""


@query("op4_secret_scan", _secret_sql())
def op4_secret_scan(spark, folder):
    return secret_scan.digests(table(spark, folder, "documents"))


@query("op5_bpe_codec")
def op5_bpe_codec(spark, folder):
    return bpe_backtrack.digests(table(spark, folder, "documents"))


@query("op6_packing")
def op6_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark, folder):
    return prefix_counts.token_counts(table(spark, folder, "documents"))


@query("op8_chat_format", r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens,
    length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS escaped,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) AS head
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + CASE WHEN opens THEN head + 23 ELSE 8 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
""")
def op8_chat_format(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.read_back(chat.format_conversations(rows.unionByName(more))))


@query("op9_simhash_dedup")
def op9_simhash_dedup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, folder):
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_toxic_spans")
def op11_toxic_spans(spark, folder):
    docs = table(spark, folder, "documents")
    tagged = toxicity.tag(docs, toxicity.train(docs, table(spark, folder, "labels")))
    held_out = F.coalesce(crc_of_id(toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    spelt = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return tagged.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_AT).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), spelt.alias("spans")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults by the hash of their place; null roles and texts are one blank. ``here`` marks the rows that are left."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("here"), F.explode(copies).alias("copy"))
    return made.drop("copy")


@query("op12_conversation_repair")
def op12_conversation_repair(spark, folder):
    return repair.summary(repair.repair(damaged(table(spark, folder, "conversations")), here="here"))


def looped_words(doc_id: int | None, raw: bytes) -> list[bytes]:
    """The words of a text; every tenth document by its hash repeats a stretch of them to its end. A row without an id stays as it is."""
    words = raw.split()
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


@query("op13_periodic_runs")
def op13_periodic_runs(spark, folder):
    found = periodic_runs.find_runs(table(spark, folder, "documents"), looped_words).withColumn("best", periodic_runs.strongest(F.col("runs")))
    spelt = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(spelt, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
