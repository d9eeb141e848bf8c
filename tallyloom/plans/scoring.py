"""Answer extraction, rewards and evaluation reports over the derived completions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rewards as R
from tallyloom.functions.answers import after_hashes, extract_answer, is_integer_like, safe_float
from tallyloom.operators import evaluation as ev
from tallyloom.plans.registry import query
from tallyloom.plans.tables import Tables

TAG = r"(?s)<answer>(.*?)</answer>"
NUM = r"-?(?:\d{1,3}(?:[ ,]\d{3})+|\d+)(?:\.\d+)?"
MIX = r"^(-?\d+)\s+(\d+)\s*/\s*(\d+)$"


def extraction_sql(source: str, text: str, mixed: bool = True) -> str:
    """Oracle steps for the extractor: adds ``found`` (text) and ``found_n`` (number)."""
    first = (
        rf"CASE WHEN has_tag AND regexp_matches(body, '{MIX}') AND CAST(regexp_extract(body, '{MIX}', 3) AS BIGINT) <> 0 THEN "
        rf"(CASE WHEN body[1] = '-' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (abs(CAST(regexp_extract(body, '{MIX}', 1) AS DOUBLE)) "
        rf"+ CAST(regexp_extract(body, '{MIX}', 2) AS DOUBLE) / CAST(regexp_extract(body, '{MIX}', 3) AS DOUBLE)) END"
        if mixed else "CAST(NULL AS DOUBLE)"
    )
    return rf"""
ext_a AS (SELECT *, regexp_matches({text}, '{TAG}') AS has_tag,
                 regexp_replace(regexp_extract({text}, '{TAG}', 1), '^\s+|\s+$', '', 'g') AS body FROM {source}),
ext_b AS (SELECT *, regexp_replace(regexp_replace(body, '[$€£\s]', '', 'g'), ',', '', 'g') AS bare, {first} AS mixed_n FROM ext_a),
ext_c AS (SELECT *, CASE WHEN mixed_n IS NOT NULL THEN CAST(mixed_n AS VARCHAR)
                         WHEN has_tag AND regexp_matches(bare, '^-?\d+(\.\d+)?$') THEN bare
                         WHEN contains({text}, '####') THEN replace(regexp_replace(split_part({text}, '####', 2), '^\s+|\s+$', '', 'g'), ',', '')
                         ELSE replace(replace(regexp_extract_all({text}, '{NUM}')[-1], ',', ''), ' ', '') END AS found FROM ext_b),
ext AS (SELECT *, TRY_CAST(found AS DOUBLE) AS found_n FROM ext_c)
"""


SCORED = "WITH " + extraction_sql("@completions", "completion")
TRUE_N = "CAST(answer AS DOUBLE)"
SOFT = r"regexp_matches(completion, '(?s)<reasoning>.*?</reasoning>\s*<answer>.*?</answer>')"
RIGHT = f"(found IS NOT NULL AND found_n IS NOT DISTINCT FROM {TRUE_N})"

REWARD_SQL = {
    "correctness": f"CASE WHEN found_n IS NOT DISTINCT FROM {TRUE_N} THEN 2.0 ELSE 0.0 END",
    "integer": r"CASE WHEN coalesce(regexp_matches(found, '^\s*[+-]?\d+\s*$'), false) THEN 0.5 ELSE 0.0 END",
    "strict_reasoning": r"CASE WHEN regexp_full_match(completion, '(?s)<reasoning>\s*.*?\s*</reasoning>\s*<answer>\s*.*?\s*</answer>\s*') THEN 0.5 ELSE 0.0 END",
    "strict_think": r"CASE WHEN regexp_full_match(completion, '(?s)<think>\s*.*?\s*</think>.*?<answer>\s*.*?\s*</answer>\s*') THEN 0.5 ELSE 0.0 END",
    "strict_answer": r"CASE WHEN regexp_full_match(completion, '(?s).*<answer>\s*.*?\s*</answer>\s*') THEN 0.5 ELSE 0.0 END",
    "soft": f"CASE WHEN {SOFT} THEN 0.5 ELSE 0.0 END",
    "xml_count": " + ".join(f"CASE WHEN contains(completion, '{t}') THEN 0.125 ELSE 0.0 END" for t in R.FORMAT_TAGS),
    "starts_reasoning": r"CASE WHEN starts_with(regexp_replace(completion, '^\s+', ''), '<reasoning>') THEN 1.0 ELSE 0.0 END",
    "starts_think": r"CASE WHEN starts_with(regexp_replace(completion, '^\s+', ''), '<think>') THEN 1.0 ELSE 0.0 END",
    "has_think": "CASE WHEN contains(completion, '<think>') AND contains(completion, '</think>') THEN 0.5 ELSE 0.0 END",
    "has_answer": "CASE WHEN regexp_matches(completion, '(?s)<answer>.*?</answer>') THEN 0.5 ELSE 0.0 END",
    "overlong": r"CASE WHEN len(regexp_extract_all(completion, '\S+')) > 1036 THEN -0.5 ELSE 0.0 END",
}


def set_sql(name: str) -> str:
    return " + ".join(f"({REWARD_SQL[n]})" for n in R.REWARD_SETS[name])


@query("accuracy_by_language", SCORED + f"""
SELECT lang, count(*) AS n, count(*) FILTER ({RIGHT}) AS n_correct, count(*) FILTER ({SOFT}) AS n_formatted,
       round(count(*) FILTER ({RIGHT}) * 100.0::DOUBLE / count(*), 2) AS accuracy_pct,
       round(count(*) FILTER ({SOFT}) * 100.0::DOUBLE / count(*), 2) AS format_pct
FROM ext GROUP BY lang""")
def _(t: Tables):
    return ev.eval_accuracy(t.view("completions"), ["lang"])


# the number is what the two engines agree on; a mixed fraction prints differently as text
@query("extract_answer", SCORED + "SELECT doc_id, CASE WHEN mixed_n IS NULL THEN found END AS found_text, found_n FROM ext")
def _(t: Tables):
    df = extract_answer(t.view("completions"), "completion", "found")
    df = extract_answer(df, "completion", "plain", mixed=False)
    number = safe_float(F.col("found"))
    is_mixed = ~F.col("found").eqNullSafe(F.col("plain"))
    return df.select("doc_id", F.when(~is_mixed, F.col("found")).alias("found_text"), number.alias("found_n"))


@query("extract_answer_basic", "WITH " + extraction_sql("@completions", "completion", mixed=False) + "SELECT doc_id, found, found_n FROM ext")
def _(t: Tables):
    df = extract_answer(t.view("completions"), "completion", "found", mixed=False)
    return df.select("doc_id", "found", safe_float(F.col("found")).alias("found_n"))


@query("canonical_answer", r"""
SELECT split, idx, replace(regexp_replace(split_part(answer, '####', 2), '^\s+|\s+$', '', 'g'), ',', '') AS plain FROM @math_rows""")
def _(t: Tables):
    return t.view("math_rows").select("split", "idx", after_hashes(F.col("answer")).alias("plain"))


@query("safe_float", r"""
WITH raw AS (SELECT doc_id, regexp_extract(text, '[^\s]+$') AS word, CAST(n_chars AS VARCHAR) || ',000' AS amount FROM @documents)
SELECT doc_id, TRY_CAST(CASE WHEN regexp_matches(replace(word, ',', ''), '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN replace(word, ',', '') END AS DOUBLE) AS word_n,
       CAST(replace(amount, ',', '') AS DOUBLE) AS amount_n FROM raw""")
def _(t: Tables):
    word = F.regexp_extract("text", r"(?U)\S+\z", 0)
    amount = F.concat(F.col("n_chars").cast("string"), F.lit(",000"))
    return t.documents.select("doc_id", safe_float(word).alias("word_n"), safe_float(amount).alias("amount_n"))


@query("is_integer_like", SCORED + r"""
SELECT doc_id, coalesce(regexp_matches(found, '^\s*[+-]?\d+\s*$'), false) AS integer_like FROM ext""")
def _(t: Tables):
    df = extract_answer(t.view("completions"), "completion", "found")
    return df.select("doc_id", is_integer_like(F.col("found")).alias("integer_like"))


def _reward_query(name: str) -> None:
    @query(f"reward_{name}", SCORED + f"SELECT doc_id, CAST({REWARD_SQL[name]} AS DOUBLE) AS reward FROM ext")
    def _(t: Tables):
        return R.add_rewards(t.view("completions"), [name]).select("doc_id", F.col(f"reward_{name}").alias("reward"))


def _set_query(name: str) -> None:
    @query(f"total_reward_{name}", SCORED + f"SELECT doc_id, CAST({set_sql(name)} AS DOUBLE) AS reward FROM ext")
    def _(t: Tables):
        return R.total_reward(t.view("completions"), name).select("doc_id", "reward")


for _name in R.REWARDS:
    _reward_query(_name)
for _name in R.REWARD_SETS:
    _set_query(_name)


@query("rewards_long", SCORED + ", parts AS (" + " UNION ALL ".join(
    f"SELECT doc_id, model, '{n}' AS part, CAST({REWARD_SQL[n]} AS DOUBLE) AS reward FROM ext" for n in R.REWARD_SETS["dapo"]
) + ") SELECT model, part, count(*) AS n, round(sum(reward), 6) AS total FROM parts GROUP BY ALL")
def _(t: Tables):
    names = R.REWARD_SETS["dapo"]
    wide = R.add_rewards(t.view("completions"), names)
    # add up wide rows first: unpivoting before the aggregate would multiply the rows
    sums = wide.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"reward_{n}").alias(n) for n in names])
    long = sums.unpivot(["model", "n"], list(names), "part", "total")
    return long.select("model", "part", "n", F.round("total", 6).alias("total"))


def _rewarded(t: Tables):
    return R.total_reward(t.view("completions"), "full").select("prompt_id", "doc_id", "reward")


REWARDED = SCORED + f", rewarded AS (SELECT prompt_id, doc_id, CAST({set_sql('full')} AS DOUBLE) AS reward FROM ext)"


@query("group_advantage", REWARDED + """
SELECT prompt_id, doc_id, reward, min(reward) OVER w <> max(reward) OVER w AS informative,
       round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-4), 6) AS advantage
FROM rewarded WINDOW w AS (PARTITION BY prompt_id)""")
def _(t: Tables):
    out = ev.group_advantage(_rewarded(t).select("prompt_id", "doc_id", "reward"), "prompt_id", "reward")
    return out.select("prompt_id", "doc_id", "reward", "informative", F.round("advantage", 6).alias("advantage"))


@query("informative_groups", REWARDED + """
SELECT prompt_id, doc_id, reward FROM rewarded
QUALIFY min(reward) OVER (PARTITION BY prompt_id) <> max(reward) OVER (PARTITION BY prompt_id)""")
def _(t: Tables):
    return ev.informative_groups(_rewarded(t).select("prompt_id", "doc_id", "reward"), "prompt_id", "reward")


@query("eval_accuracy", SCORED + f"""
SELECT model, count(*) AS n, count(*) FILTER ({RIGHT}) AS n_correct,
       round(count(*) FILTER ({RIGHT}) * 100.0::DOUBLE / count(*), 2) AS accuracy_pct,
       count(*) FILTER ({RIGHT} AND found <> '' AND answer <> '') AS n_correct_truthy
FROM ext GROUP BY model""")
def _(t: Tables):
    df = ev.mark_correct(t.view("completions"), "completion", "answer", "right")
    df = ev.mark_correct(df, "completion", "answer", "truthy", truthy=True)
    return df.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_correct"),
        ev.share(F.col("right")).alias("accuracy_pct"), F.count_if("truthy").alias("n_correct_truthy"))


@query("format_compliance", f"""
SELECT model, lang, count(*) AS n, count(*) FILTER ({SOFT}) AS n_formatted,
       round(count(*) FILTER ({SOFT}) * 100.0::DOUBLE / count(*), 2) AS format_pct FROM @completions GROUP BY ALL""")
def _(t: Tables):
    formed = F.col("completion").rlike(R.SOFT)
    return t.view("completions").groupBy("model", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(formed).alias("n_formatted"), ev.share(formed).alias("format_pct"))


@query("running_accuracy", SCORED + f"""
, marked AS (SELECT doc_id, CAST({RIGHT} AS BIGINT) AS ok FROM ext)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n_total, CAST(sum(ok) OVER (ORDER BY doc_id) AS BIGINT) AS n_correct,
       round(sum(ok) OVER (ORDER BY doc_id) * 100.0::DOUBLE / row_number() OVER (ORDER BY doc_id), 2) AS accuracy_pct FROM marked""")
def _(t: Tables):
    marked = ev.mark_correct(t.view("completions"), "completion", "answer", "right").select("doc_id", "right")
    return ev.running_accuracy(marked, "doc_id", "right").select("doc_id", "n_total", "n_correct", "accuracy_pct")


AUDIT = "WITH " + extraction_sql("@math_rows", "answer") + r"""
, audit0 AS (SELECT split, idx, found, found_n, replace(regexp_replace(split_part(answer, '####', 2), '^\s+|\s+$', '', 'g'), ',', '') AS plain FROM ext),
audit AS (SELECT *, found_n IS NULL AS unparseable, found_n IS DISTINCT FROM TRY_CAST(plain AS DOUBLE) AS mismatch, coalesce(contains(found, ','), false) AS comma_kept FROM audit0)
"""


@query("extraction_audit", AUDIT + """
SELECT split, count(*) AS n, count(*) FILTER (mismatch) AS n_mismatch, count(*) FILTER (unparseable) AS n_unparseable,
       count(*) FILTER (comma_kept) AS n_comma FROM audit GROUP BY split""")
def _(t: Tables):
    return ev.audit_totals(ev.extraction_audit(t.view("math_rows")))


@query("extraction_audit_samples", AUDIT + """
SELECT split, idx, found, plain, row_number() OVER (PARTITION BY split ORDER BY idx) AS nth FROM audit WHERE mismatch OR unparseable
QUALIFY row_number() OVER (PARTITION BY split ORDER BY idx) <= 10""")
def _(t: Tables):
    audit = ev.extraction_audit(t.view("math_rows")).filter("mismatch OR unparseable")
    # a rank limit: each task keeps ten rows per split before the shuffle
    nth = F.row_number().over(Window.partitionBy("split").orderBy("idx"))
    return audit.withColumn("nth", nth).filter("nth <= 10").select("split", "idx", "found", "plain", F.col("nth").cast("long").alias("nth"))


@query("fallback_recovery", "WITH base AS (SELECT *, split_part(answer, '####', 1) AS reasoning FROM @math_rows)," + extraction_sql("base", "reasoning") + r"""
, hit AS (SELECT split, found IS NOT NULL AND found_n IS NOT DISTINCT FROM TRY_CAST(replace(regexp_replace(split_part(answer, '####', 2), '^\s+|\s+$', '', 'g'), ',', '') AS DOUBLE) AS ok FROM ext)
SELECT split, count(*) AS n, count(*) FILTER (ok) AS n_good, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 2) AS good_pct FROM hit GROUP BY split""")
def _(t: Tables):
    return ev.fallback_recovery(t.view("math_rows"))


@query("compare_models", SCORED + f"""
, m AS (SELECT source, model, {RIGHT} AS ok, {SOFT} AS fmt FROM ext),
p AS (SELECT source, count(*) FILTER (model = 'base') AS n_base, count(*) FILTER (model = 'trained') AS n_trained,
      round(count(*) FILTER (ok AND model = 'base') * 100.0::DOUBLE / nullif(count(*) FILTER (model = 'base'), 0), 2) AS right_base,
      round(count(*) FILTER (ok AND model = 'trained') * 100.0::DOUBLE / nullif(count(*) FILTER (model = 'trained'), 0), 2) AS right_trained,
      round(count(*) FILTER (fmt AND model = 'base') * 100.0::DOUBLE / nullif(count(*) FILTER (model = 'base'), 0), 2) AS formed_base,
      round(count(*) FILTER (fmt AND model = 'trained') * 100.0::DOUBLE / nullif(count(*) FILTER (model = 'trained'), 0), 2) AS formed_trained
      FROM m GROUP BY source)
SELECT *, round(right_trained - right_base, 2) AS right_delta, round(formed_trained - formed_base, 2) AS formed_delta FROM p""")
def _(t: Tables):
    df = ev.mark_correct(t.view("completions"), "completion", "answer", "right")
    df = df.select("source", "model", "right", F.col("completion").rlike(R.SOFT).alias("formed"))
    return ev.compare_models(df, "base", "trained", ["source"])
