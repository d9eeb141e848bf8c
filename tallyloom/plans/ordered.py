"""Bookings, orders, carts, caches and tutoring over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import folds as D
from tallyloom.operators import intervals as I
from tallyloom.operators import tutoring as U
from tallyloom.plans.registry import hash_sql, query
from tallyloom.plans.tables import Tables


@query("overlap_counts", """
WITH v AS (SELECT resource, seq, s, e FROM @bookings WHERE s < e)
SELECT a.resource, a.seq, count(b.seq) AS n_overlaps FROM v a LEFT JOIN v b ON a.resource = b.resource AND a.s < b.e AND b.s < a.e AND a.seq <> b.seq GROUP BY ALL""")
def _(t: Tables):
    return I.overlap_counts(t.view("bookings"))


SPANS = """r AS (SELECT *, max(e) OVER (PARTITION BY resource ORDER BY s, e, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM @bookings WHERE s < e),
o AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY resource ORDER BY s, e, seq) AS span FROM r),
spans AS (SELECT resource, CAST(span AS BIGINT) AS span, min(s) AS s, max(e) AS e, count(*) AS n FROM o GROUP BY ALL)"""


@query("merge_intervals", f"WITH {SPANS} SELECT * FROM spans")
def _(t: Tables):
    return I.merge_intervals(t.view("bookings"))


@query("next_free", f"""
WITH {SPANS}, gaps AS (SELECT resource, e AS g, coalesce(lead(s) OVER (PARTITION BY resource ORDER BY s), 1000000000000) AS until FROM spans
  UNION ALL SELECT resource, -1000000000000, min(s) FROM spans GROUP BY resource),
q AS (SELECT resource, seq AS q_id, s AS t, 1 + seq * 7 % 400 AS d FROM @bookings)
SELECT q.resource, q_id, min(greatest(t, g)) AS free_at FROM q JOIN gaps USING (resource) WHERE until - greatest(t, g) >= d GROUP BY ALL""")
def _(t: Tables):
    bookings = t.view("bookings")
    asked = bookings.select("resource", F.col("seq").alias("q_id"), F.col("s").alias("t"), (1 + F.col("seq") * 7 % 400).alias("d"))
    return I.next_free(I.merge_intervals(bookings), asked)


# the counts are checked through running totals: DuckDB counts before each bound
@query("range_counts", """
WITH p AS (SELECT t, count(*) AS n FROM @event_times GROUP BY t), c AS (SELECT t, sum(n) OVER (ORDER BY t) AS upto FROM p),
b AS (SELECT q_id, lo, greatest(lo, hi) AS hi FROM @range_queries),
x AS (SELECT b.q_id, b.hi, coalesce(c.upto, 0) AS below_lo FROM b ASOF LEFT JOIN c ON b.lo > c.t)
SELECT x.q_id, CAST(coalesce(c.upto, 0) - below_lo AS BIGINT) AS n FROM x ASOF LEFT JOIN c ON x.hi > c.t""")
def _(t: Tables):
    return I.range_counts(t.view("event_times"), t.view("range_queries"))


@query("cart_totals", """
WITH c AS (SELECT *, CAST(coalesce(sum(CAST(is_checkout AS INT)) OVER (PARTITION BY customer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cart FROM @shop_actions)
SELECT customer, cart, CAST(coalesce(sum(qty * unit_cents) FILTER (NOT is_checkout), 0) AS BIGINT) AS total_cents, count(*) FILTER (NOT is_checkout) AS n_items, bool_or(is_checkout) AS checked_out FROM c GROUP BY ALL""")
def _(t: Tables):
    return I.cart_totals(t.view("shop_actions"))


@query("median_mode", """
WITH c AS (SELECT user_id, floor(value) AS v, count(*) AS c, min(event_id) AS f FROM @events GROUP BY ALL)
SELECT e.user_id, median(value) AS median, count(*) AS n, any_value(m.mode) AS mode FROM @events e
JOIN (SELECT user_id, CAST(v AS BIGINT) AS mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) = 1) m ON e.user_id = m.user_id GROUP BY e.user_id""")
def _(t: Tables):
    exact = I.median_mode(t.events, "user_id", "value", "event_id").drop("mode")
    whole = I.median_mode(t.events.withColumn("v", F.floor("value")), "user_id", "v", "event_id").select("user_id", "mode")
    return exact.join(whole, "user_id").select("user_id", "median", "n", "mode")


@query("live_entries", """
WITH k AS (SELECT tenant, key, arg_max(val, seq) FILTER (op = 'put') AS val, max(t) FILTER (op = 'put') AS put_at, max(seq) AS used FROM @cache_events WHERE t <= 1706000000 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY used DESC) AS recency FROM k WHERE 1706000000 - put_at <= 400000 QUALIFY recency <= 3""")
def _(t: Tables):
    return I.live_entries(t.view("cache_events"), 3, 400_000, 1_706_000_000)


@query("accept_bookings")
def _(t: Tables):
    return D.accept_bookings(t.view("bookings"))


ORDER_WALK = """
WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS nth FROM @order_events),
walk AS (
  SELECT order_id, CAST(0 AS BIGINT) AS nth, 'new' AS state, CAST(0 AS BIGINT) AS paid, CAST(0 AS BIGINT) AS refund, 'new' AS history, CAST(0 AS BIGINT) AS rejected FROM h WHERE nth = 1
  UNION ALL
  SELECT order_id, nth, then_s, CASE WHEN event = 'pay' AND ok THEN paid + amount ELSE paid END, CASE WHEN event = 'cancel' AND ok THEN paid ELSE refund END,
         CASE WHEN ok AND then_s <> state THEN history || '>' || then_s ELSE history END, CASE WHEN ok THEN rejected ELSE rejected + 1 END
  FROM (SELECT *, CASE WHEN NOT ok THEN state WHEN event = 'pay' THEN CASE WHEN paid + amount = total THEN 'paid' ELSE 'new' END
                       WHEN event = 'ship' THEN 'shipped' WHEN event = 'deliver' THEN 'delivered' ELSE 'cancelled' END AS then_s
        FROM (SELECT w.order_id, h.nth, w.state, w.paid, w.refund, w.history, w.rejected, h.event, h.amount, h.total,
                     CASE h.event WHEN 'pay' THEN w.state = 'new' AND w.paid + h.amount <= h.total WHEN 'ship' THEN w.state = 'paid'
                       WHEN 'deliver' THEN w.state = 'shipped' ELSE w.state IN ('new', 'paid') END AS ok
              FROM walk w JOIN h ON h.order_id = w.order_id AND h.nth = w.nth + 1) a) b)
SELECT order_id, state, paid, refund, history, rejected FROM walk QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY nth DESC) = 1"""


@query("order_states", ORDER_WALK)
def _(t: Tables):
    return D.order_states(t.view("order_events"))


@query("cache_trace")
def _(t: Tables):
    return D.cache_trace(t.view("cache_events"), 3, 400_000)


LEVEL_ROWS = ", ".join(
    "({})".format(", ".join([f"'{r[0]}'", *[str(x) for x in r[1:4]], f"'{r[4]}'", str(r[5]), f"'{r[6]}'", "[" + ", ".join(f"'{x}'" for x in r[7]) + "]"])) for r in U.LEVELS)
LEVEL_CTE = f"levels AS (SELECT * FROM (VALUES {LEVEL_ROWS}) l(level, ord, min_words, max_words, style, n_questions, audience, topics))"
FILLED = f"""{LEVEL_CTE}, filled AS (SELECT user_id, coalesce(l.level, 'B1') AS level, coalesce(prefs, v.topics) AS prefs, coalesce(seen, []) AS seen, scores
  FROM @learners l JOIN levels v ON v.level = coalesce(l.level, 'B1')),
moved AS (SELECT f.*, list_sum(scores) / len(scores) AS mean, v.ord FROM filled f JOIN levels v USING (level)),
adjusted AS (SELECT m.*, v.level AS new_level FROM moved m JOIN levels v ON v.ord = greatest(1, least(5, m.ord + CASE WHEN mean >= 80 THEN 1 WHEN mean < 60 THEN -1 ELSE 0 END)))"""


@query("profile_defaults", f"WITH {FILLED} SELECT user_id, level, array_to_string(prefs, ',') AS prefs, array_to_string(seen, ',') AS seen FROM filled")
def _(t: Tables):
    out = U.profile_defaults(t.view("learners"))
    return out.select("user_id", "level", F.array_join("prefs", ",").alias("prefs"), F.array_join("seen", ",").alias("seen"))


@query("adjust_level", f"WITH {FILLED} SELECT user_id, level, new_level FROM adjusted")
def _(t: Tables):
    out = U.profile_defaults(t.view("learners"))
    return out.select("user_id", "level", U.adjust_level(F.col("level"), F.col("scores")).alias("new_level"))


@query("select_topic", f"""WITH {FILLED}, every AS (SELECT list(topics ORDER BY ord) AS t FROM levels),
fresh AS (SELECT user_id, level, prefs, [x FOR x IN prefs IF NOT list_contains(list_slice(seen, greatest(1, len(seen) - 2), len(seen)), x)] AS new FROM filled),
own AS (SELECT user_id, level, CASE WHEN len(new) = 0 THEN prefs ELSE new END AS p FROM fresh),
far AS (SELECT *, t[{hash_sql(4, 'user_id')} % len(t) + 1] AS f FROM own, every)
SELECT user_id, level, coalesce(CASE WHEN len(p) > 0 THEN p[{hash_sql(3, 'user_id')} % len(p) + 1] END, f[{hash_sql(3, 'user_id')} % len(f) + 1]) AS topic FROM far""")
def _(t: Tables):
    return U.select_topic(U.profile_defaults(t.view("learners")), 3).select("user_id", "level", "topic")


USER_SQL = "'" + U.USER_PROMPT.replace("\n", "' || chr(10) || '") + "'"
for _part in ("min_words", "max_words", "prefs[1]", "new_level", "n_questions"):
    _at = min(i for i in (USER_SQL.find("%d"), USER_SQL.find("%s")) if i >= 0)
    USER_SQL = USER_SQL[:_at] + f"' || {_part} || '" + USER_SQL[_at + 2:]


@query("level_prompts", f"""WITH {FILLED}
SELECT user_id, new_level AS level, 'You write reading exercises for ' || audience || '. Style: ' || style || '. Length: ' || min_words || ' to ' || max_words || ' words.' AS system_prompt,
       {USER_SQL} AS user_prompt FROM adjusted a JOIN levels v ON v.level = a.new_level""")
def _(t: Tables):
    out = U.profile_defaults(t.view("learners"))
    out = out.select("user_id", U.adjust_level(F.col("level"), F.col("scores")).alias("level"), F.col("prefs")[0].alias("topic"))
    return U.level_prompts(out).drop("topic")


INNER = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^```json', ''), '```$', ''), '^\s+', ''), '\s+$', '')"
REPLIES = f"""replies AS (SELECT conv_id, turn, CASE WHEN json_valid({INNER}) THEN {INNER} END AS j FROM @tutor_replies),
parsed AS (SELECT conv_id, turn, coalesce(json_extract_string(j, '$.text'), '') AS text, coalesce(json_array_length(j, '$.questions'), 0) AS n_questions, j FROM replies),
asked AS (SELECT conv_id, turn, CAST(i AS INT) AS nth, json_extract_string(j, '$.questions[' || i || '].question') AS question, json_extract_string(j, '$.questions[' || i || '].answer') AS answer
  FROM (SELECT *, unnest(range(CAST(n_questions AS BIGINT))) AS i FROM parsed) p)"""


@query("parse_tutor_reply", f"WITH {REPLIES} SELECT conv_id, turn, text, CAST(n_questions AS INT) AS n_questions FROM parsed")
def _(t: Tables):
    out = U.parse_tutor_reply(t.view("tutor_replies"), "raw")
    return out.select("conv_id", "turn", "text", F.size("questions").alias("n_questions"))


@query("explode_questions", f"WITH {REPLIES} SELECT * FROM asked")
def _(t: Tables):
    return U.explode_questions(U.parse_tutor_reply(t.view("tutor_replies"), "raw"))


# the same rows by a table function and a lateral join
@query("explode_questions_lateral", f"WITH {REPLIES} SELECT * FROM asked")
def _(t: Tables):
    return U.reply_questions(t.view("tutor_replies"), "raw")


@query("answer_options", f"""WITH {REPLIES}
SELECT conv_id, turn, nth, unnest(['high_quality', 'medium_quality', 'low_quality']) AS quality,
       unnest([answer, 'Partial: ' || substr(answer, 1, length(answer) // 2) || '...', 'Maybe ' || regexp_extract(question, '\\S+') || '?']) AS text FROM asked""")
def _(t: Tables):
    asked = U.explode_questions(U.parse_tutor_reply(t.view("tutor_replies"), "raw"))
    out = U.answer_options(asked, F.col("conv_id") * 100 + F.col("turn"), 5)
    return out.select("conv_id", "turn", "nth", F.explode("options").alias("o")).select("conv_id", "turn", "nth", "o.quality", "o.text")
