"""Inputs derived from the given tables, as SQL text that Spark and DuckDB both read.

Each view covers its whole source table, so its size grows with it. ``@name`` marks a given table
or another view; the ``~`` markers are spelled per dialect in ``tables.py``.
"""

VIEWS: dict[str, str] = {}

# model completions for math questions: ten shapes of answer, wrong numbers in every third row
VIEWS["completions"] = """
SELECT doc_id, CAST(floor(doc_id / 4) AS BIGINT) AS prompt_id, doc_id % 4 AS gen_idx, lang, source,
       CASE WHEN doc_id % 3 = 1 THEN 'base' ELSE 'trained' END AS model,
       CAST(n_chars AS STRING) AS answer,
       CASE doc_id % 10
         WHEN 0 THEN '<reasoning>' || chr(10) || text || chr(10) || '</reasoning>' || chr(10) || '<answer>' || chr(10) || guess || chr(10) || '</answer>' || chr(10)
         WHEN 1 THEN '<answer>' || guess || '</answer>'
         WHEN 2 THEN text || chr(10) || '#### ' || guess
         WHEN 3 THEN text || ' so the total is ' || guess || '.'
         WHEN 4 THEN '<reasoning>' || text || '</reasoning><answer>' || guess || ' 1/4</answer>'
         WHEN 5 THEN '<answer>$' || CAST(CAST(floor(n / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(n % 1000 AS STRING), 3, '0') || '</answer>'
         WHEN 6 THEN '<think>' || text || '</think>' || chr(10) || '<answer>' || guess || '</answer>'
         WHEN 7 THEN '<reasoning>' || text || '</reasoning><answer>' || guess
         WHEN 8 THEN translate(text, '0123456789', '')
         ELSE '<reasoning>' || text || '</reasoning>' || chr(10) || '<answer>' || guess || '</answer>' || chr(10) || 'Checked twice.'
       END AS completion
FROM (SELECT *, CAST(n AS STRING) AS guess
      FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM @documents) a) b
"""

# question / worked answer pairs in two splits
VIEWS["math_rows"] = """
SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, doc_id AS idx, text AS question,
       text || ' which makes '
       || CAST(CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS STRING) || ' in all.' || chr(10) || '#### '
       || CASE WHEN doc_id % 7 = 0 THEN 'none'
               WHEN n_chars >= 1000 THEN CAST(CAST(floor(n_chars / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(n_chars % 1000 AS STRING), 3, '0')
               ELSE CAST(n_chars AS STRING) END AS answer
FROM @documents
"""

# sentiment rows: documents with a quality label
VIEWS["sentiment"] = """
SELECT d.doc_id AS id, CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, d.text, l.quality AS label
FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id
"""

# classifier outputs: two logits and a scalar logit per row
VIEWS["predictions"] = """
SELECT vec_id AS row_idx, 'run' || CAST(label % 3 AS STRING) AS run, label % 2 AS label,
       CAST(~el(embedding, 1) AS DOUBLE) AS z0, CAST(~el(embedding, 2) AS DOUBLE) AS z1,
       CAST(~el(embedding, 3) AS DOUBLE) AS z2
FROM @embeddings
"""

# one row per run and epoch, from whole cents so that both engines agree to the last bit
VIEWS["epochs"] = """
SELECT run, epoch, n, ts0, ts1,
       CASE WHEN run % 10 = 3 THEN 0.693 ELSE (cents % 1000) / 1000.0e0 END AS eval_loss,
       CASE WHEN run % 10 = 3 THEN 0.5 ELSE (cents % 97) / 97.0e0 END AS eval_acc
FROM (SELECT user_id AS run, CAST(floor((~epoch(ts) - 1704067200) / 86400) AS BIGINT) + 1 AS epoch, count(*) AS n,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
             min(~epoch(ts)) AS ts0, max(~epoch(ts)) AS ts1
      FROM @events GROUP BY 1, 2) e
"""

# training logs: one line per event, three kinds of line
VIEWS["log_lines"] = """
SELECT 'run' || CAST(user_id AS STRING) AS run, event_id AS line_no,
       CASE event_type
         WHEN 'error' THEN '[TRIPWIRE step ' || step || '] |B|max=' || b || ' grad|max=' || g
              || ' non-finite(B grads)=' || CAST(cents % 3 AS STRING) || '/224'
         WHEN 'view' THEN '[GRAD-WATCH step ' || step || '] optimizer sees: 448 grads (' || CAST(cents % 2 AS STRING)
              || ' None), nonzero=' || CAST(cents % 448 AS STRING) || ', non-finite=' || CAST(cents % 5 AS STRING) || ', absmax=' || g
              || ' | backward hooks (8x lora_B): calls=' || CAST(cents % 64 AS STRING) || ', nonzero=' || CAST(cents % 8 AS STRING)
              || ', non-finite=' || CAST(cents % 4 AS STRING) || ' | base-drift: '
              || CASE WHEN cents % 11 = 0 THEN '[''5.mlp'']' ELSE 'none' END || ' | |A|max=' || g || ' |B|max=' || b
         WHEN 'click' THEN 'batch ' || CAST(step_n * 2 AS STRING) || '/20000 | step ' || step || '/10000 | left '
              || CAST(10000 - step_n AS STRING) || ' steps | epoch 0.' || lpad(CAST(cents % 1000 AS STRING), 3, '0')
         ELSE '{''loss'': ' || g || ', ''grad_norm'': '
              || CASE WHEN cents % 7 = 0 THEN 'nan' WHEN cents % 7 = 1 THEN 'inf' ELSE g END
              || ', ''reward'': ' || b || ', ''kl'': ' || g || ', ''step'': ' || step || '}'
       END AS line
FROM (SELECT *, CAST(event_id AS STRING) AS step, event_id AS step_n,
             CAST(CAST(floor(cents / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 1000 AS STRING), 3, '0') || 'e-0' || CAST(event_id % 3 AS STRING) AS b,
             CAST(cents % 10 AS STRING) || '.' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') || 'e+0' || CAST(cents % 4 AS STRING) AS g
      FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM @events) a) c
"""

# tensors at two moments: the second copy of some is nudged, some exist on one side only
VIEWS["tensors_a"] = """
SELECT 'layers.' || CAST(vec_id AS STRING) || CASE WHEN label % 2 = 0 THEN '.lora_A' ELSE '.lora_B' END AS name, vec_id,
       label AS kind, embedding AS vals
FROM @embeddings
"""
VIEWS["tensor_cells"] = """
SELECT name, vec_id, kind, CAST(~el(vals, 1) AS DOUBLE) AS x0, CAST(~el(vals, 2) AS DOUBLE) AS x1,
       CAST(~el(vals, 3) AS DOUBLE) AS x2 FROM @tensors_a
"""

# agent benchmark runs: whole numbers come from the event value
VIEWS["agent_runs"] = """
SELECT event_id AS run_id, 's' || CAST(CAST(floor(~epoch(ts) / 86400) AS BIGINT) % 5 AS STRING) AS session,
       CASE WHEN cents % 3 = 0 THEN 'permuted' ELSE 'standard' END AS layout,
       'm' || CAST(user_id % 4 AS STRING) AS model, event_type AS task, event_id AS run,
       CASE WHEN cents % 17 = 0 THEN 124 ELSE 0 END AS rc,
       CASE WHEN cents % 2 = 0 THEN total ELSE cents % (total + 1) END AS passed, total,
       ~epoch(ts) AS started, ~epoch(ts) + CAST(floor(value) AS BIGINT) AS ended,
       CASE cents % 6 WHEN 0 THEN 'used eval/exec/compile' WHEN 1 THEN 'calc.py has invalid syntax'
            WHEN 2 THEN 'protected test file modified' WHEN 3 THEN 'wordfreq.py not created' ELSE 'pytest failing' END AS note
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents,
             CASE event_type WHEN 'click' THEN 13 WHEN 'view' THEN 14 WHEN 'error' THEN 10 WHEN 'signup' THEN 4 ELSE 8 END AS total
      FROM @events) e
"""

# ten rubric items per run
VIEWS["rubric_items"] = """
SELECT run_id, session, layout, model, run, item,
       CASE WHEN model = 'm0' AND item = 'name' THEN true WHEN model = 'm1' AND item = 'version' THEN false
            ELSE (cents * 7 + length(item) * 13 + run_id) % 6 <> 0 END AS ok
FROM (SELECT event_id AS run_id, 's' || CAST(CAST(floor(~epoch(ts) / 86400) AS BIGINT) % 5 AS STRING) AS session,
             CASE WHEN CAST(round(value * 100) AS BIGINT) % 3 = 0 THEN 'permuted' ELSE 'standard' END AS layout,
             'm' || CAST(user_id % 4 AS STRING) AS model, event_id AS run, CAST(round(value * 100) AS BIGINT) AS cents,
             ~explode('deliverable', 'name', 'version', 'license', 'summary', 'order', 'lastline', 'protected', 'no-strays', 'evidence') AS item
      FROM @events) e
"""

# the text an agent's test run printed
VIEWS["test_output"] = """
SELECT event_id AS run_id, 12 AS expected,
       CASE cents % 5
         WHEN 0 THEN 'collected' || chr(10) || CAST(cents % 13 AS STRING) || ' passed in 0.' || CAST(cents % 90 AS STRING) || 's'
         WHEN 1 THEN CAST(cents % 6 AS STRING) || ' failed, ' || CAST(cents % 12 AS STRING) || ' passed in 2s'
         WHEN 2 THEN '1 error in 0.1s'
         WHEN 3 THEN CAST(cents % 4 AS STRING) || ' failed, 3 passed' || chr(10) || CAST(cents % 3 AS STRING) || ' error, 12 passed in 9s'
         ELSE 'no tests ran' END AS out
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM @events) e
"""

# server replies as JSON text
VIEWS["server_replies"] = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN cents % 9 = 0 THEN '{"error": "slot unavailable"}'
            WHEN cents % 9 = 1 THEN '{"timings": {"prompt_n": ' || q || '}}'
            ELSE '{"timings": {"prompt_n": ' || q || ', "prompt_per_second": ' || p || ', "predicted_n": ' || CAST(cents % 500 AS STRING)
                 || ', "predicted_per_second": ' || CAST(cents % 120 AS STRING) || '.25}}' END AS reply
FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS q, CAST(cents % 9000 AS STRING) || '.5' AS p
      FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM @lineitem) a) b
"""
VIEWS["timed_replies"] = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN cents % 9 = 0 THEN '{"error": "model not found"}'
            WHEN cents % 9 = 1 THEN '{"eval_count": ' || q || '}'
            ELSE '{"prompt_eval_count": ' || q || ', "prompt_eval_duration": ' || CAST(cents * 100 AS STRING) || ', "eval_count": '
                 || CAST(cents % 500 AS STRING) || ', "eval_duration": ' || CAST(cents * 1000 AS STRING) || ', "load_duration": '
                 || CAST(cents AS STRING) || '}' END AS reply
FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS q
      FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM @lineitem) a) b
"""

# throughput measured per model, knob value and depth
VIEWS["sweep"] = """
SELECT l_suppkey AS model, l_linenumber AS knob, l_orderkey AS rep, l_partkey % 4 * 16384 AS depth,
       CAST(round(l_extendedprice) AS BIGINT) AS pp, CAST(l_quantity AS BIGINT) AS tg,
       CASE WHEN l_linenumber <= l_suppkey % 4 THEN 'oom' ELSE 'ok' END AS status, l_shipdate
FROM @lineitem
"""

# packaging results of agents, one row per file
VIEWS["artifacts"] = """
SELECT doc_id AS run_id, path, CASE path WHEN 'dist/package.meta' THEN meta WHEN 'REPORT.md' THEN report ELSE text END AS content
FROM (SELECT doc_id, text, meta, path,
             CASE WHEN doc_id % 6 = 3 THEN 'no evidence kept'
                  ELSE '## Evidence' || chr(10) || 'VALIDATE-OK ' || substr(~sha(meta || 'pack-salt-1'), 1, 12) || chr(10) || ~sha(meta) || chr(10) END AS report
      FROM (SELECT doc_id, text,
                   'Name: samplepack' || chr(10) || 'Version: ' || CASE WHEN doc_id % 5 = 0 THEN '2.5-dev' ELSE '2.4.1' END || chr(10)
                   || CASE WHEN doc_id % 7 = 0 THEN chr(10) ELSE '' END || 'License: BSD-2-Clause' || chr(10)
                   || 'Summary: ' || CASE doc_id % 4 WHEN 0 THEN 'Solver for Euler equations'
                        WHEN 1 THEN 'Character-level Transformer' ELSE lang || ' language model, ' || CAST(n_chars AS STRING) || ' characters of notes' END || chr(10)
                   || CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'Checked: manual' || chr(10) END AS meta,
                   ~explode('dist/package.meta', 'REPORT.md', 'src/NOTES', 'src/EXTRA') AS path
            FROM @documents) a) b
WHERE NOT (path = 'REPORT.md' AND doc_id % 11 = 0) AND NOT (path = 'src/EXTRA' AND doc_id % 8 <> 0)
"""
VIEWS["manifest"] = """
SELECT doc_id AS run_id, 'src/NOTES' AS path, ~sha(CASE WHEN doc_id % 10 = 4 THEN text || 'x' ELSE text END) AS sha256 FROM @documents
"""

# index content: documents under one or two paths each
VIEWS["rag_files"] = """
SELECT CASE WHEN copy = 0 THEN '/' || source || '/' || CAST(doc_id AS STRING) || '.txt'
            ELSE '/mirror/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' END AS path,
       doc_id, text AS content, CASE WHEN lang = 'en' THEN '' WHEN lang = 'de' THEN NULL ELSE lang END AS scope, n_chars AS mtime
FROM (SELECT *, ~explode(0, 1) AS copy FROM @documents) d
WHERE copy = 0 OR n_chars % 3 = 0
"""

# the query log of an index: one row per event
VIEWS["rag_queries"] = """
SELECT event_id AS id, ~epoch(ts) AS ts, 'find ' || props AS text,
       CASE WHEN event_id % 5 = 0 THEN event_type || '-hook' ELSE event_type END AS source,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS STRING) || '-' || CAST(CAST(floor(~epoch(ts) / 86400) AS BIGINT) AS STRING) END AS session_id
FROM @events
"""
VIEWS["rag_feedback"] = """
SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN 'bad' ELSE 'good' END AS verdict, o_orderpriority AS note,
       ~epoch(o_orderdate) * 100000 + o_orderkey AS ts
FROM @orders
UNION ALL
SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE 'good' END, l_linestatus,
       ~epoch(l_shipdate) * 100000 + l_partkey * 10 + l_linenumber
FROM @lineitem
"""

# learners, tutoring replies
VIEWS["learners"] = """
SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CASE c_nationkey % 5 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' WHEN 3 THEN 'B2' ELSE 'C1' END END AS level,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ~array(lower(c_mktsegment), 'travel', 'health', 'travel', 'sports') END AS prefs,
       CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN ~array(lower(c_mktsegment), 'health')
            ELSE ~array('travel', 'sports', 'health', lower(c_mktsegment)) END AS seen,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE ~array(s0, s1) END AS scores
FROM (SELECT *, CAST(abs(CAST(round(c_acctbal) AS BIGINT)) % 101 AS DOUBLE) AS s0, CAST(c_custkey % 101 AS DOUBLE) AS s1 FROM @customer) c
"""
VIEWS["tutor_replies"] = """
SELECT conv_id, turn,
       CASE (conv_id + turn) % 5
         WHEN 0 THEN 'Sorry, ' || body
         WHEN 1 THEN chr(96) || chr(96) || chr(96) || 'json' || chr(10) || json || chr(10) || chr(96) || chr(96) || chr(96)
         WHEN 2 THEN '  ' || json || chr(10)
         ELSE json END AS raw
FROM (SELECT *, '{"text": "' || body || '", "questions": [{"question": "Who wrote ' || role || '?", "answer": "' || body
                || '"}, {"question": "Why?", "answer": "' || role || ' said so"}]}' AS json
      FROM (SELECT conv_id, turn, role,
                   replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') AS body
            FROM @conversations) a) b
"""

# bookings, order events, shop actions
VIEWS["bookings"] = """
SELECT user_id AS resource, CAST(floor(~epoch(ts) / 60) AS BIGINT) AS s,
       CAST(floor(~epoch(ts) / 60) AS BIGINT) + CAST(floor(value) AS BIGINT) AS e, event_id AS seq, event_type = 'error' AS is_cancel
FROM @events
"""
VIEWS["order_events"] = """
SELECT l_orderkey AS order_id, ((l_linenumber * 100000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq,
       CASE WHEN l_linenumber <= 3 THEN 'pay' WHEN l_linenumber = 4 THEN CASE WHEN l_returnflag = 'R' THEN 'cancel' ELSE 'pay' END
            WHEN l_linenumber = 5 THEN 'ship' WHEN l_linenumber = 6 THEN 'deliver' ELSE CASE WHEN l_returnflag = 'A' THEN 'cancel' ELSE 'pay' END END AS event,
       CAST(round(l_extendedprice) AS BIGINT) AS amount, o.total
FROM @lineitem l JOIN (SELECT o_orderkey, CAST(round(o_totalprice / 4) AS BIGINT) AS total FROM @orders) o ON l.l_orderkey = o.o_orderkey
"""
VIEWS["shop_actions"] = """
SELECT user_id AS customer, event_id AS seq, event_type = 'purchase' AS is_checkout,
       CAST(1 + event_id % 5 AS BIGINT) AS qty, CAST(round(value * 100) AS BIGINT) AS unit_cents
FROM @events
"""
VIEWS["tensors_bad"] = """
SELECT name, vec_id, kind, vec_id % 10 AS step,
       CASE WHEN kind = 9 THEN NULL WHEN kind = 3 AND vec_id % 2 = 0 THEN array_append(vals, CAST('NaN' AS FLOAT))
            WHEN kind = 5 THEN array_append(vals, CAST('-Infinity' AS FLOAT)) ELSE vals END AS vals
FROM @tensors_a
"""
VIEWS["tensors_b"] = """
SELECT CASE WHEN vec_id % 50 = 7 THEN name || '.extra' ELSE name END AS name, kind,
       CASE WHEN kind = 4 THEN array_append(array_append(~array(~el(vals, 1), ~el(vals, 2)), CAST(0.5 AS FLOAT)), CAST(20000 AS FLOAT))
            ELSE ~array(~el(vals, 1), ~el(vals, 2), ~el(vals, 4), ~el(vals, 3)) END AS vals
FROM @tensors_a
"""
VIEWS["tensors_a4"] = """
SELECT name, kind, ~array(~el(vals, 1), ~el(vals, 2), ~el(vals, 3), ~el(vals, 4)) AS vals FROM @tensors_a
"""
VIEWS["token_batches"] = """
SELECT source AS batch_key, doc_id AS step, ~array(a, n_chars, b) AS ids
FROM (SELECT *, doc_id * 31 % 30010 - 2 AS a, CAST(length(lang) AS BIGINT) AS b FROM @documents) d
"""

# an earlier state of the index: some contents have changed since, mirrors came later, some paths are gone now
VIEWS["rag_before"] = """
SELECT CASE WHEN doc_id % 9 = 2 THEN '/gone' || path ELSE path END AS path, doc_id,
       CASE WHEN doc_id % 10 = 1 THEN content || ' draft' ELSE content END AS content, scope, mtime - 1 AS mtime
FROM @rag_files WHERE path NOT LIKE '/mirror/%'
"""
VIEWS["rag_roots"] = """
SELECT DISTINCT '/' || source AS root, CASE WHEN source LIKE '%1' THEN 'agent1' ELSE NULL END AS scope FROM @documents
UNION ALL SELECT DISTINCT '/mirror/' || lang, lang FROM @documents
UNION ALL SELECT DISTINCT '/mirror', 'shared' FROM @documents
"""
VIEWS["search_queries"] = """
SELECT b.item_id AS q_id, b.text AS q_text, e.embedding AS q_vec FROM @benchmark b LEFT JOIN @embeddings e ON b.item_id = e.vec_id
"""

# range queries over the event log; cache traffic per tenant
VIEWS["range_queries"] = """
SELECT o_orderkey AS q_id, 1704067200 + o_orderkey * 977 % 2592000 AS lo,
       1704067200 + o_orderkey * 977 % 2592000 + o_custkey * 131 % 100000 - 500 AS hi
FROM @orders
"""
VIEWS["event_times"] = "SELECT event_id, ~epoch(ts) AS t FROM @events"
VIEWS["cache_events"] = """
SELECT user_id AS tenant, event_id AS seq, ~epoch(ts) AS t, CASE WHEN event_type IN ('view', 'click') THEN 'get' ELSE 'put' END AS op,
       'k' || CAST(CAST(round(value * 100) AS BIGINT) % 6 AS STRING) AS key, CAST(round(value * 100) AS BIGINT) AS val
FROM @events
"""

# printed forms of benchmark results
VIEWS["result_lines"] = """
SELECT run_id, model || '|' || task || '|' || CAST(run AS STRING) || '|' || CASE WHEN rc = 124 THEN 'TIMEOUT' WHEN passed = total THEN 'PASS' ELSE 'FAIL' END || '|'
       || CAST(passed AS STRING) || '/' || CAST(total AS STRING) || '|' || CAST(ended - started AS STRING) || 's|'
       || CASE WHEN passed = total THEN '' WHEN total = 13 THEN 'order,lastline' ELSE 'evidence' END AS line
FROM @agent_runs
"""
VIEWS["item_lines"] = """
SELECT run_id, item || '|' || CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END || '|' || CASE WHEN ok THEN '' ELSE item || ' not held' END AS line FROM @rubric_items
"""
VIEWS["sweep_output"] = """
SELECT l_orderkey, l_linenumber,
       'loading model' || chr(10) || '| model | knob | test | t/s |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
       || '| s' || CAST(l_suppkey AS STRING) || ' | ' || CAST(l_linenumber AS STRING) || ' | pp512 | ' || CAST(CAST(round(l_extendedprice) AS BIGINT) AS STRING) || '.5 |' || chr(10) || 'done' AS out
FROM @lineitem
"""
VIEWS["checkpoint_paths"] = """
SELECT source AS run, '/out/' || source || '/' || CASE WHEN lang = 'es' THEN 'tmp-' ELSE 'checkpoint-' END || CAST(doc_id AS STRING) AS path FROM @documents
"""

# order events without a join, for the streaming twin
VIEWS["shipments"] = """
SELECT l_orderkey AS order_id, ((l_linenumber * 100000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq,
       CASE WHEN l_linenumber <= 4 THEN 'pay' WHEN l_linenumber = 5 THEN CASE WHEN l_returnflag = 'R' THEN 'cancel' ELSE 'ship' END
            WHEN l_linenumber = 6 THEN 'deliver' ELSE 'cancel' END AS event,
       CAST(round(l_quantity) AS BIGINT) AS amount, 20 + l_orderkey % 60 AS total
FROM @lineitem
"""
