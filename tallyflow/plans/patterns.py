"""Queries of the pattern detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators import detectors as T
from tallyflow.operators import pricing as P
from tallyflow.operators import scope as S
from tallyflow.operators import windows as V
from tallyflow.plans import derive as D
from tallyflow.plans.cost import priced, turns
from tallyflow.plans.derive import SQL

DEC = "decimal(38,0)"


def stuck_loops(spark, sf):
    out = T.stuck_loops(D.calls(spark, sf), turns(spark, sf))
    return out.select("session_id", "tool", "start_ord", "n_calls", F.col("pico").isNotNull().alias("is_priced"), F.round(F.col("pico").cast("double") / 1e12, 9).alias("usd"), "wall_ms", F.size("turns").cast("long").alias("n_turns"))


def rereads(spark, sf):
    """view reads a path, purchase edits it; a click may have changed the path that it names."""
    c = D.calls(spark, sf)
    return T.rereads(c, "view", ("purchase",), blocked_by=c.where("is_shell").select("session_id", "call_ord", "path"))


def file_calls(spark, sf):
    """Views and errors read a file, purchases edit one, clicks are shell calls; a path has three spellings."""
    e = D.events(spark, sf)
    f = F.concat(F.lit("f"), (F.col("k") % 10).cast("string"), F.lit(".ts"))
    path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/p/"), f)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("/p/./q/../"), f)).otherwise(F.concat(F.lit("//p//"), f, F.lit("/")))
    command = F.when(F.col("event_id") % 40 == 0, F.lit("git stash -u")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("sed -i s/a/b/ "), f)).otherwise(F.lit("ls -la"))
    name = F.when(F.col("event_type") == "click", "Bash").when(F.col("event_type") == "purchase", "Edit").when(F.col("event_type").isin("view", "error"), "Read").otherwise("Other")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit('{"command": "'), command, F.lit('"}'))).otherwise(F.concat(F.lit('{"offset": 1, "file_path": "'), path, F.lit('"}')))
    return e.select("session_id", "turn_index", "call_ord", name.alias("name"), (F.col("event_type") == "click").alias("is_shell"), text.alias("input_json"), F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 4 == 0, "running").otherwise("ok").alias("status"))


def same_file_rereads(spark, sf):
    out = T.same_file_rereads(file_calls(spark, sf), turns(spark, sf), D.compactions(spark, sf))
    return out.select("session_id", "n_rereads", F.col("pico").isNotNull().alias("is_priced"), F.round(F.col("pico").cast("double") / 1e12, 9).alias("usd"), F.round(F.col("tokens").cast("double"), 3).alias("tokens"), F.array_join("turns", ",").alias("turns"))


def scoped_sessions(spark, sf):
    """How many sessions each requested folder has; some were recorded at home or above, some folders have odd spellings."""
    s = D.sessions(spark, sf)
    uid = F.regexp_extract("session_id", "^([0-9]+)", 1).cast("long")
    cwd = F.when(uid % 11 == 0, "/home/u").when(uid % 11 == 1, "/").when(uid % 11 == 2, F.concat(F.lit("/home/u/./x/../"), F.lit("proj"), (uid % 6).cast("string"))).otherwise(F.col("cwd"))
    asked = s.select(F.concat(F.lit("/home/u/proj"), (uid % 6).cast("string"), F.when(uid % 2 == 0, "/src//lib/").otherwise("/../proj1")).alias("request")).distinct()
    asked = asked.unionAll(spark.createDataFrame([("/home/u",), ("/",), ("",)], "request string"))
    return S.sessions_for(s.select("session_id", cwd.alias("cwd")), asked, "/home/u").groupBy("request").agg(F.count("*").alias("n_sessions"))


def trivial_spans(spark, sf):
    out = T.trivial_spans(priced(spark, sf), D.calls(spark, sf), P.cheapest_current(D.prices(spark)), most=2000)
    return out.select("session_id", "n_turns", "tokens", "pico", "cheapest_pico", F.array_join("turns", ",").alias("turns"))


def refills(spark, sf):
    return T.refills(turns(spark, sf), D.compactions(spark, sf))


def context_thrash(spark, sf):
    return T.context_thrash(turns(spark, sf), D.compactions(spark, sf), priced(spark, sf))


def cost_shape(spark, sf):
    return T.cost_shape(turns(spark, sf), D.calls(spark, sf).where("name = 'purchase'").select("session_id", "turn_index"))


def time_caveats(spark, sf):
    s = D.sessions(spark, sf).withColumn("mtime_ms", F.when(F.hash("session_id") == 0, 0).otherwise(F.col("ended_ms") - F.col("tokens") * 10))
    t = D.sessions(spark, sf).select("session_id", F.col("ended_ms").alias("ts_ms"), F.col("tokens").alias("total"))
    return T.time_caveats(s, t)


def findings(spark, sf):
    """All findings in one shape: session, kind, cost, tokens, turns."""
    u, t = priced(spark, sf), turns(spark, sf)
    loops = T.stuck_loops(D.calls(spark, sf), t).select("session_id", F.lit("stuck-loop").alias("kind"), F.col("n_calls").alias("tokens"), F.floor("pico").cast(DEC).alias("pico"), "turns")
    thrash = T.context_thrash(t, D.compactions(spark, sf), u).select("session_id", F.lit("context-thrash").alias("kind"), "tokens", F.col("pico").cast(DEC).alias("pico"), F.sequence("first_turn", F.col("first_turn") + F.col("turn_span")).alias("turns"))
    trivial = T.trivial_spans(u, D.calls(spark, sf), P.cheapest_current(D.prices(spark)), most=2000).select("session_id", F.lit("trivial-spans").alias("kind"), "tokens", F.col("pico").cast(DEC).alias("pico"), "turns")
    return loops.unionByName(thrash).unionByName(trivial)


def waste_class_rollup(spark, sf):
    out = V.class_rollup(findings(spark, sf))
    return out.select("kind", "n_findings", F.round(F.col("pico").cast("double") / 1e12, 8).alias("usd"), "tokens", "n_sessions", F.col("rank").cast("long").alias("rank"))


def overlap_flags(spark, sf):
    return V.overlaps(findings(spark, sf), "context-thrash", "stuck-loop")


def recurrence_rules(spark, sf):
    rules = spark.createDataFrame([("stuck-loop", "break loops"), ("context-thrash", "split sessions"), ("other", "nothing")], "kind string, rule string")
    return V.recurrence(findings(spark, sf), rules)


def headline_pattern(spark, sf):
    return V.headline(findings(spark, sf)).select("session_id", "kind", "tokens", F.round(F.col("pico").cast("double") / 1e12, 9).alias("usd"))


QUERIES = {f.__name__: f for f in (stuck_loops, rereads, same_file_rereads, scoped_sessions, trivial_spans, refills, context_thrash, cost_shape, time_caveats, waste_class_rollup, overlap_flags, recurrence_rules, headline_pattern)}

_LOOPS = """, rn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY call_ord) - row_number() OVER (PARTITION BY session_id, name, input_json ORDER BY call_ord) AS island, count(*) OVER (PARTITION BY session_id, turn_index) AS n FROM calls),
loops AS (SELECT session_id, name AS tool, min(call_ord) AS start_ord, count(*) AS n_calls, CASE WHEN bool_and(coalesce(complete, false)) THEN sum(CAST(pico AS DOUBLE) / n) END AS pico, arg_max(ended_ms, call_ord) - arg_min(started_ms, call_ord) AS wall_ms, list_distinct(list(turn_index)) AS turns
  FROM rn LEFT JOIN turns USING (session_id, turn_index) GROUP BY session_id, name, input_json, island HAVING count(*) >= 3)"""
_THRASH = """, pk AS (SELECT session_id, turn_index, max(input + cache_read + cache_creation) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(input + cache_read + cache_creation) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS after FROM turns),
hits AS (SELECT session_id, turn_index FROM pk JOIN compactions USING (session_id, turn_index) WHERE before > 0 AND after * 10 >= before * 8),
lagged AS (SELECT *, turn_index - lag(turn_index) OVER (PARTITION BY session_id ORDER BY turn_index) AS gap FROM hits),
numbered AS (SELECT *, sum(CASE WHEN gap <= 25 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY turn_index) AS cluster FROM lagged),
clusters AS (SELECT session_id, cluster, count(*) AS n_compactions, min(turn_index) AS first_turn, max(turn_index) AS last_turn FROM numbered GROUP BY ALL HAVING count(*) >= 2),
sliced AS (SELECT DISTINCT session_id, cluster, h.turn_index + o AS turn_index FROM numbered h JOIN clusters USING (session_id, cluster), (VALUES (0), (1), (2), (3), (4)) v(o) WHERE h.turn_index > first_turn),
thrash_cost AS (SELECT session_id, cluster, count(DISTINCT turn_index) AS n_turns, sum(input + cache_read + cache_creation) AS tokens, CASE WHEN bool_and(prompt_pico IS NOT NULL) THEN sum(prompt_pico) END AS pico FROM sliced JOIN priced USING (session_id, turn_index) GROUP BY ALL),
thrash AS (SELECT session_id, first_turn, n_compactions, last_turn - first_turn AS turn_span, n_turns, tokens, pico FROM clusters LEFT JOIN thrash_cost USING (session_id, cluster))"""
_TRIVIAL = """, quiet AS (SELECT session_id, turn_index, sum(output) AS output, bool_and(coalesce(pico IS NOT NULL AND cheap_in < row_in, false)) AS dearer, sum(pico) AS pico, sum(least) AS least, sum(total) AS tokens FROM repriced WHERE (session_id, turn_index) NOT IN (SELECT session_id, turn_index FROM calls) GROUP BY ALL),
trivial AS (SELECT session_id, count(*) AS n_turns, sum(tokens) AS tokens, sum(pico) AS pico, sum(least) AS cheapest_pico, list_sort(list(turn_index)) AS turns FROM quiet WHERE dearer AND output <= 2000 GROUP BY session_id)"""
_ALL = SQL + _LOOPS + _THRASH + _TRIVIAL + """, findings AS (SELECT session_id, 'stuck-loop' AS kind, n_calls AS tokens, floor(pico) AS pico, turns FROM loops
UNION ALL SELECT session_id, 'context-thrash', CAST(tokens AS BIGINT), CAST(pico AS DOUBLE), range(first_turn, first_turn + turn_span + 1) FROM thrash UNION ALL SELECT session_id, 'trivial-spans', CAST(tokens AS BIGINT), CAST(pico AS DOUBLE), turns FROM trivial)"""

ORACLE_SQL = {
    "stuck_loops": SQL + _LOOPS + "SELECT session_id, tool, start_ord, n_calls, pico IS NOT NULL AS is_priced, round(pico / 1e12, 9) AS usd, wall_ms, CAST(len(turns) AS BIGINT) AS n_turns FROM loops",
    "same_file_rereads": SQL + """, c AS (SELECT session_id, turn_index, call_ord, event_type AS t, 'f' || (k % 10) || '.ts' AS f, event_id FROM e), r AS (SELECT *, lag(call_ord) OVER w AS bo, lag(turn_index) OVER w AS bt FROM c WHERE t = 'view' WINDOW w AS (PARTITION BY session_id, f ORDER BY call_ord)),
x AS (SELECT * FROM r WHERE bo IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c y WHERE y.session_id = r.session_id AND y.call_ord > bo AND y.call_ord < r.call_ord AND ((y.t = 'purchase' AND y.f = r.f) OR (y.t = 'click' AND (event_id % 40 = 0 OR (event_id % 5 = 1 AND y.f = r.f)))))
  AND NOT EXISTS (SELECT 1 FROM compactions z WHERE z.session_id = r.session_id AND z.turn_index > bt AND z.turn_index <= r.turn_index)),
n AS (SELECT session_id, turn_index, count(*) AS n FROM c GROUP BY ALL)
SELECT x.session_id, count(*) AS n_rereads, bool_and(complete AND pico IS NOT NULL) AS is_priced, round(CASE WHEN bool_and(complete AND pico IS NOT NULL) THEN sum(CAST(pico AS DOUBLE) / n) END / 1e12, 9) AS usd, round(sum(CAST(total AS DOUBLE) / n), 3) AS tokens, string_agg(DISTINCT CAST(x.turn_index AS VARCHAR), ',' ORDER BY length(CAST(x.turn_index AS VARCHAR)), CAST(x.turn_index AS VARCHAR)) AS turns
FROM x JOIN n USING (session_id, turn_index) JOIN turns USING (session_id, turn_index) GROUP BY x.session_id""",
    "scoped_sessions": SQL + """, p AS (SELECT session_id, CAST(regexp_extract(session_id, '^([0-9]+)', 1) AS BIGINT) AS u FROM sessions), h AS (SELECT CASE u % 11 WHEN 0 THEN '/home/u' WHEN 1 THEN '/' ELSE '/home/u/proj' || (u % 6) END AS at FROM p),
q AS (SELECT DISTINCT '/home/u/proj' || (u % 6) || CASE WHEN u % 2 = 0 THEN '/src//lib/' ELSE '/../proj1' END AS request, CASE WHEN u % 2 = 0 THEN '/home/u/proj' || (u % 6) || '/src/lib' ELSE '/home/u/proj1' END AS at FROM p UNION ALL VALUES ('/home/u', '/home/u'), ('/', '/'))
SELECT request, count(*) AS n_sessions FROM q JOIN h ON h.at = q.at OR (h.at NOT IN ('/', '/home/u') AND starts_with(q.at, h.at || '/')) GROUP BY request""",
    "rereads": SQL + ", t AS (SELECT *, lag(call_ord) OVER w AS before_ord, lag(name) OVER w AS before_name FROM calls WHERE name = 'view' OR name = 'purchase' WINDOW w AS (PARTITION BY session_id, path ORDER BY call_ord)) SELECT session_id, path, call_ord, before_ord FROM t WHERE name = 'view' AND before_name = 'view' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.name = 'click' AND c.session_id = t.session_id AND c.path = t.path AND c.call_ord > t.before_ord AND c.call_ord <= t.call_ord)",
    "trivial_spans": SQL + _TRIVIAL + "SELECT session_id, n_turns, CAST(tokens AS BIGINT) AS tokens, CAST(pico AS DECIMAL(38,0)) AS pico, CAST(cheapest_pico AS DECIMAL(38,0)) AS cheapest_pico, array_to_string(turns, ',') AS turns FROM trivial",
    "refills": SQL + _THRASH + "SELECT session_id, turn_index FROM hits",
    "context_thrash": SQL + _THRASH + "SELECT session_id, first_turn, n_compactions, turn_span, n_turns, CAST(tokens AS BIGINT) AS tokens, CAST(pico AS DECIMAL(38,0)) AS pico FROM thrash",
    "cost_shape": SQL + ", f AS (SELECT *, count(*) OVER s AS n, bool_and(complete) OVER s AS whole, row_number() OVER (PARTITION BY session_id ORDER BY pico DESC, turn_index) AS rk, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS rn FROM turns WINDOW s AS (PARTITION BY session_id)), ed AS (SELECT session_id, min(turn_index) AS edit FROM calls WHERE name = 'purchase' GROUP BY ALL), g AS (SELECT session_id, max(n) AS n_turns, sum(pico) AS pico, CASE WHEN max(edit) IS NOT NULL THEN sum(CASE WHEN turn_index < edit THEN pico ELSE 0 END) END AS b, sum(CASE WHEN rk <= 3 THEN pico END) AS top, avg(CASE WHEN rn <= n // 2 THEN CAST(pico AS DOUBLE) END) AS early, avg(CASE WHEN rn > n // 2 THEN CAST(pico AS DOUBLE) END) AS late FROM f LEFT JOIN ed USING (session_id) WHERE whole GROUP BY session_id) SELECT session_id, n_turns, CAST(pico AS DECIMAL(38,0)) AS pico, CAST(b AS DECIMAL(38,0)) AS pre_edit_pico, CAST(top AS DECIMAL(38,0)) AS top3_pico, CASE WHEN n_turns >= 4 AND early > 0 THEN round(late / early, 1) END AS late_ratio FROM g",
    "time_caveats": SQL + "SELECT session_id, 'turn after file time' AS caveat FROM sessions WHERE tokens * 10 > 120000 UNION ALL SELECT session_id, 'no span of time' FROM sessions WHERE tokens > 0",
    "waste_class_rollup": _ALL + "SELECT kind, count(*) AS n_findings, round(sum(pico) / 1e12, 8) AS usd, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT session_id) AS n_sessions, row_number() OVER (ORDER BY sum(pico) DESC NULLS LAST, sum(tokens) DESC, kind) AS rank FROM findings GROUP BY kind",
    "overlap_flags": _ALL + ", x AS (SELECT DISTINCT session_id, kind, unnest(turns) AS t FROM findings) SELECT a.session_id, count(*) AS n_turns FROM x a JOIN x b ON a.session_id = b.session_id AND a.t = b.t AND a.kind = 'context-thrash' AND b.kind = 'stuck-loop' GROUP BY a.session_id",
    "recurrence_rules": _ALL + "SELECT kind, count(DISTINCT session_id) AS n_sessions, CASE kind WHEN 'stuck-loop' THEN 'break loops' ELSE 'split sessions' END AS rule FROM findings WHERE kind IN ('stuck-loop', 'context-thrash') GROUP BY kind HAVING count(DISTINCT session_id) >= 3",
    "headline_pattern": _ALL + ", k AS (SELECT session_id, kind, sum(pico) AS pico, CAST(sum(tokens) AS BIGINT) AS tokens FROM findings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(pico, -1) DESC, kind DESC) AS rn FROM k) SELECT session_id, max(CASE WHEN rn = 1 THEN kind END) AS kind, max(tokens) AS tokens, round(max(pico) / 1e12, 9) AS usd FROM r GROUP BY session_id",
}
