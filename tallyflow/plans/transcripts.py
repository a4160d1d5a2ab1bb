"""Queries of the normalisers, over lines made from ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import usage as U
from tallyflow.sources import codex as X
from tallyflow.sources import jsonl as J
from tallyflow.sources import normalize as N
from tallyflow.plans import derive as D
from tallyflow.plans.derive import SQL
from tallyflow.streaming import ingest as S
from tallyflow.plans.cost import priced


def lines(spark, sf):
    """JSON lines of one message each: an id that comes again with other usage, some without id, some malformed."""
    e = D.events(spark, sf)
    usage = F.struct(F.when(F.col("event_id") % 31 == 7, F.lit("oops")).otherwise(F.col("input").cast("string")).alias("input_tokens"), (F.col("k") * 3).alias("output_tokens"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 7 * 100).alias("cache_creation_input_tokens"))
    message = F.struct(F.when(F.col("event_id") % 13 > 0, F.concat(F.lit("m"), (F.col("call_ord") / 3).cast("int").cast("string"))).alias("id"), F.lit("alpha-large").alias("model"), usage.alias("usage"))
    line = F.to_json(F.struct(F.when(F.col("event_id") % 151 == 3, F.lit("fork-context-ref")).when(F.col("event_id") % 53 == 1, F.lit("compact_boundary")).otherwise(F.lit("assistant")).alias("type"), F.col("ts_ms").alias("timestamp"), message.alias("message")))
    return e.select(F.col("session_id").alias("file"), F.col("call_ord").alias("line_no"), F.when(F.col("event_id") % 211 == 5, F.lit("{not json")).otherwise(line).alias("line"))


def claude_turns(spark, sf):
    good, _ = J.split_bad(lines(spark, sf))
    t = N.claude_turns(good)
    return t.select("file", "turn_index", "key", "ts_ms", "units_state", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"), F.col("usage.cache_creation").alias("cache_creation"), F.col("usage.total").alias("total"))


def claude_unattributed(spark, sf):
    good, _ = J.split_bad(lines(spark, sf))
    return N.claude_unattributed(good).select("file", "valid", F.col("usage.output").alias("output"))


def header_lines(spark, sf):
    """Sign-ups are titles, views the user's texts (every third an echo of the tool), clicks blocks of text, errors meta records."""
    e = D.events(spark, sf)
    text = lambda c: c.cast("string")
    at = F.concat(F.lit('"timestamp":'), text(F.col("ts_ms")))
    word = F.concat(F.when(F.col("event_id") % 3 == 0, "<command-name>clear").otherwise(" what  is\\u001b[1m "), text(F.col("k")))
    t = F.col("event_type")
    line = F.when(F.col("event_id") % 151 == 3, F.lit('{"type":"fork-context-ref"}')).when((t == "signup") & (F.col("uid") % 2 == 0), F.concat(F.lit('{"type":"ai-title","aiTitle":"About '), text(F.col("k")), F.lit('"}')))
    line = line.when(t == "view", F.concat(F.lit('{"type":"user",'), at, F.lit(',"cwd":"/p'), text(F.col("k") % 4), F.lit('","message":{"content":"'), word, F.lit('"}}')))
    line = line.when(t == "click", F.concat(F.lit('{"type":"user",'), at, F.lit(',"message":{"content":[{"type":"image"},{"type":"text","text":"block '), text(F.col("k")), F.lit('"}]}}')))
    line = line.when(t == "error", F.concat(F.lit('{"type":"user","isMeta":true,"gitBranch":"b'), text(F.col("k") % 3), F.lit('",'), at, F.lit(',"message":{"content":"meta"}}')))
    line = line.otherwise(F.concat(F.lit('{"type":"assistant",'), at, F.lit(',"isSidechain":'), F.when(F.col("event_id") % 50 == 7, "true").otherwise("false"), F.lit(',"message":{"model":"m'), text(F.col("k") % 3), F.lit('","content":[]}}')))
    return e.select(F.col("session_id").alias("file"), F.col("call_ord").alias("line_no"), line.alias("line"))


def session_headers(spark, sf):
    return N.claude_headers(header_lines(spark, sf))


def claude_compactions(spark, sf):
    good, _ = J.split_bad(lines(spark, sf))
    return N.claude_compactions(good)


def dropped_records(spark, sf):
    return J.split_bad(lines(spark, sf))[1]


def first_lines(spark, sf):
    first = J.first_lines(J.split_bad(lines(spark, sf))[0])
    return first.select("file", N.get("type").alias("type"), N.get("message.id").alias("id"))


def snapshot_merge(spark, sf):
    e = D.events(spark, sf)
    rows = e.select("session_id", (F.col("k") % 5).alias("msg"), F.col("call_ord").alias("line_no"), F.struct(F.col("input"), (F.col("k") % 20).alias("output")).alias("usage"), (F.col("event_id") % 4 > 0).alias("valid"))
    return N.merge_snapshots(rows, ["session_id", "msg"]).select("session_id", "msg", "first_line", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"), "valid")


def totals(spark, sf):
    """Running totals; the events of the type error repeat the total before, and every ninth session's fall once."""
    from pyspark.sql import Window as W

    w = W.partitionBy("session_id").orderBy("call_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = D.events(spark, sf)
    step = lambda c: F.sum(F.when(F.col("event_type") == "error", 0).otherwise(c)).over(w)
    fall = F.when((F.col("uid") % 9 == 0) & (F.col("call_ord") == 10), 10_000_000).otherwise(0)
    return e.select("session_id", "uid", "call_ord", (step(F.col("input")) - fall).cast("long").alias("input"), step(F.col("k")).cast("long").alias("output"), step(F.lit(1)).cast("long").alias("cache_read"))


def cumulative_delta(spark, sf):
    d = N.cumulative_deltas(totals(spark, sf), "session_id", "call_ord")
    return d.select("session_id", "call_ord", "d_input", "d_output", "d_cache_read", "monotone")


def trusted_deltas(spark, sf):
    d = N.trusted(N.cumulative_deltas(totals(spark, sf), "session_id", "call_ord"), "session_id")
    return d.groupBy("session_id").agg(F.count("*").alias("n_units"), F.sum("d_input").alias("input"), F.sum("d_output").alias("output"))


def billed_requests(spark, sf):
    """Every fifth session goes on with another's totals; one report in some sessions is wrong, and in some the first is missing."""
    from pyspark.sql import Window as W

    e = D.events(spark, sf).select("session_id", "uid", "call_ord", F.col("input").alias("last_input"), F.col("k").alias("last_output"), F.lit(1).alias("last_cache_read"))
    base = F.when(F.col("uid") % 5 == 0, 700).otherwise(0)
    first = F.row_number().over(W.partitionBy("session_id").orderBy("call_ord")) == 1
    wrong = F.when((F.col("uid") % 7 == 3) & (F.col("call_ord") == 4), 1).otherwise(0)
    both = totals(spark, sf).drop("uid").join(e, ["session_id", "call_ord"]).withColumn("input", F.col("input") + base)
    both = both.withColumn("last_output", F.when(~(first & (F.col("uid") % 11 == 0)), F.col("last_output") + wrong))
    d = N.requests(both, "session_id", "call_ord")
    billed = lambda c: F.coalesce(F.sum(F.when(F.col("consistent"), F.col(f"d_{c}"))), F.lit(0)).cast("long").alias(c)
    rest = lambda c: F.max(F.when(~F.col("consistent"), F.col(f"over_{c}")).otherwise(0)).cast("long").alias(f"unattributed_{c}")
    n = F.sum(F.when(F.col("consistent"), 1).otherwise(0)).alias("n_requests")
    return d.groupBy("session_id", "consistent").agg(n, F.max("base_input").cast("long").alias("inherited_input"), billed("input"), billed("output"), rest("input"), rest("output"))


def total_lines(spark, sf):
    """JSON lines of running totals and reports, a line an event, by the session's number modulo 12.

    0 is plain; 1 goes on with another log's total; 2 begins with a total of 0; 3 has a single message's usage first, 6 no totals at
    all but such messages; 4 has a count in words, 5 a broken line, 7 no first report, 8 a report alone, 9 a total that falls;
    10 repeats totals with their report, 11 states more reasoning than output. Sign-ups are messages of the user.
    """
    from pyspark.sql import Window as W

    e = D.events(spark, sf).withColumn("kind", F.col("uid") % 12)
    w = W.partitionBy("session_id").orderBy("call_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    user, again = F.col("event_type") == "signup", (F.col("kind") == 10) & (F.col("event_type") == "error")
    step = lambda c: F.when(user | again, 0).otherwise(c)
    at = lambda k, ord: (F.col("kind") == k) & (F.col("call_ord") == ord)
    start = F.when(F.col("kind") == 1, 700).otherwise(0)
    e = e.select("*", (F.sum(step(F.col("input") + F.col("k") % 3)).over(w) + start - F.when(at(9, 4), 1_000_000).otherwise(0)).alias("t_in"), (F.sum(step(F.col("k") % 3)).over(w)).alias("t_cached"), F.sum(step(F.col("k"))).over(w).alias("t_out"))
    text = lambda c: c.cast("string")
    use = lambda i, c, o, more="": F.concat(F.lit('{"input_tokens":'), text(i), F.lit(',"cached_input_tokens":'), text(c), F.lit(',"output_tokens":'), text(o), F.lit(more + "}"))
    l_in, l_cached, l_out = F.col("input") + F.col("k") % 3, F.col("k") % 3, F.col("k")
    zero = (F.col("kind") == 2) & (F.col("call_ord") == 0)
    total = F.when(at(4, 3), F.lit('{"input_tokens":"many"}')).when(at(11, 2), use(F.col("t_in"), F.col("t_cached"), F.col("t_out"), ',"reasoning_output_tokens":999999999')).otherwise(use(F.greatest(F.lit(0), "t_in"), F.col("t_cached"), F.col("t_out")))
    last = F.when((F.col("kind") == 7) & (F.col("call_ord") == 0), F.lit("")).otherwise(F.concat(F.lit(',"last_token_usage":'), use(l_in, l_cached, l_out)))
    info = F.when(zero, F.lit('"total_token_usage":{"input_tokens":0}')).when(at(8, 3), F.concat(F.lit('"last_token_usage":'), use(l_in, l_cached, l_out))).otherwise(F.concat(F.lit('"total_token_usage":'), total, last))
    single = (F.col("kind") == 6) | at(3, 0)
    line = F.when(at(5, 2), F.lit("{broken")).when(user, F.lit('{"payload":{"type":"user_message","message":"x"}}')).when(single, F.concat(F.lit('{"payload":{"type":"message","usage":'), use(l_in, l_cached, l_out), F.lit("}}")))
    line = line.otherwise(F.concat(F.lit('{"payload":{"type":"token_count","model":"alpha-large","info":{'), info, F.lit("}}}")))
    return e.select(F.col("session_id").alias("file"), F.col("call_ord").alias("line_no"), line.alias("line"))


def codex_evidence(spark, sf):
    """Which logs prove their requests, and what they come to."""
    return X.evidence(total_lines(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


def codex_requests(spark, sf):
    return X.units(total_lines(spark, sf)).select("file", "line_no", "turn_index", "input", "output", "cache_read")


def assistant_turns(spark, sf):
    """A user's message ends the turn."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", F.col("turn").alias("line_no"), "role", F.length("text").cast("long").alias("n_chars"))
    return N.segment_turns(c, F.col("role") == "user", key="conv_id").select("conv_id", "line_no", "role", "turn_index", "n_chars")


def model_in_force(spark, sf):
    e = D.events(spark, sf).withColumn("model", F.when(F.col("event_type") == "signup", F.concat(F.lit("m"), (F.col("k") % 4).cast("string"))))
    return N.last_seen(e, "model", "session_id", "call_ord").groupBy("model").agg(F.count("*").alias("n"), F.sum("input").alias("input"))


def reconcile(spark, sf):
    i = D.units(spark, sf).groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_creation")])
    x = F.col("session_id").cast("int") % 4
    s = i.select("session_id", (F.col("input") + F.when(x == 1, 5).when(x == 3, 7).otherwise(0)).alias("input"), (F.col("output") - F.when(x.isin(2, 3), 1).otherwise(0)).alias("output"), "cache_read", "cache_creation")
    return N.reconcile_aggregate(s, i)


def usage_validity(spark, sf):
    u = D.units(spark, sf).withColumn("total", F.col("total") + (F.col("input") % 50 == 0).cast("long")).withColumn("cc_1h", F.when(F.col("input") % 7 == 0, F.col("cache_creation")).otherwise(F.col("cc_1h"))).withColumn("output", F.when(F.col("input") % 11 == 0, -1).otherwise(F.col("output")))
    return u.groupBy("model").agg(F.sum(U.is_priceable().cast("long")).alias("n_priceable"), F.count("*").alias("n"))


def incremental_summaries(spark, sf):
    """A listing against a manifest of which every fifth file has changed and every seventh is new."""
    s = D.sessions(spark, sf).select(F.col("session_id").alias("file"), F.col("ended_ms").alias("mtime_ms"), F.col("tokens").alias("size"))
    manifest = s.where("size % 7 <> 0").withColumn("size", F.when(F.col("size") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return J.changed_files(s, manifest)


def windowed_usage(spark, sf):
    return S.windowed_usage(priced(spark, sf))


def gemini_replay(spark, sf):
    """Messages with rewinds: order decides, which SQL can't follow; tests hold it against a plain replay."""
    e = D.events(spark, sf)
    mid = lambda c: F.concat(F.lit("m"), c.cast("string"))
    line = F.when(F.col("event_id") % 19 == 3, F.concat(F.lit('{"$rewindTo": "'), mid(F.col("call_ord") - 2), F.lit('"}'))).otherwise(F.to_json(F.struct(mid(F.col("call_ord") - F.col("k") % 3).alias("id"), F.lit("gemini").alias("type"), F.lit("gemini-x").alias("model"), F.struct(F.col("input"), F.col("k").alias("cached"), F.col("k").alias("output")).alias("tokens"))))
    t = N.gemini_turns(e.select(F.col("session_id").alias("file"), F.col("call_ord").alias("line_no"), line.alias("line")))
    return t.select("file", "turn_index", "id", F.col("usage.input").alias("input"), F.col("usage.total").alias("total"))


def compaction_pairs(spark, sf):
    """Markers of two forms pair up by what was paired before; tests hold it against a plain loop."""
    e = D.events(spark, sf).where("event_type in ('click', 'view')")
    return N.pair_compactions(e.select(F.col("session_id").alias("file"), F.col("call_ord").alias("line_no"), F.col("event_type").alias("form"), F.floor(F.col("turn_index") / 4).cast("long").alias("turn_index"), "ts_ms"), within_ms=10**8)


QUERIES = {f.__name__: f for f in (claude_turns, claude_unattributed, claude_compactions, session_headers, dropped_records, first_lines, snapshot_merge, cumulative_delta, trusted_deltas, billed_requests, codex_evidence, codex_requests, assistant_turns, model_in_force, reconcile, usage_validity, incremental_summaries, windowed_usage, gemini_replay, compaction_pairs)}

_LINES = """, ln AS (SELECT session_id AS file, call_ord AS line_no, ts_ms, event_id, k, CASE WHEN event_id % 13 > 0 THEN 'm' || (call_ord // 3) END AS id, CASE WHEN event_id % 151 = 3 THEN 'fork-context-ref' WHEN event_id % 53 = 1 THEN 'compact_boundary' ELSE 'assistant' END AS type,
  event_id % 31 <> 7 AS valid, input, k * 3 AS output, CASE WHEN event_id % 2 = 0 THEN event_id % 7 * 100 ELSE 0 END AS cw FROM e WHERE event_id % 211 <> 5),
fk AS (SELECT *, max(CASE WHEN type = 'fork-context-ref' THEN line_no END) OVER (PARTITION BY file) AS fork FROM ln), own AS (SELECT *, coalesce(id, 'line:' || line_no) AS key FROM fk WHERE fork IS NULL OR line_no > fork),
a AS (SELECT * FROM own WHERE type = 'assistant'), tk AS (SELECT file, key, min(line_no) AS l, arg_min(ts_ms, line_no) AS ts_ms, bool_or(id IS NOT NULL) AS named FROM a GROUP BY ALL),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY valid DESC, CASE WHEN valid THEN output ELSE -1 END DESC, line_no DESC) AS rn FROM a WHERE id IS NOT NULL) WHERE rn = 1)"""
#: The lines of ``total_lines`` as numbers, and the rules on them: r are all records, c those with a running total, m the single messages.
_CODEX = SQL + """, x AS (SELECT *, uid % 12 AS kind, event_type = 'signup' AS usr, uid % 12 = 10 AND event_type = 'error' AS again, input + k % 3 AS l_in, k % 3 AS l_c, k AS l_out FROM e),
y AS (SELECT *, CASE WHEN kind = 1 THEN 700 ELSE 0 END + sum(CASE WHEN usr OR again THEN 0 ELSE l_in END) OVER w - CASE WHEN kind = 9 AND call_ord = 4 THEN 1000000 ELSE 0 END AS ti, sum(CASE WHEN usr OR again THEN 0 ELSE l_c END) OVER w AS tc, sum(CASE WHEN usr OR again THEN 0 ELSE l_out END) OVER w AS tout
  FROM x WINDOW w AS (PARTITION BY uid ORDER BY call_ord ROWS UNBOUNDED PRECEDING)),
r AS MATERIALIZED (SELECT session_id AS file, call_ord AS line_no, kind, usr, l_in - l_c AS li, l_c AS lc, l_out AS lo, NOT (kind = 6 OR (kind = 3 AND call_ord = 0)) AND NOT usr AS info, (kind = 6 OR (kind = 3 AND call_ord = 0)) AND NOT usr AS msg, kind = 5 AND call_ord = 2 AS broken,
  (kind = 4 AND call_ord = 3) OR (kind = 11 AND call_ord = 2) OR (greatest(0, ti) < tc) AS bad_total, kind = 2 AND call_ord = 0 AS zero, kind = 8 AND call_ord = 3 AS alone, NOT ((kind = 7 AND call_ord = 0) OR (kind = 2 AND call_ord = 0)) AS has_last, greatest(0, ti) - tc AS ti, tc, tout AS tout FROM y),
good AS (SELECT * FROM r WHERE NOT broken AND NOT usr),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS n, lag(ti) OVER v AS pi, lag(tc) OVER v AS pc, lag(tout) OVER v AS po, has_last AND li + lc + lo > 0 AS rep FROM good WHERE info AND NOT zero AND NOT alone AND NOT bad_total AND ti + tc + tout > 0 WINDOW v AS (PARTITION BY file ORDER BY line_no)),
base AS (SELECT file, CASE WHEN rep THEN greatest(0, ti - li) ELSE 0 END AS bi, CASE WHEN rep THEN greatest(0, tc - lc) ELSE 0 END AS bc, CASE WHEN rep THEN greatest(0, tout - lo) ELSE 0 END AS bo FROM c WHERE n = 1),
m AS (SELECT g.* FROM good g WHERE msg AND li + lc + lo > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.file = g.file AND c.line_no <= g.line_no)),
q AS MATERIALIZED (SELECT file, line_no, CASE WHEN n > 1 THEN ti - pi WHEN has_last THEN li ELSE 0 END AS input, CASE WHEN n > 1 THEN tout - po WHEN has_last THEN lo ELSE 0 END AS output, CASE WHEN n > 1 THEN tc - pc WHEN has_last THEN lc ELSE 0 END AS cache_read FROM c WHERE n = 1 OR ti <> pi OR tc <> pc OR tout <> po UNION ALL SELECT file, line_no, li, lo, lc FROM m),
faults AS (SELECT DISTINCT file, 'dropped' AS reason FROM r WHERE broken
 UNION SELECT file, 'malformed' FROM good WHERE info AND bad_total AND NOT zero AND NOT alone
 UNION SELECT file, 'mixed' FROM m WHERE EXISTS (SELECT 1 FROM c WHERE c.file = m.file)
 UNION SELECT file, 'report-alone' FROM good WHERE info AND NOT zero AND has_last AND (alone OR bad_total OR (ti + tc + tout = 0 AND li + lc + lo > 0))
 UNION SELECT file, 'totals' FROM c WHERE (n = 1 AND (NOT rep OR ti < li OR tc < lc OR tout < lo)) OR (n > 1 AND (ti <> pi OR tc <> pc OR tout <> po) AND (NOT rep OR ti - pi <> li OR tc - pc <> lc OR tout - po <> lo)))"""

ORACLE_SQL = {
    "codex_evidence": _CODEX + """, seen AS (SELECT file, line_no, 0 AS p, li AS i, lo AS o, lc AS c FROM good WHERE info AND NOT zero AND has_last AND li + lc + lo > 0
 UNION ALL SELECT file, line_no, 1, greatest(0, ti - bi), greatest(0, tout - bo), greatest(0, tc - bc) FROM c JOIN base USING (file) UNION ALL SELECT file, line_no, 2, li, lo, lc FROM m),
most AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY file ORDER BY i + o + c DESC, line_no, p) = 1),
ends AS (SELECT file, i, o, c FROM seen WHERE p = 1 QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no DESC) = 1 UNION ALL SELECT file, sum(i), sum(o), sum(c) FROM seen s WHERE p = 2 AND NOT EXISTS (SELECT 1 FROM c WHERE c.file = s.file) GROUP BY file),
f AS (SELECT file, string_agg(reason, ',' ORDER BY reason) AS reasons FROM faults GROUP BY file),
s AS (SELECT file, count(*) FILTER (input + output + cache_read > 0) AS n, sum(input) AS i, sum(output) AS o, sum(cache_read) AS c FROM q GROUP BY file),
k AS (SELECT DISTINCT file FROM good WHERE info OR msg)
SELECT file, coalesce(reasons, '') AS reasons, CASE WHEN reasons IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_requests,
  CAST(CASE WHEN reasons IS NULL THEN coalesce(s.i, 0) WHEN e2.i + e2.o + e2.c >= m2.i + m2.o + m2.c THEN e2.i ELSE coalesce(m2.i, 0) END AS BIGINT) AS input, CAST(CASE WHEN reasons IS NULL THEN coalesce(s.o, 0) WHEN e2.i + e2.o + e2.c >= m2.i + m2.o + m2.c THEN e2.o ELSE coalesce(m2.o, 0) END AS BIGINT) AS output,
  CAST(CASE WHEN reasons IS NULL THEN coalesce(s.c, 0) WHEN e2.i + e2.o + e2.c >= m2.i + m2.o + m2.c THEN e2.c ELSE coalesce(m2.c, 0) END AS BIGINT) AS cache_read, CAST(coalesce(bi + bc + bo, 0) AS BIGINT) AS inherited
FROM k LEFT JOIN f USING (file) LEFT JOIN s USING (file) LEFT JOIN base USING (file) LEFT JOIN ends e2 USING (file) LEFT JOIN most m2 USING (file)""",
    "codex_requests": _CODEX + """, t AS (SELECT file, line_no, sum(CASE WHEN usr THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS island, usr FROM r WHERE NOT broken), u AS (SELECT file, line_no, dense_rank() OVER (PARTITION BY file ORDER BY island) - 1 AS turn_index FROM t WHERE NOT usr)
SELECT file, line_no, turn_index, CAST(input AS BIGINT) AS input, CAST(output AS BIGINT) AS output, CAST(cache_read AS BIGINT) AS cache_read FROM q JOIN u USING (file, line_no) WHERE input + output + cache_read > 0 AND file NOT IN (SELECT file FROM faults)""",
    "claude_turns": SQL + _LINES + "SELECT tk.file, row_number() OVER (PARTITION BY tk.file ORDER BY l) - 1 AS turn_index, tk.key, tk.ts_ms, CASE WHEN NOT named THEN 'none' WHEN valid THEN 'implicit' ELSE 'explicit' END AS units_state, CASE WHEN valid THEN input END AS input, CASE WHEN valid THEN output END AS output, CASE WHEN valid THEN cw END AS cache_creation, CASE WHEN valid THEN input + output + cw END AS total FROM tk LEFT JOIN bs USING (file, key)",
    "claude_unattributed": SQL + _LINES + "SELECT file, valid, output FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY valid DESC, CASE WHEN valid THEN output ELSE -1 END DESC, line_no DESC) AS rn FROM a WHERE id IS NULL) WHERE rn = 1",
    "claude_compactions": SQL + _LINES + ", n AS (SELECT *, (SELECT count(*) FROM tk WHERE tk.file = own.file AND tk.l < own.line_no) AS t FROM own WHERE type = 'compact_boundary') SELECT file, t AS turn_index, arg_min(ts_ms, line_no) AS ts_ms FROM n GROUP BY ALL",
    "dropped_records": SQL + "SELECT session_id AS file, CAST(sum(CASE WHEN event_id % 211 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_records FROM e GROUP BY ALL",
    "first_lines": SQL + _LINES + "SELECT file, arg_min(type, line_no) AS type, arg_min(coalesce(id, '-'), line_no) AS id_ FROM ln GROUP BY file",
    "snapshot_merge": SQL + ", r AS (SELECT session_id, k % 5 AS msg, call_ord, input, k % 20 AS output, event_id % 4 > 0 AS valid FROM e), n AS (SELECT *, min(call_ord) OVER (PARTITION BY session_id, msg) AS first_line, row_number() OVER (PARTITION BY session_id, msg ORDER BY valid DESC, CASE WHEN valid THEN output ELSE -1 END DESC, call_ord DESC) AS rn FROM r) SELECT session_id, msg, first_line, input, output, valid FROM n WHERE rn = 1",
    "cumulative_delta": SQL + ", s AS (SELECT session_id, call_ord, CASE WHEN uid % 9 = 0 AND call_ord = 10 THEN 10000000 ELSE 0 END AS fall, CASE WHEN event_type = 'error' THEN 0 ELSE input END AS i, CASE WHEN event_type = 'error' THEN 0 ELSE k END AS o, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS c FROM e), t AS (SELECT session_id, call_ord, CAST(sum(i) OVER w - fall AS BIGINT) AS i, CAST(sum(o) OVER w AS BIGINT) AS o, CAST(sum(c) OVER w AS BIGINT) AS c FROM s WINDOW w AS (PARTITION BY session_id ORDER BY call_ord)), d AS (SELECT session_id, call_ord, i - coalesce(lag(i) OVER w, 0) AS di, o - coalesce(lag(o) OVER w, 0) AS dd, c - coalesce(lag(c) OVER w, 0) AS dc FROM t WINDOW w AS (PARTITION BY session_id ORDER BY call_ord)) SELECT session_id, call_ord, greatest(0, di) AS d_input, greatest(0, dd) AS d_output, greatest(0, dc) AS d_cache_read, di >= 0 AND dd >= 0 AND dc >= 0 AS monotone FROM d WHERE di <> 0 OR dd <> 0 OR dc <> 0",
    "trusted_deltas": SQL + "SELECT session_id, count(*) AS n_units, CAST(sum(input) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS output FROM e WHERE event_type <> 'error' AND session_id NOT IN (SELECT session_id FROM e WHERE uid % 9 = 0 AND call_ord = 10) GROUP BY session_id",
    "assistant_turns": "WITH m AS (SELECT conv_id, turn AS line_no, role, CAST(length(text) AS BIGINT) AS n_chars, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) SELECT conv_id, line_no, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS turn_index, n_chars FROM m WHERE role <> 'user'",
    "model_in_force": SQL + ", m AS (SELECT input, last_value(CASE WHEN event_type = 'signup' THEN 'm' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY call_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM e) SELECT model, count(*) AS n, CAST(sum(input) AS BIGINT) AS input FROM m GROUP BY model",
    "reconcile": SQL + "SELECT DISTINCT session_id, CASE CAST(session_id AS INT) % 4 WHEN 0 THEN 'equal' WHEN 1 THEN 'residual' WHEN 2 THEN 'items' ELSE 'conflicting' END AS state, CAST(CASE WHEN CAST(session_id AS INT) % 4 = 1 THEN 5 ELSE 0 END AS BIGINT) AS rest_input, CAST(0 AS BIGINT) AS rest_output, CAST(0 AS BIGINT) AS rest_cache_read, CAST(0 AS BIGINT) AS rest_cache_creation FROM units",
    "usage_validity": SQL + "SELECT model, CAST(sum(CASE WHEN input % 50 <> 0 AND input % 11 <> 0 AND coalesce(cc_5m, 0) + coalesce(CASE WHEN input % 7 = 0 THEN cache_creation ELSE cc_1h END, 0) <= cache_creation THEN 1 ELSE 0 END) AS BIGINT) AS n_priceable, count(*) AS n FROM units GROUP BY model",
    "incremental_summaries": SQL + "SELECT session_id AS file, ended_ms AS mtime_ms, CAST(tokens AS BIGINT) AS size FROM sessions WHERE tokens % 7 = 0 OR tokens % 5 = 0",
    "windowed_usage": SQL + "SELECT ts_ms // 604800000 * 604800000 AS start_ms, model, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(pico) AS DECIMAL(38,0)) AS pico, count(*) AS n_units FROM priced GROUP BY ALL",
}
ORACLE_SQL["first_lines"] = SQL + _LINES + "SELECT file, type, id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM ln) WHERE rn = 1"
ORACLE_SQL["billed_requests"] = SQL + """, s AS (SELECT session_id, uid, call_ord, row_number() OVER w AS rn, input AS ri, CASE WHEN row_number() OVER w = 1 AND uid % 11 = 0 THEN NULL ELSE k + CASE WHEN uid % 7 = 3 AND call_ord = 4 THEN 1 ELSE 0 END END AS ro,
  CASE WHEN event_type = 'error' THEN 0 ELSE input END AS i, CASE WHEN event_type = 'error' THEN 0 ELSE k END AS o, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY session_id ORDER BY call_ord)),
t AS (SELECT *, sum(i) OVER w - CASE WHEN uid % 9 = 0 AND call_ord = 10 THEN 10000000 ELSE 0 END + CASE WHEN uid % 5 = 0 THEN 700 ELSE 0 END AS ti, sum(o) OVER w AS t_o, sum(c) OVER w AS tc FROM s WINDOW w AS (PARTITION BY session_id ORDER BY call_ord)),
z AS (SELECT * REPLACE (row_number() OVER w AS rn) FROM t WHERE NOT (ti = 0 AND t_o = 0 AND tc = 0 AND ro IS NULL) WINDOW w AS (PARTITION BY session_id ORDER BY call_ord)),
g AS (SELECT *, ti - lag(ti) OVER w AS gi, t_o - lag(t_o) OVER w AS go, tc - lag(tc) OVER w AS gc FROM z WINDOW w AS (PARTITION BY session_id ORDER BY call_ord)),
b AS (SELECT session_id, CASE WHEN ro IS NOT NULL THEN ti - ri ELSE 0 END AS bi, CASE WHEN ro IS NOT NULL THEN t_o - ro ELSE 0 END AS bo, ro IS NOT NULL AND ti >= ri AND t_o >= ro AND tc >= 1 AS opens, coalesce(ro - ro + ri, ri) AS first_i, coalesce(ro, 0) AS first_o FROM g WHERE rn = 1),
f AS (SELECT session_id, count(*) FILTER (gi <> 0 OR go <> 0 OR gc <> 0) AS n, coalesce(bool_and(coalesce(gi = ri AND go = ro AND gc = 1 AND gi >= 0 AND go >= 0, FALSE)) FILTER (gi <> 0 OR go <> 0 OR gc <> 0), TRUE) AS follows, coalesce(sum(gi), 0) AS si, coalesce(sum(go), 0) AS so, max(ti) AS mi, max(t_o) AS mo FROM g GROUP BY session_id)
SELECT session_id, opens AND follows AS consistent, CAST(CASE WHEN opens AND follows THEN n + 1 ELSE 0 END AS BIGINT) AS n_requests, CAST(bi AS BIGINT) AS inherited_input, CAST(CASE WHEN opens AND follows THEN first_i + si ELSE 0 END AS BIGINT) AS input, CAST(CASE WHEN opens AND follows THEN first_o + so ELSE 0 END AS BIGINT) AS output,
  CAST(CASE WHEN opens AND follows THEN 0 ELSE greatest(0, mi - bi) END AS BIGINT) AS unattributed_input, CAST(CASE WHEN opens AND follows THEN 0 ELSE greatest(0, mo - bo) END AS BIGINT) AS unattributed_output FROM b JOIN f USING (session_id)"""

ORACLE_SQL["session_headers"] = SQL + """, h AS (SELECT *, max(CASE WHEN event_id % 151 = 3 THEN call_ord END) OVER (PARTITION BY session_id) AS fork FROM e), o AS (SELECT *, (event_type = 'signup' AND uid % 2 = 0) AS titled, event_type = 'purchase' OR (event_type = 'signup' AND uid % 2 = 1) AS bot FROM h WHERE fork IS NULL OR call_ord > fork),
w AS (SELECT *, CASE WHEN event_type = 'view' AND event_id % 3 <> 0 THEN 'what is ' || k WHEN event_type = 'click' THEN 'block ' || k END AS said, event_type IN ('view', 'click') OR bot AS timed FROM o)
SELECT session_id AS file, coalesce('About ' || arg_max(k, call_ord) FILTER (titled), arg_min(said, call_ord) FILTER (said IS NOT NULL)) AS title, arg_min('m' || (k % 3), call_ord) FILTER (bot) AS model, min(ts_ms) FILTER (timed) AS started_ms, max(ts_ms) FILTER (timed) AS ended_ms,
  arg_min('/p' || (k % 4), call_ord) FILTER (event_type = 'view') AS cwd, arg_min('b' || (k % 3), call_ord) FILTER (event_type = 'error') AS branch, coalesce(bool_or(event_id % 50 = 7 AND bot), FALSE) AS is_sidechain, count(said) AS n_user FROM w GROUP BY session_id"""
