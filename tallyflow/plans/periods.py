"""Queries of weeks, budgets, ranking and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import text as X
from tallyflow.operators import windows as V
from tallyflow.plans import derive as D
from tallyflow.plans.derive import NOW_MS, SQL


def labelled(spark, sf):
    s = D.sessions(spark, sf).withColumn("project", X.project_of(F.col("cwd"))).withColumn("degraded", F.lit(False))
    return V.label_weeks(V.aggregatable(V.top_level(s)), NOW_MS)


def week_current_prior(spark, sf):
    return V.window_totals(labelled(spark, sf), "source", "project")


def week_delta(spark, sf):
    return V.week_delta(V.window_totals(labelled(spark, sf), "source", "project"))


def coverage_counters(spark, sf):
    return V.window_totals(labelled(spark, sf)).select("window_label", "n_sessions", "n_full", "n_partial", "n_unpriced")


def budget_day_week(spark, sf):
    caps = spark.createDataFrame([("daily", "usd", 10**9), ("daily", "tokens", 10**9), ("weekly", "usd", 5 * 10**5), ("weekly", "tokens", 10**5)], "period string, unit string, cap long")
    return V.budgets(V.top_level(D.sessions(spark, sf)), caps, NOW_MS)


def grouping_sets_usage(spark, sf):
    """Several levels in one pass: by source and project, by source, over all."""
    s = labelled(spark, sf)
    out = s.rollup("source", "project").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_sessions"), F.sum("tokens").alias("tokens"), F.sum("pico").cast("decimal(38,0)").alias("pico"))
    return out.select("source", "project", "level", "n_sessions", "tokens", "pico")


def list_newest(spark, sf):
    return V.newest(D.sessions(spark, sf), 100, NOW_MS - V.WEEK_MS).select("session_id", "started_ms", "ended_ms", "title")


def select_by_title(spark, sf):
    return V.select_session(D.sessions(spark, sf), "title 11 OF").select("session_id", "title")


def select_by_number(spark, sf):
    return V.select_session(D.sessions(spark, sf), "7").select("session_id", "title")


def project_bucket(spark, sf):
    s = D.sessions(spark, sf).where(X.is_within(F.col("cwd"), F.lit("/home/u")))
    return s.groupBy(X.project_of(F.col("cwd")).alias("project"), X.glob_like(F.col("cwd"), "*/proj[0-2]*").alias("literal_glob"), X.glob_like(F.col("cwd"), "/home/*/proj*").alias("glob")).agg(F.count("*").alias("n_sessions"), F.sum("tokens").alias("tokens"))


def title_sanitize(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    dirty = F.concat(F.lit("\x1b[1m"), "text", F.lit("\x1b[0m\n"), F.lit("\x07 end"))
    return c.select("conv_id", "turn", X.truncate(X.sanitize(dirty)).alias("title"), X.slug(F.substring("text", 1, 40)).alias("slug"))


def burn_rate(spark, sf):
    """Cost per hour of sessions that are priced in full and took time."""
    s = D.sessions(spark, sf).where("pico is not null and unpriced_tokens = 0 and ended_ms > started_ms")
    hours = (F.col("ended_ms") - F.col("started_ms")) / 3_600_000
    return s.select("session_id", F.round(F.col("pico").cast("double") / hours, 3).alias("pico_per_hour"), X.duration(F.col("ended_ms") - F.col("started_ms")).alias("took"))


def quota_eta(spark, sf):
    """Two readings of a quota in a row tell when it is full, where all guards hold; its window is seven days, some readings are copies
    of the one before, and some clocks go back."""
    shift = F.when(F.col("event_id") % 13 == 0, -900_000_000).otherwise(0)
    e = D.events(spark, sf).select("session_id", "call_ord", (F.col("ts_ms") + shift).alias("observed_ms"), F.col("k").alias("used"), (F.floor(F.col("ts_ms") / 604_800_000) * 604_800_000 + 604_800_000).cast("long").alias("resets_ms"))
    e = V.cap_crossing(e, "session_id", "call_ord").where("crossing_ms is not null")
    return e.groupBy("session_id").agg(F.count("*").alias("n"), F.max("used").alias("most"), F.min(F.col("crossing_ms") - F.col("observed_ms")).alias("least_eta_ms"), F.max(F.col("crossing_ms") - F.col("observed_ms")).alias("most_eta_ms"))


def bucket_counts(spark, sf):
    s = D.sessions(spark, sf)
    took = X.bucket(F.col("ended_ms") - F.col("started_ms"), [3_600_000, 86_400_000, 7 * 86_400_000], ["hour", "day", "week", "more"])
    return s.groupBy(took.alias("took"), X.bucket(F.col("tokens"), [10_000, 50_000], ["small", "middle", "large"]).alias("size")).agg(F.count("*").alias("n_sessions"))


QUERIES = {f.__name__: f for f in (week_current_prior, week_delta, coverage_counters, budget_day_week, grouping_sets_usage, list_newest, select_by_title, select_by_number, project_bucket, title_sanitize, burn_rate, quota_eta, bucket_counts)}

_WEEK = f""", lab AS (SELECT *, regexp_extract(cwd, '([^/]*)/*$', 1) AS project, CASE WHEN ended_ms >= {NOW_MS} - 604800000 AND ended_ms < {NOW_MS} THEN 'current' WHEN ended_ms >= {NOW_MS} - 1209600000 AND ended_ms < {NOW_MS} - 604800000 THEN 'prior' END AS window_label FROM sessions WHERE NOT is_sidechain AND parent_id IS NULL AND tokens > 0),
w AS (SELECT * FROM lab WHERE window_label IS NOT NULL),
totals AS (SELECT window_label, CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(project) = 0 THEN 'project' ELSE 'all' END AS level, coalesce(source, project) AS value, count(*) AS n_sessions, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(pico) AS DECIMAL(38,0)) AS pico, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens,
  CAST(sum(CASE WHEN pico IS NOT NULL AND unpriced_tokens = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_full, CAST(sum(CASE WHEN pico IS NOT NULL AND unpriced_tokens > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_partial, CAST(sum(CASE WHEN pico IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unpriced
  FROM w GROUP BY GROUPING SETS ((window_label), (window_label, source), (window_label, project)))"""
_DAY = NOW_MS // 86400000 * 86400000

ORACLE_SQL = {
    "week_current_prior": SQL + _WEEK + "SELECT * FROM totals",
    "week_delta": SQL + _WEEK + "SELECT level, value, CAST(sum(CASE WHEN window_label = 'current' THEN pico END) - sum(CASE WHEN window_label = 'prior' THEN pico END) AS DECIMAL(38,0)) AS delta_pico, CAST(sum(CASE WHEN window_label = 'current' THEN tokens ELSE -tokens END) AS BIGINT) AS delta_tokens FROM totals GROUP BY level, value",
    "coverage_counters": SQL + _WEEK + "SELECT window_label, n_sessions, n_full, n_partial, n_unpriced FROM totals WHERE level = 'all'",
    "budget_day_week": SQL + f", t AS (SELECT * FROM sessions WHERE NOT is_sidechain AND parent_id IS NULL), s AS (SELECT 'daily' AS period, * FROM t WHERE ended_ms >= {_DAY} AND ended_ms < {_DAY} + 86400000 UNION ALL SELECT 'weekly', * FROM t WHERE ended_ms >= {NOW_MS} - 604800000 AND ended_ms < {NOW_MS}), u AS (SELECT period, sum(pico) AS pico, sum(tokens) AS tokens, count(*) FILTER (pico IS NOT NULL AND unpriced_tokens = 0) AS n_full, count(*) FILTER (pico IS NOT NULL AND unpriced_tokens > 0) AS n_partial, count(*) FILTER (pico IS NULL) AS n_excluded FROM s GROUP BY period) SELECT c.period, unit, CAST(cap AS BIGINT) AS cap, CAST(coalesce(CASE WHEN unit = 'usd' THEN pico ELSE tokens END, 0) AS DECIMAL(38,0)) AS used, coalesce(CASE WHEN unit = 'usd' THEN pico ELSE tokens END, 0) > cap AS exceeded, coalesce(n_full, 0) AS n_full, coalesce(n_partial, 0) AS n_partial, coalesce(n_excluded, 0) AS n_excluded FROM (VALUES ('daily', 'usd', 1000000000), ('daily', 'tokens', 1000000000), ('weekly', 'usd', 500000), ('weekly', 'tokens', 100000)) c(period, unit, cap) LEFT JOIN u ON c.period = u.period",
    "grouping_sets_usage": SQL + _WEEK + "SELECT source, project, CAST(grouping(source, project) AS BIGINT) AS level, count(*) AS n_sessions, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(pico) AS DECIMAL(38,0)) AS pico FROM w GROUP BY ROLLUP (source, project)",
    "list_newest": SQL + f"SELECT session_id, started_ms, ended_ms, title FROM sessions WHERE ended_ms >= {NOW_MS} - 604800000 ORDER BY ended_ms DESC, session_id LIMIT 100",
    "select_by_title": SQL + "SELECT session_id, title FROM sessions WHERE contains(lower(title), 'title 11 of') ORDER BY ended_ms DESC, session_id LIMIT 1",
    "select_by_number": SQL + "SELECT session_id, title FROM sessions ORDER BY ended_ms DESC, session_id LIMIT 1 OFFSET 6",
    "project_bucket": SQL + "SELECT regexp_extract(cwd, '([^/]*)/*$', 1) AS project, false AS literal_glob, true AS glob, count(*) AS n_sessions, CAST(sum(tokens) AS BIGINT) AS tokens FROM sessions GROUP BY ALL",
    "title_sanitize": r"WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g') || ' end') AS s, text FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN length(s) > 120 THEN s[1:119] || '…' ELSE s END AS title, regexp_replace(regexp_replace(lower(text[1:40]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t",
    "burn_rate": SQL + ", d AS (SELECT *, (ended_ms - started_ms + 500) // 1000 AS s FROM sessions WHERE pico IS NOT NULL AND unpriced_tokens = 0 AND ended_ms > started_ms) SELECT session_id, round(CAST(pico AS DOUBLE) / ((ended_ms - started_ms) / 3600000), 3) AS pico_per_hour, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE s || 's' END AS took FROM d",
    "quota_eta": SQL + """, r AS (SELECT session_id, call_ord, k, ts_ms - CASE WHEN event_id % 13 = 0 THEN 900000000 ELSE 0 END AS obs, ts_ms // 604800000 * 604800000 + 604800000 AS rs FROM e), l AS (SELECT *, lag(k) OVER w AS k0, lag(obs) OVER w AS t0, lag(rs) OVER w AS r0 FROM r WINDOW w AS (PARTITION BY session_id ORDER BY call_ord)),
c AS (SELECT *, obs + (100 - k) * (obs - t0) / CAST(k - k0 AS DOUBLE) AS x FROM l WHERE r0 = rs AND t0 <= obs AND obs - t0 >= 60000 AND k > k0) SELECT session_id, count(*) AS n, max(k) AS most, CAST(min(floor(x) - obs) AS BIGINT) AS least_eta_ms, CAST(max(floor(x) - obs) AS BIGINT) AS most_eta_ms FROM c WHERE x < rs GROUP BY session_id""",
    "bucket_counts": SQL + "SELECT CASE WHEN ended_ms - started_ms < 3600000 THEN 'hour' WHEN ended_ms - started_ms < 86400000 THEN 'day' WHEN ended_ms - started_ms < 604800000 THEN 'week' ELSE 'more' END AS took, CASE WHEN tokens < 10000 THEN 'small' WHEN tokens < 50000 THEN 'middle' ELSE 'large' END AS size, count(*) AS n_sessions FROM sessions GROUP BY ALL",
}
