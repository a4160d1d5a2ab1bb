"""The normalised tables as derived from the driver's ``events`` and ``conversations``.

There are no transcripts in that data, so token counts, models and compactions are synthetic: every event is a model request of
the session ``user_id``, three in a row make a turn, and all but sign-ups are tool calls. The same relations in DuckDB SQL are in
``SQL``, for the oracles; both are written apart from the operators that are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.schema import PRICES

#: now for the weekly windows: 2024-01-29T00:00:00Z.
NOW_MS = 1706486400000
PREFIXES = {"alpha-": "alpha", "beta-": "beta"}
#: (vendor, model, from, to, in, out, cached, write, write_5m, write_1h, tiers, file_ord); rates in pico-dollars a token.
BOOK = [
    ("alpha", "alpha-large", "2023-12-01", "2024-01-14", 3_000_000, 15_000_000, 300_000, None, 3_750_000, 6_000_000, [], 0),
    ("alpha", "alpha-large", "2024-01-15", None, 2_000_000, 10_000_000, 200_000, None, 2_500_000, 4_000_000, [], 1),
    ("alpha", "alpha-small", "2023-12-01", None, 250_000, 1_250_000, 25_000, 312_500, None, None, [], 2),
    ("beta", "beta-mini", "2024-01-03", None, 1_750_000, 14_000_000, None, None, None, None, [(6000, 3_500_000, 21_000_000, 350_000, 4_375_000, None, None)], 3),
    ("beta", "beta-nano", "2023-12-01", None, 50_000, 400_000, 5_000, None, None, None, [], 4),
]


def prices(spark: SparkSession) -> DataFrame:
    import datetime

    day = lambda s: None if s is None else datetime.date.fromisoformat(s)
    return spark.createDataFrame([(v, m, day(a), day(b), *rest) for v, m, a, b, *rest in BOOK], PRICES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    rows = e.select(
        "event_id", F.col("user_id").alias("uid"), F.col("user_id").cast("string").alias("session_id"), "event_type", "props", k.alias("k"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts_ms"),
        F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("input"), (F.row_number().over(order) - 1).cast("long").alias("call_ord"),
    )
    return rows.withColumn("turn_index", F.floor(F.col("call_ord") / 3).cast("long"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    model = F.when(F.col("uid") % 4 == 3, "gamma-x").when(F.col("uid") % 4 == 2, "alpha-small").when(F.col("uid") % 4 == 1, "beta-mini").otherwise("alpha-large")
    state = F.when(F.col("event_id") % 97 == 0, "blocked").when(F.col("event_id") % 89 == 0, "direct").otherwise("absent")
    out = e.select(
        "session_id", "turn_index", (F.col("call_ord") % 3).alias("unit_ord"), "input", (F.col("k") * 7).alias("output"), (F.col("event_id") % 7 * 500).alias("cache_read"), (F.col("event_id") % 5 * 200).alias("cache_creation"),
        F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5 * 100).alias("cc_5m"), F.when(F.col("event_id") % 3 == 2, F.col("event_id") % 5 * 50).alias("cc_1h"), "ts_ms", "day", model.alias("model"), state.alias("provider_state"),
        F.when(state == "direct", F.lit("beta")).alias("provider"), F.lit(None).cast("string").alias("source"),
    )
    return out.withColumn("total", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation"))


def vendor():
    from tallyflow.functions import usage

    return usage.vendor(PREFIXES, {"none": "none"})


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type <> 'signup'")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return e.select("session_id", "turn_index", "call_ord", F.col("event_type").alias("name"), (F.col("event_type") == "click").alias("is_shell"), F.when(F.col("k") < 60, F.lit("same")).otherwise(F.col("props")).alias("input_json"), status.alias("status"), F.concat(F.lit("/p"), (F.col("k") % 10).cast("string")).alias("path"), F.col("ts_ms").alias("started_ms"), (F.col("ts_ms") + F.col("k")).alias("ended_ms"))


def compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_id % 17 = 0").select("session_id", "turn_index").distinct()


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events, eight in a row to a session: enough sessions for windows, parents and ranking."""
    e = events(spark, sf_dir).withColumn("part", F.floor(F.col("call_ord") / 8).cast("long"))
    s = e.groupBy("uid", "part").agg(F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.sum(F.col("input") + F.col("k") * 7).alias("tokens"), F.sum(F.when(F.col("event_id") % 9 > 0, F.col("input") * 3)).cast("decimal(38,0)").alias("pico"), F.sum(F.when(F.col("event_id") % 9 == 0, F.col("input")).otherwise(0)).alias("unpriced_tokens"))
    sid = F.concat(F.col("uid").cast("string"), F.lit("-"), F.col("part").cast("string"))
    pico = F.when(F.col("uid") % 10 != 7, F.col("pico")).cast("decimal(38,0)")
    return s.select(sid.alias("session_id"), "started_ms", "ended_ms", "tokens", pico.alias("pico"), F.when(F.col("uid") % 2 == 0, 0).otherwise(F.col("unpriced_tokens")).cast("long").alias("unpriced_tokens"), F.concat(F.lit("src"), (F.col("uid") % 3).cast("string")).alias("source"),
                    F.concat(F.lit("/home/u/proj"), (F.col("uid") % 6).cast("string"), F.lit("/")).alias("cwd"), (F.col("part") % 5 == 4).alias("is_sidechain"), F.when(F.col("part") % 5 == 4, F.concat(F.col("uid").cast("string"), F.lit("-"), (F.col("part") - 1).cast("string"))).alias("parent_id"), F.concat(F.lit("Title "), F.col("uid").cast("string"), F.lit(" of "), F.col("part").cast("string")).alias("title"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for every purchase: its SHA is the md5 of the id."""
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select(F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"), F.col("ts_ms").alias("commit_ms"), "session_id", "turn_index", "ts_ms", F.concat(F.lit("change number "), (F.col("event_id") % 50).cast("string")).alias("subject"), (F.col("uid") % 2 == 0).alias("own"))


_n = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_RATES = ("r_in", "r_out", "r_cached", "r_write", "r_write_5m", "r_write_1h")
_BOOK_ROWS = ", ".join("(" + ", ".join(map(_n, (*b[:10], b[11], *(b[10][0] if b[10] else (None,) * 7)))) + ")" for b in BOOK)


def _cost(output: str = "output", rates: str = "c_") -> str:
    short, long = f"coalesce({rates}r_write_5m, {rates}r_write, 0)", f"coalesce({rates}r_write_1h, {rates}r_write, 0)"
    return (f"CAST(CAST(input AS HUGEINT) * {rates}r_in + CAST({output} AS HUGEINT) * {rates}r_out + CAST(cache_read AS HUGEINT) * coalesce({rates}r_cached, 0)"
            f" + CAST(cache_creation - coalesce(cc_1h, 0) AS HUGEINT) * {short} + CAST(coalesce(cc_1h, 0) AS HUGEINT) * {long} AS HUGEINT)")  # fmt: skip


SQL = f"""
WITH ev AS (
  SELECT event_id, user_id AS uid, CAST(user_id AS VARCHAR) AS session_id, event_type, props, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, epoch_us(ts) // 1000 AS ts_ms, CAST(ts AS DATE) AS day,
    CAST(round(value * 100) AS BIGINT) AS input, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS call_ord FROM events),
e AS (SELECT *, call_ord // 3 AS turn_index FROM ev),
units AS (
  SELECT session_id, turn_index, call_ord % 3 AS unit_ord, input, k * 7 AS output, event_id % 7 * 500 AS cache_read, event_id % 5 * 200 AS cache_creation,
    CASE WHEN event_id % 3 > 0 THEN event_id % 5 * 100 END AS cc_5m, CASE WHEN event_id % 3 = 2 THEN event_id % 5 * 50 END AS cc_1h, ts_ms, day,
    CASE uid % 4 WHEN 3 THEN 'gamma-x' WHEN 2 THEN 'alpha-small' WHEN 1 THEN 'beta-mini' ELSE 'alpha-large' END AS model,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'beta' WHEN uid % 4 IN (0, 2) THEN 'alpha' WHEN uid % 4 = 1 THEN 'beta' END AS vendor,
    input + k * 7 + event_id % 7 * 500 + event_id % 5 * 200 AS total FROM e),
book(b_vendor, b_model, from_date, to_date, {", ".join(_RATES)}, file_ord, t_above, {", ".join("t_" + r for r in _RATES)}) AS (VALUES {_BOOK_ROWS}),
tiered AS (
  SELECT u.*, b.r_in AS row_in, from_date, {", ".join(f"CASE WHEN t_above < input + cache_read + cache_creation THEN t_{r} ELSE b.{r} END AS c_{r}" for r in _RATES)}
  FROM units u LEFT JOIN book b ON vendor = b_vendor AND model = b_model AND day >= CAST(from_date AS DATE) AND (to_date IS NULL OR day <= CAST(to_date AS DATE))),
priced AS (SELECT *, CASE WHEN c_r_in IS NOT NULL THEN {_cost()} END AS pico, CASE WHEN c_r_in IS NOT NULL THEN {_cost("0")} END AS prompt_pico,
  coalesce(c_r_in IS NOT NULL AND ((cache_creation - coalesce(cc_1h, 0) > 0 AND coalesce(c_r_write_5m, c_r_write) IS NULL) OR (coalesce(cc_1h, 0) > 0 AND coalesce(c_r_write_1h, c_r_write) IS NULL)), false) AS write_floor,
  coalesce(c_r_in IS NOT NULL AND cache_read > 0 AND c_r_cached IS NULL, false) AS read_floor FROM tiered),
turns AS (SELECT session_id, turn_index, sum(input) AS input, sum(output) AS output, sum(cache_read) AS cache_read, sum(cache_creation) AS cache_creation, sum(total) AS total, sum(pico) AS pico,
  sum(CASE WHEN pico IS NULL THEN total ELSE 0 END) AS unpriced_tokens, count(*) AS n_units, count(pico) AS n_priced, count(*) = count(pico) AS complete, bool_or(write_floor) AS write_floor, bool_or(read_floor) AS read_floor FROM priced GROUP BY ALL),
calls AS (SELECT session_id, turn_index, call_ord, event_type AS name, CASE WHEN k < 60 THEN 'same' ELSE props END AS input_json, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, '/p' || CAST(k % 10 AS VARCHAR) AS path, ts_ms AS started_ms, ts_ms + k AS ended_ms
  FROM e WHERE event_type <> 'signup'),
compactions AS (SELECT DISTINCT session_id, turn_index FROM e WHERE event_id % 17 = 0),
parts AS (SELECT uid, call_ord // 8 AS part, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, sum(input + k * 7) AS tokens, sum(CASE WHEN event_id % 9 > 0 THEN input * 3 END) AS pico, sum(CASE WHEN event_id % 9 = 0 THEN input ELSE 0 END) AS unpriced_tokens FROM e GROUP BY ALL),
sessions AS (SELECT uid || '-' || part AS session_id, started_ms, ended_ms, tokens, CASE WHEN uid % 10 <> 7 THEN pico END AS pico, CASE WHEN uid % 2 = 0 THEN 0 ELSE unpriced_tokens END AS unpriced_tokens, 'src' || (uid % 3) AS source,
  '/home/u/proj' || (uid % 6) || '/' AS cwd, part % 5 = 4 AS is_sidechain, CASE WHEN part % 5 = 4 THEN uid || '-' || (part - 1) END AS parent_id, 'Title ' || uid || ' of ' || part AS title FROM parts),
commits AS (SELECT md5(CAST(event_id AS VARCHAR)) AS sha, ts_ms AS commit_ms, session_id, turn_index, ts_ms, 'change number ' || (event_id % 50) AS subject, uid % 2 = 0 AS own FROM e WHERE event_type = 'purchase'),
cheapest AS (SELECT b_vendor, b_model, from_date, {", ".join(_RATES)}, t_above, {", ".join("t_" + r for r in _RATES)} FROM (SELECT *, row_number() OVER (PARTITION BY b_vendor ORDER BY r_in, file_ord) AS rn FROM book WHERE to_date IS NULL) WHERE rn = 1),
repriced AS (SELECT *, {_cost(rates="d_")} AS least FROM (SELECT p.*, c.r_in AS cheap_in, {", ".join(f"CASE WHEN t_above < input + cache_read + cache_creation THEN t_{r} ELSE c.{r} END AS d_{r}" for r in _RATES)} FROM priced p LEFT JOIN cheapest c ON vendor = b_vendor))
"""
