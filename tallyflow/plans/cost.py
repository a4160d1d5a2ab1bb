"""Queries of pricing and attribution over the derived requests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import text as X
from tallyflow.functions import usage as U
from tallyflow.operators import attribution as A
from tallyflow.operators import pricing as P
from tallyflow.operators import receipt as R
from tallyflow.plans import derive as D
from tallyflow.plans.derive import SQL


def priced(spark, sf):
    return P.price_units(D.units(spark, sf), D.prices(spark), D.vendor())


def turns(spark, sf):
    return P.price_turns(priced(spark, sf))


def price_units_by_model(spark, sf):
    p = priced(spark, sf)
    return p.groupBy("model").agg(
        F.sum("pico").cast("decimal(38,0)").alias("pico"), F.sum("total").alias("tokens"), F.sum(F.when(F.col("pico").isNull(), F.col("total")).otherwise(0)).alias("unpriced_tokens"), F.count("*").alias("n_units"))


def price_flags(spark, sf):
    p = priced(spark, sf)
    return p.groupBy("vendor", "model").agg(F.sum(F.col("write_floor").cast("long")).alias("n_write_floor"), F.sum(F.col("read_floor").cast("long")).alias("n_read_floor"), F.sum(U.cached_read_saving()).cast("decimal(38,0)").alias("cached_saving"))


def tier_boundary(spark, sf):
    p = priced(spark, sf).where("vendor = 'beta' and pico is not null")
    return p.groupBy((F.col("rates.r_in") > F.col("price.r_in")).alias("upper"), "model").agg(F.count("*").alias("n_units"), F.min(U.prompt_side()).alias("least_prompt"), F.max(U.prompt_side()).alias("most_prompt"), F.sum("pico").cast("decimal(38,0)").alias("pico"))


def price_turns(spark, sf):
    return turns(spark, sf).select("session_id", "turn_index", "pico", "total", "unpriced_tokens", "n_units", "n_priced", "complete", "write_floor", "read_floor")


def envelope_units(spark, sf):
    """Every fifth turn claims one token too many; every seventh has no explicit requests."""
    u = D.units(spark, sf)
    t = u.groupBy("session_id", "turn_index").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_creation", "cc_5m", "cc_1h", "total")], F.min("ts_ms").alias("ts_ms"), F.min("day").alias("day"), F.min("model").alias("model"))
    t = t.withColumn("total", F.col("total") + (F.col("turn_index") % 5 == 4).cast("long")).withColumn("units_state", F.when(F.col("turn_index") % 7 == 6, "implicit").otherwise("explicit"))
    t = t.withColumns({"provider_state": F.lit("absent"), "provider": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    kept = P.envelope_units(t, u.join(t.where("units_state = 'explicit'").select("session_id", "turn_index"), ["session_id", "turn_index"], "left_semi"))
    return kept.groupBy("session_id").agg(F.count("*").alias("n_units"), F.sum("total").alias("tokens"), F.countDistinct("turn_index").alias("n_turns"))


def tool_attribution(spark, sf):
    t = A.by_tool(turns(spark, sf), D.calls(spark, sf))
    return t.groupBy("tool").agg(F.sum("n_calls").alias("n_calls"), F.round(F.sum("pico").cast("double") / 1e12, 7).alias("usd"), F.round(F.sum("tokens").cast("double"), 1).alias("tokens"), F.count("pico").alias("n_priced"))


def tool_rows(spark, sf):
    """The tools' rows in the order in which a receipt lists them."""
    return A.tool_order(tool_attribution(spark, sf), [], "usd").select("rank", "tool", "usd", "tokens")


def vendor_rows(spark, sf):
    """All vendors that there are adapters for, those without a request too."""
    known = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "vendor string")
    return A.rows_of_all(known, D.units(spark, sf).withColumn("vendor", D.vendor()), "vendor")


def session_totals(spark, sf):
    return A.session_totals(turns(spark, sf)).withColumn("coverage", A.coverage()).select("session_id", "pico", "tokens", "unpriced_tokens", "n_turns", "n_unpriced_turns", "write_floor", "read_floor", "coverage")


def cost_by_session_model(spark, sf):
    return A.by_model(priced(spark, sf))


def model_mix(spark, sf):
    return A.model_mix(D.units(spark, sf).withColumn("session_id", F.concat(F.lit("g"), (F.col("session_id").cast("int") % 7).cast("string")))).select("session_id", "model", "tokens", "share", F.col("rank").cast("long").alias("rank"))


def peak_turn(spark, sf):
    return A.peak_turn(turns(spark, sf))


def price_rows_used(spark, sf):
    return A.prices_used(priced(spark, sf)).groupBy("vendor", "model", "from_date").agg(F.count("*").alias("n_session_days"))


def cheapest_row(spark, sf):
    """The cheapest open row per vendor, and the requests of that vendor."""
    c = P.cheapest_current(D.prices(spark)).select("vendor", F.col("cheapest.model").alias("cheapest_model"), F.col("cheapest.r_in").alias("r_in"))
    return D.units(spark, sf).withColumn("vendor", D.vendor()).join(F.broadcast(c), "vendor").groupBy("vendor", "cheapest_model", "r_in").agg(F.count("*").alias("n_units"))


def price_delta(spark, sf):
    p = priced(spark, sf).withColumn("session_id", F.concat_ws(":", "session_id", "turn_index"))
    return P.price_delta(p, D.prices(spark))


def book_faults(spark, sf):
    """A book with faults planted in it, by the number of requests that fall on a faulty model."""
    import datetime

    book, day = D.prices(spark), datetime.date
    more = spark.createDataFrame([("beta", "beta-mini", day(2024, 1, 20), None, 1, 1, None, None, None, None, [], 9), ("alpha", "alpha-large", day(2024, 3, 1), day(2024, 2, 1), 1, 1, None, None, None, None, [], 10)], book.schema)
    bad = P.book_faults(book.unionAll(more))
    return D.units(spark, sf).groupBy("model").agg(F.count("*").alias("n_units")).join(F.broadcast(bad), "model").select("vendor", "model", "from_date", "fault", "n_units")


def usd_floor(spark, sf):
    return turns(spark, sf).where("pico is not null").select("session_id", "turn_index", X.usd_floor(F.col("pico")).alias("usd"))


def usd_ledger(spark, sf):
    """A ledger a session, a row a model and day; every third session states a total below what its rows come to."""
    p = priced(spark, sf).where("pico is not null").groupBy("session_id", "model", "day").agg(F.sum("pico").cast("decimal(38,0)").alias("pico"))
    every = F.sum("pico").over(W.partitionBy("session_id"))
    stated = F.when(F.col("session_id").cast("int") % 3 == 0, every - 2_000_000_000).otherwise(every).cast("decimal(38,0)")
    rows = A.ledger(p.withColumn("stated", stated), ["session_id"], ["model", "day"], total="stated")
    return rows.select("session_id", "model", "day", "decimals", "amount", "total_amount")


def receipts(spark, sf):
    """A receipt a session; every fifth session is a child of the one before, some of them unreadable, and has none."""
    p = priced(spark, sf).withColumn("u", F.col("session_id").cast("long"))
    s = p.groupBy("session_id", "u").agg(F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"))
    s = s.withColumns({"source": F.concat(F.lit("src"), (F.col("u") % 3).cast("string")), "title": F.when(F.col("u") % 4 > 0, F.concat(F.lit('Title, "'), F.col("u").cast("string"), F.lit('"')))})
    gap = F.col("pico").isNull()
    vector = lambda make: F.struct(*[make(c).alias(c) for c in R.PARTS])
    kids = p.where("u % 5 = 1").groupBy("u").agg(F.sum("pico").cast("decimal(38,0)").alias("pico"), vector(lambda c: F.sum(c)).alias("tokens"), vector(lambda c: F.sum(F.when(gap, F.col(c)).otherwise(0))).alias("unpriced"))
    kids = kids.select((F.col("u") - 1).cast("string").alias("parent_id"), (F.col("u") % 35 == 1).alias("unreadable"), "pico", "tokens", "unpriced")
    return R.receipts(s.where("u % 5 <> 1").drop("u"), p.drop("u"), D.calls(spark, sf), kids)


def receipt_sessions(spark, sf):
    usd = ["totalUsd", "subagentsPricedUsd", "combinedPricedUsd"]
    return R.session_table(receipts(spark, sf)).withColumns({c: F.round(c, 9) for c in usd})


def receipt_tools(spark, sf):
    return R.tool_table(receipts(spark, sf)).withColumns({c: F.round(c, 4) for c in ("usd", "inputTokens", "outputTokens", "cacheReadTokens", "cacheCreationTokens", "totalTokens")})


def compare_receipts(spark, sf):
    r = receipts(spark, sf)
    pairs = r.select(F.col("session_id").alias("a_id"), (F.col("session_id").cast("long") + 1).cast("string").alias("b_id"))
    return R.compared(r, pairs).withColumn("usd_delta", F.round("usd_delta", 7))


def token_formats(spark, sf):
    t = turns(spark, sf)
    names = ["<1k", "1k-5k", "5k-20k", "20k+"]
    return t.select("session_id", "turn_index", X.short_tokens(F.col("total")).alias("short"), X.bucket(F.col("total"), [1000, 5000, 20000], names).alias("bucket"), X.share(F.col("cache_read"), F.col("total")).alias("cached"))


QUERIES = {f.__name__: f for f in (price_units_by_model, price_flags, tier_boundary, price_turns, envelope_units, tool_attribution, tool_rows, vendor_rows, session_totals, cost_by_session_model, model_mix, peak_turn, price_rows_used, cheapest_row, price_delta, book_faults, usd_floor, usd_ledger, receipt_sessions, receipt_tools, compare_receipts, token_formats)}

TOOLS = ", n AS (SELECT session_id, turn_index, count(*) AS n FROM calls GROUP BY ALL), s AS (SELECT t.session_id, coalesce(name, '(thinking/reply)') AS tool, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS k, CAST(pico AS DOUBLE) / coalesce(n, 1) AS pico, CAST(total AS DOUBLE) / coalesce(n, 1) AS tokens FROM turns t LEFT JOIN n USING (session_id, turn_index) LEFT JOIN calls c USING (session_id, turn_index)), p AS (SELECT session_id, tool, sum(k) AS k, sum(pico) AS pico, sum(tokens) AS tokens FROM s GROUP BY ALL), r AS (SELECT tool, CAST(sum(k) AS BIGINT) AS n_calls, round(sum(pico) / 1e12, 7) AS usd, round(sum(tokens), 1) AS tokens, count(pico) AS n_priced FROM p GROUP BY tool)"

def _places(v: str) -> str:
    """SQL: decimals by the amount's digits: whole cents two, from a hundredth of a cent four, else to the first digit."""
    return f"(CASE WHEN {v} <= 0 OR {v} % 10000000000 = 0 THEN 2 WHEN length(CAST({v} AS VARCHAR)) >= 9 THEN 4 ELSE 13 - length(CAST({v} AS VARCHAR)) END)"


def _units(u: str, d: str) -> str:
    return f"(format('{{:,}}', CAST({u} // CAST(pow(10, {d}) AS HUGEINT) AS BIGINT)) || '.' || lpad(CAST({u} % CAST(pow(10, {d}) AS HUGEINT) AS VARCHAR), CAST({d} AS INT), '0'))"


def _shown(v: str, d: str) -> str:
    return _units(f"(greatest({v}, 0) // CAST(pow(10, 12 - {d}) AS HUGEINT))", d)


_PARTS = ("input", "output", "cache_read", "cache_creation", "total")
_HEADS = ("InputTokens", "OutputTokens", "CacheReadTokens", "CacheCreationTokens", "TotalTokens")
_sums = lambda c, p: ", ".join(f"CAST(coalesce(sum({c.format(x)}), 0) AS BIGINT) AS {p}{x}" for x in _PARTS)
_RECEIPTS = f"""{SQL}, pu AS MATERIALIZED (SELECT *, CAST(session_id AS BIGINT) AS u FROM priced),
own AS MATERIALIZED (SELECT u, min(ts_ms) AS s, max(ts_ms) AS e, sum(pico) AS pico, bool_or(write_floor OR read_floor) AS fl, {_sums("{}", "t_")}, {_sums("CASE WHEN pico IS NULL THEN {} END", "g_")} FROM pu GROUP BY u),
kids AS (SELECT u - 1 AS u, u % 35 = 1 AS bad, * EXCLUDE (u) FROM own WHERE u % 5 = 1),
k AS (SELECT u, count(*) AS n, sum(CASE WHEN NOT bad THEN pico END) AS kp, CAST(coalesce(sum(CASE WHEN NOT bad THEN t_total END), 0) AS BIGINT) AS kt, {", ".join(f"CAST(coalesce(sum(CASE WHEN bad THEN 0 WHEN pico IS NULL THEN t_{x} ELSE g_{x} END), 0) AS BIGINT) AS c_{x}" for x in _PARTS)}, count(*) FILTER (NOT bad AND (pico IS NULL OR g_total > 0)) AS nu, count(*) FILTER (bad) AS nb FROM kids GROUP BY u),
first AS (SELECT u, model FROM (SELECT u, model, sum(total) AS n FROM pu GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, model) = 1),
r AS MATERIALIZED (SELECT o.*, k.* EXCLUDE (u), model, CASE WHEN pico IS NULL THEN 'unpriced' WHEN g_total > 0 OR fl THEN 'partial' ELSE 'full' END AS cov, CASE WHEN pico IS NOT NULL OR kp IS NOT NULL THEN coalesce(pico, 0) + coalesce(kp, 0) END AS summed FROM own o LEFT JOIN k ON k.u = o.u JOIN first f ON f.u = o.u WHERE o.u % 5 <> 1)
"""
_kind = lambda c, p: f"CASE WHEN {c} IS NOT NULL THEN '{R.KIND}' END AS {p}Kind, CASE WHEN {c} IS NOT NULL THEN '{R.BASIS}' END AS {p}Basis"
_cells = lambda expr, p: ", ".join(f"{expr.format(x)} AS {p + h if p else h[0].lower() + h[1:]}" for x, h in zip(_PARTS, _HEADS))

ORACLE_SQL = {
    "price_units_by_model": SQL + "SELECT model, CAST(sum(pico) AS DECIMAL(38,0)) AS pico, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(CASE WHEN pico IS NULL THEN total ELSE 0 END) AS BIGINT) AS unpriced_tokens, count(*) AS n_units FROM priced GROUP BY model",
    "price_flags": SQL + "SELECT vendor, model, CAST(sum(CAST(write_floor AS INT)) AS BIGINT) AS n_write_floor, CAST(sum(CAST(read_floor AS INT)) AS BIGINT) AS n_read_floor, CAST(sum(CASE WHEN c_r_in >= c_r_cached THEN cache_read * (c_r_in - c_r_cached) END) AS DECIMAL(38,0)) AS cached_saving FROM priced GROUP BY ALL",
    "tier_boundary": SQL + "SELECT c_r_in > row_in AS upper, model, count(*) AS n_units, min(input + cache_read + cache_creation) AS least_prompt, max(input + cache_read + cache_creation) AS most_prompt, CAST(sum(pico) AS DECIMAL(38,0)) AS pico FROM priced WHERE vendor = 'beta' AND pico IS NOT NULL GROUP BY ALL",
    "price_turns": SQL + "SELECT session_id, turn_index, CAST(pico AS DECIMAL(38,0)) AS pico, CAST(total AS BIGINT) AS total, CAST(unpriced_tokens AS BIGINT) AS unpriced_tokens, n_units, n_priced, complete, write_floor, read_floor FROM turns",
    "envelope_units": SQL + ", w AS (SELECT session_id, turn_index, count(*) AS n, sum(total) AS total FROM units GROUP BY ALL) SELECT session_id, CAST(sum(CASE WHEN turn_index % 7 = 6 THEN 1 ELSE n END) AS BIGINT) AS n_units, CAST(sum(total + CASE WHEN turn_index % 5 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS tokens, count(*) AS n_turns FROM w WHERE turn_index % 7 = 6 OR turn_index % 5 <> 4 GROUP BY session_id",
    "tool_attribution": SQL + TOOLS + " SELECT tool, n_calls, usd, tokens, n_priced FROM r",
    "tool_rows": SQL + TOOLS + " SELECT row_number() OVER (ORDER BY usd IS NULL, usd DESC, CASE WHEN usd IS NULL THEN tokens END DESC, tool) AS rank, tool, usd, tokens FROM r",
    "vendor_rows": SQL + ", s AS (SELECT vendor, count(DISTINCT session_id) AS n_sessions, count(*) AS n_units, sum(total) AS tokens FROM units GROUP BY vendor) SELECT v AS vendor, CAST(coalesce(n_sessions, 0) AS BIGINT) AS n_sessions, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM (VALUES ('alpha'), ('beta'), ('gamma')) x(v) LEFT JOIN s ON v = vendor",
    "session_totals": SQL + "SELECT session_id, CAST(sum(pico) AS DECIMAL(38,0)) AS pico, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens, count(*) AS n_turns, CAST(count(*) - sum(CAST(complete AS INT)) AS BIGINT) AS n_unpriced_turns, bool_or(write_floor) AS write_floor, bool_or(read_floor) AS read_floor, CASE WHEN sum(pico) IS NULL THEN 'unpriced' WHEN sum(unpriced_tokens) > 0 THEN 'partial' ELSE 'full' END AS coverage FROM turns GROUP BY session_id",
    "cost_by_session_model": SQL + "SELECT session_id, model, CAST(sum(pico) AS DECIMAL(38,0)) AS pico, CAST(sum(total) AS BIGINT) AS tokens FROM priced WHERE pico IS NOT NULL GROUP BY ALL",
    "model_mix": SQL + ", g AS (SELECT 'g' || (CAST(session_id AS INT) % 7) AS session_id, model, sum(total) AS tokens FROM units GROUP BY ALL) SELECT session_id, model, CAST(tokens AS BIGINT) AS tokens, round(tokens / sum(tokens) OVER (PARTITION BY session_id), 6) AS share, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, model) AS rank FROM g",
    "peak_turn": SQL + "SELECT session_id, turn_index, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total DESC, turn_index) AS rn FROM turns) WHERE rn = 1",
    "price_rows_used": SQL + "SELECT vendor, model, CAST(from_date AS DATE) AS from_date, count(*) AS n_session_days FROM (SELECT DISTINCT session_id, vendor, model, from_date, day FROM priced WHERE pico IS NOT NULL) GROUP BY ALL",
    "cheapest_row": SQL + "SELECT vendor, b_model AS cheapest_model, CAST(r_in AS BIGINT) AS r_in, count(*) AS n_units FROM units JOIN cheapest ON vendor = b_vendor GROUP BY ALL",
    "price_delta": SQL + "SELECT session_id || ':' || turn_index AS session_id, min(vendor) AS vendor, CAST(sum(pico) AS DECIMAL(38,0)) AS pico, CAST(sum(least) AS DECIMAL(38,0)) AS cheapest_pico, CAST(sum(pico) - sum(least) AS DECIMAL(38,0)) AS delta_pico FROM repriced GROUP BY repriced.session_id, turn_index HAVING count(DISTINCT vendor) = 1 AND bool_and(pico IS NOT NULL AND NOT write_floor AND NOT read_floor)",
    "book_faults": SQL + "SELECT v AS vendor, m AS model, CAST(d AS DATE) AS from_date, f AS fault, count(*) AS n_units FROM units JOIN (VALUES ('beta', 'beta-mini', '2024-01-03', 'overlaps the next row'), ('beta', 'beta-mini', '2024-01-20', 'more than one open row'), ('alpha', 'alpha-large', '2024-01-15', 'overlaps the next row'), ('alpha', 'alpha-large', '2024-03-01', 'ends before it begins')) x(v, m, d, f) ON model = m GROUP BY ALL",
    "usd_floor": SQL + f"SELECT session_id, turn_index, {_shown('pico', _places('pico'))} AS usd FROM turns WHERE pico IS NOT NULL",
    "usd_ledger": SQL + ", g AS (SELECT session_id, model, day, sum(pico) AS pico FROM priced WHERE pico IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(pico) OVER (PARTITION BY session_id) - CASE WHEN CAST(session_id AS INT) % 3 = 0 THEN 2000000000 ELSE 0 END AS stated FROM g), "
    + f"d AS (SELECT *, max(greatest({_places('pico')}, {_places('stated')})) OVER (PARTITION BY session_id) AS d FROM t), u AS (SELECT *, greatest(pico, 0) // CAST(pow(10, 12 - d) AS HUGEINT) AS u, greatest(stated, 0) // CAST(pow(10, 12 - d) AS HUGEINT) AS most FROM d), "
    + "x AS (SELECT *, sum(u) OVER (PARTITION BY session_id ORDER BY u DESC, model, day ROWS UNBOUNDED PRECEDING) - u AS before, greatest(0, sum(u) OVER (PARTITION BY session_id) - most) AS excess FROM u), y AS (SELECT *, u - greatest(0, least(u, excess - before)) AS v FROM x), z AS (SELECT *, sum(v) OVER (PARTITION BY session_id) AS s FROM y) "
    + f"SELECT session_id, model, day, CAST(d AS INTEGER) AS decimals, {_units('v', 'd')} AS amount, {_units('s', 'd')} AS total_amount FROM z",
    "token_formats": SQL + ", i AS (SELECT session_id, turn_index, CAST(total AS BIGINT) AS total, CAST(cache_read AS BIGINT) AS cache_read, CAST(floor(100 * CAST(cache_read AS DOUBLE) / total + 0.5) AS BIGINT) AS p FROM turns) SELECT session_id, turn_index, CASE WHEN total < 1000 THEN CAST(total AS VARCHAR) WHEN total < 9950 THEN regexp_replace(((total + 50) // 100 // 10) || '.' || ((total + 50) // 100 % 10), '[.]0$', '') || 'k' WHEN total < 999500 THEN ((total + 500) // 1000) || 'k' WHEN total < 9950000 THEN regexp_replace(((total + 50000) // 100000 // 10) || '.' || ((total + 50000) // 100000 % 10), '[.]0$', '') || 'M' ELSE ((total + 500000) // 1000000) || 'M' END AS short, CASE WHEN total < 1000 THEN '<1k' WHEN total < 5000 THEN '1k-5k' WHEN total < 20000 THEN '5k-20k' ELSE '20k+' END AS bucket, CASE WHEN p <= 0 AND cache_read > 0 THEN '<1%' WHEN p >= 100 AND cache_read < total THEN '>99%' ELSE p || '%' END AS cached FROM i",
    "receipt_sessions": _RECEIPTS + f"""SELECT {R.VERSION} AS schemaVersion, CAST(u AS VARCHAR) AS sessionId, 'src' || (u % 3) AS agent, CASE WHEN u % 4 > 0 THEN 'Title, "' || u || '"' ELSE '' END AS title, strftime(epoch_ms(s), '%Y-%m-%dT%H:%M:%S.%gZ') AS startedAt, e - s AS durationMs, model AS primaryModel, round(CAST(pico AS DOUBLE) / 1e12, 9) AS totalUsd,
{_cells("t_{}", "")}, {_kind("pico", "cost")}, '{R.PARENT}' AS totalUsdScope, round(CAST(kp AS DOUBLE) / 1e12, 9) AS subagentsPricedUsd, round(CAST(summed AS DOUBLE) / 1e12, 9) AS combinedPricedUsd, {_kind("summed", "combinedCost")}, coalesce(kt, 0) AS subagentsTokens, t_total + coalesce(kt, 0) AS combinedTotalTokens,
coalesce(n, 0) AS subagentCount, coalesce(nu, 0) AS subagentUnpricedCount, coalesce(nb, 0) AS subagentUnreadableCount, cov AS pricingCoverage, {_cells("g_{}", "unpriced")}, '{R.PARENT}' AS unpricedTokensScope, {_kind("kp", "subagentsCost")}, '{R.CHILDREN}' AS subagentsUsdScope, {_cells("coalesce(c_{}, 0)", "subagentsUnpriced")},
'{R.CHILDREN}' AS subagentsUnpricedTokensScope, {", ".join(f"g_{x} + coalesce(c_{x}, 0) AS combinedUnpriced{h}" for x, h in zip(_PARTS, _HEADS))}, '{R.BOTH}' AS combinedUnpricedTokensScope, CASE WHEN summed IS NULL THEN 'unpriced' WHEN cov <> 'full' OR coalesce(c_total, 0) > 0 OR coalesce(nu, 0) > 0 OR coalesce(nb, 0) > 0 THEN 'partial' ELSE 'full' END AS combinedPricingCoverage FROM r""",
    "receipt_tools": _RECEIPTS + f""", n AS (SELECT session_id, turn_index, count(*) AS n FROM calls GROUP BY ALL), s AS (SELECT CAST(t.session_id AS BIGINT) AS u, coalesce(name, '(thinking/reply)') AS tool, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS c, CAST(pico AS DOUBLE) / coalesce(n, 1) AS pico, {", ".join(f"CAST({x} AS DOUBLE) / coalesce(n, 1) AS {x}" for x in _PARTS)} FROM turns t LEFT JOIN n USING (session_id, turn_index) LEFT JOIN calls c USING (session_id, turn_index)),
p AS (SELECT u, tool, sum(c) AS c, sum(pico) AS pico, {", ".join(f"sum({x}) AS {x}" for x in _PARTS)} FROM s GROUP BY ALL)
SELECT {R.VERSION} AS schemaVersion, CAST(r.u AS VARCHAR) AS sessionId, 'src' || (r.u % 3) AS agent, tool, round(p.pico / 1e12, 4) AS usd, {_cells("round(p.{}, 4)", "")}, CAST(c AS BIGINT) AS callCount, {_kind("p.pico", "cost")}, '{R.TOOL}' AS costScope, CASE WHEN p.pico IS NULL THEN 'unpriced' WHEN cov = 'full' THEN 'full' ELSE 'indeterminate' END AS pricingCoverage,
CASE WHEN p.pico IS NOT NULL AND cov <> 'full' THEN '{R.LIMITATION}' ELSE '' END AS pricingCoverageLimitation FROM r JOIN p ON p.u = r.u""",
    "compare_receipts": _RECEIPTS + "SELECT CAST(a.u AS VARCHAR) AS a_id, CAST(b.u AS VARCHAR) AS b_id, b.t_total - a.t_total AS tokens_delta, round(CAST(b.pico AS DOUBLE) / 1e12 - CAST(a.pico AS DOUBLE) / 1e12, 7) AS usd_delta FROM r a JOIN r b ON b.u = a.u + 1",
}
