"""Receipts: all that is known of a session as one nested row, and the tables and texts that are made of it.

The nested row is the export's schema, version ``VERSION``; the flat tables of sessions and of tools are projections of it, so
all exports of a session agree. Dollars leave exact pico-dollars only here, as doubles; an unpriced amount is null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.operators.attribution import NO_TOOL, model_mix, tool_order
from tallyflow.schema import PICO

VERSION = 2
PARTS = ("input", "output", "cache_read", "cache_creation", "total")
#: Fixed values of the exports: what an amount covers, and what kind of claim it is.
PARENT, CHILDREN, BOTH, TOOL = "parent-session", "readable-subagents", "parent-session-plus-readable-subagents", "parent-session-tool"
KIND, BASIS = "lower-bound", "standard-api-list-price-equivalent"
LIMITATION = "session pricing is partial; unpriced tokens are not separable at tool-row granularity"


def _vector(make) -> Column:
    return F.struct(*[make(p).alias(p) for p in PARTS])


def _zero(c) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def tool_lines(priced: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_id, tool_rows): a session's tools in their order, each with calls, money and the parts of its tokens.

    A turn's tokens and money are split evenly over its calls; a turn without calls is a tool of its own. Money is null unless a
    contributing request has a price. ``priced`` comes from ``price_units``.
    """
    turn = ["session_id", "turn_index"]
    per_turn = priced.groupBy(*turn).agg(F.sum("pico").cast(PICO).alias("pico"), *[F.sum(p).alias(p) for p in PARTS])
    named = calls.groupBy(*turn, "name").agg(F.count("*").alias("k"))
    n = calls.groupBy(*turn).agg(F.count("*").alias("n"))
    split = per_turn.join(n, turn, "left").join(named, turn, "left")
    part = lambda c: (F.col(c).cast("decimal(24,0)") * F.coalesce("k", F.lit(1)).cast("decimal(9,0)") / F.coalesce("n", F.lit(1)).cast("decimal(9,0)")).cast("decimal(30,6)")
    rows = split.groupBy("session_id", F.coalesce("name", F.lit(NO_TOOL)).alias("tool")).agg(F.sum(F.coalesce("k", F.lit(0))).cast("long").alias("calls"), F.sum(part("pico")).alias("pico"), *[F.sum(part(p)).alias(p) for p in PARTS])
    ranked = tool_order(rows.withColumn("tokens", F.col("total")), ["session_id"])
    row = F.struct("rank", "tool", (F.col("pico").cast("double") / 1e12).alias("usd"), F.col("calls").alias("call_count"), _vector(lambda p: F.col(p).cast("double")).alias("tokens"))
    return ranked.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("tool_rows"))  # a row a tool


def children_of(children: DataFrame) -> DataFrame:
    """(session_id, subagents): what a session's children come to: how many, priced sum, tokens, what is unpriced or unreadable.

    ``children``: (parent_id, unreadable, pico, tokens and unpriced as vectors). Unreadable ones are counted and nothing else.
    """
    readable = ~F.col("unreadable")
    gap = lambda p: F.when(readable, F.when(F.col("pico").isNull(), F.col(f"tokens.{p}")).otherwise(F.col(f"unpriced.{p}")))
    out = children.groupBy(F.col("parent_id").alias("session_id")).agg(
        F.count("*").alias("count"), F.sum(F.when(readable, F.col("pico"))).cast(PICO).alias("pico"), F.sum(F.when(readable, F.col("tokens.total"))).alias("tokens_total"), *[F.sum(gap(p)).alias(f"u_{p}") for p in PARTS],
        F.count_if(readable & (F.col("pico").isNull() | (F.col("unpriced.total") > 0))).alias("unpriced_count"), F.count_if("unreadable").alias("unreadable_count"),
    )
    return out.select("session_id", F.struct("count", "pico", _zero("tokens_total").alias("tokens_total"), _vector(lambda p: _zero(F.col(f"u_{p}"))).alias("unpriced"), "unpriced_count", "unreadable_count").alias("subagents"))


def receipts(sessions: DataFrame, priced: DataFrame, calls: DataFrame, children: DataFrame) -> DataFrame:
    """One nested row per session of ``sessions`` (session_id, source, title, started_ms, ended_ms).

    ``priced`` are its requests with their prices, ``children`` as for ``children_of``. A session without requests has zeros and no
    price; sessions that aren't in ``sessions`` have no receipt.
    """
    gap = F.col("pico").isNull()
    totals = priced.groupBy("session_id").agg(F.sum("pico").cast(PICO).alias("pico"), *[F.sum(p).alias(p) for p in PARTS], *[F.sum(F.when(gap, F.col(p))).alias(f"u_{p}") for p in PARTS], F.max(F.col("write_floor") | F.col("read_floor")).alias("floored"))
    totals = totals.select("session_id", "pico", _vector(lambda p: F.col(p)).alias("tokens"), _vector(lambda p: _zero(F.col(f"u_{p}"))).alias("unpriced"), "floored")
    mix = model_mix(priced).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "model", "tokens", "share"))).alias("models"))  # a row a model
    joined = sessions
    for other in (totals, tool_lines(priced, calls), mix, children_of(children)):
        joined = joined.join(other, "session_id", "left")
    nothing = _vector(lambda p: F.lit(0).cast("long"))
    joined = joined.withColumns({"tokens": F.coalesce("tokens", nothing), "unpriced": F.coalesce("unpriced", nothing)})
    kids = lambda f: F.col(f"subagents.{f}")
    both = F.when(F.col("pico").isNotNull() | kids("pico").isNotNull(), _zero("pico") + _zero(kids("pico")))
    coverage = F.when(F.col("pico").isNull(), "unpriced").when((F.col("unpriced.total") > 0) | F.col("floored"), "partial").otherwise("full")
    joined = joined.withColumn("both", both).withColumn("coverage", coverage)
    child_gap = (_zero(kids("unpriced.total")) > 0) | (_zero(kids("unpriced_count")) > 0) | (_zero(kids("unreadable_count")) > 0)
    usd = lambda c: (c.cast("double") / 1e12)
    claim = lambda c: F.when(c.isNotNull(), F.struct(F.lit(KIND).alias("kind"), F.lit(BASIS).alias("basis"), usd(c).alias("min_usd")))
    combined = F.when(F.col("both").isNull(), "unpriced").when((F.col("coverage") != "full") | child_gap, "partial").otherwise("full")
    return joined.select(
        F.lit(VERSION).alias("schema_version"), "session_id", "source", "title", "started_ms", (F.col("ended_ms") - F.col("started_ms")).alias("duration_ms"), F.coalesce("models", F.array().cast("array<struct<rank:int,model:string,tokens:bigint,share:double>>")).alias("models"),
        F.coalesce("tool_rows", F.array().cast("array<struct<rank:bigint,tool:string,usd:double,call_count:bigint,tokens:struct<input:double,output:double,cache_read:double,cache_creation:double,total:double>>>")).alias("tool_rows"),
        "tokens", "unpriced", usd(F.col("pico")).alias("total_usd"), claim(F.col("pico")).alias("total_estimate"), "coverage",
        F.struct(_zero(kids("count")).alias("count"), usd(kids("pico")).alias("priced_usd"), claim(kids("pico")).alias("estimate"), _zero(kids("tokens_total")).alias("tokens_total"), _vector(lambda p: _zero(kids(f"unpriced.{p}"))).alias("unpriced"), _zero(kids("unpriced_count")).alias("unpriced_count"), _zero(kids("unreadable_count")).alias("unreadable_count")).alias("subagents"),
        F.struct(usd(F.col("both")).alias("priced_usd"), claim(F.col("both")).alias("estimate"), (F.col("tokens.total") + _zero(kids("tokens_total"))).alias("tokens_total"), _vector(lambda p: F.col(f"unpriced.{p}") + _zero(kids(f"unpriced.{p}"))).alias("unpriced"), combined.alias("coverage")).alias("combined"),
    )


_NAMES = {"input": "InputTokens", "output": "OutputTokens", "cache_read": "CacheReadTokens", "cache_creation": "CacheCreationTokens", "total": "TotalTokens"}


def _plain(of: str, prefix: str = "") -> list[Column]:
    name = lambda p: prefix + _NAMES[p] if prefix else _NAMES[p][0].lower() + _NAMES[p][1:]
    return [F.col(f"{of}.{p}").alias(name(p)) for p in PARTS]


def _claim(of: str, prefix: str) -> list[Column]:
    kind, basis = ("costKind", "costBasis") if not prefix else (f"{prefix}CostKind", f"{prefix}CostBasis")
    return [F.col(f"{of}.kind").alias(kind), F.col(f"{of}.basis").alias(basis)]


def session_table(found: DataFrame) -> DataFrame:
    """The flat table of sessions, 48 columns, a row a receipt."""
    return found.select(
        F.col("schema_version").alias("schemaVersion"), F.col("session_id").alias("sessionId"), F.col("source").alias("agent"), F.coalesce("title", F.lit("")).alias("title"), F.date_format(F.timestamp_millis("started_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedAt"), F.col("duration_ms").alias("durationMs"),
        F.get("models", F.lit(0))["model"].alias("primaryModel"), F.col("total_usd").alias("totalUsd"), *_plain("tokens"), *_claim("total_estimate", ""), F.lit(PARENT).alias("totalUsdScope"), F.col("subagents.priced_usd").alias("subagentsPricedUsd"), F.col("combined.priced_usd").alias("combinedPricedUsd"),
        *_claim("combined.estimate", "combined"), F.col("subagents.tokens_total").alias("subagentsTokens"), F.col("combined.tokens_total").alias("combinedTotalTokens"), F.col("subagents.count").alias("subagentCount"), F.col("subagents.unpriced_count").alias("subagentUnpricedCount"),
        F.col("subagents.unreadable_count").alias("subagentUnreadableCount"), F.col("coverage").alias("pricingCoverage"), *_plain("unpriced", "unpriced"), F.lit(PARENT).alias("unpricedTokensScope"), *_claim("subagents.estimate", "subagents"), F.lit(CHILDREN).alias("subagentsUsdScope"),
        *_plain("subagents.unpriced", "subagentsUnpriced"), F.lit(CHILDREN).alias("subagentsUnpricedTokensScope"), *_plain("combined.unpriced", "combinedUnpriced"), F.lit(BOTH).alias("combinedUnpricedTokensScope"), F.col("combined.coverage").alias("combinedPricingCoverage"),
    )


def tool_table(found: DataFrame) -> DataFrame:
    """The flat table of tools, 16 columns, a row a tool of a receipt.

    Unpriced tokens can't be told apart by tool: where a session isn't priced in full, a priced tool's coverage is indeterminate.
    """
    rows = found.select("schema_version", "session_id", "source", "coverage", F.explode("tool_rows").alias("t"))
    covered = F.when(F.col("t.usd").isNull(), "unpriced").when(F.col("coverage") == "full", "full").otherwise("indeterminate")
    priced = F.col("t.usd").isNotNull()
    return rows.select(
        F.col("schema_version").alias("schemaVersion"), F.col("session_id").alias("sessionId"), F.col("source").alias("agent"), F.col("t.tool").alias("tool"), F.col("t.usd").alias("usd"), *_plain("t.tokens"), F.col("t.call_count").alias("callCount"), F.when(priced, KIND).alias("costKind"), F.when(priced, BASIS).alias("costBasis"),
        F.lit(TOOL).alias("costScope"), covered.alias("pricingCoverage"), F.when(covered == "indeterminate", LIMITATION).otherwise("").alias("pricingCoverageLimitation"),
    )


def compared(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, tokens_delta, usd_delta) of pairs (a_id, b_id) of receipts, b less a; null where either has no price, and no ranking."""
    side = lambda s: found.select(F.col("session_id").alias(f"{s}_id"), F.col("tokens.total").alias(f"{s}_tokens"), F.col("total_usd").alias(f"{s}_usd"))
    both = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    return both.select("a_id", "b_id", (F.col("b_tokens") - F.col("a_tokens")).alias("tokens_delta"), (F.col("b_usd") - F.col("a_usd")).alias("usd_delta"))


def write_json(found: DataFrame, path: str) -> None:
    """One JSON object a line, nulls spelled out, so that every object has all fields."""
    found.write.option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Receipts as written; a line of another version or form is an error, not a row of nulls."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    known = F.when(F.col("schema_version") == VERSION, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("not a receipt of this version: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))).cast("int"))
    return rows.withColumn("schema_version", known)


def write_csv(table: DataFrame, path: str) -> None:
    """A flat table with a header; fields are quoted where they need it, quotes doubled, null amounts empty."""
    table.write.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
