"""Attribution of priced turns to tools, models and sessions, with coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import text as X
from tallyflow.schema import PICO

NO_TOOL, UNATTRIBUTED = "(thinking/reply)", "(unattributed usage)"


def by_tool(turns: DataFrame, calls: DataFrame, unattributed: DataFrame | None = None) -> DataFrame:
    """(session_id, tool, n_calls, pico, tokens): each turn split evenly over its calls; a turn without calls is a tool of its own.

    ``turns`` comes from ``price_turns``. pico is null unless a contributing turn has a price. Shares keep twelve decimals;
    sums over a session are taken from turns, never from shares. ``unattributed`` (session_id, tokens) adds rows with no calls.
    """
    named = calls.groupBy("session_id", "turn_index", "name").agg(F.count("*").alias("k"))
    total = calls.groupBy("session_id", "turn_index").agg(F.count("*").alias("n"))
    split = turns.join(total, ["session_id", "turn_index"], "left").join(named, ["session_id", "turn_index"], "left")
    n, k = F.coalesce("n", F.lit(1)), F.coalesce("k", F.lit(1))
    part = lambda c: F.col(c).cast("decimal(24,0)") * k.cast("decimal(9,0)") / n.cast("decimal(9,0)")
    out = split.groupBy("session_id", F.coalesce("name", F.lit(NO_TOOL)).alias("tool")).agg(
        F.sum(F.coalesce("k", F.lit(0))).alias("n_calls"), F.sum(part("pico").cast("decimal(30,6)")).alias("pico"), F.sum(part("total").cast("decimal(30,6)")).alias("tokens"))
    if unattributed is not None:
        extra = unattributed.select("session_id", F.lit(UNATTRIBUTED).alias("tool"), F.lit(0).cast("long").alias("n_calls"), F.lit(None).cast("decimal(38,6)").alias("pico"), F.col("tokens").cast("decimal(38,6)").alias("tokens"))
        out = out.unionByName(extra)
    return out


def session_totals(turns: DataFrame) -> DataFrame:
    """Per session: priced sum, all tokens, and how far the prices cover them."""
    return turns.groupBy("session_id").agg(
        F.sum("pico").cast(PICO).alias("pico"), F.sum("total").alias("tokens"), F.sum("unpriced_tokens").alias("unpriced_tokens"), F.count("*").alias("n_turns"),
        F.sum((~F.col("complete")).cast("long")).alias("n_unpriced_turns"), F.bool_or("write_floor").alias("write_floor"), F.bool_or("read_floor").alias("read_floor"),
    )


def coverage() -> Column:
    """full, partial or unpriced, of a row with ``pico`` and ``unpriced_tokens``."""
    return F.when(F.col("pico").isNull(), "unpriced").when(F.col("unpriced_tokens") > 0, "partial").otherwise("full")


def by_model(priced: DataFrame) -> DataFrame:
    return priced.where("pico is not null").groupBy("session_id", "model").agg(F.sum("pico").cast(PICO).alias("pico"), F.sum("total").alias("tokens"))


def model_mix(units: DataFrame) -> DataFrame:
    """Each model's share of a session's tokens, largest first."""
    each = units.groupBy("session_id", F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(F.sum("total").alias("tokens"))
    whole = F.sum("tokens").over(W.partitionBy("session_id"))
    ranked = W.partitionBy("session_id").orderBy(F.desc("tokens"), "model")
    return each.withColumn("share", F.round(F.col("tokens") / F.nullif(whole, F.lit(0)), 6)).withColumn("rank", F.row_number().over(ranked))


def peak_turn(turns: DataFrame) -> DataFrame:
    """The turn of most tokens, the first on ties."""
    top = F.max_by(F.struct("turn_index", "total"), F.struct("total", -F.col("turn_index")))
    return turns.groupBy("session_id").agg(top.alias("t")).select("session_id", F.col("t.turn_index").alias("turn_index"), F.col("t.total").alias("total"))


def prices_used(priced: DataFrame) -> DataFrame:
    """The distinct (vendor, model, from_date) that prices were taken from, with the days they served."""
    return priced.where("pico is not null").select("session_id", "vendor", "model", F.col("price.from_date").alias("from_date"), "day").dropDuplicates()


def tool_order(rows: DataFrame, by: list[str], money: str = "pico") -> DataFrame:
    """Adds the long ``rank`` of a receipt's tool rows within ``by``: priced rows first, by most money, then by name; the others by
    most tokens, then by name."""
    unpriced = F.when(F.col(money).isNull(), F.col("tokens"))
    order = W.partitionBy(*by).orderBy(F.col(money).desc_nulls_last(), unpriced.desc_nulls_last(), "tool")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def rows_of_all(known: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, n_sessions, n_units, tokens) for every row of ``known``: one without usage gets zeros, usage of an unknown key is left out.

    ``known`` is a narrow list of keys. Usage is summed before the join, so what is joined has a row a key.
    """
    of_session = units.groupBy(key, "session_id").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
    seen = of_session.groupBy(key).agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_units"), F.sum("total").alias("tokens"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_sessions", "n_units", "tokens")]
    return known.select(key).distinct().join(seen, key, "left").select(key, *zero)


def ledger(rows: DataFrame, by: list[str], order: list[str], money: str = "pico", total: str | None = None) -> DataFrame:
    """Adds to rows of money what a ledger shows of them: ``amount`` and ``total_amount`` (texts) and ``decimals``, one for all of a ledger.

    Each amount is rounded down at the most decimals that a row or the total needs; null counts as nothing. Where ``total``
    names a column with a ledger's stated total and the amounts come to more than it, the excess units are taken from the largest
    amounts, in their order; so rows never add up to more, and ``total_amount`` is exactly what the rows add up to.
    """
    of, seq = W.partitionBy(*by), W.partitionBy(*by).orderBy(F.col("_units").desc(), *order)
    needs = F.greatest(X.usd_decimals(F.col(money)), X.usd_decimals(F.col(total)) if total else F.lit(2))
    shown = rows.withColumn("decimals", F.max(needs).over(of))
    shown = shown.withColumn("_units", F.coalesce(X.usd_units(F.col(money), F.col("decimals")), F.lit(0).cast(PICO)))
    if total:
        before = F.sum("_units").over(seq.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_units")
        excess = F.greatest(F.lit(0).cast(PICO), F.sum("_units").over(of) - X.usd_units(F.coalesce(F.col(total), F.lit(0).cast(PICO)), F.col("decimals")))
        shown = shown.withColumn("_taken", F.greatest(F.lit(0).cast(PICO), F.least("_units", excess - before))).withColumn("_units", (F.col("_units") - F.col("_taken")).cast(PICO)).drop("_taken")
    text = lambda c: X.usd_text(c.cast(PICO), F.col("decimals"))
    return shown.withColumn("amount", text(F.col("_units"))).withColumn("total_amount", text(F.sum("_units").over(of))).drop("_units")
