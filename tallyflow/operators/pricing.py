"""Pricing: a dated range join of requests with the price book, then exact sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import usage as U
from tallyflow.schema import PICO, RATES, TOKENS

#: A price book of at most so many rows is broadcast.
MOST_BROADCAST = 100_000


def book_side(prices: DataFrame) -> DataFrame:
    """The book as one side of a join: broadcast if a count shows that it is small."""
    return F.broadcast(prices) if prices.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else prices


def resolve(units: DataFrame, prices: DataFrame, vendor: Column | None = None) -> DataFrame:
    """Adds ``vendor``, ``price`` (the row of the vendor and model whose dates, both inclusive, hold the request's) and ``rates``.

    No row, no price: nothing is guessed and no neighbour is taken. The keys are equal, the dates a residual, so that the
    join stays a hash join; a book without overlaps (see ``book_faults``) gives one row a request.
    """
    dated = units.withColumn("vendor", U.vendor() if vendor is None else vendor).withColumn("day", F.to_date(F.timestamp_millis("ts_ms")) if "day" not in units.columns else F.col("day"))
    book = prices.select(F.col("vendor").alias("p_vendor"), F.col("model").alias("p_model"), "from_date", "to_date", F.struct("from_date", *RATES, "tiers").alias("price"))
    holds = (F.col("vendor") == F.col("p_vendor")) & (F.col("model") == F.col("p_model")) & (F.col("day") >= F.col("from_date")) & (F.col("to_date").isNull() | (F.col("day") <= F.col("to_date")))
    joined = dated.join(book_side(book), holds, "left").drop("p_vendor", "p_model", "from_date", "to_date")
    return joined.withColumn("rates", F.when(F.col("price").isNotNull(), U.rates("price")))


def price_units(units: DataFrame, prices: DataFrame, vendor: Column | None = None) -> DataFrame:
    """Adds ``pico`` (null unless usage is consistent and a row is cited) and the two lower-bound flags."""
    priced = resolve(units, prices, vendor)
    ok = U.is_priceable() & F.col("rates").isNotNull()
    flag = lambda c: F.coalesce(ok & c, F.lit(False))
    return priced.withColumn("pico", F.when(ok, U.cost())).withColumn("write_floor", flag(U.write_is_lower_bound())).withColumn("read_floor", flag(U.read_is_lower_bound()))


def price_turns(priced: DataFrame) -> DataFrame:
    """Requests to turns: the priced ones' sum (null if none is), unpriced tokens, flags, and whether all are priced."""
    unpriced = F.col("pico").isNull()
    sums = [F.sum(t).alias(t) for t in TOKENS]
    return priced.groupBy("session_id", "turn_index").agg(
        *sums, F.sum("pico").cast(PICO).alias("pico"), F.sum(F.when(unpriced, F.col("total")).otherwise(0)).alias("unpriced_tokens"),
        F.count("*").alias("n_units"), F.count("pico").alias("n_priced"), F.bool_or("write_floor").alias("write_floor"), F.bool_or("read_floor").alias("read_floor"),
    ).withColumn("complete", F.col("n_units") == F.col("n_priced"))


def envelope_units(turns: DataFrame, units: DataFrame) -> DataFrame:
    """Units of turns whose explicit requests add up to the turn's envelope in all seven counts; no other turn has any.

    A turn with ``units_state`` implicit is its own single unit.
    """
    total = lambda t: F.sum(t).alias(f"u_{t}")
    sums = units.groupBy("session_id", "turn_index").agg(*map(total, TOKENS), F.bool_and(U.is_priceable()).alias("valid"))
    good = turns.where("units_state = 'explicit'").join(sums, ["session_id", "turn_index"])
    for t in TOKENS:
        good = good.where(F.col(t).eqNullSafe(F.col(f"u_{t}")))
    good = good.where("valid").select("session_id", "turn_index")
    implicit = turns.where("units_state = 'implicit'").where(F.col("total").isNotNull()).withColumn("unit_ord", F.lit(0).cast("long"))
    return units.join(good, ["session_id", "turn_index"], "left_semi").unionByName(implicit.select(*units.columns))


def cheapest_current(prices: DataFrame) -> DataFrame:
    """Per vendor, the open row of the lowest input rate; the earlier in the book wins ties."""
    return prices.where("to_date is null").groupBy("vendor").agg(F.min_by(F.struct("model", "from_date", *RATES, "tiers"), F.struct("r_in", "file_ord")).alias("cheapest"))


def price_delta(priced: DataFrame, prices: DataFrame) -> DataFrame:
    """Per session: its cost, the same tokens at its vendor's cheapest row, and the difference.

    Only for sessions of one vendor that are priced in full, without a lower-bound flag.
    """
    whole = priced.groupBy("session_id").agg(F.countDistinct("vendor").alias("n"), F.bool_and(F.col("pico").isNotNull() & ~F.col("write_floor") & ~F.col("read_floor")).alias("full")).where("n = 1 and full")
    at = priced.drop("rates", "price").join(whole.select("session_id"), "session_id", "left_semi").join(book_side(cheapest_current(prices)), "vendor")
    at = at.withColumn("rates", U.rates("cheapest")).withColumn("least", U.cost())
    return at.groupBy("session_id", "vendor").agg(F.sum("pico").cast(PICO).alias("pico"), F.sum("least").cast(PICO).alias("cheapest_pico")).withColumn("delta_pico", (F.col("pico") - F.col("cheapest_pico")).cast(PICO))


def book_faults(prices: DataFrame) -> DataFrame:
    """Rows of a book that break its rules: (vendor, model, from_date, fault)."""
    after = W.partitionBy("vendor", "model").orderBy("from_date", "file_ord")
    seen = prices.withColumn("next_from", F.lead("from_date").over(after)).withColumn("opens", F.sum(F.col("to_date").isNull().cast("int")).over(W.partitionBy("vendor", "model")))
    tiers = F.transform(F.coalesce("tiers", F.array()), lambda t: t["above"])
    fault = (
        F.when(F.col("to_date") < F.col("from_date"), "ends before it begins")
        .when(F.col("next_from").isNotNull() & (F.col("to_date").isNull() | (F.col("to_date") >= F.col("next_from"))), "overlaps the next row")
        .when(F.col("next_from").isNotNull() & (F.date_add("to_date", 1) != F.col("next_from")), "leaves a gap").when(F.col("opens") > 1, "more than one open row")
        .when(F.size(F.array_distinct(tiers)) != F.size(tiers), "a tier's threshold repeats").when(F.array_sort(tiers) != tiers, "tiers out of order")
    )
    return seen.withColumn("fault", fault).where("fault is not null").select("vendor", "model", "from_date", "fault")
