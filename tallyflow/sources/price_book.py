"""Price books as JSON files, one per vendor, to exact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: JSON names of the rates, in the order of ``schema.RATES`` (fixed values).
NAMES = ("input", "output", "input_cached", "input_cache_write", "input_cache_write_5m", "input_cache_write_1h")
_RATE_FIELDS = ", ".join(f"{n}: decimal(18,6)" for n in NAMES)
_ROW = f"{_RATE_FIELDS}, from_date: date, to_date: date, context_tiers: array<struct<above_input_tokens: bigint, {_RATE_FIELDS}>>, sources: array<struct<url: string, observed_at: string, excerpt: string>>"
BOOK = f"struct<vendor: string, models: map<string, struct<price_history: array<struct<{_ROW}>>>>, omitted: array<struct<model: string, reason: string, source: string>>>"


def _pico(prefix: str) -> str:
    from tallyflow.schema import RATES

    return ", ".join(f"cast({prefix}.{n} * 1000000 as bigint) as {r}" for n, r in zip(NAMES, RATES))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Rows like ``schema.PRICES``. A file that can't be parsed gives none, so its models stay without prices."""
    books = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.from_json("value", BOOK).alias("b"))
    rows = books.where("b.vendor is not null").select(F.col("b.vendor").alias("vendor"), F.explode("b.models").alias("model", "m")).select("vendor", "model", F.posexplode("m.price_history").alias("place", "p"))
    tiers = f"transform(coalesce(p.context_tiers, array()), t -> struct(t.above_input_tokens as above, {_pico('t')}))".replace("coalesce(p.context_tiers, array())", "p.context_tiers")
    out = rows.selectExpr("vendor", "model", "p.from_date as from_date", "p.to_date as to_date", *_pico("p").split(", "), f"{tiers} as tiers", "cast(place as bigint) as place")
    from pyspark.sql import Window as W

    return out.withColumn("file_ord", (F.row_number().over(W.partitionBy("vendor").orderBy("model", "place")) - 1).cast("long")).drop("place")
