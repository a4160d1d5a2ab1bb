"""Weighted rendezvous hashing of stable record keys over shards; DataFrame functions only.

Every (key, shard) pair draws a uniform number u from a hash, and the key goes to the shard with the least
``-ln(u) / weight``.  Draws of a shard don't depend on the other shards, so one more shard takes keys only into itself
(about its share of the weight), and a shard that goes gives its keys to the others and moves no other key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import numbered, table, text_or_empty


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (int, 0 to ``len(weights) - 1``) of a key.

    The key's text form decides, so equal keys go together, whatever their type; a null key is a key of its own.  A
    shard of weight 0 gets nothing.  Draws that tie (2^-53) go to the smaller shard.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    name = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(seed), F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0]).getField("shard").cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", salts: int = 256) -> DataFrame:
    """Deals rows to weighted shards by their key, with a gapless slot in each.

    Returns key, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, shard, slot, grown_shard (the
    shard under the weights ``grown``; null if not asked for).  Repeated keys share a shard and get slots of their own.
    An empty table gives an empty result.  Only ``key`` and ``text`` are read, so other columns can't clash.
    """
    body = text_or_empty(text).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"), (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered(rows, ["shard"], ["doc_id", "size", "text_crc32", "grown_shard"], salts, "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards, and where 17 would put them."""
    out = shard(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op1_sharding": op1_sharding}
ORACLE_SQL: dict[str, str] = {}
