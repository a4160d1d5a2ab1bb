"""Normalised tables that the operators work on.

``units``: one row per model request, the grain that is priced. ``turns`` and ``calls`` hang on (session_id, turn_index).
Token counts are longs, money is whole pico-dollars (10^-12 USD) in DECIMAL(38,0): a rate of r USD per million tokens is
r * 10^6 pico-dollars per token, exactly, for rates of up to six decimals.
"""

from __future__ import annotations

from pyspark.sql import types as T

TOKENS = ("input", "output", "cache_read", "cache_creation", "cc_5m", "cc_1h", "total")
RATES = ("r_in", "r_out", "r_cached", "r_write", "r_write_5m", "r_write_1h")
PICO = "decimal(38,0)"


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: provider_state is absent (no evidence), blocked (routed: never priced) or direct (then ``provider`` is the vendor).
UNITS = T.StructType([*_strings("session_id"), *_longs("turn_index", "unit_ord", *TOKENS, "ts_ms"), *_strings("model", "provider_state", "provider", "source")])
CALLS = T.StructType([*_strings("session_id"), *_longs("turn_index", "call_ord"), *_strings("name"), T.StructField("is_shell", T.BooleanType()), *_strings("input_json", "output", "status"), *_longs("started_ms", "ended_ms")])
TIER = T.StructType(_longs("above", *RATES))
PRICES = T.StructType([*_strings("vendor", "model"), T.StructField("from_date", T.DateType()), T.StructField("to_date", T.DateType()), *_longs(*RATES), T.StructField("tiers", T.ArrayType(TIER)), *_longs("file_ord")])
