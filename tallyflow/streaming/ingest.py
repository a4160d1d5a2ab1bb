"""Streaming ingest: evolving snapshots by upsert, the last reading of each quota as keyed state, and windowed usage with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyflow.operators.windows import crossing
from tallyflow.schema import PICO
from tallyflow.sources.normalize import merge_snapshots


#: After so many batches the state is written whole; until then a batch writes what it changes.
COMPACT = 16


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max_by(F.struct("line_no", "usage", "valid"), F.struct("valid", F.when(F.col("valid"), F.col("usage.output")).otherwise(-1), "line_no"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.line_no", "b.usage", "b.valid")


def _versions(spark: SparkSession, target: str) -> list[tuple[int, bool]]:
    """(batch, whether it holds the whole state) of the finished batches; a missing list is an empty one, an unreadable one an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    rows = spark.read.schema("batch long, whole boolean").json(f"{target}/_versions").distinct().collect()
    return sorted((r["batch"], r["whole"]) for r in rows)


def latest_state(spark: SparkSession, target: str, keys: list[str], before: int | None = None) -> DataFrame | None:
    """The table after the last finished batch, or after the last one before batch ``before``; None before the first.

    It is the last whole state with the changes since then, at most ``COMPACT`` of them.
    """
    known = [v for v in _versions(spark, target) if before is None or v[0] < before]
    if not known:
        return None
    start = max((k for k, (_, whole) in enumerate(known) if whole), default=0)
    return _best(spark.read.parquet(*[f"{target}/v{batch}" for batch, _ in known[start:]]), keys)


def upsert_snapshots(stream: DataFrame, target: str, checkpoint: str, keys: list[str], compact: int = COMPACT) -> StreamingQuery:
    """Keeps the best snapshot per key as lines arrive. A batch writes the best of its own keys, so its work grows with the batch;
    every ``compact`` batches it writes the whole state, and versions that no reader or repeated batch needs are removed.

    Snapshots can change after they were seen, so results can't be appended; a version is named by its batch, so a batch that
    runs again writes the same one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, whole = batch.select(*keys, "line_no", "usage", "valid"), (number + 1) % compact == 0
        state = latest_state(spark, target, keys, number) if whole else None
        merged = _best(rows if state is None else rows.unionByName(state), keys)
        merged.write.mode("overwrite").parquet(f"{target}/v{number}")
        spark.createDataFrame([(number, whole)], "batch long, whole boolean").coalesce(1).write.mode("append").json(f"{target}/_versions")
        wholes = [n for n, w in _versions(spark, target) if w]
        if whole and len(wholes) > 1:  # the whole state before this one stays, for readers and for this batch again
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            files = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for n, _ in _versions(spark, target):
                if n < wholes[-2]:
                    files.delete(path(f"{target}/v{n}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crossings(readings: DataFrame, key: str = "account") -> DataFrame:
    """A stream of quota readings (key string, observed_ms, used, resets_ms) with ``crossing_ms`` from the reading before, of this batch or an
    earlier one. The state is one reading a key and outlives a restart; it grows with the keys, not with the readings."""
    names, empty = [key, "observed_ms", "used", "resets_ms", "b_ms", "b_used", "b_reset"], (None, None, None)

    def pair(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, out = state.get if state.exists else empty, []
        for r in pd.concat(list(batches)).sort_values(["observed_ms", "used"]).itertuples(index=False):
            now = (int(r.observed_ms), float(r.used), int(r.resets_ms))
            out.append((of[0], *now, *before))
            before = now
        state.update(before)
        yield pd.DataFrame(out, columns=names).astype({"b_ms": "Int64", "b_used": "float64", "b_reset": "Int64"})

    rows = readings.select(F.col(key).cast("string").alias(key), "observed_ms", F.col("used").cast("double").alias("used"), "resets_ms")
    schema = f"{key} string, observed_ms long, used double, resets_ms long, b_ms long, b_used double, b_reset long"
    paired = rows.groupBy(key).applyInPandasWithState(pair, schema, "observed_ms long, used double, resets_ms long", "append", GroupStateTimeout.NoTimeout)
    return paired.select(key, "observed_ms", "used", "resets_ms", crossing(F.col("b_used"), F.col("b_ms"), F.col("b_reset")).alias("crossing_ms"))


def windowed_usage(priced: DataFrame, late: str = "1 day", size: str = "7 days") -> DataFrame:
    """Tokens and cost per model and event-time window; requests later than ``late`` are dropped by the watermark. Works on streams and tables."""
    at = priced.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", size), "model").agg(F.sum("total").alias("tokens"), F.sum("pico").cast(PICO).alias("pico"), F.count("*").alias("n_units")).select(F.unix_millis("window.start").alias("start_ms"), "model", "tokens", "pico", "n_units")


__all__ = ["crossings", "latest_state", "merge_snapshots", "upsert_snapshots", "windowed_usage"]
