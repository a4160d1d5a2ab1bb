"""Receipts, their flat tables, and what is written read again."""

import json

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import receipt as R


@pytest.fixture(scope="module")
def found(spark):
    units = [("a", 0, "m1", 10, 2, 0, 3, 5_000_000_000_000), ("a", 0, "m2", 1, 1, 0, 0, None), ("a", 1, "m1", 4, 0, 0, 0, 1_000_000), ("b", 0, "m1", 7, 0, 0, 0, None), ("c", 0, "m1", 8, 0, 0, 0, 3_000_000)]
    cols = "session_id string, turn_index long, model string, input long, output long, cache_read long, cache_creation long, pico long"
    priced = spark.createDataFrame(units, cols).withColumns({"pico": F.col("pico").cast("decimal(38,0)"), "total": F.expr("input + output + cache_read + cache_creation"), "write_floor": F.lit(False), "read_floor": F.lit(False)})
    calls = spark.createDataFrame([("a", 0, "Bash"), ("a", 0, "Bash"), ("a", 0, "Read"), ("b", 0, "Read")], "session_id string, turn_index long, name string")
    v = "struct<input:long,output:long,cache_read:long,cache_creation:long,total:long>"
    kid = lambda t: (t, 0, 0, 0, t)
    children = spark.createDataFrame([("a", False, 10**12, kid(5), kid(0)), ("a", False, None, kid(6), kid(0)), ("a", True, 10**12, kid(99), kid(99)), ("b", False, 2 * 10**12, kid(1), kid(1))], f"parent_id string, unreadable boolean, pico long, tokens {v}, unpriced {v}")
    sessions = spark.createDataFrame([("a", "x", 'T, "q"\nz', 0, 1500), ("b", "x", None, None, None), ("c", "x", "t", 5, 5), ("none", "y", "t", 0, 1)], "session_id string, source string, title string, started_ms long, ended_ms long")
    return R.receipts(sessions, priced, calls, children.withColumn("pico", F.col("pico").cast("decimal(38,0)"))).cache()


def test_sessions(found):
    rows = {r["sessionId"]: r for r in R.session_table(found).collect()}
    assert len(R.session_table(found).columns) == 48 and set(rows) == {"a", "b", "c", "none"}
    a, b, c, none = (rows[k] for k in ("a", "b", "c", "none"))
    assert (a["startedAt"], a["durationMs"], a["primaryModel"], a["totalUsd"], a["inputTokens"], a["totalTokens"], a["unpricedTotalTokens"], a["pricingCoverage"]) == ("1970-01-01T00:00:00.000Z", 1500, "m1", 5.000001, 15, 21, 2, "partial")
    assert (a["subagentCount"], a["subagentUnpricedCount"], a["subagentUnreadableCount"], a["subagentsTokens"], a["combinedTotalTokens"], a["subagentsUnpricedTotalTokens"], a["combinedUnpricedTotalTokens"], a["combinedPricedUsd"], a["combinedPricingCoverage"]) == (3, 1, 1, 11, 32, 6, 8, 6.000001, "partial")
    assert (b["totalUsd"], b["costKind"], b["pricingCoverage"], b["combinedPricedUsd"], b["combinedPricingCoverage"], b["unpricedInputTokens"], b["startedAt"]) == (None, None, "unpriced", 2.0, "partial", 7, None)
    assert (c["pricingCoverage"], c["combinedPricingCoverage"], c["subagentsCostKind"], c["costKind"]) == ("full", "full", None, "lower-bound")
    assert (none["totalTokens"], none["totalUsd"], none["primaryModel"], none["combinedPricingCoverage"]) == (0, None, None, "unpriced")


def test_tools(found):
    rows = {(r["sessionId"], r["tool"]): r for r in R.tool_table(found).collect()}
    assert len(R.tool_table(found).columns) == 16 and set(rows) == {("a", "Bash"), ("a", "Read"), ("a", "(thinking/reply)"), ("b", "Read"), ("c", "(thinking/reply)")}
    bash = rows["a", "Bash"]
    assert (round(bash["usd"], 6), round(bash["totalTokens"], 4), bash["callCount"], bash["pricingCoverage"]) == (3.333333, 11.3333, 2, "indeterminate") and bash["pricingCoverageLimitation"] == R.LIMITATION
    assert (rows["b", "Read"]["usd"], rows["b", "Read"]["pricingCoverage"], rows["c", "(thinking/reply)"]["pricingCoverage"]) == (None, "unpriced", "full")
    ranks = {r["session_id"]: [t["tool"] for t in r["tool_rows"]] for r in found.collect()}
    assert ranks["a"] == ["Bash", "Read", "(thinking/reply)"] and ranks["none"] == []
    d = R.compared(found, found.sparkSession.createDataFrame([("c", "a"), ("b", "a")], "a_id string, b_id string")).orderBy("a_id").collect()
    assert [(r["tokens_delta"], r["usd_delta"] and round(r["usd_delta"], 6)) for r in d] == [(14, None), (13, 4.999998)]


def test_what_is_written_reads_again(spark, found, tmp_path):
    R.write_json(found, str(tmp_path / "json"))
    assert sorted(map(str, R.read_json(spark, str(tmp_path / "json"), found.schema).collect())) == sorted(map(str, found.collect()))
    line = json.loads(next(x for f in (tmp_path / "json").glob("part*") for x in f.read_text().splitlines() if '"none"' in x))
    assert list(line)[:2] == ["schema_version", "session_id"] and line["total_usd"] is None and line["tool_rows"] == []  # nulls are spelled out
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "part-0.json").write_text(json.dumps(line | {"schema_version": 1}) + "\n")
    with pytest.raises(Exception, match="not a receipt of this version"):
        R.read_json(spark, str(tmp_path / "old"), found.schema).collect()
    R.write_csv(R.session_table(found).coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part*")).read_text()
    assert '"T, ""q""\nz"' in text and text.startswith("schemaVersion,sessionId,agent,title,")
    again = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["title"] for r in again.collect()} == {'T, "q"\nz', None, "t"} and again.count() == 4
