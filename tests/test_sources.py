"""Readers, normalisers and streams on small files."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from frames import frame

from tallyflow.sources import jsonl as J
from tallyflow.sources import codex as X
from tallyflow.sources import normalize as N
from tallyflow.sources.price_book import read_prices
from tallyflow.streaming import ingest as S


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def say(mid, out, at, usage=None, **more):
    u = {"input_tokens": 10, "output_tokens": out} | (usage or {})
    return {"type": "assistant", "timestamp": at, "message": {"id": mid, "model": "claude-a", "usage": u, "content": more.pop("content", [])}} | more


def test_files_and_lines(spark, tmp_path):
    write(tmp_path / "p" / "a.jsonl", say("m1", 1, 1), "", "{broken", "[1]", say("m2", 1, 2))
    write(tmp_path / "p" / "subagents" / "agent-1.jsonl", say("x", 1, 1))
    (tmp_path / "p" / "empty.jsonl").write_text("")
    write(tmp_path / "p" / "other.txt", "x")
    write(tmp_path / "q" / "chats" / "c.jsonl", {"id": "1"})
    write(tmp_path / "q" / "rollout-1.jsonl", {"id": "1"})
    names = lambda s: sorted(r["file"].rsplit("/", 1)[1] for r in J.list_files(spark, str(tmp_path), s).collect())
    assert names("claude-code") == ["a.jsonl", "c.jsonl", "rollout-1.jsonl"] and names("codex") == ["rollout-1.jsonl"] and names("gemini") == ["c.jsonl"]
    good, bad = J.split_bad(J.read_lines(spark, str(tmp_path / "p"), "claude-code"))
    assert [r["line_no"] for r in good.orderBy("line_no").collect()] == [0, 4] and bad.first()["dropped_records"] == 2
    assert json.loads(J.first_lines(good).first()["line"])["message"]["id"] == "m1"
    listing = J.list_files(spark, str(tmp_path), "claude-code")
    seen = listing.withColumn("size", F.when(F.contains("file", F.lit("a.jsonl")), F.col("size") + 1).otherwise(F.col("size")))
    assert [r["file"][-7:] for r in J.changed_files(listing, seen).collect()] == ["a.jsonl"]


def lines(spark, *records):
    return spark.createDataFrame([("f", k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)], "file string, line_no long, line string")


def test_snapshots_forks_and_unattributed(spark):
    ls = lines(
        spark, say("old", 9, 1), {"type": "fork-context-ref"}, say("m1", 5, 1000), say("m1", 7, 2000, {"input_tokens": 3}), say("m1", 7, 3000, {"input_tokens": 4}), say("m1", 99, 4000, {"input_tokens": "x"}),
        say("m2", 1, 5000, {"input_tokens": -1}), say(None, 2, 6000), say(None, 8, 7000), say("m3", 1, 8000, {"cache_creation_input_tokens": 10, "cache_creation": {"ephemeral_5m_input_tokens": 6, "ephemeral_1h_input_tokens": 6}}),
        say("m4", 1, 9000, {"cache_creation": {"ephemeral_5m_input_tokens": 6, "ephemeral_1h_input_tokens": 1}}),
    )
    rows = N.claude_turns(ls).orderBy("turn_index").collect()
    got = {r["key"]: (r["turn_index"], r["units_state"], r["usage"] and (r["usage"]["input"], r["usage"]["output"], r["usage"]["cache_creation"], r["usage"]["cc_5m"], r["usage"]["total"])) for r in rows}
    assert got["m1"] == (0, "implicit", (4, 7, 0, None, 11)) and got["m2"] == (1, "explicit", None)
    assert got["line:7"] == (2, "none", None) and got["line:8"] == (3, "none", None)
    assert got["m3"][2] == (10, 1, 10, None, 21) and got["m4"][2] == (10, 1, 7, 6, 18) and "old" not in got
    assert N.claude_unattributed(ls).first()["usage"]["output"] == 8


def test_calls_and_compactions(spark):
    use = lambda i, n, x: {"type": "tool_use", "id": i, "name": n, "input": x}
    result = lambda i, c, e=False: {"type": "user", "timestamp": 9, "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": c, "is_error": e}]}}
    ls = lines(spark, say("m1", 1, 1000, content=[use("a", "Bash", {"x": 1}), use("b", "Read", {})]), {"type": "compact_boundary", "timestamp": 5000}, {"type": "compact-summary", "timestamp": 6000}, result("a", "one"), result("a", "two", True), say("m1", 2, 2000, content=[use("a", "Other", {})]), say("m2", 1, 3000), {"type": "compact_boundary", "timestamp": 7000})
    got = {r["id"]: (r["call_ord"], r["name"], r["is_shell"], r["status"], r["output"]) for r in N.claude_calls(ls).collect()}
    assert got == {"a": (0, "Bash", True, "error", "two"), "b": (1, "Read", False, "running", None)}
    assert sorted((r["turn_index"], r["ts_ms"]) for r in N.claude_compactions(ls).collect()) == [(1, 5000 * 1000), (2, 7000 * 1000)]


def test_running_totals(spark):
    """Inherited totals, repeats, zero totals, and each reason against a log's requests."""
    use = lambda i, c, o, **k: {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, **k}
    both = lambda total, last=None: {"timestamp": 1, "payload": {"type": "token_count", "info": {"total_token_usage": total, **({"last_token_usage": last} if last is not None else {})}}}
    user, say = {"payload": {"type": "user_message"}}, lambda u: {"payload": {"type": "message", "role": "assistant", "usage": u}}
    setup = {"payload": {"type": "turn_context", "model": "gpt-a", "model_provider": " OpenAI "}}
    ls = lines(spark, setup, user, both(use(0, 0, 0)), both(use(1000, 400, 100), use(10, 4, 1)), both(use(1000, 400, 100), use(10, 4, 1)), user, user, {"payload": {"model": "gpt-b", "model_provider": "router"}}, both(use(1020, 400, 104), use(20, 0, 4)))
    got = [(r["turn_index"], r["model"], r["provider_state"], r["provider"], r["input"], r["cache_read"], r["output"]) for r in X.units(ls).orderBy("line_no").collect()]
    assert got == [(1, "gpt-a", "direct", "openai", 6, 4, 1), (2, "gpt-b", "blocked", None, 20, 0, 4)]
    one = lambda *records: X.evidence(lines(spark, *records)).select("reasons", "n_requests", "input", "cache_read", "output", "inherited").first()
    assert one(setup, user, both(use(1000, 400, 100), use(10, 4, 1)), both(use(1020, 400, 104), use(20, 0, 4))) == ([], 2, 26, 4, 5, 1089)
    first = both(use(10, 4, 1), use(10, 4, 1))
    assert one(first, both(use(30, 4, 5), use(20, 0, 4, reasoning_output_tokens=2, total_tokens=24))) == ([], 2, 26, 4, 5, 0)
    assert one(both(use(10, 4, 1)), both(use(30, 4, 5), use(20, 0, 4))) == (["totals"], 0, 26, 4, 5, 0)  # no first report
    assert one(first, both(use(9, 4, 1), use(0, 0, 1)), both(use(30, 4, 5), use(21, 0, 4))) == (["totals"], 0, 26, 4, 5, 0)  # falls
    assert one(first, both(use(30, 4, 5), use(19, 0, 4))) == (["totals"], 0, 26, 4, 5, 0)  # another report
    assert one(both(use(5, 0, 1), use(6, 0, 1)), both(use(9, 0, 1), use(4, 0, 0))) == (["totals"], 0, 9, 0, 1, 0)  # a report above its total
    assert one(first, both(use(30, "4", 5), use(20, 0, 4))) == (["malformed", "report-alone"], 0, 20, 0, 4, 0)
    assert one(first, both(use(30, 4, 5, total_tokens=36), use(20, 0, 4)))[0] == ["malformed", "report-alone"]
    assert one(first, both(use(30, 4, 5), use(20, 0, 4, reasoning_output_tokens=5)))[0] == ["malformed", "totals"]
    assert one({"payload": {"info": {"last_token_usage": use(7, 0, 2)}}}, first) == (["report-alone"], 0, 6, 4, 1, 0)
    assert one(both(use(0, 0, 0), use(7, 0, 2)), first)[0] == ["report-alone"]
    assert one(say(use(3, 0, 1)), say(use(2, 1, 2))) == ([], 2, 4, 1, 3, 0)  # single messages alone
    assert one(say(use(3, 0, 1)), first) == (["mixed"], 0, 6, 4, 1, 0) and one(first, say(use(99, 0, 1)))[:2] == ([], 1)
    assert one(say(use(3, 0, 1)), say([1]))[0] == ["malformed"]
    dropped = lines(spark, first).unionByName(spark.createDataFrame([("f", 99, "{no")], "file string, line_no long, line string"))
    assert X.evidence(dropped).first()["reasons"] == ["dropped"] and X.units(dropped).count() == 0
    assert X.evidence(lines(spark, user, setup)).count() == 0 and X.units(ls.limit(0)).count() == 0


def test_headers_echoes_and_told_compactions(spark):
    user = lambda c, at=None, **k: {"type": "user", "message": {"content": c}, **({"timestamp": at} if at else {}), **k}
    title = lambda t: {"type": "ai-title", "aiTitle": t}
    ls = lines(spark, user("before the fork", 1), title("old"), {"type": "fork-context-ref"}, user("meta", 1, isMeta=True, cwd="/m", gitBranch="main"), user("<command-name>x</command-name>", 3000), user([{"type": "tool_result", "text": "no"}, {"type": "text", "text": "\x1b[1mHi\n  there\x07"}], 2000),
               user("second", 9000, cwd="/n", isSidechain=True), say("m1", 1, 5000), say("m2", 1, 5001, content="<local-command-stdout>out"))
    assert tuple(N.claude_headers(ls).first())[1:] == ("Hi there", "claude-a", 2_000_000, 9_000_000, "/m", "main", True, 2)
    assert N.claude_turns(ls).count() == 1  # an echo is no answer
    ls = lines(spark, title("first"), title("x" * 200), title(3), user("[not a list]", 5))
    assert N.claude_headers(ls).first()["title"] == "x" * 119 + "…"
    assert N.claude_headers(lines(spark, title(" \x07 "), user("[not a list]", 5))).first()["title"] == "[not a list]"
    assert N.claude_headers(ls.limit(0)).count() == 0 and N.claude_headers(lines(spark, {"type": "x"})).first()["title"] is None
    told = lines(spark, say("m1", 1, 1), user("The context was compacted.", 2, isMeta=True), user("context compacted", 3), say("m2", 1, 4), user([{"type": "text", "text": "Context has been compacted"}], 5, isMeta=True))
    assert sorted((r["turn_index"], r["ts_ms"]) for r in N.claude_compactions(told).collect()) == [(1, 2000), (2, 5000)]


def test_compaction_pairs(spark):
    rows = spark.createDataFrame([("f", 1, "a", 0, 1000), ("f", 2, "b", 0, 6000), ("f", 3, "a", 0, 6500), ("f", 4, "a", 0, 6600), ("f", 5, "b", 1, 6700), ("f", 6, "a", 1, 11_701), ("f", 7, "b", 1, None)], "file string, line_no long, form string, turn_index long, ts_ms long")
    assert sorted((r["turn_index"], r["ts_ms"]) for r in N.pair_compactions(rows).collect()) == [(0, 1000), (0, 6500), (0, 6600), (1, 6700), (1, 11_701)]


def test_replay_against_a_plain_one(spark):
    rng, records = random.Random(2), []
    for k in range(400):
        x = rng.random()
        records.append({"$rewindTo": f"m{rng.randrange(k + 1)}"} if x < 0.1 else {"$set": {"messages": [{"id": f"m{j}", "v": k} for j in range(3)]}} if x < 0.12 else "{bad" if x < 0.15 else {"id": f"m{rng.randrange(k + 1)}", "v": k})
    kept = []
    for r in records:
        if isinstance(r, str):
            continue
        ids = [i for i, _ in kept]
        if "$rewindTo" in r:
            kept = kept[: ids.index(r["$rewindTo"])] if r["$rewindTo"] in ids else kept
        elif "$set" in r:
            kept = [(m["id"], m["v"]) for m in r["$set"]["messages"]]
        elif r["id"] in ids:
            kept[ids.index(r["id"])] = (r["id"], r["v"])
        else:
            kept.append((r["id"], r["v"]))
    got = [(r["id"], json.loads(r["message"])["v"]) for r in N.replay(lines(spark, *records)).orderBy("place").collect()]
    assert got == kept and kept
    one = N.gemini_turns(lines(spark, {"id": "a", "type": "gemini", "tokens": {"input": 5, "cached": 9, "tool": 2, "output": 1, "thoughts": 3}})).first()["usage"]
    assert (one["input"], one["output"], one["cache_read"], one["total"]) == (2, 4, 9, 15)


def test_databases(spark, tmp_path):
    path = tmp_path / "s.db"
    with sqlite3.connect(path) as db:
        db.execute("create table kv (key text primary key, value text)")
        head = {"fullConversationHeadersOnly": [{"bubbleId": b, "type": t} for b, t in (("b1", 1), ("b2", 2), ("b3", 2), ("b4", 1), ("b5", 2))]}
        db.executemany("insert into kv values (?, ?)", [("composerData:c1", json.dumps(head)), ("composerData:c2", "null"), *[(f"bubbleId:c1:b{k}", json.dumps({"toolFormerData": {"tool": k} | ({"name": "edit"} if k == 5 else {})})) for k in range(1, 6)]])
    (tmp_path / "broken.db").write_text("no database")
    kv = N.read_sqlite(spark, [str(path), str(tmp_path / "broken.db"), str(tmp_path / "none.db")], "select key, value from kv", "key string, value string")
    got = [(r["session_id"], r["turn_index"], r["tool"]) for r in N.cursor_turns(kv).orderBy("line_no").collect()]
    assert got == [("c1", 0, "tool_2"), ("c1", 0, "tool_3"), ("c1", 1, "edit")]


def test_messages_of_two_providers(spark):
    data = [{"modelID": "m", "providerID": "anthropic", "tokens": {"input": 5, "output": 2, "reasoning": 3, "cache": {"read": 1, "write": "x"}}}, {"model": {"id": "n", "providerID": "router"}}]
    rows = spark.createDataFrame([("s", str(k), k, json.dumps(d)) for k, d in enumerate(data)], "session_id string, id string, seq long, data string")
    a, b = N.opencode_messages(rows).orderBy("seq").collect()
    assert (a["provider_state"], a["provider"], a["usage"]["output"], a["usage"]["total"]) == ("direct", "anthropic", 5, 11)
    assert (b["provider_state"], b["provider"], b["usage"], b["model"]) == ("blocked", None, None, "n")


def test_price_book(spark, tmp_path):
    book = {"vendor": "v", "models": {"m": {"price_history": [{"input": 0.003625, "output": 5, "input_cached": 0.5, "from_date": "2026-01-01", "to_date": None, "context_tiers": [{"above_input_tokens": 272000, "input": 10.0, "output": 45}]}]}}}
    (tmp_path / "v.json").write_text(json.dumps(book))
    (tmp_path / "bad.json").write_text("{")
    r = read_prices(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0]["r_in"], r[0]["r_out"], r[0]["r_cached"], r[0]["r_write"]) == (3625, 5_000_000, 500_000, None)
    assert r[0]["tiers"][0]["above"] == 272000 and r[0]["tiers"][0]["r_in"] == 10_000_000 and r[0]["tiers"][0]["r_cached"] is None


def test_upsert_keeps_the_best_snapshot(spark, tmp_path):
    src = tmp_path / "in"
    schema = f"id string, line_no long, usage {N.USAGE}, valid boolean"
    row = lambda i, n, out, valid=True: (i, n, (1, out, 0, 0, None, None, 1 + out), valid)
    batches = [[row("a", 1, 5), row("b", 2, 1, False)], [row("a", 3, 5), row("a", 4, 4)], [row("b", 5, 0), row("c", 6, 1)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
        S.upsert_snapshots(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "ck"), ["id"]).awaitTermination()
    got = {r["id"]: (r["line_no"], r["usage"]["output"], r["valid"]) for r in S.latest_state(spark, str(tmp_path / "out"), ["id"]).collect()}
    assert got == {"a": (3, 5, True), "b": (5, 0, True), "c": (6, 1, True)}


def test_upsert_writes_changes_and_compacts(spark, tmp_path):
    src, out, schema = tmp_path / "in", tmp_path / "out", f"id string, line_no long, usage {N.USAGE}, valid boolean"
    assert S.latest_state(spark, str(out), ["id"]) is None
    for n in range(7):
        rows = [(f"k{n % 3}", n, (1, n, 0, 0, None, None, 1 + n), True), (f"new{n}", n, (1, 1, 0, 0, None, None, 2), True)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        S.upsert_snapshots(spark.readStream.schema(schema).parquet(str(src)), str(out), str(tmp_path / "ck"), ["id"], compact=2).awaitTermination()
        got = {r["id"]: r["usage"]["output"] for r in S.latest_state(spark, str(out), ["id"]).collect()}
        assert got == {f"new{k}": 1 for k in range(n + 1)} | {f"k{k % 3}": k for k in range(n + 1)}
    assert {int(p.name[1:]) for p in out.glob("v*")} == {3, 4, 5, 6}  # two whole states, and what changed since
    assert spark.read.parquet(str(out / "v6")).count() == 2  # a batch writes its own keys only
    (out / "_versions" / "part-broken.json").write_text("")
    (out / "v6").rename(out / "gone")
    with pytest.raises(Exception, match="v6"):
        S.latest_state(spark, str(out), ["id"]).collect()


def test_last_reading_survives_a_restart(spark, tmp_path):
    """Readings of three batches, a new query each; results as from all at once."""
    from tallyflow.operators.windows import cap_crossing

    schema, m = "account string, observed_ms long, used double, resets_ms long", 60_000
    batches = [[("a", 0, 40.0, 10**9), ("b", 0, 10.0, 10**9)], [("a", m, 50.0, 10**9), ("a", 2 * m, 55.0, 10**9)], [("b", 3 * m, 12.0, 10**9), ("a", 3 * m, 54.0, 10**9), ("c", 0, 1.0, 10**9)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = S.crossings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    key = lambda df: sorted(map(tuple, df.select("account", "observed_ms", "used", "resets_ms", "crossing_ms").collect()))
    want = key(cap_crossing(spark.createDataFrame([r for b in batches for r in b], schema), "account"))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want and sum(r[4] is not None for r in want) == 3


def test_windowed_usage_as_a_stream(spark, tmp_path):
    rows = [("m", 1_700_000_000_000 + k * 3_600_000, k, 2) for k in range(50)]
    frame(spark, rows, "model string, ts_ms long, total long, pico decimal(38,0)").write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    q = S.windowed_usage(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), size="1 day").writeStream.format("memory").queryName("usage_stream").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("usage_stream")) == key(S.windowed_usage(table, size="1 day"))


def test_turns_need_something_in_them(spark):
    rows = spark.createDataFrame([("c", k, r) for k, r in enumerate("aUUaaUa")], "file string, line_no long, role string")
    got = [(r["line_no"], r["turn_index"]) for r in N.segment_turns(rows, F.col("role") == "U").orderBy("line_no").collect()]
    assert got == [(0, 0), (3, 1), (4, 1), (6, 2)]


@pytest.mark.parametrize(("session", "items", "state"), [((5, 5), (5, 5), "equal"), ((6, 5), (5, 5), "residual"), ((4, 5), (5, 5), "items"), ((6, 4), (5, 5), "conflicting")])
def test_reconcile(spark, session, items, state):
    side = lambda x: spark.createDataFrame([("s", *x)], "session_id string, input long, output long")
    r = N.reconcile_aggregate(side(session), side(items), ("input", "output")).first()
    assert r["state"] == state and r["rest_input"] == (1 if state == "residual" else 0)


def test_sessions_stream_in_order(spark):
    """A session longer than a batch, with others beside it, and no group of all its rows."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        log = spark.range(300).selectExpr("concat('f', cast(id % 3 as string)) file", "299 - id line_no", "if(id = 0, '{\"$rewindTo\": \"m98\"}', concat('{\"id\": \"m', cast((299 - id) div 3 as string), '\"}')) line")
        left = N.replay(log)
        got = {(r["file"], r["place"], r["id"]) for r in left.collect()}
        assert got == {(f"f{f}", k, f"m{k}") for f in range(3) for k in range(98 if f == 0 else 100)}
        marks = spark.range(300).selectExpr("concat('f', cast(id % 3 as string)) file", "299 - id line_no", "if(id div 3 % 2 = 0, 'a', 'b') form", "0L turn_index", "id ts_ms")
        events = N.pair_compactions(marks)
        assert sorted(r["ts_ms"] for r in events.collect()) == [k for k in range(300) if k // 3 % 2 == 1]
        for df in (left, events):
            assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_billed_requests(spark):
    columns = "file string, line_no int, input long, output long, cache_read long, last_input long, last_output long, last_cache_read long"
    rows = [
        ("inherited", 1, 100, 20, 5, 10, 2, 0), ("inherited", 2, 100, 20, 5, 10, 2, 0), ("inherited", 3, 130, 25, 5, 30, 5, 0),
        ("no first report", 1, 100, 20, 5, None, None, None), ("no first report", 2, 130, 25, 5, 30, 5, 0),
        ("falls", 1, 10, 2, 0, 10, 2, 0), ("falls", 2, 5, 3, 0, 5, 3, 0), ("other report", 1, 10, 2, 0, 10, 2, 0), ("other report", 2, 30, 4, 0, 19, 2, 0), ("above total", 1, 10, 2, 0, 11, 2, 0),
    ]
    got = N.requests(spark.createDataFrame(rows, columns)).collect()
    seen = {(r["file"], r["line_no"]): (r["d_input"], r["d_output"], r["base_input"], r["consistent"]) for r in got}
    assert seen["inherited", 1] == (10, 2, 90, True) and seen["inherited", 3] == (30, 5, 90, True) and ("inherited", 2) not in seen
    assert not any(ok for (f, _), (*_, ok) in seen.items() if f != "inherited")
    assert {r["file"]: r["over_input"] for r in got} == {"inherited": 40, "no first report": 130, "falls": 10, "other report": 30, "above total": 11}
    assert N.requests(spark.createDataFrame([], columns)).count() == 0
