"""Windows, budgets, ranking, and branch attribution at their edges."""

from pyspark.sql import functions as F

from frames import frame

from tallyflow.operators import branch as B
from tallyflow.operators import windows as V

S = "session_id string, started_ms long, ended_ms long, tokens long, pico decimal(38,0), unpriced_tokens long, is_sidechain boolean, parent_id string, title string"
NOW = 1_700_000_000_000


def sessions(spark, *rows):
    return frame(spark, [(f"s{k}", r.get("start", r.get("end")), r.get("end"), r.get("tokens", 1), r.get("pico"), r.get("unpriced", 0), r.get("side", False), r.get("parent"), r.get("title", f"T{k}")) for k, r in enumerate(rows)], S)


def test_weeks_are_half_open(spark):
    w = V.WEEK_MS
    s = sessions(spark, *[{"end": NOW - d} for d in (0, 1, w, w + 1, 2 * w, 2 * w + 1)], {"end": None})
    assert {r["session_id"]: r["window_label"] for r in V.label_weeks(s, NOW).collect()} == {"s1": "current", "s2": "current", "s3": "prior", "s4": "prior"}


def test_delta_is_null_if_a_side_is_unpriced(spark):
    s = sessions(spark, {"end": NOW - 1, "pico": 5, "tokens": 3}, {"end": NOW - V.WEEK_MS - 1, "tokens": 10})
    r = V.week_delta(V.window_totals(V.label_weeks(s, NOW))).first()
    assert (r["delta_pico"], r["delta_tokens"]) == (None, -7)


def test_budget_at_its_cap_is_not_exceeded(spark):
    s = sessions(spark, {"end": NOW - 1, "pico": 70, "tokens": 5}, {"end": NOW - 2, "pico": 30, "unpriced": 1}, {"end": NOW - 3, "tokens": 0})
    caps = spark.createDataFrame([("weekly", "usd", 100), ("weekly", "usd", 99), ("daily", "tokens", 10**9)], "period string, unit string, cap long")
    got = {(r["period"], r["cap"]): (int(r["used"]), r["exceeded"], r["n_full"], r["n_partial"], r["n_excluded"]) for r in V.budgets(s, caps, NOW).collect()}
    assert got["weekly", 100] == (100, False, 1, 1, 1) and got["weekly", 99][1] is True


def test_aggregatable_and_top_level(spark):
    s = sessions(spark, {"end": 1, "tokens": 0}, {"end": 1, "side": True}, {"end": 1, "parent": "s0"}, {"end": 1})
    assert [r["session_id"] for r in V.top_level(V.aggregatable(s.withColumn("degraded", F.col("session_id") == "s0"))).orderBy("session_id").collect()] == ["s0", "s3"]
    assert V.aggregatable(s.withColumn("degraded", F.lit(False))).count() == 3


def test_selectors(spark):
    s = sessions(spark, {"end": 3, "title": "Fix Bug"}, {"end": 9}, {"end": None, "start": 5, "title": "fix bugs"})
    pick = lambda q: [r["session_id"] for r in V.select_session(s, q).collect()]
    assert pick("") == ["s1"] and pick("1") == ["s1"] and pick("3") == ["s0"] and pick("4") == [] and pick("0") == []
    assert pick("FIX") == ["s2"] and pick("s0") == ["s0"] and pick("none") == []


def test_recurrence_and_headline(spark):
    f = frame(spark, [("a", "x", 5, 1, [1]), ("a", "x", 6, 1, [2]), ("b", "x", None, 9, [1]), ("c", "y", 3, 1, [1]), ("a", "y", 8, 1, [2])], "session_id string, kind string, pico decimal(38,0), tokens long, turns array<long>")
    rules = spark.createDataFrame([("x", "r"), ("z", "q")], "kind string, rule string")
    assert V.recurrence(f, rules, 3).count() == 0 and V.recurrence(f, rules, 2).first()["n_sessions"] == 2
    head = {r["session_id"]: (r["kind"], r["pico"]) for r in V.headline(f).collect()}
    assert head == {"a": ("x", 11), "b": ("x", None), "c": ("y", 3)}
    assert [(r["session_id"], r["n_turns"]) for r in V.overlaps(f, "x", "y").collect()] == [("a", 1)]


def test_commit_band(spark):
    b = B.BAND_MS
    c = spark.createDataFrame([(1000 * b,)], "commit_ms long")
    s = sessions(spark, {"start": 1001 * b, "end": 1002 * b}, {"start": 1001 * b + 1, "end": 1002 * b}, {"start": 10 * b, "end": 999 * b}, {"start": 10 * b, "end": 999 * b - 1}, {"start": 1, "end": 5000 * b})
    assert sorted(r["session_id"] for r in B.in_commit_window(s, c).collect()) == ["s0", "s2", "s4"]


def test_sha_prefixes(spark):
    c = spark.createDataFrame([("abcdef0123456789",), ("abcdef0199999999",)], "sha string")
    runs = spark.createDataFrame([("ABCDEF012",), ("abcdef01",), ("abcdef",), ("1234567",)], "run string")
    assert {r["run"]: (r["n_matches"], r["sha"]) for r in B.resolve_shas(runs, c).collect()} == {"ABCDEF012": (1, "abcdef0123456789"), "abcdef01": (2, None), "abcdef": (0, None), "1234567": (0, None)}


def test_children(spark):
    p = sessions(spark, {"start": 10, "end": 20, "pico": 5})
    kids = frame(spark, [("k1", 20, 30, 2, None), ("k2", 21, 30, 1, 7), ("k3", None, 10, 1, 4), ("k4", None, None, 1, 1)], "session_id string, started_ms long, ended_ms long, tokens long, pico decimal(38,0)").withColumn("parent_id", F.lit("s0"))
    r = B.rollup_children(p, kids).first()
    assert (r["n_children"], r["children_pico"], r["children_tokens"], r["combined_pico"]) == (2, 4, 3, 9)
    assert B.rollup_children(p, kids, kids.where("session_id = 'k3'")).first()["n_children"] == 1


def test_slices_and_segments(spark):
    t = frame(spark, [("s", k, 10, 1, 0) for k in range(6)] + [("f", 0, 1, 1, 0)], "session_id string, turn_index long, total long, pico decimal(38,0), unpriced_tokens long")
    a = spark.createDataFrame([("s", 1, "x", 5), ("s", 3, "o1", 6), ("s", 4, "o2", 7), ("f", 0, "o1", 9)], "session_id string, turn_index long, sha string, ts_ms long")
    got = B.reindex(B.slices(a.where("session_id = 's'"), t, F.col("sha").startswith("o")))
    assert [(r["session_id"], r["turn_index"], r["label"], r["new_index"]) for r in got.orderBy("session_id", "turn_index").collect()] == [("f", 0, "full", 0), ("s", 2, "slice", 0), ("s", 3, "slice", 1), ("s", 4, "slice", 2)]
    seg = {r["sha"]: (r["n_turns"], r["tokens"]) for r in B.commit_segments(t, a).collect()}
    assert seg == {"x": (2, 20), "o1": (2, 20), "o2": (2, 20)}


def test_patches_subjects_and_promotion(spark):
    side = lambda *r: spark.createDataFrame(list(r), "sha string, patch_id string")
    assert [tuple(r) for r in B.recover_by_patch(side(("a", "1"), ("b", "2"), ("c", "2")), side(("x", "1"), ("y", "2"))).collect()] == [("1", "a", "x")]
    commits = spark.createDataFrame([("c1", "a long subject"), ("c2", "short"), ("c3", "said by two of us"), ("c4", "claimed already")], "sha string, subject string")
    said = spark.createDataFrame([("s1", "a long subject"), ("s1", "short"), ("s1", "said by two of us"), ("s2", "said by two of us"), ("s2", "claimed already")], "session_id string, subject string")
    assert [tuple(r) for r in B.match_subjects(said, commits, commits.where("sha = 'c4'")).collect()] == [("s1", "c1")]
    kids = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k3", "p2")], "session_id string, parent_id string")
    assert [r["session_id"] for r in B.promote(kids, kids.where("session_id = 'k3'"), spark.createDataFrame([("p1",)], "session_id string")).collect()] == ["k2"]


def test_tool_order(spark):
    from tallyflow.operators.attribution import tool_order

    rows = [("s", "b", 5, 1), ("s", "a", 5, 1), ("s", "c", None, 99), ("s", "g", None, 100), ("s", "d", 5, 2), ("t", "e", None, None), (None, "f", 0, 0)]
    got = tool_order(spark.createDataFrame(rows, "session_id string, tool string, pico long, tokens long"), ["session_id"])
    assert {(r.session_id, r.tool): r["rank"] for r in got.collect()} == {("s", "a"): 1, ("s", "b"): 2, ("s", "d"): 3, ("s", "g"): 4, ("s", "c"): 5, ("t", "e"): 1, (None, "f"): 1}


def test_rows_of_all(spark):
    from tallyflow.operators.attribution import rows_of_all

    units = spark.createDataFrame([("a", "s", 1), ("a", "s", 2), ("a", "t", None), ("x", "s", 9), (None, "s", 9)], "vendor string, session_id string, total long")
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "vendor string")
    assert sorted(map(tuple, rows_of_all(known, units, "vendor").collect())) == [("a", 2, 3, 3), ("b", 0, 0, 0)]
    assert sorted(map(tuple, rows_of_all(known, units.limit(0), "vendor").collect())) == [("a", 0, 0, 0), ("b", 0, 0, 0)]


def test_cap_crossing_guards(spark):
    from tallyflow.operators.windows import cap_crossing

    m, reset = 60_000, 10_000_000
    rows = [("ok", 0, 40, reset), ("ok", m, 50, reset), ("near", 0, 40, reset), ("near", m - 1, 50, reset), ("falls", 0, 50, reset), ("falls", m, 40, reset), ("level", 0, 50, reset), ("level", m, 50, reset), ("window", 0, 40, reset), ("window", m, 50, reset + 1), ("late", 0, 50, 61 * m), ("late", m, 51, 50 * m), ("late reset", 0, 50, 50 * m), ("late reset", m, 51, 50 * m), ("one", 0, 50, reset), ("full", 0, 90, reset), ("full", m, 100, reset)]
    df = spark.createDataFrame([(k, i, *r) for i, (k, *r) in enumerate(rows)] + [("future", 99, m, 40, reset), ("future", 100, 0, 50, reset)], "k string, n int, observed_ms long, used long, resets_ms long")
    got = {r["k"]: r["crossing_ms"] for r in cap_crossing(df, "k", "n").where("crossing_ms is not null").collect()}
    assert got == {"ok": 6 * m, "full": m}
