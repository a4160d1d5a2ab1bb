"""Boundaries of the pattern detectors."""

from pyspark.sql import functions as F

from frames import frame

from tallyflow.operators import detectors as T

CALLS = "session_id string, turn_index long, call_ord long, name string, input_json string, status string, started_ms long, ended_ms long, path string"
TURNS = "session_id string, turn_index long, pico decimal(38,0), complete boolean, input long, output long, cache_read long, cache_creation long, total long"


def calls(spark, names, status=None, paths=None, turn=lambda k: k):
    return spark.createDataFrame([("s", turn(k), k, n, "{}", (status or {}).get(k, "ok"), k * 10, k * 10 + 5, (paths or {}).get(k, "/p")) for k, n in enumerate(names)], CALLS)


def turns(spark, prompts, pico=lambda k: 100, complete=lambda k: True):
    return frame(spark, [("s", k, pico(k), complete(k), p, 0, 0, 0, p) for k, p in enumerate(prompts)], TURNS)


def test_loop_of_two_or_three(spark):
    t = turns(spark, [1] * 9)
    assert T.stuck_loops(calls(spark, "aab"), t).count() == 0
    r = T.stuck_loops(calls(spark, "baaab"), t).collect()
    assert [(x["start_ord"], x["n_calls"], float(x["pico"]), x["wall_ms"], x["turns"]) for x in r] == [(1, 3, 300.0, 25, [1, 2, 3])]


def test_loop_without_a_full_price_has_none(spark):
    assert T.stuck_loops(calls(spark, "aaa"), turns(spark, [1] * 3, complete=lambda k: k != 1)).first()["pico"] is None
    assert T.stuck_loops(calls(spark, "aaa"), turns(spark, [1] * 2)).first()["pico"] is None


def test_loops_compare_canonical_input(spark):
    c = calls(spark, "aaa").withColumn("input_json", F.when(F.col("call_ord") == 1, '{"b": 1, "a": [2]}').otherwise('{"a":[2],"b":1}'))
    assert T.stuck_loops(c, turns(spark, [1] * 3), key=F.col("input_json")).count() == 0 and T.stuck_loops(c, turns(spark, [1] * 3)).count() == 1
    assert T.stuck_loops(c, turns(spark, [1] * 3), key=T.canonical_json(F.col("input_json"))).count() == 1


def test_rereads(spark):
    run = lambda names, **k: [(r["call_ord"], r["before_ord"]) for r in T.rereads(calls(spark, names, **k), "R", ("E",)).orderBy("call_ord").collect()]
    assert run("RxR") == [(2, 0)]
    assert run("RER") == []
    assert run("RRR", status={1: "error"}) == [(2, 0)]
    assert run("RER", paths={1: "/q"}) == [(2, 0)]
    c = calls(spark, "RxR")
    blocked = lambda o, p: spark.createDataFrame([("s", o, p)], "session_id string, call_ord long, path string")
    assert T.rereads(c, "R", ("E",), blocked_by=blocked(1, None)).count() == 0
    assert T.rereads(c, "R", ("E",), blocked_by=blocked(1, "/other")).count() == 1


def thrash(spark, prompts, at):
    t = turns(spark, prompts)
    units = t.drop("pico").withColumn("pico", F.lit(1).cast("decimal(38,0)")).withColumn("cc_5m", F.lit(None).cast("long")).withColumn("cc_1h", F.lit(None).cast("long")).withColumn("rates", F.expr("named_struct('r_in', 2L, 'r_out', 9L, 'r_cached', cast(null as bigint), 'r_write', cast(null as bigint), 'r_write_5m', cast(null as bigint), 'r_write_1h', cast(null as bigint))"))
    c = spark.createDataFrame([("s", k) for k in at], "session_id string, turn_index long")
    return T.context_thrash(t, c, units).collect()


def test_refill_ratio_and_reach(spark):
    hit = lambda prompts, at: [r["turn_index"] for r in T.refills(turns(spark, prompts), spark.createDataFrame([("s", k) for k in at], "session_id string, turn_index long")).orderBy("turn_index").collect()]
    assert hit([1000, 800], [1]) == [1] and hit([1000, 799], [1]) == []
    assert hit([1000, 0, 0, 0, 0, 800], [1]) == [1] and hit([1000, 0, 0, 0, 0, 0, 800], [1]) == []
    assert hit([0, 5], [1]) == [] and hit([1000, 900], [2]) == [] and hit([1000, 900], [0]) == []


def test_gap_and_union_of_slices(spark):
    p = [1000] * 60
    assert len(thrash(spark, p, [1, 27])) == 0
    r = thrash(spark, p, [1, 26])
    assert [(x["n_compactions"], x["turn_span"], x["n_turns"], x["pico"]) for x in r] == [(2, 25, 5, 5 * 1000 * 2)]
    assert thrash(spark, p, [1, 4, 6])[0]["n_turns"] == 7
    assert len(thrash(spark, p, [1])) == 0


def test_trivial_output_bound(spark):
    rates = "named_struct('r_in', {0}L, 'r_out', 1L, 'r_cached', cast(null as bigint), 'r_write', cast(null as bigint), 'r_write_5m', cast(null as bigint), 'r_write_1h', cast(null as bigint), 'tiers', cast(array() as array<struct<above: bigint, r_in: bigint, r_out: bigint, r_cached: bigint, r_write: bigint, r_write_5m: bigint, r_write_1h: bigint>>))"
    u = spark.createDataFrame([("s", 0, 10, 120), ("s", 1, 10, 121), ("s", 2, 10, 5)], "session_id string, turn_index long, input long, output long")
    u = u.withColumns({"cache_read": F.lit(0).cast("long"), "cache_creation": F.lit(0).cast("long"), "cc_5m": F.lit(None).cast("long"), "cc_1h": F.lit(None).cast("long"), "total": F.col("input") + F.col("output"), "vendor": F.lit("v"), "price": F.expr(rates.format(5)), "pico": F.lit(7).cast("decimal(38,0)")})
    cheap = spark.range(1).select(F.lit("v").alias("vendor"), F.expr(rates.format(2)).alias("cheapest"))
    r = T.trivial_spans(u, calls(spark, "xxa").where("call_ord = 2"), cheap).collect()
    assert [(x["turns"], x["pico"], x["cheapest_pico"]) for x in r] == [([0], 7, 10 * 2 + 120)]
    assert T.trivial_spans(u, calls(spark, "x").limit(0), cheap.withColumn("cheapest", F.expr(rates.format(5)))).count() == 0


def test_cost_shape(spark):
    t = turns(spark, [1] * 4, pico=lambda k: [10, 20, 30, 60][k])
    edit = lambda *k: spark.createDataFrame([("s", x) for x in k], "session_id string, turn_index long")
    r = T.cost_shape(t, edit(2, 3)).first()
    assert (r["pre_edit_pico"], r["top3_pico"], r["late_ratio"]) == (30, 110, 3.0)
    assert T.cost_shape(t, edit(0)).first()["pre_edit_pico"] == 0
    assert T.cost_shape(t, edit(0).limit(0)).first()["pre_edit_pico"] is None
    assert T.cost_shape(turns(spark, [1] * 3), edit(0)).first()["late_ratio"] is None
    assert T.cost_shape(turns(spark, [1] * 4, complete=lambda k: k > 0), edit(0)).count() == 0


def test_same_file_rereads(spark):
    import json

    def run(*steps, compacted=()):
        """Steps are (tool, path or command); a turn each, at 10 tokens and 100 pico; a failed read ends with !."""
        rows = [("s", k, k, t.rstrip("!"), t == "Bash", json.dumps({"command": x} if t == "Bash" else {"notebook_path" if t.startswith("Note") else "file_path": x}), "error" if t.endswith("!") else None) for k, (t, x) in enumerate(steps)]
        c = spark.createDataFrame(rows, "session_id string, turn_index long, call_ord long, name string, is_shell boolean, input_json string, status string")
        t = spark.createDataFrame([("s", k, 100, 10, True) for k in range(len(steps))], "session_id string, turn_index long, pico long, total long, complete boolean")
        at = spark.createDataFrame([("s", k) for k in compacted], "session_id string, turn_index long")
        r = T.same_file_rereads(c, t, at).first()
        return (0, []) if r is None else (r["n_rereads"], r["turns"])

    a, b = ("Read", "src/a.ts"), ("Read", "./src//x/../a.ts/")
    assert run(a, b, a) == (2, [1, 2]) and run(a, ("Read", "test/a.ts")) == (0, []) and run(a, ("Read", "/src/a.ts")) == (0, [])
    assert run(a, ("Edit", "src/a.ts"), b) == (0, []) and run(a, ("Edit", "src/b.ts"), b) == (1, [2]) and run(a, ("Edit", "src/a.ts"), a, a) == (1, [3]) and run(a, ("NotebookEdit", "src/a.ts"), a) == (0, [])
    assert run(a, ("Bash", "cat data.ts"), a) == (0, []) and run(a, ("Bash", "cat b.ts"), a) == (1, [2])  # the name is part of another's
    for cmd in ("git reset --hard", "git stash pop", "git checkout .", "git restore -- . ", "prettier src --write", "find . -exec rm {} +"):
        assert run(a, ("Bash", cmd), a) == (0, []), cmd
    assert run(a, ("Bash", "git checkout README.md"), a) == (1, [2]) and run(a, ("Bash", ""), a) == (1, [2])
    assert run(a, ("Read!", "src/a.ts"), a) == (1, [2]) and run(("Read!", "src/a.ts"), a) == (0, [])
    assert run(a, a, compacted=(1,)) == (0, []) and run(a, a, compacted=(0, 2)) == (1, [1]) and run(a, a, a, compacted=(1,)) == (1, [2])
    assert run(("Read", "Makefile"), ("Bash", "make -f Makefile"), ("Read", "Makefile")) == (0, []) and run(("Read", "a"), ("Bash", "ls b"), ("Read", "a")) == (1, [2])


def test_paths_and_scopes(spark):
    from tallyflow.functions import paths as P
    from tallyflow.operators import scope as S

    folded = {"/a/./b//c/": "/a/b/c", "/repo/../other": "/other", "/..": "/", "/../..//x": "/x", "a/../../b": "../b", "..": "..", "C:\\Dir\\x": "c:/Dir/x", "c:/../O": "c:/O", "D:": "d:", "C:x": "C:x", "//srv/share/": "//srv/share", "//": "/", "": "", ".": "", "/a/b/../../..": "/"}
    df = spark.createDataFrame([(k,) for k in folded] + [(None,)], "p string").select("p", P.fold("p").alias("f"), P.fold_file("p").alias("g"), P.ancestors(P.fold("p")).alias("a"), P.folder_name(P.fold("p")).alias("n"))
    got = {r["p"]: r for r in df.collect()}
    assert {k: r["f"] for k, r in got.items()} == {**folded, None: None}
    assert got["/a/./b//c/"]["a"] == ["/", "/a", "/a/b", "/a/b/c"] and got["//srv/share/"]["a"] == ["/", "//srv", "//srv/share"] and got["c:/../O"]["a"] == ["c:", "c:/O"] and got[""]["a"] == [] and got["//srv/share/"]["n"] == "--srv-share" and got["//srv/share/"]["g"] == "/srv/share"
    sessions = spark.createDataFrame([("root", "/"), ("home", "/home/u/"), ("above", "/home"), ("repo", "/home/u/repo"), ("sub", "/home/u/repo/sub"), ("like", "/home/u/repo2"), ("none", None), ("empty", "")], "session_id string, cwd string")
    asked = spark.createDataFrame([("/home/u/repo/sub/x",), ("/home/u",), ("/home/u/repo/../repo2",), ("",), ("/",)], "request string")
    found = {}
    for r in S.sessions_for(sessions, asked, "/home/u").collect():
        found.setdefault(r["request"], set()).add(r["session_id"])
    assert found == {"/home/u/repo/sub/x": {"repo", "sub"}, "/home/u": {"home"}, "/home/u/repo/../repo2": {"like"}, "/": {"root"}}
    assert {r["name"] for r in S.log_folders(asked.limit(1)).collect()} == {"-", "-home", "-home-u", "-home-u-repo", "-home-u-repo-sub", "-home-u-repo-sub-x"}
    files = spark.createDataFrame([("/l/p/a",), ("/l/p",), ("/l/pq",)], "file string")
    assert [r["file"] for r in S.without_subtrees(files, spark.createDataFrame([("/l/p/",)], "root string")).collect()] == ["/l/pq"]
    kids = {"/l/p/subagents/agent-1.jsonl": ("1", "p", "/l/p.jsonl"), "/l/p/subagents/x/subagents/agent-2.jsonl": ("2", "p", "/l/p.jsonl"), "/l/p/agent-3.jsonl": None, "subagents/agent-4.jsonl": None, "/l/p/subagents/note.jsonl": None, "/subagents/agent-5.jsonl": None}
    df = spark.createDataFrame([(k,) for k in kids], "file string").select("file", P.child_of("file").alias("c"))
    assert {r["file"]: r["c"] and tuple(r["c"]) for r in df.collect()} == kids
