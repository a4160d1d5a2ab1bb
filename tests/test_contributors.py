"""Contributors by each kind of evidence, in any order of sessions."""

import random

from tallyflow.operators import contributors as C

SHA = {k: f"{k}{k}{k}{k}{k}{k}{k}{k}" + "0" * 32 for k in "abcdef"}


def run(spark, sessions, subjects, patches, order):
    """``sessions``: id -> (source, pool, in_worktree, loaded, degraded, [(command, output), ...])."""
    names = list(sessions)
    random.Random(order).shuffle(names)
    cand = spark.createDataFrame([(s, *sessions[s][:5], len(sessions[s][5])) for s in names], "session_id string, source string, pool string, in_worktree boolean, loaded boolean, degraded boolean, turn_count long")
    rows = [(s, k, k, True, c, o) for s in names for k, (c, o) in enumerate(sessions[s][5])]
    calls = spark.createDataFrame(rows, "session_id string, turn_index long, call_ord long, is_shell boolean, input_json string, output string")
    commits = spark.createDataFrame([(SHA[k], t) for k, t in subjects.items()], "sha string, subject string")
    found = C.contributors(cand, calls, commits, spark.createDataFrame(patches, "run string, patch_id string"))
    return {r["session_id"]: (r["basis"], r["event"], r["kind"]) for r in found.collect()}, found, calls


def test_every_kind_of_evidence(spark):
    commit = lambda sha, text="m": (f'git commit -m "{text}"', f"[f {sha}] {text}")
    quiet = lambda text: (f'git commit -q -m "{text}"', "")
    here, far = ("repo", True, True, False), ("anchor", False, True, False)
    sessions = {
        "direct": ("x", *here, [commit("aaaaaaa")]), "pushed": ("x", *far, [("git push", " 1111111..aaaaaaa  f -> f")]), "amended": ("x", *here, [commit("1234567")]), "thief": ("x", *here, [commit("7654321")]),
        "helper": ("codex", *here, [("ls", "")]), "far helper": ("codex", *far, [("ls", "")]), "named": ("x", *here, [quiet("a subject long enough")]), "two names": ("x", *here, [quiet("the fifth subject, long"), quiet("the sixth subject, long")]),
        "elsewhere": ("x", *here, [quiet("the fifth subject, long"), commit("9999999")]), "short": ("x", *here, [quiet("tiny")]), "nothing": ("x", *here, [("ls", "")]), "far nothing": ("x", *far, [quiet("nobody has this one")]),
        "unread": ("x", "repo", True, False, False, []), "degraded": ("x", "repo", True, False, True, []), "claimed": ("x", *here, [quiet("what the first commit says")]),
    }
    subjects = {"a": "what the first commit says", "b": "recovered by its patch", "c": "a subject long enough", "d": "tiny", "e": "the fifth subject, long", "f": "the sixth subject, long"}
    patches = [(SHA["a"], "p1"), (SHA["b"], "p2"), ("1234567", "p2"), ("7654321", "p1")]
    want = {
        "direct": ("anchor", None, "slice"), "pushed": (None, "unattributable-anchor-pool", None), "amended": ("anchor", None, "slice"), "thief": (None, "unanchored-git-write", None), "helper": ("helper", None, "full"), "far helper": (None, None, None), "named": ("message", None, "full"),
        "two names": (None, "unanchored-git-write", None), "elsewhere": (None, "unanchored-git-write", None), "short": (None, "unanchored-git-write", None), "nothing": (None, "silenced-git-write", None), "far nothing": (None, None, None), "unread": (None, "silenced-git-write", None),
        "degraded": (None, "unreadable-session", None), "claimed": (None, "unanchored-git-write", None),
    }
    for order in (1, 2):
        got, found, _ = run(spark, sessions, subjects, patches, order)
        assert got == want
    assert C.excluded_count(found).first()[0] == 7
    explicit = spark.createDataFrame([("thief", "full", 0, 0), ("thief", "full", 0, 0), ("named", "full", 0, 9), ("new", "slice", 2, 3)], "session_id string, kind string, start_turn long, end_turn long")
    both = {r["session_id"]: (r["basis"], r["event"], r["kind"], r["end_turn"]) for r in C.with_explicit(found, explicit).collect()}
    assert both["thief"] == ("anchor", None, "full", 0) and both["named"] == ("anchor", None, "full", 0) and both["new"] == ("anchor", None, "slice", 3) and len(both) == len(want) + 1


def test_roles_and_nested(spark):
    c = spark.createDataFrame([("a", "codex"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "x")], "session_id string, source string")
    calls = spark.createDataFrame([("b", "Task", None), ("c", "Bash", '{"command": "cd x && codex --json exec \\"y\\""}'), ("d", "Bash", "echo codex exec; codex login exec"), ("a", "Agent", None)], "session_id string, name string, input_json string")
    roles = {r["session_id"]: r["role"] for r in C.roles(c, calls, spark.createDataFrame([("e",)], "parent_id string")).collect()}
    assert roles == {"a": "codex", "b": "orchestrator", "c": "orchestrator", "d": "builder", "e": "orchestrator"}
    parents = spark.createDataFrame([("p", "/l/p.jsonl"), ("q", "/l/q.jsonl")], "session_id string, file string")
    files = ["/l/p/subagents/agent-1.jsonl", "/l/p/subagents/agent-1/subagents/agent-2.jsonl", "/l/p/subagents/note.jsonl", "/l/p/agent-3.jsonl", *(f"/l/q/subagents/agent-{k:03}.jsonl" for k in range(205))]
    got = C.nested_candidates(parents, spark.createDataFrame([(f,) for f in files], "file string")).collect()
    assert [r["agent_id"] for r in got if r["parent_id"] == "p"] == ["1"] and max(r["agent_id"] for r in got) == "199" and len(got) == 201


def test_command_lines_are_cut_once(spark):
    # a stage with several uses is stored, so the answer's plan cuts no command line and isn't planned from the calls again
    sessions = {"a": ("x", "repo", True, True, False, [('git commit -m "m"', "[f aaaaaaa] m")]), "b": ("codex", "repo", True, True, False, [("ls", "")])}
    got, found, calls = run(spark, sessions, {"a": "what the first commit says"}, [(SHA["a"], "p1")], 1)
    assert got == {"a": ("anchor", None, "slice"), "b": ("helper", None, "full")}
    assert "ArrowEvalPython" in C.G.git_commands(calls)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
