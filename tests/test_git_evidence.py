"""Command lines, verbs, push classes and output lines against plain loops over random words."""

import random
import re

from pyspark.sql import functions as F

from tallyflow.functions import shell
from tallyflow.operators import git_evidence as G
from tallyflow.plans import git_work


def read(line):
    """A command line, character by character."""
    out, words, word, i = [], [], None, 0
    while i < len(line):
        c = line[i]
        if c in "'\"":
            word, i = word or "", i + 1
            while i < len(line) and line[i] != c:
                i += c == '"' and line[i] == "\\" and i + 1 < len(line)
                word, i = word + line[i], i + 1
        elif c == "\\" and i + 1 < len(line):
            word, i = (word or "") + line[i + 1], i + 1
        elif line[i : i + 2] in ("&&", "||") or c in ";|\n" or c in " \t\r":
            words += [] if word is None else [word]
            word = None
            if c not in " \t\r":
                i += line[i : i + 2] in ("&&", "||")
                out, words = out + ([words] if words else []), []
        else:
            word = (word or "") + c
        i += 1
    words += [] if word is None else [word]
    return out + ([words] if words else [])


def test_lines_by_character():
    rng = random.Random(1)
    for _ in range(40_000):
        line = "".join(rng.choice("ab '\"\\&|;\n\t-\r") for _ in range(rng.randrange(14)))
        assert shell.commands(line) == read(line), line
    assert len(shell.commands('"' + 'a\\"' * 200_000)) == 1  # very long, open to the end


def test_wrappers_and_inputs():
    assert shell.invoked('{"command": "git add -A && git commit -m \'a b\'"}') == [["git", "add", "-A"], ["git", "commit", "-m", "a b"]]
    assert shell.invoked('{"command": null, "cmd": "git push"}') == [["git", "push"]]
    assert shell.invoked('{"command": ["codex", "exec", "fix it and then git push"]}') == [["codex", "exec", "fix it and then git push"]]
    assert shell.invoked('codex exec "x && git push"') == [["codex", "exec", "x && git push"]]
    assert shell.invoked("bash -lc 'git push; ls'") == [["git", "push"], ["ls"]] and shell.invoked("bash script.sh -c") == [["bash", "script.sh", "-c"]]
    nested = "git push"
    for depth in range(1, 6):
        nested = "sh -c '" + nested.replace("'", "'\\''") + "'"
        assert (shell.invoked(nested) == [["git", "push"]]) == (depth <= 4)
    for odd in (None, "", "null", "3", '{"command": ["a", 3]}', '{"command": {}}', "{}", '["a", "b", 1]'):
        assert shell.invoked(odd) in ([], [["3"]]), odd


def git(argv):
    i = 0
    while i < len(argv) and re.match(r"[A-Za-z_][A-Za-z0-9_]*=", argv[i]):
        i += 1
    if i == len(argv) or argv[i].rstrip("/").split("/")[-1] != "git":
        return None
    away, i = False, i + 1
    while i < len(argv) and argv[i].startswith("-"):
        away |= argv[i] in G.RETARGETING or bool(re.match("--(git-dir|work-tree|namespace|exec-path)=", argv[i]))
        if argv[i] in G.GLOBAL_WITH_VALUE:
            i += 1
            away |= i < len(argv) and (argv[i] in G.RETARGETING or bool(re.match("--(git-dir|work-tree|namespace|exec-path)=", argv[i])))
        i += 1
    return (argv[i] if i < len(argv) else None, argv[i + 1 :], away)


def push(argv):
    found = git(argv)
    if found is None:
        return "not-git"
    sub, args, away = found
    if sub != "push":
        return "not-push"
    if away:
        return "retargeted"
    options, words, remote, bad, plain, i = set(), [], None, False, False, 0
    while i < len(args):
        w = args[i]
        if plain or w == "-" or not w.startswith("-"):
            words.append(w)
        elif w == "--":
            plain = True
        elif w == "--repo" or w.startswith("--repo="):
            if w == "--repo":
                i += 1
                remote = args[i] if i < len(args) else ""
            else:
                remote = w[7:]
            bad |= not remote
        elif w in G.PUSH_WITH_VALUE:
            i += 1
            bad |= i >= len(args)
        elif w.startswith("--"):
            if not re.match("--(receive-pack|exec|push-option|recurse-submodules|signed|force-with-lease)=", w):
                options.add(w)
                bad |= w not in G.PUSH_PLAIN
        else:
            for k, c in enumerate(w[1:], 1):
                if c == "o":
                    if k == len(w) - 1:
                        i += 1
                        bad |= i >= len(args)
                    break
                options |= {"n": {"--dry-run"}, "d": {"--delete"}}.get(c, set())
                if c not in "nduqvf46":
                    bad = True
                    break
        i += 1
    if remote is None and words:
        remote, words = words[0], words[1:]
    for holds, reason in ((bad, "ambiguous"), ("--dry-run" in options, "dry-run"), ("--delete" in options, "delete"), ("--mirror" in options, "mirror"), ("--all" in options, "all"), (remote not in (None, "origin"), "non-origin")):
        if holds:
            return reason
    if not words:
        return "tags-only" if "--tags" in options else "prune-only" if "--prune" in options else None
    if len(words) > 1:
        return "ambiguous-refspecs"
    spec = words[0].removeprefix("+")
    source, colon, target = spec.partition(":")
    if (target if colon else spec).startswith(G.RECEIPT_REFS):
        return "receipts-ref"
    if colon:
        good = source == "HEAD" and target.startswith("refs/heads/") and len(target) > 11
    elif spec.startswith("refs/heads/"):
        good = len(spec) > 11
    else:
        good = spec == "HEAD" or not (spec == "" or spec[0] == "-" or "*" in spec or spec == "tag" or spec.startswith("refs/tags/") or re.fullmatch("[0-9a-fA-F]{7,40}", spec))
    return None if good else "not-branch-refspec"


def test_push_classes_of_random_words(spark):
    rng = random.Random(5)
    before = ["git", "git", "git", "/usr/bin/git", "A=b", "-C", "-c", "/x", "--git-dir=/r", "--no-pager", "echo", "push"]
    after = ["origin", "origin", "feat", "HEAD", "HEAD:refs/heads/x", "HEAD:refs/heads/", "+feat", "a:b", ":a", "tag", "deadbeef", "refs/heads/x", "refs/tags/v", "refs/receipts/a", "HEAD:refs/aireceipts/b", "a*", "", "-", "--", "--repo", "--repo=", "--repo=origin", "-o", "-qo", "-ox", "-un", "-d", "-fx", "-q", "--tags", "--prune", "--all", "--mirror", "--exec", "--exec=x", "--signed=1", "--force", "--force-with-lease=a", "--what", "upstream"]
    rows = [["git"] * (rng.random() < 0.8) + [rng.choice(before) for _ in range(rng.randrange(3))] + ["push"] * (rng.random() < 0.9) + [rng.choice(after) for _ in range(rng.randrange(5))] for _ in range(6000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, argv array<string>").select("i", F.expr(G.git_call("argv")).alias("git"))
    df = df.withColumn("push", G.push_args("git.args"))
    got = {r["i"]: (r["git"], r["reason"]) for r in df.select("i", "git", G.push_class("git", "push").alias("reason")).collect()}
    for i, argv in enumerate(rows):
        found, reason = got[i]
        assert (found and (found["sub"], found["args"], found["retargeted"])) == git(argv), argv
        assert reason == push(argv), argv
    assert len({r for _, r in got.values()}) == 15  # every reason, and none
    assert all(push(shell.invoked(line)[0]) == reason for line, reason in git_work.PUSHES)


def test_what_moves_head(spark):
    yes = ["switch main", "pull", "checkout main", "checkout --", "checkout --ours", "reset --hard a b", "reset HEAD", "rebase main", "am x", "cherry-pick a", "revert a", "merge x", "bisect start", "stash branch x", "update-ref HEAD a", "update-ref -d refs/heads/x", "update-ref --stdin", "symbolic-ref HEAD x", "symbolic-ref --delete HEAD", "fetch --update-head-ok", "filter-branch"]
    no = ["commit -m x", "status", "checkout -- a", "checkout -p", "checkout --theirs a", "reset HEAD a", "reset -p", "reset --pathspec-from-file=x", "rebase --show-current-patch", "cherry-pick -n a", "merge --squash x", "bisect", "bisect -x log", "stash", "stash pop", "update-ref refs/tags/x a", "update-ref HEAD", "symbolic-ref HEAD", "fetch", ""]
    df = spark.createDataFrame([(line, ["git", *line.split()]) for line in yes + no], "line string, argv array<string>")
    got = {r["line"]: r["b"] for r in df.select("line", F.expr(G.git_call("argv")).alias("git")).select("line", G.moves_head("git").alias("b")).collect()}
    assert got == {line: line in yes for line in yes + no}


def test_output_lines_and_ambiguous_writes(spark):
    a, b = "a1b2c3d", "0123456789"
    rows = [
        (1, "git commit -m x && git log", f" [feat {a}] x\r\n{b} old\n[x {a.upper()}] no\n[a] {b}", [[a], []]),
        (2, "git commit -m x; git commit -m y", f"[feat {a}] x", [[], []]),
        (3, "git commit -m x; git commit -m y", f"[feat {a}] x\n[main (root-commit) {b}] y", [[a], [b]]),
        (4, "git push", f" {b}..{a}  feat -> feat\n + {a}...{b} x -> x (forced update)\n * [new branch] z -> z\n{a}..{b} in a log\n{a} -> main", [[a, b, a]]),
        (5, "git push; git push", f" {b}..{a}  feat -> feat", [[], []]),
        (6, "echo git commit", f"[feat {a}] x", []),
        (7, "git commit -m x", None, [[]]),
    ]
    calls = spark.createDataFrame([("s", 0, i, True, c, o) for i, c, o, _ in rows] + [("s", 0, 99, False, "git push", rows[3][2])], "session_id string, turn_index long, call_ord long, is_shell boolean, input_json string, output string")
    got = {}
    for r in G.git_commands(calls).orderBy("call_ord", "inv_ord").collect():
        got.setdefault(r["call_ord"], []).append(list(r["runs"]))
    assert got == {i: runs for i, _, _, runs in rows if runs}


def test_chains_end_at_barriers_and_unproven_commits(spark):
    def chains(*steps):
        shas = ["%07x" % (k + 0xABCDE00) for k in range(len(steps))]
        calls = [("s", k, k, True, s.rstrip("!"), "" if s.endswith("!") else f"[f {shas[k]}] m") for k, s in enumerate(steps)]
        df = spark.createDataFrame(calls, "session_id string, turn_index long, call_ord long, is_shell boolean, input_json string, output string")
        commits = spark.createDataFrame([(shas[-1] + "0" * 33,)], "sha string")
        found = G.anchors(G.owned(G.git_commands(df), commits))
        return sorted((r["first_turn"], r["n_commits"], r["own"]) for r in G.amend_chains(found).collect()), found

    c, m = "git commit -m x", "git commit --amend"
    assert chains(c, m, m)[0] == [(0, 3, True)]
    assert chains(c, "git checkout x", m)[0] == [(0, 1, False), (2, 1, True)]
    assert chains(c, "git checkout -- x", "git push!", m)[0] == [(0, 2, True)]
    assert chains(c, m + "!", m)[0] == [(0, 1, False), (2, 1, True)]
    assert chains(c, c, m, c)[0] == [(0, 1, False), (1, 2, False), (3, 1, True)]
    _, found = chains(c, c, m)
    sessions = spark.createDataFrame([("s", 3), ("t", 5), ("u", 0)], "session_id string, turn_count long")
    got = {r["session_id"]: (r["kind"], r["start_turn"], r["end_turn"]) for r in G.scopes(found, sessions).collect()}
    assert got == {"s": ("slice", 1, 2), "t": ("full", 0, 4), "u": ("full", 0, 0)}
