"""Queries of what tool calls did to a repository. Every event is a shell call; its number picks the command and the output.

``COMMANDS`` and ``PUSHES`` state, beside each command, what the rules make of it; the oracles are written from that alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions.shell import invocations
from tallyflow.operators import contributors as C
from tallyflow.operators import git_evidence as G
from tallyflow.plans import derive as D
from tallyflow.plans.derive import SQL

#: (input, output, git commands as (verb or null, amend, barrier, which run it confirms)); {a} and {b} are two SHAs of the event.
COMMANDS = [
    ('{"command": "git add -A && git commit -m \\"change && push; {a}\\""}', "[feat {a}] change\n 1 file changed", [(None, False, False, 0), ("commit", False, False, 1)]),
    ('{"command": "git commit --amend --no-edit"}', "[feat {a}] change", [("commit", True, False, 1)]),
    ('{"command": ["bash", "-lc", "git commit -m x && git log --oneline"]}', "[feat {a}] x\n{b} older\n[not {b} a line", [("commit", False, False, 1), (None, False, False, 0)]),
    ('{"cmd": "git push origin feat"}', "To host\n   {b}..{a}  feat -> feat", [("push", False, False, 1)]),
    ('{"command": "codex exec \\"fix it and then git push origin main\\""}', "   {b}..{a}  main -> main", []),
    ('{"command": "git checkout main"}', "Switched to branch 'main' {a}", [(None, False, True, 0)]),
    ('{"command": "git checkout -- src/a.ts"}', "", [(None, False, False, 0)]),
    ('{"command": "git commit -m a; git commit -m b"}', "[feat {a}] a\nnothing to commit", [("commit", False, False, 0), ("commit", False, False, 0)]),
    ('{"command": "git push && git push --tags"}', "   {b}..{a}  feat -> feat", [("push", False, False, 0), ("push", False, False, 0)]),
    ('{"command": "GIT_EDITOR=true git status | cat"}', "{a} -> x", [(None, False, False, 0)]),
    ('{"command": "git commit --amend -m \\"quiet {b}\\""}', "nothing to commit, working tree clean", [("commit", True, False, 0)]),
    ('{"command": "sh -c \\"bash -c \'git commit -m nested\'\\""}', "  [main (root-commit) {a}] nested", [("commit", False, False, 1)]),
    ('{"command": "/usr/bin/git -C /other push origin HEAD"}', " + {b}...{a} feat -> feat (forced update)", [("push", False, False, 1)]),
    ('{"command": "git reset --hard HEAD~1"}', "HEAD is now at {a}", [(None, False, True, 0)]),
    ('{"command": "git reset HEAD a.txt"}', "", [(None, False, False, 0)]),
    ('{"command": "git commit --amend -am one && git commit --amend -am two"}', "[feat {b}] one\n[feat {a}] two", [("commit", True, False, 2), ("commit", True, False, 1)]),
    ('{"command": "git -c user.name=x commit --amend --no-edit"}', "[feat {a}] change", [("commit", True, False, 1)]),
]
#: (command, why it isn't a plain push of the current branch, or null)
PUSHES = [
    ("git push", None), ("git push origin feat", None), ("git push -u origin HEAD", None), ("git push --force-with-lease=feat:abc origin +feat", None), ("git push origin HEAD:refs/heads/review", None), ("git -c a.b=c push -fq -o x origin refs/heads/x", None), ("git push --repo=origin feat", None),
    ("ls -la", "not-git"), ("echo git push", "not-git"), ("codex exec 'git push'", "not-git"), ("git status", "not-push"), ("git -C /r push", "retargeted"), ("git --git-dir=/r/.git push", "retargeted"), ("git push --what", "ambiguous"), ("git push -x", "ambiguous"), ("git push --exec", "ambiguous"),
    ("git push --dry-run", "dry-run"), ("git push -qn origin feat", "dry-run"), ("git push --delete origin feat", "delete"), ("git push -d origin feat", "delete"), ("git push --mirror", "mirror"), ("git push --all origin", "all"), ("git push upstream feat", "non-origin"), ("git push --repo other feat", "non-origin"),
    ("git push --tags", "tags-only"), ("git push --prune origin", "prune-only"), ("git push origin a b", "ambiguous-refspecs"), ("git push origin HEAD:refs/receipts/x", "receipts-ref"), ("git push origin tag", "not-branch-refspec"), ("git push origin :feat", "not-branch-refspec"), ("git push origin a:b", "not-branch-refspec"), ("git push origin deadbeef1", "not-branch-refspec"), ("git push -- origin refs/tags/v1", "not-branch-refspec"),
]


def _picked(values: list[str], by: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def calls(spark, sf):
    """All events as shell calls; their SHAs are the md5 of the number, and of its text after a b."""
    e = D.events(spark, sf)
    sha = lambda text: F.substring(F.md5(text.cast("binary")), 1, 10)
    a, b = sha(F.col("event_id").cast("string")), sha(F.concat(F.lit("b"), F.col("event_id").cast("string")))
    filled = lambda k: F.replace(F.replace(_picked([c[k] for c in COMMANDS], "event_id"), F.lit("{a}"), a), F.lit("{b}"), b)
    return e.select("session_id", "turn_index", "call_ord", F.lit(True).alias("is_shell"), filled(0).alias("input_json"), filled(1).alias("output"))


def evidence(spark, sf):
    return G.owned(G.git_commands(calls(spark, sf)), D.commits(spark, sf).select("sha"))


def push_classes(spark, sf):
    """Every event runs a command; how many of each class, plain pushes as a null reason."""
    e = D.events(spark, sf).select(F.explode(invocations(_picked([p for p, _ in PUSHES], "event_id"))).alias("argv"))
    git = e.select(F.expr(G.git_call("argv")).alias("git")).select("git", G.push_args("git.args").alias("push"))
    return git.select(G.push_class("git", "push").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def git_writes(spark, sf):
    """Every commit and push command with the SHAs that its output confirms, and the branch's commits among them."""
    return evidence(spark, sf).where("verb is not null").select("session_id", "call_ord", "inv_ord", "verb", F.array_join("runs", ",").alias("runs"), F.array_join(F.coalesce("shas", F.array().cast("array<string>")), ",").alias("shas"))


def amend_lineage(spark, sf):
    return G.amend_chains(G.anchors(evidence(spark, sf))).select("session_id", "n_commits", "first_turn", "last_turn", "run", "own")


def git_scopes(spark, sf):
    """The branch's turns of each session by its own commits, amended ones included."""
    turns = D.events(spark, sf).groupBy("session_id").agg((F.max("turn_index") + 1).alias("turn_count"))
    return G.scopes(G.anchors(evidence(spark, sf)), turns)


def anchor_summary(spark, sf):
    return G.anchor_summary(evidence(spark, sf))


def anchor_events(spark, sf):
    return G.anchor_events(evidence(spark, sf))


def short_sessions(spark, sf):
    """The same calls in sessions of four."""
    part = F.floor(F.col("call_ord") / 4).cast("long")
    return calls(spark, sf).select(F.concat("session_id", F.lit("-"), part.cast("string")).alias("session_id"), (F.col("call_ord") % 4).alias("turn_index"), "call_ord", "is_shell", F.lit("Bash").alias("name"), "input_json", "output")


def candidates(spark, sf):
    e = D.events(spark, sf).withColumn("part", F.floor(F.col("call_ord") / 4).cast("long"))
    e = e.groupBy("uid", "part").agg((F.max("call_ord") % 4 + 1).alias("turn_count"))
    source, pool = F.when(F.col("uid") % 3 == 0, "codex").otherwise("claude-code"), F.when(F.col("part") % 5 == 4, "anchor").otherwise("repo")
    return e.select(F.concat(F.col("uid").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("session_id"), source.alias("source"), pool.alias("pool"), (F.col("uid") % 7 != 6).alias("in_worktree"), ((F.col("uid") + F.col("part")) % 11 != 10).alias("loaded"), (F.col("part") % 2 == 0).alias("degraded"), "turn_count")


def found_contributors(spark, sf):
    """A purchase is a commit; its subject is what the quiet commit among 17 events in a row names. Two events in a row are one patch."""
    e = D.events(spark, sf)
    sha = lambda text: F.md5(text.cast("binary"))
    quiet = sha(F.concat(F.lit("b"), (F.col("event_id") - F.col("event_id") % 17 + 10).cast("string")))
    commits = e.where("event_type = 'purchase'").select(sha(F.col("event_id").cast("string")).alias("sha"), F.concat(F.lit("quiet "), F.substring(quiet, 1, 10)).alias("subject"))
    patches = e.select(F.substring(sha(F.col("event_id").cast("string")), 1, 10).alias("run"), F.floor(F.col("event_id") / 2).cast("long").alias("patch_id"))
    return C.contributors(candidates(spark, sf), short_sessions(spark, sf), commits, patches)


def contributors(spark, sf):
    return found_contributors(spark, sf).select("session_id", "basis", "event", "kind")


def explicit_contributors(spark, sf):
    """Every fourth session of a user is named as well; how many are left out by each basis and event."""
    named = candidates(spark, sf).where("session_id like '%-3'").select("session_id", F.lit("full").alias("kind"), F.lit(0).cast("long").alias("start_turn"), (F.col("turn_count") - 1).alias("end_turn"))
    found = C.with_explicit(found_contributors(spark, sf), named.unionAll(named))
    return found.groupBy("basis", "event").agg(F.count("*").alias("n_sessions"))


def contributor_roles(spark, sf):
    """Sessions of even parts are the parents of the next."""
    c = candidates(spark, sf)
    kids = c.select(F.concat(F.regexp_extract("session_id", "^(.*-)", 1), (F.regexp_extract("session_id", "([0-9]+)$", 1).cast("long") - 1).cast("string")).alias("parent_id")).where("parent_id like '%0'")
    return C.roles(c, short_sessions(spark, sf), kids).groupBy("role").agg(F.count("*").alias("n_sessions"))


def nested_candidates(spark, sf):
    """A file an event below its user's log: some in a child's own folder, some of another name; five a parent."""
    e = D.events(spark, sf)
    stem = F.concat(F.lit("/logs/u"), F.col("session_id"))
    name = F.concat(F.when(F.col("event_id") % 7 == 0, "note-").otherwise("agent-"), F.col("event_id").cast("string"), F.lit(".jsonl"))
    file = F.concat(stem, F.when(F.col("event_id") % 5 == 0, "/subagents/agent-1/subagents/").otherwise("/subagents/"), name)
    return C.nested_candidates(e.select("session_id", F.concat(stem, F.lit(".jsonl")).alias("file")).distinct(), e.select(file.alias("file")), 5)


QUERIES = {f.__name__: f for f in (push_classes, git_writes, amend_lineage, git_scopes, anchor_summary, anchor_events, contributors, explicit_contributors, contributor_roles, nested_candidates)}


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)


_RULES = ", ".join(f"({t}, {i}, {', '.join(map(_value, c))})" for t, (_, _, cs) in enumerate(COMMANDS) for i, c in enumerate(cs))
#: Commands by the rules stated above; ``pre`` is an amend's pre-image, found by looking back from each commit.
GIT = f"""{SQL}, rules(t, inv, verb, amend, barrier, which) AS (VALUES {_RULES}),
cmds AS MATERIALIZED (SELECT session_id, turn_index, call_ord, inv, verb, amend, barrier, call_ord * 10 + inv AS o, event_id,
  CASE which WHEN 1 THEN md5(CAST(event_id AS VARCHAR))[1:10] WHEN 2 THEN md5('b' || event_id)[1:10] END AS run FROM e JOIN rules ON t = event_id % {len(COMMANDS)}),
heads AS (SELECT DISTINCT sha FROM commits),
writes AS MATERIALIZED (SELECT c.*, h.sha FROM cmds c LEFT JOIN heads h ON run IS NOT NULL AND starts_with(h.sha, run) WHERE verb IS NOT NULL),
before AS (SELECT *, lag(o) OVER w AS prev, lag(run) OVER w AS prev_run FROM writes WHERE verb = 'commit' WINDOW w AS (PARTITION BY session_id ORDER BY o)),
bars AS (SELECT session_id, o FROM cmds WHERE barrier),
made AS MATERIALIZED (SELECT b.*, CASE WHEN amend AND prev_run IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bars x WHERE x.session_id = b.session_id AND x.o > b.prev AND x.o < b.o) THEN prev END AS pre FROM before b),
"""
_LINEAGE = """
mine AS (SELECT session_id, o, pre FROM made WHERE sha IS NOT NULL UNION SELECT m.session_id, m.o, m.pre FROM mine x JOIN made m ON m.session_id = x.session_id AND m.o = x.pre),
"""
_RECURSIVE = GIT.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1)

#: All lines of a call's first verb, as the outputs above have them: (command, verb, which run).
_LINES = "(0, 'commit', 1), (1, 'commit', 1), (2, 'commit', 1), (3, 'push', 1), (7, 'commit', 1), (8, 'push', 1), (11, 'commit', 1), (12, 'push', 1), (15, 'commit', 2), (15, 'commit', 1), (16, 'commit', 1)"
_CLAIMS = f"""{SQL}, f AS (SELECT e.*, event_id % {len(COMMANDS)} AS t, uid || '-' || (call_ord // 4) AS s, call_ord // 4 AS part, md5(CAST(event_id AS VARCHAR))[1:10] AS a, md5('b' || event_id)[1:10] AS b FROM e),
cand AS MATERIALIZED (SELECT s, CASE WHEN uid % 3 = 0 THEN 'codex' ELSE 'claude-code' END AS source, CASE WHEN part % 5 = 4 THEN 'anchor' ELSE 'repo' END AS pool, uid % 7 <> 6 AS wt, (uid + part) % 11 <> 10 AS loaded, part % 2 = 0 AS degraded, uid, part FROM f GROUP BY ALL),
g AS MATERIALIZED (SELECT f.* FROM f JOIN cand USING (s) WHERE loaded),
branch AS MATERIALIZED (SELECT md5(CAST(event_id AS VARCHAR)) AS sha, event_id // 2 AS patch, 'quiet ' || md5('b' || (event_id - event_id % 17 + 10))[1:10] AS subject FROM e WHERE event_type = 'purchase'),
lines(t, verb, which) AS (VALUES {_LINES}), rules(t, inv, verb, amend, barrier, which) AS (VALUES {_RULES}),
runs AS MATERIALIZED (SELECT DISTINCT s, l.verb, CASE which WHEN 1 THEN a ELSE b END AS run, CASE which WHEN 1 THEN event_id // 2 END AS patch, h.sha FROM g JOIN lines l USING (t) LEFT JOIN branch h ON h.sha[1:10] = CASE which WHEN 1 THEN a ELSE b END),
direct AS (SELECT DISTINCT s, sha FROM runs WHERE sha IS NOT NULL),
orphans AS (SELECT DISTINCT s, run, patch FROM runs WHERE sha IS NULL AND verb = 'commit'),
lone AS (SELECT patch, any_value(run) AS run FROM orphans WHERE patch IS NOT NULL GROUP BY patch HAVING count(*) = 1),
heads AS (SELECT patch, any_value(sha) AS sha FROM branch GROUP BY patch HAVING count(*) = 1),
aliases AS MATERIALIZED (SELECT o.s, o.run, h.sha FROM orphans o JOIN lone USING (patch) JOIN heads h USING (patch) WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.sha = h.sha AND d.s <> o.s)),
mapped AS MATERIALIZED (SELECT DISTINCT s, r.verb, CASE which WHEN 1 THEN a WHEN 2 THEN b END AS run FROM g JOIN rules r USING (t) WHERE which > 0),
own AS (SELECT m.s, bool_or(h.sha IS NOT NULL) AS has_own, bool_or(m.verb = 'commit' AND (h.sha IS NOT NULL OR x.sha IS NOT NULL)) AS sliced FROM mapped m LEFT JOIN branch h ON h.sha[1:10] = m.run LEFT JOIN aliases x ON x.s = m.s AND x.run = m.run GROUP BY m.s),
wrote AS (SELECT s, count(DISTINCT call_ord) AS n FROM g JOIN rules r USING (t) WHERE r.verb IS NOT NULL GROUP BY s),
open AS (SELECT subject FROM branch WHERE sha NOT IN (SELECT sha FROM direct UNION SELECT sha FROM aliases) AND subject IN (SELECT subject FROM branch GROUP BY subject HAVING count(*) = 1)),
c AS MATERIALIZED (SELECT cand.*, pool = 'repo' AND wt AS here, coalesce(has_own, false) OR s IN (SELECT s FROM aliases) AS mine, coalesce(sliced, false) AS sliced, coalesce(n, 0) AS n, source = 'codex' AND coalesce(n, 0) = 0 AS calm FROM cand LEFT JOIN own USING (s) LEFT JOIN wrote USING (s)),
asks AS (SELECT DISTINCT s, 'quiet ' || b AS subject FROM g JOIN c USING (s) WHERE t = 10 AND here AND NOT mine AND NOT calm AND 'quiet ' || b IN (SELECT subject FROM open)),
named AS (SELECT s FROM asks GROUP BY s HAVING count(*) = 1 AND any_value(subject) IN (SELECT subject FROM asks GROUP BY subject HAVING count(*) = 1)),
judged AS (SELECT *, CASE WHEN NOT loaded THEN NULL WHEN mine AND NOT (pool = 'anchor' AND NOT sliced) THEN 'anchor' WHEN mine THEN NULL WHEN calm AND here THEN 'helper' WHEN s IN (SELECT s FROM named) AND s NOT IN (SELECT s FROM runs WHERE sha IS NULL) THEN 'message' END AS basis FROM c),
told AS (SELECT s AS session_id, basis, CASE WHEN basis IS NOT NULL THEN NULL WHEN NOT loaded AND (degraded OR NOT here) THEN 'unreadable-session' WHEN NOT loaded THEN 'silenced-git-write' WHEN mine THEN 'unattributable-anchor-pool' WHEN here AND n > 0 THEN 'unanchored-git-write' WHEN here THEN 'silenced-git-write' END AS event,
  CASE WHEN basis IS NOT NULL THEN CASE WHEN sliced THEN 'slice' ELSE 'full' END END AS kind FROM judged)
"""

ORACLE_SQL = {
    "push_classes": SQL + f", rules(t, reason) AS (VALUES {', '.join(f'({t}, {_value(r)})' for t, (_, r) in enumerate(PUSHES))}) SELECT reason, count(*) AS n FROM e JOIN rules ON t = event_id % {len(PUSHES)} GROUP BY reason",
    "git_writes": GIT + "z AS (SELECT 1) SELECT session_id, call_ord, CAST(inv AS INTEGER) AS inv_ord, verb, coalesce(run, '') AS runs, coalesce(sha, '') AS shas FROM writes",
    "amend_lineage": _RECURSIVE + _LINEAGE + """roots AS (SELECT session_id, o, o AS root FROM made WHERE run IS NOT NULL AND pre IS NULL UNION ALL SELECT m.session_id, m.o, r.root FROM roots r JOIN made m ON m.session_id = r.session_id AND m.pre = r.o AND m.run IS NOT NULL)
SELECT r.session_id, count(*) AS n_commits, min(turn_index) AS first_turn, max(turn_index) AS last_turn, arg_max(run, r.o) AS run, bool_or(x.o IS NOT NULL) AS own FROM roots r JOIN made m ON m.session_id = r.session_id AND m.o = r.o LEFT JOIN mine x ON x.session_id = r.session_id AND x.o = r.o GROUP BY r.session_id, root""",
    "git_scopes": _RECURSIVE + _LINEAGE + f"""marks AS MATERIALIZED (SELECT w.session_id, w.o, w.turn_index, verb, w.sha IS NOT NULL OR x.o IS NOT NULL AS own FROM writes w LEFT JOIN mine x ON x.session_id = w.session_id AND x.o = w.o WHERE run IS NOT NULL),
own AS (SELECT session_id, min(o) AS f, arg_min(turn_index, o) AS ft, max(turn_index) AS l FROM marks WHERE own GROUP BY session_id HAVING bool_or(verb = 'commit')),
back AS (SELECT m.session_id, max(turn_index) AS b FROM marks m JOIN own USING (session_id) WHERE NOT m.own AND o < f GROUP BY m.session_id),
n AS (SELECT session_id, max(turn_index) + 1 AS turn_count FROM e GROUP BY session_id)
SELECT session_id, CASE WHEN f IS NULL THEN 'full' ELSE 'slice' END AS kind, CASE WHEN f IS NULL OR b IS NULL THEN 0 WHEN b < ft THEN b + 1 ELSE ft END AS start_turn, coalesce(l, turn_count - 1) AS end_turn, turn_count, CASE WHEN f IS NULL THEN '{G.FULL}' END AS label
FROM n LEFT JOIN own USING (session_id) LEFT JOIN back USING (session_id)""",
    "anchor_summary": GIT + "z AS (SELECT 1) SELECT session_id, bool_or(sha IS NOT NULL) AS has_own, count(DISTINCT call_ord) AS write_count FROM writes GROUP BY session_id",
    "anchor_events": GIT + "z AS (SELECT DISTINCT session_id, turn_index, sha, min(o) AS o FROM writes WHERE verb = 'commit' AND sha IS NOT NULL GROUP BY ALL) SELECT session_id, turn_index, CAST(row_number() OVER (PARTITION BY session_id, turn_index ORDER BY o) - 1 AS INTEGER) AS place, sha FROM z",
    "contributors": _CLAIMS + "SELECT * FROM told",
    "explicit_contributors": _CLAIMS + "SELECT CASE WHEN session_id LIKE '%-3' THEN 'anchor' ELSE basis END AS basis, CASE WHEN session_id LIKE '%-3' THEN NULL ELSE event END AS event, count(*) AS n_sessions FROM told GROUP BY 1, 2",
    "contributor_roles": _CLAIMS + "SELECT CASE WHEN source = 'codex' THEN 'codex' WHEN s IN (SELECT s FROM f WHERE t = 4) OR EXISTS (SELECT 1 FROM cand k WHERE k.uid = cand.uid AND k.part = cand.part + 1 AND cand.part % 10 = 0) THEN 'orchestrator' ELSE 'builder' END AS role, count(*) AS n_sessions FROM cand GROUP BY 1",
    "nested_candidates": SQL + "SELECT session_id AS parent_id, CAST(event_id AS VARCHAR) AS agent_id, '/logs/u' || session_id || '/subagents/agent-' || event_id || '.jsonl' AS file FROM e WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY '/logs/u' || session_id || '/subagents/agent-' || event_id || '.jsonl') <= 5",
}
