"""Queries of branch and commit attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators import branch as B
from tallyflow.operators import windows as V
from tallyflow.plans import derive as D
from tallyflow.plans.cost import turns
from tallyflow.plans.derive import SQL


def commit_window_overlap(spark, sf):
    """All sessions and commits, with the operator's own band."""
    return B.in_commit_window(D.sessions(spark, sf), D.commits(spark, sf)).select("session_id", "started_ms")


def prefix_sha_join(spark, sf):
    """Runs of 7 digits; a few that two commits or none begin with."""
    c = D.commits(spark, sf).select("sha")
    c = c.unionAll(c.where("sha < '2'").select(F.concat(F.substring("sha", 1, 20), F.lit("0" * 12)).alias("sha")))
    runs = D.commits(spark, sf).select(F.upper(F.substring("sha", 1, 9)).alias("run")).unionAll(D.commits(spark, sf).where("sha > 'd'").select(F.reverse(F.substring("sha", 1, 9)).alias("run")))
    return B.resolve_shas(runs, c).select("run", "n_matches", "sha")


def patch_recovery(spark, sf):
    """Every event is a commit, of the branch if its number is odd; two in a row are one patch, but those of every tenth k are all alike."""
    patch = F.when(F.col("k") % 10 == 0, 0).otherwise(F.floor(F.col("event_id") / 2)).cast("long")
    c = D.events(spark, sf).select((F.col("event_id") % 2 == 1).alias("on_branch"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"), patch.alias("patch_id"))
    return B.recover_by_patch(c.where("not on_branch"), c.where("on_branch"))


def subject_match(spark, sf):
    """Every event has a message; those of some sessions are alike. The branch's own commits are claimed already."""
    subject = lambda sha: F.concat(F.lit("change number "), F.substring(sha, 1, 5))
    c = D.commits(spark, sf).withColumn("subject", subject(F.col("sha")))
    return B.match_subjects(D.events(spark, sf).select("session_id", subject(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("subject")), c, c.where("own").select("sha"))


def child_interval_rollup(spark, sf):
    s = D.sessions(spark, sf)
    kids = sidechains(s).withColumn("started_ms", F.col("started_ms") - F.col("tokens") * 100)
    return B.rollup_children(V.top_level(s), kids)


def exclude_children(spark, sf):
    s = D.sessions(spark, sf)
    kids = sidechains(s).withColumn("started_ms", F.col("started_ms") - F.col("tokens") * 1000)
    return B.rollup_children(V.top_level(s), kids, kids.where("tokens % 2 = 0")).where("n_children > 0")


def sidechains(s):
    return s.where("is_sidechain and parent_id is not null")


def promote_orphans(spark, sf):
    s = D.sessions(spark, sf)
    kids = sidechains(s)
    return B.promote(kids, kids.where("tokens % 3 = 0"), V.top_level(s).where("tokens % 2 = 0")).select("session_id", "parent_id")


def branch_slices(spark, sf):
    anchors = D.commits(spark, sf).withColumn("mine", F.col("sha") < "9")
    return B.reindex(B.slices(anchors, turns(spark, sf).select("session_id", "turn_index"), F.col("mine")))


def per_commit_segments(spark, sf):
    return B.commit_segments(turns(spark, sf), D.commits(spark, sf))


def confidence_summary(spark, sf):
    s = D.sessions(spark, sf)
    events = s.where("pico is null").select(F.lit("unpriced").alias("kind"), "session_id").unionAll(s.where("unpriced_tokens > 0").select(F.lit("partial").alias("kind"), "session_id"))
    return B.confidence(events.unionAll(events))


QUERIES = {f.__name__: f for f in (commit_window_overlap, prefix_sha_join, patch_recovery, subject_match, child_interval_rollup, exclude_children, promote_orphans, branch_slices, per_commit_segments, confidence_summary)}

_KIDS = """, kids AS (SELECT session_id AS child, parent_id AS p, started_ms - tokens * {shift} AS a, ended_ms AS b, pico AS kp, tokens AS kt FROM sessions WHERE is_sidechain AND parent_id IS NOT NULL {more}),
r AS (SELECT s.session_id, min(s.pico) AS pico, count(child) AS n_children, sum(kp) AS kp, sum(kt) AS kt FROM sessions s LEFT JOIN kids ON p = s.session_id AND a <= s.ended_ms AND b >= s.started_ms WHERE NOT s.is_sidechain AND s.parent_id IS NULL GROUP BY s.session_id)
SELECT session_id, n_children, CAST(kp AS DECIMAL(38,0)) AS children_pico, CAST(coalesce(kt, 0) AS BIGINT) AS children_tokens, CAST(CASE WHEN pico IS NOT NULL OR kp IS NOT NULL THEN coalesce(pico, 0) + coalesce(kp, 0) END AS DECIMAL(38,0)) AS combined_pico FROM r"""

ORACLE_SQL = {
    "commit_window_overlap": SQL + "SELECT session_id, started_ms FROM sessions s WHERE EXISTS (SELECT 1 FROM commits c WHERE c.commit_ms BETWEEN s.started_ms - 900000 AND s.ended_ms + 900000)",
    "prefix_sha_join": SQL + ", c AS (SELECT sha FROM commits UNION ALL SELECT sha[1:20] || repeat('0', 12) FROM commits WHERE sha < '2'), runs AS (SELECT upper(sha[1:9]) AS run FROM commits UNION ALL SELECT reverse(sha[1:9]) FROM commits WHERE sha > 'd'), m AS (SELECT run, count(DISTINCT sha) AS n, min(sha) AS sha FROM (SELECT DISTINCT run FROM runs) r JOIN c ON starts_with(sha, lower(run)) GROUP BY run) SELECT r.run, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN sha END AS sha FROM runs r LEFT JOIN m ON r.run = m.run",
    "patch_recovery": SQL + ", p AS (SELECT md5(CAST(event_id AS VARCHAR)) AS sha, event_id % 2 = 1 AS b, CAST(CASE WHEN k % 10 = 0 THEN 0 ELSE event_id // 2 END AS BIGINT) AS patch_id FROM e), o AS (SELECT patch_id, any_value(sha) AS orphan_sha FROM p WHERE NOT b GROUP BY 1 HAVING count(*) = 1), m AS (SELECT patch_id, any_value(sha) AS sha FROM p WHERE b GROUP BY 1 HAVING count(*) = 1) SELECT patch_id, orphan_sha, sha FROM o JOIN m USING (patch_id)",
    "subject_match": SQL + ", c AS (SELECT sha, own, 'change number ' || sha[1:5] AS subject, count(*) OVER (PARTITION BY sha[1:5]) AS n FROM commits), m AS (SELECT 'change number ' || md5(CAST(event_id AS VARCHAR))[1:5] AS subject, min(session_id) AS session_id FROM e GROUP BY 1 HAVING min(session_id) = max(session_id)) SELECT session_id, sha FROM c JOIN m USING (subject) WHERE NOT own AND n = 1",
    "child_interval_rollup": SQL + _KIDS.format(shift=100, more=""),
    "exclude_children": SQL + _KIDS.format(shift=1000, more="AND tokens % 2 <> 0") + " WHERE n_children > 0",
    "promote_orphans": SQL + "SELECT session_id, parent_id FROM sessions s WHERE is_sidechain AND parent_id IS NOT NULL AND tokens % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM sessions p WHERE p.session_id = s.parent_id AND NOT p.is_sidechain AND p.parent_id IS NULL AND p.tokens % 2 = 0)",
    "branch_slices": SQL + ", b AS (SELECT session_id, min(turn_index) FILTER (sha < '9') AS f, max(turn_index) FILTER (sha < '9') AS l FROM commits GROUP BY session_id), x AS (SELECT session_id, max(turn_index) AS x FROM commits JOIN b USING (session_id) WHERE sha >= '9' AND turn_index < f GROUP BY session_id), t AS (SELECT session_id, turn_index, CASE WHEN f IS NULL THEN 'full' ELSE 'slice' END AS label FROM turns LEFT JOIN b USING (session_id) LEFT JOIN x USING (session_id) WHERE f IS NULL OR (turn_index <= l AND turn_index > coalesce(x, -1))) SELECT session_id, turn_index, label, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS new_index FROM t",
    "per_commit_segments": SQL + ", m AS (SELECT session_id, turn_index, max(sha) AS sha FROM commits GROUP BY ALL), t AS (SELECT turns.*, coalesce((SELECT arg_min(sha, m.turn_index) FROM m WHERE m.session_id = turns.session_id AND m.turn_index >= turns.turn_index), (SELECT arg_max(sha, m.turn_index) FROM m WHERE m.session_id = turns.session_id AND m.turn_index <= turns.turn_index)) AS sha FROM turns) SELECT sha, count(*) AS n_turns, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(pico) AS DECIMAL(38,0)) AS pico, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens FROM t WHERE sha IS NOT NULL GROUP BY sha",
    "confidence_summary": SQL + "SELECT 'unpriced' AS kind, count(*) AS n_sessions, true AS floored FROM sessions WHERE pico IS NULL UNION ALL SELECT 'partial', count(*), true FROM sessions WHERE unpriced_tokens > 0",
}
