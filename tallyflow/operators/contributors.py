"""Which sessions made a branch: claims by confirmed commits first, of all sessions, then the weaker kinds of evidence.

Every rule looks at tables of claims, so no result depends on the order of sessions. Claims are (session, commit) pairs;
a commit that one session claims directly is never given to another by an equal patch or an equal message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions.shell import invocations
from tallyflow.functions.stages import stored
from tallyflow.operators import git_evidence as G
from tallyflow.operators.branch import recover_by_patch, resolve_shas

#: The fewest code points of a subject that counts, and the most children that a parent brings along.
LEAST_SUBJECT, MOST_CHILDREN = 12, 200


def claims(calls: DataFrame, commits: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(direct, aliases, foreign) of all sessions' writes.

    ``direct``: (session_id, sha), the branch's commits that an output confirms. ``aliases``: (session_id, run, sha), commits
    that aren't on the branch but whose patch is that of exactly one commit there and of no other such commit, unless another session
    claims that commit directly. ``foreign``: sessions that wrote commits of no branch commit. ``patches``: (run, patch_id).
    """
    runs = G.call_writes(calls).select("session_id", "verb", F.explode("runs").alias("run")).distinct()
    named = stored(resolve_shas(runs, commits))
    direct = named.where("sha is not null").select("session_id", "sha").distinct()
    foreign = named.where("n_matches = 0").select("session_id").distinct()
    orphans = named.where("n_matches = 0 and verb = 'commit'").select("session_id", "run").distinct()
    patch = patches.select("run", "patch_id")
    heads = commits.select("sha").join(patch, F.startswith("sha", "run") & (F.substring("sha", 1, 7) == F.substring("run", 1, 7))).select("sha", "patch_id").distinct()
    recovered = recover_by_patch(orphans.join(patch, "run").select(F.col("run").alias("sha"), "patch_id"), heads)
    owners = direct.groupBy("sha").agg(F.min("session_id").alias("lo"), F.max("session_id").alias("hi"))
    found = orphans.join(recovered.select(F.col("orphan_sha").alias("run"), "sha"), "run").join(owners, "sha", "left")
    return direct, stored(found.where("lo is null or (lo = session_id and hi = session_id)").select("session_id", "run", "sha")), foreign


def contributors(candidates: DataFrame, calls: DataFrame, commits: DataFrame, patches: DataFrame) -> DataFrame:
    """(session_id, basis, event, kind, start_turn, end_turn) of every candidate.

    ``candidates``: (session_id, source, pool, in_worktree, loaded, degraded, turn_count); ``commits``: (sha, subject). ``basis``: ``anchor``
    for a session with a commit of the branch, direct or recovered; ``helper`` for one of codex that wrote nothing, in this worktree;
    ``message`` for one in this worktree that alone names exactly one commit's subject: unclaimed, on the branch once, long enough, and
    the session has no writes elsewhere. Else ``event`` tells why it is left out, null if it is none of ours.

    What has several uses is stored in the shared folder: the calls as git commands, the claims, and what is known of each candidate.
    """
    candidates = stored(candidates)
    mine = stored(G.told(calls).join(candidates.where("loaded").select("session_id"), "session_id", "left_semi"))
    direct, aliases, foreign = claims(mine, commits, patches)
    commands = G.git_commands(mine)
    summary = G.anchor_summary(G.owned(commands, commits))
    claimed = direct.select("sha").unionAll(aliases.select("sha")).distinct()
    once = commits.groupBy("subject").agg(F.count("*").alias("n")).where("n = 1").select("subject")
    eligible = commits.join(claimed, "sha", "left_anti").where(F.length("subject") >= LEAST_SUBJECT).select("subject").join(once, "subject", "left_semi")

    c = candidates.join(summary, "session_id", "left").join(aliases.select("session_id", F.lit(True).alias("recovered")).distinct(), "session_id", "left").join(foreign.withColumn("elsewhere", F.lit(True)), "session_id", "left")
    c = c.withColumns({"here": F.expr("pool = 'repo' and in_worktree"), "own": F.expr("coalesce(has_own, false) or coalesce(recovered, false)"), "writes": F.coalesce("write_count", F.lit(0))})
    c = stored(c.withColumn("quiet_codex", F.expr("source = 'codex' and writes = 0")))
    asks = G.commit_subjects(mine).join(c.where("loaded and here and not own and not quiet_codex").select("session_id"), "session_id", "left_semi").join(eligible, "subject", "left_semi")
    asks = asks.withColumn("claimants", F.count("*").over(W.partitionBy("subject")))
    named = asks.groupBy("session_id").agg(F.count("*").alias("subjects"), F.max("claimants").alias("claimants")).where("subjects = 1 and claimants = 1").select("session_id", F.lit(True).alias("named"))

    scope = G.scopes(G.anchors(G.owned(commands, commits, aliases)), candidates.where("loaded").select("session_id", "turn_count")).select("session_id", "kind", "start_turn", "end_turn")
    c = c.join(named, "session_id", "left").join(scope, "session_id", "left")
    basis = F.expr("""case when not loaded then null when own and not (pool = 'anchor' and kind = 'full') then 'anchor' when own then null
      when quiet_codex and here then 'helper' when coalesce(named, false) and not coalesce(elsewhere, false) then 'message' end""")
    event = F.expr("""case when basis is not null then null when not loaded and (degraded or not here) then 'unreadable-session' when not loaded then 'silenced-git-write'
      when own then 'unattributable-anchor-pool' when here and writes > 0 then 'unanchored-git-write' when here then 'silenced-git-write' end""")
    return c.withColumn("basis", basis).withColumn("event", event).select("session_id", "basis", "event", *[F.when(F.col("basis").isNotNull(), F.col(x)).alias(x) for x in ("kind", "start_turn", "end_turn")])


def with_explicit(found: DataFrame, explicit: DataFrame) -> DataFrame:
    """Contributors with sessions that the user names, each once: a name is an anchor and ends its event; scopes found stay.

    ``explicit``: (session_id, kind, start_turn, end_turn). Names may repeat.
    """
    named = explicit.dropDuplicates(["session_id"]).select("session_id", *[F.col(c).alias(f"_{c}") for c in ("kind", "start_turn", "end_turn")], F.lit(True).alias("_named"))
    both = found.join(named, "session_id", "full")
    kept = [F.when(F.col("basis").isNull() & F.col("_named"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("kind", "start_turn", "end_turn")]
    return both.select("session_id", F.when(F.col("_named"), "anchor").otherwise(F.col("basis")).alias("basis"), F.when(F.col("_named").isNull(), F.col("event")).alias("event"), *kept)


def excluded_count(found: DataFrame) -> DataFrame:
    """(n_excluded): sessions in this worktree that can't be proven."""
    return found.agg(F.count_distinct(F.when(F.col("event").isin("silenced-git-write", "unanchored-git-write"), F.col("session_id"))).alias("n_excluded"))


def roles(candidates: DataFrame, calls: DataFrame, children: DataFrame) -> DataFrame:
    """(session_id, role): ``codex`` by its source, ``orchestrator`` with children or a call that launches an agent, else ``builder``.

    ``calls`` has the tool's name; a launch is a task or agent tool, or a command that runs codex exec. ``children``: (parent_id).
    """
    starts = f"""exists(argvs, a -> {G.base_name("get(a, 0)")} = 'codex' and get(filter(slice(a, 2, size(a)), w -> w not like '-%'), 0) <=> 'exec')"""
    found = calls.select("session_id", "name", invocations(F.col("input_json")).alias("argvs")).where(F.lower("name").isin("task", "agent") | F.expr(starts))
    leads = found.select("session_id").unionAll(children.select(F.col("parent_id").alias("session_id"))).distinct().withColumn("leads", F.lit(True))
    rows = candidates.select("session_id", "source").join(leads, "session_id", "left")
    return rows.select("session_id", F.when(F.col("source") == "codex", "codex").when(F.col("leads"), "orchestrator").otherwise("builder").alias("role"))


def nested_candidates(parents: DataFrame, files: DataFrame, most: int = MOST_CHILDREN) -> DataFrame:
    """(parent_id, agent_id, file): the direct children of each parent's log, by name the first ``most`` of them, so a grandchild
    counts with its own parent only.

    ``parents``: (session_id, file), files ``<stem>.jsonl``; a child is ``<stem>/subagents/agent-<id>.jsonl``. Joined by folder; ranks
    are cut before they are shuffled.
    """
    folder, name = F.regexp_extract("child", "^(.*)/[^/]*$", 1), F.regexp_extract("child", "/agent-([^/]+)[.]jsonl$", 1)
    kids = files.select(F.col("file").alias("child")).select("child", folder.alias("folder"), name.alias("agent_id")).where("agent_id <> ''")
    of = parents.select(F.col("session_id").alias("parent_id"), F.concat(F.regexp_replace("file", "[.]jsonl$", ""), F.lit("/subagents")).alias("folder"))
    rank = F.row_number().over(W.partitionBy("parent_id").orderBy("child"))
    return of.join(kids, "folder").withColumn("rank", rank).where(F.col("rank") <= most).select("parent_id", "agent_id", F.col("child").alias("file"))
