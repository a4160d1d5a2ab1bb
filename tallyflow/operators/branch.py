"""Attribution of sessions to branches and commits: band, prefix, interval and anti joins, slices and segments.

Evidence from version control comes in as tables: ``commits`` (ord, sha, commit_ms, subject), newest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.schema import PICO

#: Fixed value: a commit within a quarter of an hour of a session counts as made in it.
BAND_MS = 15 * 60_000


def in_commit_window(sessions: DataFrame, commits: DataFrame, band_ms: int = BAND_MS, cell_ms: int = 6 * 3_600_000) -> DataFrame:
    """Sessions with a commit in [start - band, end + band].

    The range is joined by cells: a session goes to each cell that its range touches, a commit to its own, and the rest is an
    equi-join that neither side has to be small for.
    """
    lo, hi = F.col("started_ms") - band_ms, F.col("ended_ms") + band_ms
    cells = sessions.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell_ms), F.floor(F.col("_hi") / cell_ms))))
    at = commits.select(F.floor(F.col("commit_ms") / cell_ms).alias("_at"), "commit_ms").distinct()
    hit = cells.join(at, (F.col("_cell") == F.col("_at")) & F.col("commit_ms").between(F.col("_lo"), F.col("_hi")), "left_semi")
    return hit.drop("_lo", "_hi", "_cell").dropDuplicates(["session_id"])


def resolve_shas(runs: DataFrame, commits: DataFrame, least: int = 7) -> DataFrame:
    """Adds to runs of hex digits (column ``run``) the one commit that begins with it; null for none or several.

    Prefixes are joined by their first ``least`` digits, then compared.
    """
    c = commits.select("sha", F.substring("sha", 1, least).alias("_head"))
    pairs = runs.where(F.length("run") >= least).select("run").distinct().withColumn("_head", F.substring(F.lower("run"), 1, least)).join(c, "_head").where(F.startswith("sha", F.lower("run")))
    one = pairs.groupBy("run").agg(F.countDistinct("sha").alias("n_matches"), F.min("sha").alias("sha")).select("run", "n_matches", F.when(F.col("n_matches") == 1, F.col("sha")).alias("sha"))
    return runs.join(one, "run", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))


def recover_by_patch(orphans: DataFrame, branch: DataFrame) -> DataFrame:
    """Pairs of commits with one patch id that is unique on both sides: (orphan_sha, sha)."""
    once = lambda df, name: df.groupBy("patch_id").agg(F.count("*").alias("n"), F.min("sha").alias(name)).where("n = 1").drop("n")
    return once(orphans, "orphan_sha").join(once(branch, "sha"), "patch_id")


def match_subjects(messages: DataFrame, commits: DataFrame, claimed: DataFrame, least: int = 12) -> DataFrame:
    """Commit messages of sessions to commits by equal subject: (session_id, sha).

    The subject has ``least`` code points or more, is on the branch once, isn't claimed, and is written by one session.
    """
    commits = commits.select("sha", "subject")
    unclaimed = commits.join(claimed.select("sha").distinct(), "sha", "left_anti").where(F.length("subject") >= least)
    once = commits.groupBy("subject").agg(F.count("*").alias("n")).where("n = 1").select("subject")
    by_one = messages.select("session_id", "subject").distinct().groupBy("subject").agg(F.count("*").alias("n"), F.min("session_id").alias("session_id")).where("n = 1").drop("n")
    return unclaimed.join(once, "subject", "left_semi").join(by_one, "subject").select("session_id", "sha")


def child_overlap(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children of each parent that overlap its window, both ends inclusive; unknown times never do: (parent_id, child_id)."""
    start, end = F.coalesce("c.started_ms", "c.ended_ms"), F.coalesce("c.ended_ms", "c.started_ms")
    on = (F.col("c.parent_id") == F.col("p.session_id")) & (start <= F.col("p.ended_ms")) & (end >= F.col("p.started_ms"))
    return parents.alias("p").join(children.alias("c"), on).select(F.col("p.session_id").alias("parent_id"), F.col("c.session_id").alias("child_id"))


def rollup_children(parents: DataFrame, children: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Parents with the count, cost and tokens of their overlapping children, those excluded by id left out."""
    kids = children if excluded is None else children.join(excluded.select("session_id").distinct(), "session_id", "left_anti")
    pairs = child_overlap(parents, kids).join(kids.select(F.col("session_id").alias("child_id"), F.col("pico").alias("c_pico"), F.col("tokens").alias("c_tokens")), "child_id")
    sums = pairs.groupBy(F.col("parent_id").alias("_of")).agg(F.count("*").alias("n_children"), F.sum("c_pico").cast(PICO).alias("children_pico"), F.sum("c_tokens").alias("children_tokens"))
    both = F.when(F.col("pico").isNull() & F.col("children_pico").isNull(), None).otherwise(F.coalesce("pico", F.lit(0).cast(PICO)) + F.coalesce("children_pico", F.lit(0).cast(PICO)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = parents.join(sums, F.col("session_id") == F.col("_of"), "left")
    return joined.select("session_id", zero("n_children"), "children_pico", zero("children_tokens"), both.cast(PICO).alias("combined_pico"))


def promote(sidechains: DataFrame, covered: DataFrame, parents: DataFrame) -> DataFrame:
    """Sidechain sessions that no roll-up covers and whose parent isn't selected."""
    return sidechains.join(covered.select("session_id"), "session_id", "left_anti").join(parents.select(F.col("session_id").alias("_p")), F.col("parent_id") == F.col("_p"), "left_anti")


def slices(anchors: DataFrame, turns: DataFrame, own: Column) -> DataFrame:
    """The turns of a session that belong to a branch: (session_id, turn_index, label).

    ``anchors`` has a row per commit that a turn made; ``own`` tells the branch's. The slice ends with the last own
    commit and starts after the last foreign one before the first own. Sessions without own commits are labelled full.
    """
    a = anchors.withColumn("own", own)
    bounds = a.groupBy("session_id").agg(F.min(F.when(F.col("own"), F.col("turn_index"))).alias("first"), F.max(F.when(F.col("own"), F.col("turn_index"))).alias("last"))
    before = a.join(bounds, "session_id").where(~F.col("own") & (F.col("turn_index") < F.col("first"))).groupBy("session_id").agg(F.max("turn_index").alias("foreign"))
    at = turns.join(bounds, "session_id", "left").join(before, "session_id", "left")
    whole = F.col("first").isNull()
    inside = (F.col("turn_index") <= F.col("last")) & (F.col("turn_index") > F.coalesce("foreign", F.lit(-1)))
    return at.where(whole | inside).select("session_id", "turn_index", F.when(whole, "full").otherwise("slice").alias("label"))


def reindex(sliced: DataFrame) -> DataFrame:
    """Adds ``new_index``: the turn's place in its slice, from 0."""
    return sliced.withColumn("new_index", (F.row_number().over(W.partitionBy("session_id").orderBy("turn_index")) - 1).cast("long"))


def commit_segments(turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per commit: turns, tokens and cost booked to it.

    A turn is booked to the next commit at or after it in its session; turns after the last are booked to the last. A SHA that is
    printed again counts where it was first; the earliest session owns it.
    """
    owner = anchors.groupBy("sha").agg(F.min_by(F.struct("session_id", "turn_index"), F.struct("ts_ms", "session_id", "turn_index")).alias("o"))
    made = owner.select(F.col("o.session_id").alias("session_id"), F.col("o.turn_index").alias("turn_index"), "sha").groupBy("session_id", "turn_index").agg(F.max("sha").alias("sha"))
    order = W.partitionBy("session_id").orderBy("turn_index")
    at = turns.join(made, ["session_id", "turn_index"], "left").withColumn("next", F.first("sha", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    at = at.withColumn("booked", F.coalesce("next", F.last("sha", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))).where("booked is not null")
    return at.groupBy(F.col("booked").alias("sha")).agg(F.count("*").alias("n_turns"), F.sum("total").alias("tokens"), F.sum("pico").cast(PICO).alias("pico"), F.sum("unpriced_tokens").alias("unpriced_tokens"))


def confidence(events: DataFrame) -> DataFrame:
    """Distinct sessions per kind of caveat, and whether any floors the result."""
    return events.groupBy("kind").agg(F.countDistinct("session_id").alias("n_sessions")).withColumn("floored", F.col("n_sessions") > 0)
