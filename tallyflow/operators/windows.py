"""Windows of time: weeks, budgets, deltas, recurrence and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.schema import PICO

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS


def label_weeks(sessions: DataFrame, now_ms: int) -> DataFrame:
    """Adds ``window_label``: current for ended_ms in [now - 7 days, now), prior for the seven days before; other rows go."""
    at = F.col("ended_ms")
    label = F.when((at >= now_ms - WEEK_MS) & (at < now_ms), "current").when((at >= now_ms - 2 * WEEK_MS) & (at < now_ms - WEEK_MS), "prior")
    return sessions.withColumn("window_label", label).where("window_label is not null")


def aggregatable(sessions: DataFrame) -> DataFrame:
    """Sessions with any token, and unreadable ones, which are counted as such."""
    return sessions.where((F.coalesce("tokens", F.lit(0)) > 0) | F.coalesce("degraded", F.lit(False)))


def top_level(sessions: DataFrame) -> DataFrame:
    return sessions.where(~F.coalesce("is_sidechain", F.lit(False)) & F.col("parent_id").isNull())


def window_totals(labelled: DataFrame, *by: str) -> DataFrame:
    """All tokens, the priced part's cost, and coverage counts, per window and for each of ``by`` alone, in one pass.

    ``level`` names the grouping: all, or a column; ``value`` its value.
    """
    sets = F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(b).alias("level"), F.col(b).cast("string").alias("value")) for b in by]))
    n = lambda c: F.sum(c.cast("long"))
    priced, partial = F.col("pico").isNotNull(), F.col("unpriced_tokens") > 0
    return labelled.withColumn("g", sets).groupBy("window_label", "g.level", "g.value").agg(
        F.count("*").alias("n_sessions"), F.sum("tokens").alias("tokens"), F.sum("pico").cast(PICO).alias("pico"), F.sum("unpriced_tokens").alias("unpriced_tokens"),
        n(priced & ~partial).alias("n_full"), n(priced & partial).alias("n_partial"), n(~priced).alias("n_unpriced"),
    )


def week_delta(totals: DataFrame) -> DataFrame:
    """current less prior per level and value; a side without a price makes the cost's delta null."""
    side = lambda w: totals.where(F.col("window_label") == w).select("level", "value", F.col("pico").alias(f"pico_{w}"), F.col("tokens").alias(f"tokens_{w}")).alias(w)
    both = side("current").join(side("prior"), (F.col("current.level") == F.col("prior.level")) & F.col("current.value").eqNullSafe(F.col("prior.value")), "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(F.coalesce("current.level", "prior.level").alias("level"), F.coalesce("current.value", "prior.value").alias("value"), (F.col("pico_current") - F.col("pico_prior")).cast(PICO).alias("delta_pico"), (zero(F.col("tokens_current")) - zero(F.col("tokens_prior"))).alias("delta_tokens"))


def budgets(sessions: DataFrame, caps: DataFrame, now_ms: int) -> DataFrame:
    """Per cap (period daily or weekly, unit usd or tokens, cap): what was used, by how many sessions, and whether strictly more.

    Daily is the UTC day of ``now_ms``, weekly the seven days before it. Caps in dollars are pico-dollars here.
    """
    day = now_ms // DAY_MS * DAY_MS
    at = F.col("ended_ms")
    spans = sessions.select("*", F.explode(F.filter(F.array(F.when((at >= day) & (at < day + DAY_MS), F.lit("daily")), F.when((at >= now_ms - WEEK_MS) & (at < now_ms), F.lit("weekly"))), lambda x: x.isNotNull())).alias("period"))
    used = spans.groupBy("period").agg(
        F.sum("pico").cast(PICO).alias("pico"), F.sum("tokens").cast(PICO).alias("tokens"), F.sum((F.col("pico").isNotNull() & (F.col("unpriced_tokens") == 0)).cast("long")).alias("n_full"),
        F.sum((F.col("pico").isNotNull() & (F.col("unpriced_tokens") > 0)).cast("long")).alias("n_partial"), F.sum(F.col("pico").isNull().cast("long")).alias("n_excluded"),
    )
    amount = F.coalesce(F.when(F.col("unit") == "usd", F.col("pico")).otherwise(F.col("tokens")), F.lit(0).cast(PICO))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(caps).join(used, "period", "left").select("period", "unit", "cap", amount.alias("used"), (amount > F.col("cap")).alias("exceeded"), *map(zero, ("n_full", "n_partial", "n_excluded")))


def class_rollup(findings: DataFrame) -> DataFrame:
    """Per kind of finding: findings, priced cost, tokens, distinct sessions; dearest first."""
    out = findings.groupBy("kind").agg(F.count("*").alias("n_findings"), F.sum("pico").alias("pico"), F.sum("tokens").alias("tokens"), F.countDistinct("session_id").alias("n_sessions"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("pico"), F.desc("tokens"), "kind")))


def overlaps(findings: DataFrame, left: str, right: str) -> DataFrame:
    """Sessions in which a turn belongs to findings of both kinds."""
    turns = findings.select("session_id", "kind", F.explode("turns").alias("turn_index")).distinct()
    side = lambda k: turns.where(F.col("kind") == k).select("session_id", "turn_index")
    return side(left).join(side(right), ["session_id", "turn_index"]).groupBy("session_id").agg(F.count("*").alias("n_turns"))


def recurrence(findings: DataFrame, templates: DataFrame, least: int = 3) -> DataFrame:
    """Kinds found in ``least`` or more distinct sessions for which a rule's template exists."""
    n = findings.groupBy("kind").agg(F.countDistinct("session_id").alias("n_sessions")).where(F.col("n_sessions") >= least)
    return n.join(F.broadcast(templates), "kind")


def headline(findings: DataFrame) -> DataFrame:
    """Per session the dearest kind, not the sum of kinds, which may share turns."""
    each = findings.groupBy("session_id", "kind").agg(F.sum("pico").alias("pico"), F.sum("tokens").alias("tokens"))
    return each.groupBy("session_id").agg(F.max("pico").alias("pico"), F.max("tokens").alias("tokens"), F.max_by("kind", F.struct(F.coalesce("pico", F.lit(-1).cast("decimal(38,6)")), "kind")).alias("kind"))


def newest(sessions: DataFrame, n: int, since_ms: int | None = None) -> DataFrame:
    """The ``n`` newest by end, else start; rows of no time come last, and stay under ``since_ms``."""
    at = F.coalesce("ended_ms", "started_ms")
    some = sessions if since_ms is None else sessions.where(at.isNull() | (at >= since_ms))
    return some.orderBy(F.coalesce(at, F.lit(0)).desc(), "session_id").limit(n)


def select_session(sessions: DataFrame, selector: str = "") -> DataFrame:
    """At most one session: the newest, the n-th newest for a number, else by id, else the newest whose title holds the text."""
    at = F.coalesce("ended_ms", "started_ms", F.lit(0))
    if not selector:
        return newest(sessions, 1)
    if selector.isdigit():
        place = F.row_number().over(W.orderBy(at.desc(), "session_id"))  # over the n rows that the limit leaves
        return newest(sessions, int(selector)).withColumn("_place", place).where(F.col("_place") == int(selector)).drop("_place")
    by_id, by_title = F.col("session_id") == selector, F.contains(F.lower("title"), F.lit(selector.lower()))
    return sessions.where(by_id | by_title).orderBy(by_id.desc(), at.desc(), "session_id").limit(1)


#: Fixed value: readings of a quota that are nearer than a minute tell no rate.
LEAST_GAP_MS = 60_000


def crossing(before: Column, at: Column, reset: Column) -> Column:
    """When a quota is full if it goes on rising as since an earlier reading; null where that can't be told.

    Both readings (the later in observed_ms, used in per cent, resets_ms) are of one window, the same reset; the earlier isn't of the
    future, they are a minute apart, the use has risen, and the crossing comes before the reset.
    """
    gap = F.col("observed_ms") - at
    full = F.col("observed_ms") + (100 - F.col("used")) * gap / F.nullif(F.col("used") - before, F.lit(0))
    sure = (reset == F.col("resets_ms")) & (gap >= LEAST_GAP_MS) & (F.col("used") > before) & (full < F.col("resets_ms"))
    return F.when(sure, F.floor(full).cast("long"))


def cap_crossing(readings: DataFrame, key: str, order: str = "observed_ms") -> DataFrame:
    """Adds ``crossing_ms`` to readings (key, observed_ms, used, resets_ms), each from the reading before it."""
    w = W.partitionBy(key).orderBy(order)
    return readings.withColumn("crossing_ms", crossing(F.lag("used").over(w), F.lag("observed_ms").over(w), F.lag("resets_ms").over(w)))
