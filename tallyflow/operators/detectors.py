"""Pattern detectors over sequences of calls and turns, as window functions keyed by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions import usage as U
from tallyflow.functions.paths import fold_file
from tallyflow.schema import PICO

#: The shortest loop, the longest trivial output, and the bounds of context churn.
LOOP, TRIVIAL_OUTPUT, LOOK_AHEAD, REFILL_TENTHS, MAX_GAP = 3, 120, 5, 8, 25
LATE_TURNS, TOP_TURNS = 4, 3


def canonical_json(c: Column) -> Column:
    """A JSON text with the keys of all its objects sorted; a text that isn't JSON stays as it is. Parsed objects keep their keys in order."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def stuck_loops(calls: DataFrame, turns: DataFrame, key: Column | None = None, least: int = LOOP) -> DataFrame:
    """Maximal runs of ``least`` or more calls with one tool and input, across turns: (session_id, tool, start_ord, n_calls, ...).

    ``key`` is what makes two inputs equal; by default their JSON with sorted keys, or their text if it is none. A call carries an even
    share of its turn, if that is priced in full; one without price makes the run's cost null. Runs are islands: the
    number among all calls less the number among equal calls is constant in a run.
    """
    whole = calls.groupBy("session_id", "turn_index").agg(F.count("*").alias("n"))
    part = F.when(F.col("complete"), F.col("pico").cast("decimal(30,6)") / F.col("n").cast("decimal(9,0)"))
    flat = calls.withColumn("same", F.coalesce(canonical_json(F.col("input_json")) if key is None else key, F.lit("")))
    ordered, equal = W.partitionBy("session_id").orderBy("call_ord"), W.partitionBy("session_id", "name", "same").orderBy("call_ord")
    flat = flat.withColumn("rn", F.row_number().over(ordered)).withColumn("island", F.col("rn") - F.row_number().over(equal))
    runs = flat.join(whole, ["session_id", "turn_index"]).join(turns.select("session_id", "turn_index", "pico", "complete"), ["session_id", "turn_index"], "left").withColumn("part", part)
    out = runs.groupBy("session_id", "name", "same", "island").agg(
        F.min("call_ord").alias("start_ord"), F.count("*").alias("n_calls"), F.sum("part").alias("s"), F.count("part").alias("n_priced"), F.min_by("started_ms", "call_ord").alias("t0"), F.max_by("ended_ms", "call_ord").alias("t1"),
        F.array_sort(F.collect_set("turn_index")).alias("turns"),
    )
    out = out.where(F.col("n_calls") >= least)
    return out.select("session_id", F.col("name").alias("tool"), "start_ord", "n_calls", F.when(F.col("n_priced") == F.col("n_calls"), F.col("s")).alias("pico"), (F.col("t1") - F.col("t0")).alias("wall_ms"), "turns")


def rereads(calls: DataFrame, read: str, edit: tuple[str, ...], path: str = "path", blocked_by: DataFrame | None = None) -> DataFrame:
    """Successful reads of a path that was read before with nothing between that may have changed it.

    Every successful read becomes the one before the next. An edit of the path between the two, or a row of
    ``blocked_by`` (session_id, call_ord, path; null path: all paths) between, clears the repeat. (session_id, path, call_ord, before_ord).
    """
    of_path = W.partitionBy("session_id", path).orderBy("call_ord")
    touched = calls.where(F.col("name").isin(read, *edit) & F.col(path).isNotNull() & ((F.col("name") != read) | (F.col("status") == "ok")))
    seen = touched.withColumn("before_ord", F.lag("call_ord").over(of_path)).withColumn("before_name", F.lag("name").over(of_path))
    found = seen.where((F.col("name") == read) & (F.col("before_name") == read)).select("session_id", F.col(path).alias("path"), "call_ord", "before_ord")
    if blocked_by is not None:
        b = blocked_by.select(F.col("session_id").alias("b_session"), F.col("call_ord").alias("b_ord"), F.col("path").alias("b_path"))
        between = (F.col("session_id") == F.col("b_session")) & (F.col("b_ord") > F.col("before_ord")) & (F.col("b_ord") <= F.col("call_ord")) & (F.col("b_path").isNull() | (F.col("b_path") == F.col("path")))
        found = found.join(b, between, "left_anti")
    return found


#: Tools that read or change a file, and shell commands that may change any.
READS, EDITS = ("Read",), ("Edit", "Write", "NotebookEdit")
WHOLE_TREE = r"\bgit\s+reset\s+--hard\b|\bgit\s+stash\b|\bgit\s+apply\b|\bgit\s+(?:checkout|restore)\s+(?:--\s+)?\.(?:\s|$)|\bprettier\b[^|]*--write|\beslint\b[^|]*--fix|\bfind\b[^|]*-exec"


def _latest(reads: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str) -> DataFrame:
    """Adds to reads the column ``mark``: the greatest place in ``marks`` (by..., place) not after the read's ``at``, -1 for none.

    One running maximum over both tables together, so nothing is compared pair by pair.
    """
    of = [F.col(c).alias(f"_{c}") for c in by]
    rows = reads.select(*of, F.col(at).alias("_at"), F.lit(1).alias("_read"), F.struct(*reads.columns).alias("_row"))
    rows = rows.unionByName(marks.select(*of, F.col("place").cast("long").alias("_at"), F.lit(0).alias("_read")), allowMissingColumns=True)
    upto = W.partitionBy(*[f"_{c}" for c in by]).orderBy("_at", "_read").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(mark, F.coalesce(F.max(F.when(F.col("_read") == 0, F.col("_at"))).over(upto), F.lit(-1))).where("_read = 1").select("_row.*", mark)


def same_file_rereads(calls: DataFrame, turns: DataFrame, compactions: DataFrame) -> DataFrame:
    """(session_id, n_rereads, pico, tokens, turns, confidence): reads of a file that was read before, with no recorded cause between.

    A cause is an edit of the same path, a shell command that names the file's last part or may change the whole tree, or a
    compaction in a later turn than the read before, up to this one's. Paths are folded; failed reads count for nothing, all
    others become the read before the next. A call carries an even share of its turn; pico is null if a counted read has no price.
    ``calls``: (session_id, turn_index, call_ord, name, is_shell, input_json, status). The finding is no verdict: confidence is low.
    """
    raw = F.coalesce(F.expr("try_variant_get(try_parse_json(input_json), '$.file_path', 'string')"), F.expr("try_variant_get(try_parse_json(input_json), '$.notebook_path', 'string')"))
    files = calls.where(F.col("name").isin(*READS, *EDITS)).withColumn("raw", raw).where("raw <> ''").withColumn("path", fold_file("raw"))
    files = files.withColumn("base", F.regexp_extract("path", "([^/]*)$", 1))
    edits = files.where(F.col("name").isin(*EDITS)).select("session_id", "path", F.col("call_ord").alias("place"))
    reads = files.where(F.col("name").isin(*READS) & (F.coalesce("status", F.lit("")) != "error")).select("session_id", "turn_index", "call_ord", "path", "base")
    before = W.partitionBy("session_id", "path").orderBy("call_ord")
    reads = reads.withColumn("before_ord", F.lag("call_ord").over(before)).withColumn("before_turn", F.lag("turn_index").over(before)).where("before_ord is not null")

    shell = calls.where((F.col("is_shell") | (F.col("name") == "Bash")) & ~F.col("name").isin(*EDITS)).select("session_id", F.col("call_ord").alias("place"), F.expr("coalesce(try_variant_get(try_parse_json(input_json), '$.command', 'string'), '')").alias("command"))
    # a command names a file if it holds the name anywhere: joined by the name's first letters, then looked up
    grams = lambda text, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda k: F.substr(text, k, F.lit(n)))
    letters = F.array_distinct(F.concat(*[grams(F.col("command"), n) for n in (1, 2, 3)]))
    bases = reads.select("session_id", "base").distinct().withColumn("gram", F.substring("base", 1, 3))
    named = shell.where("command <> ''").withColumn("gram", F.explode(letters)).join(bases, ["session_id", "gram"]).where(F.contains("command", F.col("base"))).select("session_id", "base", "place")
    whole = shell.where(F.col("command").rlike(WHOLE_TREE)).select("session_id", "place")

    reads = _latest(reads, edits, ["session_id", "path"], "call_ord", "edited")
    reads = _latest(reads, named, ["session_id", "base"], "call_ord", "named")
    reads = _latest(reads, whole, ["session_id"], "call_ord", "changed")
    reads = _latest(reads, compactions.select("session_id", F.col("turn_index").alias("place")), ["session_id"], "turn_index", "compacted")
    found = reads.where("edited <= before_ord and named <= before_ord and changed <= before_ord and compacted <= before_turn")

    n = calls.groupBy("session_id", "turn_index").agg(F.count("*").alias("n"))
    share = lambda c: F.col(c).cast("decimal(30,6)") / F.col("n").cast("decimal(9,0)")
    priced = found.join(n, ["session_id", "turn_index"]).join(turns.select("session_id", "turn_index", "pico", "total", "complete"), ["session_id", "turn_index"], "left")
    out = priced.groupBy("session_id").agg(F.count("*").alias("n_rereads"), F.sum(F.when(F.col("complete"), share("pico"))).alias("s"), F.count(F.when(F.col("complete"), F.col("pico"))).alias("n_priced"), F.sum(share("total")).alias("tokens"), F.array_sort(F.collect_set("turn_index")).alias("turns"))
    return out.select("session_id", "n_rereads", F.when(F.col("n_priced") == F.col("n_rereads"), F.col("s")).alias("pico"), "tokens", "turns", F.lit("low").alias("confidence"))


def trivial_spans(priced: DataFrame, calls: DataFrame, cheapest: DataFrame, most: int = TRIVIAL_OUTPUT) -> DataFrame:
    """Turns without calls and with little output whose every request has a dearer model than its vendor's cheapest.

    ``cheapest`` is ``pricing.cheapest_current``. One row a session: the turns, their cost, and their cost at the cheapest row.
    """
    from tallyflow.operators.pricing import book_side

    quiet = priced.join(calls.select("session_id", "turn_index").distinct(), ["session_id", "turn_index"], "left_anti")
    at = quiet.join(book_side(cheapest), "vendor", "left").withColumn("dearer", F.coalesce(F.col("pico").isNotNull() & (F.col("cheapest.r_in") < F.col("price.r_in")), F.lit(False)))
    at = at.drop("rates").withColumn("rates", U.rates("cheapest")).withColumn("least", U.cost())
    turns = at.groupBy("session_id", "turn_index").agg(F.sum("output").alias("output"), F.bool_and("dearer").alias("all"), F.sum("pico").cast(PICO).alias("pico"), F.sum("least").cast(PICO).alias("least"), F.sum("total").alias("tokens"))
    hit = turns.where(F.col("all") & (F.col("output") <= most))
    return hit.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.sum("tokens").alias("tokens"), F.sum("pico").cast(PICO).alias("pico"), F.sum("least").cast(PICO).alias("cheapest_pico"), F.array_sort(F.collect_list("turn_index")).alias("turns"))


def refills(turns: DataFrame, compactions: DataFrame, k: int = LOOK_AHEAD, tenths: int = REFILL_TENTHS) -> DataFrame:
    """Compactions after which, within ``k`` turns, the prompt is back at ``tenths``/10 of its peak before: (session_id, turn_index)."""
    order = W.partitionBy("session_id").orderBy("turn_index")
    prompt = F.coalesce(U.prompt_side(), F.lit(0))
    peaks = turns.select("session_id", "turn_index", F.max(prompt).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.max(prompt).over(order.rowsBetween(0, k - 1)).alias("after"))
    hit = peaks.where((F.col("before") > 0) & (F.col("after") * 10 >= F.col("before") * tenths))
    return hit.join(compactions.select("session_id", "turn_index").distinct(), ["session_id", "turn_index"], "left_semi").select("session_id", "turn_index")


def context_thrash(turns: DataFrame, compactions: DataFrame, priced: DataFrame, k: int = LOOK_AHEAD, gap: int = MAX_GAP) -> DataFrame:
    """Clusters of two or more refilled compactions with gaps of at most ``gap`` turns.

    The cost is that of the prompts, without output and each in its own context tier, of the ``k`` turns after every
    compaction but the cluster's first, each turn once; null if any request of them has no price.
    """
    order = W.partitionBy("session_id").orderBy("turn_index")
    hits = refills(turns, compactions, k).withColumn("new", (F.coalesce(F.col("turn_index") - F.lag("turn_index").over(order), F.lit(gap + 1)) > gap).cast("int"))
    hits = hits.withColumn("cluster", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    clusters = hits.groupBy("session_id", "cluster").agg(F.count("*").alias("n_compactions"), F.min("turn_index").alias("first"), F.max("turn_index").alias("last")).where("n_compactions >= 2")
    later = hits.join(clusters, ["session_id", "cluster"]).where("turn_index > first")
    slices = later.select("session_id", "cluster", F.explode(F.sequence("turn_index", F.col("turn_index") + (k - 1))).alias("turn_index")).distinct()
    cost = F.when(F.col("pico").isNotNull(), U.cost(output=False))
    used = slices.join(priced.withColumn("prompt_pico", cost), ["session_id", "turn_index"])
    sums = used.groupBy("session_id", "cluster").agg(F.sum(U.prompt_side()).alias("tokens"), F.sum("prompt_pico").cast(PICO).alias("s"), F.bool_and(F.col("prompt_pico").isNotNull()).alias("full"), F.countDistinct("turn_index").alias("n_turns"))
    return clusters.join(sums, ["session_id", "cluster"], "left").select("session_id", F.col("first").alias("first_turn"), "n_compactions", (F.col("last") - F.col("first")).alias("turn_span"), "n_turns", "tokens", F.when(F.col("full"), F.col("s")).alias("pico"))


def cost_shape(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Per session priced in full: cost before the first edit, the share of its three dearest turns, and late over early cost.

    ``edits`` has (session_id, turn_index) of edits. No edit: the first is null. An edit in the first turn: 0, not null.
    The ratio (one decimal) needs four turns: the mean of those from the middle on over the mean of those before.
    """
    first = edits.groupBy("session_id").agg(F.min("turn_index").alias("edit"))
    s = W.partitionBy("session_id")
    full = turns.withColumn("n", F.count("*").over(s)).withColumn("all", F.bool_and("complete").over(s)).where("all")
    full = full.withColumn("rank", F.row_number().over(s.orderBy(F.desc("pico"), "turn_index"))).withColumn("rn", F.row_number().over(s.orderBy("turn_index"))).withColumn("half", F.floor(F.col("n") / 2))
    sums = full.join(first, "session_id", "left").groupBy("session_id").agg(
        F.sum("pico").cast(PICO).alias("pico"), F.max("edit").alias("edit"), F.sum(F.when(F.col("turn_index") < F.col("edit"), F.col("pico")).otherwise(0)).cast(PICO).alias("before"),
        F.sum(F.when(F.col("rank") <= TOP_TURNS, F.col("pico"))).cast(PICO).alias("top"), F.max("n").alias("n_turns"),
        F.avg(F.when(F.col("rn") <= F.col("half"), F.col("pico").cast("double"))).alias("early"), F.avg(F.when(F.col("rn") > F.col("half"), F.col("pico").cast("double"))).alias("late"),
    )
    ratio = F.when((F.col("n_turns") >= LATE_TURNS) & (F.col("early") > 0), F.round(F.col("late") / F.col("early"), 1))
    return sums.select("session_id", "n_turns", "pico", F.when(F.col("edit").isNotNull(), F.col("before")).alias("pre_edit_pico"), F.col("top").alias("top3_pico"), ratio.alias("late_ratio"))


def time_caveats(sessions: DataFrame, turns: DataFrame, slack_ms: int = 120_000) -> DataFrame:
    """Sessions with a turn later than their file's time plus two minutes, or with usage but no span of time."""
    span = turns.groupBy("session_id").agg(F.max("ts_ms").alias("last"), F.min("ts_ms").alias("first"), F.sum("total").alias("tokens"))
    joined = sessions.select("session_id", "mtime_ms").join(span, "session_id")
    late, flat = F.col("last") > F.col("mtime_ms") + slack_ms, (F.col("last") <= F.col("first")) & (F.col("tokens") > 0)
    return joined.select("session_id", F.explode(F.filter(F.array(F.when(late, F.lit("turn after file time")), F.when(flat, F.lit("no span of time"))), lambda x: x.isNotNull())).alias("caveat"))


