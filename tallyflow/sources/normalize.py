"""Normalisers: from a producer's lines to requests, turns and calls.

Each works on (file, line_no, line) and keys everything by file, so one file is one window partition at most; columns are
cut down to what is needed before any shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions.text import epoch_ms, sanitize, truncate
from tallyflow.functions.usage import MOST_TOKENS

USAGE = "struct<input: bigint, output: bigint, cache_read: bigint, cache_creation: bigint, cc_5m: bigint, cc_1h: bigint, total: bigint>"


def get(path: str, line: str = "line") -> Column:
    return F.get_json_object(line, f"$.{path}")


def count(path: str) -> tuple[Column, Column]:
    """A token count, and whether something stands there that isn't one."""
    raw = get(path)
    n = F.when(raw.rlike(r"^\d{1,16}$"), F.expr(f"try_cast(get_json_object(line, '$.{path}') as bigint)"))
    n = F.when(n <= MOST_TOKENS, n)
    return n, raw.isNotNull() & n.isNull()


def _usage(**parts: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0))
    total = z(parts["input"]) + z(parts["output"]) + z(parts["cache_read"]) + z(parts["cache_creation"])
    return F.struct(*[z(parts[n]).cast("long").alias(n) for n in ("input", "output", "cache_read", "cache_creation")], *[parts.get(n, F.lit(None)).cast("long").alias(n) for n in ("cc_5m", "cc_1h")], total.cast("long").alias("total"))


# -- messages with ids and evolving snapshots -----------------------------------------------------------------

CONTENT = "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"


def after_fork(lines: DataFrame) -> DataFrame:
    """Lines after a file's last fork marker: what a fork inherits isn't its own."""
    w = W.partitionBy("file")
    fork = F.max(F.when(get("type") == "fork-context-ref", F.col("line_no"))).over(w)
    return lines.withColumn("_fork", fork).where("_fork is null or line_no > _fork").drop("_fork")


#: What the command line tool writes into a log by itself, and the words of a compaction in a record of its own.
ECHO = r"^\s*<(command-name|command-message|command-args|local-command-stdout|local-command-caveat)>"
COMPACTED = r"(?i)\bcontext (?:was |has been )?compacted\b"


def is_meta() -> Column:
    return F.coalesce(get("isMeta") == "true", F.lit(False))


def content_text() -> tuple[Column, Column, Column]:
    """Of a message's content: its text if it is one, the first text among its blocks, and the texts of all its blocks together."""
    raw = F.expr("try_variant_get(try_parse_json(line), '$.message.content', 'variant')")
    kind = F.schema_of_variant(raw)
    blocks = F.when(kind.like("ARRAY%"), F.from_json(get("message.content"), CONTENT))
    texts = F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"])
    firsts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(kind == "STRING", get("message.content")), F.get(firsts, F.lit(0)), F.array_join(texts, "")


def is_echo() -> Column:
    return F.coalesce(content_text()[0].rlike(ECHO), F.lit(False))


def claude_headers(lines: DataFrame) -> DataFrame:
    """(file, title, model, started_ms, ended_ms, cwd, branch, is_sidechain, n_user) of each log: what a list of sessions shows.

    The title is the last one that a model gave, else the first text of the user, without terminal sequences, at most 120 characters;
    what the command line tool echoed is no text of the user. Times, texts and models are of records that aren't meta;
    folder, branch and title also of those. Only lines after the last fork marker count. One aggregate a file.
    """
    text, block, _ = content_text()
    own = after_fork(lines)
    plain, user = ~is_meta(), get("type") == "user"
    said = F.when(plain & user & F.expr("try_variant_get(try_parse_json(line), '$.message', 'variant') is not null"), F.when(text.isNotNull(), F.when(~text.rlike(ECHO), text)).otherwise(block))
    kind = lambda p: F.schema_of_variant(F.expr(f"try_variant_get(try_parse_json(line), '$.{p}', 'variant')"))
    named = lambda p: F.when((kind(p) == "STRING") & (get(p) != ""), get(p))
    rows = own.select(
        "file", "line_no", F.when((get("type") == "ai-title") & (kind("aiTitle") == "STRING"), get("aiTitle")).alias("given"), said.alias("said"), F.when(plain, epoch_ms(get("timestamp"))).alias("ts_ms"),
        F.when(plain & (get("type") == "assistant") & ~is_echo(), get("message.model")).alias("model"), named("cwd").alias("cwd"), named("gitBranch").alias("branch"), (get("isSidechain") == "true").alias("side"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    out = rows.groupBy("file").agg(
        F.max_by("given", F.when(F.col("given").isNotNull(), F.col("line_no"))).alias("given"), first("said"), first("model"), F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), first("cwd"), first("branch"),
        F.coalesce(F.max("side"), F.lit(False)).alias("is_sidechain"), F.count("said").alias("n_user"),
    )
    shown = lambda c: F.nullif(truncate(sanitize(F.col(c))), F.lit(""))
    return out.select("file", F.coalesce(shown("given"), shown("said")).alias("title"), "model", "started_ms", "ended_ms", "cwd", "branch", "is_sidechain", "n_user")


def claude_usage() -> tuple[Column, Column]:
    """(usage, valid). The flat count of cache writes wins over the split; a split that contradicts it is left out."""
    n, bad = zip(*(count(f"message.usage.{p}") for p in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation.ephemeral_5m_input_tokens", "cache_creation.ephemeral_1h_input_tokens")))
    split = F.coalesce(n[4], F.lit(0)) + F.coalesce(n[5], F.lit(0))
    written = F.coalesce(n[3], F.when(n[4].isNotNull() | n[5].isNotNull(), split))
    fits = split <= F.coalesce(written, F.lit(0))
    wrong = bad[0]
    for b in bad[1:4]:
        wrong = wrong | b
    usage = _usage(input=n[0], output=n[1], cache_read=n[2], cache_creation=written, cc_5m=F.when(fits, n[4]), cc_1h=F.when(fits, n[5]))
    return usage, get("message.usage").isNotNull() & ~wrong


def merge_snapshots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the one coherent usage of most output: a valid one before an invalid one, the later on ties.

    ``rows`` has keys, line_no, usage, valid. An aggregate, not a window, so that snapshots combine before the shuffle.
    """
    best = F.max_by(F.struct("usage", "valid"), F.struct("valid", F.when(F.col("valid"), F.col("usage.output")).otherwise(-1), "line_no"))
    return rows.groupBy(*keys).agg(best.alias("b"), F.min("line_no").alias("first_line")).select(*keys, "first_line", "b.usage", "b.valid")


def claude_turns(lines: DataFrame) -> DataFrame:
    """One row a message id: file, turn_index, key, model, ts_ms, usage, units_state. Usage that can't be trusted is no unit at all.

    A line without an id is a turn of its own; its usage goes to ``claude_unattributed``.
    """
    usage, valid = claude_usage()
    own = after_fork(lines).where((get("type") == "assistant") & ~is_meta() & ~is_echo())
    rows = own.select("file", "line_no", F.coalesce(get("message.id"), F.concat(F.lit("line:"), F.col("line_no").cast("string"))).alias("key"), get("message.id").isNotNull().alias("named"), get("message.model").alias("model"), epoch_ms(get("timestamp")).alias("ts_ms"), usage.alias("usage"), valid.alias("valid"), get("message.usage").isNotNull().alias("has_usage"))
    turns = rows.groupBy("file", "key").agg(F.min("line_no").alias("first_line"), F.min_by("ts_ms", "line_no").alias("ts_ms"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_no"))).alias("model"), F.bool_or(F.col("has_usage") & F.col("named")).alias("has_usage"))
    merged = merge_snapshots(rows.where("named and has_usage"), ["file", "key"]).drop("first_line")
    out = turns.join(merged, ["file", "key"], "left")
    state = F.when(~F.col("has_usage"), "none").when(F.col("valid"), "implicit").otherwise("explicit")
    return out.select("file", (F.row_number().over(W.partitionBy("file").orderBy("first_line")) - 1).cast("long").alias("turn_index"), "key", "model", "ts_ms", F.when(F.col("valid"), F.col("usage")).alias("usage"), state.alias("units_state"))


def claude_unattributed(lines: DataFrame) -> DataFrame:
    """Per file the best single snapshot of usage without a message id."""
    usage, valid = claude_usage()
    rows = after_fork(lines).where((get("type") == "assistant") & get("message.id").isNull() & get("message.usage").isNotNull() & ~is_meta() & ~is_echo()).select("file", "line_no", usage.alias("usage"), valid.alias("valid"))
    return merge_snapshots(rows, ["file"]).drop("first_line")


def claude_calls(lines: DataFrame) -> DataFrame:
    """Calls with their results: the first call of an id counts, and the last result of it."""
    items = after_fork(lines).select("file", "line_no", epoch_ms(get("timestamp")).alias("ts_ms"), F.coalesce(get("message.id"), F.concat(F.lit("line:"), F.col("line_no").cast("string"))).alias("key"), F.posexplode(F.from_json(get("message.content"), CONTENT)).alias("place", "c"))
    used = items.where("c.type = 'tool_use' and c.id is not null").groupBy("file", F.col("c.id").alias("id")).agg(F.min_by(F.struct("key", "line_no", "place", "c.name", "c.input", "ts_ms"), F.struct("line_no", "place")).alias("u"))
    result = items.where("c.type = 'tool_result'").groupBy("file", F.col("c.tool_use_id").alias("id")).agg(F.max_by(F.struct("c.content", "c.is_error", "ts_ms"), F.struct("line_no", "place")).alias("r"))
    status = F.when(F.col("r").isNull(), "running").when(F.col("r.is_error"), "error").otherwise("ok")
    joined = used.join(result, ["file", "id"], "left")
    ordered = W.partitionBy("file").orderBy("u.line_no", "u.place")
    return joined.select("file", "id", F.col("u.key").alias("key"), (F.row_number().over(ordered) - 1).cast("long").alias("call_ord"), F.col("u.name").alias("name"), (F.col("u.name") == "Bash").alias("is_shell"), F.col("u.input").alias("input_json"), F.col("r.content").alias("output"), status.alias("status"), F.col("u.ts_ms").alias("started_ms"), F.col("r.ts_ms").alias("ended_ms"))


def claude_compactions(lines: DataFrame) -> DataFrame:
    """(file, turn_index of the next turn, ts_ms): the first definite marker before each turn."""
    own = after_fork(lines)
    text, _, blocks = content_text()
    told = is_meta() & (get("type") == "user") & F.coalesce(text, blocks).rlike(COMPACTED)
    marker = get("type").isin("compact-summary", "compact_boundary", "compact-boundary") | F.coalesce(get("isCompactSummary") == "true", F.lit(False)) | F.coalesce(told, F.lit(False))
    key = F.when((get("type") == "assistant") & ~is_meta() & ~is_echo(), F.coalesce(get("message.id"), F.concat(F.lit("line:"), F.col("line_no").cast("string"))))
    rows = own.select("file", "line_no", epoch_ms(get("timestamp")).alias("ts_ms"), F.coalesce(marker, F.lit(False)).alias("marker"), key.alias("key"))
    first = rows.withColumn("new", (F.col("key").isNotNull() & (F.row_number().over(W.partitionBy("file", "key").orderBy("line_no")) == 1)).cast("int"))
    at = first.withColumn("turn_index", F.coalesce(F.sum("new").over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return at.where("marker").groupBy("file", "turn_index").agg(F.min_by("ts_ms", "line_no").alias("ts_ms"))


# -- cumulative counters --------------------------------------------------------------------------------------


def cumulative_deltas(snapshots: DataFrame, key: str = "file", order: str = "line_no", counts: tuple[str, ...] = ("input", "output", "cache_read")) -> DataFrame:
    """From running totals to what each request added: a snapshot equal to the one before is none; the first counts whole.

    That fits counters that begin at 0. Where a log may go on with another's totals, see ``requests``.
    ``monotone`` is false where a total fell; then nothing of the key's requests can be trusted (see ``trusted``).
    """
    w = W.partitionBy(key).orderBy(order)
    out = snapshots
    changed, monotone = F.lit(False), F.lit(True)
    for c in counts:
        before = F.lag(c, 1, 0).over(w)
        out = out.withColumn(f"d_{c}", F.greatest(F.lit(0), F.col(c) - before)).withColumn(f"_m_{c}", F.col(c) >= before).withColumn(f"_c_{c}", F.col(c) != before)
        changed, monotone = changed | F.col(f"_c_{c}"), monotone & F.col(f"_m_{c}")
    return out.withColumn("monotone", monotone).where(changed).drop(*[f"_{x}_{c}" for c in counts for x in "mc"])


def requests(snapshots: DataFrame, key: str = "file", order: str = "line_no", counts: tuple[str, ...] = ("input", "output", "cache_read")) -> DataFrame:
    """From running totals with each request's own report to billed requests, one row a changed snapshot.

    Each count ``c`` has a total and a report ``last_c`` (null: none). The first snapshot bills its report; the rest of its total
    is ``base_c``, inherited from an earlier log and never billed. Later ones bill what the total grew by (``d_c``); a snapshot
    equal to the one before is no request, whatever it reports. A total of 0 without a report is no
    snapshot. ``consistent`` is false for all rows of a key if the first has no report above 0 or one above its total, a total
    falls, or a report is missing or isn't what the total grew by. Such a key has no billable request; ``over_c`` is what its totals reached above the base, to be kept as unattributed.
    """
    w = W.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    every = lambda parts: functools.reduce(lambda x, y: x & y, parts)
    first = F.lag(F.lit(True), 1, False).over(w) == F.lit(False)
    reported = F.coalesce(every([F.col(f"last_{c}").isNotNull() for c in counts]) & (sum((F.col(f"last_{c}") for c in counts), F.lit(0)) > 0), F.lit(False))
    nothing = every([F.coalesce(F.col(c), F.lit(0)) == 0 for c in counts])
    out = snapshots.where(~nothing | reported).withColumns({"_first": first, "_reported": reported, **{f"_was_{c}": F.lag(c).over(w) for c in counts}})
    out = out.withColumns({f"d_{c}": F.when(F.col("_first"), F.coalesce(f"last_{c}", F.lit(0))).otherwise(F.col(c) - F.col(f"_was_{c}")) for c in counts})
    changed = F.col("_first") | ~every([F.col(f"d_{c}") == 0 for c in counts])
    opens = every([F.col(c) >= F.col(f"d_{c}") for c in counts])
    follows = every([(F.col(f"d_{c}") >= 0) & (F.col(f"d_{c}") == F.col(f"last_{c}")) for c in counts])
    fine = F.when(~changed, True).otherwise(F.col("_reported") & F.when(F.col("_first"), opens).otherwise(F.coalesce(follows, F.lit(False))))
    base = {f"base_{c}": F.first(F.when(F.col("_reported"), F.col(c) - F.col(f"d_{c}")).otherwise(0)).over(whole) for c in counts}
    out = out.withColumns({"_changed": changed, "consistent": F.bool_and(fine).over(whole), **base})
    out = out.withColumns({f"over_{c}": F.greatest(F.lit(0), F.max(c).over(W.partitionBy(key)) - F.col(f"base_{c}")) for c in counts})
    return out.where("_changed").drop("_first", "_reported", "_changed", *[f"_was_{c}" for c in counts])


def trusted(deltas: DataFrame, key: str = "file") -> DataFrame:
    """Rows of keys all of whose snapshots are consistent: one bad row drops the key's requests altogether."""
    return deltas.withColumn("_all", F.bool_and("monotone").over(W.partitionBy(key))).where("_all").drop("_all")


def last_seen(rows: DataFrame, column: str, key: str = "file", order: str = "line_no") -> DataFrame:
    """A column that holds until it is set again."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def segment_turns(rows: DataFrame, closes: Column, key: str = "file", order: str = "line_no") -> DataFrame:
    """Adds turn_index: a row for which ``closes`` holds (a user's message) ends the turn; stretches without other rows are no turns."""
    w = W.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_closes", F.coalesce(closes, F.lit(False))).withColumn("_island", F.sum(F.col("_closes").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.where("not _closes").withColumn("turn_index", (F.dense_rank().over(W.partitionBy(key).orderBy("_island")) - 1).cast("long")).drop("_closes", "_island")


def pair_compactions(rows: DataFrame, within_ms: int = 5000) -> DataFrame:
    """One event for two markers of opposite forms before the same turn and within five seconds; (file, turn_index, ts_ms).

    ``rows`` has file, line_no, form, turn_index, ts_ms. Pairing depends on what was paired before, so a file's markers
    stream through one task in order; it holds one marker at a time.
    """
    names = ["file", "turn_index", "ts_ms"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            out = []
            for file, form, turn, ts in zip(*(b.column(i).to_pylist() for i in range(4))):
                if before is not None and before[0] == file and before[2] == turn and before[1] != form and (ts is None or before[3] is None or abs(ts - before[3]) <= within_ms):
                    before = None
                    continue
                out.append((file, turn, ts))
                before = (file, form, turn, ts)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names)

    ordered = rows.repartition("file").sortWithinPartitions("file", F.asc_nulls_last("line_no"))
    return ordered.select("file", "form", "turn_index", "ts_ms").mapInArrow(pair, "file string, turn_index long, ts_ms long")


# -- rewinds and checkpoints ----------------------------------------------------------------------------------


def replay(lines: DataFrame) -> DataFrame:
    """The messages that are left of a log with rewinds and checkpoints: (file, place, id, message).

    A message of a known id replaces the earlier one in its place. ``$rewindTo`` drops that message and all after it;
    ``$set.messages`` replaces all; a target that is no known id changes nothing. Every step depends on the state before it, so a file's lines stream through one task
    in order; it holds the messages that are left of one file.
    """
    import json

    def step(kept: dict[str, str], line: str) -> dict[str, str]:
        try:
            r = json.loads(line)
        except ValueError:
            return kept
        if not isinstance(r, dict):
            return kept
        if "$rewindTo" in r:
            ids, to = list(kept), r["$rewindTo"]
            if isinstance(to, str) and to in kept:
                for gone in ids[ids.index(to) :]:
                    del kept[gone]
        elif isinstance(r.get("$set"), dict) and isinstance(r["$set"].get("messages"), list):
            return {m["id"]: json.dumps(m) for m in r["$set"]["messages"] if isinstance(m, dict) and isinstance(m.get("id"), str)}
        elif isinstance(r.get("id"), str):
            kept[r["id"]] = line
        return kept

    def left(file: str | None, kept: dict[str, str]) -> Iterator[pa.RecordBatch]:
        some = []
        for i, (k, v) in enumerate(kept.items()):
            some.append((file, i, k, v))
            if len(some) == 1000 or i == len(kept) - 1:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in some], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "place", "id", "message"])
                some = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, kept = None, {}
        for b in batches:
            for f, line in zip(b.column(0).to_pylist(), b.column(1)):
                if f != file:
                    yield from left(file, kept)
                    file, kept = f, {}
                line = line.as_py()
                if line is not None:
                    kept = step(kept, line)
        yield from left(file, kept)

    ordered = lines.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", F.asc_nulls_last("line_no"))
    return ordered.select("file", "line").mapInArrow(run, "file string, place long, id string, message string")


def gemini_turns(lines: DataFrame) -> DataFrame:
    """Model messages of what a replay leaves: cached input is taken off input, tool tokens join it, thoughts join output."""
    m = replay(lines).withColumnRenamed("message", "line").where(get("type") == "gemini")
    n = lambda x: F.coalesce(F.expr(f"try_cast(get_json_object(line, '$.tokens.{x}') as bigint)"), F.lit(0))
    usage = _usage(input=F.greatest(F.lit(0), n("input") - n("cached")) + n("tool"), output=n("output") + n("thoughts"), cache_read=n("cached"), cache_creation=F.lit(0))
    return m.select("file", (F.row_number().over(W.partitionBy("file").orderBy("place")) - 1).cast("long").alias("turn_index"), "id", get("model").alias("model"), epoch_ms(get("timestamp")).alias("ts_ms"), F.when(get("tokens").isNotNull(), usage).alias("usage"))


# -- databases ------------------------------------------------------------------------------------------------


def read_sqlite(spark, paths: list[str], query: str, schema: str) -> DataFrame:
    """Rows of one query over many SQLite files, a file a task; a file that can't be opened gives none. Adds ``file``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                        cursor = db.execute(query)
                        names = [d[0] for d in cursor.description]
                        while rows := cursor.fetchmany(10_000):
                            yield pa.RecordBatch.from_pydict({**{n: [None if r[k] is None else r[k] for r in rows] for k, n in enumerate(names)}, "file": [path] * len(rows)})
                except sqlite3.Error:
                    continue

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, f"{schema}, file string")


def cursor_turns(kv: DataFrame) -> DataFrame:
    """From (file, key, value) of a key-value store: header order gives the bubbles, a user's bubble ends the turn. No usage: unpriceable."""
    composers = kv.where(F.col("key").startswith("composerData:") & (F.col("value") != "null")).select("file", F.substring_index("key", ":", -1).alias("session_id"), F.posexplode(F.from_json(F.get_json_object("value", "$.fullConversationHeadersOnly"), "array<struct<bubbleId: string, type: int>>")).alias("place", "h"))
    bubbles = kv.where(F.col("key").startswith("bubbleId:")).select("file", F.split("key", ":")[1].alias("session_id"), F.split("key", ":")[2].alias("bubble"), "value")
    joined = composers.select("file", "session_id", F.col("place").cast("long").alias("line_no"), F.col("h.bubbleId").alias("bubble"), F.col("h.type").alias("type")).join(bubbles, ["file", "session_id", "bubble"])
    joined = joined.withColumn("sid", F.concat_ws("#", "file", "session_id"))
    turns = segment_turns(joined, F.col("type") == 1, key="sid")
    tool = F.coalesce(F.get_json_object("value", "$.toolFormerData.name"), F.concat(F.lit("tool_"), F.get_json_object("value", "$.toolFormerData.tool")))
    return turns.select("file", "session_id", "turn_index", "line_no", tool.alias("tool"), F.get_json_object("value", "$.toolFormerData.status").alias("status"))


def reconcile_aggregate(sessions: DataFrame, itemised: DataFrame, counts: tuple[str, ...] = ("input", "output", "cache_read", "cache_creation")) -> DataFrame:
    """A session's own totals against the sum of its messages: what is left over is unattributed; where they cross, conflicting.

    Both have session_id and the counts. ``state``: equal, residual (the totals dominate), items (the messages do) or conflicting.
    """
    j = sessions.alias("s").join(itemised.alias("i"), "session_id", "left")
    z = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0))
    up, down = F.lit(True), F.lit(True)
    for c in counts:
        up, down = up & (z("s", c) >= z("i", c)), down & (z("s", c) <= z("i", c))
    state = F.when(up & down, "equal").when(up, "residual").when(down, "items").otherwise("conflicting")
    left = [F.when(up, z("s", c) - z("i", c)).otherwise(0).cast("long").alias(f"rest_{c}") for c in counts]
    return j.select("session_id", state.alias("state"), *left)


def opencode_messages(rows: DataFrame) -> DataFrame:
    """Messages of (session_id, id, seq, data): strict counts, reasoning as output; a provider that is missing blocks pricing."""
    n = lambda x: F.expr(f"case when get_json_object(data, '$.tokens.{x}') rlike '^[0-9]{{1,15}}$' then cast(get_json_object(data, '$.tokens.{x}') as bigint) end")
    d = lambda x: F.get_json_object("data", f"$.{x}")
    provider = F.coalesce(d("model.providerID"), d("providerID"))
    usage = _usage(input=n("input"), output=F.coalesce(n("output"), F.lit(0)) + F.coalesce(n("reasoning"), F.lit(0)), cache_read=n("cache.read"), cache_creation=n("cache.write"))
    direct = provider.isin("anthropic", "openai", "google")
    return rows.select("session_id", "id", "seq", F.coalesce(d("model.id"), d("modelID")).alias("model"), F.when(d("tokens").isNotNull(), usage).alias("usage"), F.when(direct, "direct").otherwise("blocked").alias("provider_state"), F.when(direct, provider).alias("provider"))
