"""Billed requests of logs that report running totals, and whether a log's reports prove them.

A log is a file's lines. Its records may hold a running total beside what the last request used, or, in older logs, the usage
of one message. Requests are billed only where all of a log's evidence agrees; else its largest coherent count is kept
once, as tokens of no request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions.text import epoch_ms
from tallyflow.functions.usage import MOST_TOKENS
from tallyflow.sources import normalize as N

PARTS = ("input", "output", "cache_read")
#: Providers whose own prices apply (fixed values); any other that is named has none.
DIRECT = ("anthropic", "openai", "google", "deepseek")


_FIELDS = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens", "total_tokens")


def usage_of(variant: str) -> Column:
    """(has, bad, ok, input, output, cache_read, total) of a variant column that should hold a usage object.

    Cached input is part of the input, reasoning part of the output. ``bad``: something stands there that isn't such an object,
    a count isn't a whole number from 0, a part exceeds its whole, or the stated total isn't input and output together.
    """
    kind = lambda p: f"schema_of_variant(try_variant_get({variant}, '{p}', 'variant'))"
    n = lambda f: f"try_variant_get({variant}, '$.{f}', 'bigint')"
    z = lambda f: f"coalesce({n(f)}, 0)"
    whole = f"({z('input_tokens')} + {z('output_tokens')})"
    wrong = [f"coalesce({kind('$.' + f)} <> 'BIGINT' or not {n(f)} between 0 and {MOST_TOKENS}, false)" for f in _FIELDS]
    wrong += [f"{z('cached_input_tokens')} > {z('input_tokens')}", f"{z('reasoning_output_tokens')} > {z('output_tokens')}", f"coalesce({n('total_tokens')} <> {whole}, false)", f"{whole} > {MOST_TOKENS}"]
    present, is_object, broken = f"coalesce(schema_of_variant({variant}) <> 'VOID', false)", f"coalesce(schema_of_variant({variant}) like 'OBJECT%', false)", " or ".join(wrong)
    return F.expr(f"""named_struct('has', schema_of_variant({variant}) is not null, 'bad', {present} and (not {is_object} or {broken}), 'ok', {is_object} and not ({broken}),
      'input', {z("input_tokens")} - {z("cached_input_tokens")}, 'output', {z("output_tokens")}, 'cache_read', {z("cached_input_tokens")}, 'total', {whole})""")


def records(lines: DataFrame) -> DataFrame:
    """Each line's record: ``dropped`` if it is no JSON object, turn_index, model and provider in force, and ``total``, ``last`` and
    ``message`` as ``usage_of`` gives them. A line is parsed once; lines of the user end a turn and are left out."""
    rows = lines.select("file", "line_no", F.try_parse_json("line").alias("top"))
    inner = [f"if(schema_of_variant(try_variant_get(top, '$.{k}', 'variant')) like 'OBJECT%', try_variant_get(top, '$.{k}', 'variant'), null)" for k in ("payload", "item", "response")]
    rows = rows.select("file", "line_no", "top", F.expr(f"coalesce({', '.join(inner)}, top)").alias("item"))
    text = lambda of, p: f"try_variant_get({of}, '$.{p}', 'string')"
    raw = lambda of, p: F.expr(f"try_variant_get({of}, '$.{p}', 'variant')")
    rows = rows.select(
        "file", "line_no", F.expr("not coalesce(schema_of_variant(top) like 'OBJECT%', false)").alias("dropped"), F.expr(f"coalesce({text('item', 'type')}, {text('top', 'type')}, '')").alias("kind"), F.expr(text("item", "role")).alias("role"), F.expr(text("item", "model")).alias("model"),
        F.coalesce(raw("item", "model_provider"), raw("top", "model_provider")).alias("named"), F.expr(f"coalesce({text('top', 'timestamp')}, {text('top', 'created_at')}, {text('top', 'time')})").alias("at"),
        raw("item", "info.total_token_usage").alias("total"), raw("item", "info.last_token_usage").alias("last"), F.coalesce(raw("item", "usage"), raw("top", "usage")).alias("message"),
    )
    provider = "lower(trim(try_variant_get(named, '$', 'string')))"
    state = F.expr(f"case when schema_of_variant(named) is null then null when {provider} in {DIRECT} then {provider} else '' end")
    rows = rows.select("file", "line_no", "dropped", "kind", "role", "model", state.alias("provider"), epoch_ms(F.col("at")).alias("ts_ms"), *[usage_of(u).alias(u) for u in ("total", "last", "message")])
    rows = N.last_seen(N.last_seen(rows, "model"), "provider")
    return N.segment_turns(rows, (F.col("kind") == "user_message") | ((F.col("kind") == "message") & (F.col("role") == "user")))


def judged(lines: DataFrame) -> DataFrame:
    """The records with what they ask to be billed and what speaks against it: ``request`` (null: none), ``base`` at the first
    running total, ``counted`` (the log's own share of a running total), ``single`` (one message's usage before any), and ``faults``.

    The first running total bills its report; the rest of it is the base, inherited from an earlier log. Later ones bill what
    the total grew by; one that is equal to the one before is no request, whatever it reports. A total of 0 is none.
    All windows are over a file's lines in order, so rows are dealt and sorted once.
    """
    before = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = lambda make: F.struct(*[make(p).cast("long").alias(p) for p in PARTS])
    both = lambda test: " and ".join(test.format(p=p) for p in PARTS)
    rows = records(lines).withColumn("counts", F.expr("total.ok and total.total > 0"))
    rows = rows.withColumn("was", F.last(F.when(F.col("counts"), F.col("total")), ignorenulls=True).over(before))
    rows = rows.withColumn("first", F.expr("counts and was is null")).withColumn("reports", F.expr("last.ok and last.total > 0"))
    rows = rows.withColumn("changed", F.expr(f"counts and (was is null or not ({both('total.{p} = was.{p}')}))"))
    rows = rows.withColumn("single", F.expr("was is null and not counts and message.ok and message.total > 0"))
    grown = parts(lambda p: F.greatest(F.lit(0), F.col(f"total.{p}") - F.col(f"was.{p}")))
    request = F.when(F.col("first"), F.when(F.col("reports"), parts(lambda p: F.col(f"last.{p}")))).when(F.col("changed"), grown).when(F.col("single"), parts(lambda p: F.col(f"message.{p}")))
    base = F.when(F.col("first"), parts(lambda p: F.when(F.col("reports"), F.greatest(F.lit(0), F.col(f"total.{p}") - F.col(f"last.{p}"))).otherwise(0)))
    rows = rows.withColumn("request", request).withColumn("base", base)
    rows = rows.withColumn("inherited", F.last("base", ignorenulls=True).over(upto)).withColumn("counted", F.when(F.col("counts"), parts(lambda p: F.greatest(F.lit(0), F.col(f"total.{p}") - F.col(f"inherited.{p}")))))
    opens, follows = both("total.{p} >= last.{p}"), both("total.{p} >= was.{p}") + " and " + both("total.{p} - was.{p} = last.{p}")
    reasons = {
        "dropped": "dropped", "malformed": "total.bad or last.bad or (was is null and not counts and message.bad)", "mixed": "first and had_single", "report-alone": "last.has and (not total.ok or (total.total = 0 and reports))",
        "totals": f"changed and not (reports and if(was is null, {opens}, {follows}))",
    }
    rows = rows.withColumn("had_single", F.coalesce(F.max("single").over(before), F.lit(False)))
    return rows.withColumn("faults", F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(r)) for r, c in reasons.items()])))


def evidence(lines: DataFrame) -> DataFrame:
    """(file, reasons, n_requests, input, output, cache_read, inherited) of every log with a count.

    ``reasons`` (sorted) tell what voids a log's requests: ``dropped`` lines, ``malformed`` counts, a report without its running total
    (``report-alone``), usage of single messages before running totals (``mixed``), or ``totals`` that fall, begin without a report or
    don't grow by it. Without reasons the counts are the sum of the billed requests, else the log's largest coherent count: what its
    running totals (or else its single messages) come to, or the largest that one record shows. ``inherited`` is what the first
    running total held from an earlier log.
    """
    rows = judged(lines)
    size = lambda u: " + ".join(f"{u}.{p}" for p in PARTS)
    plain = lambda u: F.struct(*[F.col(f"{u}.{p}").alias(p) for p in PARTS])
    # of one record's counts the greatest, the earlier of equals: report, running total, single message
    shown = F.array(F.when(F.col("reports"), plain("last")), F.col("counted"), F.when(F.col("single"), plain("message")))
    rows = rows.withColumn("shown", shown)
    rows = rows.withColumn("most", F.expr("array_max(transform(filter(transform(shown, (u, i) -> struct(u as u, i as i)), x -> x.u is not null), x -> struct(x.u.input + x.u.output + x.u.cache_read as n, -x.i as i, x.u as u)))"))
    a = rows.groupBy("file").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("faults")))).alias("reasons"), F.count_if(F.expr(f"{size('request')} > 0")).alias("n"), *[F.sum(f"request.{p}").alias(f"sum_{p}") for p in PARTS], F.max(total_of("base")).alias("inherited"),
        F.max_by("counted", F.when(F.col("counts"), F.col("line_no"))).alias("last"), F.max(F.expr("coalesce(counts, false)")).alias("any_total"), F.max_by("most.u", F.when(F.col("most").isNotNull(), F.struct("most.n", -F.col("line_no")))).alias("most"),
        F.max(F.expr("counts or message.ok or last.ok or total.bad or last.bad or message.bad")).alias("any"),
    ).where("any")
    end = F.when(F.col("any_total"), F.col("last")).otherwise(F.struct(*[F.coalesce(f"sum_{p}", F.lit(0)).alias(p) for p in PARTS]))
    a = a.withColumn("end", end).withColumn("kept", F.expr(f"if(most is null or {size('end')} >= {size('most')}, end, most)"))
    fine = F.size("reasons") == 0
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return a.select("file", "reasons", F.when(fine, z("n")).otherwise(0).cast("long").alias("n_requests"), *[F.when(fine, z(f"sum_{p}")).otherwise(z(F.col(f"kept.{p}"))).alias(p) for p in PARTS], z("inherited").alias("inherited"))


def total_of(u: str) -> Column:
    """All parts of a usage together."""
    return F.expr(" + ".join(f"{u}.{p}" for p in PARTS))


def units(lines: DataFrame) -> DataFrame:
    """The billed requests of logs without a reason against them: (file, line_no, turn_index, model, provider_state, provider, ts_ms, input,
    output, cache_read).

    ``provider_state``: absent where no record so far names a provider, direct for one with prices of its own, else blocked.
    """
    rows = judged(lines).withColumn("void", F.max(F.size("faults") > 0).over(W.partitionBy("file")))
    found = rows.where("not void").where(total_of("request") > 0)
    state = F.when(F.col("provider").isNull(), "absent").when(F.col("provider") == "", "blocked").otherwise("direct")
    return found.select("file", "line_no", "turn_index", "model", state.alias("provider_state"), F.nullif("provider", F.lit("")).alias("provider"), "ts_ms", "request.*")
