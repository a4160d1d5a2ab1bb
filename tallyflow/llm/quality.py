"""Quality rules as a bitmask ledger; DataFrame and SQL functions only.

``ledger`` measures each text once and stores which rules it fails, one bit a rule.  Everything after that is integer
work on the ledger: ``apply_policy`` keeps rows under a versioned set of rules, ``ablate`` tells for each rule how many
rows it rejects, how many only it rejects, and how many a policy would keep without it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A row fails where ``fails`` (SQL over the measurements) is true."""

    name: str
    fails: str


#: Bit k is the k-th rule. New rules go to the end, so that stored ledgers keep their meaning.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("too_many_words", "n_words > 100000"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_ratio", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("mean_word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("few_letters", "10 * n_letters < 6 * word_chars"),
    Rule("exclamations", "10 * n_exclaim > 3 * n_words"),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}

#: Versioned policies: the rules that reject.
POLICIES = {
    "v0-base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "too_many_words", "repeated_windows", "symbol_ratio", "duplicate_lines", "mean_word_length", "shouting", "few_letters", "exclamations"),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeat_words(words: str) -> str:
    """SQL for the number of words that lie in a 3-word window found twice or more, of the array of words.

    A window is the hash of its words. The fast part (all windows differ) is one hash set; the rest sorts (hash,
    position), keeps positions beside an equal hash, and adds up how far each kept window reaches past the one before.
    """
    windows = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    repeats = "transform(filter(s, (x, i) -> if(i > 0, s[greatest(i - 1, 0)].h = x.h, false) or if(i < size(s) - 1, s[least(i + 1, size(s) - 1)].h = x.h, false)), x -> x.p)"
    covered = "aggregate(transform(q, (p, i) -> if(i = 0, 3, least(3, p - q[greatest(i - 1, 0)]))), 0L, (a, x) -> a + x)"
    sort = "array_sort(transform(w, (h, p) -> struct(h, p)))"
    return f"""if(size({words}) < 3, 0L, transform(array({windows}), w -> if(size(array_distinct(w)) = size(w), 0L,
        transform(array({sort}), s -> transform(array(sort_array({repeats})), q -> {covered})[0])[0]))[0])""".replace("array_sort(", "sort_array(")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, the measurements and ``fail_bits``.

    A null text is one without words; it and the empty text fail ``too_few_words`` and nothing else. Repeated rows are
    measured each on its own. Texts are measured whole, in one pass without a shuffle. Other columns aren't read.
    """
    t = F.coalesce(F.col("_t"), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))
    bare = F.translate(t, SPACE, "")
    split = base.select("doc_id", t.alias("t"), F.expr("regexp_extract_all(coalesce(_t, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)").alias("w"))
    t = F.col("t")
    bare = F.translate(t, SPACE, "")
    lines = F.expr("transform(array(filter(split(t, '\\n'), x -> length(translate(x, ' \\t\\u000b\\u000c\\r', '')) > 0)), l -> struct(size(l) as n, size(l) - size(array_distinct(l)) as d))[0]")
    measured = split.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("l"),
        F.expr(_repeat_words("w")).alias("n_repeat_words"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"), F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_exclaim"),
    ).withColumn("n_lines", F.col("l.n").cast("long")).withColumn("n_dup_lines", F.col("l.d").cast("long")).drop("l")
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(0)
    return measured.withColumn("fail_bits", bits)


def rejects(policy: str, bits: Column | None = None) -> Column:
    """True where the ledger's row fails a rule of the policy."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds the boolean ``kept``."""
    return rows.withColumn("kept", ~rejects(policy))


def ablate(rows: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: rows that fail it, that fail only it, and that the policy keeps without it.

    One aggregation over the distinct bit patterns, of which there are at most 2^rules; nothing is measured again.
    """
    m = mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    each = patterns.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"), total(F.col("bits") == F.col("r.bit")).alias("failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
    )
    return out.withColumn("policy", F.lit(policy))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document; a null text has no words and fails, an empty table has no rows."""
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), "v1")
    failed = rejects("v0-base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "fail_bits", "n_lines", "n_upper", "n_letters", "n_exclaim")


QUERIES = {"op3_quality_rules": op3_quality_rules}

_W = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_W}') AS w FROM d),
p AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_W}')),
k AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
  CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaim
  FROM w LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)),
f AS (SELECT *, {" + ".join(f"CAST(CASE WHEN {r.fails} THEN {BIT[r.name]} ELSE 0 END AS BIGINT)" for r in RULES)} AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask("v0-base")} <> 0 AS base_failed,
  fail_bits & {mask("v0-base") | mask("v1")} = 0 AS kept, fail_bits, n_lines, n_upper, n_letters, n_exclaim FROM f""",
}
