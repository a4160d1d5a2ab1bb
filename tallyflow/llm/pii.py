"""Personal data in texts: patterns propose, checksums confirm, context words adjust; DataFrame and SQL functions only.

Each kind of ``KINDS`` has a pattern that proposes spans, a validator in SQL (Luhn, mod 97, ranges of digits), a score
to start from, and words that raise the score where they stand shortly before the span. The first four kinds are kept
whenever their validator holds; the others need ``THRESHOLD`` as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import table


@dataclass(frozen=True)
class Kind:
    name: str
    #: No group; quantifiers are possessive where that can't change the match, so that long runs can't backtrack.
    pattern: str
    #: SQL that is true for texts that may hold a match; saves the pattern's work on the others.
    hint: str
    #: SQL over the matched text ``m``.
    valid: str
    score: float
    context: str
    always: bool = True


def _digits(m: str = "m") -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str = "m") -> str:
    each = "transform(split(reverse(d), ''), (c, i) -> case when i % 2 = 0 then cast(c as int) when cast(c as int) > 4 then 2 * cast(c as int) - 9 else 2 * cast(c as int) end)"
    return f"transform(array({_digits(m)}), d -> if(length(d) between 14 and 19, aggregate({each}, 0, (a, x) -> a + x) % 10 = 0, false))[0]"


def _mod97(m: str = "m") -> str:
    """The four first characters go to the end, letters count as 10 to 35, and the number is 1 modulo 97."""
    s = f"replace(concat(substr({m}, 5), substr({m}, 1, 4)), ' ', '')"
    step = "case when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end"
    return f"transform(array({s}), s -> if(length(s) between 15 and 34, aggregate(split(s, ''), 0, (a, c) -> {step}) = 1, false))[0]"


_OCTET = "length(ltrim('0', p)) <= 3 and coalesce(try_cast(right(p, 3) as int), 0) <= 255"

#: A span's kind sorts by its place here.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "t rlike '[0-9]'", f"forall(split(m, '[.]'), p -> {_OCTET})", 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9]'", _luhn(), 0.7, "card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", f"length({_digits()}) between 10 and 15", 0.7, "phone|call|tel|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "t rlike '[0-9]'", _mod97(), 0.7, "iban|account|bank|konto|cuenta|compte", False),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}(?![A-Za-z0-9])", "t rlike '[0-9]'", "m rlike '[0-9]' and m rlike '[A-Fa-f]'", 0.3, "token|secret|password|passwd|api.?key|credential", False),
)
BASE = ("email", "ip", "card", "phone")
THRESHOLD, RAISE, BEFORE = 0.5, 0.3, 32


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: Kind, place: int) -> str:
    """SQL for the array of a kind's spans in ``t``.

    What stands between matches and the matches alternate, so a span starts where the lengths before it end. Those
    sums go by blocks of 256 matches, which keeps texts with very many matches from taking quadratic time.
    """
    p = _quoted(kind.pattern)
    upto = "element_at(g.base, cast(i div 256 as int) + 1) + aggregate(slice(g.len, cast(i div 256 as int) * 256 + 1, cast(i % 256 as int)), 0L, (a, x) -> a + x) + length(g.gap[i])"
    sums = "transform(sequence(0, cast((size(z.len) - 1) div 256 as int)), b -> aggregate(slice(z.len, b * 256 + 1, 256), 0L, (a, x) -> a + x))"
    based = f"aggregate({sums}, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x))"
    near = f"substr(t, cast(greatest(1L, k.s - {BEFORE - 1}) as int), cast(least(k.s, {BEFORE}L) as int))"
    score = f"least(1D, {kind.score}D + if({near} rlike {_quoted(f'(?i)(?:{kind.context})')}, {RAISE}D, 0D))"
    made = f"struct(k.s as start, {place} as kind, k.s + length(k.m) as stop, {score} as score)"
    return f"""case when {kind.hint} then
        transform(transform(array(regexp_extract_all(t, {p}, 0)), m ->
          if(size(m) = 0, array(), transform(transform(transform(array(split(t, {p})),
            gap -> struct(m as m, gap as gap, transform(m, (x, i) -> cast(length(gap[i]) + length(x) as bigint)) as len)),
            z -> struct(z.m as m, z.gap as gap, z.len as len, {based} as base)),
            g -> filter(transform(g.m, (x, i) -> struct({upto} as s, x as m)), k -> transform(array(k.m), m -> {kind.valid})[0]))[0]))[0],
          k -> {made}) end""".replace("array(), transform", "cast(array() as array<struct<s: bigint, m: string>>), transform")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text and ``spans``, an array of (start, kind, stop, score) sorted by start, then kind.

    ``kind`` is the place in ``KINDS``; offsets count code points, ``stop`` is exclusive. Texts are read whole, in one
    pass without a shuffle. A null text has no span and stays null; repeated rows stay; other columns aren't read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    none = "cast(array() as array<struct<start: bigint, kind: int, stop: bigint, score: double>>)"
    each = rows.select("doc_id", "text", *[F.expr(f"coalesce({_spans(k, i)}, {none})").alias(f"k{i}") for i, k in enumerate(KINDS)])
    kept = [f"k{i}" if k.always else f"filter(k{i}, x -> x.score >= {THRESHOLD})" for i, k in enumerate(KINDS)]
    return each.select("doc_id", "text", F.expr(f"sort_array(concat({', '.join(kept)}))").alias("spans"))


def listed(spans: str = "spans", kinds: tuple[str, ...] | None = None) -> str:
    """SQL for ``kind:start:end`` of all spans, or of those of some kinds, joined by commas."""
    names = "array(" + ", ".join(f"'{k.name}'" for k in KINDS) + ")"
    some = f"filter({spans}, x -> x.kind in ({', '.join(str(i) for i, k in enumerate(KINDS) if k.name in kinds)}))" if kinds else spans
    return f"array_join(transform({some}, x -> concat({names}[x.kind], ':', x.start, ':', x.stop)), ',')"


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``find`` with a column ``redacted``: the text with each span replaced by ``<KIND>``.

    Spans that overlap are one hole, named after its first span. A null text stays null.
    """
    names = "array(" + ", ".join(f"'<{k.name.upper()}>'" for k in KINDS) + ")"
    # reach: where all spans before this one end (largest stop so far, by blocks of 256); a span that starts there or later opens a hole
    tops = "transform(sequence(0, cast((size(e) - 1) div 256 as int)), b -> array_max(slice(e, b * 256 + 1, 256)))"
    based = f"aggregate({tops}, array(0L), (a, x) -> array_append(a, greatest(element_at(a, -1), x)))"
    reach = "greatest(g.base[cast(i div 256 as int)], coalesce(array_max(slice(g.e, cast(i div 256 as int) * 256 + 1, cast(i % 256 as int))), 0L))"
    holes = f"""transform(transform(array(transform(spans, x -> x.stop)), e -> struct(e as e, {based} as base)),
        g -> filter(transform(spans, (x, i) -> struct(x.start as start, x.kind as kind, {reach} as reach)), x -> x.start >= x.reach))[0]"""
    found = find(docs, key, text).withColumn("h", F.expr(f"if(size(spans) > 0, {holes}, null)"))
    piece = f"concat(substr(text, cast(x.reach + 1 as int), cast(x.start - x.reach as int)), {names}[x.kind])"
    joined = f"concat(array_join(transform(h, x -> {piece}), ''), substr(text, cast(array_max(transform(spans, x -> x.stop)) + 1 as int)))"
    return found.withColumn("redacted", F.expr(f"if(size(spans) > 0, {joined}, text)")).drop("h")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document; a null text has none, an empty table no rows."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda name: F.expr(f"cast(size(filter(spans, x -> x.kind = {BASE.index(name)})) as bigint)").alias(f"n_{name}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.expr(listed(kinds=BASE)), 256).alias("base_sha256"), F.expr(listed()).alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLE_SQL: dict[str, str] = {}
