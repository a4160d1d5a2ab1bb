"""Text, bucket and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(c: Column) -> Column:
    """Without terminal sequences and control characters, white space runs made one space, trimmed."""
    c = F.regexp_replace(c, r"\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)", "")
    c = F.regexp_replace(c, r"\x1B\[[0-9;?]*[ -/]*[@-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), r"\s+", " "))


def truncate(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def project_of(path: Column) -> Column:
    """The last part of a path, without a slash at its end."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def is_within(path: Column, root: Column) -> Column:
    """Whether a path is the root or lies below it."""
    return (path == root) | F.startswith(path, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def glob_like(c: Column, pattern: str) -> Column:
    """``*`` stands for any run of characters; everything else for itself."""
    import re

    return c.rlike("^(?s:" + ".*".join(re.escape(p) for p in pattern.split("*")) + ")$")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bucket(c: Column, edges: list[int], names: list[str]) -> Column:
    """The name of the first edge that the value stays below; the last name from there on. Null stays null."""
    out = F.when(c.isNull(), None)
    for edge, name in zip(edges, names):
        out = out.when(c < edge, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def _exact(n: int) -> Column:
    return F.lit(n).cast("decimal(38,0)")


def usd_decimals(pico: Column) -> Column:
    """How many decimals show an amount: two for whole cents, else four, or as many (to 12) as show its first digit that isn't 0.

    Nothing and null need two. A ledger shows all its amounts with the most that one of them needs.
    """
    whole = (pico <= 0) | (pico % _exact(10**10) == 0)
    small = F.lit(12)
    for decimals in range(11, 4, -1):
        small = F.when(pico >= _exact(10 ** (12 - decimals)), decimals).otherwise(small)
    return F.when(pico.isNull() | whole, 2).when(pico >= _exact(10**8), 4).otherwise(small)


def usd_units(pico: Column, decimals: Column) -> Column:
    """Whole display units of 10^-decimals dollars, rounded down; nothing for less than nothing."""
    size = F.element_at(F.array(*[_exact(10 ** (12 - d)) for d in range(13)]), decimals + 1)
    safe = F.greatest(pico, _exact(0))
    return ((safe - safe % size) / size).cast("decimal(38,0)")  # exact: a quotient would be rounded


def usd_text(units: Column, decimals: Column) -> Column:
    """Display units as text, thousands grouped."""
    digits = F.lpad(units.cast("string"), F.greatest(F.length(units.cast("string")), decimals + 1), "0")
    dollars = F.substring(digits, F.lit(1), F.length(digits) - decimals)
    return F.concat(grouped(dollars), F.lit("."), F.substring(digits, F.length(digits) - decimals + 1, decimals))


def grouped(digits: Column) -> Column:
    """A text of digits in groups of three."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+$)", ",")


def usd_floor(pico: Column) -> Column:
    """Dollars as text, never rounded up, with the decimals of ``usd_decimals``."""
    d = usd_decimals(pico)
    return F.when(pico.isNotNull(), usd_text(usd_units(pico, d), d))


def share(part: Column, whole: Column) -> Column:
    """A share in per cent, rounded; what isn't none or all never reads 0% or 100%, but <1% and >99%."""
    p = F.floor(100 * part / F.nullif(whole, F.lit(0)) + 0.5)
    return F.when((p <= 0) & (part > 0), F.lit("<1%")).when((p >= 100) & (part < whole), F.lit(">99%")).otherwise(F.concat(p.cast("string"), F.lit("%")))


def short_tokens(n: Column) -> Column:
    """Whole tokens, or thousands, millions and billions: one decimal below 9.95 of the unit, none from there; ties go up."""

    def unit(size: int, suffix: str) -> Column:
        tenths = F.floor((20 * n + size) / (2 * size))
        fine = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(F.lit("")))
        return F.concat(F.when(100 * n < 995 * size, fine).otherwise(F.floor((2 * n + size) / (2 * size)).cast("string")), F.lit(suffix))

    return F.when(n < 1000, n.cast("string")).when(n < 999_500, unit(1000, "k")).when(n < 999_500_000, unit(1_000_000, "M")).otherwise(unit(1_000_000_000, "B"))


def duration(ms: Column) -> Column:
    """Rounded to seconds: ``1h 02m 03s``, ``2m 03s`` or ``3s``."""
    s = F.floor(ms / 1000 + 0.5)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.concat(F.when(h > 0, two(m)).otherwise(m.cast("string")), F.lit("m "), two(s % 60), F.lit("s"))
    return F.when(ms.isNull() | (ms < 0), None).when(h > 0, F.concat(h.cast("string"), F.lit("h "), minutes)).when(m > 0, minutes).otherwise(F.concat(s.cast("string"), F.lit("s")))


def epoch_ms(c: Column) -> Column:
    """Epoch milliseconds of an ISO text or a number (below 10^12: seconds); null for anything else."""
    number = F.try_to_number(F.regexp_extract(c, r"^\s*(\d{1,18}(?:\.\d{1,6})?)\s*$", 1), F.lit("9" * 18 + ".999999"))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(F.try_to_timestamp(c)))
    return F.coalesce(F.when(number < 10**12, F.floor(number * 1000)).otherwise(F.floor(number)).cast("long"), iso)
