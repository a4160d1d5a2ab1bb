"""Column expressions over token usage: validity, context tiers, cost and its lower-bound flags."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyflow.schema import PICO, RATES

#: Above this, the producers' numbers aren't exact any more.
MOST_TOKENS = 2**53 - 1
#: A model's vendor by the start of its name (fixed values).
VENDOR_BY_PREFIX = {"claude-": "anthropic", "gpt-": "openai", "gemini-": "google", "deepseek-": "deepseek"}
#: An agent's vendor where the model tells none (fixed values).
VENDOR_BY_SOURCE = {"claude-code": "anthropic", "codex": "openai", "gemini": "google"}


def is_priceable() -> Column:
    """Whether usage is consistent: counts in range, total = the four parts, and the cache-write split within its whole."""
    whole = lambda c: F.col(c).isNotNull() & F.col(c).between(0, MOST_TOKENS)
    split = lambda c: F.col(c).isNull() | F.col(c).between(0, MOST_TOKENS)
    parts = reduce(and_, [*map(whole, ("input", "output", "cache_read", "cache_creation", "total")), *map(split, ("cc_5m", "cc_1h"))])
    # the casts keep sums of extreme counts from overflowing before they are refused
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
    same = d("total") == d("input") + d("output") + d("cache_read") + d("cache_creation")
    return F.coalesce(parts & same & (d("cc_5m") + d("cc_1h") <= d("cache_creation")), F.lit(False))


def prompt_side() -> Column:
    """What context tiers and refills go by: all but the output."""
    return F.col("input") + F.col("cache_read") + F.col("cache_creation")


def vendor(prefixes: dict[str, str] | None = None, sources: dict[str, str] | None = None) -> Column:
    """Blocked: none. Direct: the provider. No evidence: by the model's name, else by the source."""
    by_model = F.coalesce(*[F.when(F.col("model").startswith(p), F.lit(v)) for p, v in (prefixes or VENDOR_BY_PREFIX).items()])
    by_source = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in (sources or VENDOR_BY_SOURCE).items()])
    return F.when(F.col("provider_state") == "blocked", None).when(F.col("provider_state") == "direct", F.col("provider")).otherwise(F.coalesce(by_model, by_source))


def rates(row: str = "price") -> Column:
    """The rates of the highest context tier whose threshold the prompt exceeds (strictly), else the row's own.

    A tier's rates replace the row's as a whole: one that the tier leaves out isn't taken from the row.
    """
    p, tier = F.col(row), F.filter(F.col(f"{row}.tiers"), lambda t: t["above"] < prompt_side())
    top = F.element_at(F.array_sort(tier), -1)
    own = F.struct(*[p[r].alias(r) for r in RATES])
    of_tier = F.struct(*[top[r].alias(r) for r in RATES])
    return F.when(F.size(F.coalesce(tier, F.array())) > 0, of_tier).otherwise(own)


def _d(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(20,0)")


def unsplit() -> Column:
    """Cache writes of no stated lifetime; they count as the short one."""
    return F.col("cache_creation") - F.coalesce("cc_5m", F.lit(0)) - F.coalesce("cc_1h", F.lit(0))


def write_rates(r: str = "rates") -> tuple[Column, Column]:
    return F.coalesce(f"{r}.r_write_5m", f"{r}.r_write"), F.coalesce(f"{r}.r_write_1h", f"{r}.r_write")


def cost(r: str = "rates", output: bool = True) -> Column:
    """Pico-dollars at least; a cache rate that isn't cited adds nothing."""
    short, long = write_rates(r)
    parts = [(F.col("input"), F.col(f"{r}.r_in")), (F.col("cache_read"), F.col(f"{r}.r_cached")), (F.coalesce("cc_5m", F.lit(0)) + unsplit(), short), (F.col("cc_1h"), long)]
    if output:
        parts.append((F.col("output"), F.col(f"{r}.r_out")))
    return sum((_d(t) * _d(x) for t, x in parts[1:]), _d(parts[0][0]) * _d(parts[0][1])).cast(PICO)


def write_is_lower_bound(r: str = "rates") -> Column:
    short, long = write_rates(r)
    return ((F.coalesce("cc_5m", F.lit(0)) + unsplit() > 0) & short.isNull()) | ((F.coalesce("cc_1h", F.lit(0)) > 0) & long.isNull())


def read_is_lower_bound(r: str = "rates") -> Column:
    return (F.col("cache_read") > 0) & F.col(f"{r}.r_cached").isNull()


def cached_read_saving(r: str = "rates") -> Column:
    """What the cached reads would have cost more at the input rate; null if uncited or dearer than input."""
    gap = F.col(f"{r}.r_in") - F.col(f"{r}.r_cached")
    return F.when(gap >= 0, (_d(F.col("cache_read")) * _d(gap)).cast(PICO))
