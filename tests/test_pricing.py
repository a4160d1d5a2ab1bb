"""Boundaries of pricing: dates, tiers, cache rates, validity, and null that isn't zero."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from frames import frame

from tallyflow.functions import text as X
from tallyflow.functions import usage as U
from tallyflow.operators import attribution as A
from tallyflow.operators import pricing as P
from tallyflow.schema import PRICES, UNITS


def ms(day, hour=0):
    return int(dt.datetime.fromisoformat(f"{day}T{hour:02}:00:00+00:00").timestamp() * 1000)


def unit(n, day="2026-02-01", model="gpt-a", state="absent", provider=None, source=None, i=0, o=0, cr=0, cw=0, c5=None, c1=None, total=None, turn=0, session="s"):
    return (session, turn, n, i, o, cr, cw, c5, c1, i + o + cr + cw if total is None else total, ms(day, 23), model, state, provider, source)


BOOK = [
    ("openai", "gpt-a", dt.date(2026, 1, 1), dt.date(2026, 1, 31), 2_000_000, 10_000_000, None, None, None, None, [], 0),
    ("openai", "gpt-a", dt.date(2026, 2, 1), None, 5_000_000, 30_000_000, 500_000, 6_250_000, None, None, [(272_000, 10_000_000, 45_000_000, None, 12_500_000, None, None)], 1),
    ("openai", "gpt-b", dt.date(2026, 1, 1), None, 5_000_000, 1_000_000, None, None, None, None, [], 2),
    ("anthropic", "claude-a", dt.date(2026, 1, 1), None, 3_000_000, 15_000_000, 300_000, None, 3_750_000, 6_000_000, [], 3),
]


@pytest.fixture(scope="module")
def price(spark):
    book = spark.createDataFrame(BOOK, PRICES)

    def run(*units):
        return [r for r in P.price_units(spark.createDataFrame(list(units), UNITS), book).orderBy("unit_ord").collect()]

    return run


def test_dates_are_inclusive_at_both_ends(price):
    days = ["2025-12-31", "2026-01-01", "2026-01-31", "2026-02-01"]
    assert [r["pico"] for r in price(*[unit(k, d, i=10) for k, d in enumerate(days)])] == [None, 20_000_000, 20_000_000, 50_000_000]


def test_tier_is_strictly_above(price):
    at, over, output = price(unit(0, i=272_000), unit(1, i=271_000, cr=1001), unit(2, i=100, o=272_001))
    assert at["pico"] == 272_000 * 5_000_000
    assert over["pico"] == 271_000 * 10_000_000 and over["read_floor"]  # the tier cites no cached rate: nothing, and a flag
    assert output["pico"] == 100 * 5_000_000 + 272_001 * 30_000_000


def test_cache_writes(price):
    rows = price(unit(0, model="claude-a", cw=100, c5=30, c1=20), unit(1, model="gpt-a", cw=100, c1=40), unit(2, "2026-01-05", cw=10, cr=10, i=1), unit(3, model="claude-a", cw=10, c5=10))
    assert rows[0]["pico"] == 80 * 3_750_000 + 20 * 6_000_000 and not rows[0]["write_floor"]
    assert rows[1]["pico"] == 100 * 6_250_000 and not rows[1]["write_floor"]
    assert rows[2]["pico"] == 2_000_000 and rows[2]["write_floor"] and rows[2]["read_floor"]
    assert rows[3]["pico"] == 37_500_000


def test_bad_usage_is_never_priced(price):
    rows = price(unit(0, i=-1, total=-1), unit(1, i=5, total=6), unit(2, cw=5, c5=4, c1=2), unit(3, i=2**53), unit(4, i=2**63 - 1, o=1, total=0), unit(5, i=1, total=2))
    assert [r["pico"] for r in rows] == [None] * 6


def test_unknown_is_null_not_zero(price):
    rows = price(unit(0, model="gpt-zzz", i=5), unit(1, model=None, i=5), unit(2, model="gpt-a", state="blocked", i=5), unit(3, model="gpt-a", state="direct", provider="anthropic", i=5), unit(4, model="claude-a", state="absent", i=5), unit(5, model="gpt-a", i=0))
    assert [r["pico"] for r in rows] == [None, None, None, None, 15_000_000, 0]


def test_source_gives_the_vendor_only_without_a_model_prefix(spark):
    df = spark.createDataFrame([("gpt-x", "absent", None, "claude-code"), ("odd", "absent", None, "claude-code"), ("odd", "absent", None, "cursor")], "model string, provider_state string, provider string, source string")
    assert [r[0] for r in df.select(U.vendor()).collect()] == ["openai", "anthropic", None]


def test_turns_keep_what_is_unpriced(spark, price):
    book = spark.createDataFrame(BOOK, PRICES)
    units = spark.createDataFrame([unit(0, i=10), unit(1, model="?", i=7), unit(0, model="?", i=3, turn=1)], UNITS)
    a, b = P.price_turns(P.price_units(units, book)).orderBy("turn_index").collect()
    assert (a["pico"], a["unpriced_tokens"], a["complete"]) == (50_000_000, 7, False)
    assert (b["pico"], b["unpriced_tokens"], b["complete"]) == (None, 3, False)


def test_huge_counts_stay_exact(price):
    assert price(unit(0, "2026-01-05", i=2**53 - 1))[0]["pico"] == (2**53 - 1) * 2_000_000


def test_cheapest_prefers_the_earlier_row(spark):
    book = spark.createDataFrame([*BOOK, ("openai", "gpt-c", dt.date(2026, 1, 1), None, 5_000_000, 9, None, None, None, None, [], 0)], PRICES)
    got = {r["vendor"]: r["cheapest"]["model"] for r in P.cheapest_current(book).collect()}
    assert got == {"openai": "gpt-c", "anthropic": "claude-a"}


def test_book_faults(spark):
    d = dt.date
    bad = [("v", "gap", d(2026, 1, 1), d(2026, 1, 2)), ("v", "gap", d(2026, 1, 4), None), ("v", "over", d(2026, 1, 1), d(2026, 1, 4)), ("v", "over", d(2026, 1, 4), None), ("v", "fine", d(2026, 1, 1), d(2026, 1, 3)), ("v", "fine", d(2026, 1, 4), None)]
    rows = P.book_faults(spark.createDataFrame([(*b, 1, 1, None, None, None, None, [], k) for k, b in enumerate(bad)], PRICES)).collect()
    assert {(r["model"], r["fault"]) for r in rows} == {("gap", "leaves a gap"), ("over", "overlaps the next row")}


def test_even_split_and_replies(spark):
    turns = frame(spark, [("s", 0, 90, 30, True), ("s", 1, None, 10, False), ("s", 2, 5, 5, True)], "session_id string, turn_index long, pico decimal(38,0), total long, complete boolean")
    calls = spark.createDataFrame([("s", 0, "a"), ("s", 0, "a"), ("s", 0, "b"), ("s", 1, "c")], "session_id string, turn_index long, name string")
    extra = spark.createDataFrame([("s", 4)], "session_id string, tokens long")
    got = {r["tool"]: (r["n_calls"], None if r["pico"] is None else float(r["pico"]), float(r["tokens"])) for r in A.by_tool(turns, calls, extra).collect()}
    assert got == {"a": (2, 60.0, 20.0), "b": (1, 30.0, 10.0), "c": (1, None, 10.0), A.NO_TOOL: (0, 5.0, 5.0), A.UNATTRIBUTED: (0, None, 4.0)}


def test_usd_floor_never_rounds_up(spark):
    want = {
        0: "0.00", -5: "0.00", 1: "0.000000000001", 9_999_999_999: "0.0099", 10_000_000_000: "0.01", 1_999_999_999_999: "1.9999", 123_456: "0.0000001", 12_345_678_900_000_000: "12,345.6789", 12_300_000_000: "0.0123", 1_234_500_000_000: "1.2345",
        1_230_000_000_000: "1.23", 99_999_999: "0.00009", 100_000_000: "0.0001", 1_234_567_000_000_000_000: "1,234,567.00", 10**24 + 1: "1,000,000,000,000.0000", 1_000_000_000_000_000: "1,000.00", 10**12 - 10**10: "0.99",
    }
    df = spark.createDataFrame([(str(v),) for v in want], "v string").select(X.usd_floor(F.col("v").cast("decimal(38,0)")))
    assert [r[0] for r in df.collect()] == list(want.values())


def test_ledger_rows_never_add_up_to_more(spark):
    import random
    from collections import defaultdict
    from decimal import Decimal

    rng = random.Random(3)
    rows = [(g, i, rng.choice((None, 0, rng.randrange(10**5), rng.randrange(10**13), rng.randrange(1, 500) * 10**10))) for g in range(60) for i in range(rng.randrange(1, 6))]
    total = {g: max(0, sum(v or 0 for h, _, v in rows if h == g) - rng.choice((0, 0, 1, 10**8, 10**11, 10**14))) for g in range(60)}
    df = frame(spark, [(g, i, v, total[g]) for g, i, v in rows], "g int, i int, pico decimal(38,0), stated decimal(38,0)")
    found = defaultdict(list)
    for r in A.ledger(df, ["g"], ["i"], total="stated").orderBy("g", "i").collect():
        found[r["g"]].append(r)
    money = lambda t: Decimal(t.replace(",", ""))
    places = lambda v: 2 if v <= 0 or v % 10**10 == 0 else max(4, 13 - len(str(v)))
    for g, shown in found.items():
        d = max(places(v or 0) for v in [*(r["pico"] for r in shown), total[g]])
        units = [int(r["pico"] or 0) // 10 ** (12 - d) for r in shown]
        excess = max(0, sum(units) - total[g] // 10 ** (12 - d))
        for k in sorted(range(len(units)), key=lambda k: (-units[k], k)):
            less = min(units[k], excess)
            units[k], excess = units[k] - less, excess - less
        assert [money(r["amount"]) * 10**d for r in shown] == units and {r["decimals"] for r in shown} == {d}
        assert {money(r["total_amount"]) for r in shown} == {sum(money(r["amount"]) for r in shown)} and sum(money(r["amount"]) for r in shown) * 10**12 <= total[g]
    plain = A.ledger(df, ["g"], ["i"]).where("pico is null").select("amount").distinct().collect()
    assert {set(r["amount"]) <= set("0.") for r in plain} == {True}


def test_timestamps(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("1767225600",), ("1767225600000",), ("1767225600.5",), ("soon",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.epoch_ms(F.col("t"))).collect()] == [1767225600000, 1767225600000, 1767225600000, 1767225600500, None, None, None]


def test_text_helpers(spark):
    one = spark.createDataFrame([("\x1b[31mRed\x1b[0m\x00 a\n\tb \x1b]0;title\x07!", "/a/b/c//")], "t string, p string")
    r = one.select(X.sanitize(F.col("t")), X.project_of(F.col("p")), X.is_within(F.lit("/a/bc"), F.lit("/a/b")), X.is_within(F.lit("/a/b/c"), F.lit("/a/b/")), X.glob_like(F.lit("a.b+c"), "a.*c"), X.slug(F.lit("  Ünder The_Sea!! "))).first()
    assert tuple(r) == ("Red a b !", "c", False, True, True, "nder-the-sea")
