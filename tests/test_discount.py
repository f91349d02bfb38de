"""Discount context against a plain restatement of its rule."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tendero.functions import dates
from tendero.operators import discount as disc

ROW = "id INT, price DECIMAL(18,2), list_price DECIMAL(18,2), history ARRAY<STRUCT<date: DATE, price: DECIMAL(18,2)>>"
MATCH = "date DATE, label STRING, opponent STRING, venue STRING"


def contexts(spark, rows, matches=()):
    df = spark.createDataFrame(rows, ROW)
    years = spark.range(2020, 2030).select(F.col("id").alias("year"))
    calendar = dates.holiday_calendar(years)
    out = disc.pricing_context(df, spark.createDataFrame(list(matches), MATCH), calendar)
    return {r.id: r.pricing_context for r in out.collect()}


def money(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def test_drop_with_holiday(spark):
    days = [(date(2025, 12, 20), 50000), (date(2025, 12, 24), 50000), (date(2025, 12, 25), 42000), (date(2025, 12, 26), 42000)]
    matches = [(date(2025, 12, 27), "Final", None, "Estadio Norte"), (date(2025, 12, 18), "Copa", None, None), (date(2026, 2, 1), "x", None, None)]
    c = contexts(spark, [(1, money(42000), None, [(d, money(p)) for d, p in days])], matches)[1]
    assert c.has_discount and c.reference_price == 50000 and c.current_price == 42000
    assert (c.discount_start, c.discount_observed_until) == (date(2025, 12, 25), date(2025, 12, 26))
    assert float(c.discount_pct) == 16.0 and float(c.discount_amount) == 8000
    # 1 January is seven days away, but 2026 was not observed
    assert [(s.kind, s.label, s.days_offset, s.note) for s in c.signals] == [
        ("holiday", "Navidad", 0, "festivo"),
        ("match", "Final", 2, "partido cercano (estadio norte)"),
        ("match", "Copa", -7, "partido local cercano"),
    ]


def test_easter_and_monday_rule(spark):
    years = spark.createDataFrame([(y,) for y in range(1990, 2060)], "year INT")
    easters = {r.year: r.e for r in years.select("year", dates.easter(F.col("year")).alias("e")).collect()}
    known = {1991: (3, 31), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2038: (4, 25)}
    for y, (m, d) in known.items():
        assert easters[y] == date(y, m, d)
    assert all(e.weekday() == 6 for e in easters.values())
    rows = {r.date: r.label for r in dates.holiday_calendar(years.filter("year = 2024")).collect()}
    assert rows[date(2024, 1, 8)] == "Reyes Magos" and rows[date(2024, 5, 13)] == "Ascensión del Señor"
    assert rows[date(2024, 7, 22)] == "Independencia de Colombia"


def expected(price, listed, points):
    if not points:
        on = listed is not None and listed > price
        return (on, listed if on else None, price if on else None, None, None)
    highest, current = max(p for _, p in points), points[-1][1]
    on, reference = current < highest * Decimal("0.98"), highest
    if not on and listed is not None and listed > current * Decimal("1.02"):
        on, reference = True, listed
    start = None
    if on:
        run = len(points)
        while run and abs(points[run - 1][1] - current) < Decimal("0.01"):
            run -= 1
        start = points[run][0]
    return (on, reference, current, start, points[-1][0] if on else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        days = sorted(rng.sample(range(400), rng.choice([0, 1, 2, 5, 9])))
        points = [(date(2024, 1, 1) + timedelta(days=d), money(rng.choice([100, 97.99, 98, 100.005, 80, 120]))) for d in days]
        rows.append((i, money(rng.choice([80, 100])), money(rng.choice([None, 90, 102, 103])), points))
    got = contexts(spark, rows)
    for i, price, listed, points in rows:
        c = got[i]
        have = (c.has_discount, c.reference_price, c.current_price, c.discount_start, c.discount_observed_until)
        assert have == expected(price, listed, points), rows[i]
