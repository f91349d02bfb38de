"""Discount context of a price history, with nearby holidays and matches.

A history is an array with one point per day, so it is bounded by the days of
the window. Everything about one listing is computed inside its row; the two
calendars come as one row per calendar day, so looking up the days around a
discount start moves no listing more than once and multiplies none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.dates import years_of
from ..functions.money import pct


def valid_points(history: Column) -> Column:
    """Points with date and price, by date."""
    return F.array_sort(
        F.filter(history, lambda p: p["date"].isNotNull() & p["price"].isNotNull()),
        lambda a, b: F.when(a["date"] < b["date"], -1).when(a["date"] > b["date"], 1).otherwise(0),
    )


def nearby_events(events: DataFrame, days: int = lx.EVENT_WINDOW_DAYS) -> DataFrame:
    """Range join by enumeration: each event under every day at most ``days`` away.

    Returns ``(day, days_offset, <event columns>)`` to be joined on the day.
    """
    offsets = F.sequence(F.lit(-days), F.lit(days))
    return events.withColumn("days_offset", F.explode(offsets)).withColumn(
        "day", F.date_sub("date", F.col("days_offset"))
    )


def _signals(near: DataFrame, order: list[str], name: str) -> DataFrame:
    """Per day the signals around it, nearest first."""
    signal = F.struct("kind", "date", "label", "days_offset", "note")
    keyed = F.struct(F.abs("days_offset").alias("far"), *order, signal.alias("signal"))
    return near.groupBy("day").agg(
        F.transform(F.array_sort(F.collect_list(keyed)), lambda k: k["signal"]).alias(name)
    )


def holiday_signals(calendar: DataFrame) -> DataFrame:
    """``(day, holiday_signals)`` for every day near a holiday."""
    near = nearby_events(calendar).select(
        "*",
        F.lit("holiday").alias("kind"),
        F.year("date").alias("year"),
        F.when(F.col("days_offset") == 0, lx.NOTE_HOLIDAY)
        .otherwise(lx.NOTE_NEAR_HOLIDAY)
        .alias("note"),
    )
    return _signals(near, ["year", "position"], "holiday_signals")


def match_signals(matches: DataFrame) -> DataFrame:
    """``(day, match_signals)`` for every day near a match."""
    venue = F.lower(F.trim(F.coalesce("venue", F.lit(""))))
    near = nearby_events(matches.select("date", "label", "venue").distinct()).select(
        "*",
        F.lit("match").alias("kind"),
        F.when(
            (venue != "") & ~F.contains(venue, F.lit("local")),
            F.format_string(lx.NOTE_MATCH_AT, venue),
        )
        .otherwise(lx.NOTE_LOCAL_MATCH)
        .alias("note"),
    )
    return _signals(near, ["date", "label"], "match_signals")


def no_history_context(price: Column, list_price: Column) -> Column:
    """Discount of a listing seen for the first time: only its list price can tell."""
    promoted = F.coalesce(list_price > price, F.lit(False))
    only = lambda c: F.when(promoted, c)
    return F.struct(
        promoted.alias("has_discount"),
        only(list_price).alias("reference_price"),
        only(price).alias("current_price"),
        F.lit(None).cast("date").alias("discount_start"),
        F.lit(None).cast("date").alias("discount_observed_until"),
        F.when(promoted, lx.NOTE_LIST_PRICE).otherwise(lx.NOTE_OBSERVED).alias(
            "reference_price_note"
        ),
    )


def detect_discount(points: Column) -> Column:
    """``struct(highest, current, dropped)`` of valid points."""
    highest = F.array_max(F.transform(points, lambda p: p["price"]))
    current = F.try_element_at(points, F.lit(-1))["price"]
    bound = highest * F.lit(str(lx.DROP_RATIO)).cast("decimal(6,4)")
    return F.struct(
        highest.alias("highest"),
        current.alias("current"),
        ((highest > 0) & (current < bound)).alias("dropped"),
    )


def discount_run_start(points: Column, current: Column) -> Column:
    """Day of the first point of the unbroken run at the current price."""
    tolerance = F.lit(str(lx.SAME_PRICE_TOLERANCE)).cast("decimal(4,2)")
    other = F.array_max(
        F.transform(
            points, lambda p, i: F.when(F.abs(p["price"] - current) >= tolerance, i + 1)
        )
    )
    return F.get(points, F.coalesce(other, F.lit(0)))["date"]


def history_context(points: Column, found: Column, list_price: Column) -> Column:
    """Discount of a listing with history, the list price as second evidence."""
    current = found["current"]
    raised = current * F.lit(str(lx.LIST_PRICE_RATIO)).cast("decimal(6,4)")
    by_list = ~found["dropped"] & F.coalesce(list_price > raised, F.lit(False))
    discounted = found["dropped"] | by_list
    return F.struct(
        discounted.alias("has_discount"),
        F.when(by_list, list_price).otherwise(found["highest"]).alias("reference_price"),
        current.alias("current_price"),
        F.when(discounted, discount_run_start(points, current)).alias("discount_start"),
        F.when(discounted, F.try_element_at(points, F.lit(-1))["date"]).alias(
            "discount_observed_until"
        ),
        F.lit(lx.NOTE_OBSERVED).alias("reference_price_note"),
    )


def discount_facts(rows: DataFrame) -> DataFrame:
    """Columns of the discount itself for rows with history, price and list_price."""
    found = rows.withColumn("_points", valid_points(F.col("history"))).withColumn(
        "_found", detect_discount(F.col("_points"))
    )
    context = F.when(
        F.size("_points") > 0,
        history_context(F.col("_points"), F.col("_found"), F.col("list_price")),
    ).otherwise(no_history_context(F.col("price"), F.col("list_price")))
    shaped = found.withColumn("_context", context).select(
        *rows.columns,
        years_of(F.transform("_points", lambda p: p["date"])).alias("years"),
        "_context.*",
    )
    off = F.when(F.col("has_discount"), F.col("reference_price") - F.col("current_price"))
    return shaped.select(
        "*",
        off.cast("decimal(18,2)").alias("discount_amount"),
        pct(off, F.col("reference_price")).alias("discount_pct"),
    )


def with_signals(facts: DataFrame, calendar: DataFrame, matches: DataFrame) -> DataFrame:
    """Discount facts with ``signals``: holidays first, then matches.

    A holiday counts only in a year in which the listing was observed. The
    holiday table has one row per calendar day of the observed years; its size and
    that of the match table are the planner's to check.
    """
    near = facts.join(
        holiday_signals(calendar), facts["discount_start"] == F.col("day"), "left"
    ).drop("day")
    near = near.join(
        match_signals(matches), near["discount_start"] == F.col("day"), "left"
    ).drop("day")
    empty = F.array().cast("array<struct<kind:string,date:date,label:string,days_offset:int,note:string>>")
    own_years = F.filter(
        "holiday_signals", lambda s: F.array_contains("years", F.year(s["date"]))
    )
    return near.withColumn(
        "signals",
        F.concat(F.coalesce(own_years, empty), F.coalesce("match_signals", empty)),
    ).drop("holiday_signals", "match_signals", "years")


CONTEXT_FIELDS = [
    "has_discount", "reference_price", "current_price", "discount_amount", "discount_pct",
    "discount_start", "discount_observed_until", "reference_price_note", "signals",
]


def pricing_context(rows: DataFrame, matches: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows (history, price, list_price, ...) with a ``pricing_context`` struct.

    ``calendar`` holds the holidays of at least the years the histories lie in.
    Taking it from the dates' source, not from ``rows``, saves a second run of
    the plan behind them.
    """
    full = with_signals(discount_facts(rows), calendar, matches)
    return full.select(*rows.columns, F.struct(*CONTEXT_FIELDS).alias("pricing_context"))
