"""Price rules. Money is DECIMAL(18,2); rounding is decimal, half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def from_cents(cents: Column) -> Column:
    """An integer number of hundredths as money, without a division."""
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals; NULL when the whole is 0."""
    share = F.try_divide(
        part.cast("decimal(18,2)") * F.lit(100), whole.cast("decimal(18,2)")
    )
    return F.round(share, 2).cast("decimal(18,2)")


def mean_money(c: Column | str) -> Column:
    """Mean of a money column with two decimals (the division keeps twelve)."""
    mean = F.sum(c) / F.count(c).cast("decimal(12,0)")
    return F.round(mean, 2).cast(MONEY)


def clean_list_price(price: Column, list_price: Column) -> Column:
    """A list price counts only above the price charged."""
    return F.when(list_price > price, list_price)


def has_discount(price: Column, list_price: Column) -> Column:
    return F.coalesce(list_price > price, F.lit(False))


def discount_pct(price: Column, list_price: Column) -> Column:
    return F.when(list_price > price, pct(list_price - price, list_price))


def resolve_price(selling: Column, detail: Column, listed: Column) -> Column:
    """Charged price with its fallbacks, and the list price that remains above it."""
    known = F.coalesce(selling, detail)
    price = F.coalesce(known, listed)
    left_over = F.when(known.isNotNull() & (listed > known), listed)
    return F.struct(price.alias("price"), left_over.alias("list_price"))


def is_drop(current: Column, highest: Column, ratio: float = lx.DROP_RATIO) -> Column:
    bound = highest * F.lit(str(ratio)).cast("decimal(6,4)")
    return (highest > 0) & (current < bound)
