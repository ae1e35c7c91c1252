"""Money is DECIMAL(18,2); every stage rounds to cents, half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"


def cents(x: Column) -> Column:
    """Rounded to cents; doubles go through six decimals so that engines agree."""
    return F.round(x.cast("decimal(18,6)"), 2).cast(CENTS)


def factor_up(pct: Column) -> Column:
    """What ``scaled`` multiplies with for a rise: worked out once where an amount rises often."""
    return (F.lit(1) + pct / F.lit(100).cast("decimal(9,2)")).cast("decimal(12,8)")


def scaled(amount: Column, factor: Column) -> Column:
    return F.round(amount * factor, 2).cast(CENTS)


def percent_down(amount: Column, pct: Column) -> Column:
    return F.round(amount * (F.lit(1) - pct / F.lit(100).cast("decimal(9,2)")).cast("decimal(12,8)"), 2).cast(CENTS)


def undo_percent_down(amount: Column, pct: Column) -> Column:
    """The amount before ``percent_down``."""
    return F.round(amount / (F.lit(1) - pct / F.lit(100).cast("decimal(9,2)")).cast("decimal(12,8)"), 2).cast(CENTS)


def money_text(x: Column) -> Column:
    """'6,480.00'; null stays null."""
    return F.format_number(x.cast("decimal(18,2)"), 2)


def gap_text(x: Column) -> Column:
    """A shortfall in brackets, a dash for none."""
    return F.when(F.abs(x) < 0.005, "\u2014").otherwise(F.concat(F.lit("("), money_text(F.abs(x)), F.lit(")")))


def percent_text(fraction: Column, decimals: int = 0) -> Column:
    return F.concat(F.format_number((fraction * 100).cast("decimal(18,6)"), decimals), F.lit("%"))


def dashed(x: Column) -> Column:
    """Absent values as a dash; zero is a value."""
    return F.coalesce(F.when(x.cast("string") != "", x.cast("string")), F.lit("\u2014"))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or one + "s"))


def percent_number(pct: Column) -> Column:
    """A percentage as written: no trailing zeros."""
    return F.regexp_replace(pct.cast("decimal(9,4)").cast("string"), r"\.?0+$", "")


def same_money(got: Column, want: Column) -> Column:
    """Equal within a cent; both absent is equal, one absent is not."""
    return F.when(got.isNull() | want.isNull(), got.isNull() & want.isNull()).otherwise(F.abs(got - want) <= 0.01)


def shown(x: Column) -> Column:
    """As a double at the boundary, null as 0."""
    return F.coalesce(x.cast("double"), F.lit(0.0))
