"""Exact money means, guarded ratios and the labels made from them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.model import AMOUNT, MONEY_SUM

# Wording of the comparison labels and the currency sign.
NO_PRIOR_DATA = "No previous-period data available"
VERSUS_PRIOR = "vs previous period"
CURRENCY = "₹"


# money_sum splits hundredths at this bit, so that neither half overflows a bigint before 8e12 rows.
_LOW_BITS = 20


def money_sum(amount: Column) -> Column:
    """Exact sum of decimal(12,2) amounts, null if there are none; an aggregate like sum().

    The buffer of a plain decimal sum is too wide for a machine word, and updating it costs more than
    the rest of a grouped aggregation. Amounts of another type are refused when the query runs, since
    hundredths would lose their rest. Here every row adds two integers, the high and low bits of its
    hundredths; they are put together once per group.
    """
    kind = F.typeof(amount)  # folded away by the optimizer where it fits
    wrong = F.raise_error(F.concat(F.lit("money must be decimal(12,2), not "), kind))
    hundredths = F.when(kind == AMOUNT, (amount * 100).cast("bigint")).otherwise(wrong)
    high = F.sum(F.shiftright(hundredths, _LOW_BITS)).cast("decimal(19,0)")
    low = F.sum(hundredths.bitwiseAND(2**_LOW_BITS - 1)).cast("decimal(19,0)")
    return ((high * 2**_LOW_BITS + low) * F.lit(Decimal("0.01"))).cast(MONEY_SUM)


def money_or_zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast(MONEY_SUM)


def exact_mean(total: Column, count: Column) -> Column:
    """total / count to two places, half away from zero, 0 when count is 0.

    avg() of a decimal stops at a few extra digits before an outer round sees it, which rounds twice.
    Here the mean is one integer division of hundredths. `total` must have two decimal places.
    """
    hundredths = (F.abs(total) * 100).cast("decimal(36,0)")
    units = F.nullif(count, F.lit(0))
    rounded = F.call_function("div", hundredths * 2 + units, units * 2)
    mean = rounded.cast("decimal(19,0)") * F.lit(Decimal("0.01"))
    signed = F.when(total < 0, -mean).otherwise(mean)
    return F.coalesce(signed, F.lit(Decimal("0.00"))).cast("decimal(21,2)")


def per_unit(total: Column, count: Column) -> Column:
    """total / count as double, 0 when there is nothing to divide by."""
    return F.coalesce(
        F.when(count > 0, F.try_divide(total.cast("double"), count.cast("double"))), F.lit(0.0)
    )


def share_pct(value: Column, total: Column) -> Column:
    """value as a percentage of total, 0 when the total is not positive."""
    return F.coalesce(
        F.when(total > 0, F.try_divide(value.cast("double"), total.cast("double")) * 100), F.lit(0.0)
    )


def change_pct(current: Column, prior: Column) -> Column:
    """Percentage change against prior, null when prior is 0."""
    now, before = current.cast("double"), prior.cast("double")
    return F.try_divide(now - before, before) * 100


def change_direction(pct: Column) -> Column:
    return F.when(pct > 0, "up").when(pct < 0, "down").otherwise("neutral")


def change_label(pct: Column) -> Column:
    shown = F.concat(percent_text(F.abs(pct)), F.lit(f" {VERSUS_PRIOR}"))
    return (
        F.when(pct.isNull(), NO_PRIOR_DATA)
        .when(pct > 0, F.concat(F.lit("↑ "), shown))
        .when(pct < 0, F.concat(F.lit("↓ "), shown))
        .otherwise(shown)
    )


def percent_text(value: Column) -> Column:
    """One decimal place. format_number rounds the binary value half-even; format_string would not."""
    return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit("%"))


def currency_text(amount: Column, places: int = 0) -> Column:
    return F.concat(F.lit(CURRENCY), F.format_number(amount, places))


def count_text(value: Column) -> Column:
    return F.format_number(value, 0)
