"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375  # 365.25 / 12; tenure months = days / 30.4375


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return col(c).cast("double")


def floor1_ratio(num, den) -> Column:
    """num / max(den, 1), NULL when den is NULL (``greatest`` alone would skip
    the NULL and divide by 1)."""
    d = col(den)
    return F.when(d.isNotNull(), as_double(num) / F.greatest(d, F.lit(1)).cast("double"))


def zero_as_one_ratio(num, den) -> Column:
    """num / (den with 0 replaced by 1); unlike floor1_ratio, keeps negatives."""
    d = col(den)
    return as_double(num) / F.when(d == 0, F.lit(1)).otherwise(d).cast("double")


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI mode would raise)."""
    return F.try_divide(as_double(num), as_double(den))


def count_true(c) -> Column:
    return F.count_if(col(c)).cast("bigint")


def exact_mean(c) -> Column:
    """Mean of a DECIMAL/integral column as DOUBLE: the sum is exact (no
    dependence on row order after a shuffle), one division at the end."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def money(c) -> Column:
    return col(c).cast("double")


def round_money(c, scale: int = 2) -> Column:
    """Round at ``scale`` decimals via DECIMAL so the tie rule does not depend
    on the binary form of the double (x.xx5 rounds half-up on the decimal)."""
    return F.round(col(c).cast("decimal(38,8)"), scale).cast("double")


def tenure_months(days) -> Column:
    """days / 30.4375 at one decimal. 30.4375 = 487/16 with 487 odd, so the
    quotient is never a tie and half-up and half-even agree."""
    return F.round(as_double(days) / F.lit(DAYS_PER_MONTH), 1)


def month_number(d) -> Column:
    """year*12 + month, so that month differences are whole numbers."""
    c = col(d)
    return (F.year(c) * 12 + F.month(c)).cast("bigint")


def month_index(later, earlier) -> Column:
    """Whole calendar months from ``earlier`` to ``later`` (not months_between,
    which is fractional)."""
    return month_number(later) - month_number(earlier)


def month_label(d) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def stable_sum(c, scale: int = 12) -> Column:
    """Sum of a DOUBLE column made independent of row order: each value is
    fixed at ``scale`` decimals first and added as DECIMAL, exactly."""
    return F.sum(col(c).cast(f"decimal(38,{scale})")).cast("double")


def stable_mean(c, scale: int = 12) -> Column:
    """Mean of a DOUBLE column with the order-independent sum of stable_sum."""
    return F.try_divide(stable_sum(c, scale), F.count(c).cast("double"))


def pct_half_up(num, den, decimals: int = 1) -> Column:
    """100 * num / den for integer counts, rounded half-up at ``decimals`` on
    the exact ratio (integer arithmetic), so no binary tie can flip it."""
    scale = 10 ** decimals
    n, d = col(num).cast("bigint"), col(den).cast("bigint")
    units = F.when(d > 0, F.floor((n * (200 * scale) + d) / (d * 2)))
    # floor of a DOUBLE quotient is exact here: both operands are integers far
    # below 2**53 and the quotient is never within an ulp of the next integer
    # unless it is that integer.
    return units.cast("double") / float(scale)
