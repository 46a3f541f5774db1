"""Scalar column functions: identifiers, quarters, guards and cleaned ratios. A missing value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_ticker(c: Column) -> Column:
    """The first word, upper-cased."""
    return F.upper(F.split(F.trim(c), " ")[0])


def with_suffix(c: Column, suffix: str = " US") -> Column:
    return F.concat(c, F.lit(suffix))


def without_suffix(c: Column, suffix: str = " US") -> Column:
    """Without the suffix wherever it stands, as it is written."""
    return F.replace(c, F.lit(suffix), F.lit(""))


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def clip(c: Column, low, high) -> Column:
    """Between bounds; NULL stays NULL (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low))


def quarter_index(q: Column) -> Column:
    """'2026Q3' as a number that counts quarters."""
    return (F.substring(q, 1, 4).cast("int") * 4 + F.substring(q, 6, 1).cast("int") - 1).cast("int")


def quarter_name(i: Column) -> Column:
    return F.format_string("%04dQ%d", F.floor(i / 4).cast("int"), (F.pmod(i, F.lit(4)) + 1).cast("int"))


def add_quarters(q: Column, n) -> Column:
    return quarter_name(quarter_index(q) + n)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def log_return(later: Column, earlier: Column) -> Column:
    return F.when((later > 0) & (earlier > 0), F.ln(later / earlier))


def log_cap(cap: Column) -> Column:
    """Regression weight: ln of the capitalisation, at least ln 1; missing counts as 1."""
    return F.ln(F.greatest(F.coalesce(cap, F.lit(1.0)), F.lit(1.0)))


def safe_ratio(cap: Column, median_of_quarter: Column) -> Column:
    return F.round(F.try_divide(cap, 4 * median_of_quarter), 2)


def symmetric_growth(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, F.abs((now + before) / 2))


def ou_blend(ou_rank: Column, reversal_rank: Column, half_life: Column, reference: float = 30.0, cap: float = 10.0) -> Column:
    """Weighted mean of two ranks; the faster the reversion, the more the first counts."""
    w = ou_weight(half_life, reference, cap)
    return (w * F.coalesce(ou_rank, F.lit(0.0)) + reversal_rank) / (w + 1)


def ou_weight(half_life: Column, reference: float = 30.0, cap: float = 10.0) -> Column:
    return F.when(half_life > 0, F.least(F.lit(reference) / half_life, F.lit(cap))).otherwise(0.0)
