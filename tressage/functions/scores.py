"""Scores and dates as expressions.  Null means "not observable" and is never taken for zero; NaN counts as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_A_MONTH = 30.4375
Z95 = 1.959963985
#: Weights of the components of a pair's score.
WEIGHTS = (("buyer", 0.50), ("text", 0.25), ("cpv", 0.20), ("time", 0.05))
#: Lower edges and names of the comparison levels.
TEXT_LEVELS = ((0.05, 0.15, 0.30, 0.50), ("text<0.05", "text0.05-0.15", "text0.15-0.30", "text0.30-0.50", "text>=0.50"))
CPV_LEVELS = ((0.001, 0.50), ("cpv_none", "cpv_partial", "cpv_strong"))
TIME_LEVELS = ((0.001, 0.50), ("time_low", "time_medium", "time_high"))
AGREEING = ("buyer_siren", "cpv_strong", "cpv_partial", "time_high", "text>=0.50", "text0.30-0.50")


def observed(x: Column) -> Column:
    """A double with NaN turned into null."""
    return F.when(~F.isnan(x), x)


def level(x: Column, edges, names) -> Column:
    """The comparison level of a score; an edge belongs to the level above it; "missing" if not observable."""
    v = observed(x)
    out = F.when(v.isNull(), F.lit("missing"))
    for e, n in zip(edges, names):
        out = out.when(v < e, F.lit(n))
    return out.otherwise(F.lit(names[-1]))


def weighted_score(parts: dict[str, Column], weights=WEIGHTS, scale: float = 100.0) -> Column:
    """Weighted mean over the observable parts, each clipped to [0, 1]; null if none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights:
        v = observed(parts[name])
        total = total + F.coalesce(F.lit(w) * F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        weight = weight + F.when(v.isNull(), F.lit(0.0)).otherwise(F.lit(w))
    return F.when(weight > 0, F.lit(scale) * total / weight)


def completeness(*parts: Column) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + observed(p).isNotNull().cast("int")
    return out


def time_plausibility(gap_days: Column, months: Column) -> Column:
    m = observed(months)
    return F.when(m > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(gap_days - m * DAYS_A_MONTH) / 365.0))


def category_continuity(a: Column, b: Column) -> Column:
    """The larger of the three-digit overlap and half the two-digit overlap of two code lists; null if one is empty."""
    from .text import jaccard, prefixes

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(jaccard(prefixes(a, 3), prefixes(b, 3)), 0.5 * jaccard(prefixes(a, 2), prefixes(b, 2))))


def wilson(k: Column, n: Column, upper: bool, z: float = Z95) -> Column:
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    centre = p + z * z / (2.0 * n)
    bound = (centre + half if upper else centre - half) / (1 + z * z / n)
    return F.when(n > 0, F.round(F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0)), 4))


def logistic_bits(weight: Column) -> Column:
    """The probability of a match weight in bits, without overflow on either side."""
    ln2 = 0.6931471805599453
    return F.when(weight >= 0, 1 / (1 + F.exp(-weight * ln2))).otherwise(F.exp(weight * ln2) / (1 + F.exp(weight * ln2)))


def parsed_date(x: Column) -> Column:
    """The first 20YY-MM-DD or 20YY/MM/DD anywhere in a text; an impossible date is null."""
    m = F.regexp_extract(x, r"(20[0-9]{2}[-/][0-9]{2}[-/][0-9]{2})", 1)
    return F.when(m != "", F.try_to_date(F.regexp_replace(m, "/", "-"), "yyyy-MM-dd"))


def month_index(a: Column, b: Column) -> Column:
    return F.round(F.datediff(b, a) / DAYS_A_MONTH, 2)


def quarter_start(d: Column) -> Column:
    return F.to_date(F.date_trunc("quarter", d))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def plus_months(ts: Column, months: Column) -> Column:
    """A timestamp moved by months of 30.4375 days, fractions of a day kept."""
    return F.timestamp_micros((F.unix_micros(ts) + F.round(months * DAYS_A_MONTH * 86_400_000_000)).cast("long"))
