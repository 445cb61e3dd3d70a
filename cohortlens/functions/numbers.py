"""Dates, shares, rates, buckets and array tests."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_months(day: Column, months: int) -> Column:
    """Whole months ahead, held to the end of a shorter month."""
    if months <= 0:
        raise ValueError("months must be positive")
    return F.add_months(day, months)


def shift_months(day: dt.date, months: int) -> dt.date:
    """The same rule for a literal date known while the plan is built."""
    index = day.year * 12 + day.month - 1 + months
    year, month = index // 12, index % 12 + 1
    return dt.date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def window_end(cutoff: dt.date, months: int) -> dt.date:
    if months <= 0:
        raise ValueError("months must be positive")
    return shift_months(cutoff, months)


def recency_start(cutoff: dt.date, months: int) -> dt.date:
    """First day of the recency window of ``months`` that ends on the cutoff."""
    return shift_months(cutoff, -months) + dt.timedelta(days=1)


def age(day: Column, model_year: Column) -> tuple[Column, Column]:
    """Years since the model year, null when negative, and whether it is negative."""
    gap = F.year(day) - model_year
    return F.when(gap >= 0, gap), gap < 0


def share(part: Column, whole: Column) -> Column:
    """Part of the whole, null when the whole is zero or null."""
    return F.when(whole > 0, part / whole)


def rate_per_10k(count: Column, units: Column) -> Column:
    return F.when(units > 0, count * F.lit(10000.0) / units)


def _bucket(value: Column, first: tuple[str, Column], bounds: list[tuple[int, str]], last: str) -> Column:
    chain = F.when(first[1], first[0])
    for limit, label in bounds:
        chain = chain.when(value <= limit, label)
    return F.when(value.isNotNull(), chain.otherwise(last))


def age_at_cutoff_bucket(value: Column) -> Column:
    return _bucket(
        value, ("0", value == 0), [(2, "1-2"), (5, "3-5"), (10, "6-10"), (20, "11-20")], "21+"
    )


def age_bucket(value: Column) -> Column:
    return _bucket(value, ("0-2", value <= 2), [(5, "3-5"), (10, "6-10"), (20, "11-20")], "21+")


def support_bucket(value: Column) -> Column:
    return _bucket(value, ("1", value == 1), [(4, "2-4"), (9, "5-9"), (49, "10-49")], "50+")


def coverage_bucket(communication: Column, recall: Column) -> Column:
    return (
        F.when(communication & recall, "communications_and_recalls")
        .when(communication, "communications_only")
        .when(recall, "recalls_only")
        .otherwise("complaints_only_or_limited")
    )


EXPECTED = "OBSERVED_COMPLAINT_ACTIVITY_EXPECTED"
NOT_EXPECTED = "NO_OBSERVED_COMPLAINT_ACTIVITY_EXPECTED"


def classify(probability: Column, threshold: float = 0.5) -> Column:
    """Class name and display label of a probability; null outside [0, 1]."""
    expected = F.struct(
        F.lit(EXPECTED).alias("classification"),
        F.lit("Complaint activity predicted").alias("label"),
    )
    unexpected = F.struct(
        F.lit(NOT_EXPECTED).alias("classification"),
        F.lit("No complaint activity predicted").alias("label"),
    )
    return F.when(
        probability.between(0, 1), F.when(probability >= threshold, expected).otherwise(unexpected)
    )


def has_any(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))
