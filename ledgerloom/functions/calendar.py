"""Fiscal periods and months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _year_end(year: Column) -> Column:
    """The fiscal year's last day; a day the month does not have becomes its last one."""
    month = F.coalesce(F.expr("nullif(fiscalyear_last_month, 0)"), F.lit(12))
    day = F.coalesce(F.expr("nullif(fiscalyear_last_day, 0)"), F.lit(31))
    first = F.make_date(year, month, F.lit(1))
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def fiscal_periods(companies: DataFrame, today: dt.date, n: int = 4,
                   date_pattern: str = "MM/dd/yyyy", stored: DataFrame | None = None) -> DataFrame:
    """The last `n` fiscal years of each company, named by their dates. Those already in
    `stored` (by name) are left out."""
    years = F.sequence(F.lit(today.year - n + 1), F.lit(today.year))
    spans = (companies.select(F.col("id").alias("company_id"), "fiscalyear_last_day",
                              "fiscalyear_last_month", F.explode(years).alias("year"))
             .select("company_id",
                     F.date_add(_year_end(F.col("year") - 1), 1).alias("date_from"),
                     _year_end(F.col("year")).alias("date_to")))
    periods = spans.select(
        "company_id",
        F.concat(F.date_format("date_from", date_pattern), F.lit(" - "),
                 F.date_format("date_to", date_pattern)).alias("name"),
        "date_from", "date_to")
    if stored is not None:
        periods = periods.join(stored.select("company_id", "name"), ["company_id", "name"],
                               "left_anti")
    return periods


def month_range(date_from: Column, month: Column,
                within_period: bool = False) -> tuple[Column, Column]:
    """First and last day of a month of the fiscal period starting at `date_from`.

    The year is the period's first one, whatever the month; `within_period` takes the next
    year for months before the period's first.
    """
    year = F.year(date_from)
    if within_period:
        year = year + F.when(month < F.month(date_from), 1).otherwise(0)
    first = F.make_date(year, month, F.lit(1))
    return first, F.last_day(first)


def fill_dates(reports: DataFrame, periods: DataFrame) -> DataFrame:
    """Reports with a chosen period (`period_name`) and perhaps a month (`month`) get their
    dates from them; aged reports and those without a period keep their own."""
    chosen = periods.select("company_id", F.col("name").alias("period_name"),
                            F.col("date_from").alias("_from"), F.col("date_to").alias("_to"))
    first, last = month_range(F.col("_from"), F.col("month"))
    use = F.col("_from").isNotNull() & (F.col("ledger_type") != "aged")
    by_month = F.col("month").isNotNull()
    return (reports.join(chosen, ["company_id", "period_name"], "left")
            .withColumn("date_from", F.when(use, F.when(by_month, first).otherwise(F.col("_from")))
                        .otherwise(F.col("date_from")))
            .withColumn("date_to", F.when(use, F.when(by_month, last).otherwise(F.col("_to")))
                        .otherwise(F.col("date_to")))
            .drop("_from", "_to"))
