"""Matches: groups of items that settle each other, and how far into the future they reach."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scan import company_items, dated
from ledgerloom.options import ReportOptions
from ledgerloom.sources.tables import LedgerTables


def match_dates(tables: LedgerTables, o: ReportOptions, since: dt.date | None = None) -> DataFrame:
    """Each match with the date of its last item; with `since`, only matches having an item
    from that day on, and only items from that day on are read.

    Items of every state, account and kind count. The sums run per match before the shuffle,
    so a match of any size is one row per task.
    """
    items = company_items(tables, o).where(F.col("full_reconcile_id").isNotNull())
    if since is not None:
        items = dated(items, since=since)
    return items.groupBy("full_reconcile_id").agg(F.max("date").alias("last_match_date"))


def match_flags(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Per match: does it have an item on or after the start, and one after the end?"""
    return match_dates(tables, o).select(
        "full_reconcile_id", "last_match_date",
        (F.col("last_match_date") >= F.lit(o.date_from)).alias("reaches_start"),
        (F.col("last_match_date") > F.lit(o.date_to)).alias("reaches_past_end"))


def with_match_dates(items: DataFrame, needed: Column, dates: DataFrame) -> DataFrame:
    """Items with `last_match_date`, null where the item is not `needed` to have one.

    Items stored with the date are taken as they are. Otherwise, as most items have no match,
    those go around the join: in it, their null key would put them all into one task.
    """
    if "last_match_date" in items.columns:
        return items
    absent = F.lit(None).cast("date").alias("last_match_date")
    needed = F.coalesce(F.col("full_reconcile_id").isNotNull() & needed, F.lit(False))
    return (items.where(needed).join(dates, "full_reconcile_id", "left")
            .unionByName(items.where(~needed).select("*", absent)))


def reconciled_flag(o: ReportOptions) -> Column:
    """Matched, with nothing in the match after the report's end."""
    past_end = F.col("last_match_date") > F.lit(o.date_to)
    return F.col("full_reconcile_id").isNotNull() & ~F.coalesce(past_end, F.lit(False))


def open_at_start(o: ReportOptions) -> Column:
    """Not matched, or matched by something on or after the report's start."""
    reaches = F.coalesce(F.col("last_match_date") >= F.lit(o.date_from), F.lit(False))
    return F.col("full_reconcile_id").isNull() | reaches


def matching_label(reconciled: Column, match_id: Column, name: Column) -> Column:
    """The match's name; a star if it is completed only after the report's end."""
    return (F.when(match_id.isNotNull() & F.coalesce(reconciled, F.lit(False)), name)
            .when(match_id.isNotNull(), "*").otherwise(""))
