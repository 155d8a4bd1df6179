"""What was before a report's start, from a store's sums per month instead of from the items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.options import ReportOptions
from ledgerloom.sources.tables import LedgerTables

_LIKE_ITEMS = ("company_id", "account_id", "journal_id", "partner_id", "parent_state", "date",
               "full_reconcile_id", "last_match_date", "display_type", *S.FLOWS)


def past(tables: LedgerTables, o: ReportOptions) -> LedgerTables:
    """Tables whose items are rows that add up to those before the start, for openings and the result
    of prior years.

    A store's sums stand for all items of the months before the start's, under the first day of their
    months. The start's own month is known to the day only from items: those of its days before the
    start, and those of any date whose match is complete in it; a match of another month is clearly
    before or after the start. Without a store, these are the items themselves.
    """
    if tables.rollup is None:
        return tables
    year, first = o.date_from.year, o.date_from.replace(day=1)
    following = (first + dt.timedelta(days=31)).replace(day=1)
    cells = tables.rollup.where(
        (F.col("company_id") == o.company_id) & (F.col("date_year") <= year)
        & (F.col("month") < F.lit(first)) & ~F.col("match_month").eqNullSafe(F.lit(first)))
    cells = cells.withColumns({
        "date": F.col("month"), "last_match_date": F.col("match_month"),
        "full_reconcile_id": F.when(F.col("matched"), F.lit(0)).cast("bigint"),
        "display_type": F.lit(None).cast("string")})
    days = ((F.col("date_year") == year) & (F.col("date") >= F.lit(first))
            & (F.col("date") < F.lit(o.date_from)))
    settled = ((F.col("open_year") == year) & (F.col("date") < F.lit(first))
               & (F.col("last_match_date") >= F.lit(first))
               & (F.col("last_match_date") < F.lit(following)))
    items = tables.items.where((F.col("company_id") == o.company_id) & (days | settled)
                               & F.col("display_type").isNull())
    rows = cells.select(*_LIKE_ITEMS).unionByName(items.select(*_LIKE_ITEMS))
    frames = {n: f for n, f in tables.frames.items() if n != "rollup"}
    return LedgerTables({**frames, "account_move_line": rows}, tables._known)
