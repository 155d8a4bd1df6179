"""Column functions shared by the ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schemas import AGE_COLUMNS, AGE_EDGES


def sum0(value: str | Column) -> Column:
    """Sum that is zero, not null, over no rows."""
    if isinstance(value, str):
        return F.expr(f"coalesce(sum(`{value}`), 0)")
    return F.coalesce(F.sum(value), F.lit(0))


def exceeds(amount: str, rounding: Decimal | str | None) -> Column:
    """Whether an amount counts: it is more than half the currency's smallest unit, which is
    given as a number or as the name of its column."""
    if rounding is None:
        return F.lit(None).cast("boolean")
    half = f"`{rounding}` / 2" if isinstance(rounding, str) else f"{rounding / 2:f}BD"
    return F.expr(f"abs(`{amount}`) > {half}")


def net_opening(debit: Column, credit: Column, balance: Column,
                history: bool | Column) -> tuple[Column, Column]:
    """Opening debit and credit: as they are with history, else the net amount on its side."""
    history = F.lit(history) if isinstance(history, bool) else history
    zero = F.lit(0).cast("decimal(18,2)")
    return (F.when(history, debit).otherwise(F.greatest(balance, zero)),
            F.when(history, credit).otherwise(F.greatest(-balance, zero)))


def age_of(due: Column, to: Column, edges: Sequence[int] = AGE_EDGES) -> Column:
    """Name of the age column an amount due on a day belongs in at `to`. No due date means no
    column at all."""
    name = F.when(due > to, AGE_COLUMNS[0])
    for days, column in zip(edges, AGE_COLUMNS[1:]):
        name = name.when(due > F.date_sub(to, days), column)
    return name.when(due.isNotNull(), AGE_COLUMNS[-1])


def age_buckets(due: Column, amount: Column, to: Column,
                edges: Sequence[int] = AGE_EDGES) -> dict[str, Column]:
    """The amount in the column of its age."""
    age = age_of(due, to, edges)
    return {name: F.when(age == name, amount) for name in AGE_COLUMNS}


def round_to(amount: Column, unit: Column) -> Column:
    """Round half away from zero to a multiple of `unit`."""
    return F.when(unit > 0, F.round(amount / unit) * unit).otherwise(amount)


def code_and_name(code: Column, name: Column) -> Column:
    """`code name`; null if either is."""
    return F.concat(code, F.lit(" "), name)


def optional_code_and_name(code: Column, name: Column) -> Column:
    """`code name`, or the name alone where there is no code."""
    return F.when(code.isNull(), name).otherwise(code_and_name(code, name))


def analytic_label(code: Column, name: Column) -> Column:
    return F.when(code.isNotNull() & (code != ""), F.concat(code, F.lit(" - "), name)).otherwise(name)


def blank_zero(amount: Column) -> Column:
    """Null for zero: statements leave such cells empty."""
    return F.when(amount != 0, amount)
