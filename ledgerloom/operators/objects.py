"""Report objects: the accounts, partners, journals or analytic accounts a report is cut by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import code_and_name, optional_code_and_name
from ledgerloom.operators.scan import move_lines, select_accounts
from ledgerloom.options import OBJECT_COLUMNS, ReportOptions
from ledgerloom.sources.tables import LedgerTables

OBJECT_TABLES = {
    "account": "account_account", "partner": "res_partner", "journal": "account_journal",
    "analytic": "account_analytic_account"}


def object_names(tables: LedgerTables, report_type: str) -> DataFrame:
    """Key and name of every possible object of a report type.

    Analytic accounts read `code name`. (Sorting by `code code`, as ledgers of this kind have
    been seen to do, would differ in section order only.)
    """
    table = tables[OBJECT_TABLES[report_type]]
    if report_type == "partner":
        name = optional_code_and_name(F.col("ref"), F.col("name"))
    elif report_type == "analytic":
        name = optional_code_and_name(F.col("code"), F.col("name"))
    else:
        name = code_and_name(F.col("code"), F.col("name"))
    return table.select(F.col("id").alias("object_id"), name.alias("name"))


def _typed_keys(o: ReportOptions) -> list[Column]:
    return [(F.col("object_id") if column == o.object_column else F.lit(None).cast("bigint"))
            .alias(column) for column in OBJECT_COLUMNS.values()]


def report_objects(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Objects having any item within the report's journals, accounts, partners and analytic
    accounts, whatever its date or state; so some may have no line.

    Keys are made distinct first, then named: the names join a few keys, not all items.
    """
    accounts = select_accounts(tables, o)
    keys = (move_lines(tables, o).join(accounts.select("account_id"), "account_id", "left_semi")
            .select(F.col(o.object_column).alias("object_id")).distinct())
    if o.report_type == "account":
        keys = keys.unionByName(
            unaffected_account(tables, o).select(F.col("account_id").alias("object_id"))
        ).distinct()
    return (keys.join(object_names(tables, o.report_type), "object_id", "left")
            .select(F.lit(o.report_id).cast("bigint").alias("report_id"), "object_id", "name",
                    *_typed_keys(o)))


def unaffected_account(tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """The company's account for the result of prior years: one row if the report covers it.

    Should a company have several, the one with the lowest id is meant; the report covers it
    only if that very account is selected.
    """
    first = (tables["account_account"]
             .where((F.col("company_id") == o.company_id) & F.col("is_unaffected_earnings"))
             .orderBy("id").limit(1).select(F.col("id").alias("account_id")))
    return select_accounts(tables, o).join(first, "account_id", "left_semi")


def whole_company(o: ReportOptions) -> bool:
    """Whether an account report covers all accounts and journals. Then the result of prior
    years is summed in the same pass as everything else."""
    return (o.report_type == "account"
            and not (o.account_select_ids or o.account_group_ids or o.journal_ids))


def unaffected_id(tables: LedgerTables, o: ReportOptions) -> int | None:
    """Id of the account for the result of prior years, if the report covers it: one row,
    looked up once."""
    def find() -> int | None:
        row = unaffected_account(tables, o).select("account_id").first()
        return row.account_id if row else None
    return tables.known(f"unaffected {o.company_id}", find)


def section_heading(objects: DataFrame, tables: LedgerTables, o: ReportOptions) -> DataFrame:
    """Objects with `heading`, the display name sections are titled with."""
    table = tables[OBJECT_TABLES[o.report_type]]
    if o.ledger_type == "aged":
        heading = F.col("name")
    elif o.report_type == "partner":
        heading = F.col("display_name")
    elif o.report_type == "journal":
        heading = F.col("name")
    elif o.report_type == "analytic":
        heading = F.when(F.coalesce("code", F.lit("")) != "",
                         F.concat(F.lit("["), F.col("code"), F.lit("] "), F.col("name"))
                         ).otherwise(F.col("name"))
    else:
        heading = code_and_name(F.col("code"), F.col("name"))
    names = table.select(F.col("id").alias("object_id"), heading.alias("heading"))
    return objects.join(names, "object_id", "left")
