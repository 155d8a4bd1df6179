"""Saved reports and outbound messages derived from the trade tables, for the registered
queries: each grows with the table it is made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas as S


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}.parquet")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _reports(df: DataFrame, **columns: Column) -> DataFrame:
    return S.conform(df.select(*[c.alias(n) for n, c in columns.items()]), S.REPORT_CONFIG)


def nation_reports(spark: SparkSession, path: str) -> DataFrame:
    """One trial balance per nation, with all kinds of options."""
    n = F.col("n_nationkey")
    year = F.make_date(1996 + n % 4, F.lit(1), F.lit(1))
    end = F.make_date(1997 + n % 4, 6 + n % 6, F.lit(15))
    return _reports(
        _read(spark, path, "nation"),
        report_id=n + 1, company_id=F.lit(1), name=F.col("n_name"),
        ledger_type=_pick(("general", "partner", "journal", "open", "aged", "analytic"), n),
        summary=F.lit(True), target_move=_pick(("posted", "all"), n), reconciled=n % 4 != 1,
        result_selection=_pick(("customer", "supplier", "customer_supplier"), n),
        compact_account=n % 5 == 0, init_balance_history=n % 7 != 1,
        date_from=F.when(n % 7 != 6, year), date_to=F.when(n % 8 != 7, end),
        journal_ids=F.when(n % 9 == 4, _ids(1, 3)),
        partner_ids=F.when(n % 10 == 3, F.sequence(F.lit(1), F.lit(100))),
        account_select_ids=F.when(n == 9, _ids(5120, 40103, 41107, 60702, 1200)),
        account_group_ids=F.when(n % 12 == 0, _ids(4, 60)),
        analytic_account_ids=F.when(n == 11, _ids(101, 102, 103)))


def customer_reports(spark: SparkSession, path: str, plain: bool = False) -> DataFrame:
    """One saved report per customer; unless `plain`, with many settings left empty."""
    k = F.col("c_custkey")
    ledgers = ("general", "partner", "journal", "open", "aged", "analytic")
    empty = F.lit(False) if plain else k % 4 == 3
    return _reports(
        _read(spark, path, "customer"),
        report_id=k, company_id=F.lit(1),
        name=F.when(empty, "").otherwise(F.col("c_name")),
        ledger_type=F.when(~empty, _pick(ledgers, k)), summary=k % 2 == 0,
        target_move=F.when(~empty, _pick(("posted", "all"), k)), reconciled=k % 3 == 0,
        result_selection=F.when(~empty, _pick(("customer", "supplier"), k)),
        compact_account=k % 5 == 0, init_balance_history=k % 7 == 0,
        date_from=F.when(k % 11 != 0, F.make_date(F.lit(1997), (k % 12 + 1).cast("int"), F.lit(1))),
        date_to=F.when(k % 13 != 0, F.make_date(F.lit(1998), (k % 12 + 1).cast("int"), F.lit(1))),
        journal_ids=F.when(k % 4 == 0, _ids(1, 3)).when(k % 4 == 1, _ids()),
        partner_ids=F.when(k % 6 < 2, _ids(2, 4, 6)))


def default_reports(spark: SparkSession) -> DataFrame:
    """The options a new report starts with."""
    return _reports(
        spark.range(1), company_id=F.lit(1), name=F.lit("Standard Report"),
        ledger_type=F.lit("general"), summary=F.lit(False), target_move=F.lit("posted"),
        reconciled=F.lit(True), result_selection=F.lit("supplier"),
        compact_account=F.lit(False), init_balance_history=F.lit(True), journal_ids=_ids(2))


def recipients(spark: SparkSession, path: str) -> DataFrame:
    """Phone numbers as people write them: one per event, ten events to a message."""
    user = F.lpad(F.col("user_id").cast("string"), 9, "1")
    form = F.col("event_id") % 6
    number = (F.when(form == 0, F.concat(F.lit("+33 "), user))
              .when(form == 1, F.concat(F.lit("(33)-"), user))
              .when(form == 2, F.concat(F.lit("0"), user, F.lit("^")))
              .when(form == 3, F.substring(user, 1, 6))
              .when(form == 4, F.concat(user, user))
              .otherwise(F.concat(F.lit("+3.3/"), user)))
    return _read(spark, path, "events").select(
        F.expr("event_id div 10").alias("message_id"), number.alias("number"))


def outbound_messages(spark: SparkSession, path: str) -> DataFrame:
    message = F.col("message_id")
    return (_read(spark, path, "events")
            .select(F.expr("event_id div 10").alias("message_id")).distinct()
            .select("message_id",
                    _pick(("primary", "backup", "other"), message).alias("provider"),
                    F.concat(F.lit("Message \"no\" "), message).alias("message")))


def outbound_accounts(spark: SparkSession) -> DataFrame:
    """A usable provider account and one lacking settings."""
    return spark.createDataFrame(
        [("primary", "eu", "key", "secret", "consumer", "sms-1", "Books"),
         ("backup", "eu", "key", "", "consumer", "sms-2", None)], S.OUTBOUND_ACCOUNT)


def outbound_replies(spark: SparkSession, path: str) -> DataFrame:
    form = F.col("event_id") % 4
    return _read(spark, path, "events").select(
        F.col("event_id").alias("message_id"),
        F.when(form == 0, None).when(form == 1, 0.0).otherwise(F.col("value"))
         .cast("double").alias("total_credits_removed"))
