"""Outbound text messages: recipient cleaning, send jobs and reply classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters and lengths a number may have, and the job's settings.
NOT_DIALLED = "[^0-9^+]"
SHORTEST, LONGEST = 7, 15
CHARSET, CODING, PRIORITY, VALIDITY_MINUTES = "UTF-8", "7bit", "high", 2880
ACCOUNT_SETTINGS = ("endpoint", "application_key", "application_secret", "consumer_key",
                    "sms_account", "sender")
INSUFFICIENT_CREDIT = "insufficient credit"


def clean_number(number: Column) -> Column:
    """Keep digits, plus signs and carets. (The caret is let through as part of the rule as it
    stands; a leading zero is not rejected either.)"""
    return F.regexp_replace(number, NOT_DIALLED, "")


def clean_numbers(messages: DataFrame) -> DataFrame:
    """One row per message and number it goes to: cleaned, of a legal length, each once.

    Takes `numbers` as an array or one `number` per row. Copies are dropped by message and
    number together, so a message of any size is spread over tasks.
    """
    if "numbers" in messages.columns:
        messages = messages.select("message_id", F.explode("numbers").alias("number"))
    return (messages.select("message_id", clean_number(F.col("number")).alias("number"))
            .where(F.length("number").between(SHORTEST, LONGEST))
            .dropDuplicates(["message_id", "number"]))


def _complete() -> Column:
    filled = F.lit(True)
    for setting in ACCOUNT_SETTINGS:
        filled = filled & (F.coalesce(F.col(setting), F.lit("")) != "")
    return filled


def valid_accounts(accounts: DataFrame) -> DataFrame:
    """Provider accounts with all settings filled in."""
    return accounts.where(_complete())


def rejected_accounts(accounts: DataFrame) -> DataFrame:
    """Provider accounts that cannot be used, with the settings they lack."""
    lacking = [F.when(F.coalesce(F.col(s), F.lit("")) == "", s) for s in ACCOUNT_SETTINGS]
    return accounts.where(~_complete()).select(
        "provider", F.array_compact(F.array(*lacking)).alias("missing_settings"))


def route(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Messages with `route`: their provider if it has an account, complete or not, else the
    default route."""
    known = accounts.select("provider", F.lit(True).alias("_known")).distinct()
    return (messages.join(known, "provider", "left")
            .withColumn("route", F.when(F.col("_known"), F.col("provider")).otherwise("default"))
            .drop("_known"))


def _sendable(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """Routed messages whose account is complete, with the account's settings."""
    return (route(messages, accounts).where(F.col("route") != "default")
            .join(valid_accounts(accounts).select("provider", "sms_account", "sender"),
                  "provider"))


def send_jobs(messages: DataFrame, accounts: DataFrame,
              recipients: DataFrame | None = None) -> DataFrame:
    """One send job per routed message whose account is complete: its settings as JSON and how
    many receivers it has. The receivers themselves are rows, see `job_receivers`, so a
    message may have any number of them."""
    numbers = clean_numbers(messages) if recipients is None else recipients
    counts = numbers.groupBy("message_id").agg(F.count(F.lit(1)).alias("receiver_count"))
    job = F.struct(
        F.lit(CHARSET).alias("charset"), F.lit(CODING).alias("coding"), F.col("message"),
        F.lit(True).alias("noStopClause"), F.lit(PRIORITY).alias("priority"),
        F.lit(False).alias("senderForResponse"),
        F.lit(VALIDITY_MINUTES).alias("validityPeriod"), F.col("sender"))
    return _sendable(messages, accounts).join(counts, "message_id", "left").select(
        "message_id", "provider", "sms_account",
        F.coalesce("receiver_count", F.lit(0)).cast("bigint").alias("receiver_count"),
        F.to_json(job).alias("job"))


def job_receivers(messages: DataFrame, accounts: DataFrame,
                  recipients: DataFrame | None = None) -> DataFrame:
    """The receivers of the send jobs: one row per message and number."""
    numbers = clean_numbers(messages) if recipients is None else recipients
    return numbers.join(_sendable(messages, accounts).select("message_id", "provider"),
                        "message_id").select("message_id", "provider", "number")


def write_outbox(jobs: DataFrame, receivers: DataFrame, path: str) -> None:
    """Store send jobs and their receivers by provider for the program that posts them."""
    for name, rows in (("jobs", jobs), ("receivers", receivers)):
        rows.write.mode("overwrite").partitionBy("provider").parquet(f"{path}/{name}")


def classify_replies(replies: DataFrame) -> DataFrame:
    """Replies with `success`: sent if credits were taken; none or no figure is a failure."""
    paid = F.coalesce(F.col("total_credits_removed") > 0, F.lit(False))
    return replies.withColumns({
        "success": paid, "error": F.when(~paid, INSUFFICIENT_CREDIT)})
