"""Mail sources: CSV of raw messages, CSV of labelled messages, parsing, sinks and model folders."""

from __future__ import annotations

import email
from email import policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quoted

def read_corpus(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """CSV with a quoted ``message`` (or ``Message``) column of whole mails: one column, message; most: rows at most, if given."""
    rows = quoted.read(spark, path, ["message"])
    return rows.limit(most) if most is not None else rows


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """CSV with Subject, Message and Spam/Ham: subject, message, label (ham or spam; others are left out)."""
    rows = quoted.read(spark, path, ["Subject", "Message", "Spam/Ham"])
    label = F.lower(F.trim(F.col("`Spam/Ham`")))
    return rows.select(F.coalesce("Subject", F.lit("")).alias("subject"), F.coalesce("Message", F.lit("")).alias("message"), label.alias("label")).filter(label.isin("ham", "spam"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def parse(mails: DataFrame) -> DataFrame:
    """mail_id and message to mail_id, sender, recipients, subject, body (the first text/plain part), failed. Null messages fail."""

    def one(raw: str | None) -> tuple:
        if raw is None:
            return "", "", "", "", True
        try:
            m = email.message_from_string(raw, policy=policy.compat32)
            part = next((p for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_multipart()), None)
            # a part that isn't encoded for transport is text already
            coded = part is not None and str(part["content-transfer-encoding"] or "").lower().strip() in ("base64", "quoted-printable")
            text = "" if part is None else part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace") if coded else str(part.get_payload())
            return str(m["from"] or ""), str(m["to"] or ""), str(m["subject"] or ""), text, False
        except (LookupError, ValueError, UnicodeError):
            return "", "", "", "", True

    def run(frames):
        for pdf in frames:
            cols = list(zip(*map(one, pdf["message"]))) or [[], [], [], [], []]
            yield pd.DataFrame({"mail_id": pdf["mail_id"], **dict(zip(("sender", "recipients", "subject", "body", "failed"), cols))})

    return mails.select(F.col("mail_id").cast("long").alias("mail_id"), "message").mapInPandas(run, "mail_id long, sender string, recipients string, subject string, body string, failed boolean")
