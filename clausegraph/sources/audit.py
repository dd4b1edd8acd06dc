"""Append-only audit and feedback logs, partitioned by day."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = """ts string, client string, question string, previous_question string, intent string, refused boolean,
  crag string, strategy string, articles array<string>, latency_ms bigint, cached boolean"""
FEEDBACK_SCHEMA = """ts string, client string, question string, reason string, comment string, answer_preview string,
  intent string, articles array<string>"""
# Length limits of a feedback row.
FEEDBACK_LIMITS = {"question": 500, "reason": 40, "comment": 1000, "answer_preview": 500, "intent": 40}
FEEDBACK_ARTICLES = 12


def day_of(ts):
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyyMMdd")


def append_log(rows: DataFrame, path: str, ts: str = "ts") -> None:
    rows.withColumn("day", day_of(F.to_timestamp(ts))).write.mode("append").partitionBy("day").json(path)


def clean_day(day: str) -> str:
    digits = re.sub(r"\D", "", day or "")
    if len(digits) != 8:
        raise ValueError("day must have eight digits")
    return digits


def read_day(spark: SparkSession, path: str, day: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Rows of one day; malformed lines are skipped, a missing day is empty."""
    folder = f"{path}/day={clean_day(day)}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def list_days(logs: DataFrame, limit: int = 31) -> DataFrame:
    return logs.select("day").distinct().orderBy(F.col("day").desc()).limit(max(1, limit))


def export_lines(rows: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def valid_feedback(rows: DataFrame, reasons: list[str]) -> DataFrame:
    """Feedback with an allowed reason and lengths within limits; article lists are cut to the allowed number."""
    keep = F.col("reason").isin(*reasons) & (F.char_length(F.trim("question")) > 0)
    for column, limit in FEEDBACK_LIMITS.items():
        keep = keep & (F.char_length(F.coalesce(column, F.lit(""))) <= limit)
    return rows.where(keep).withColumn("articles", F.slice(F.coalesce("articles", F.array().cast("array<string>")), 1, FEEDBACK_ARTICLES))
