"""The audit log: an append-only table, readable as a table or as a stream."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "timestamp string, action string, details map<string,string>"


def append(spark: SparkSession, path: str, action: str, details: dict) -> None:
    """One entry as a new file. Details named timestamp or action take the place of the entry's own, and values that are no texts are JSON."""
    entry = {"timestamp": datetime.now(UTC).isoformat(), "action": action}
    entry |= {k: str(v) for k, v in details.items() if k in entry}
    rest = {k: v if isinstance(v, str) else json.dumps(v) for k, v in details.items() if k not in entry}
    spark.createDataFrame([(entry["timestamp"], entry["action"], rest)], LOG).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path).orderBy("timestamp")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """New entries as they come."""
    return spark.readStream.schema(LOG).json(path)


def action_counts(entries: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, action, n) of a log or a stream of one; a stream forgets windows that are ``late`` behind."""
    timed = entries.withColumn("at", F.to_timestamp("timestamp"))
    timed = timed.withWatermark("at", late) if entries.isStreaming else timed
    return timed.groupBy(F.window("at", window), "action").agg(F.count("*").alias("n"))
