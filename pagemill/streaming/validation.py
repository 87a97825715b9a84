"""Translations checked as they arrive: a stream of zone files against the table of zones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.contracts import zone_result_errors
from pagemill.sources.records import TRANSLATION, checked


def zone_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of whole zone files ``<page_id>_zone-NNN.jsonl``: (page_id, zone_id, content)."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(path)
    name = F.col("_metadata.file_name")
    return files.select(F.regexp_extract(name, r"^(\d+)_(zone-\d{3,})\.jsonl$", 1).try_cast("bigint").alias("page_id"), F.regexp_extract(name, r"^(\d+)_(zone-\d{3,})\.jsonl$", 2).alias("zone_id"), F.col("value").alias("content"))


def batch_status(files: DataFrame, zones: DataFrame, segments: DataFrame) -> DataFrame:
    """(page_id, zone_id, ok, error) of whole zone files."""
    lines = files.select("page_id", "zone_id", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(r"\S"))
    rows = checked(lines, TRANSLATION)
    # a line without a sound record counts as one of a wrong type
    results = rows.select("page_id", "zone_id", F.when(F.col("error").isNull(), F.col("record.segment_id")).alias("segment_id"), F.col("record.text").alias("text"))
    arrived = files.select("page_id", "zone_id").distinct()
    own = zones.join(arrived, [zones["page_id"] == arrived["page_id"], zones["id"] == arrived["zone_id"]], "left_semi")
    errors = zone_result_errors(own, results, segments)
    return arrived.join(errors, ["page_id", "zone_id"], "left").select("page_id", "zone_id", F.col("error").isNull().alias("ok"), "error")


def validate_stream(spark: SparkSession, path: str, zones: DataFrame, segments: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of files goes through the contract of zones; ``sink`` gets the status rows."""
    return zone_files(spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda files, n: sink(batch_status(files, zones, segments), n)).start()
