"""Run folders as tables: what a stage has written, read back and checked, and bundles of pages for readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.contract import AssemblyError


def write_stage(df: DataFrame, root: str, stage: str, buckets: int = 64, again: bool = False) -> None:
    """A stage table, in folders by a hash of the page; an existing one is an error, or with ``again`` replaced."""
    placed = df.withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").write.mode("overwrite" if again else "errorifexists").partitionBy("bucket").parquet(f"{root}/{stage}")


def read_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stage}").drop("bucket")


def page_of(df: DataFrame, page_id: int, buckets: int = 64) -> DataFrame:
    """Rows of one page from a table of ``write_stage``; reads one folder."""
    bucket = F.pmod(F.xxhash64(F.lit(page_id).cast("bigint")), F.lit(buckets)).cast("int")
    return df.where((F.col("bucket") == bucket) & (F.col("page_id") == page_id))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def changed_files(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): ``missing``, ``unexpected`` or ``changed`` files; both need (path, sha256)."""
    both = recorded.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full")
    problem = F.when(F.col("b").isNull(), F.lit("missing")).when(F.col("a").isNull(), F.lit("unexpected")).when(F.col("a") != F.col("b"), F.lit("changed"))
    return both.select("path", problem.alias("problem")).where("problem is not null")


def late_charset(pages: DataFrame) -> DataFrame:
    """Pages that don't name their charset within the first 1024 bytes."""
    head = F.substring(F.col("html").cast("binary"), 1, 1024 + len('<meta charset="utf-8"')).cast("string")
    place = F.locate('<meta charset="utf-8"', head)
    return pages.where((place == 0) | (F.octet_length(F.expr("substring(html, 1, locate('<meta charset=\"utf-8\"', html) - 1)")) >= 1024)).select("page_id")


def write_pages(pages: DataFrame, root: str) -> DataFrame:
    """Writes ``<root>/<page_id>/index.html`` for each page; (page_id, path, bytes) of what was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, folder = html.encode(), f"{base}/{page_id}"
                place = data.find(b'<meta charset="utf-8"')
                if not 0 <= place < 1024:
                    raise AssemblyError("UTF-8 charset declaration must occur in the first 1024 bytes")
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/index.html.part") as out:
                    out.write(data)
                system.move(f"{folder}/index.html.part", f"{folder}/index.html")
                rows.append({"page_id": page_id, "path": f"{page_id}/index.html", "bytes": len(data)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return pages.select("page_id", "html").where("html is not null").mapInArrow(write, "page_id bigint, path string, bytes bigint")
