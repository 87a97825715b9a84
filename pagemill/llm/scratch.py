"""Tables that cut lineage, kept in the folder the cluster shares.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and Spark runs on one machine (tests) a
temporary folder is made and set as the checkpoint folder; on a cluster a missing setting is an error, as executors
don't see each other's disks.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; also makes ``DataFrame.checkpoint`` usable."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = _OWN.get(context.applicationId)
        if base is None:
            base = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="pagemill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Actions inside send Python workers batches of about so many bytes, however long the texts; rows alone don't bound them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Parquet tables of one operator call; ``drop`` frees a table and the shuffles behind it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Without names: the whole folder."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [self.path(t) for t in tables] or [self.root]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)

    def settle(self) -> None:
        """Let the cleaner delete shuffle files of finished phases; they else wait for the next collection."""
        gc.collect()
        self.spark._jvm.System.gc()
