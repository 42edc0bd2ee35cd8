"""Facts kept up to date from a stream of changed files.

The stream has a row for each saved version of a file (id, language, source, version). Each
micro-batch is extracted like a batch and appended with its batch number; ``current_facts``
reads the newest version of each file. A batch that is run again after a failure overwrites its
own folder, so every version counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basaltic.sources.extract import extract

CHANGES = "id string, language string, source string, version long"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files of changed sources in ``folder``."""
    return spark.readStream.schema(CHANGES).parquet(folder)


def keep_facts(stream: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Extracts each micro-batch into ``store/batch=<n>``."""

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct("language", "source", "version"), "version").alias("x")).select("id", "x.*")
        facts = extract(newest).join(newest.select(F.col("id").alias("file_id"), "version"), "file_id")
        facts.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_facts(spark: SparkSession, store: str) -> DataFrame:
    """The facts of each file's newest version."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy("file_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["file_id", "version"]).drop("batch", "version")
