"""Incremental ingestion: new and changed files only, idempotent by (path, hash)."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import chunker

PAGES = "doc_id string, file_path string, content_hash string, page_number int, text string, arrived_at timestamp"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batches; empty before the first one is written. Any other trouble with reading it is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place) or not files.listStatus(place):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def merge_batch(store: str, chunk_size: int = 1000, overlap: int = 150) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch of pages to the tables `pages`, `chunks` and `ledger`.

    The ledger has a row for every (path, hash) that was taken in; a batch that comes again, as after a
    failure, changes nothing. Every batch writes its own folder, so nothing is rewritten.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = ["file_path", "content_hash"]
        folder = f"batch={number}"
        ledger = _read(spark, f"{store}/ledger", "file_path string, content_hash string, doc_id string, batch int")
        fresh = batch.join(ledger.where(F.col("batch") != number).select(*key).distinct(), key, "left_anti").dropDuplicates(["doc_id", "page_number", *key]).persist()
        try:
            fresh.write.mode("overwrite").parquet(f"{store}/pages/{folder}")
            chunker.chunk_documents(fresh, chunk_size, overlap).write.mode("overwrite").parquet(f"{store}/chunks/{folder}")
            # the ledger comes last: a batch counts as taken in only when its tables are there
            fresh.select(*key, "doc_id").distinct().write.mode("overwrite").parquet(f"{store}/ledger/{folder}")
        finally:
            fresh.unpersist()

    return run


def start(spark: SparkSession, source: str, store: str, checkpoint: str, trigger: dict | None = None, files_per_batch: int = 1000):
    """Run the ingestion over a folder of page tables; by default all that is there, then stop."""
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(merge_batch(store)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The rows of a table that belong to the last version of each path, which the batch that took it in wrote."""
    ledger = _read(spark, f"{store}/ledger", "file_path string, content_hash string, doc_id string, batch int")
    last = ledger.groupBy("file_path").agg(F.max_by(F.struct("doc_id", "batch"), "batch").alias("v")).select("v.doc_id", "v.batch").distinct()
    return spark.read.parquet(f"{store}/{table}").join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def arrivals(pages: DataFrame, delay: str = "3 days", window: str = "1 day") -> DataFrame:
    """Pages by day of extraction on a stream, late ones counted up to `delay`."""
    return pages.withWatermark("extracted_at", delay).groupBy(F.window("extracted_at", window)).agg(F.count("*").alias("pages"))


def safe_name(path: str) -> str:
    """A path for a text file; refuses those that climb out of their folder or reach into the system."""
    p = PurePosixPath(path)
    if ".." in p.parts or (p.is_absolute() and p.parts[1:2] and p.parts[1] in ("bin", "boot", "dev", "etc", "lib", "proc", "sbin", "sys", "usr")):
        raise ValueError(f"refused: {path}")
    return str(p)
