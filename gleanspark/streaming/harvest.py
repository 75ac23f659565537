"""A growing folder as a stream: each content once, whatever its files are called, with a table of what is done and one of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanspark.functions import text as T
from gleanspark.sources import formats

DONE = "content_hash string, doc_id string, status string, batch long, at timestamp"
EVENTS = "seq long, type string, doc_id string, stage string, message string, at timestamp"


def new_files(spark: SparkSession, folder: str, suffixes=None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, suffix, length, content, content_hash). Writers move whole files in; empty ones are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    suffix = formats.suffix_of(F.col("path"))
    wanted = formats.supported_suffixes() if suffixes is None else ["." + x.lower().lstrip(".") for x in suffixes]
    return s.where((F.col("length") > 0) & suffix.isin(*wanted)).select("path", suffix.alias("suffix"), "length", "content", T.content_hash(F.col("content")).alias("content_hash"))


def replace_part(rows: DataFrame, path: str, number: int) -> None:
    """Write a batch's rows as the table's part of that number, in place of what a failed attempt may have left."""
    rows.withColumn("part", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def unclaimed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose content isn't done; of equal contents the one of the least path."""
    first = files.groupBy("content_hash").agg(F.min("path").alias("path"))
    return files.join(first, ["content_hash", "path"], "left_semi").join(done.where("status = 'ok'").select("content_hash").distinct(), "content_hash", "left_anti")


def harvest(spark: SparkSession, folder: str, state: str, handle: Callable[[DataFrame], DataFrame], suffixes=None, poll_seconds: float | None = None) -> StreamingQuery:
    """Run ``handle`` over new contents: it takes unclaimed files and returns (content_hash, doc_id, status), of which 'ok' is final.

    The checkpoint and the table of what is done lie in the shared folder ``state``. A batch that is repeated after a failure finds its
    finished contents done. A failed content comes again when its file does, or by ``pending``. Without polling the stream ends when
    all that is there is done.
    """
    done_path, event_path = f"{state}/done", f"{state}/events"

    def batch(files: DataFrame, number: int) -> None:
        todo = unclaimed(files, table_or_none(spark, done_path, DONE))
        out = handle(todo).select("content_hash", "doc_id", "status", F.lit(number).cast("long").alias("batch"), F.current_timestamp().alias("at"))
        replace_part(out, done_path, number)
        own = table_or_none(spark, done_path, DONE).where(F.col("batch") == number)
        # a sequence number of batch and place: it rises within and over batches, and a repeated batch gives the same rows again
        events = own.select((F.lit(number).cast("long") * (1 << 40) + F.monotonically_increasing_id()).alias("seq"), F.when(F.col("status") == "ok", "document_done").otherwise("document_failed").alias("type"), "doc_id", F.lit("harvest").alias("stage"), "status", "at").withColumnRenamed("status", "message")
        replace_part(events, event_path, number)

    writer = new_files(spark, folder, suffixes).writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(availableNow=True) if poll_seconds is None else writer.trigger(processingTime=f"{poll_seconds} seconds")).start()


def claim_stats(spark: SparkSession, state: str) -> DataFrame:
    """(done, failed): contents by their best outcome."""
    best = table_or_none(spark, f"{state}/done", DONE).groupBy("content_hash").agg(F.max(F.col("status") == "ok").alias("ok"))
    return best.agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))


def event_history(spark: SparkSession, state: str, after: int = -1, most: int | None = None) -> DataFrame:
    """Events after a number, in order; with ``most`` the last so many: the option's meaning."""
    e = table_or_none(spark, f"{state}/events", EVENTS).where(F.col("seq") > after)
    return e.orderBy("seq") if most is None else e.orderBy(F.desc("seq")).limit(most).orderBy("seq")
