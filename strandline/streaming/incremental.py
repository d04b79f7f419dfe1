"""Incremental processing with Structured Streaming: exactly-once files, late data, first occurrences, running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.session import materialize, release


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 96) -> DataFrame:
    """Each file once, in the order of arrival; the checkpoint of the query takes the place of done markers."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def drain(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; run again later, it continues where it was."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "21 days") -> DataFrame:
    """(day, keys, n) per tumbling day; rows later than the watermark are dropped, days come out once it has passed."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("date").alias("day"), *keys, "n")


def sliding_counts(stream: DataFrame, ts: str, size: str, slide: str, keys: list[str], late: str = "21 days") -> DataFrame:
    """(start, keys, n) over overlapping windows: each window sees the days around its core."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str = "21 days") -> DataFrame:
    """(start, end, keys, n): events chained as long as the next comes within the gap."""
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_occurrences(stream: DataFrame, keys: list[str], ts: str, within: str = "1 day") -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def append_unseen(path: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For drain_batches: rows whose keys the output lacks, each key once; a repeated batch adds nothing. NULL keys match NULL keys.

    The output lies in ``buckets`` folders by digest of the keys; a batch is compared with the keys of the folders it touches only.
    """

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = materialize(batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "new")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        lacking = new
        try:
            have = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*(F.col(k).alias(f"__h_{k}") for k in keys)).distinct()
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
            lacking = new.join(have, on, "left_anti")
        except AnalysisException as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        lacking.write.mode("append").partitionBy("bucket").parquet(path)
        release(new)

    return handle


def running_totals(path: str, keys: list[str], date: str, days: int) -> Callable[[DataFrame, int], None]:
    """For drain_batches: per key and day counts, kept for ``days`` days before the batch's latest, replaced by day.

    The table is the state: a batch is added to the days it touches, so trailing counts over
    it equal those of a batch job over all rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys, F.col(date).cast("date").alias("day")).agg(F.count("*").alias("n"))
        root = f"{path}/version="
        if batch_id > 0:
            new = new.unionByName(spark.read.parquet(f"{root}{batch_id - 1}")).groupBy(*keys, "day").agg(F.sum("n").alias("n"))
        last = new.agg(F.max("day")).first()[0]
        kept = new if last is None else new.where(F.col("day") > F.date_sub(F.lit(last), days))
        kept.write.mode("overwrite").parquet(f"{root}{batch_id}")

    return handle
