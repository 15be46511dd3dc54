"""Worker events and job states as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.jobs import latest, ocr_progress
from quire.sources.files import event_stream


def progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """Progress and message of each worker event as files of JSON lines arrive."""
    return ocr_progress(event_stream(spark, path)).where("progress IS NOT NULL")


def latest_status(updates: DataFrame) -> DataFrame:
    """The last update of each job in a stream, for output mode `update` or `complete`."""
    rest = [c for c in updates.columns if c != "job_id"]
    return updates.groupBy("job_id").agg(F.max_by(F.struct(*rest), "event_id").alias("s")).select("job_id", "s.*")


def counted_by_window(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) a window and type; events later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").count().select(F.col("w.start").alias("start"), "event_type", F.col("count").alias("n"))


def upsert(updates: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps a table of last states under `path`, in one folder a bucket of job ids.

    A batch is merged with the buckets that it touches; each is written as its next version, and the one before is removed
    when that is whole. So a batch costs what it touches, and a batch that is repeated after a failure gives the same states.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch).withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
        for (bucket,) in fresh.select("bucket").distinct().collect():  # `buckets` at most
            folder = f"{path}/bucket={bucket}"
            old = _versions(spark, folder)
            if number in old:  # this batch is repeated, and did get so far
                continue
            mine = fresh.where(F.col("bucket") == bucket).drop("bucket")
            known = [spark.read.parquet(f"{folder}/{v}") for v in old if v < number]
            merged = latest(known[-1].unionByName(mine)) if known else mine
            merged.write.mode("overwrite").parquet(f"{folder}/{number}")
            for v in old:
                if v < number:
                    _remove(spark, f"{folder}/{v}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, path: str) -> DataFrame:
    """The table that `upsert` keeps."""
    return spark.read.parquet(f"{path}/bucket=*/*")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The whole versions of a bucket, in order; one whose writing was broken off has no mark of success."""
    fs, at = _folder(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_folder(spark, f"{folder}/{n}/_SUCCESS")[1]))


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def stop_job(spark: SparkSession, job: str) -> int:
    """Stops the streams that are named for a job and cancels the running work of its job group; how many streams."""
    named = [q for q in spark.streams.active if q.name == job]
    for q in named:
        q.stop()
    spark.sparkContext.cancelJobGroup(job)
    return len(named)
