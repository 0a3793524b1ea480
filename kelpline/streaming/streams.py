"""Structured Streaming forms of the sync: changed files as a stream, and windowed counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.publish import Folder, numbered
from ..session import materialize, shared_dir, table


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A table folder (or file) as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there in micro-batches; a later run with the same checkpoint goes on behind it."""
    stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def best(df: DataFrame) -> DataFrame:
    """The current reading of each path."""
    rank = F.struct("modified_time", "received_at", "obs_id")
    one = df.where("content_hash IS NOT NULL AND source_path IS NOT NULL").groupBy("source_path").agg(F.max(F.struct(rank.alias("r"), "content_hash")).alias("m"))
    return one.select("source_path", "m.r.modified_time", "m.r.received_at", "m.r.obs_id", "m.content_hash")


class CurrentFiles:
    """Current content of each path, kept up to date by streaming upserts under ``root``.

    A batch is reduced to one row per path and rewrites only the buckets with such a path.  Its result is
    named after the batch, so a batch that is repeated after a failure gives the same rows again; the next
    run resumes from the checkpoint.
    """

    SCHEMA = "source_path string, modified_time double, received_at timestamp, obs_id long, content_hash string"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.buckets, self.root = spark, buckets, root.rstrip("/")
        self.folder = Folder(spark, root)

    def _last(self, before: int | None = None) -> dict[str, str]:
        found = [x for x in numbered(self.folder.names(), "STATE-") if before is None or x[0] < before]
        return json.loads(self.folder.read(found[-1][1])) if found else {}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def update(self, batch: DataFrame, number: int) -> None:
        if self.folder.exists(f"STATE-{number:09d}"):
            return  # published before the failure that made the batch come again
        held = self._last(number)
        bucket = F.pmod(F.xxhash64("source_path"), F.lit(self.buckets)).cast("int")
        fresh = materialize(best(batch).withColumn("bucket", bucket), "batch")
        touched = [str(r[0]) for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        merged = best(self._read([held[b] for b in touched if b in held]).unionByName(fresh.drop("bucket")))
        path = f"data-{number:09d}-{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        self.folder.publish(f"STATE-{number:09d}", json.dumps(held | {b: f"{path}/bucket={b}" for b in touched}))

    def run(self, stream: DataFrame) -> DataFrame:
        """Take in what the stream holds; the state afterwards."""
        run_available(stream.select("source_path", "modified_time", "received_at", "obs_id", "content_hash"), self.update, f"{self.root}/checkpoint")
        return self._read(sorted(self._last().values()))


def current_files(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Current content of each path of the scan log; with ``root`` a later call goes on where this one ended."""
    where = root or f"{shared_dir(spark)}/kelpline/streams/current-{uuid.uuid4().hex}"
    state = CurrentFiles(spark, where).run(read_table_stream(spark, sf_dir, "scan_log"))
    return state.select(F.col("source_path").alias("path"), F.col("content_hash").alias("hash"))


def event_counts(events: DataFrame, lateness: str, window: str = "1 hour") -> DataFrame:
    """Events per window and type; rows later than ``lateness`` behind the newest one no longer count."""
    counts = events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "events", "total")


def hourly_events(spark: SparkSession, sf_dir: str, root: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """Events per hour and type.

    Update mode: a batch sends on only the windows it changed, the watermark drops the state of closed ones,
    and of the rows of one window the latest batch counts.  With ``root`` a later call goes on where this
    one ended.  The whole table is one batch (its files are not in order of time), so that none is late.
    """
    where = root or f"{shared_dir(spark)}/kelpline/streams/hourly-{uuid.uuid4().hex}"
    events = read_table_stream(spark, sf_dir, "events", files_per_trigger=2**31 - 1).withColumn("ts", F.col("ts").cast("timestamp"))

    def on_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/windows/batch={number}")

    run_available(event_counts(events, lateness), on_batch, f"{where}/checkpoint", "update")
    schema = "start timestamp, event_type string, events long, total double, batch long"
    written = spark.read.schema(schema).option("basePath", f"{where}/windows").parquet(f"{where}/windows")
    last = written.groupBy("start", "event_type").agg(F.max_by(F.struct("events", "total"), "batch").alias("x"))
    return last.select("start", "event_type", "x.events", F.round("x.total", 4).alias("total"))


class Progress(StreamingQueryListener):
    """Passes progress of streaming syncs to a callback ``(event, rows)``."""

    def __init__(self, callback: Callable[[str, int], None]):
        self.callback = callback

    def onQueryStarted(self, event):
        self.callback("sync_started", 0)

    def onQueryProgress(self, event):
        self.callback("sync_progress", int(event.progress.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.callback("sync_finished", 0)
