"""Incremental sync as keyed diffs between files and the saved state, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("indexed_at", T.StringType()), T.StructField("chunk_count", T.IntegerType()),
        T.StructField("chunk_ids", T.ArrayType(T.LongType())), T.StructField("mtime", T.DoubleType()), T.StructField("image_count", T.IntegerType()), T.StructField("image_ids", T.ArrayType(T.LongType())),
    ]
)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def latest_state(states: DataFrame) -> DataFrame:
    """One row per path: that of the greatest ``run_id``, ties by time and hash."""
    rest = [c for c in states.columns if c != "path"]
    return states.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("run_id", "mtime", "content_hash")).alias("s")).select("path", "s.*")


def classify(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """``(path, status, touched, hash, mtime, old_hash, old_ids)`` for every path on either side.

    ``files`` has ``path, mtime, hash``, ``state`` the columns of ``STATE``; one row per path on each side.
    Statuses are ``new``, ``modified``, ``unchanged`` and ``deleted``.  A file counts as read (its hash is
    compared) only if its time differs from the saved one or none was saved; with an equal hash it is
    unchanged but ``touched``.
    """
    f = files.select("path", F.col("mtime").alias("_m"), "hash", F.lit(True).alias("_f"))
    s = state.select("path", F.col("mtime").alias("_sm"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("_s"), F.concat(F.coalesce("chunk_ids", F.array().cast("array<bigint>")), F.coalesce("image_ids", F.array().cast("array<bigint>"))).alias("old_ids"))
    moved = F.col("_sm").isNull() | (F.col("_sm") != F.col("_m"))
    differs = ~F.col("hash").eqNullSafe(F.col("old_hash"))
    status = (
        F.when(F.col("_f").isNull(), "deleted").when(F.col("_s").isNull(), "new").when(F.lit(force), "modified").when(moved & differs, "modified").otherwise("unchanged")
    )
    touched = (status == "unchanged") & moved
    return f.join(s, "path", "full_outer").select("path", status.alias("status"), touched.alias("touched"), "hash", F.col("_m").alias("mtime"), "old_hash", "old_ids")


def stale_points(classified: DataFrame) -> DataFrame:
    """Ids of points that must go: of modified and deleted files, each once."""
    return classified.where(F.col("status").isin("modified", "deleted")).select(F.explode("old_ids").alias("id")).distinct()


def sync_summary(classified: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: added, updated, deleted, unchanged and the sorted list of failed paths."""
    if failed is not None:
        classified = classified.join(failed.select("path", F.lit(True).alias("_failed")).distinct(), "path", "left")
    else:
        classified = classified.withColumn("_failed", F.lit(None).cast("boolean"))
    ok = F.col("_failed").isNull()
    return classified.agg(
        F.count_if((F.col("status") == "new") & ok).alias("added"), F.count_if((F.col("status") == "modified") & ok).alias("updated"), F.count_if(F.col("status") == "deleted").alias("deleted"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"), F.array_sort(F.collect_list(F.when(~ok, F.col("path")))).alias("failed"),
    )


def index_summary(chunks: DataFrame, failed: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: total_files (0 if no chunk came out), total_chunks, failed_files, skipped_files.

    The list of failed files is the report itself; it is as long as there are failed files.
    """
    none = F.lit(None).cast("string")
    rows = chunks.select("source", none.alias("bad")).unionByName(failed.select(none.alias("source"), F.col("source").alias("bad")))
    return rows.agg(
        F.count_distinct("source").alias("total_files"), F.count("source").alias("total_chunks"), F.array_sort(F.collect_set("bad")).alias("failed_files"), F.lit(skipped).alias("skipped_files")
    )


def status_report(classified: DataFrame) -> DataFrame:
    """``(status, files)`` with one row per status that occurs."""
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def last_indexed(state: DataFrame) -> DataFrame:
    return state.agg(F.max("indexed_at").alias("last_indexed"), F.count(F.lit(1)).alias("tracked"), F.sum("chunk_count").alias("chunks"))


def pending(classified: DataFrame, limit: int = 5) -> DataFrame:
    """The first pending paths in order; ``limit`` is the feature (the report shows five)."""
    return classified.where(F.col("status").isin("new", "modified")).select("path", "status").orderBy("path").limit(limit)


def new_state(classified: DataFrame, indexed: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """The state after a run: indexed files replaced, touched ones with their new time, deleted ones gone.

    ``indexed`` has ``path, content_hash, chunk_ids, mtime, image_ids``; paths that failed keep their row.
    """
    fresh = indexed.select(
        "path", "content_hash", F.lit(now).alias("indexed_at"), F.size("chunk_ids").alias("chunk_count"), "chunk_ids", "mtime", F.size("image_ids").alias("image_count"), "image_ids"
    )
    kept = state.join(fresh.select("path"), "path", "left_anti").join(classified.where("status = 'deleted'").select("path"), "path", "left_anti")
    times = classified.where("touched").select("path", F.col("mtime").alias("_new"))
    kept = kept.join(times, "path", "left").withColumn("mtime", F.coalesce("_new", "mtime")).drop("_new")
    return kept.select(*[f.name for f in STATE]).unionByName(fresh.select(*[f.name for f in STATE]))


def state_json_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_state_json(spark: SparkSession, path: str) -> DataFrame:
    """State rows of a JSON file ``{"files": {path: {...}}}``; a missing file is an empty state, missing optional keys take defaults."""
    if not state_json_exists(spark, path):
        return spark.createDataFrame([], STATE)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    entry = T.StructType([f for f in STATE])
    if p.getName()[:1] in "._":  # table readers skip hidden files
        stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        raw = spark.createDataFrame([(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"),)], "value string")
        stream.close()
    else:
        raw = spark.read.text(path, wholetext=True)
    text = raw.select(F.from_json("value", T.StructType([T.StructField("files", T.MapType(T.StringType(), entry))])).alias("j"))
    rows = text.select(F.explode("j.files").alias("key", "s")).select(F.coalesce("s.path", "key").alias("path"), *[F.col(f"s.{f.name}") for f in STATE if f.name != "path"])
    ids = F.array().cast("array<bigint>")
    return rows.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "chunk_ids": F.coalesce("chunk_ids", ids), "image_count": F.coalesce("image_count", F.lit(0)), "image_ids": F.coalesce("image_ids", ids)})


def write_state_json(state: DataFrame, path: str) -> None:
    """A copy of a state for other tools: one JSON file written by the driver row by row, in order of path.

    The engine's own state is a table in its store.
    """
    import json
    import os

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "files": {')
        for k, row in enumerate(state.select(*[x.name for x in STATE]).orderBy("path").toLocalIterator()):
            entry = {n: (list(v) if isinstance(v, list) else v) for n, v in row.asDict().items()}
            f.write(("," if k else "") + "\n    " + json.dumps(row["path"]) + ": " + json.dumps(entry, indent=2).replace("\n", "\n    "))
        f.write("\n  }\n}\n")


def clean_counts(state: DataFrame) -> DataFrame:
    """One row: entries, and points that belong to them."""
    n = F.coalesce(F.size("chunk_ids"), F.lit(0)) + F.coalesce(F.size("image_ids"), F.lit(0))
    return state.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(n), F.lit(0)).alias("points"))
