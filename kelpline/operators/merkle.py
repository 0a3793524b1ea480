"""Processing only new or changed records: a Merkle tree over key-range hashes.

A *snapshot* is a set of ``(key, value)`` records, one per key.  Keys are spread by a 64-bit hash; a leaf
of the tree is a range of that hash space, so a hot repository or directory never makes a hot leaf.  A
leaf's digest is order-free (xor of two independent record hashes, and the count), which lets Spark
combine it on the map side; an inner node's digest is the xor of the digests of its ``2**FANOUT_BITS``
children, each bound to its place.  ``changed_leaves`` walks from the root and opens a node only where the digests of both trees
differ, and only the records of changed leaves are compared.

:class:`MerkleStore` keeps the snapshot of the last successful run.  ``commit`` writes the run's output,
records and tree into a fresh folder and then publishes all three with one manifest file, which takes the
number after the manifest that the run was planned against.  A run that dies earlier leaves no trace that a
later run could read, and of two runs planned against the same manifest the second fails, so records are
neither skipped nor repeated.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, shared_dir
from .publish import Folder, numbered

FANOUT_BITS = 4
#: records a leaf holds on average; small leaves prune more, large ones make a smaller tree
LEAF_RECORDS = 4


def leaf_bits_for(n: int, leaf_records: int = LEAF_RECORDS) -> int:
    """Depth of the tree in bits for ``n`` records, a multiple of the fan-out."""
    bits = math.ceil(math.log2(max(2, n / leaf_records)))
    return min(32, max(FANOUT_BITS, math.ceil(bits / FANOUT_BITS) * FANOUT_BITS))


def snapshot(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, h)``: the records of a snapshot with the hash that places them."""
    return df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.xxhash64(F.col(key)).alias("h"))


def with_leaf(records: DataFrame, leaf_bits: int) -> DataFrame:
    return records.withColumn("leaf", F.shiftrightunsigned("h", 64 - leaf_bits))


def tree(records: DataFrame, leaf_bits: int) -> DataFrame:
    """``(level, node, digest)``: level 0 holds the leaves, the last level the root's children."""
    leaves = (
        with_leaf(records, leaf_bits)
        .groupBy("leaf")
        .agg(
            F.bit_xor(F.xxhash64("key", "value")).alias("a"),
            F.bit_xor(F.xxhash64("value", "h", F.lit(7))).alias("b"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(F.col("leaf").alias("node"), F.xxhash64("a", "b", "n").alias("digest"))
    )
    # one pass for all levels: a node's digest is the xor of its children's, which are bound to their place
    level = F.explode(F.sequence(F.lit(0), F.lit(leaf_bits // FANOUT_BITS - 1))).alias("level")
    nodes = leaves.select("node", "digest", level).withColumn("place", F.xxhash64("node", "digest"))
    nodes = nodes.withColumn("node", F.expr(f"shiftrightunsigned(node, level * {FANOUT_BITS})"))
    return nodes.groupBy("level", "node").agg(F.bit_xor("place").alias("digest"))


def changed_leaves(current: DataFrame, saved: DataFrame, leaf_bits: int) -> DataFrame:
    """Leaves whose digests differ, found from the top: a node is opened only below a changed parent."""
    both = current.withColumn("now", F.lit(True)).unionByName(saved.withColumn("now", F.lit(False)))
    changed = None
    for level in range(leaf_bits // FANOUT_BITS - 1, -1, -1):
        nodes = both.where(F.col("level") == level)
        if changed is not None:
            nodes = nodes.withColumn("parent", F.shiftrightunsigned("node", FANOUT_BITS)).join(changed, "parent", "left_semi")
        digest = lambda now: F.max(F.when(F.col("now") == now, F.col("digest")))
        found = nodes.groupBy("node").agg(digest(True).alias("c"), digest(False).alias("s")).where(~F.col("c").eqNullSafe(F.col("s")))
        changed = found.select(F.col("node").alias("parent"))
    return changed.select(F.col("parent").alias("leaf"))


def diff(current: DataFrame, saved: DataFrame, leaf_bits: int, current_tree: DataFrame | None = None, saved_tree: DataFrame | None = None) -> DataFrame:
    """``(key, value, old_value, change)`` for every key that is new, changed or deleted.

    Null keys form no record; a null value equals a null value.  Both sides hold one row per key.
    """
    current_tree = materialize(tree(current, leaf_bits), "tree") if current_tree is None else current_tree
    saved_tree = materialize(tree(saved, leaf_bits), "tree") if saved_tree is None else saved_tree
    leaves = changed_leaves(current_tree, saved_tree, leaf_bits)
    new = with_leaf(current, leaf_bits).join(leaves, "leaf", "left_semi").select("key", "value", F.lit(True).alias("in_new"))
    old = with_leaf(saved, leaf_bits).join(leaves, "leaf", "left_semi").select("key", F.col("value").alias("old_value"), F.lit(True).alias("in_old"))
    both = new.join(old, "key", "full_outer")
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(~F.col("value").eqNullSafe(F.col("old_value")), "modified")
    return both.select("key", "value", "old_value", change.alias("change")).where(F.col("change").isNotNull())


def current_records(scan_log: DataFrame) -> DataFrame:
    """Current content of each path: greatest ``modified_time``, then latest ``received_at``.

    Readings without ``content_hash`` or path are ignored; a null time is older than any; readings equal
    in both times are settled by the greatest ``obs_id``.
    """
    rank = F.struct("modified_time", "received_at", "obs_id")
    return (
        scan_log.where(F.col("content_hash").isNotNull() & F.col("source_path").isNotNull())
        .groupBy(F.col("source_path").alias("key"))
        .agg(F.max_by("content_hash", rank).alias("value"))
        .select("key", "value", F.xxhash64("key").alias("h"))
    )


def processed_records(file_state: DataFrame, sync_runs: DataFrame) -> DataFrame:
    """Content each path had when the last successful run recorded it; rows of other runs don't count."""
    ok = sync_runs.where(F.col("status") == "ok").select("run_id").distinct()
    rank = F.struct("run_id", "mtime", "content_hash")
    return (
        file_state.where(F.col("path").isNotNull())
        .join(ok, "run_id", "left_semi")
        .groupBy(F.col("path").alias("key"))
        .agg(F.max_by("content_hash", rank).alias("value"))
        .select("key", "value", F.xxhash64("key").alias("h"))
    )


def pending_files(scan_log: DataFrame, file_state: DataFrame, sync_runs: DataFrame, leaf_records: int = LEAF_RECORDS) -> DataFrame:
    """Files the next sync must process: ``(source_path, content_hash, change)``, each path once.

    The saved side is a :class:`MerkleStore`, into which the recorded state is brought first; the next sync
    is planned against its tree.  Empty tables give an empty result; paths that only the saved side knows
    are no work for a sync and are left out.
    """
    spark = scan_log.sparkSession
    store = MerkleStore(spark, f"{shared_dir(spark)}/kelpline/{spark.sparkContext.applicationId}/merkle-{uuid.uuid4().hex}", leaf_records)
    store.commit(processed_records(file_state, sync_runs))
    found = store.plan(materialize(current_records(scan_log), "current")).where(F.col("change") != "deleted")
    return found.select(F.col("key").alias("source_path"), F.col("value").alias("content_hash"), "change")


class MerkleStore:
    """Snapshot of the last successful run under ``root``, published by numbered manifests.

    ``plan(current)`` gives the changes against the last manifest, and ``commit(current, output)`` publishes
    the run as the one after it; :class:`~.publish.Conflict` is raised if another run was faster.  Without a
    plan, ``commit`` counts as planned against the manifest that is there when it begins.
    """

    def __init__(self, spark: SparkSession, root: str, leaf_records: int = LEAF_RECORDS):
        self.spark, self.root, self.leaf_records = spark, root.rstrip("/"), leaf_records
        self._folder = Folder(spark, root)
        self._planned: int | None = None

    def manifests(self) -> list[tuple[int, str]]:
        return numbered(self._folder.names(), "MANIFEST-")

    def last(self) -> dict | None:
        found = self.manifests()
        return json.loads(self._folder.read(found[-1][1])) | {"number": found[-1][0]} if found else None

    def plan(self, current: DataFrame) -> DataFrame:
        """Changes of ``current`` (``key, value, h``) against the last commit."""
        last = self.last()
        self._planned = last["number"] if last else 0
        if last is None:
            return diff(current, current.limit(0), FANOUT_BITS)
        saved = self.spark.read.parquet(f"{last['run']}/records")
        saved_tree = self.spark.read.parquet(f"{last['run']}/tree")
        return diff(current, saved, last["leaf_bits"], saved_tree=saved_tree)

    def commit(self, current: DataFrame, output: DataFrame | None = None, fail_before_publish: bool = False) -> str:
        """Write output, records and tree, then publish them together; returns the run's folder."""
        number = self._planned if self._planned is not None else (self.manifests() or [(0, "")])[-1][0]
        run = f"{self.root}/runs/{uuid.uuid4().hex}"
        if output is not None:
            output.write.parquet(f"{run}/output")
        current.write.parquet(f"{run}/records")
        records = self.spark.read.parquet(f"{run}/records")
        bits = leaf_bits_for(records.count(), self.leaf_records)
        tree(records, bits).write.parquet(f"{run}/tree")
        if fail_before_publish:
            raise RuntimeError("stopped before publishing")
        self._folder.publish(f"MANIFEST-{number + 1:09d}.json", json.dumps({"run": run, "leaf_bits": bits}))
        self._planned = None
        return run


def repeated_key_check(records: DataFrame) -> DataFrame:
    """Keys that break the one-row-per-key contract of a snapshot, with their number."""
    return records.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest whole row of each key by ``order`` (descending, nulls last)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
