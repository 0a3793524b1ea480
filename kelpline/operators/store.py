"""Collections of points with named vectors, kept as tables of Parquet files with atomic snapshots.

A collection is a folder of buckets by the hash of the point id, and of numbered snapshots: ``CURRENT-<n>``
names the files of every bucket and of the sync states.  A change rewrites the buckets it touches and
publishes the next snapshot without overwriting, so readers never see half a write, and of two changes made
from the same snapshot the second fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cosine
from .publish import Conflict, Folder, numbered

SCHEMA = "id long, vectors map<string,array<float>>, document string, metadata map<string,string>"
#: buckets of a new collection; choose more for one of many points
BUCKETS = 32


def upsert(target: DataFrame, source: DataFrame) -> DataFrame:
    """Insert or replace by id; of repeated ids in ``source`` the greatest document wins."""
    rest = [c for c in source.columns if c != "id"]
    one = source.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("document", F.xxhash64(F.to_json(F.struct(*rest))))).alias("s")).select("id", "s.*")
    return target.join(one.select("id"), "id", "left_anti").unionByName(one.select(*target.columns))


def delete_by_ids(target: DataFrame, ids: DataFrame) -> DataFrame:
    return target.join(ids.select("id"), "id", "left_anti")


def delete_by_source(target: DataFrame, path: str) -> DataFrame:
    return target.where(~F.col("metadata")["source"].eqNullSafe(F.lit(path)))


def top_k(points: DataFrame, query: list[float], k: int = 5, using: str | None = None) -> DataFrame:
    """``(id, score, ...)`` of the ``k`` most similar points; ties go to the smaller id.

    One scan with a bounded heap per task; the query vector is a literal.  Points without the vector, and
    those of another length, are left out.
    """
    vec = F.col("vectors")[using] if using else F.col("vector")
    q = F.array(*[F.lit(float(x)) for x in query])
    return points.where(vec.isNotNull() & (F.size(vec) == len(query))).withColumn("score", F.round(cosine(vec, q), 12)).orderBy(F.col("score").desc(), "id").limit(k)


class Store:
    """Collections under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._folder = Folder(spark, root)

    def _dir(self, name: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"no name for a collection: {name!r}")
        return name

    def exists(self, name: str) -> bool:
        return self._folder.exists(f"{self._dir(name)}/VECTORS.json")

    def ensure(self, name: str, vectors: dict[str, int], buckets: int = BUCKETS) -> bool:
        """Create the collection if it is absent; was it created?"""
        if self.exists(name):
            return False
        try:
            self._folder.publish(f"{self._dir(name)}/VECTORS.json", json.dumps({"buckets": buckets, "vectors": {k: {"size": v, "distance": "cosine"} for k, v in vectors.items()}}))
        except Conflict:
            return False
        return True

    def _settings(self, name: str) -> dict:
        return json.loads(self._folder.read(f"{self._dir(name)}/VECTORS.json"))

    def vectors(self, name: str) -> dict[str, dict]:
        out = dict(self._settings(name)["vectors"])
        for n in self._folder.names(self._dir(name)):
            if n.startswith("VECTORS-"):
                out |= json.loads(self._folder.read(f"{name}/{n}"))
        return out

    def add_vector(self, name: str, vector: str, size: int) -> bool:
        """A further named vector for an existing collection; False if it has it."""
        if vector in self.vectors(name):
            return False
        self._folder.publish(f"{self._dir(name)}/VECTORS-{uuid.uuid4().hex}.json", json.dumps({vector: {"size": size, "distance": "cosine"}}))
        return True

    def snapshot(self, name: str) -> dict:
        """Number, files by bucket and files of the sync states of the snapshot that counts."""
        found = numbered(self._folder.names(self._dir(name)), "CURRENT-")
        return {"number": 0, "buckets": {}, "states": {}} if not found else json.loads(self._folder.read(f"{name}/{found[-1][1]}")) | {"number": found[-1][0]}

    def _points(self, paths: dict[str, str]) -> DataFrame:
        """Points of some buckets; files are named, so no folder is listed for what is not read."""
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{p}" for p in paths.values()])

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"no collection {name!r}")
        return self._points(self.snapshot(name)["buckets"])

    def state(self, name: str, key: str) -> DataFrame | None:
        """The sync state saved under ``key``, or None."""
        path = self.snapshot(name)["states"].get(key) if self.exists(name) else None
        return None if path is None else self.spark.read.parquet(f"{self.root}/{path}")

    def with_state(self, key: str) -> list[str]:
        """Names of the collections that hold a sync state under ``key``."""
        return [n for n in self.names() if key in self.snapshot(n)["states"]]

    def names(self) -> list[str]:
        return [n for n in self._folder.names() if not n.startswith((".", "_")) and self.exists(n)]

    def apply(self, name: str, points: DataFrame | None = None, delete: DataFrame | None = None, states: dict[str, DataFrame] | None = None) -> None:
        """Delete ids, insert or replace points and save sync states, all with one snapshot.

        Only buckets with an id of ``delete`` or ``points`` are read and written.
        """
        if not self.exists(name):
            raise ValueError(f"no collection {name!r}")
        last, count = self.snapshot(name), self._settings(name)["buckets"]
        bucket = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
        buckets, saved = dict(last["buckets"]), dict(last["states"])
        parts = [x.select("id") for x in (points, delete) if x is not None]
        # at most as many rows as the collection has buckets
        touched = sorted(r["b"] for r in reduce(DataFrame.unionByName, parts).select(bucket.alias("b")).distinct().collect()) if parts else []
        if touched:
            rows = self._points({k: v for k, v in buckets.items() if int(k) in touched})
            if delete is not None:
                rows = delete_by_ids(rows, delete)
            if points is not None:
                rows = upsert(rows, points.select("id", "vectors", "document", "metadata"))
            path = f"{name}/data-{uuid.uuid4().hex}"
            rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
            there = {n.removeprefix("bucket=") for n in self._folder.names(path) if n.startswith("bucket=")}
            buckets = {k: v for k, v in buckets.items() if int(k) not in touched} | {k: f"{path}/bucket={k}" for k in there}
        for key, state in (states or {}).items():
            saved[key] = f"{name}/state-{uuid.uuid4().hex}"
            state.write.parquet(f"{self.root}/{saved[key]}")
        self._folder.publish(f"{name}/CURRENT-{last['number'] + 1:09d}", json.dumps({"buckets": buckets, "states": saved}))

    def upsert(self, name: str, points: DataFrame) -> None:
        self.apply(name, points=points)

    def delete_ids(self, name: str, ids: DataFrame) -> None:
        """No-op if there are no ids."""
        if not ids.isEmpty():
            self.apply(name, delete=ids)

    def delete_source(self, name: str, path: str) -> int:
        """Delete the points of one source; how many there were."""
        gone = self.read(name).where(F.col("metadata")["source"] == path).select("id")
        n = gone.count()
        if n:
            self.apply(name, delete=gone)
        return n

    def list(self) -> DataFrame:
        """``(name, points_count, vector_size)`` of every collection."""
        rows = [(n, self.read(n).count(), ", ".join(str(v["size"]) for _, v in sorted(self.vectors(n).items()))) for n in self.names()]
        return self.spark.createDataFrame(rows, "name string, points_count long, vector_size string")

    def delete(self, name: str) -> None:
        if not self.exists(name):
            raise ValueError(f"no collection {name!r}")
        self._folder.remove(self._dir(name))

    def search(self, name: str, query: list[float], k: int = 5, using: str | None = None) -> DataFrame:
        using = using or sorted(self.vectors(name))[0]
        return top_k(self.read(name), query, k, using)
