"""The engine: index, sync, status, clean and search over one store, as single lazy plans."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import chunkers, embed, text
from .operators import images as im
from .operators import payloads, sync
from .operators.store import Store
from .session import materialize
from .sources import discover, loaders, pdfimages

#: events a callback gets, in the order in which a run may emit them
EVENTS = (
    "discovery_started", "discovery_finished", "loading_started", "loading_finished", "embedding_started", "embedding_finished",
    "upload_started", "upload_finished", "sync_started", "sync_progress", "sync_finished", "failed",
)
Callback = Callable[[str, int, int, str], None]


class Engine:
    """Documents of directories in collections of a :class:`Store`.

    ``chunker`` is a strategy or ``auto`` (by extension).  Files that fail to load keep their error and
    never stop a run.  A run's points, deletions and state become visible with one snapshot of the store.
    With ``images`` the images of PDF files become points as well.
    """

    def __init__(
        self, spark: SparkSession, root: str, collection: str, model: str = embed.DEFAULT_MODEL, chunker: str = "auto", chunk_size: int = 1536, overlap: int = 200, on_progress: Callback | None = None,
        images: bool = False, image_model: str = embed.DEFAULT_IMAGE_MODEL, min_image_size: int = im.MIN_SIZE,
    ):
        info = embed.model_info(model)
        if chunker != "auto":
            chunkers.get_chunker(chunker)
        self.spark, self.store, self.collection, self.model = spark, Store(spark, root), collection, model
        self.vector, self.size = f"fast-{model.rsplit('/', 1)[-1].lower()}", info["size"]
        self.chunker, self.options, self.emit = chunker, {"chunk_size": chunk_size, "overlap": overlap}, on_progress or (lambda *_: None)
        self.images, self.image_model, self.min_image_size = images, image_model, min_image_size
        self.image_vector = f"clip-{image_model.rsplit('/', 1)[-1].lower()}"
        self.image_size = embed.model_info(image_model, embed.IMAGE_MODELS)["size"] if images else 0

    # -- plans ---------------------------------------------------------------------------------------
    def documents(self, files: DataFrame) -> DataFrame:
        return loaders.load(discover.read_bytes(files))

    def chunks(self, documents: DataFrame) -> DataFrame:
        """``(source, chunk_index, total_chunks, chunk, metadata, symbol)``: one row per chunk.

        Code files are chunked by symbol, and have no chunks without symbols; other strategies than
        ``code`` get the symbol's head and documentation instead of its source.
        """
        ok = documents.where("error IS NULL")
        strategy = chunkers.preferred_strategy(F.coalesce("metadata.extension", F.lit(""))) if self.chunker == "auto" else F.lit(self.chunker)
        plain = ok.where("symbols IS NULL").select("source", "metadata", F.lit(None).cast(loaders.DOCUMENT["symbols"].dataType.elementType).alias("symbol"), F.lit(0).alias("sym"), chunkers.chunk(F.coalesce("content", F.lit("")), strategy, **self.options).alias("chunks"))
        code = ok.where("symbols IS NOT NULL").select("source", "metadata", F.posexplode("symbols").alias("sym", "symbol"))
        size, overlap = self.options["chunk_size"], self.options["overlap"]
        if self.chunker in ("auto", "code"):
            parts = text.code_chunks(F.col("symbol"), size, overlap)
        else:
            head = text.symbol_text(F.col("symbol"))
            parts = chunkers.chunk(head, self.chunker, **self.options)
        code = code.select("source", "metadata", "symbol", "sym", parts.alias("chunks"))
        # number the chunks of a file over its symbols: one sort of the few rows of each file
        whole = plain.unionByName(code).groupBy("source").agg(F.first("metadata").alias("metadata"), F.array_sort(F.collect_list(F.struct("sym", "symbol", "chunks")), lambda a, b: a["sym"] - b["sym"]).alias("parts"))
        flat = F.flatten(F.transform("parts", lambda p: F.transform(p["chunks"], lambda c: F.struct(c.alias("chunk"), p["symbol"].alias("symbol")))))
        rows = payloads.explode_chunks(whole.select("source", "metadata", flat.alias("chunks")))
        return rows.select("source", "metadata", "chunk_index", "total_chunks", "chunk.chunk", "chunk.symbol").where(~text.is_blank(F.col("chunk")))

    def points(self, chunks: DataFrame, now: str) -> DataFrame:
        m = F.col("metadata")
        known = F.create_map(*[x for n in ("filename", "extension", "size", "modified_time", *loaders.KNOWN, "page_count", "is_code") for x in (F.lit(n), m[n].cast("string"))])
        own = payloads.merge(known, F.coalesce(m["extra"], F.create_map().cast("map<string,string>")))
        base = payloads.base_metadata(F.col("source"), F.lit(now), own, F.col("chunk_index"), F.col("total_chunks"))
        s = F.col("symbol")
        p = F.when(s.isNull(), payloads.text_payload(F.col("chunk"), base)).otherwise(payloads.code_payload(F.col("chunk"), base, s))
        vectors = F.create_map(F.lit(self.vector), embed.embed(F.col("chunk"), self.model))
        rows = payloads.with_point_ids(chunks).withColumn("p", p)
        return rows.select("source", "chunk_index", "id", vectors.alias("vectors"), "p.document", "p.metadata")

    def image_points(self, files: DataFrame, documents: DataFrame, now: str) -> DataFrame:
        """Points of the images of PDF files that load."""
        found = pdfimages.extract_images(discover.read_bytes(files.where(F.lower("extension") == ".pdf")), self.min_image_size)
        m = F.col("metadata")
        own = documents.where("error IS NULL").select(F.col("source").alias("path"), F.create_map(*[x for n in ("filename", "extension", *loaders.KNOWN, "page_count") for x in (F.lit(n), m[n].cast("string"))]).alias("own"))
        rows = found.join(own, F.col("source") == F.col("path")).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("source")))
        image = F.struct("page_number", "bbox", "width", "height", "caption", "surrounding_text", "image_hash")
        p = payloads.image_payload(image, payloads.base_metadata(F.col("source"), F.lit(now), F.col("own")), F.col("ord"), F.col("total"))
        vectors = F.create_map(F.lit(self.image_vector), embed.embed_images(F.col("image_data"), self.image_model))
        rows = payloads.with_point_ids(rows, "source", "ord", image=True).select("source", F.col("ord").alias("chunk_index"), "id", vectors.alias("vectors"), p.alias("p"), F.lit(True).alias("image"))
        return rows.select("source", "chunk_index", "id", "vectors", "p.document", "p.metadata", "image")

    # -- runs ----------------------------------------------------------------------------------------
    def _prepare(self) -> None:
        self.store.ensure(self.collection, {self.vector: self.size} | ({self.image_vector: self.image_size} if self.images else {}))
        if self.images:
            self.store.add_vector(self.collection, self.image_vector, self.image_size)

    def _points_of(self, files: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
        self.emit("loading_started", 0, 0, "")
        documents = materialize(self.documents(files), "documents")
        self.emit("loading_finished", 0, 0, "")
        self.emit("embedding_started", 0, 0, "")
        points = self.points(self.chunks(documents), now).withColumn("image", F.lit(False))
        if self.images:
            points = points.unionByName(self.image_points(files, documents, now))
        points = materialize(points, "points")
        self.emit("embedding_finished", 0, 0, "")
        return documents, points

    def index(self, directory: str, patterns: Iterable[str] = discover.DEFAULT_INDEX_PATTERNS, exclude: Iterable[str] = ()) -> dict:
        """Full run: total_files (0 if no chunk came out), total_chunks, failed_files, skipped_files."""
        self._prepare()
        self.emit("discovery_started", 0, 0, directory)
        included, excluded = discover.filter_files(materialize(discover.scan(self.spark, directory, patterns), "files"), exclude, use_defaults=False)
        self.emit("discovery_finished", 0, 0, directory)
        documents, points = self._points_of(included, _now())
        self.emit("upload_started", 0, 0, "")
        if not points.isEmpty():
            self.store.upsert(self.collection, points)
        self.emit("upload_finished", 0, 0, "")
        return sync.index_summary(points.where("NOT image"), documents.where("error IS NOT NULL"), excluded.count()).first().asDict()

    def index_file(self, path: str) -> dict:
        """Index one file: chunk_count, chunk_ids, image_count, image_ids.  A file that fails to load raises ``ValueError``."""
        self._prepare()
        documents, points = self._points_of(discover.one_file(self.spark, path), _now())
        failed = documents.where("error IS NOT NULL").first()
        if failed is not None:
            raise ValueError(failed["error"])
        if not points.isEmpty():
            self.store.upsert(self.collection, points)
        # the ids of one file, which this call has to return
        rows = points.select("image", "chunk_index", "id").orderBy("image", "chunk_index").collect()
        ids = {kind: [r["id"] for r in rows if r["image"] == kind] for kind in (False, True)}
        return {"chunk_count": len(ids[False]), "chunk_ids": ids[False], "image_count": len(ids[True]), "image_ids": ids[True]}

    def sync(self, directory: str, state_file: str | None = None, patterns: Iterable[str] = discover.DEFAULT_INDEX_PATTERNS, exclude: Iterable[str] = (), force: bool = False) -> dict:
        """Incremental run: added, updated, deleted, unchanged, failed.

        Only files whose time differs from the saved one are read.  Points and state are published together.
        The state lives in the store; a ``state_file`` is read where the store has none, and written as a copy.
        """
        self._prepare()
        self.emit("sync_started", 0, 0, directory)
        state = self.state(directory, state_file)
        scanned = materialize(discover.scan(self.spark, directory, patterns), "files")
        classified = materialize(self._classify(scanned, state, exclude, force), "classified")
        work = classified.where("status IN ('new', 'modified')").select("path")
        now = _now()
        documents, points = self._points_of(scanned.join(work.select(F.col("path").alias("source")), "source", "left_semi"), now)
        failed = documents.where("error IS NOT NULL").select(F.col("source").alias("path"))
        stale = sync.stale_points(classified.join(failed, "path", "left_anti"))
        ids = lambda image: F.transform(F.array_sort(F.collect_list(F.when(F.col("image") == image, F.struct("chunk_index", "id")))), lambda x: x["id"])
        per_file = points.groupBy(F.col("source").alias("path")).agg(ids(False).alias("chunk_ids"), ids(True).alias("image_ids"))
        good = documents.where("error IS NULL").select(F.col("source").alias("path")).join(classified.select("path", F.col("hash").alias("content_hash"), "mtime"), "path").join(per_file, "path", "left")
        none = F.array().cast("array<bigint>")
        fresh = good.select("path", "content_hash", F.coalesce("chunk_ids", none).alias("chunk_ids"), "mtime", F.coalesce("image_ids", none).alias("image_ids"))
        new_state = materialize(sync.new_state(classified, fresh, state, now), "new-state")
        self.store.apply(self.collection, points, stale, {_key(directory): new_state})
        if state_file:
            sync.write_state_json(new_state, state_file)
        self.emit("sync_finished", 0, 0, directory)
        return sync.sync_summary(classified, failed).first().asDict()

    def state(self, directory: str, state_file: str | None = None) -> DataFrame:
        """The saved state of a directory: from the store, else from a JSON file, else empty."""
        saved = self.store.state(self.collection, _key(directory)) if self.collection != ANY else None
        if saved is None and self.collection == ANY:
            for name in self.store.with_state(_key(directory)):
                saved = self.store.state(name, _key(directory))
        return saved if saved is not None else materialize(sync.read_state_json(self.spark, state_file or default_state_file(directory)), "state")

    def has_state(self, directory: str, state_file: str | None = None) -> bool:
        return bool(self.store.with_state(_key(directory))) or sync.state_json_exists(self.spark, state_file or default_state_file(directory))

    def classify(self, directory: str, state: DataFrame, patterns=discover.DEFAULT_INDEX_PATTERNS, exclude=(), force: bool = False) -> DataFrame:
        return self._classify(discover.scan(self.spark, directory, patterns), state, exclude, force)

    def _classify(self, scanned: DataFrame, state: DataFrame, exclude, force: bool) -> DataFrame:
        """Statuses of all files; only those that are new, forced or of another time than saved are read and hashed."""
        files = discover.filter_files(scanned, exclude, use_defaults=False)[0]
        saved = state.select(F.col("path").alias("source"), F.col("mtime").alias("_saved"), F.lit(True).alias("_known"))
        marked = files.join(saved, "source", "left").withColumn("_read", F.col("_known").isNull() | F.col("_saved").isNull() | (F.col("_saved") != F.col("mtime")) | F.lit(force))
        listing = [c.split()[0] for c in discover.FILES.split(", ")]
        read = discover.read_bytes(marked.where("_read").select(*listing)).select("source", "mtime", sync.file_hash(F.col("content")).alias("hash"))
        seen = marked.where("NOT _read").select("source", "mtime", F.lit(None).cast("string").alias("hash"))
        return sync.classify(read.unionByName(seen).withColumnRenamed("source", "path"), state, force)

    def status(self, directory: str, state_file: str | None = None, patterns=discover.DEFAULT_INDEX_PATTERNS, exclude=()) -> dict:
        """Counts by status, tracked files, time of the last run and the first five pending paths."""
        state = self.state(directory, state_file)
        classified = materialize(self.classify(directory, state, patterns, exclude), "classified")
        counts = {r["status"]: r["files"] for r in sync.status_report(classified).collect()}
        last = sync.last_indexed(state).first()
        waiting = [r["path"] for r in sync.pending(classified).collect()]
        return {s: counts.get(s, 0) for s in ("new", "modified", "deleted", "unchanged")} | {"tracked": last["tracked"], "last_indexed": last["last_indexed"], "pending": waiting}

    def clean(self, directory: str, state_file: str | None = None, everything: bool = False) -> dict:
        """Remove the points and state of files that are gone, or of all files."""
        state = self.state(directory, state_file)
        if everything:
            gone = state
        else:
            here = discover.scan(self.spark, directory, ["**/*"]).select(F.col("source").alias("path"))
            gone = materialize(state.join(here, "path", "left_anti"), "gone")
        out = sync.clean_counts(gone).first().asDict()
        kept = materialize(state.join(gone.select("path"), "path", "left_anti"), "kept")
        self.store.apply(self.collection, delete=gone.select(F.explode(F.concat("chunk_ids", "image_ids")).alias("id")), states={_key(directory): kept})
        if state_file:
            sync.write_state_json(kept, state_file)
        return out

    def search(self, query: str, k: int = 5) -> DataFrame:
        vector = embed.loaded(self.model).embed([query])[0]
        return self.store.search(self.collection, [float(x) for x in vector], k, self.vector)


#: in place of a collection: any that holds a state of the directory
ANY = "-"


def _key(directory: str) -> str:
    return directory if "://" in directory else os.path.abspath(directory)


def default_state_file(directory: str) -> str:
    return f"{directory.rstrip('/')}/.kelpline-state.json"


def _now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
