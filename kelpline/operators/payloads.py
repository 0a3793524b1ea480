"""Point ids and payloads of text chunks, code chunks and images, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import image_point_id, point_id


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def base_metadata(path: Column, timestamp: Column, document_metadata: Column, index: Column | None = None, total: Column | None = None) -> Column:
    """``map<string,string>``: source, timestamp and chunk position, overridden by the document's own keys.

    ``symbols`` never reaches a payload.  Values are strings; null values are left out.
    """
    pairs = [F.lit("source"), path, F.lit("timestamp"), timestamp]
    if index is not None:
        pairs += [F.lit("chunk_index"), index.cast("string"), F.lit("total_chunks"), total.cast("string")]
    own = F.map_filter(F.coalesce(document_metadata, F.create_map().cast("map<string,string>")), lambda k, v: (k != "symbols") & v.isNotNull())
    return merge(F.create_map(*pairs), own)


def merge(first: Column, second: Column) -> Column:
    """Both maps in one; keys of ``second`` win, whatever the session's policy on repeated keys is."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


def text_payload(chunk: Column, metadata: Column) -> Column:
    return F.struct(chunk.alias("document"), metadata.alias("metadata"))


def code_payload(chunk: Column, metadata: Column, symbol: Column) -> Column:
    names = {
        "language": "language", "symbol_type": "symbol_type", "symbol_name": "name", "symbol_qualified_name": "qualified_name", "signature": "signature",
        "docstring": "docstring", "line_start": "line_start", "line_end": "line_end", "parent_class": "parent", "visibility": "visibility",
    }
    extra = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), _text(symbol[v]))])
    return F.struct(chunk.alias("document"), merge(metadata, extra).alias("metadata"))


def image_payload(image: Column, metadata: Column, index: Column, total: Column) -> Column:
    """Payload of an image; its document is caption and surrounding text, whichever are not empty."""
    box = image["bbox"]
    extra = F.create_map(
        F.lit("content_type"), F.lit("image"), F.lit("image_index"), index.cast("string"), F.lit("total_images"), total.cast("string"),
        F.lit("page_number"), _text(image["page_number"]), F.lit("width"), _text(image["width"]), F.lit("height"), _text(image["height"]),
        F.lit("bbox"), F.to_json(F.array(box["x0"], box["y0"], box["x1"], box["y1"])), F.lit("caption"), _text(image["caption"]),
        F.lit("surrounding_text"), _text(image["surrounding_text"]), F.lit("image_hash"), _text(image["image_hash"]),
    )
    document = F.concat_ws(" ", F.nullif(image["caption"], F.lit("")), F.nullif(image["surrounding_text"], F.lit("")))
    return F.struct(document.alias("document"), merge(metadata, extra).alias("metadata"))


def explode_chunks(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row per chunk with ``chunk_index``, ``total_chunks`` and ``chunk``; rows without chunks vanish."""
    rest = [c for c in df.columns if c != chunks]
    return df.select(*rest, F.size(chunks).alias("total_chunks"), F.posexplode(chunks).alias("chunk_index", "chunk"))


def with_point_ids(df: DataFrame, path: str = "source", index: str = "chunk_index", image: bool = False) -> DataFrame:
    return df.withColumn("id", (image_point_id if image else point_id)(F.col(path), F.col(index)))
