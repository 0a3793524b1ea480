"""Images of documents: size filter, dedup, captions and surrounding text by position on the page."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import strip, truncate

MIN_SIZE, MARGIN, TEXT_LIMIT, CAPTION_DISTANCE, CAPTION_PAD, CAPTION_LIMIT = 100, 50.0, 500, 50.0, 20.0, 300
# Fixed value: how captions begin.
CAPTION = r"(?is)\A(Figure|Fig\.?|Table|Plate|Image|Photo|Diagram|Chart|Graph|Illustration)\s*(\d+(?:\.\d+)?)\s*[:.\-—–]?\s*.*\z"


def large_enough(images: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    return images.where((F.col("width") >= least) & (F.col("height") >= least))


def with_hash(images: DataFrame) -> DataFrame:
    """MD5 of the image data where none is given."""
    return images.withColumn("image_hash", F.coalesce(F.nullif(F.col("image_hash"), F.lit("")), F.md5("image_data")))


def first_of_each(images: DataFrame) -> DataFrame:
    """One image per document and hash: the first by page and order on it."""
    w = Window.partitionBy("source", "image_hash").orderBy("page_number", "ord", "image_id")
    return images.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def scan_images(images: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    """The images of each document that count, each content once; those without data or hash are dropped."""
    return first_of_each(with_hash(large_enough(images, least)).where(F.col("image_hash").isNotNull()))


def bbox_or_default(images: DataFrame, rects: DataFrame) -> DataFrame:
    """First rectangle of each image, else one from the origin with the image's size.

    ``rects`` has ``image_id, ord, x0, y0, x1, y1``.
    """
    box = F.struct("x0", "y0", "x1", "y1")
    first = rects.groupBy("image_id").agg(F.min_by(box, F.col("ord")).alias("_box"))
    zero = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"))
    return images.join(first, "image_id", "left").withColumn("bbox", F.coalesce("_box", zero)).drop("_box")


def _overlaps(a: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (a["x0"] < x1) & (a["x1"] > x0) & (a["y0"] < y1) & (a["y1"] > y0)


def text_context(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """``image_id, surrounding_text, caption`` from the text blocks of the image's page.

    ``blocks`` has ``source, page, block, bbox, text, page_width, page_height``.  The join is an equi-join
    on (source, page) with the rectangles as residual condition.
    """
    b = blocks.where(strip(F.col("text")) != "").select(F.col("source").alias("_s"), F.col("page").alias("_p"), "block", F.col("bbox").alias("_b"), strip(F.col("text")).alias("_t"), "page_width", "page_height")
    i = images.select("image_id", "source", "page_number", "bbox")
    pairs = i.join(b, (F.col("source") == F.col("_s")) & (F.col("page_number") == F.col("_p")), "left")
    box, w, h = F.col("bbox"), F.col("page_width"), F.col("page_height")
    near = _overlaps(F.col("_b"), F.greatest(F.lit(0.0), box["x0"] - MARGIN), F.greatest(F.lit(0.0), box["y0"] - MARGIN), F.least(w, box["x1"] + MARGIN), F.least(h, box["y1"] + MARGIN))
    below = _overlaps(F.col("_b"), F.greatest(F.lit(0.0), box["x0"] - CAPTION_PAD), box["y1"], F.least(w, box["x1"] + CAPTION_PAD), F.least(h, box["y1"] + CAPTION_DISTANCE))
    caption = below & F.col("_t").rlike(CAPTION)
    texts = F.array_sort(F.collect_list(F.when(near, F.struct("block", "_t"))))
    return (
        pairs.groupBy("image_id")
        .agg(texts.alias("near"), F.min_by("_t", F.when(caption, F.col("block"))).alias("cap"), F.max(caption).alias("any_cap"))
        .select(
            "image_id",
            truncate(F.nullif(F.array_join(F.transform("near", lambda x: x["_t"]), " "), F.lit("")), TEXT_LIMIT).alias("surrounding_text"),
            F.when(F.col("any_cap"), truncate(F.col("cap"), CAPTION_LIMIT)).alias("caption"),
        )
    )


def is_caption(text: Column) -> Column:
    return strip(text).rlike(CAPTION)


def _png_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height if ``data`` is a PNG whose header is intact."""
    if not data or len(data) < 33 or bytes(data[:8]) != b"\x89PNG\r\n\x1a\n" or bytes(data[12:16]) != b"IHDR":
        return None
    if zlib.crc32(bytes(data[12:29])) != struct.unpack(">I", bytes(data[29:33]))[0]:
        return None
    return struct.unpack(">II", bytes(data[16:24]))


@F.udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]), useArrow=True)
def png_size(data):
    """Size of a PNG; null if it cannot be decoded."""
    return _png_size(data)
