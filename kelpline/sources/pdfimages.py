"""Images of PDF files as PNG, with their place on the page and the text blocks around them."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import images as im

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
IMAGE = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("bbox", BOX), T.StructField("width", T.IntegerType()),
     T.StructField("height", T.IntegerType()), T.StructField("image_data", T.BinaryType()), T.StructField("image_hash", T.StringType())]
)
BLOCK = T.StructType(
    [T.StructField("block", T.IntegerType()), T.StructField("bbox", BOX), T.StructField("text", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("page_width", T.DoubleType()), T.StructField("page_height", T.DoubleType())]
)
SCANNED = T.StructType([T.StructField("source", T.StringType()), T.StructField("images", T.ArrayType(IMAGE)), T.StructField("blocks", T.ArrayType(BLOCK))])
_MAGIC = b"\x89PNG\r\n\x1a\n"


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of 8-bit gray (h, w) or RGB (h, w, 3) pixels."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((h, 1 + pixels[0].size), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG (or of PDF data with a PNG predictor) without their filters."""
    rows = np.frombuffer(raw, np.uint8)[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h + 1, stride + step), np.int64)
    for y in range(h):
        kind, line, up = rows[y, 0], rows[y, 1:].astype(np.int64), out[y]
        here = out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 2:
            here[step:] = (line + up[step:]) & 255
        elif kind == 1:
            here[step:] = line
            for c in range(step):
                here[step + c :: step] = np.cumsum(line[c::step]) & 255
        else:
            for x in range(stride):
                left, above, corner = here[x], up[x + step], up[x]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                here[x + step] = (line[x] + guess) & 255
    return out[1:, step:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels of an 8-bit gray, RGB or RGBA PNG without interlace, else None."""
    if im._png_size(data) is None or data[24] != 8 or data[25] not in (0, 2, 6) or data[28]:
        return None
    w, h = struct.unpack(">II", data[16:24])
    body, at = b"", 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    step = {0: 1, 2: 3, 6: 4}[data[25]]
    try:
        rows = unfilter(zlib.decompress(body), h, w * step, step)
    except (zlib.error, ValueError):
        return None
    return rows.reshape(h, w, step) if step > 1 else rows


def to_png(data: bytes, head: bytes) -> bytes | None:
    """An image stream as PNG: deflated 8-bit gray or RGB here, anything else by Pillow where it is installed."""
    number = lambda key: int(m[1]) if (m := re.search(rb"/" + key + rb"\s+(\d+)", head)) else 0
    w, h = number(b"Width"), number(b"Height")
    if data.startswith(_MAGIC):
        return data if im._png_size(data) else None
    step = 3 if b"/DeviceRGB" in head else 1 if b"/DeviceGray" in head else 0
    if not re.search(rb"/(?:DCT|JPX|CCITTFax|JBIG2)Decode", head) and step and number(b"BitsPerComponent") == 8:
        try:
            if number(b"Predictor") >= 10:
                rows = unfilter(data, h, w * step, step)
            else:
                rows = np.frombuffer(data, np.uint8)[: h * w * step]
            return encode_png(rows.reshape(h, w, 3) if step == 3 else rows.reshape(h, w))
        except ValueError:
            return None
    try:
        from PIL import Image

        out = io.BytesIO()
        Image.open(io.BytesIO(data)).save(out, format="PNG")
        return out.getvalue()
    except Exception:  # Pillow is absent or can't read it: this image is left out, as other unreadable ones
        return None


_OPERATOR = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|/[\w.+-]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


def _page(content: bytes, height: float) -> tuple[list[tuple[str, tuple]], list[tuple[tuple, str]]]:
    """``(name, box)`` of the images drawn on a page, and ``(box, text)`` of its lines; y grows downwards."""
    from .loaders import _pdf_string

    drawn, lines, args = [], [], []
    ctm, stack = np.eye(3), []
    tm, size, leading, shown = np.eye(3), 12.0, 14.0, []
    matrix = lambda v: np.array([[v[0], v[1], 0], [v[2], v[3], 0], [v[4], v[5], 1]])

    def flush() -> None:
        nonlocal shown
        text = "".join(shown).strip()
        if text:
            x, y, _ = np.array([0.0, 0.0, 1.0]) @ tm @ ctm
            lines.append(((float(x), float(height - y - size), float(x + 0.5 * size * len(text)), float(height - y)), text))
        shown = []

    for m in _OPERATOR.finditer(content):
        tok = m.group()
        if tok[:1] in (b"(", b"<", b"/") or re.fullmatch(rb"[-+]?\d*\.?\d+", tok):
            args.append(tok)
            continue
        numbers = [float(x) for x in args if re.fullmatch(rb"[-+]?\d*\.?\d+", x)]
        if tok == b"q":
            stack.append(ctm)
        elif tok == b"Q" and stack:
            ctm = stack.pop()
        elif tok == b"cm" and len(numbers) >= 6:
            ctm = matrix(numbers[-6:]) @ ctm
        elif tok == b"Do" and args:
            corners = np.array([[0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]]) @ ctm
            (x0, y0), (x1, y1) = corners[:, :2].min(axis=0), corners[:, :2].max(axis=0)
            drawn.append((args[-1][1:].decode("latin-1"), (float(x0), float(height - y1), float(x1), float(height - y0))))
        elif tok == b"Tf" and numbers:
            size = abs(numbers[-1])
        elif tok == b"TL" and numbers:
            leading = numbers[-1]
        elif tok in (b"Td", b"TD", b"Tm", b"T*", b"BT", b"ET", b"'", b'"'):
            flush()
            if tok == b"BT":
                tm = np.eye(3)
            elif tok == b"Tm" and len(numbers) >= 6:
                tm = matrix(numbers[-6:])
            elif tok in (b"Td", b"TD") and len(numbers) >= 2:
                tm = matrix([1, 0, 0, 1, *numbers[-2:]]) @ tm
            elif tok in (b"T*", b"'", b'"'):
                tm = matrix([1, 0, 0, 1, 0, -leading]) @ tm
        if tok in (b"Tj", b"TJ", b"'", b'"'):
            shown += [_pdf_string(x) for x in args if x[:1] in (b"(", b"<")]
        args = []
    flush()
    return drawn, lines


def scan_pdf(raw: bytes, least: int = im.MIN_SIZE) -> tuple[list[dict], list[dict]]:
    """Images (each content once, by page and order) and text blocks of a PDF; unreadable images are left out."""
    import hashlib

    from .loaders import pdf_objects, pdf_stream

    objects = pdf_objects(raw)
    pages = [b for b in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    images, blocks, seen = [], [], set()
    for number, page in enumerate(pages, 1):
        box = re.search(rb"/MediaBox\s*\[\s*([\d.\s-]+)\]", page)
        x0, y0, x1, y1 = map(float, box[1].split()) if box else (0.0, 0.0, 612.0, 792.0)
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", page)
        ids = re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs and refs[1] else [refs[2]] if refs else []
        drawn, lines = _page(b"\n".join(pdf_stream(objects.get(int(i), b"")) for i in ids), y1 - y0)
        blocks += [{"block": k, "bbox": dict(zip(("x0", "y0", "x1", "y1"), b)), "text": t, "page": number, "page_width": x1 - x0, "page_height": y1 - y0} for k, (b, t) in enumerate(lines)]
        res = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)
        scope = page + (objects.get(int(res[1]), b"") if res else b"")
        if ref := re.search(rb"/XObject\s+(\d+)\s+\d+\s+R", scope):
            scope += b"/XObject <<" + objects.get(int(ref[1]), b"") + b">>"
        named = {n.decode("latin-1"): int(i) for d in re.findall(rb"/XObject\s*<<(.*?)>>", scope, re.S) for n, i in re.findall(rb"/([\w.+-]+)\s+(\d+)\s+\d+\s+R", d)}
        where = {n: b for n, b in reversed(drawn)}
        for name, obj in named.items():
            body = objects.get(obj, b"")
            head = body[: body.find(b"stream")] if b"stream" in body else body
            if b"/Image" not in head:
                continue
            w, h = (int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", head)) else 0 for k in (b"Width", b"Height"))
            if w < least or h < least or (png := to_png(pdf_stream(body), head)) is None:
                continue
            digest = hashlib.md5(png).hexdigest()
            if digest in seen:
                continue
            seen.add(digest)
            b = where.get(name, (0.0, 0.0, float(w), float(h)))
            images.append({"page_number": number, "ord": len(images), "bbox": dict(zip(("x0", "y0", "x1", "y1"), b)), "width": w, "height": h, "image_data": png, "image_hash": digest})
    return images, blocks


def extract_images(files: DataFrame, least: int = im.MIN_SIZE) -> DataFrame:
    """Images of the PDF files among ``files`` (``source, extension, content``) with ``surrounding_text`` and ``caption``.

    Files that cannot be read have no images.  ``ord`` counts the images of a file from 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, content in zip(pdf["source"], pdf["content"]):
                try:
                    images, blocks = scan_pdf(bytes(content), least)
                except (ValueError, IndexError, KeyError, TypeError, zlib.error):
                    images, blocks = [], []
                if images:
                    out.append((source, [{"source": source} | x for x in images], blocks))
            yield pd.DataFrame(out, columns=["source", "images", "blocks"])

    scanned = files.where((F.lower("extension") == ".pdf") & F.col("content").isNotNull()).select("source", "content").mapInPandas(run, SCANNED)
    image = scanned.select("blocks", F.explode("images").alias("i")).select("i.*", "blocks").withColumn("image_id", F.xxhash64("source", "ord"))
    # a file's blocks travel with its images, so the join by position needs no second pass over the files
    texts = image.select("source", F.col("page_number").alias("page"), "blocks").dropDuplicates(["source", "page"]).select("source", F.explode(F.filter("blocks", lambda b: b["page"] == F.col("page"))).alias("b")).select("source", "b.*")
    return image.drop("blocks").join(im.text_context(image, texts), "image_id")
