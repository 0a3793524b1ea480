"""Scalar functions as Column expressions, so that they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: blanks as Unicode defines them, and the separators that Java leaves out of ``\s``
BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def _id_of(key: Column) -> Column:
    high = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, -10).cast("long")
    return high.bitwiseAND(F.lit(9223372036854775807).cast("long"))


def point_id(path: Column, index: Column) -> Column:
    """Positive 63-bit id of a chunk: the first 8 bytes of the SHA-256 of ``path-index``."""
    return _id_of(F.concat(path, F.lit("-"), index.cast("string")))


def image_point_id(path: Column, index: Column) -> Column:
    return _id_of(F.concat(F.lit("image:"), path, F.lit("-"), index.cast("string")))


def vector_name(model: Column) -> Column:
    return F.concat(F.lit("fast-"), F.lower(F.substring_index(model, "/", -1)))


def clip_vector_name(model: Column) -> Column:
    return F.concat(F.lit("clip-"), F.lower(F.substring_index(model, "/", -1)))


def pdf_date(c: Column) -> Column:
    """``YYYY-MM-DD`` cut out of a PDF date (``D:`` prefix allowed); null below eight characters."""
    s = F.regexp_replace(c, r"^D:", "")
    return F.when(F.length(s) >= 8, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))


# The two ways a DOI is written.
DOI_URL = r"(?:https?://)?(?:dx\.)?doi\.org/(10\.\d{4,}/[^\s]+)"
DOI_MARK = r"[Dd][Oo][Ii][:：]?\s*(10\.\d{4,}/[^\s]+)"


def doi(c: Column) -> Column:
    """The first DOI: as a URL anywhere, else after ``doi:``; without trailing ``.,;:``."""
    found = F.coalesce(F.nullif(F.regexp_extract(c, DOI_URL, 1), F.lit("")), F.nullif(F.regexp_extract(c, DOI_MARK, 1), F.lit("")))
    return F.regexp_replace(found, r"[.,;:]+$", "")


def is_garbled(c: Column) -> Column:
    """More than 30 % replacement characters; blank texts are not garbled."""
    lost = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.when(is_blank(c), False).otherwise(lost / F.length(c) > 0.3)


def truncate(c: Column, limit: int, mark: str = "...") -> Column:
    """At most ``limit`` characters, then ``mark``."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def describe_model(c: Column) -> Column:
    """A description of at most 50 characters: the first 47 and dots if it is longer."""
    return F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 47), F.lit("..."))).otherwise(c)


def clean_block_comment(c: Column) -> Column:
    """Text of a ``/** */`` or ``/*! */`` comment without its marks, leading stars and blank lines."""
    body = F.regexp_replace(strip(c), r"^/\*[*!]?|\*/$", "")
    lines = F.transform(F.split(body, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^\*+", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def derives(attributes: Column) -> Column:
    """Trait names of the ``derive(...)`` attributes in an array of attribute texts."""
    inside = F.transform(attributes, lambda a: F.split(F.regexp_extract(a, r"derive\(([^)]*)\)", 1), ","))
    return F.filter(F.transform(F.flatten(inside), strip), lambda x: x != "")


def rst_title(text: Column) -> Column:
    """The line above the first underline of ``=``, ``-``, ``~`` or backquotes (a blank line counts as one)."""
    lines = F.split(text, "\n")
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1))),
        lambda i: (i < F.size(lines)) & (F.length(F.element_at(lines, i + 1)) > 0) & strip(F.element_at(lines, i + 1)).rlike(r"^[=\-~`]*$"),
    )
    return F.when(F.size(at) > 0, strip(F.element_at(lines, F.element_at(at, 1))))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 when a norm is 0, null when a side is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def symbol_context(symbol: Column) -> Column:
    """``type: name``, signature and documentation of a symbol, one below the other."""
    head = F.concat_ws(" ", F.nullif(symbol["visibility"], F.lit("")), F.concat(symbol["symbol_type"], F.lit(": "), symbol["qualified_name"]))
    return F.concat_ws("\n", head, F.nullif(symbol["signature"], F.lit("")), F.nullif(symbol["docstring"], F.lit("")))


# -- chunking without Python ---------------------------------------------------------------------------
def fixed_chunks(text: Column, size: int, overlap: int, skip_blank: bool = True) -> Column:
    """Windows of ``size`` characters every ``size - overlap`` (every ``size`` if that is not positive)."""
    step = size - overlap if size > overlap else size
    n = F.length(text)
    count = F.least(F.ceil(n / step), F.greatest(F.ceil((n - size) / step), F.lit(0)) + 1).cast("int")
    many = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    empty = F.array().cast("array<string>")
    out = F.when(n <= size, F.array(text)).otherwise(many)
    return F.when(is_blank(text) if skip_blank else (text.isNull() | (n == 0)), empty).otherwise(out)


def recursive_pieces(text: Column, size: int) -> Column:
    """Pieces of the recursive splitter without overlap: four nested folds, all in the JVM."""

    def level(piece: Column, separators: tuple[str, ...]) -> Column:
        if not separators:
            return F.transform(F.sequence(F.lit(0), ((F.length(piece) - 1) / size).cast("int")), lambda i: F.substring(piece, i * size + 1, F.lit(size)))
        sep, rest = separators[0], separators[1:]
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def step(acc: Column, part: Column) -> Column:
            joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(sep), part)).otherwise(part)
            flushed = F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
            big = F.length(part) > size
            return (
                F.when(F.length(joined) <= size, F.struct(acc["done"].alias("done"), joined.alias("cur")))
                .when(big, F.struct(F.concat(flushed, level(part, rest)).alias("done"), F.lit("").alias("cur")))
                .otherwise(F.struct(flushed.alias("done"), part.alias("cur")))
            )

        return F.aggregate(
            F.split(piece, "\\Q" + sep + "\\E", -1), start, step,
            lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]),
        )

    empty = F.array().cast("array<string>")
    return F.when(is_blank(text), empty).when(F.length(text) <= size, F.array(text)).otherwise(level(text, ("\n\n", "\n", ". ", " ")))


def overlap_pieces(pieces: Column, size: int, overlap: int) -> Column:
    """Each piece after the first gets the tail of the piece before it and is cut at ``size``."""
    if overlap <= 0:
        return pieces
    lag = F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.substring(F.concat(F.right(F.element_at(pieces, F.greatest(i, F.lit(1))), F.lit(overlap)), x), 1, size)))
    return F.when(F.size(pieces) > 1, lag).otherwise(pieces)


def recursive_chunks(text: Column, size: int = 1532, overlap: int = 200) -> Column:
    return overlap_pieces(recursive_pieces(text, size), size, overlap)


def merge_small(chunks: Column, least: int, most: int | None = None) -> Column:
    """Neighbouring chunks joined by a blank line while the current one is below ``least`` and the sum fits."""
    limit = 3 * least if most is None else most
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.concat(acc["cur"], F.lit("\n\n"), x)
        fits = (F.length(acc["cur"]) < least) & (F.length(joined) <= limit)
        return (
            F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), x.alias("cur")))
            .when(fits, F.struct(acc["done"].alias("done"), joined.alias("cur")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), x.alias("cur")))
        )

    return F.aggregate(chunks, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), strip), lambda x: x != "")


def symbol_text(symbol: Column) -> Column:
    """Head, signature and documentation of a symbol: what other strategies than ``code`` split."""
    signature = F.coalesce(F.concat(F.nullif(symbol["signature"], F.lit("")), F.lit("\n")), F.lit(""))
    doc = F.coalesce(F.concat(F.lit("\n"), F.nullif(symbol["docstring"], F.lit(""))), F.lit(""))
    return F.concat(symbol["symbol_type"], F.lit(": "), symbol["qualified_name"], F.lit("\n"), signature, doc)


def code_chunks(symbol: Column, size: int = 1536, overlap: int = 200, include_source: bool = True) -> Column:
    """Chunks of a symbol: head with documentation, then its source; what is left is windowed."""
    head = F.concat(
        symbol["symbol_type"], F.lit(": "), symbol["qualified_name"],
        F.coalesce(F.concat(F.lit("\n"), F.nullif(symbol["signature"], F.lit(""))), F.lit("")),
        F.coalesce(F.concat(F.lit("\n\nDocumentation:\n"), F.nullif(symbol["docstring"], F.lit(""))), F.lit("")),
    )
    if not include_source:
        return F.when(F.length(head) <= size, F.array(head)).otherwise(fixed_chunks(head, size, overlap, False))
    content = F.coalesce(symbol["content"], F.lit(""))
    prefix = F.concat(head, F.lit("\n\nSource:\n"))
    full = F.concat(prefix, content)
    left = F.lit(size) - F.length(prefix)
    rest = F.substring(content, left + 1, F.length(content))
    split = F.concat(F.array(F.concat(prefix, F.substring(content, F.lit(1), left))), fixed_chunks(rest, size, overlap, False))
    both = F.concat(fixed_chunks(head, size, overlap, False), fixed_chunks(content, size, overlap, False))
    return F.when(F.length(full) <= size, F.array(full)).when(left > 0, split).otherwise(both)
