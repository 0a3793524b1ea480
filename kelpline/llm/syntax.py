"""Source files that do not parse: flags per file, rates per repository and language.

Method: the languages of a file are ranked by its tokens, and its content is parsed against the grammars
of all supported languages in that order.  A file that fails in its own language but parses in another
has the wrong extension; a file that parses in none is corrupt.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import phplang, rustlang

# Extensions of the supported languages, compared without case.
EXTENSIONS = {".py": "python", ".pyi": "python", ".php": "php", ".php5": "php", ".phtml": "php", ".rs": "rust"}
LANGUAGES = ("python", "php", "rust")
#: token shapes that speak for a language, and their weight
MARKS = {
    "python": re.compile(r"^\s*(?:def|class|import|from|elif|except|with|async def|@\w)\b.*|\bself\b|\bNone\b|:\s*$", re.M),
    "php": re.compile(r"<\?php|<\?=|\$\w+|->|\bfunction\b|\becho\b|=>"),
    "rust": re.compile(r"\bfn\b|\blet\b|\bimpl\b|\bpub\b|\bmut\b|&str|::|->|#\[|\bmatch\b|\busize\b"),
}


def rank(text: str) -> list[str]:
    """Languages by the number of their tokens in the text, best first; ties in a fixed order."""
    return sorted(LANGUAGES, key=lambda x: (-len(MARKS[x].findall(text)), LANGUAGES.index(x)))


def parses(text: str, language: str, foreign: bool = False) -> bool:
    """Is ``text`` valid in ``language``?  As a foreign language, text without code is no evidence."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
            return not foreign or bool(tree.body) and not all(isinstance(x, ast.Expr) and isinstance(x.value, (ast.Name, ast.Constant)) for x in tree.body)
        if language == "php":
            items = phplang.parse(text)
            return not foreign or phplang.has_code(text) and bool(items)
        return bool(rustlang.parse(text)) or not foreign
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def judge(content: bytes | None, extension: str | None) -> tuple[str | None, bool | None, str | None, str | None]:
    """``(language of the extension, valid, language it parses as, verdict)``.

    Verdicts are ``valid``, ``wrong_extension`` and ``corrupt``; unknown extensions and null contents give
    nulls.  Bytes that are no UTF-8 are invalid in every language; a byte-order mark and CRLF are fine.
    """
    language = EXTENSIONS.get((extension or "").lower())
    if content is None or language is None:
        return language, None, None, None
    try:
        text = bytes(content).decode("utf-8-sig")
    except UnicodeDecodeError:
        return language, False, None, "corrupt"
    order = rank(text)
    # a stand-in for line ends: the grammars see one kind
    text = text.replace("\r\n", "\n")
    found = [x for x in order if parses(text, x, foreign=x != language)]
    if language in found:
        return language, True, language, "valid"
    return language, False, (found[0] if found else None), "wrong_extension" if found else "corrupt"


def check_files(files: DataFrame, keep: tuple[str, ...] = ("file_id", "repository")) -> DataFrame:
    """``keep`` columns and ``ext_language, valid, parsed_as, verdict`` for every row; no shuffle."""
    source = files.select(*keep, F.col("extension").alias("_ext"), F.col("content").alias("_content"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    schema += ", ext_language string, valid boolean, parsed_as string, verdict string"
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(c, e) for e, c in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            cols = [batch.column(i) for i in range(n)]
            for k, kind in enumerate((pa.string(), pa.bool_(), pa.string(), pa.string())):
                cols.append(pa.array([r[k] for r in rows], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ext_language", "valid", "parsed_as", "verdict"])

    return source.mapInArrow(run, schema)


def invalid_rates(checked: DataFrame) -> DataFrame:
    """``(repository, language, files, invalid, rate)`` over files of supported languages."""
    return (
        checked.where(F.col("valid").isNotNull())
        .groupBy("repository", F.col("ext_language").alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
