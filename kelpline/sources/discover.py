"""File discovery: a glob scan with symlink dedup, and the exclusion predicate as a Column."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Default patterns of files to index and of files to leave out.
DEFAULT_INDEX_PATTERNS = ("**/*.md", "**/*.txt", "**/*.pdf", "**/*.epub", "**/*.rst", "**/*.html", "**/*.htm", "**/*.py", "**/*.php", "**/*.rs")
DEFAULT_EXCLUDE_PATTERNS = (
    "node_modules/**", ".git/**", "__pycache__/**", "*.pyc", "venv/**", ".venv/**", ".tox/**", ".nox/**", ".mypy_cache/**",
    ".pytest_cache/**", ".ruff_cache/**", "*.egg-info/**", "dist/**", "build/**", ".direnv/**",
)
FILES = "source string, resolved string, rel_path string, filename string, extension string, size long, mtime double"


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression for the whole string; ``*`` crosses slashes."""
    out, i = ["(?s)\\A"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + body[1:] if body.startswith('!') else body}]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c == "_" else f"\\{c}" if c.isascii() else c)
    return "".join(out) + "\\z"


def _like(regex: str):
    return lambda x: x.rlike(regex)


def is_excluded(rel_path: Column, patterns: Iterable[str]) -> Column:
    """True if a pattern matches the relative path, one of its parts, or (``x/**``) one of its folders."""
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    out = F.lit(False)
    for p in patterns:
        whole = glob_regex(p)
        out = out | rel_path.rlike(whole) | F.exists(parts, _like(whole))
        if p.endswith("/**"):
            out = out | F.exists(folders, _like(glob_regex(p[:-3])))
    return out


def mark_excluded(files: DataFrame, exclude: Iterable[str] = (), use_defaults: bool = True) -> DataFrame:
    """``files`` with ``excluded``; the given patterns come before the defaults."""
    patterns = [*exclude, *(DEFAULT_EXCLUDE_PATTERNS if use_defaults else ())]
    return files.withColumn("excluded", is_excluded(F.col("rel_path"), patterns))


def filter_files(files: DataFrame, exclude: Iterable[str] = (), use_defaults: bool = True) -> tuple[DataFrame, DataFrame]:
    """Included and excluded files."""
    marked = mark_excluded(files, exclude, use_defaults)
    return marked.where("NOT excluded").drop("excluded"), marked.where("excluded").drop("excluded")


def scan(spark: SparkSession, directory: str, patterns: Iterable[str] = DEFAULT_INDEX_PATTERNS, slices: int | None = None) -> DataFrame:
    """Regular files that match the patterns, each resolved path once (first pattern, then path order).

    The top-level folders are listed in parallel tasks, so that a large tree is never listed by the driver.
    """
    patterns = list(patterns)
    base = os.path.abspath(directory)
    tops = sorted(e.name for e in os.scandir(base) if e.is_dir()) if os.path.isdir(base) else []
    # one task per top-level folder; files directly below the root belong to the task ''
    jobs = spark.createDataFrame([(t,) for t in ["", *tops]], "top string").repartition(slices or max(1, len(tops)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["k", "source", "resolved", "rel_path", "filename", "extension", "size", "mtime"]
        for pdf in batches:
            rows = []
            for top in pdf["top"]:
                for k, pattern in enumerate(patterns):
                    deep = pattern.startswith("**/")
                    if not top:
                        found = Path(base).glob(pattern[3:] if deep else pattern)
                        found = [p for p in found if p.parent == Path(base) or not deep]
                    else:
                        found = (Path(base) / top).glob(pattern) if deep else []
                    for path in found:
                        if path.is_file():
                            s = path.stat()
                            rows.append((k, str(path), str(path.resolve()), str(path.relative_to(base)), path.name, path.suffix, s.st_size, s.st_mtime))
            yield pd.DataFrame(rows, columns=columns)

    listed = jobs.mapInPandas(run, "k int, " + FILES)
    return first_per_resolved(listed).drop("k")


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """The listing of a single file; ``ValueError`` if it is none."""
    p = Path(os.path.abspath(path))
    if not p.is_file():
        raise ValueError(f"no file {p}")
    s = p.stat()
    return spark.createDataFrame([(str(p), str(p.resolve()), p.name, p.name, p.suffix, s.st_size, s.st_mtime)], FILES)


def first_per_resolved(listed: DataFrame) -> DataFrame:
    """One row per resolved path: the first by pattern, then by path."""
    w = Window.partitionBy("resolved").orderBy("k", "source")
    return listed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_bytes(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` and ``error``, read by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content, error = [], []
            for path in pdf["source"]:
                try:
                    content.append(Path(path).read_bytes())
                    error.append(None)
                except OSError as exc:
                    content.append(None)
                    error.append(str(exc))
            yield pdf.assign(content=content, error=error)

    return files.mapInPandas(run, FILES + ", content binary, error string")


def discover(spark: SparkSession, directory: str, patterns: Iterable[str] = DEFAULT_INDEX_PATTERNS, exclude: Iterable[str] | None = None) -> DataFrame:
    """Scan and exclusion by the given patterns alone (no defaults)."""
    return filter_files(scan(spark, directory, patterns), exclude or (), use_defaults=False)[0]
