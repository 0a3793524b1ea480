"""The six chunking strategies as table functions over a text column.

``recursive``, ``fixed`` and ``code`` also exist as pure Column expressions in ``functions.text``; here all
run in one Arrow-batched function per row, which is faster for deep folds.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import htmltree
from .embed import DEFAULT_MODEL, loaded

SEPARATORS = ("\n\n", "\n", ". ", " ")


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters; an empty text has none."""
    if not text:
        return []
    step = size - overlap if size > overlap else size
    out = [text[:size]]
    at = step
    while at - step + size < len(text):
        out.append(text[at : at + size])
        at += step
    return out


def fixed(text: str, chunk_size: int = 1536, overlap: int = 50) -> list[str]:
    return windows(text, chunk_size, overlap) if text and text.strip() else []


def pieces(text: str, size: int, level: int = 0) -> list[str]:
    """Greedy packing of the parts at one separator; parts that are too long go down one level."""
    if level == len(SEPARATORS):
        return [text[i : i + size] for i in range(0, len(text), size)]
    sep, done, held = SEPARATORS[level], [], ""
    for part in text.split(sep):
        longer = held + sep + part if held else part
        if len(longer) <= size:
            held = longer
            continue
        if held:
            done.append(held)
        held = ""
        if len(part) > size:
            done += pieces(part, size, level + 1)
        else:
            held = part
    return done + [held] if held else done


def recursive(text: str, chunk_size: int = 1532, overlap: int = 200) -> list[str]:
    if not text or not text.strip():
        return []
    if len(text) <= chunk_size:
        return [text]
    parts = pieces(text, chunk_size)
    if overlap <= 0:
        return parts
    return parts[:1] + [(before[-overlap:] + part)[:chunk_size] for before, part in zip(parts, parts[1:])]


def merge_small(chunks: list[str], min_size: int, max_size: int | None = None) -> list[str]:
    limit = 3 * min_size if max_size is None else max_size
    out: list[str] = []
    for c in chunks:
        if out and len(out[-1]) < min_size and len(out[-1]) + 2 + len(c) <= limit:
            out[-1] += "\n\n" + c
        else:
            out.append(c)
    return out


# -- Markdown ------------------------------------------------------------------------------------------
class Section(NamedTuple):
    """A header's depth (0: text before any), its words, and the whole text up to the next header."""

    level: int
    title: str
    body: str


FRONT = re.compile(r"\A---\n(.*?)\n---\n", re.S)
#: a fenced block, whose lines are no headers, or the marks of a header (a fence may begin in its words)
BLOCK = re.compile(r"(?s:```.*?```)|^(#{1,6})\s+(?=(.+)$)", re.M)


def front_matter(text: str) -> tuple[str, str]:
    """Front matter with its marks (stripped; empty if there is none) and the rest."""
    m = FRONT.match(text)
    return (m.group().strip(), text[m.end() :]) if m else ("", text)


def sections(text: str) -> list[Section]:
    """The text cut at its headers, in one pass over headers and fences; without headers it is one section as it stands."""
    out, begun, said, level, title = [], 0, 0, 0, ""
    for m in BLOCK.finditer(text):
        if m[1] and m.start() >= said:  # the words of a header may stand on the next line and look like one
            out.append(Section(level, title, text[begun : m.start()].strip()))
            begun, said, level, title = m.start(), m.end(2), len(m[1]), m[2].strip()
    out.append(Section(level, title, text[begun:].strip() if level else text))
    return [s for s in out if s.level or s.body.strip()]


def merge_sections(found: list[Section], size: int, least: int) -> list[Section]:
    """A small section takes in the next one while both fit; it keeps its own level and title."""
    out: list[Section] = []
    for s in found:
        if out and len(out[-1].body) < least and len(out[-1].body) + 2 + len(s.body) <= size:
            out[-1] = out[-1]._replace(body=f"{out[-1].body}\n\n{s.body}")
        else:
            out.append(s)
    return out


def breadcrumb(found: list[Section], at: int) -> str:
    """Headers above a section, outermost first."""
    want, trail = found[at].level - 1, []
    for s in reversed(found[:at]):
        if want < 1:
            break
        if 0 < s.level <= want:
            trail.append(f"{'#' * s.level} {s.title}")
            want = s.level - 1
    return " > ".join(reversed(trail))


def markdown(text: str, chunk_size: int = 1500, overlap: int = 100, min_section_size: int = 100) -> list[str]:
    if not text or not text.strip():
        return []
    front, body = front_matter(text)
    found = sections(body)
    if all(s.level == 0 for s in found):
        return recursive(text, chunk_size, overlap)
    out = [front] if front else []
    merged = merge_sections(found, chunk_size, min_section_size)
    for i, s in enumerate(merged):
        if len(s.body) <= chunk_size:
            out += [s.body] if s.body.strip() else []
            continue
        trail = breadcrumb(merged, i)
        prefix = f"[Context: {trail}]\n\n" if trail else ""
        for j, part in enumerate(recursive(s.body, chunk_size, overlap)):
            out.append(prefix + part if j and len(prefix) + len(part) <= chunk_size else part)
    return out


# -- HTML ----------------------------------------------------------------------------------------------
LANDMARKS = ("article", "section", "main", "aside", "header", "footer", "nav")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _flat(node: htmltree.Node) -> str:
    return re.sub(r"\s+", " ", node.text(" ")).strip()


def _table_chunks(table: htmltree.Node, size: int, overlap: int) -> list[str]:
    whole = _flat(table)
    if len(whole) <= size:
        return [whole]
    out, held = [], ""
    for row in table.find_all("tr"):
        text = _flat(row)
        if not text:
            continue
        longer = f"{held} | {text}" if held else text
        if len(longer) <= size:
            held = longer
            continue
        if held:
            out.append(held)
        held = ""
        if len(text) > size:
            out += recursive(text, size, overlap)
        else:
            held = text
    return out + [held] if held else out


def _by_headings(root: htmltree.Node) -> list[str]:
    out = []
    for head in root.find_all(*HEADINGS):
        parts = [_flat(head)]
        siblings = head.parent.children
        for sib in siblings[next(i for i, s in enumerate(siblings) if s is head) + 1 :]:
            if not isinstance(sib, htmltree.Node):
                continue
            if sib.tag in HEADINGS or sib.find(*HEADINGS):
                break
            parts.append(_flat(sib))
        out.append(" ".join(p for p in parts if p))
    return out


def html(text: str, chunk_size: int = 1500, overlap: int = 100) -> list[str]:
    if not text or not text.strip():
        return []
    root = htmltree.parse(text)
    for node in root.find_all("script", "style", "noscript"):
        node.drop()
    tables = []
    for node in root.find_all("table"):
        tables += _table_chunks(node, chunk_size, overlap)
    for node in root.find_all("table"):
        node.drop()
    out = [_flat(n) for n in root.find_all(*LANDMARKS)]
    out = [x for x in out if x] or [x for x in _by_headings(root) if x] or recursive(_flat(root), chunk_size, overlap)
    cut = [p for c in out + tables for p in ([c] if len(c) <= chunk_size else recursive(c, chunk_size, overlap))]
    return [c for c in cut if c.strip()]


# -- semantic ------------------------------------------------------------------------------------------
def split_points(vectors: np.ndarray, threshold: float) -> list[int]:
    """Positions after which the similarity to the next segment is below ``threshold``; a zero vector has none."""
    norm = np.linalg.norm(vectors, axis=1)
    dots = np.einsum("ij,ij->i", vectors[:-1], vectors[1:]) if len(vectors) > 1 else np.array([])
    scale = norm[:-1] * norm[1:]
    sim = np.where(scale == 0, 0.0, dots / np.where(scale == 0, 1, scale))
    return [i + 1 for i in np.flatnonzero(sim < threshold)]


def merge_runs(segments: list[str], cuts: list[int], separator: str) -> list[str]:
    edges = [0, *cuts, len(segments)]
    return [separator.join(segments[a:b]) for a, b in zip(edges, edges[1:]) if a < b]


def bounded(chunks: list[str], size: int, least: int) -> list[str]:
    """Small chunks take in the next while both fit; what is then too long is split recursively."""
    out: list[str] = []
    for c in chunks:
        if out and len(out[-1]) < least and len(out[-1]) + 2 + len(c) <= size:
            out[-1] += "\n\n" + c
        else:
            out.append(c)
    return [p for c in out for p in ([c] if len(c) <= size else recursive(c, size, 0))]


def semantic(text: str, chunk_size: int = 1500, min_chunk_size: int = 200, similarity_threshold: float = 0.5, embedding_model: str | None = None) -> list[str]:
    if not text or not text.strip():
        return []
    text = text.strip()
    if len(text) <= chunk_size:
        return [text]
    paras = [p for x in text.split("\n\n") if (p := x.strip())]
    if len(paras) >= 3 and sum(map(len, paras)) / len(paras) >= 100:
        segments, separator = paras, "\n\n"
    else:
        segments, separator = [s for x in re.split(r"(?<=[.!?])\s+", text) if (s := x.strip())], " "
        if len(segments) < 3:
            return recursive(text, chunk_size, 0)
    try:
        vectors = loaded(embedding_model or DEFAULT_MODEL).embed(segments)
    except Exception:  # a model that fails leaves the text to the recursive splitter
        return recursive(separator.join(segments), chunk_size, 0)
    cuts = split_points(np.asarray(vectors, np.float64), similarity_threshold) or split_points(np.asarray(vectors, np.float64), 0.7 * similarity_threshold)
    if not cuts:
        return recursive(separator.join(segments), chunk_size, 0)
    return bounded(merge_runs(segments, cuts, separator), chunk_size, min_chunk_size)


def code(text: str, chunk_size: int = 1536, overlap: int = 200, include_source: bool = True) -> list[str]:
    """Plain text under the code strategy; symbols go through ``functions.text.code_chunks``."""
    return recursive(text, chunk_size, overlap)


CHUNKERS: dict[str, Callable[..., list[str]]] = {"recursive": recursive, "fixed": fixed, "markdown": markdown, "html": html, "semantic": semantic, "code": code}
#: preferred strategy by lower-case extension
PREFERRED = {
    ".md": "markdown", ".txt": "recursive", ".pdf": "semantic", ".rst": "recursive", ".epub": "recursive", ".html": "html", ".htm": "html",
    ".py": "code", ".pyi": "code", ".php": "code", ".php3": "code", ".php4": "code", ".php5": "code", ".phtml": "code", ".rs": "code",
}


def get_chunker(strategy: str, **options) -> Callable[[str], list[str]]:
    """The strategy with those of ``options`` it knows; ``ValueError`` for ``auto`` and unknown names."""
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(sorted(CHUNKERS))}" + (" ('auto' needs a file)" if strategy == "auto" else ""))
    known = inspect.signature(CHUNKERS[strategy]).parameters
    bound = {k: v for k, v in options.items() if k in known and v is not None}
    return lambda text: CHUNKERS[strategy](text, **bound)


def get_chunker_for_file(path: str, **options) -> Callable[[str], list[str]]:
    name = path.rsplit("/", 1)[-1]
    return get_chunker(PREFERRED.get("." + name.rsplit(".", 1)[-1].lower() if "." in name else "", "recursive"), **options)


def preferred_strategy(extension: Column) -> Column:
    """Strategy of an extension, as a literal map."""
    pairs = [F.lit(x) for kv in PREFERRED.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(extension)), F.lit("recursive"))


def chunk(text: Column, strategy: str | Column = "recursive", **options) -> Column:
    """``array<string>`` of chunks; ``strategy`` may be a column (see ``preferred_strategy``).  Null gives an empty array."""
    kind = T.ArrayType(T.StringType())
    if isinstance(strategy, str):
        get_chunker(strategy, **options)  # fail early

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        makers = {name: get_chunker(name, **options) for name in CHUNKERS}
        for texts, names in batches:
            yield pd.Series([makers[n](t) if t else [] for t, n in zip(texts, names)])

    return run(text, F.lit(strategy) if isinstance(strategy, str) else strategy)
