"""Loaders: bytes of files in, typed documents out, with one error column for what failed."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import date, datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import htmltree
from .symbols import LANGUAGES, SYMBOL, symbols_of

KNOWN = (
    "title", "author", "description", "keywords", "language", "publisher", "date", "identifier", "subject", "creator", "producer",
    "creation_date", "modification_date", "doi", "doc_type", "module_path", "item_type", "signature",
)
METADATA = T.StructType(
    [T.StructField("filename", T.StringType()), T.StructField("extension", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified_time", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in KNOWN]
    + [T.StructField("page_count", T.IntegerType()), T.StructField("is_code", T.BooleanType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
DOCUMENT = T.StructType([T.StructField("source", T.StringType()), T.StructField("content", T.StringType()), T.StructField("metadata", METADATA), T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("error", T.StringType())])
# Elements and classes that are no content, and item types of Rust documentation.
UNWANTED = ("script", "style", "nav", "noscript", "iframe", "svg")
RUSTDOC_CLASSES = ("sidebar", "search-form", "rustdoc-footer")
RUSTDOC_ITEMS = ("struct", "fn", "trait", "enum", "mod", "type", "macro", "constant")


def _utf8(raw: bytes) -> str:
    return re.sub(r"\r\n?", "\n", raw.decode("utf-8"))


def load_text(raw: bytes) -> tuple[str, dict]:
    return _utf8(raw), {}


def load_markdown(raw: bytes) -> tuple[str, dict]:
    """Front matter as metadata, the stripped rest as content; broken front matter stays in the text."""
    text = _utf8(raw)
    m = re.match(r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", text, re.S)
    if not m:
        return text.strip(), {}
    import yaml

    meta = yaml.safe_load(m[1])
    if not isinstance(meta, dict):
        return text.strip(), {}
    return text[m.end() :].strip(), {str(k): v for k, v in meta.items()}


def load_rst(raw: bytes) -> tuple[str, dict]:
    text = _utf8(raw)
    lines = text.split("\n")
    at = next((i for i in range(1, len(lines)) if lines[i] and all(c in "=-~`" for c in lines[i].strip())), None)
    return text, {} if at is None else {"title": lines[at - 1].strip()}


def _html_metadata(root: htmltree.Node) -> dict:
    out = {}
    title = root.find("title")
    if title is not None and title.text().strip():
        out["title"] = "".join(title.texts()).strip()
    metas = root.find_all("meta")
    for key, names in (("description", ("description", "og:description")), ("keywords", ("keywords",)), ("author", ("author",))):
        for name in names:
            found = next((m for m in metas if m.attrs.get("name") == name), None) or next((m for m in metas if m.attrs.get("property") == name), None)
            if found is not None and found.attrs.get("content"):
                out[key] = found.attrs["content"].strip()
                break
    return out


def _is_rustdoc(root: htmltree.Node) -> bool:
    body = root.find("body")
    return body is not None and "rustdoc" in body.classes()


def _rustdoc(root: htmltree.Node, meta: dict) -> None:
    """Fields of a page of Rust documentation; its own furniture goes."""
    meta["doc_type"] = "rustdoc"
    for node in root.walk():
        if "fqn" in node.classes():
            meta["module_path"] = node.text()
            break
    kind = next((c for c in root.find("body").classes() if c in RUSTDOC_ITEMS), None)
    if kind:
        meta["item_type"] = kind
    pre = next((n for n in root.find_all("pre") if "rust" in n.classes()), None)
    if pre is not None:
        meta["signature"] = pre.text()
    for node in [n for n in root.walk() if set(n.classes()) & set(RUSTDOC_CLASSES)]:
        node.drop()


#: specialised pages: (which they are, what is done with them); the first that applies counts.  Register own ones here.
HTML_LOADERS: list[tuple[Callable[[htmltree.Node], bool], Callable[[htmltree.Node, dict], None]]] = [(_is_rustdoc, _rustdoc)]


def load_html(raw: bytes) -> tuple[str, dict]:
    """Text of a page without its furniture; specialised pages get their extra fields."""
    root = htmltree.parse(_utf8(raw))
    meta = _html_metadata(root)
    for applies, special in HTML_LOADERS:
        if applies(root):
            special(root, meta)
            break
    for node in root.find_all(*UNWANTED):
        node.drop()
    return root.text("\n"), meta


def load_epub(raw: bytes) -> tuple[str, dict]:
    """Chapters in spine order joined by blank lines, with the Dublin Core fields."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        fields: dict[str, list[str]] = {}
        for e in package.iter():
            if "purl.org/dc/" in e.tag and (e.text or "").strip():
                fields.setdefault(local(e), []).append(e.text.strip())
        manifest = [e.attrib for e in package.iter() if local(e) == "item"]
        chapters = []
        for item in manifest:
            if item.get("media-type") in ("application/xhtml+xml", "text/html"):
                text = htmltree.parse(z.read(base + item["href"]).decode("utf-8", "replace")).text("\n")
                if text.strip():
                    chapters.append(text)
    meta = {n: fields[n][0] for n in ("title", "language", "publisher", "description", "date", "identifier") if n in fields}
    if "creator" in fields:
        meta["author"] = "; ".join(fields["creator"])
    return "\n\n".join(chapters), meta


# -- PDF -----------------------------------------------------------------------------------------------
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|-?\d*\.?\d+|T[jJ*dDmr]|'|\"|BT|ET", re.S)
# Keys of the document information and what they are called here.
PDF_KEYS = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer"}


def _pdf_string(token: bytes) -> str:
    if token.startswith(b"<"):
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", token[1:-1])) % 2 else ""))
    else:
        escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = re.sub(rb"\\([0-7]{1,3}|.|\n)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else escapes.get(m[1], b"" if m[1] == b"\n" else m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def pdf_date(value: str) -> str | None:
    s = value[2:] if value.startswith("D:") else value
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}" if len(s) >= 8 else None


def pdf_stream(body: bytes) -> bytes:
    at = body.find(b"stream")
    if at < 0:
        return b""
    data = body[at + 6 :].lstrip(b"\r").removeprefix(b"\n")
    data = data[: data.rfind(b"endstream")]
    if b"FlateDecode" in body[:at]:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return b""
    return data


def pdf_objects(raw: bytes) -> dict[int, bytes]:
    """Bodies of the objects of a PDF by number, those in object streams included."""
    if not raw.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    for body in list(objects.values()):
        if b"/ObjStm" in body:
            data = pdf_stream(body)
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
            head = list(map(int, data[:first].split()[: 2 * n]))
            ends = [*head[3::2], len(data) - first]
            for (num, off), end in zip(zip(head[::2], head[1::2]), ends):
                objects.setdefault(num, data[first + off : first + end])
    return objects


def pdf_raw_text(contents: list[bytes]) -> str:
    """All strings of the content streams as single-byte text, whatever operators stand between them."""
    return "\n\n".join(t for c in contents if (t := " ".join(_pdf_string(x).strip() for x in re.findall(rb"\((?:[^()\\]|\\.)*\)", c, re.S)).strip()))


def garbled(text: str) -> bool:
    """More than 30 % replacement characters."""
    return bool(text.strip()) and text.count("\ufffd") / len(text) > 0.3


def _page_text(stream: bytes) -> str:
    out: list[str] = []
    pending: list[str] = []
    for m in _STRING.finditer(stream):
        tok = m.group()
        if tok[:1] in (b"(", b"<"):
            pending.append(_pdf_string(tok))
        elif tok in (b"Tj", b"TJ"):
            out += pending
            pending = []
        elif tok in (b"'", b'"'):
            out += ["\n", *pending]
            pending = []
        elif tok in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            if out and out[-1] != "\n":
                out.append("\n")
            pending = []
        elif tok == b"BT":
            pending = []
    return "".join(out).strip()


def load_pdf(raw: bytes) -> tuple[str, dict]:
    """Text of a PDF with plain or deflated content streams and simple fonts; pages joined by blank lines.

    This built-in reader covers unencrypted files with object-level pages; ``LOADERS`` takes another one.
    """
    objects = pdf_objects(raw)
    pages = [b for b in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    texts, contents = [], []
    for page in pages:
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", page)
        ids = re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs and refs[1] else [refs[2]] if refs else []
        streams = [pdf_stream(objects.get(int(i), b"")) for i in ids]
        contents += streams
        text = "\n".join(map(_page_text, streams)).strip()
        if text:
            texts.append(text)
    meta: dict = {"page_count": len(pages)}
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", raw)
    body = objects.get(int(info[1]), b"") if info else b""
    for m in re.finditer(rb"/(\w+)\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", body, re.S):
        key, value = m[1].decode(), _pdf_string(m[2]).strip()
        if key in PDF_KEYS and value:
            meta[PDF_KEYS[key]] = value
        elif key in ("CreationDate", "ModDate") and (day := pdf_date(value)):
            meta["creation_date" if key == "CreationDate" else "modification_date"] = day
    content = "\n\n".join(texts)
    if garbled(content):
        content = pdf_raw_text(contents)
    if found := find_doi(content):
        meta["doi"] = found
    return content, meta


def find_doi(text: str) -> str | None:
    from ..functions.text import DOI_MARK, DOI_URL

    m = re.search(DOI_URL, text) or re.search(DOI_MARK, text)
    return m[1].rstrip(".,;:") if m else None


#: loader by lower-case extension; anything else is text.  Register own loaders here.
LOADERS: dict[str, Callable[[bytes], tuple[str, dict]]] = {
    ".md": load_markdown, ".txt": load_text, ".pdf": load_pdf, ".rst": load_rst, ".epub": load_epub, ".html": load_html, ".htm": load_html,
} | {e: load_text for e in LANGUAGES}


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=lambda x: x.isoformat() if isinstance(x, (date, datetime)) else str(x))


def load_one(source: str, filename: str, extension: str, size: int, mtime: float, content: bytes | None, error: str | None = None) -> dict:
    """One document row; what fails becomes its error."""
    meta = {f.name: None for f in METADATA} | {"extra": {}}
    row = {"source": source, "content": None, "metadata": meta, "symbols": None, "error": error}
    ext = (extension or "").lower()
    try:
        if content is None:
            raise ValueError(error or "no content")
        text, found = LOADERS.get(ext, load_text)(bytes(content))
        for key, value in found.items():
            if key in KNOWN or key == "page_count":
                meta[key] = value if key == "page_count" or isinstance(value, str) else None if value is None else _json(value)
            elif key not in ("filename", "extension"):
                meta["extra"][key] = _json(value)
        row["content"] = text
        if ext in LANGUAGES:
            meta["is_code"] = True
            row["symbols"] = symbols_of(text, LANGUAGES[ext], filename.rsplit(".", 1)[0])
        meta |= {"filename": filename, "extension": extension}
        if ext not in (".md", ".epub", ".pdf"):
            meta |= {"size": size, "modified_time": mtime}
    except Exception as exc:  # the error channel of a row: one bad file must not stop the others
        row |= {"content": None, "symbols": None, "error": f"{type(exc).__name__}: {exc}"}
    return row


def load(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` become documents; columns as in ``DOCUMENT``, one row per file, no shuffle."""
    have = files.columns
    source = files.select("source", "filename", "extension", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), "content", (F.col("error") if "error" in have else F.lit(None).cast("string")).alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([load_one(*r) for r in pdf.itertuples(index=False)], columns=[f.name for f in DOCUMENT])

    return source.mapInPandas(run, DOCUMENT)
