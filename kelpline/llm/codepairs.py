"""Functions paired with their documentation.

Method: signatures are detected with regular expressions on the source text, bodies are delimited by an
indentation stack (Python) or a stack of braces (PHP, Rust), and comments are attached by line distance.
Functions nested in functions are skipped.  Pairs with empty or trivial documentation are dropped.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax import EXTENSIONS, parses

PY_DEF = re.compile(r"^([ \t]*)(?:(async)[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")
PHP_DEF = re.compile(r"^[ \t]*((?:(?:public|protected|private|static|abstract|final)[ \t]+)*)function[ \t]+&?[ \t]*([A-Za-z_]\w*)[ \t]*\(")
PHP_BOX = re.compile(r"^[ \t]*(?:(?:abstract|final|readonly)[ \t]+)*(class|interface|trait|enum)[ \t]+([A-Za-z_]\w*)")
RUST_DEF = re.compile(r"^[ \t]*(?:pub(?:[ \t]*\([^()]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+([^\W\d]\w*)")
RUST_BOX = re.compile(r"^[ \t]*(?:unsafe[ \t]+)?(?:(impl)\b(.*)|(?:pub(?:[ \t]*\([^()]*\))?[ \t]+)?(?:unsafe[ \t]+)?(trait|mod)[ \t]+([^\W\d]\w*))")
#: what blanks out strings and comments so that braces can be counted; PHP and Rust differ
PHP_BLANK = re.compile(r"/\*.*?\*/|(?://|#(?!\[))(?:(?!\?>)[^\n])*|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|<<<[ \t]*([\"']?)([A-Za-z_]\w*)\1\n.*?^[ \t]*\2\b", re.S | re.M)
RUST_TOKEN = re.compile(r"//[^\n]*|/\*|\*/|(?:b|c)?r(#*)\"|(?:b|c)?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'", re.S)


def _spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def blank_rust(text: str) -> str:
    out, pos = [], 0
    while m := RUST_TOKEN.search(text, pos):
        out.append(text[pos : m.start()])
        body = m.group()
        end = m.end()
        if body == "/*":
            depth = 1
            for k in re.finditer(r"/\*|\*/", text[end:]):
                depth += 1 if k.group() == "/*" else -1
                if not depth:
                    end += k.end()
                    break
            else:
                end = len(text)
        elif m[1] is not None:
            at = text.find('"' + m[1], end)
            end = len(text) if at < 0 else at + 1 + len(m[1])
        out.append(_spaces(text[m.start() : end]))
        pos = end
    out.append(text[pos:])
    return "".join(out)


def _doc_python(lines: list[str], head_end: int, indent: int, stop: int) -> str | None:
    """The string literal that is the first statement of a body."""
    at = head_end + 1
    while at < stop and (not lines[at].strip() or lines[at].lstrip().startswith("#")):
        at += 1
    if at >= stop:
        return None
    first = lines[at].lstrip()
    m = re.match(r"(?:[rRuU]{0,2})(\"\"\"|'''|\"|')", first)
    if not m:
        return None
    body = "\n".join([first, *lines[at + 1 : stop]])
    quote = m[1]
    end = m.end()
    while True:
        end = body.find(quote, end)
        if end < 0:
            return None
        back = len(body[:end]) - len(body[:end].rstrip("\\"))
        if back % 2 == 0:
            break
        end += 1
    literal = body[: end + len(quote)]
    rest = body[end + len(quote) :].split("\n", 1)[0].strip()
    if rest and not rest.startswith((";", "#")):
        return None
    try:
        value = ast.literal_eval(literal)
    except (SyntaxError, ValueError):
        return None
    return value if isinstance(value, str) else None


def _python(text: str) -> list[dict]:
    lines = text.split("\n")
    # strings over several lines may hold anything at the margin; their inner lines are no code
    inner = [False] * (len(lines) + 1)
    try:
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.Constant, ast.JoinedStr)) and getattr(node, "end_lineno", 0) > node.lineno:
                for k in range(node.lineno, node.end_lineno):
                    inner[k] = True
    except (SyntaxError, ValueError, RecursionError):
        return []
    stack: list[tuple[int, str, str]] = []  # indentation, kind, name
    out, depth = [], 0
    for i, line in enumerate(lines):
        if inner[i] or not line.strip() or line.lstrip().startswith("#"):
            continue
        m = PY_DEF.match(line)
        indent = len(line.expandtabs()) - len(line.expandtabs().lstrip())
        if depth == 0 and line.lstrip()[0] not in ")]}":
            while stack and indent <= stack[-1][0]:
                stack.pop()
        if m and depth == 0:
            kind, name = m[3], m[4]
            # end of the head: the line on which the brackets are closed
            level, end = 0, i
            while end < len(lines):
                bare = re.sub(r"#.*|\"[^\"\n]*\"|'[^'\n]*'", "", lines[end])
                level += sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")
                if level <= 0 and re.search(r":", bare):
                    break
                end += 1
            if kind == "def" and not any(k == "def" for _, k, _ in stack):
                stop = next((k for k in range(end + 1, len(lines)) if lines[k].strip() and not inner[k] and not lines[k].lstrip().startswith("#") and len(lines[k]) - len(lines[k].lstrip()) <= indent), len(lines))
                while stop > end + 1 and not inner[stop - 1] and (not lines[stop - 1].strip() or lines[stop - 1].lstrip().startswith("#") and len(lines[stop - 1]) - len(lines[stop - 1].lstrip()) <= indent):
                    stop -= 1
                box = stack[-1][2] if stack else ""
                one = re.search(r":[ \t]*(?:[rRuU]{0,2})([\"'].*)$", lines[end]) if end + 1 >= stop else None
                doc = _doc_python(lines, end, indent, stop)
                if doc is None and one is not None:
                    doc = _doc_python(["", one[1]], 0, indent, 2)
                out.append({"name": name, "qualified_name": f"{box}.{name}" if box else name, "kind": "method" if box else "function", "line_start": i + 1, "line_end": stop, "code": "\n".join(lines[i:stop]), "doc": doc})
            stack.append((indent, kind, name))
    return out


def _braced(text: str, blanked: str, language: str) -> list[dict]:
    lines, bare = text.split("\n"), blanked.split("\n")
    starts = [0]
    for line in bare:
        starts.append(starts[-1] + len(line) + 1)
    stack: list[tuple[str, str]] = []  # what each open brace belongs to
    pending: tuple[str, str] | None = None
    opened: list[int] = []
    out = []
    for i, line in enumerate(bare):
        box = fn = None
        if language == "php":
            if m := PHP_DEF.match(line):
                fn = m[2]
            elif m := PHP_BOX.match(line):
                box = m[2]
        else:
            if m := RUST_DEF.match(line):
                fn = m[1]
            elif m := RUST_BOX.match(line):
                if m[1]:
                    head = re.sub(r"^\s*<[^{]*?>(?=\s*\w)", "", m[2]) if m[2].lstrip().startswith("<") else m[2]
                    head = head.split("{")[0].split(" where ")[0]
                    box = (head.split(" for ", 1)[1] if " for " in head else head).strip()
                else:
                    box = m[4]
        inside = any(k == "fn" for k, _ in stack)
        if fn and not inside:
            holder = stack[-1][1] if stack and stack[-1][0] == "box" else ""
            item = {"name": fn, "qualified_name": f"{holder}.{fn}" if holder else fn, "kind": "method" if holder else "function", "line_start": i + 1, "line_end": i + 1, "doc": _doc_before(lines, bare, i, language)}
            out.append(item)
            pending = ("fn", fn)
            item["_open"] = True
        elif box and not inside:
            pending = ("box", box)
        for c in line:
            if c == "{":
                stack.append(pending or ("other", ""))
                opened.append(i)
                if pending and pending[0] == "fn":
                    out[-1]["_depth"] = len(stack)
                pending = None
            elif c == "}" and stack:
                if stack[-1][0] == "fn":
                    for item in reversed(out):
                        if item.get("_depth") == len(stack):
                            item["line_end"] = i + 1
                            item.pop("_depth")
                            break
                stack.pop()
                opened.pop()
            elif c == ";" and pending:
                if pending[0] == "fn" and line.count("(") <= line.count(")"):
                    out[-1]["line_end"] = i + 1
                    pending = None
    for item in out:
        item.pop("_open", None)
        item.pop("_depth", None)
        item["code"] = "\n".join(lines[item["line_start"] - 1 : item["line_end"]])
    return out


def _doc_before(lines: list[str], bare: list[str], i: int, language: str) -> str | None:
    """The documentation comment that ends next above line ``i``; attributes may stand between."""
    k = i - 1
    while k >= 0:
        line = lines[k].strip()
        if line.startswith("#[") or line.endswith("]") and "#[" in "".join(lines[max(0, k - 4) : k + 1]) and not line.startswith(("//", "*")):
            while k >= 0 and not lines[k].strip().startswith("#["):
                k -= 1
            k -= 1
            continue
        if not line:
            k -= 1
            if language == "php" or k >= 0 and lines[k].strip().endswith("*/") or k >= 0 and lines[k].strip().startswith("///"):
                continue
            return None
        break
    if k < 0:
        return None
    line = lines[k].strip()
    if language == "rust" and line.startswith("///") and not line.startswith("////"):
        got = []
        while k >= 0 and (lines[k].strip().startswith("///") or lines[k].strip().startswith("#[")):
            if lines[k].strip().startswith("///"):
                got.append(re.sub(r"^\s*/// ?", "", lines[k]))
            k -= 1
        return "\n".join(reversed(got))
    if line.endswith("*/"):
        j = k
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        if j < 0:
            return None
        block = "\n".join(lines[j : k + 1]).strip()
        if not re.match(r"/\*\*(?![*/])", block) and not re.fullmatch(r"/\*\*+/", block) or block == "/**/":
            return None
        body = re.sub(r"\A/\*\*+|\*+/\Z", "", block)
        return "\n".join(re.sub(r"^\s*\* ?", "", x) for x in body.split("\n")).strip()
    return None


def functions_of(text: str, language: str) -> list[dict]:
    """Functions and methods of a valid file with their documentation (null where there is none)."""
    text = text.replace("\r\n", "\n")
    if language == "python":
        return _python(text)
    if language == "php":
        # outside the tags is no code
        from ..sources.phplang import OPEN_TAG

        out, pos = [], 0
        while m := OPEN_TAG.search(text, pos):
            out.append(_spaces(text[pos : m.end()]))
            end = re.compile(r"\?>").search(text, m.end())
            stop = end.start() if end else len(text)
            out.append(text[m.end() : stop])
            pos = stop
        out.append(_spaces(text[pos:]))
        return _braced(text, PHP_BLANK.sub(lambda m: _spaces(m[0]), "".join(out)), "php")
    return _braced(text, blank_rust(text), "rust")


# Words that only name what every function has, or stand in for missing text.
KIND_WORDS = frozenset(
    "a an the this that these it its is are be to of for and or in on with by from as function functions method methods class classes fn func procedure routine helper helpers used use uses does do "
    "done doing return returns returned result results value values implementation implements implementing description describes describe given which what will can given call calls called name named "
    "struct trait module public private protected static constructor getter setter gets sets get set parameter parameters param params argument arguments arg args input inputs output type types "
    "summary docstring documentation doc docs object instance mixed void none null self int str string bool list array".split()
)
MISSING = re.compile(
    r"""(?ix)^\W*(?:
      (?:@?todo|fixme|xxx|tbd|tba|wip)\b.* | n/?a | none | null | nil | hack
    | (?:no|missing|without)\ (?:description|documentation|docs?|docstring|summary|comment|text)s?\b.*
    | (?:description|documentation|docs?|docstring|summary|comment|text)s?(?:\ (?:is|are))?\ (?:missing|pending|to\ follow|follows?|goes?\ here|to\ come|here|needed|tbd|todo|to\ be\ (?:written|added|done)|not\ (?:yet\ )?(?:available|written)|will\ follow\b.*|coming\ soon)\b.*
    | (?:write|add|document|describe|fill|complete|insert|put|enter|edit)\ (?:me|this|it|docs?|a?\ ?description|documentation|in|here|something)\b.*
    | (?:auto(?:matically)?[- ]?|machine[- ]?)generated\b.* | (?:created|generated)\ (?:from|by)\ (?:the\ |an?\ )?[\w ]*(?:template|editor|ide|plugin|tool)\b.*
    | (?:template|stub|placeholder|boilerplate)\b.* | to\ be\ (?:documented|written|done|completed|filled)\b.* | (?:coming|follows)\ soon\b.* | will\ follow\b.*
    | (?:description|documentation|docs?|docstring|summary|comment)s?\ (?:(?:will|shall)\ (?:be|follow|come)|coming|to\ be|not\ yet|pending)\b.*
    | .*\b(?:has|have)\ (?:no|not\ (?:yet\ )?(?:any|a))\ (?:description|documentation|docs?|docstring|comment)\b(?:\ yet)?
    | .*\b(?:hat|gibt\ es)\ (?:noch\ )?keine\ (?:beschreibung|dokumentation|doku)\b.* | .*\bn['’]a\ pas\ (?:encore\ )?de\ (?:description|documentation)\b.*
    | .*\b(?:a[uú]n|todav[ií]a)\ no\ tiene\ (?:descripci[oó]n|documentaci[oó]n)\b.* | .*\bainda\ n[aã]o\ tem\ (?:descri[cç][aã]o|documenta[cç][aã]o)\b.*
    | .*\b(?:jeszcze\ )?nie\ ma\ (?:jeszcze\ )?(?:opisu|dokumentacji)\b.* | .*\b(?:пока|ещё|еще)\ нет\ (?:описания|документации)\b.*
    | (?:説明|ドキュメント)は?(?:後で|未記入|なし|準備中).*
    | (?:enter|type)\ description\ here.* | \[.*\] | _\w+_ | \{?@inherit(?:doc)?\}?.* | undocumented\b.* | not\ (?:yet\ )?documented\b.*
    | (?:beschreibung|dokumentation|doku|kommentar)\ (?:folgt|fehlt|kommt)\b.* | noch\ (?:zu|keine)\b.* | keine\ (?:beschreibung|dokumentation)\b.*
    | (?:à|a)\ (?:compléter|documenter|faire)\b.* | (?:description|documentation)\ (?:à\ venir|manquante)\b.* | pas\ de\ (?:description|documentation)\b.*
    | (?:sin|falta(?:\ la)?|pendiente(?:\ de)?)\ (?:descripci[oó]n|documentaci[oó]n|documentar)\b.* | sem\ (?:descri[cç][aã]o|documenta[cç][aã]o)\b.* | (?:brak|bez)\ (?:opisu|dokumentacji)\b.* | (?:описание|документация)\ (?:отсутствует|будет|позже)\b.* | нет\ описания\b.*
    )\W*$"""
)
TAG_LINE = re.compile(r"^\s*(?:@[A-Za-z][\w-]*|:[A-Za-z][\w ]*:|\\[A-Za-z]+)")
SECTION = re.compile(r"(?i)^\s*(?:#+\s*)?(?:args?|arguments?|params?|parameters?|returns?|raises?|yields?|throws?|attributes?|keyword args|other parameters|examples?|notes?|panics|errors|safety)\s*:?\s*$")
ENTRY = re.compile(r"^\s*[-*]?\s*`?([\w$&*]+)`?\s*(?:\([^)]*\))?\s*[:–-]\s*(.*)$")
WORD = re.compile(r"[^\W\d_]+")


def _split_name(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+", name)
    return {p.lower() for p in parts} | {name.lower().strip("_")}


def _stems(word: str) -> set[str]:
    """A word and what it may be inflected from."""
    out = {word}
    for end, repl in (("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("er", ""), ("er", "e"), ("or", ""), ("ation", "e"), ("ion", "")):
        if word.endswith(end) and len(word) - len(end) >= 2:
            stem = word[: len(word) - len(end)] + repl
            out.add(stem)
            if len(stem) > 2 and stem[-1] == stem[-2]:
                out.add(stem[:-1])
    return out


def is_trivial(doc: str | None, name: str, qualified_name: str = "", params: str = "") -> bool:
    """Does the documentation say nothing beyond the item's name, kind and parameters?"""
    if doc is None or not WORD.search(doc):
        return True
    known: set[str] = set()
    for n in (name, *qualified_name.split("."), *re.findall(r"[^\W\d]\w*", params)):
        known |= _split_name(n)
    stems = set().union(*(_stems(w) for w in known)) if known else set()
    section = False
    kept = []
    for line in doc.split("\n"):
        s = line.strip()
        if SECTION.match(s):
            section = True
            continue
        if not s:
            kept.append("")
            continue
        if TAG_LINE.match(s):
            body = TAG_LINE.sub("", s)
            words = [w for w in re.findall(r"[$\w]+", body)]
            rest = [w.lower() for w in words if not w.startswith("$")]
            if sum(not (_stems(w) & stems) and w not in KIND_WORDS for w in rest) < 3:
                continue
            kept.append(body)
            continue
        if section and (m := ENTRY.match(line)):
            kept.append(m[2])
            continue
        kept.append(s)
    blocks = [b.replace("\n", " ") for b in re.split(r"\n\s*\n", "\n".join(kept))]
    for block in blocks:
        for sentence in re.split(r"(?<=[.!?])\s+", block.strip()):
            if not WORD.search(sentence) or MISSING.match(sentence):
                continue
            if re.search(r"(?i)\btodo\b|\bfixme\b", sentence) and MISSING.match(block):
                continue
            words = [w.lower() for w in WORD.findall(sentence)]
            new = [w for w in words if w not in KIND_WORDS and not (_stems(w) & stems)]
            if new:
                return False
    return True


def _params(code: str) -> str:
    at = code.find("(")
    if at < 0:
        return ""
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if not depth:
            return code[at : k + 1]
    return ""


def pairs_of(content: bytes | None, extension: str | None) -> list[dict]:
    """Code–description pairs of one file; files that do not parse or hold no known language give none."""
    language = EXTENSIONS.get((extension or "").lower())
    if content is None or language is None:
        return []
    try:
        text = bytes(content).decode("utf-8-sig")
    except UnicodeDecodeError:
        return []
    if not parses(text.replace("\r\n", "\n"), language):
        return []
    return [f | {"language": language} for f in functions_of(text, language) if not is_trivial(f["doc"], f["name"], f["qualified_name"], _params(f["code"]))]


SCHEMA = "file_id long, qualified_name string, name string, kind string, language string, line_start int, line_end int, code string, documentation string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("qualified_name", "name", "kind", "language", "line_start", "line_end", "code", "doc")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    for batch in batches:
        ids, rows = [], []
        for i, e, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for pair in pairs_of(c, e):
                ids.append(i)
                rows.append(pair)
        cols = [pa.array(ids, pa.int64())] + [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["file_id", "qualified_name", "name", "kind", "language", "line_start", "line_end", "code", "documentation"])


def documented_functions(source_files: DataFrame) -> DataFrame:
    """One row per function or method with real documentation; a file's repeated names come once each.

    Null contents, unknown extensions and invalid files give no rows.  Each file is read whole in one task.
    """
    return source_files.select("file_id", "extension", "content").mapInArrow(_run, SCHEMA)


def documented_symbols(source_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The pairs whose function the loader listed as a symbol, with the symbol's signature; each once.

    Repeated symbol rows are first reduced to one per (file, qualified name); a null signature gives way
    to any other.  Of functions with one qualified name in a file the first documented one counts.
    """
    listed = (
        symbols.where(F.col("symbol_type").isin("function", "method"))
        .groupBy("file_id", "qualified_name")
        .agg(F.max("signature").alias("signature"))
    )
    found = documented_functions(source_files)
    rest = [c for c in found.columns if c not in ("file_id", "qualified_name")]
    pairs = found.groupBy("file_id", "qualified_name").agg(F.min_by(F.struct(*rest), F.struct("line_start", "line_end", "code")).alias("p")).select("file_id", "qualified_name", "p.*").select(*found.columns)
    return pairs.join(listed, ["file_id", "qualified_name"])
