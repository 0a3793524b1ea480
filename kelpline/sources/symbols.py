"""Symbols of Python, PHP and Rust sources as rows of one schema."""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import phplang, rustlang

METADATA = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in ("decorators", "bases", "extends", "implements", "derives", "attributes", "lifetimes", "variants", "supertraits")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_async", "is_unsafe", "is_const", "is_mutable", "is_exported")]
    + [T.StructField(n, T.StringType()) for n in ("generics", "where_clause", "self_type", "trait", "aliased_type", "const_type", "static_type")]
)
SYMBOL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "qualified_name", "symbol_type", "content", "language", "docstring", "signature")]
    + [T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("parent", T.StringType()), T.StructField("visibility", T.StringType()), T.StructField("metadata", METADATA)]
)


def _symbol(name, kind, content, language, start, end, qualified=None, doc=None, signature=None, parent=None, visibility=None, **meta) -> dict:
    blank = {f.name: None for f in METADATA}
    return {"name": name, "qualified_name": qualified or name, "symbol_type": kind, "content": content, "language": language, "docstring": doc, "signature": signature, "line_start": start, "line_end": end, "parent": parent, "visibility": visibility, "metadata": blank | meta}


# -- Python --------------------------------------------------------------------------------------------
def python_symbols(text: str, stem: str = "") -> list[dict]:
    """Functions, classes each with its methods right behind, upper-case module constants and the module docstring; outer ones first."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.split("\n")
    cut = lambda node: "\n".join(lines[node.lineno - 1 : node.end_lineno])
    out = []
    if doc := ast.get_docstring(tree):
        out.append(_symbol("__module__", "module", doc, "python", 1, 1, qualified=f"{stem}.__module__", doc=doc))
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)

    def function(node, box: str | None = None) -> dict:
        args = ", ".join(a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args)
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        return _symbol(
            node.name, "method" if box else "function", cut(node), "python", node.lineno, node.end_lineno, qualified=f"{box}.{node.name}" if box else node.name,
            doc=ast.get_docstring(node), signature=f"({args}){returns}", parent=box, decorators=[ast.unparse(d) for d in node.decorator_list], is_async=isinstance(node, ast.AsyncFunctionDef),
        )

    methods = {id(f) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, kinds)}
    for node in ast.walk(tree):
        if isinstance(node, kinds):
            if id(node) not in methods:
                out.append(function(node))
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            out.append(_symbol(node.name, "class", cut(node), "python", node.lineno, node.end_lineno, doc=ast.get_docstring(node), signature=f"({', '.join(bases)})" if bases else None, bases=bases, decorators=[ast.unparse(d) for d in node.decorator_list]))
            out += [function(f, node.name) for f in node.body if isinstance(f, kinds)]
        elif isinstance(node, ast.Assign) and node in tree.body:
            out += [_symbol(t.id, "constant", cut(node), "python", node.lineno, node.end_lineno) for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
    return out


# -- shared by PHP and Rust ----------------------------------------------------------------------------
def clean_comment(comment: str) -> str:
    """Text of a block comment without marks, leading stars and blank lines."""
    body = re.sub(r"\A/\*[*!]?|\*/\Z", "", comment.strip())
    return "\n".join(x for line in body.split("\n") if (x := line.strip().lstrip("*").strip()))


class _Text:
    def __init__(self, text: str):
        self.text = text

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def span(self, pair) -> str | None:
        return None if pair is None else self.text[pair[0] : pair[1]]


def _php_doc(text: str, at: int) -> str | None:
    """The nearest ``/** */`` block above, with only blanks and attributes between."""
    head = re.sub(r"(?:\s|#\[[^\n]*\])+\Z", "", text[:at])
    m = re.search(r"/\*\*(?:(?!\*/).)*\*/\Z", head, re.S)
    return clean_comment(m.group()) or None if m else None


def php_symbols(text: str, recover: bool = True) -> list[dict]:
    """Functions, classes, interfaces, traits, methods and top-level constants; of a file with errors those that can be told."""
    try:
        items = phplang.parse(text)
    except SyntaxError:
        items = phplang.parse(text, recover=True) if recover else []
    t = _Text(text)

    def one(item, kind, parent=None):
        params, ret = t.span(item.params), t.span(item.ret)
        signature = params + (f": {ret}" if ret else "") if params else None
        meta = {}
        if kind == "class":
            meta = {"extends": [t.span(x) for x in item.extends] or None, "implements": [t.span(x) for x in item.implements] or None}
        visible = None
        if kind == "method":
            visible = next((m for m in item.modifiers if m in ("public", "protected", "private")), "public")
        return _symbol(item.name, kind, text[item.start : item.end], "php", t.line(item.start), t.line(item.end), qualified=f"{parent}.{item.name}" if parent else item.name, doc=_php_doc(text, item.start), signature=signature, parent=parent, visibility=visible, **meta)

    out = []
    for item in items:
        if item.kind in ("function", "class", "interface", "trait"):
            out.append(one(item, item.kind))
            out += [one(m, "method", item.name) for m in item.children]
        elif item.kind == "const":
            out.append(one(item, "constant"))
    return out


def _rust_doc(text: str, at: int) -> str | None:
    """Doc lines or a doc block right above an item, attributes skipped."""
    lines = text[:at].split("\n")[:-1]
    got: list[str] = []
    while lines:
        s = lines[-1].strip()
        if s.startswith("#["):
            lines.pop()
        elif s.startswith(("///", "//!")) and not s.startswith("////"):
            got.append(re.sub(r"^//[/!] ?", "", s))
            lines.pop()
        elif s.endswith("*/") and not got:
            m = re.search(r"/\*[*!](?:(?!\*/).)*\*/\s*\Z", "\n".join(lines), re.S)
            return clean_comment(m.group()) or None if m else None
        elif s.endswith("]") and not got and "#[" in "\n".join(lines[-6:]):
            while lines and not lines.pop().strip().startswith("#["):
                pass
        else:
            break
    return "\n".join(reversed(got)).strip() or None


def rust_symbols(text: str, recover: bool = True) -> list[dict]:
    """Functions, structs, enums, traits, impls, aliases, constants, statics, macros and inline modules; of a file with errors those that can be told."""
    try:
        items = rustlang.parse(text)
    except SyntaxError:
        items = rustlang.parse(text, recover=True) if recover else []
    t = _Text(text)
    out: list[dict] = []

    def common(item) -> dict:
        generics = t.span(item.generics)
        attributes = [t.span(a) for a in item.attrs]
        names = [x.strip() for a in attributes if (m := re.search(r"derive\(([^)]*)\)", a)) for x in m[1].split(",") if x.strip()]
        return {"generics": generics, "lifetimes": re.findall(r"'\w+", generics) if generics else None, "where_clause": t.span(item.where), "attributes": attributes or None, "derives": names or None}

    def add(item, kind, name=None, parent=None, signature=None, **meta):
        visible = item.vis or "private"
        if kind == "macro":
            visible = "pub" if any("macro_export" in t.span(a) for a in item.attrs) else "private"
        label = name or item.name
        out.append(_symbol(label, kind, text[item.start : item.end], "rust", t.line(item.start), t.line(item.end), qualified=f"{parent}.{label}" if parent and kind == "method" else label, doc=_rust_doc(text, item.start - len(text[: item.start].split("\n")[-1]) if not item.attrs else item.attrs[0][0]), signature=signature, parent=parent, visibility=visible, **(common(item) | meta)))

    def function(item, parent=None):
        words = [item.vis, *[w for w in ("const", "async", "unsafe") if w in item.words], "fn"]
        signature = " ".join(w for w in words if w) + f" {item.name}{t.span(item.generics) or ''}{t.span(item.params)}" + (f" -> {t.span(item.ret)}" if item.ret else "") + (f" {t.span(item.where)}" if item.where else "")
        add(item, "method" if parent else "function", parent=parent, signature=signature, is_async="async" in item.words, is_unsafe="unsafe" in item.words, is_const="const" in item.words)

    def declared(item, word, tail=""):
        return " ".join(x for x in (item.vis, word) if x) + f" {item.name}{t.span(item.generics) or ''}{tail}" + (f" {t.span(item.where)}" if item.where else "")

    def visit(items, parent=None):
        for item in items:
            k = item.kind
            if k == "fn":
                function(item, parent)
            elif k == "struct":
                add(item, "struct", signature=declared(item, "struct"))
            elif k == "enum":
                add(item, "enum", signature=declared(item, "enum"), variants=item.names or None)
            elif k == "trait":
                bounds = t.span(item.trait)
                add(item, "trait", signature=declared(item, "trait", f": {bounds}" if bounds else ""), supertraits=[bounds] if bounds else None, is_unsafe="unsafe" in item.words)
                for child in item.children:
                    if child.kind == "fn":
                        function(child, item.name)
            elif k == "impl":
                target, trait = t.span(item.target), t.span(item.trait)
                name = f"{trait} for {target}" if trait else target
                add(item, "impl", name=name, signature=f"impl {name}", self_type=target, trait=trait, is_unsafe="unsafe" in item.words)
                for child in item.children:
                    if child.kind == "fn":
                        function(child, target)
            elif k == "type":
                add(item, "type_alias", signature=declared(item, "type", f" = {t.span(item.value)}"), aliased_type=t.span(item.value))
            elif k == "const":
                add(item, "constant", signature=f"const {item.name}: {t.span(item.value)}", const_type=t.span(item.value))
            elif k == "static":
                add(item, "static", signature=f"static {'mut ' if 'mut' in item.words else ''}{item.name}: {t.span(item.value)}", static_type=t.span(item.value), is_mutable="mut" in item.words)
            elif k == "macro":
                add(item, "macro", signature=f"macro_rules! {item.name}", is_exported=any("macro_export" in t.span(a) for a in item.attrs))
            elif k == "mod" and item.has_body:
                add(item, "module", signature=declared(item, "mod"))
                visit(item.children, item.name)

    visit(items)
    return out


def symbols_of(text: str | None, language: str | None, stem: str = "", recover: bool = True) -> list[dict] | None:
    if text is None:
        return None
    if language == "python":
        return python_symbols(text, stem)
    if language == "php":
        return php_symbols(text, recover)
    if language == "rust":
        return rust_symbols(text, recover)
    return None


# Languages by lower-case extension.
LANGUAGES = {".py": "python", ".pyi": "python", ".php": "php", ".php3": "php", ".php4": "php", ".php5": "php", ".phtml": "php", ".rs": "rust"}


def language_of(extension: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(extension))


@F.udf(T.ArrayType(SYMBOL), useArrow=True)
def _extract(text, language, stem, recover):
    return symbols_of(text, language, stem or "", recover)


def extract_symbols(text: Column, extension: Column, stem: Column | None = None, recover: bool = True) -> Column:
    """``array<struct>`` of symbols; null where the extension is no code.

    Of a PHP or Rust file with errors it holds what can be told, or nothing without ``recover``; a Python
    file with errors has no symbols.
    """
    return _extract(text, language_of(extension), F.lit("") if stem is None else stem, F.lit(recover))
