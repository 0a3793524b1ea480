"""Rust 2021 syntax: a tokenizer and a recursive-descent parser that yields items with source spans.

``parse(text)`` returns the list of top-level :class:`Item` or raises ``SyntaxError``.  Only syntax is
judged; names and types are not.  The same tree feeds the symbol extractor and the syntax check.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .deep import deep_recursion

TOKEN = re.compile(
    r"""
    (?P<ws>\s+)
  | (?P<doc>///(?!/)[^\n]*|//![^\n]*)
  | (?P<line>//[^\n]*)
  | (?P<block>/\*)
  | (?P<raw>(?:b|c)?r(?P<hash>\#*)")
  | (?P<str>(?:b|c)?"(?:[^"\\]|\\(?s:.))*")
  | (?P<char>b?'(?:[^'\\\n\r\t]|\\(?:[nrt0\\'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
  | (?P<life>'[^\W\d]\w*)
  | (?P<num>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+\w*|0b[01_]+\w*
        |[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?)(?!\w)
  | (?P<id>r\#[^\W\d]\w*|[^\W\d]\w*)
  | (?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.
        |[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]])
    """,
    re.X,
)
KEYWORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return "
    "self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final "
    "macro override priv typeof unsized virtual yield try".split()
)
PATH_WORDS = frozenset("self Self super crate".split())
CLOSE = {"(": ")", "[": "]", "{": "}"}
#: binary operators and how tightly they bind
BINARY = {
    "*": 11, "/": 11, "%": 11, "+": 10, "-": 10, "<<": 9, ">>": 9, "&": 8, "^": 7, "|": 6,
    "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "&&": 4, "||": 3, "..": 2, "..=": 2,
    "=": 1, "+=": 1, "-=": 1, "*=": 1, "/=": 1, "%=": 1, "^=": 1, "&=": 1, "|=": 1, "<<=": 1, ">>=": 1,
}


@dataclass
class Item:
    """One syntactic item; offsets are code points into the text."""

    kind: str
    name: str
    start: int
    end: int = 0
    vis: str = ""
    head: tuple[int, int] = (0, 0)
    params: tuple[int, int] | None = None
    ret: tuple[int, int] | None = None
    generics: tuple[int, int] | None = None
    where: tuple[int, int] | None = None
    value: tuple[int, int] | None = None
    trait: tuple[int, int] | None = None
    target: tuple[int, int] | None = None
    words: tuple[str, ...] = ()
    attrs: list[tuple[int, int]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    children: list["Item"] = field(default_factory=list)
    has_body: bool = False


def _token(text: str, pos: int) -> tuple[str, int]:
    """Kind and end of the token at ``pos``."""
    m = TOKEN.match(text, pos)
    if not m:
        raise SyntaxError(f"unknown character at {pos}")
    kind, end = m.lastgroup, m.end()
    if kind == "hash" or (kind is not None and m.group("raw") is not None):
        close = '"' + m.group("hash")
        at = text.find(close, end)
        if at < 0:
            raise SyntaxError("raw string never ends")
        kind, end = "str", at + len(close)
    elif kind == "block":
        depth, at = 1, end
        while depth:
            nxt = re.compile(r"/\*|\*/").search(text, at)
            if not nxt:
                raise SyntaxError("comment never ends")
            depth += 1 if nxt.group() == "/*" else -1
            at = nxt.end()
        return "block", at
    return kind, end


def tokenize(text: str, recover: bool = False) -> list[list]:
    """``[kind, text, start, end]`` without blanks and comments; raises ``SyntaxError``, or passes over what is no token."""
    out, pos, n = [], 0, len(text)
    if text.startswith("﻿"):
        pos = 1
    if text.startswith("#!", pos) and not re.match(r"#!\s*\[", text[pos:]):
        pos = (text.find("\n", pos) + 1) or n
    while pos < n:
        try:
            kind, end = _token(text, pos)
        except SyntaxError:
            if not recover:
                raise
            pos += 1
            continue
        if kind not in ("ws", "doc", "line", "block"):
            out.append([kind, text[pos:end], pos, end])
        pos = end
    return out


class Parser:
    def __init__(self, text: str, recover: bool = False):
        self.text, self.toks, self.i = text, tokenize(text, recover), 0
        self.toks.append(["eof", "", len(text), len(text)])

    # -- token access ----------------------------------------------------------------------------
    @property
    def t(self) -> str:
        tok = self.toks[self.i]
        return tok[1] if tok[0] in ("id", "op") else ""

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    def ahead(self, k: int = 1) -> str:
        tok = self.toks[min(self.i + k, len(self.toks) - 1)]
        return tok[1] if tok[0] in ("id", "op") else ""

    def fail(self, what: str = "unexpected token"):
        tok = self.toks[self.i]
        raise SyntaxError(f"{what}: {tok[1]!r} at {tok[2]}")

    def eat(self, s: str) -> bool:
        if self.t == s:
            self.i += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.eat(s):
            self.fail(f"expected {s!r}")

    def eat_split(self, s: str) -> bool:
        """Eat ``s`` even as the first character of a longer operator."""
        if self.t == s:
            self.i += 1
            return True
        tok = self.toks[self.i]
        if tok[0] == "op" and len(tok[1]) > 1 and tok[1][0] == s and tok[1] not in ("->", "=>", "::", "..", "..=", "..."):
            self.toks[self.i] = ["op", tok[1][1:], tok[2] + 1, tok[3]]
            return True
        return False

    def ident(self) -> str:
        tok = self.toks[self.i]
        if tok[0] != "id" or tok[1] in KEYWORDS:
            self.fail("expected a name")
        self.i += 1
        return tok[1]

    def here(self) -> int:
        return self.toks[self.i][2]

    def last(self) -> int:
        return self.toks[self.i - 1][3]

    def tree(self) -> None:
        """One balanced token tree."""
        if self.kind == "eof":
            self.fail("unexpected end")
        if self.t in (")", "]", "}"):
            self.fail("unbalanced")
        close = CLOSE.get(self.t)
        self.i += 1
        if close:
            while self.t != close:
                self.tree()
            self.i += 1

    def delimited(self, open_: str, one, sep: str = ",") -> int:
        """``open_ one (sep one)* sep? close``; returns how many."""
        self.need(open_)
        n = 0
        while not self.eat(CLOSE[open_]):
            one()
            n += 1
            if not self.eat(sep):
                self.need(CLOSE[open_])
                break
        return n

    # -- items -----------------------------------------------------------------------------------
    def file(self) -> list[Item]:
        while self.t == "#" and self.ahead() == "!":
            self.i += 2
            self.tree()
        out = []
        while self.kind != "eof":
            out.append(self.item())
        return out

    def attributes(self, inner: bool = False) -> list[tuple[int, int]]:
        spans = []
        while self.t == "#":
            at = self.here()
            self.i += 1
            if inner:
                self.eat("!")
            if self.t != "[":
                self.fail("expected an attribute")
            self.tree()
            spans.append((at, self.last()))
        return spans

    def visibility(self) -> str:
        if self.t != "pub":
            return ""
        at = self.here()
        self.i += 1
        if self.t == "(" and self.ahead() in ("crate", "self", "super", "in"):
            self.tree()
        return self.text[at : self.last()]

    def item(self, inside: str = "") -> Item:
        attrs = self.attributes()
        start = self.here()
        vis = self.visibility()
        return self.item_rest(attrs, start, vis, inside)

    def item_rest(self, attrs, start, vis, inside) -> Item:
        t = self.t
        words = []
        save = self.i
        while self.t in ("const", "async", "unsafe", "extern", "default", "safe") and not (self.t == "const" and self.ahead() not in ("fn", "async", "unsafe", "extern")):
            if self.t == "default" and self.ahead() not in ("fn", "const", "async", "unsafe", "impl", "type", "extern"):
                break
            words.append(self.t)
            self.i += 1
            if words[-1] == "extern" and self.kind == "str":
                self.i += 1
        item = Item("", "", start, vis=vis, words=tuple(words), attrs=attrs)
        if self.eat("fn"):
            self.fn_rest(item)
        elif self.t == "{" and "extern" in words:
            item.kind = "extern"
            self.i += 1
            while not self.eat("}"):
                item.children.append(self.item("extern"))
        elif self.t == "trait" or self.t == "auto" and self.ahead() == "trait":
            self.eat("auto")
            self.i += 1
            item.kind, item.name = "trait", self.ident()
            self.generics(item)
            at = self.here()
            if self.eat(":"):
                self.bounds()
                item.trait = (at, self.last())
            if self.eat("="):
                self.bounds()
                self.where(item)
                self.need(";")
            else:
                self.where(item)
                item.head = (start, self.last())
                self.members(item, "trait")
        elif self.t == "impl":
            self.i += 1
            item.kind = "impl"
            if self.t == "<" and self.ahead() in (">", "#") or self.t == "<" and (self.toks[self.i + 1][0] in ("life", "id")) and self.generic_ahead():
                self.generics(item)
            self.eat("const")
            self.eat("!")
            at = self.here()
            self.type()
            if self.eat("for"):
                item.trait = (at, self.toks[self.i - 2][3])
                at = self.here()
                self.type()
            item.target = (at, self.last())
            self.where(item)
            item.head = (start, self.last())
            self.members(item, "impl")
        elif self.t == "mod":
            self.i += 1
            item.kind, item.name = "mod", self.ident()
            if not self.eat(";"):
                self.need("{")
                item.has_body = True
                while self.t == "#" and self.ahead() == "!":
                    self.i += 2
                    self.tree()
                while not self.eat("}"):
                    item.children.append(self.item())
        elif "extern" in words and self.t == "crate":
            self.i += 1
            item.kind, item.name = "use", self.toks[self.i][1]
            self.i += 1
            if self.eat("as"):
                self.i += 1
            self.need(";")
        else:
            if words and not (words == ["default"]):
                self.i = save
                if self.t not in ("const",):
                    self.fail("expected an item")
            t = self.t
            if t in ("struct", "union") and self.toks[self.i + 1][0] == "id" and self.ahead() not in KEYWORDS:
                self.i += 1
                item.kind, item.name = "struct", self.ident()
                self.generics(item)
                self.where(item)
                item.head = (start, self.last())
                if self.t == "{":
                    self.delimited("{", self.field)
                elif self.t == "(":
                    self.delimited("(", self.tuple_field)
                    self.where(item)
                    self.need(";")
                else:
                    self.need(";")
            elif t == "enum":
                self.i += 1
                item.kind, item.name = "enum", self.ident()
                self.generics(item)
                self.where(item)
                item.head = (start, self.last())
                self.delimited("{", lambda: item.names.append(self.variant()))
            elif t == "type":
                self.i += 1
                item.kind, item.name = "type", self.ident()
                self.generics(item)
                if self.eat(":"):
                    self.bounds()
                self.where(item)
                if self.eat("="):
                    at = self.here()
                    self.type()
                    item.value = (at, self.last())
                    self.where(item)
                elif not inside:
                    self.fail("expected '='")
                self.need(";")
            elif t in ("const", "static"):
                self.i += 1
                item.kind = t
                if self.eat("mut"):
                    item.words = ("mut",)
                    if t == "const":
                        self.fail("const mut")
                if t == "const" and self.eat("_"):
                    item.name = "_"
                else:
                    item.name = self.ident()
                self.need(":")
                at = self.here()
                self.type()
                item.value = (at, self.last())
                if self.eat("="):
                    self.expr()
                elif not inside:
                    self.fail("expected '='")
                self.need(";")
            elif t == "use":
                self.i += 1
                item.kind = "use"
                self.use_tree()
                self.need(";")
            elif t == "macro_rules" and self.ahead() == "!":
                self.i += 2
                item.kind, item.name = "macro", self.ident()
                brace = self.t == "{"
                if self.t not in CLOSE:
                    self.fail("expected macro rules")
                self.tree()
                if not brace:
                    self.need(";")
            elif self.kind == "id" and (t not in KEYWORDS or t in PATH_WORDS) or t == "::":
                item.kind = "call"
                self.eat("::")
                while True:
                    if self.t not in PATH_WORDS:
                        self.ident()
                    else:
                        self.i += 1
                    if not self.eat("::"):
                        break
                self.need("!")
                if vis or self.t not in CLOSE:
                    self.fail("expected a macro call")
                brace = self.t == "{"
                self.tree()
                if not brace:
                    self.need(";")
            else:
                self.fail("expected an item")
        item.end = self.last()
        if item.head == (0, 0):
            item.head = (start, item.end)
        return item

    def generic_ahead(self) -> bool:
        """After ``impl``: is ``<`` a parameter list rather than a qualified path?"""
        nxt = self.toks[self.i + 2][1]
        return self.toks[self.i + 1][0] == "life" or self.ahead() == "const" or nxt in (",", ">", ":", "=", ">>")

    def members(self, item: Item, inside: str) -> None:
        self.need("{")
        item.has_body = True
        while self.t == "#" and self.ahead() == "!":
            self.i += 2
            self.tree()
        while not self.eat("}"):
            child = self.item(inside)
            if child.kind not in ("fn", "const", "type", "call"):
                self.fail("not allowed here")
            item.children.append(child)

    def fn_rest(self, item: Item) -> None:
        item.kind, item.name = "fn", self.ident()
        self.generics(item)
        at = self.here()
        self.delimited("(", self.param)
        item.params = (at, self.last())
        if self.eat("->"):
            at = self.here()
            self.type()
            item.ret = (at, self.last())
        self.where(item)
        item.head = (item.start, self.last())
        if not self.eat(";"):
            item.has_body = True
            self.block()

    def param(self) -> None:
        self.attributes()
        if self.t == "...":
            self.i += 1
            return
        save = self.i
        if self.eat("&"):
            if self.kind == "life":
                self.i += 1
        self.eat("mut")
        if self.eat("self"):
            if self.eat(":"):
                self.type()
            return
        self.i = save
        self.pattern_one()
        self.need(":")
        if not self.eat("..."):
            self.type()

    def generics(self, item: Item | None = None) -> None:
        if self.t != "<":
            return
        at = self.here()
        self.i += 1
        while not self.eat_split(">"):
            self.attributes()
            if self.kind == "life":
                self.i += 1
                if self.eat(":"):
                    while self.kind == "life":
                        self.i += 1
                        if not self.eat("+"):
                            break
            elif self.eat("const"):
                self.ident()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.generic_value()
            else:
                self.ident()
                if self.eat(":") and self.t not in (",", ">", "=", ">>"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not self.eat(","):
                if not self.eat_split(">"):
                    self.fail("expected '>'")
                break
        if item is not None:
            item.generics = (at, self.last())

    def where(self, item: Item) -> None:
        if self.t != "where":
            return
        at = self.here()
        self.i += 1
        while self.t not in ("{", ";", "=", ""):
            if self.kind == "life":
                self.i += 1
                self.need(":")
            else:
                self.for_lifetimes()
                self.type()
                self.need(":")
            if self.t not in (",", "{", ";"):
                self.bounds()
            if not self.eat(","):
                break
        while self.kind == "life":
            self.i += 1
            self.need(":")
            self.bounds()
            if not self.eat(","):
                break
        item.where = (at, self.last())

    def for_lifetimes(self) -> None:
        if self.t == "for" and self.ahead() == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.kind == "life":
                self.i += 1
            elif self.t in ("(", "?", "for", "::", "~", "<", "use", "const", "async") or self.kind == "id":
                paren = self.eat("(")
                if self.eat("~"):
                    self.need("const")
                if self.t == "use" and self.ahead() == "<":
                    self.i += 1
                    self.generic_args()
                else:
                    self.eat("const")
                    self.eat("async")
                    self.eat("?")
                    self.for_lifetimes()
                    self.type_path()
                if paren:
                    self.need(")")
            else:
                break
            if not self.eat("+"):
                break

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.ident()
        self.need(":")
        self.type()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def variant(self) -> str:
        self.attributes()
        self.visibility()
        name = self.ident()
        if self.t == "{":
            self.delimited("{", self.field)
        elif self.t == "(":
            self.delimited("(", self.tuple_field)
        if self.eat("="):
            self.expr()
        return name

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.t == "{":
                self.delimited("{", self.use_tree)
                return
            if self.t in PATH_WORDS:
                self.i += 1
            else:
                self.ident()
            if not self.eat("::"):
                break
        if self.eat("as") and not self.eat("_"):
            self.ident()

    # -- types -----------------------------------------------------------------------------------
    def type(self) -> None:
        t = self.t
        if t == "(":
            self.delimited("(", self.type)
        elif t == "!":
            self.i += 1
        elif t in ("&", "&&"):
            self.i += 1
            if self.kind == "life":
                self.i += 1
            self.eat("mut")
            self.type_no_bounds()
        elif t == "*":
            self.i += 1
            if not (self.eat("const") or self.eat("mut")):
                self.fail("expected const or mut")
            self.type_no_bounds()
        elif t == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                self.expr()
            self.need("]")
        elif t == "_":
            self.i += 1
        elif t in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif t in ("fn", "unsafe", "extern") or t == "for":
            self.for_lifetimes()
            if self.t in ("fn", "unsafe", "extern"):
                self.eat("unsafe")
                if self.eat("extern") and self.kind == "str":
                    self.i += 1
                self.need("fn")
                self.delimited("(", self.fn_type_param)
                if self.eat("->"):
                    self.type_no_bounds()
            else:
                self.type_path()
        else:
            self.type_path()
            if self.t == "!" and self.ahead() in CLOSE:
                self.i += 1
                self.tree()
            elif self.t == "+" and False:
                self.bounds()

    type_no_bounds = type

    def fn_type_param(self) -> None:
        self.attributes()
        if self.eat("..."):
            return
        if self.kind == "id" and self.ahead() == ":" :
            self.i += 2
        self.type()

    def type_path(self) -> None:
        if self.eat_split("<"):
            self.type()
            if self.eat("as"):
                self.type_path()
            if not self.eat_split(">"):
                self.fail("expected '>'")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if self.t in PATH_WORDS:
                self.i += 1
            else:
                self.ident()
            if self.t == "<" or self.t == "<<" or self.t == "::" and self.ahead() in ("<", "<<"):
                self.eat("::")
                self.generic_args()
            elif self.t == "(" :
                self.delimited("(", self.type)
                if self.eat("->"):
                    self.type()
            if not (self.t == "::" and self.toks[self.i + 1][0] == "id"):
                break
            self.i += 1

    def generic_value(self) -> None:
        if self.t == "{":
            self.block()
        elif self.kind in ("num", "str", "char") or self.t in ("true", "false"):
            self.i += 1
        elif self.t == "-" and self.toks[self.i + 1][0] == "num":
            self.i += 2
        else:
            self.type()

    def generic_args(self) -> None:
        if not self.eat_split("<"):
            self.fail("expected '<'")
        while not self.eat_split(">"):
            if self.kind == "life":
                self.i += 1
            else:
                self.generic_value()
                if self.eat("="):
                    self.generic_value()
                elif self.eat(":"):
                    self.bounds()
            if not self.eat(","):
                if not self.eat_split(">"):
                    self.fail("expected '>'")
                break

    # -- patterns --------------------------------------------------------------------------------
    def pattern(self) -> None:
        self.eat("|")
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        t, k = self.t, self.kind
        if t in ("&", "&&"):
            self.i += 1
            self.eat("mut")
            self.pattern_one()
        elif t == "(":
            self.delimited("(", self.pattern)
        elif t == "[":
            self.delimited("[", self.pattern)
        elif t in ("_",):
            self.i += 1
        elif t in ("..", "..="):
            self.i += 1
            if k == "op" and (self.kind in ("num", "char", "str") or self.t == "-"):
                self.literal_pattern()
        elif k in ("num", "char", "str") or t in ("-", "true", "false"):
            self.literal_pattern()
            self.range_end()
        elif t in ("ref", "mut"):
            self.eat("ref")
            self.eat("mut")
            self.ident()
            if self.eat("@"):
                self.pattern_one()
        elif t == "const" and self.ahead() == "{":
            self.i += 1
            self.block()
        elif t == "box":
            self.i += 1
            self.pattern_one()
        elif k == "id" or t in ("::", "<"):
            simple = k == "id" and t not in PATH_WORDS
            self.expr_path()
            if self.t == "!" and self.ahead() in CLOSE:
                self.i += 1
                self.tree()
            elif self.t == "(":
                self.delimited("(", self.pattern)
            elif self.t == "{":
                self.delimited("{", self.field_pattern)
            elif simple and self.eat("@"):
                self.pattern_one()
            else:
                self.range_end()
        else:
            self.fail("expected a pattern")

    def range_end(self) -> None:
        if self.t in ("..=", "..", "..."):
            self.i += 1
            if self.kind in ("num", "char", "str") or self.t == "-":
                self.literal_pattern()
            elif self.kind == "id" and self.t not in ("if",):
                self.expr_path()

    def literal_pattern(self) -> None:
        self.eat("-")
        if self.kind in ("num", "char", "str") or self.t in ("true", "false"):
            self.i += 1
        else:
            self.fail("expected a literal")

    def field_pattern(self) -> None:
        self.attributes()
        if self.eat(".."):
            return
        if self.kind in ("id", "num") and self.ahead() == ":":
            self.i += 2
            self.pattern()
            return
        self.eat("box")
        self.eat("ref")
        self.eat("mut")
        self.ident()
        if self.eat("@"):
            self.pattern_one()

    # -- expressions -----------------------------------------------------------------------------
    def block(self) -> None:
        self.need("{")
        while self.t == "#" and self.ahead() == "!":
            self.i += 2
            self.tree()
        while not self.eat("}"):
            self.statement()

    def statement(self) -> None:
        if self.eat(";"):
            return
        self.attributes()
        t = self.t
        if t == "let":
            self.i += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
                if self.eat("else"):
                    self.block()
            self.need(";")
            return
        if self.item_ahead():
            self.item()
            return
        if t == "macro_rules" and self.ahead() == "!" and self.toks[self.i + 2][0] == "id":
            self.item()
            return
        block_like = self.block_like_ahead()
        if block_like:
            self.primary(True)
            if self.t in (".", "?") :
                self.postfix_rest()
                self.binary_rest(0, True)
            elif self.t == "as" :
                self.binary_rest(0, True)
            else:
                self.eat(";")
                return
        else:
            self.expr()
            prev = self.toks[self.i - 1]
            if self.t not in (";", "}") and prev[1] == "}" and self.macro_stmt:
                return
        if not self.eat(";") and self.t != "}":
            self.fail("expected ';'")

    macro_stmt = False

    def item_ahead(self) -> bool:
        t, n = self.t, self.ahead()
        if t in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "type", "static", "pub"):
            return True
        if t == "const":
            return n not in ("{", "|", "||", "move", "async") or n == "async" and self.ahead(2) == "fn"
        if t == "unsafe":
            return n in ("fn", "impl", "trait", "extern")
        if t == "async":
            return n == "fn" or n == "unsafe"
        if t == "extern":
            return True
        return t == "union" and self.toks[self.i + 1][0] == "id" and self.ahead(2) in ("{", "<")

    def block_like_ahead(self) -> bool:
        t, n = self.t, self.ahead()
        if self.kind == "life":
            return n == ":"
        return t in ("{", "if", "match", "while", "loop", "for") or t in ("unsafe", "const") and n == "{" or t == "async" and (n == "{" or n == "move" and self.ahead(2) == "{")

    def expr(self, least: int = 0, struct: bool = True) -> None:
        self.attributes()
        t = self.t
        self.macro_stmt = False
        if t in ("..", "..="):
            self.i += 1
            if self.starts_expr(struct):
                self.expr(3, struct)
        else:
            self.unary(struct)
        self.binary_rest(least, struct)

    def starts_expr(self, struct: bool) -> bool:
        t, k = self.t, self.kind
        if k in ("num", "str", "char", "life"):
            return True
        if k == "id":
            return t not in KEYWORDS or t in PATH_WORDS or t in ("true", "false", "if", "match", "loop", "while", "for", "unsafe", "move", "return", "break", "continue", "async", "const")
        if t == "{":
            return struct
        return t in ("(", "[", "&", "&&", "*", "-", "!", "|", "||", "<", "::")

    def binary_rest(self, least: int, struct: bool) -> None:
        compared = False
        while True:
            t = self.t
            if t == "as":
                self.i += 1
                self.type()
                continue
            p = BINARY.get(t) if self.kind == "op" else None
            if p is None or p < least:
                return
            if p == 5:
                if compared:
                    self.fail("comparison cannot be chained")
                compared = True
            elif p < 5:
                compared = False
            self.i += 1
            if p == 1:
                self.expr(1, struct)
            elif p == 2:
                if self.starts_expr(struct):
                    self.expr(3, struct)
                elif t == "..=":
                    self.fail("range without end")
            else:
                self.expr(p + 1, struct)

    def unary(self, struct: bool) -> None:
        t = self.t
        if t in ("-", "!", "*"):
            self.i += 1
            self.unary(struct)
        elif t in ("&", "&&"):
            self.i += 1
            if self.t == "raw" and self.ahead() in ("const", "mut"):
                self.i += 2
            else:
                self.eat("mut")
            self.unary(struct)
        else:
            self.primary(struct)
            self.postfix_rest()

    def postfix_rest(self) -> None:
        while True:
            t = self.t
            if t == "?":
                self.i += 1
            elif t == "(":
                self.delimited("(", self.expr)
            elif t == "[":
                self.i += 1
                self.expr()
                self.need("]")
            elif t == ".":
                self.i += 1
                if self.eat("await"):
                    continue
                if self.kind == "num":
                    self.i += 1
                    continue
                self.ident()
                if self.t == "::":
                    self.i += 1
                    self.generic_args()
                    if self.t != "(":
                        self.fail("expected arguments")
            else:
                return

    def condition(self) -> None:
        self.expr(0, False)

    def primary(self, struct: bool) -> None:
        t, k = self.t, self.kind
        if k in ("num", "str", "char"):
            self.i += 1
        elif k == "life":
            self.i += 1
            self.need(":")
            if self.t not in ("{", "loop", "while", "for"):
                self.fail("expected a loop")
            self.primary(struct)
        elif t in ("true", "false"):
            self.i += 1
        elif t == "(":
            self.delimited("(", self.expr)
        elif t == "[":
            self.i += 1
            if not self.eat("]"):
                self.expr()
                if self.eat(";"):
                    self.expr()
                    self.need("]")
                else:
                    while self.eat(","):
                        if self.t == "]":
                            break
                        self.expr()
                    self.need("]")
        elif t == "{":
            self.block()
        elif t == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.eat("else"):
                if self.t == "if":
                    self.primary(struct)
                else:
                    self.block()
        elif t == "match":
            self.i += 1
            self.condition()
            self.need("{")
            while self.t == "#" and self.ahead() == "!":
                self.i += 2
                self.tree()
            while not self.eat("}"):
                self.attributes()
                self.pattern()
                if self.eat("if"):
                    self.expr()
                self.need("=>")
                block = self.t == "{"
                self.expr()
                if not self.eat(",") and self.t != "}" and not (block and self.toks[self.i - 1][1] == "}"):
                    self.fail("expected ','")
        elif t == "while":
            self.i += 1
            self.condition()
            self.block()
        elif t == "loop":
            self.i += 1
            self.block()
        elif t == "for":
            if self.ahead() == "<":
                self.for_lifetimes()
                self.primary(struct)
                return
            self.i += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.block()
        elif t == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            self.expr(5, False)
        elif t in ("unsafe", "const") and self.ahead() == "{":
            self.i += 1
            self.block()
        elif t in ("async", "move", "static", "|", "||"):
            if self.eat("async"):
                self.eat("move")
                if self.t == "{":
                    self.block()
                    return
            self.eat("static")
            self.eat("move")
            if not self.eat("||"):
                self.need("|")
                while not self.eat("|"):
                    self.attributes()
                    self.pattern_one()
                    if self.eat(":"):
                        self.type()
                    if not self.eat(","):
                        self.need("|")
                        break
            if self.eat("->"):
                self.type()
                self.block()
            else:
                self.expr(1, struct)
        elif t in ("return", "break"):
            self.i += 1
            if t == "break" and self.kind == "life" and self.ahead() != ":":
                self.i += 1
            if self.starts_expr(struct):
                self.expr(0, struct)
        elif t == "continue":
            self.i += 1
            if self.kind == "life":
                self.i += 1
        elif k == "id" and (t not in KEYWORDS or t in PATH_WORDS) or t in ("::", "<"):
            self.expr_path()
            if self.t == "!" and self.ahead() in CLOSE:
                self.i += 1
                brace = self.t == "{"
                self.tree()
                self.macro_stmt = brace
            elif self.t == "{" and struct:
                self.delimited("{", self.field_value)
        else:
            self.fail("expected an expression")

    def field_value(self) -> None:
        self.attributes()
        if self.eat(".."):
            if self.t != "}":
                self.expr()
            return
        if self.kind == "num":
            self.i += 1
            self.need(":")
            self.expr()
            return
        self.ident()
        if self.eat(":"):
            self.expr()

    def expr_path(self) -> None:
        if self.t == "<":
            self.i += 1
            self.type()
            if self.eat("as"):
                self.type_path()
            if not self.eat_split(">"):
                self.fail("expected '>'")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if self.t in PATH_WORDS:
                self.i += 1
            else:
                self.ident()
            if self.t != "::":
                return
            self.i += 1
            if self.t in ("<", "<<"):
                self.generic_args()
                if not self.eat("::"):
                    return


#: words that may begin an item
STARTS = frozenset("pub fn struct enum trait impl mod const static type use extern unsafe async macro_rules union #".split())


class Tolerant(Parser):
    """Items of a file with errors: bodies are passed over by their braces, and what fails up to the next item."""

    def next_start(self, at: int, column: int | None = None) -> int:
        """The next token that begins a line and may begin an item, no further right than ``column``."""
        for i in range(at, len(self.toks)):
            kind, word, start, _ = self.toks[i]
            line = self.text.rfind("\n", 0, start) + 1
            if kind == "eof" or word in STARTS and not self.text[line:start].strip() and (column is None or start - line <= column):
                return i
        return len(self.toks) - 1

    def column(self, i: int) -> int:
        line = self.text.rfind("\n", 0, self.toks[i][2]) + 1
        return len(self.text[line:]) - len(self.text[line:].lstrip(" \t"))

    def block(self) -> None:
        at, depth = self.i, 0
        self.need("{")
        self.i = at
        while self.kind != "eof":
            depth += (self.t == "{") - (self.t == "}")
            self.i += 1
            if not depth:
                return
        self.i = self.next_start(at + 1, self.column(at))  # never closed: it ends where an item stands as far left

    def some_items(self, out: list[Item], inside: str = "") -> None:
        """One item, or what has to be passed over to reach the next."""
        at = self.i
        try:
            out.append(self.item(inside))
        except (SyntaxError, IndexError):
            self.i = at + 1
            while self.kind != "eof" and self.t != "}" and self.next_start(self.i) != self.i:
                if self.t == "{":
                    self.block()
                else:
                    self.i += 1

    def members(self, item: Item, inside: str) -> None:
        self.need("{")
        item.has_body = True
        while self.kind != "eof" and not self.eat("}"):
            self.some_items(item.children, inside)

    def file(self) -> list[Item]:
        out: list[Item] = []
        while self.kind != "eof":
            self.some_items(out)
            while self.eat("}"):
                pass
        return out


def parse(text: str, recover: bool = False) -> list[Item]:
    """Items of a Rust file.  Raises ``SyntaxError`` where the file is not valid, unless it shall ``recover``; nesting may be of any depth."""
    with deep_recursion(len(text)):
        try:
            return (Tolerant(text, True) if recover else Parser(text)).file()
        except IndexError as exc:
            raise SyntaxError(str(exc)) from exc
