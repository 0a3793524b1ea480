"""PHP 8 syntax: a tokenizer with inline HTML, heredocs and interpolation, and a recursive-descent parser.

``parse(text)`` returns the top-level :class:`Item` list or raises ``SyntaxError``.  Text outside PHP
tags is always valid.  Only syntax is judged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .deep import deep_recursion

OPEN_TAG = re.compile(r"<\?(?:php(?=\s|$)|=)", re.I)
NAME = r"[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*"
TOKEN = re.compile(
    rf"""
    (?P<ws>\s+)
  | (?P<attr>\#\[)
  | (?P<line>(?://|\#)(?:(?!\?>)[^\r\n])*)
  | (?P<block>/\*.*?\*/)
  | (?P<badblock>/\*)
  | (?P<close>\?>\n?)
  | (?P<var>\$+(?={NAME}){NAME}|\$+(?=\{{))
  | (?P<heredoc><<<[ \t]*(?P<q>["']?)(?P<tag>{NAME})(?P=q)\r?\n)
  | (?P<sq>b?'(?:[^'\\]|\\.)*')
  | (?P<dq>b?["`])
  | (?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*
       |(?:[0-9]+(?:_[0-9]+)*)?\.[0-9]+(?:_[0-9]+)*(?:[eE][+-]?[0-9]+)?|[0-9]+(?:_[0-9]+)*\.?(?:[eE][+-]?[0-9]+)?)
  | (?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)[ \t]*\))
  | (?P<id>\\?{NAME}(?:\\{NAME})*)
  | (?P<op>\?\?=|\.\.\.|<=>|\*\*=|===|!==|<<=|>>=|\?->|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=
       |\.=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!.,;:?&|^~@(){{}}\[\]\\$])
    """,
    re.X | re.S | re.I,
)
RESERVED = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty "
    "enddeclare endfor endforeach endif endswitch endwhile exit eval extends final finally fn for foreach function global "
    "goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private "
    "protected public require require_once return static switch throw trait try unset use var while xor yield die "
    "__halt_compiler readonly".split()
)
MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
#: binary operators: (how tightly, right associative)
BINARY = {
    "**": (20, 1), "instanceof": (18, 0), "*": (16, 0), "/": (16, 0), "%": (16, 0), "+": (15, 0), "-": (15, 0),
    "<<": (14, 0), ">>": (14, 0), ".": (13, 0), "<": (12, 0), "<=": (12, 0), ">": (12, 0), ">=": (12, 0),
    "==": (11, 0), "!=": (11, 0), "===": (11, 0), "!==": (11, 0), "<>": (11, 0), "<=>": (11, 0),
    "&": (10, 0), "^": (9, 0), "|": (8, 0), "&&": (7, 0), "||": (6, 0), "??": (5, 1), "?": (4, 0),
    "=": (3, 1), "+=": (3, 1), "-=": (3, 1), "*=": (3, 1), "/=": (3, 1), ".=": (3, 1), "%=": (3, 1), "**=": (3, 1),
    "&=": (3, 1), "|=": (3, 1), "^=": (3, 1), "<<=": (3, 1), ">>=": (3, 1), "??=": (3, 1),
    "and": (2, 0), "xor": (1, 0), "or": (0, 0),
}


@dataclass
class Item:
    """A function, method, class, interface, trait, enum or constant with offsets into the text."""

    kind: str
    name: str
    start: int
    end: int = 0
    params: tuple[int, int] | None = None
    ret: tuple[int, int] | None = None
    extends: list[tuple[int, int]] = field(default_factory=list)
    implements: list[tuple[int, int]] = field(default_factory=list)
    modifiers: tuple[str, ...] = ()
    children: list["Item"] = field(default_factory=list)


def has_code(text: str) -> bool:
    """Is there any PHP tag?"""
    return OPEN_TAG.search(text) is not None


def _end_of_quoted(text: str, at: int, quote: str) -> int:
    """Offset after the closing ``quote``, honouring escapes and ``{$...}`` parts."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == quote:
            return at + 1
        elif c == "{" and text[at + 1 : at + 2] == "$" or c == "$" and text[at + 1 : at + 2] == "{":
            at = _end_of_braced(text, at + 1 if c == "{" else at + 2)
        else:
            at += 1
    raise SyntaxError("string never ends")


def _end_of_braced(text: str, at: int) -> int:
    depth, n = 1, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unknown character at {at}")
        kind, end = m.lastgroup, m.end()
        if kind == "dq":
            end = _end_of_quoted(text, end, text[end - 1])
        elif kind == "op" and m.group() in "{}":
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return end
        at = end
    raise SyntaxError("braces in a string never end")


def _token(text: str, pos: int) -> tuple[str, int]:
    """Kind and end of the token at ``pos``."""
    m = TOKEN.match(text, pos)
    if not m:
        raise SyntaxError(f"unknown character at {pos}")
    kind, end = m.lastgroup, m.end()
    if kind in ("q", "tag") or m.group("heredoc") is not None:
        tag = m.group("tag")
        stop = re.compile(rf"(?:^|(?<=\n))[ \t]*{re.escape(tag)}(?![\w\x80-\U0010ffff])").search(text, end)
        if not stop:
            raise SyntaxError("heredoc never ends")
        if m.group("q") != "'":
            at = end
            while (at := text.find("{$", at, stop.start())) >= 0:
                at = _end_of_braced(text, at + 1)
        kind, end = "str", stop.end()
    elif kind == "dq":
        kind, end = "str", _end_of_quoted(text, end, text[end - 1])
    elif kind == "sq":
        kind = "str"
    elif kind == "badblock":
        raise SyntaxError("comment never ends")
    return kind, end


def tokenize(text: str, recover: bool = False) -> list[tuple]:
    """``(kind, text, start, end)``; inline HTML becomes one ``;``, ``?>`` likewise.  ``recover`` passes over what is no token."""
    out, pos, n = [], 0, len(text)
    if text.startswith("#!"):
        pos = (text.find("\n") + 1) or n
    while pos < n:
        m = OPEN_TAG.search(text, pos)
        if not m:
            return out
        if m.start() > pos:
            out.append(("html", ";", pos, m.start()))
        pos = m.end()
        if m.group().endswith("="):
            out.append(("id", "echo", m.start(), pos))
        while pos < n:
            try:
                kind, end = _token(text, pos)
            except SyntaxError:
                if not recover:
                    raise
                pos += 1
                continue
            if kind == "close":
                out.append(("op", ";", pos, end))
                pos = end
                break
            if kind not in ("ws", "line", "block"):
                word = text[pos:end]
                out.append((kind, word.lower() if kind == "id" and word.lower() in RESERVED else word, pos, end))
            pos = end
    return out


class Parser:
    def __init__(self, text: str, recover: bool = False):
        self.text, self.toks, self.i = text, tokenize(text, recover), 0
        self.toks.append(("eof", "", len(text), len(text)))
        self.toks.append(("eof", "", len(text), len(text)))

    @property
    def t(self) -> str:
        tok = self.toks[self.i]
        return tok[1] if tok[0] in ("op", "attr", "html") or tok[0] == "id" else ""

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    def ahead(self, k: int = 1) -> str:
        return self.toks[min(self.i + k, len(self.toks) - 1)][1]

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

    def here(self) -> int:
        return self.toks[self.i][2]

    def last(self) -> int:
        return self.toks[self.i - 1][3]

    def name(self, reserved: bool = False, qualified: bool = False) -> str:
        kind, word, *_ = self.toks[self.i]
        if kind != "id" or "\\" in word and not qualified or word in RESERVED and not reserved and not (word == "readonly" or word == "enum"):
            self.fail("expected a name")
        self.i += 1
        return word

    # -- files and statements ----------------------------------------------------------------------
    def file(self) -> list[Item]:
        out: list[Item] = []
        while self.kind != "eof":
            if self.t == "__halt_compiler":
                break
            self.statement(out, top=True)
        return out

    def attributes(self) -> None:
        while self.kind == "attr":
            self.i += 1
            while True:
                self.name(qualified=True)
                if self.t == "(":
                    self.arguments()
                if not self.eat(",") or self.t == "]":
                    break
            self.need("]")

    def semicolon(self) -> None:
        if not self.eat(";"):
            self.fail("expected ';'")

    def block(self) -> None:
        self.need("{")
        sink: list[Item] = []
        while not self.eat("}"):
            if self.kind == "eof":
                self.fail("unexpected end")
            self.statement(sink)

    def body(self, *ends: str) -> None:
        """A statement, or the ``:`` form up to one of ``ends``."""
        sink: list[Item] = []
        if ends and self.eat(":"):
            while self.t not in ends:
                if self.kind == "eof":
                    self.fail("unexpected end")
                self.statement(sink)
            return
        self.statement(sink)

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def statement(self, out: list[Item], top: bool = False) -> None:
        kind, t = self.kind, self.t
        if kind == "html":
            self.i += 1
            return
        if kind == "attr":
            save = self.i
            self.attributes()
            if self.declaration(out, self.here()):
                return
            self.i = save
            self.expr()
            self.semicolon()
            return
        if t == ";":
            self.i += 1
        elif t == "{":
            self.block()
        elif kind == "id":
            if not self.declaration(out, self.here()) and not self.keyword(out, t, top):
                self.expr_statement()
        else:
            self.expr_statement()

    def expr_statement(self) -> None:
        self.expr()
        self.semicolon()

    def declaration(self, out: list[Item], start: int) -> bool:
        t = self.t
        if t == "function" and (self.toks[self.i + 1][0] == "id" or self.ahead() == "&" and self.toks[self.i + 2][0] == "id"):
            self.i += 1
            self.eat("&")
            item = Item("function", self.name(), start)
            self.signature(item)
            self.block()
        elif t in ("abstract", "final", "readonly", "class") and self.class_ahead():
            words = []
            while self.t in ("abstract", "final", "readonly"):
                words.append(self.t)
                self.i += 1
            self.need("class")
            item = Item("class", self.name(), start, modifiers=tuple(words))
            self.class_rest(item)
        elif t == "interface":
            self.i += 1
            item = Item("interface", self.name(), start)
            if self.eat("extends"):
                self.names(item.extends)
            self.members(item)
        elif t == "trait":
            self.i += 1
            item = Item("trait", self.name(), start)
            self.members(item)
        elif t.lower() == "enum" and self.toks[self.i + 1][0] == "id" and self.ahead() not in ("extends", "implements"):
            self.i += 1
            item = Item("enum", self.name(), start)
            if self.eat(":"):
                self.type()
            if self.eat("implements"):
                self.names(item.implements)
            self.members(item)
        else:
            return False
        item.end = self.last()
        out.append(item)
        return True

    def class_ahead(self) -> bool:
        k = 0
        while self.ahead(k) in ("abstract", "final", "readonly"):
            k += 1
        return self.ahead(k) == "class"

    def class_rest(self, item: Item) -> None:
        if self.eat("extends"):
            at = self.here()
            self.name(qualified=True)
            item.extends.append((at, self.last()))
        if self.eat("implements"):
            self.names(item.implements)
        self.members(item)

    def names(self, spans: list) -> None:
        while True:
            at = self.here()
            self.name(qualified=True)
            spans.append((at, self.last()))
            if not self.eat(","):
                break

    def signature(self, item: Item | None = None) -> None:
        at = self.here()
        self.parameters()
        if item is not None:
            item.params = (at, self.last())
        if self.t == "use" and item is None:
            self.i += 1
            self.need("(")
            while not self.eat(")"):
                self.eat("&")
                if self.kind != "var":
                    self.fail("expected a variable")
                self.i += 1
                if not self.eat(","):
                    self.need(")")
                    break
        if self.eat(":"):
            at = self.here()
            self.type()
            if item is not None:
                item.ret = (at, self.last())

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.attributes()
            while self.t in ("public", "protected", "private", "readonly", "final"):
                self.i += 1
            if self.kind != "var" and self.t not in ("&", "..."):
                self.type()
            self.eat("&")
            self.eat("...")
            if self.kind != "var":
                self.fail("expected a variable")
            self.i += 1
            if self.eat("="):
                self.expr()
            if self.t == "{":
                self.hooks()
            if not self.eat(","):
                self.need(")")
                break

    def type(self) -> None:
        if self.eat("?"):
            self.type_name()
            return
        while True:
            if self.eat("("):
                self.type_name()
                while self.t == "&":
                    self.i += 1
                    self.type_name()
                self.need(")")
            else:
                self.type_name()
            if self.t == "|" or self.t == "&" and self.toks[self.i + 1][0] == "id" or self.t == "&" and self.ahead() == "(":
                self.i += 1
                continue
            return

    def type_name(self) -> None:
        if self.t in ("array", "callable", "static"):
            self.i += 1
        else:
            self.name(qualified=True)

    def members(self, item: Item) -> None:
        self.need("{")
        while not self.eat("}"):
            self.member(item)

    def member(self, item: Item) -> None:
        self.attributes()
        start = self.here()
        t = self.t
        if t == "use":
            self.i += 1
            self.names([])
            if self.t == "{":
                self.i += 1
                while not self.eat("}"):
                    self.name(qualified=True)
                    if self.eat("::"):
                        self.name(reserved=True)
                    if self.eat("insteadof"):
                        self.names([])
                    else:
                        self.need("as")
                        if self.t in ("public", "protected", "private"):
                            self.i += 1
                        if self.t != ";":
                            self.name(reserved=True)
                    self.need(";")
            else:
                self.need(";")
            return
        if t == "case" and item.kind == "enum":
            self.i += 1
            self.name(reserved=True)
            if self.eat("="):
                self.expr()
            self.need(";")
            return
        words = []
        while self.t in MODIFIERS:
            words.append(self.t)
            self.i += 1
            if self.t == "(" and self.ahead() == "set":
                self.i += 2
                self.need(")")
        if self.eat("const"):
            if not (self.toks[self.i + 1][1] == "="):
                self.type()
            while True:
                self.name(reserved=True)
                self.need("=")
                self.expr()
                if not self.eat(","):
                    break
            self.need(";")
        elif self.eat("function"):
            self.eat("&")
            child = Item("method", self.name(reserved=True), start, modifiers=tuple(words))
            self.signature(child)
            if not self.eat(";"):
                self.block()
            child.end = self.last()
            item.children.append(child)
        elif words:
            if self.kind != "var":
                self.type()
            while True:
                if self.kind != "var":
                    self.fail("expected a property")
                self.i += 1
                if self.eat("="):
                    self.expr()
                if self.t == "{":
                    self.hooks()
                    break
                if not self.eat(","):
                    self.need(";")
                    break
        else:
            self.fail("expected a member")

    def hooks(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.attributes()
            while self.t in ("final", "&"):
                self.i += 1
            self.name(reserved=True)
            if self.t == "(":
                self.parameters()
            if self.eat("=>"):
                self.expr()
                self.need(";")
            elif not self.eat(";"):
                self.block()

    def keyword(self, out: list[Item], t: str, top: bool) -> bool:
        if t == "namespace" and self.ahead() not in ("(",) and not self.ahead().startswith("\\"):
            self.i += 1
            if self.t != "{":
                self.name(qualified=True)
            if self.eat("{"):
                while not self.eat("}"):
                    if self.kind == "eof":
                        self.fail("unexpected end")
                    self.statement(out, True)
            else:
                self.semicolon()
        elif t == "use" and top:
            self.i += 1
            if self.t in ("function", "const"):
                self.i += 1
            while True:
                self.name(qualified=True)
                if self.t == "\\" and self.ahead() == "{":
                    self.i += 2
                    while not self.eat("}"):
                        if self.t in ("function", "const"):
                            self.i += 1
                        self.name(qualified=True)
                        if self.eat("as"):
                            self.name()
                        if not self.eat(","):
                            self.need("}")
                            break
                if self.eat("as"):
                    self.name()
                if not self.eat(","):
                    break
            self.semicolon()
        elif t == "const":
            start = self.here()
            self.i += 1
            first = None
            while True:
                at = self.name()
                first = first or at
                self.need("=")
                self.expr()
                if not self.eat(","):
                    break
            self.semicolon()
            out.append(Item("const", first, start, self.last()))
        elif t == "if":
            self.i += 1
            self.paren()
            if self.t == ":":
                self.body("elseif", "else", "endif")
                while True:
                    if self.eat("elseif"):
                        self.paren()
                        self.body("elseif", "else", "endif")
                    elif self.t == "else":
                        self.i += 1
                        if self.eat("if"):
                            self.paren()
                            self.body("elseif", "else", "endif")
                        else:
                            self.body("endif")
                    else:
                        break
                self.need("endif")
                self.semicolon()
            else:
                self.body()
                while self.t in ("elseif", "else"):
                    if self.eat("elseif"):
                        self.paren()
                        self.body()
                    else:
                        self.i += 1
                        self.body()
                        break
        elif t in ("while", "for", "foreach", "switch", "declare"):
            self.i += 1
            if t == "while":
                self.paren()
            elif t == "for":
                self.need("(")
                for end in (";", ";", ")"):
                    while self.t != end:
                        self.expr()
                        if not self.eat(","):
                            break
                    self.need(end)
            elif t == "foreach":
                self.need("(")
                self.expr()
                self.need("as")
                self.target()
                if self.eat("=>"):
                    self.target()
                self.need(")")
            elif t == "switch":
                self.paren()
                alt = self.t == ":"
                if not alt and self.t != "{":
                    self.fail("expected '{'")
                self.i += 1
                close = "endswitch" if alt else "}"
                while self.kind == "html" or self.t == ";" :
                    self.i += 1
                while not self.eat(close):
                    if self.eat("case"):
                        self.expr()
                    else:
                        self.need("default")
                    if not (self.eat(":") or self.eat(";")):
                        self.fail("expected ':'")
                    while self.t not in ("case", "default", close):
                        if self.kind == "eof":
                            self.fail("unexpected end")
                        self.statement([])
                if alt:
                    self.semicolon()
                return True
            else:
                self.need("(")
                while True:
                    self.name()
                    self.need("=")
                    self.expr()
                    if not self.eat(","):
                        break
                self.need(")")
                if self.eat(";"):
                    return True
            end = "end" + t
            alt = self.t == ":"
            self.body(end)
            if alt:
                self.need(end)
                self.semicolon()
        elif t == "do":
            self.i += 1
            self.body()
            self.need("while")
            self.paren()
            self.semicolon()
        elif t == "try":
            self.i += 1
            self.block()
            some = False
            while self.eat("catch"):
                some = True
                self.need("(")
                self.type()
                if self.kind == "var":
                    self.i += 1
                self.need(")")
                self.block()
            if self.eat("finally"):
                some = True
                self.block()
            if not some:
                self.fail("expected catch")
        elif t in ("return", "break", "continue"):
            self.i += 1
            if self.t != ";":
                self.expr()
            self.semicolon()
        elif t in ("echo",):
            self.i += 1
            self.expr_list()
            self.semicolon()
        elif t == "global":
            self.i += 1
            self.expr_list()
            self.semicolon()
        elif t == "static" and self.toks[self.i + 1][0] == "var":
            self.i += 1
            while True:
                if self.kind != "var":
                    self.fail("expected a variable")
                self.i += 1
                if self.eat("="):
                    self.expr()
                if not self.eat(","):
                    break
            self.semicolon()
        elif t == "unset":
            self.i += 1
            self.arguments()
            self.semicolon()
        elif t == "goto":
            self.i += 1
            self.name()
            self.semicolon()
        elif self.ahead() == ":" and t not in RESERVED and self.kind == "id":
            self.i += 2
        else:
            return False
        return True

    def target(self) -> None:
        self.eat("&")
        self.expr()

    def expr_list(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    # -- expressions -------------------------------------------------------------------------------
    def arguments(self) -> None:
        self.need("(")
        if self.t == "..." and self.ahead() == ")":
            self.i += 2
            return
        while not self.eat(")"):
            self.eat("...")
            if self.kind == "id" and self.ahead() == ":" :
                self.i += 2
            self.expr()
            if not self.eat(","):
                self.need(")")
                break

    def expr(self, least: int = 0) -> None:
        self.unary()
        while True:
            t = self.t.lower()
            found = BINARY.get(t)
            if found is None or found[0] < least or self.kind not in ("op", "id"):
                return
            p, right = found
            self.i += 1
            if t == "?":
                if not self.eat(":"):
                    self.expr()
                    self.need(":")
                self.expr(p + 1)
            elif t == "=":
                self.eat("&")
                self.expr(3)
            elif t == "instanceof":
                if self.kind == "id":
                    self.name(reserved=self.t == "static", qualified=True)
                else:
                    self.unary()
            else:
                self.expr(p if right else p + 1)
                if p in (11, 12) and BINARY.get(self.t, (0,))[0] == p and self.kind == "op":
                    self.fail("comparison cannot be chained")

    def unary(self) -> None:
        kind, t = self.kind, self.t
        if kind == "cast" or t in ("!", "-", "+", "~", "@", "++", "--", "&"):
            self.i += 1
            self.expr(3 if t == "&" else 12 if t == "!" and False else 17)
            while t == "!" and BINARY.get(self.t, (0,))[0] == 3 and self.kind == "op":
                self.i += 1
                self.expr(3)
            return
        if t in ("print", "include", "include_once", "require", "require_once"):
            self.i += 1
            self.expr(3)
            return
        if t == "throw":
            self.i += 1
            self.expr()
            return
        if t == "clone":
            self.i += 1
            self.expr(19)
            return
        if t == "yield":
            self.i += 1
            if self.kind == "id" and self.t == "from":
                self.i += 1
                self.expr(3)
            elif self.t not in (";", ")", ",", "]"):
                self.expr(3)
                if self.eat("=>"):
                    self.expr(3)
            return
        self.postfix()
        if self.t in ("++", "--"):
            self.i += 1
        if BINARY.get(self.t, (0,))[0] == 3 and self.kind == "op":
            op = self.t
            self.i += 1
            if op == "=":
                self.eat("&")
            self.expr(3)

    def array_items(self, close: str) -> None:
        while not self.eat(close):
            if self.eat(","):
                continue
            self.eat("...")
            self.eat("&")
            self.expr()
            if self.eat("=>"):
                self.eat("&")
                self.expr()
            if not self.eat(","):
                self.need(close)
                break

    def primary(self) -> None:
        kind, t = self.kind, self.t
        if kind in ("str", "num"):
            self.i += 1
        elif kind == "var":
            word = self.toks[self.i][1]
            self.i += 1
            if word.endswith("$"):
                self.need("{")
                self.expr()
                self.need("}")
        elif kind == "attr":
            self.attributes()
            self.primary()
        elif t == "(":
            self.paren()
        elif t == "[":
            self.i += 1
            self.array_items("]")
        elif t in ("array", "list") and self.ahead() == "(":
            self.i += 2
            self.array_items(")")
        elif t == "isset":
            self.i += 1
            self.arguments()
        elif t in ("empty", "eval"):
            self.i += 1
            self.paren()
        elif t in ("exit", "die"):
            self.i += 1
            if self.t == "(":
                self.arguments()
        elif t in ("function", "fn") or t == "static" and self.ahead() in ("function", "fn"):
            self.eat("static")
            arrow = self.t == "fn"
            self.i += 1
            self.eat("&")
            if arrow:
                self.parameters()
                if self.eat(":"):
                    self.type()
                self.need("=>")
                self.expr(3)
            else:
                self.signature()
                self.block()
        elif t == "new":
            self.i += 1
            self.attributes()
            if self.t in ("class", "readonly"):
                self.eat("readonly")
                self.need("class")
                if self.t == "(":
                    self.arguments()
                self.class_rest(Item("class", "", self.here()))
                return
            if self.eat("("):
                self.expr()
                self.need(")")
            elif self.kind == "var":
                self.i += 1
                while self.t in ("->", "?->", "::", "["):
                    if self.eat("["):
                        self.expr()
                        self.need("]")
                    else:
                        self.i += 1
                        self.i += 1
            else:
                self.name(reserved=self.t == "static", qualified=True)
            if self.t == "(":
                self.arguments()
        elif t == "match":
            self.i += 1
            self.paren()
            self.need("{")
            while not self.eat("}"):
                if not self.eat("default"):
                    self.expr()
                    while self.eat(","):
                        if self.t == "=>":
                            break
                        self.expr()
                else:
                    self.eat(",")
                self.need("=>")
                self.expr()
                if not self.eat(","):
                    self.need("}")
                    break
        elif t == "static":
            self.i += 1
            if self.t != "::":
                self.fail("unexpected static")
        elif kind == "id" and (t not in RESERVED or t in ("readonly", "enum")):
            self.i += 1
        elif t == "namespace" and self.ahead().startswith("\\"):
            self.i += 2
        else:
            self.fail("expected an expression")

    def postfix(self) -> None:
        self.primary()
        while True:
            t = self.t
            if t == "[":
                self.i += 1
                if not self.eat("]"):
                    self.expr()
                    self.need("]")
            elif t == "{" and False:
                return
            elif t in ("->", "?->"):
                self.i += 1
                if self.kind == "id":
                    self.name(reserved=True)
                elif self.kind == "var":
                    self.primary()
                elif self.eat("{"):
                    self.expr()
                    self.need("}")
                else:
                    self.fail("expected a member")
            elif t == "::":
                self.i += 1
                if self.kind == "id":
                    self.name(reserved=True)
                elif self.kind == "var":
                    self.primary()
                elif self.eat("{"):
                    self.expr()
                    self.need("}")
                else:
                    self.fail("expected a member")
            elif t == "(":
                self.arguments()
            else:
                return


#: words that may begin a declaration, or a member of a class
STARTS = MODIFIERS | frozenset("function class interface trait enum const case use namespace".split())


class Tolerant(Parser):
    """Items of a file with errors: bodies are passed over by their braces, and what fails up to the next declaration."""

    def next_start(self, at: int, column: int | None = None) -> int:
        """The next token that begins a line and may begin a declaration, no further right than ``column``."""
        for i in range(at, len(self.toks)):
            kind, word, start, _ = self.toks[i]
            line = self.text.rfind("\n", 0, start) + 1
            if kind == "eof" or (word in STARTS or kind == "attr") and not self.text[line:start].strip() and (column is None or start - line <= column):
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
        self.i = self.next_start(at + 1, self.column(at))  # never closed: it ends where a declaration stands as far left

    def members(self, item: Item) -> None:
        self.need("{")
        while self.kind != "eof" and not self.eat("}"):
            at = self.i
            try:
                self.member(item)
            except (SyntaxError, IndexError):
                self.i = at + 1
                while self.kind != "eof" and self.t != "}" and self.next_start(self.i) != self.i:
                    if self.t == "{":
                        self.block()
                    else:
                        self.i += 1

    def file(self) -> list[Item]:
        out: list[Item] = []
        while self.kind != "eof":
            at = self.i
            try:
                self.statement(out, top=True)
            except (SyntaxError, IndexError):
                self.i = self.next_start(at + 1)
        return out


def parse(text: str, recover: bool = False) -> list[Item]:
    """Items of a PHP file.  Raises ``SyntaxError`` where the file is not valid, unless it shall ``recover``; nesting may be of any depth."""
    if text.startswith("\ufeff"):
        text = " " + text[1:]
    with deep_recursion(len(text)):
        try:
            return (Tolerant(text, True) if recover else Parser(text)).file()
        except IndexError as exc:
            raise SyntaxError(str(exc)) from exc
