"""Markup residue in text documents: clean text that keeps headings, lists, code blocks and formulas.

Method (line-block distribution): markup is stripped line by line into typed lines, the lengths of their
text (link texts don't count) are summed over a sliding window, the first surge and the last dive of that
distribution are located, and the text between them is kept, with headings, lists, code and formulas inside
it.  What lies outside is page furniture: menus, footers, notices.  Only whole HTML pages have such
furniture, so the windows decide there; of fragments and of the other families every line of text stays.

Output format of the clean text: headings become ``# title`` (as many ``#`` as the level), list items
``- item``, code blocks are fenced with three backquotes, formulas stand between ``$$``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML, environment-free commands of LaTeX and behaviour switches of wikis.
HTML_NAMES = (
    "a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main "
    "mark math meta nav noscript nowiki object ol option p pre q ref references s samp script section select small source span strike strong "
    "style sub summary syntaxhighlight gallery poem sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
)
TAG = re.compile(r"</?(?:" + "|".join(HTML_NAMES.split()) + r")(?:\s+[^<>]*|/[^<>]*)?\s*/?>|<!DOCTYPE[^<>]*>|<\?xml[^<>]*\?>", re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
DROPPED = re.compile(r"<(script|style|noscript|template|svg|head)\b[^>]*>.*?</\1\s*>", re.I | re.S)
ENTITY = re.compile(r"&(?:#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z][A-Za-z0-9]{1,31});")
FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[ \t]*[\w+.-]*[ \t]*$")
MD_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^[ \t]*(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDERLINE = re.compile(r"^(={3,}|-{3,})[ \t]*$")
LINK = re.compile(r"(!?)\[([^\[\]\n]+(?:\n[^\[\]\n]+)?)\]\(([^()\s]+)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)")
REF_LINK = re.compile(r"(!?)\[([^\[\]\n]+)\]\[([^\[\]\n]*)\](?!\()")
FOOT_REF = re.compile(r"\[\^[\w-]+\]:?")
REF_DEF = re.compile(r"^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]+(?:<[^<>\s]+>|https?://\S+|/\S*|\.{1,2}/\S*|#\S+|[\w.-]+/\S*)(?:[ \t]+[\"'(].*)?$")
BOLD = re.compile(r"(?<![\w*/\\.])(\*\*\*?|__)(?=[^\s*_/.])([^*\n_]*?(?:\n[^*\n_]+?)?[^\s*_/])\1(?![\w*/])")
ITALIC = re.compile(r"(?<![\w*/\\.])\*(?=[^\s*/.])([^*\n]*?(?:\n[^*\n]+?)?[^\s*/])\*(?![\w*/.])")
UNDER = re.compile(r"(?<![\w_/])_(?=[^\s_])([^_\n]*?(?:\n[^_\n]+?)?[^\s_])_(?![\w_])")
STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)~~")
CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+(?:\n[^`\n]+)?)\1(?!`)")
QUOTE = re.compile(r"^[ \t]{0,3}>[ \t]+\S|^[ \t]{0,3}>[ \t]*$")
BULLET = re.compile(r"^[ \t]*([-*+])[ \t]+(\S.*)$")
NUMBER = re.compile(r"^[ \t]*(\d{1,3})[.)][ \t]+(\S.*)$")
WIKI_ITEM = re.compile(r"^([*#;]{1,4})[ \t]*([^*#;:\s].*)$")
MD_TABLE = re.compile(r"^[ \t]*\|(?:[ \t]*:?-{2,}:?[ \t]*\|)+[ \t]*$")
MD_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$")
WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$")
WIKI_LINK = re.compile(r"\[\[(?![ \t])([^\[\]\n|]+(?:\n[^\[\]\n|]+)?)(?:\|([^\[\]\n|]*(?:\n[^\[\]\n|]+)?))*(?<![ \t])\]\]")
WIKI_EXT = re.compile(r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+[ \t]+([^\[\]\n]+)\]")
WIKI_TEMPLATE = re.compile(r"\{\{(?!\{)(?:[^{}]*\|[^{}]*|[a-z][a-z -]*|[A-Z][A-Za-z ]+)\}\}")
#: field names that stand for an unfilled placeholder when they fill a pair of brackets alone
FIELD_NAMES = frozenset("amount name first_name last_name date title company city address email phone subject recipient owner version department price total street country number reference signature location".split())
#: double braces without a bar are wiki templates only under one of these names; others are placeholders
WIKI_STUBS = frozenset(("stub", "citation needed", "cite", "clear", "reflist", "toc", "clarify", "fact", "disambig", "disambiguation", "unreferenced", "cleanup", "dubious", "dead link", "refbegin", "refend", "notoc"))
WIKI_QUOTE = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(?=\S)((?:(?!'').)+?)\1(?!')", re.S)
WIKI_TABLE = re.compile(r"^(?:\{\||\|\}|\|-|\|\+)|^![^!\n]+!!")
WIKI_CELL = re.compile(r"^[|!][ \t]*\S|^[|!][ \t]*$")
MAGIC = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|NOGALLERY)__")
REDIRECT = re.compile(r"^#REDIRECT[ \t]*:?[ \t]*\[\[", re.I)
CATEGORY = re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei)\s*:[^\[\]\n]*\]\]", re.I)
ENV = re.compile(r"\\(begin|end)[ \t]*\{([A-Za-z]+\*?)\}((?:\[[^\]\n]*\]|\{[^{}\n]*\})*)")
COMMAND = re.compile(r"\\([A-Za-z]+)\*?((?:\[[^\[\]\n]*\])?)\{")
BARE = re.compile(r"\\(?:item|maketitle|noindent|par|ldots|dots|textbackslash|newline|newpage|clearpage|centering|hline|toprule|midrule|bottomrule|tableofcontents|bfseries|itshape|small|large|Large|LaTeX|TeX|quad|qquad|medskip|bigskip|smallskip)(?![A-Za-z])")
ACCENT = re.compile(r"\\([\"'`^~=.])\{?\\?([A-Za-z])\}?|\\(c|v|H|k|u|r|d|b)\{([A-Za-z])\}|\\(ss|aa|AA|ae|AE|oe|OE|o|O|l|L|i|j)(?:\{\}|(?![A-Za-z])[ \t]?)|\{\\(ss|aa|AA|ae|AE|oe|OE|o|O|l|L)\}")
DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)
INLINE = re.compile(r"(?<![\\$\w])\$(?![\s$\d][^$\n]*[a-z]{3} )((?:[^$\n\\]|\\.)+?)(?<![\s\\])\$(?![\w$])|\\\((.+?)\\\)")
MATH_MARK = re.compile(r"[\\^_=<>+*/{}]|^\s*[A-Za-z]\s*$")
ESCAPED = re.compile(r"\\([%&_#${}])")
MD_ESCAPED = re.compile(r"\\([*_`\[\]()#+.!>|-])")
ACCENTS = {'"': "̈", "'": "́", "`": "̀", "^": "̂", "~": "̃", "=": "̄", ".": "̇", "c": "̧", "v": "̌", "H": "̋", "k": "̨", "u": "̆", "r": "̊", "d": "̣", "b": "̱"}
LETTERS = {"ss": "ß", "aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}
#: commands whose argument is no prose
SILENT = frozenset("documentclass usepackage label ref cite pagestyle bibliography bibliographystyle includegraphics input include vspace hspace setlength newcommand renewcommand index eqref pageref thispagestyle".split())
HEADS = {"title": 1, "part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
LATEX_COMMANDS = SILENT | HEADS.keys() | frozenset("textbf textit emph texttt underline textsc textsf textrm textsl href url footnote caption author date mbox hbox text mathbf mathrm frac sqrt sum item begin end enquote textsuperscript textsubscript uppercase verb".split())
MATH_ENVS = frozenset("equation equation* align align* displaymath math eqnarray gather multline".split())
CODE_ENVS = frozenset("verbatim lstlisting minted Verbatim alltt".split())
#: what a text must hold to be worth looking at; texts without are clean as they are
SUSPECT = re.compile(r"[<&`*#\[_{|\\$~=>]|^[ \t]*[-+][ \t]|^(?:'''?|---|\d{1,3}[.)] )|''", re.M)
#: what shows a whole HTML page
PAGE = re.compile(r"<(?:html|body|head|nav|footer|header|aside|main|article)\b|<!doctype", re.I)
#: lines in a window, and the length at which it surges (half the fullest window, if that is less)
WINDOW, SURGE = 3, 80
FURNITURE = re.compile(r"(<(nav|footer|aside)\b[^<>]*)(>.*?)(</\2\s*>)", re.I | re.S)
ANCHOR = re.compile(r"(<a\b[^<>]*>)(.*?)(</a\s*>)", re.I | re.S)
PROSE, HEADING, LIST, CODE_LINE, FORMULA, TABLE, PARAGRAPH = range(7)


def _compose(mark: str, letter: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", letter + ACCENTS[mark])


def _accents(text: str, kinds: set[str]) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            out = _compose(m[1], m[2])
        elif m[3]:
            out = _compose(m[3], m[4])
        else:
            out = LETTERS[m[5] or m[6]]
        kinds.add("latex")
        return out

    return ACCENT.sub(one, text)


def _latex_commands(text: str, kinds: set[str]) -> str:
    """Unwrap ``\\command{...}`` by balanced braces, innermost text kept unless the command is silent."""
    out, pos = [], 0
    while m := COMMAND.search(text, pos):
        name = m[1]
        if name not in LATEX_COMMANDS and not (len(name) > 2 and m.start() == 0) and not _known_latex(text):
            out.append(text[pos : m.end()])
            pos = m.end()
            continue
        depth, at = 1, m.end()
        while at < len(text) and depth:
            c = text[at]
            depth += (c == "{") - (c == "}")
            at += 2 if c == "\\" else 1
        if depth:
            out.append(text[pos : m.start()])
            pos = m.end()
            kinds.add("latex")
            continue
        kinds.add("latex")
        inner = text[m.end() : at - 1]
        out.append(text[pos : m.start()])
        if name == "href" and text[at : at + 1] == "{":
            pos = at
            stop = text.find("}", at)
            if stop > 0:
                out.append(_latex_commands(text[at + 1 : stop], kinds))
                pos = stop + 1
            continue
        if name in HEADS:
            out.append(f"\n\x01{HEADS[name]} {_latex_commands(inner, kinds)}\n")
        elif name not in SILENT:
            out.append(_latex_commands(inner, kinds))
        pos = at
    out.append(text[pos:])
    return "".join(out)


def _known_latex(text: str) -> bool:
    return "\\begin{" in text or "\\documentclass" in text or "\\section" in text


def _placeholder_free(m: re.Match) -> bool:
    """Is this pair of double braces a wiki template rather than an unfilled placeholder?"""
    inner = m.group()[2:-2]
    name = inner.split("|", 1)[0].strip()
    if "|" in inner:
        return not re.search(r"\|\s*(?:upper|lower|title|safe|default|date|e|escape|trim)\b[^|=]*$", inner) or "=" in inner or name[:1].isupper()
    return name.lower() in WIKI_STUBS or name.lower().split(" ")[0] in ("infobox", "cite") and name != "cite"


def convert(text: str) -> tuple[str, list[str]]:
    """Clean text and the markup families found in it (``html``, ``latex``, ``markdown``, ``wiki``)."""
    if not SUSPECT.search(text):
        return text, []
    kinds: set[str] = set()
    keep: list[str] = []  # code and formulas, out of reach of later rules

    def stash(body: str, kind: str) -> str:
        keep.append(body)
        return f"\x02{kind}{len(keep) - 1}\x03"

    def found(kind: str, repl):
        def one(m: re.Match) -> str:
            kinds.add(kind)
            return repl(m) if callable(repl) else repl

        return one

    s = text.replace("\r\n", "\n")
    # fenced code first: nothing inside is markup
    if "```" in s or "~~~" in s:
        lines, out, i = s.split("\n"), [], 0
        while i < len(lines):
            m = FENCE.match(lines[i])
            if m:
                j = next((k for k in range(i + 1, len(lines)) if lines[k].strip() == m[1]), None)
                kinds.add("markdown")
                if j is None:
                    i += 1
                    continue
                out.append(stash("\n".join(lines[i + 1 : j]), "c"))
                i = j + 1
            else:
                out.append(lines[i])
                i += 1
        s = "\n".join(out)
    if s.startswith("---\n"):
        end = s.find("\n---", 4)
        if end > 0 and re.match(r"(?:[\w-]+:.*\n?)+\Z", s[4:end]):
            kinds.add("markdown")
            s = s[end + 4 :].lstrip("\n")
    if "\\" in s:
        s = ENV.sub(lambda m: m[0] if m[2] not in CODE_ENVS else m[0], s)
        s = re.sub(r"\\begin\{(verbatim|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*\n?(.*?)\\end\{\1\}", found("latex", lambda m: "\n" + stash(m[2].rstrip("\n"), "c") + "\n"), s, flags=re.S)
        s = re.sub(r"\\begin\{(equation\*?|align\*?|displaymath|math|eqnarray|gather|multline)\}(.*?)\\end\{\1\}", found("latex", lambda m: "\n" + stash(m[2].strip(), "f") + "\n"), s, flags=re.S)
    if "<" in s:
        s = re.sub(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre\s*>", found("html", lambda m: "\n" + stash(html.unescape(TAG.sub("", m[1])).strip("\n"), "c") + "\n"), s, flags=re.I | re.S)
        s = re.sub(r"<math\b[^>]*>(.*?)</math\s*>", found("wiki", lambda m: "\n" + stash(m[1].strip(), "f") + "\n"), s, flags=re.I | re.S)
        s = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", found("wiki", ""), s, flags=re.I | re.S)
        s = re.sub(r"<(?:nowiki|syntaxhighlight|source)\b[^>]*>(.*?)</(?:nowiki|syntaxhighlight|source)\s*>", found("wiki", lambda m: stash(m[1], "c")), s, flags=re.I | re.S)
    if "$" in s or "\\" in s:
        s = DISPLAY.sub(found("latex", lambda m: "\n" + stash((m[1] or m[2]).strip(), "f") + "\n"), s)
        s = INLINE.sub(lambda m: found("latex", lambda k: stash((k[1] or k[2]).strip(), "i"))(m) if m[2] or MATH_MARK.search(m[1]) else m[0], s)
    if "`" in s:
        s = CODE.sub(found("markdown", lambda m: stash(m[2].strip(), "q")), s)
    page = "<" in s and PAGE.search(s) is not None
    if "<" in s:
        s = COMMENT.sub(found("html", ""), s)
        s = DROPPED.sub(found("html", "\n"), s)
        s = re.sub(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", found("html", lambda m: f"\n\x01{m[1]} {' '.join(TAG.sub(' ', m[2]).split())}\n"), s, flags=re.I | re.S)
        if page:  # link texts are marked, so that their lengths don't count
            s = FURNITURE.sub(lambda m: m[1] + re.sub(r">([^<>]+)(?=<|$)", "> \x06\\1\x07", m[3]) + m[4], s)
            s = ANCHOR.sub(lambda m: f"{m[1]}\x06{m[2]}\x07{m[3]}", s)
        s = re.sub(r"<(?:li|dt|dd)\b[^<>]*>", found("html", "\n\x04 "), s, flags=re.I)
        s = re.sub(r"<t[dh]\b[^<>]*>", found("html", " \x05 "), s, flags=re.I)
        if page:
            s = re.sub(r"<su[bp]\b[^<>]*>", found("html", "\x0e"), s, flags=re.I)
        s = re.sub(r"<p\b[^<>]*>", found("html", "\n\x0e" if page else "\n"), s, flags=re.I)
        s = re.sub(r"</?(?:p|div|br|ul|ol|dl|tr|table|section|article|nav|footer|header|aside|main|blockquote|hr|body|html|form|figure)\b[^<>]*>", found("html", "\n"), s, flags=re.I)
        s = TAG.sub(found("html", ""), s)
    if "&" in s:

        def entity(m: re.Match) -> str:
            plain = html.unescape(m[0])
            if plain == m[0]:
                return m[0]
            kinds.add("html")
            return plain.replace("\xa0", " ")

        s = ENTITY.sub(entity, s)
    if "[" in s or "{" in s or "'" in s or "_" in s:
        s = CATEGORY.sub(found("wiki", ""), s)
        s = WIKI_LINK.sub(lambda m: found("wiki", lambda k: k[2] or k[1])(m) if not re.match(r"[-!]\w?\s|\$", m[1]) and (m[2] or m[1] not in FIELD_NAMES) else m[0], s)
        s = re.sub(r"(?ms)^\{\{(?:[A-Z][^{}|]*)\n?\|.*?\}\}[ \t]*$", found("wiki", ""), s)
        s = WIKI_TEMPLATE.sub(lambda m: found("wiki", "")(m) if _placeholder_free(m) else m[0], s)
        s = WIKI_EXT.sub(found("wiki", lambda m: m[1]), s)
        s = MAGIC.sub(found("wiki", ""), s)
        s = WIKI_QUOTE.sub(found("wiki", lambda m: m[2]), s)
        s = FOOT_REF.sub(found("markdown", ""), s)
        s = LINK.sub(found("markdown", lambda m: m[2]), s)
    if "\\" in s:
        if _known_latex(s) or COMMAND.search(s):
            s = re.sub(r"(?<!\\)%[^\n]*", "", s) if _known_latex(s) else s
        s = _latex_commands(ENV.sub(lambda m: found("latex", "\n")(m) if m[1] == "end" or True else m[0], s), kinds)
        if not re.search(r"(?<!\w)[A-Za-z]:\\\w", s):
            s = _accents(s, kinds)
            s = re.sub(r"\\item\b[ \t]*", found("latex", "\n\x04 "), s)
            s = BARE.sub(found("latex", " "), s)
            if "latex" in kinds or re.search(r"\w\\[&%]\s|\\[%&]", s):
                s = ESCAPED.sub(found("latex", lambda m: m[1]), s)
                s = s.replace("\\\\", "\n")
        s = MD_ESCAPED.sub(found("markdown", lambda m: m[1]), s)
    if "*" in s or "_" in s or "~" in s:
        s = BOLD.sub(found("markdown", lambda m: m[2]) if "**" in s else lambda m: found("markdown", lambda k: k[2])(m) if not re.fullmatch(r"__[A-Z_]+__", m[0]) and not re.fullmatch(r"__\w+__", m[0]) else m[0], s)
        s = ITALIC.sub(found("markdown", lambda m: m[1]), s)
        s = UNDER.sub(found("markdown", lambda m: m[1]), s)
        s = STRIKE.sub(found("markdown", lambda m: m[1]), s)
    # line rules
    lines = s.split("\n")
    kinds_of, texts = [], []
    bullets = [bool(BULLET.match(x)) for x in lines]
    n = len(lines)
    table = False
    for i, line in enumerate(lines):
        kind = PROSE
        if "\x01" in line:
            k = line.index("\x01")
            line, kind = "#" * int(line[k + 1]) + line[k + 2 :], HEADING
        elif line.startswith("\x04"):
            line, kind = "- " + line[1:].strip(), LIST
        elif line.startswith("\x02c"):
            kind = CODE_LINE
        elif line.startswith("\x02f"):
            kind = FORMULA
        elif m := MD_HEAD.match(line):
            kinds.add("wiki" if REDIRECT.match(line) else "markdown")
            line, kind = f"{m[1]} {m[2]}", HEADING
        elif REDIRECT.match(line):
            kinds.add("wiki")
        elif m := WIKI_HEAD.match(line) if line.startswith("=") else None:
            kinds.add("wiki")
            line, kind = f"{'#' * len(m[1])} {m[2]}", HEADING
        elif UNDERLINE.match(line) and i and texts and texts[-1].strip() and kinds_of[-1] == PROSE and len(texts[-1]) < 120 and not lines[i - 1].startswith(("|", "{")):
            kinds.add("markdown")
            texts[-1], kinds_of[-1] = f"# {texts[-1].strip()}", HEADING
            continue
        elif RULE.match(line):
            kinds.add("markdown")
            continue
        elif line.startswith("{|") or line.startswith("|}"):
            kinds.add("wiki")
            table = line.startswith("{|")
            continue
        elif table and WIKI_CELL.match(line):
            if line.startswith(("|-", "|+")):
                continue
            line, kind = " | ".join(x.strip() for x in re.split(r"\|\||!!", line[1:])), TABLE
        elif line.startswith(("|-", "|+")):
            kinds.add("wiki")
            continue
        elif MD_TABLE.match(line):
            kinds.add("markdown")
            continue
        elif MD_ROW.match(line) and (line.count("|") > 2 or i + 1 < n and MD_ROW.match(lines[i + 1]) or i and MD_ROW.match(lines[i - 1])):
            kinds.add("markdown")
            line, kind = line.strip().strip("|").strip(), TABLE
        elif line.startswith("|") and re.match(r"\|[ \t]*[\w ]+?[ \t]*(?:=|\|\|)", line):
            kinds.add("wiki")
            line, kind = line[1:].strip(), TABLE
        elif QUOTE.match(line):
            kinds.add("markdown")
            line = re.sub(r"^[ \t]*>+[ \t]?", "", line)
        elif REF_DEF.match(line):
            kinds.add("markdown")
            continue
        elif bullets[i] and line.lstrip()[0] in "*+-" and not re.match(r"\s*-\s*\d+\s*-\s*$", line) and (i and bullets[i - 1] or i + 1 < n and bullets[i + 1] or line.lstrip()[0] in "*+" or "markdown" in kinds):
            m = BULLET.match(line)
            kinds.add("wiki" if m[1] == "*" and "wiki" in kinds else "markdown")
            line, kind = f"- {m[2]}", LIST
        elif line[:1] in ("*", "#", ";") and "wiki" in kinds and (m := WIKI_ITEM.match(line)):
            line, kind = f"- {m[2]}", LIST
        elif (m := NUMBER.match(line)) and (i + 1 < n and NUMBER.match(lines[i + 1]) or i and NUMBER.match(lines[i - 1])):
            kinds.add("markdown")
            line, kind = f"{m[1]}. {m[2]}", LIST
        if "\x05" in line and kind == PROSE:
            kind = TABLE
        texts.append(line.replace("\x05", "|"))
        kinds_of.append(kind)
    if "latex" in kinds:
        texts = [t.replace("~", " ") if k == PROSE else t for t, k in zip(texts, kinds_of)]
    if not kinds:
        return text, []
    body = _kept(texts, kinds_of, page)
    return _unstash(body, keep), sorted(kinds)


MARKS = " \t\x06\x07\x0e"
#: texts of links and of furniture elements
LINKED = re.compile(r"\x06[^\x07]*(?:\x07|$)|^[^\x06\x07]*\x07")


def _kept(texts: list[str], kinds_of: list[int], page: bool) -> str:
    """Text between the first surge and the last dive of the line-block distribution of a page; else all of it."""
    if page:
        rows = [(t, k) for t, k in zip(texts, kinds_of) if t.strip(MARKS)]  # blank lines of the source say nothing
        first, last = _surge_and_dive([len(LINKED.sub("", t).strip(MARKS + "-|")) for t, _ in rows], [PARAGRAPH if "\x0e" in t else k for t, k in rows])
        inside = iter(range(len(rows)))
        keep = [first <= next(inside) <= last if t.strip(MARKS) else None for t in texts]
        texts = [t for t, k in zip(texts, keep) if k is not False]
    out = "\n".join(t.rstrip() for t in texts)
    out = re.sub("[\x06\x07\x0e]", "", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


TOUCHING = frozenset((HEADING, LIST, TABLE, CODE_LINE, FORMULA, PARAGRAPH))


def _surge_and_dive(length: list[int], kinds: list[int]) -> tuple[int, int]:
    """First and last line of the text of a page; all lines where no window holds more than another."""
    n = len(length)
    if not n:
        return 0, -1
    size = np.array([max(x, SURGE) if k in (CODE_LINE, FORMULA) else x for x, k in zip(length, kinds)], dtype=np.int64)
    block = np.convolve(size, np.ones(WINDOW, dtype=np.int64))
    ahead, behind = block[WINDOW - 1 :], block[:n]
    surge = min(SURGE, int(block.max()) / 2)
    if block.max() < SURGE / 2:
        return 0, n - 1
    # the window that surges begins before the line that made it surge
    first = int(np.argmax(ahead >= surge))
    while first < n - 1 and size[first] < surge / WINDOW:
        first += 1
    last = n - 1 - int(np.argmax(behind[::-1] >= surge))
    while last > first and size[last] < surge / WINDOW:
        last -= 1
    # headings, one title line, and short lines that are marked as text belong to the text they touch
    title = True
    while first and size[first - 1] and (kinds[first - 1] in TOUCHING or title and kinds[first - 1] == PROSE):
        title &= kinds[first - 1] != PROSE
        first -= 1
    while last < n - 1 and size[last + 1] and kinds[last + 1] in TOUCHING:
        last += 1
    return first, last


def _unstash(text: str, keep: list[str]) -> str:
    def one(m: re.Match) -> str:
        body = _unstash(keep[int(m[2])], keep)
        return {"c": f"```\n{body}\n```", "f": f"$$\n{body}\n$$", "i": f"${body}$", "q": body}[m[1]]

    return re.sub("\x02([cfiq])(\\d+)\x03", one, text)


SCHEMA = T.StructType([T.StructField("clean", T.StringType()), T.StructField("families", T.ArrayType(T.StringType()))])


def clean_markup(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``clean`` and ``families`` for every row of ``df``.

    ``families`` is empty where nothing was found; then ``clean`` is the text itself.  Null texts give null
    and an empty list, blank texts themselves.  Other columns of ``df`` may have any names: only ``keep``
    and ``text`` are read.  Rows are independent, so the operator is one scan without any shuffle.
    """
    source = df.select(*keep, F.col(text).alias("_text"))
    fields = [source.schema[c] for c in keep] + list(SCHEMA)
    out_schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, families = [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                if value is None:
                    clean.append(None)
                    families.append([])
                else:
                    body, kinds = convert(value)
                    clean.append(body)
                    families.append(kinds)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(clean, pa.string()), pa.array(families, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out_schema])

    return source.mapInArrow(run, out_schema)
