"""Template residue and error-page text: unfilled placeholders, filler, error pages, script notices.

Method, all of it over distinct texts, so that copies are no evidence:

* Records made from the same template are aligned by the words around a candidate slot.  The places of all
  markers are looked up in all records, so a value that another record holds there ("Dear Anna,") counts as
  well as another marker.  A place with different fillers is an induced slot, and a record whose slot still
  holds a variable name, a default or a blank is flagged.  A filler that stands in induced slots is one
  elsewhere too.  What is left are markers that nothing can be aligned with: one is flagged if its form is
  unmistakable and its sentence does not speak of templates.
* Whole pages are compared with templates of errors, script notices and filler: a page is flagged if every
  content line belongs to one.  Fixed patterns only give the first such lines.  Lines that occur nearly only
  on such pages are learned from the corpus, and pages that hold nothing but learned lines are flagged too.
  Every line of every text is judged and counted, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import materialize
from .markup import FIELD_NAMES, LINK, TAG, WIKI_TEMPLATE, _placeholder_free

#: a place is a slot where it holds so many different fillers in distinct texts
MIN_FILLERS = 2
#: a line is learned as part of error pages if at least this share of its texts are such pages
LEARNED_SHARE = 0.8
#: a text teaches lines if at least this share of its content lines are known
TEACHING_SHARE = 0.3
#: words that a value between two fixed contexts may have, and the size of the bit maps of contexts
VALUE_WORDS = 4
CONTEXT_BITS = 22

# The syntaxes in which templates write their slots.
SLOT = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|%\([A-Za-z_]\w*\)[sdf]"
    r"|%%[A-Za-z_]\w*%%|@@[A-Za-z_]\w*@@|__[A-Z][A-Z0-9_]*[A-Z0-9]__|\$[A-Z][A-Z0-9_]*\$|<<[^<>\n]{2,50}>>"
    r"|\{[A-Za-z0-9_][^{}\n]{0,50}\}|\[\[[A-Za-z_][\w ]{0,30}\]\]|\[[^\[\]\n]{2,50}\]|<[^<>\n]{2,50}>|\b(?:XX|DD|MM)[/.-](?:XX|DD|MM)[/.-](?:XXXX|YYYY|XX|YY)\b|_{4,}"
)
#: markers that nothing but a template holds
CLEAR = re.compile(
    r"\{\{\{?\s*[A-Za-z_][\w.|\[\]'\" -]*\}?\}\}|\$\{\s*[A-Za-z_][\w.]*\s*\}|#\{\s*[A-Za-z_][\w.]*\s*\}|<%=?[^%\n]+%>|%\([A-Za-z_]\w*\)[sdf]|%%[A-Z_]+%%|@@[A-Z_]+@@|__[A-Z][A-Z_]+__|\$[A-Z][A-Z_]+\$"
    r"|<<[A-Za-z][\w ]+>>|[\[<](?i:your|insert|enter|add|ihr|ihre|bitte|votre|su|seu|ваше?|twoje?)\b[^\[\]<>\n]*[\]>]"
)
#: a sentence about templates
ABOUT = re.compile(
    r"(?i)\b(?:templat\w*|placeholders?|variables?|substitut\w*|replac\w*|render\w*|expand\w*|syntax|markers?|macros?|tokens?|expressions?|snippets?|braces|brackets|delimiters?|escap\w*|means|denotes|stands? for|write|type|regex\w*"
    r"|vorlagen?|platzhalter\w*|variablen?|ersetz\w*|modèle|gabarit|variable|remplac\w*|plantilla|marcador|reemplaz\w*|sustitu\w*|modelo|substitu\w*|шаблон\w*|переменн\w*|замен\w*|szablon\w*|zmienn\w*|zastęp\w*)\b|テンプレート|変数|置換|`"
)
MAGIC = frozenset("__NOTOC__ __TOC__ __FORCETOC__ __NOEDITSECTION__ __NOINDEX__ __INDEX__ __NOGALLERY__".split())
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque morbi "
    "tristique senectus orci viverra sagittis netus malesuada fames ac turpis egestas".split()
)
FILLER = re.compile(
    r"""(?ix)^(?:
      .{0,40}\bplaceholder(?:\s+text)?\W*$ | .*\b(?:text|paragraph|content|copy|description|caption|title)\ goes\ here\b.* | .{0,40}\bto\ come\W*$
    | coming\ soon\b.* | (?:insert|add|enter|put|write)\ (?:your\ |the\ )?[\w ]{1,30}(?:\bhere|\bfor\ this\ \w+)\W*$ | replace\ this\ [\w ]{1,25}(?:\bwith\b.*)?$
    | this\ is\ (?:(?:an?|some|just|only)\ )*(?:example|sample|dummy|placeholder)\b[\w ]{0,25}\W*(?:change\ it.*|edit\ me.*|replace\ .*)?$ | (?:change|edit|replace)\ (?:it|me|this)\ later\W*$
    | your\ (?:text|paragraph|content|title|caption|\w+)\ (?:goes\ )?here\b.* | (?:blah\W*){2,}.*
    | (?:sample|dummy|lorem|test|filler|example)\ \w+(?:\ \w+){0,2}(?:\W+(?:sample|dummy|lorem|test|filler|example)\ \w+(?:\ \w+){0,2})*\W*$
    | hier\ (?:kommt|steht|folgt)\b.*\btext\b.* | (?:blindtext|platzhalter)\b.* | aqu[ií]\ va\ .*\btexto\b.* | texto\ de\ (?:ejemplo|relleno|prueba)\b.*
    | texte\ (?:provisoire|de\ remplacement|d['’]exemple|fictif)\b.* | здесь\ (?:будет|должен|находится)\b.* | текст[- ]заполнитель.* | (?:tu\ wpisz|tutaj\ będzie|tekst\ zastępczy)\b.*
    | (?:aqui\ vai|texto\ provis[oó]rio)\b.* | (?:ダミー|ここに).*
    | \[[\w ]{2,30}\]\W*$ | (?:more\ )?(?:text|copy|content)\ (?:to\ follow|follows|pending|missing)\W*$
    )$"""
)
MASH = re.compile(r"(?i)\b(?:asdf\w*|qwert?\w*|jkl\w*|hjkl\w*|zxcv\w*|yxcv\w*|x{3,}|test|foo|bar|baz|abc|[a-z]?123\d*)\b")
SCRIPT = re.compile(
    r"""(?ix)
      \b(?:enable|activate|allow|turn\ on|switch\ on)\ (?:java\ ?script|js\b|scripts?\b|scripting|active\ content|client-side\ code|cookies)
    | \b(?:requires?|needs?)\ (?:java\ ?script|js\b|scripts\b|scripting|active\ content|client-side\ code)
    | \b(?:java\ ?script|js|scripts?|scripting|script\ execution|active\ content|client-side\ code)\b(?:(?!,).){0,25}\b(?:is|are|seems?|has|have|must|may|appears?|needs?)\b(?:(?!,).){0,25}\b(?:off|on|disabled|blocked|unavailable|not\ available|required|needed|enabled|allowed|inactive|turned|switched|deactivated|supported)\b
    | \b(?:browser|reader|viewer)\b.{0,30}\bwith\ (?:java\ ?script|js\b|scripts?\b|scripting|active\ content|client-side\ code) | \bdoes\ not\ support\ (?:java\ ?script|js|scripts?|scripting)
    | \bnoscript\b | \bturn\ scripts\ on\b | \bcookies\ and\ scripts\b | \bwithout\ (?:java\ ?script|scripts|scripting|js)\b
    | \bcannot\ show\ the\ \w+\b | \b(?:page|list|site|content)\ stays\ empty\b | \bchange\ the\ setting\ and\ (?:press\ )?reload\b | \bpress\ reload\b
    | \bnot\ a\ robot\b | \bchecking\ your\ browser\b | \bupdate\ your\ browser\b | ^loading\W*$ | ^loading\.\.\.
    | aktivieren\ sie\b.*(?:java\ ?script|skript|script) | (?:java\ ?script|skripte)\b.*\b(?:aktivier|eingeschaltet|deaktiviert|ausgeschaltet|erforderlich)
    | (?:activez|activer|veuillez\ activer)\b.*(?:java\ ?script|scripts?) | (?:java\ ?script|scripts?)\b.*\b(?:désactiv|doit\ être|requis|nécessaire)
    | (?:activ[ea]r?|habilit[ea]r?|ative)\b.*(?:java\ ?script|los\ scripts|scripts) | (?:java\ ?script|скрипты|сценарии)\b.*(?:включ|отключ) | (?:включите|включить|разрешите)\b.*(?:java\ ?script|скрипт|сценари)
    | (?:włącz|włączyć|wymaga)\b.*(?:java\ ?script|skrypt|obsług) | (?:java\ ?script|スクリプト).*(?:有効|無効|必要)
    """
)
ERROR = re.compile(
    r"""(?ix)
      \b(?:page|file|entry|record|document|folder|item|list|resource|url|address|site|link)\b.{0,40}\b(?:does\ not\ exist|doesn['’]t\ exist|has\ been\ (?:moved|removed|deleted)|was\ (?:moved|removed|deleted|withdrawn|not\ found)|is\ no\ longer\ (?:available|here)|is\ not\ here|could\ not\ be\ found|cannot\ be\ (?:found|displayed|shown)|is\ not\ available|not\ found)
    | \bno\ such\ (?:page|file|entry|record|document|folder)\b | \bserver\b.{0,30}\b(?:met\ an\ unexpected|encountered|did\ not\ (?:answer|respond)|sent\ an\ invalid|is\ (?:too\ )?busy|overloaded|could\ not)\b
    | \bcannot\ find\ (?:this|that|the|your)\ \w+\W*$ | \bcould\ not\ be\ loaded\b | \bserver\ ran\ into\b | \bcould\ not\ finish\ your\ request\b | \b(?:your\ )?(?:session|login)\ (?:has\ (?:expired|run\ out|timed\ out|ended)|over|expired)\b | \bsign\ in\ (?:again|once\ more)\b | \blog\ in\ (?:again|once\ more)\b
    | \btoo\ many\ requests\b | \byou\ (?:are\ not\ allowed|do\ not\ have\ (?:permission|access|the\ right)|don['’]t\ have\ (?:permission|access)|may\ not\ open|need\ (?:permission|rights))\b | \baccess\ (?:was\ |is\ |has\ been\ )?(?:denied|forbidden|refused)\b
    | \bunable\ to\ (?:establish|connect|load|complete|process)\b | \b(?:could\ not|cannot)\ connect\b | \bconnection\b.{0,20}\b(?:refused|reset|failed|lost)\b | \bdown\ for\ maintenance\b | \bmaintenance\ in\ progress\b | \bwill\ be\ back\ (?:soon|shortly|online)\b | \b(?:under|closed\ for)\ maintenance\b
    | \btoo\ much\ time\ passed\b | \brequest\b.{0,30}\b(?:was\ malformed|is\ malformed|timed\ out|could\ not\ be|cannot\ be|failed)\b | \bcheck\ the\ (?:spelling|address|url)\b | \bgo\ back\ to\ the\ (?:start|home|previous)\b
    | \bunhandled\ exception\b | \bfatal\ error\b | \bcall\ stack\s*: | \bstack\ trace\s*: | ^traceback\b | \bsomething\ went\ wrong\b | \btry\ again\ (?:later|in\ a\ few|soon)\b | ^oops\b | ^sorry,
    | \boperators?\ (?:were|was|have\ been)\ (?:told|notified|informed)\b | \bread\ the\ server\ log\b | ^(?:kind|type)\s*:\s*status\ page\b | ^incident\s+\w+ | ^request\ id\b | ^reference\s*:\s*\w+$ | ^error\s+code\b
    | \b(?:wait\ a\ few\ (?:minutes|seconds))\W*$ | ^(?:http|error|fehler|erreur|ошибка|błąd|erro)\s*:?\s*0\b
    | (?:angeforderte|gesuchte|gewünschte)\ \w+\b.*\b(?:nicht\ gefunden|existiert\ nicht|nicht\ (?:mehr\ )?vorhanden|verschoben) | \bseite\b.*\bnicht\ gefunden | kein\ zugriff | zugriff\ verweigert | (?:server|dienst)\b.*\b(?:nicht\ erreichbar|wartung|vorübergehend)
    | page\ demandée\b.*\b(?:existe\ pas|introuvable|supprimée|déplacée) | page\ introuvable | accès\ (?:refusé|interdit) | (?:service|serveur)\b.*\b(?:indisponible|maintenance)
    | no\ hemos\ podido\ encontrar | página\b.*\b(?:no\ encontrada|no\ existe|não\ encontrada|não\ existe) | acceso\ denegado | acesso\ negado | página\ solicitada
    | запрос\ не\ может\ быть\ выполнен | страница\b.*не\ (?:найдена|существует) | доступ\ (?:запрещ|закрыт) | попробуйте\ позже | ошибка\ сервера
    | strona\b.*\b(?:nie\ istnieje|nie\ została\ znaleziona) | nie\ znaleziono\ strony | brak\ dostępa | ページが見つかりません | アクセスできません | エラーが発生
    """
)
STATUS = re.compile(
    r"(?i)^(?:(?:http|error|fehler|erreur|ошибка|status)?\s*:?\s*0?\s*[:.–-]?\s*)?(?:not found|page not found|forbidden|unauthori[sz]ed|access denied|bad gateway|bad request|gateway time-?out|request time-?out|internal server error|"
    r"server error|service unavailable|temporarily (?:offline|unavailable)|too many requests|database error|application error|timed out|gone|removed|session over|session expired|login required|no such page|no such \w+|"
    r"under maintenance|maintenance|not allowed|moved|deleted|error|fatal error|warning|ошибка сервера|seite nicht gefunden|nicht gefunden|page introuvable|página no encontrada|página não encontrada|страница не найдена)\W*$"
)
#: a sentence about errors or scripts as a subject, not a notice
SUBJECT = re.compile(r"(?i)^(?:if|when|whenever|once|where)\b.*,\s*(?:the|a|an|our|every|it|this|that)\b.*\bstill\b|[“\"«„].{0,40}[”\"»“]|\bonly means\b|\berrors? (?:fell|rose|dropped|grew|are|were)\b")
MASK = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]+\b|\d+")
SIDE = re.compile(r"(?i)^(?:[^|.!?]{1,30}\|){1,6}[^|.!?]{1,30}$|\ball rights reserved\b|^copyright\b|^(?:back to|skip to|go to|return to)\b[\w ]{0,25}$|^(?:menu|home|products|about|contact|search|help|terms|privacy|login|imprint|start)$")
SENTENCE = re.compile(r"(?<=[.!?…。])\s+")


# Letter runs of which a sentence must hold one to match the pattern of script notices, or one of errors.
SCRIPT_CUES = "script|js|cookie|robot|browser|loading|reload|active content|client-side|skript|скрипт|сценари|スクリプト|skrypt|stays empty|cannot show|setting"
ERROR_CUES = (
    "cannot|could not|exist|moved|removed|deleted|found"
    "|no longer|is not here|not available|unavailable|no such|server|request|session|login|sign in|log in|not allowed|permission|may not|access|unable|connect|maintenance|will be back|go back|time|spelling|address|exception"
    "|fatal|stack|went wrong|try again|oops|sorry|operator|status|incident|reference|error|http|wait a few|gefunden|existiert|vorhanden|verschoben|zugriff|wartung|erreichbar|fehler|introuvable|supprim|déplac|refus|interdit"
    "|indisponible|erreur|encontrad|existe|denegado|negado|solicitada|encontrar|erro |запрос|страниц|доступ|попробуйте|ошибка|istnieje|znalezion|dostęp|błąd|見つかりません|アクセス|エラー|gone|denied|forbidden|gateway|unauthor|traceback"
    "|need permission|need rights|doesn't exist|doesn’t exist|offline|withdrawn"
)
FILLER_CUES = "placeholder|here|to come|coming|insert|replace|example|sample|dummy|later|your |blah|lorem|test|filler|text|platzhalter|здесь|заполнитель|wpisz|tutaj|aqui|aquí|ダミー|ここ|[|follow|pending|missing|change|edit|enter|add |write|put |asdf|qwer|zxcv|yxcv|jkl|xxx|foo|123"


def _automaton(cues: str) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for cue in cues.split("|"):
        out.add_word(cue, 1)
    out.make_automaton()
    return out


_SCRIPT_CUE, _ERROR_CUE, _FILLER_CUE = _automaton(SCRIPT_CUES), _automaton(ERROR_CUES), _automaton(FILLER_CUES)


def _has(automaton: ahocorasick.Automaton, text: str) -> bool:
    return next(automaton.iter(text), None) is not None


def _notice(sentence: str) -> bool:
    """Does the (masked) sentence belong to an error page or a script notice?"""
    low = sentence.lower()
    found = _has(_ERROR_CUE, low) and (ERROR.search(sentence) or STATUS.match(sentence)) or _has(_SCRIPT_CUE, low) and SCRIPT.search(sentence)
    return bool(found) and not SUBJECT.search(sentence)


_PUNCT = str.maketrans({c: " " for c in ".,;:!?()[]{}\"'“”„«»–—-_/|0123456789"})


def _filler(line: str) -> bool:
    low = line.lower()
    words = low.split()
    # few words repeated begin with few letters, and filler Latin shows in its words: only such lines are looked at closely
    if len({w[0] for w in words[:12]}) <= 5 or sum(map(LOREM.__contains__, words)) >= 0.3 * len(words):
        words = low.translate(_PUNCT).split()
        kinds = set(words) if len(words) >= 3 else frozenset("abcd")
        if len(kinds & LOREM) >= 2 and sum(w in LOREM for w in words) >= 0.75 * len(words):
            return True
        if len(kinds) <= min(3, max(1, len(words) // 3)) or len(words) >= 4 and len(kinds) <= 2:
            return True
    if len(line) >= 200 or not _has(_FILLER_CUE, low):
        return False
    words = low.translate(_PUNCT).split()
    if not words:
        return False
    if len(words) >= 2 and len(MASH.findall(line)) >= max(2, 0.5 * len(line.split())):
        return True
    return FILLER.match(line.strip()) is not None


#: how lines beside the content begin that hold no bar
SIDE_STARTS = frozenset("cop bac ski go ret men hom pro abo con sea hel ter pri log imp sta".split()) | {"go "}


def _side(line: str) -> bool:
    """Is this a menu line or a notice beside the content?"""
    low = line.lower()
    return ("|" in line or low[:3] in SIDE_STARTS or "all rights" in low) and SIDE.search(line) is not None


def page_lines(text: str) -> tuple[int, list[int]]:
    """How many known lines (errors, notices, filler) a text has, and its other content sentences as keys.

    Digits are masked.  Menu lines and a title in front do not count.
    """
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    lines = [x for x in lines if len(x) > 160 or not _side(x)]
    known, rest = 0, set()
    for k, line in enumerate(lines):
        masked = MASK.sub("0", line)
        low = line.lower()
        error = _has(_ERROR_CUE, low)
        cue = error or _has(_SCRIPT_CUE, low)
        if len(line) < 60 and error and STATUS.match(masked) or _filler(line):
            known += 1
            continue
        if k == 0 and len(lines) > 1 and len(line) < 90 and not re.search(r"[.!?…。:]\W*$|\.\.\.", line) and not (cue and _notice(masked)):
            continue
        parts = SENTENCE.split(masked)
        for sentence in parts:
            if cue and _notice(sentence) or len(parts) > 1 and _filler(sentence) and not SUBJECT.search(sentence):
                known += 1
            elif re.search(r"[^\W\d_]", sentence):
                rest.add(xxhash.xxh64_intdigest(sentence) - (1 << 63))
    return known, sorted(rest)


def slots(text: str) -> list[tuple[str, str, str, bool]]:
    """``(left words, right words, filler, clear)`` of every candidate slot; markup is no slot.

    ``clear`` tells that the marker needs no other record to be one: its form is unmistakable and its
    sentence does not speak of templates.
    """
    if not re.search(r"[{\[<%@$_]|XX|DD|MM", text):
        return []
    spans = [m.span() for m in TAG.finditer(text)] + [m.span() for m in LINK.finditer(text)]
    spans += [m.span() for m in WIKI_TEMPLATE.finditer(text) if _placeholder_free(m)]
    out = []
    found = []
    for m in SLOT.finditer(text):
        a, b = m.span()
        body = m.group()
        inner = body.strip("[]{}<>%$#@_= ")
        if any(s <= a < e or s < b <= e for s, e in spans) or body in MAGIC:
            continue
        if body[0] in "[<" and not body.startswith(("<%", "<<")):
            if not re.search(r"[^\W\d]", inner) or text[b : b + 1] in ("(", "[", "]") or body.startswith("[^") or re.match(r"</?[a-z]\w*(?:\s+[\w-]+=|\s*/?>)", body) and " " not in inner:
                continue
            if body.startswith("[[") and inner.lower().strip() not in FIELD_NAMES:
                continue
            if body[0] == "[" and re.fullmatch(r"\[[a-z]\w*(?:, *[a-z]\w*)+\]", body):
                continue
            if body.startswith("< ") or re.match(r"\[\s*-\w|\[!|<!|<https?:|<[\w.+-]+@", body):
                continue
        if a and text[a - 1] not in " \t\n(\"'“„«:,;/—–-" or a and text[a - 1] == "\\":
            continue
        if b < len(text) and (text[b].isalnum() or text[b] in "_\\{"):
            continue
        found.append((a, b, body))
    for a, b, body in found:
        start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
        end = end if end >= 0 else len(text)
        left = SLOT.sub("*", text[start:a]).split()[-2:]
        right = SLOT.sub("*", text[b:end]).split()[:2]
        mark = text[b : b + 1] if b < len(text) and not text[b].isspace() else ""
        head, tail = SENTENCE.split(text[start:a])[-1], SENTENCE.split(text[b:end], maxsplit=1)[0]
        clear = CLEAR.fullmatch(body) is not None and not ABOUT.search(head) and not ABOUT.search(tail)
        out.append((" ".join(left), f"{mark}|{' '.join(right)}", MASK.sub("0", body), clear))
    return out


def _bit(context: str) -> int:
    return xxhash.xxh64_intdigest(context) & ((1 << CONTEXT_BITS) - 1)


def values(text: str, ends: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> Iterator[tuple[str, str, str]]:
    """``(left words, right words, value)`` wherever both contexts of a marker surround other words, or nothing.

    The bit maps hold the last left words, the left and the right contexts of all markers.
    """
    for line in text.split("\n"):
        w = line.split()
        for i in range(1, len(w)):
            if not ends[_bit(w[i - 1])]:
                continue
            left = " ".join(w[max(0, i - 2) : i])
            if not lefts[_bit(left)]:
                continue
            for n in range(VALUE_WORDS + 1):
                j = i + n
                if j >= len(w):
                    break
                last = w[j - 1] if n else ""
                mark = last[-1:] if not last[-1:].isalnum() else ""
                right = f"{mark}|{mark} {w[j]}" if mark else f"|{w[j]} {w[j + 1]}" if j + 1 < len(w) else ""
                if right and rights[_bit(right)]:
                    yield left, right, MASK.sub("0", " ".join(w[i:j]).rstrip(mark or None))
                    break


EMIT = "doc_id long, t binary, known int, rest array<long>, slots array<struct<l:string,r:string,f:string,clear:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string()), ("f", pa.string()), ("clear", pa.bool_())]))
    for batch in batches:
        ids, keys, known, rest, cand = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None or not text.strip():
                continue
            n, other = page_lines(text)
            s = slots(text)
            if not n and not s and not other:
                continue
            ids.append(i)
            keys.append(xxhash.xxh3_128_digest(text))
            known.append(n)
            rest.append(other)
            cand.append([{"l": a, "r": b, "f": c, "clear": d} for a, b, c, d in s])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(known, pa.int32()), pa.array(rest, pa.list_(pa.int64())), pa.array(cand, kind)], names=["doc_id", "t", "known", "rest", "slots"])


def _bits(contexts: DataFrame) -> np.ndarray:
    """Bit map of one string column, combined on the map side: at most ``2**(CONTEXT_BITS - 6)`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array(sorted({_bit(x) for x in batch.column(0).to_pylist()}), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bits"])

    words = np.zeros(1 << CONTEXT_BITS - 6, np.int64)
    for r in contexts.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[r["word"]] = r["bits"]
    return np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def _aligned_values(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``(l, r, f)``: what other records hold between the contexts of markers, each once."""
    full = places.where("l <> ''")
    maps = (_bits(full.select(F.element_at(F.split("l", " "), -1))), _bits(full.select("l")), _bits(full.select("r")))
    shared = texts.sparkSession.sparkContext.broadcast(maps)  # three maps of 2**CONTEXT_BITS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {x for text in batch.column(0).to_pylist() if text for x in values(text, *shared.value)}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], names=["l", "r", "f"])

    got = texts.mapInArrow(run, "l string, r string, f string").distinct()
    # the maps let some other contexts through
    return got.join(places.distinct(), ["l", "r"], "left_semi")


def _slots(source: DataFrame, texts: DataFrame) -> DataFrame:
    """Keys of the texts that hold an unfilled placeholder."""
    slot = texts.where(F.size("slots") > 0).select("t", F.explode("slots").alias("s")).select("t", "s.*")
    markers = materialize(slot.groupBy("l", "r", "f").agg(F.max("clear").alias("clear")), "markers")
    aligned = _aligned_values(source.select("text"), markers.select("l", "r"))
    combos = materialize(markers.select("l", "r", "f").unionByName(aligned.where("f <> ''")).distinct(), "fillers")
    by_place = combos.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n_both"))
    by_left = markers.where("l <> ''").groupBy("l").agg(F.count_distinct("f").alias("n_left"))
    by_right = markers.where("r <> '|'").groupBy("r").agg(F.count_distinct("f").alias("n_right"))
    judged = markers.join(by_place, ["l", "r"]).join(by_left, "l", "left").join(by_right, "r", "left").select("l", "r", "f", "clear", (F.greatest("n_both", "n_left", "n_right") >= MIN_FILLERS).alias("varies"))
    usual = judged.where("varies").select("f").distinct()
    open_ = judged.join(usual.withColumn("usual", F.lit(True)), "f", "left").where("varies OR usual OR clear").select("l", "r", "f")
    return salted_join(slot, open_, ["l", "r", "f"], "left_semi", by="t").select("t").distinct()


def _pages(texts: DataFrame) -> DataFrame:
    """Keys of the texts in which every content line is known or learned."""
    teaches = F.col("known") >= TEACHING_SHARE * (F.col("known") + F.size("rest"))
    alone = (F.col("known") == 0) & (F.size("rest") == 1)  # a text of one line says nothing about the line
    lines = texts.select("t", teaches.cast("int").alias("page"), alone.alias("alone"), F.explode("rest").alias("h"))
    counts = lines.groupBy("h").agg(F.count_if(~F.col("alone")).alias("n"), F.sum("page").alias("n_page"))
    learned = counts.where((F.col("n_page") >= 2) & (F.col("n_page") >= LEARNED_SHARE * F.col("n"))).select("h")
    covered = salted_join(lines, learned, ["h"], "left_semi", by="t").groupBy("t").agg(F.count(F.lit(1)).alias("n_learned"))
    open_ = texts.where(F.size("rest") > 0).select("t", F.size("rest").alias("n_rest"))
    return texts.where((F.col("known") > 0) & (F.size("rest") == 0)).select("t").unionByName(open_.join(covered, "t").where("n_rest = n_learned").select("t"))


def template_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, placeholder, whole_page)`` for every flagged document, each once.

    Null and blank texts are never flagged; repeated rows of an id give one row, and an id with different
    texts is flagged if one of them is.  Texts are reduced to distinct ones before anything is counted or
    joined; joins on lines and slots are salted, since one may stand in a third of all texts.
    """
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = materialize(source.mapInArrow(_scan, EMIT), "residue")
    texts = materialize(seen.groupBy("t").agg(F.first("known").alias("known"), F.first("rest").alias("rest"), F.first("slots").alias("slots")), "texts")
    filled = _slots(source, texts).select("t", F.lit(True).alias("placeholder"), F.lit(False).alias("whole_page"))
    whole = _pages(texts).select("t", F.lit(False).alias("placeholder"), F.lit(True).alias("whole_page"))
    flags = filled.unionByName(whole).groupBy("t").agg(F.max("placeholder").alias("placeholder"), F.max("whole_page").alias("whole_page"))
    ids = salted_join(seen.select("doc_id", "t"), flags, ["t"], "inner", by="doc_id")
    return ids.groupBy("doc_id").agg(F.max("placeholder").alias("placeholder"), F.max("whole_page").alias("whole_page"))


def without_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus without flagged documents; null and blank texts stay."""
    flagged = template_residue(documents, doc_id, text).select(F.col("doc_id").alias(doc_id))
    return documents.join(flagged, doc_id, "left_anti")
