"""Noise in text from scanned pages, repaired into continuous paragraphs.

Method: forms of the whole corpus are counted; for every rare form, correction candidates are retrieved
by an inverted join on character q-grams of a *confusion skeleton* (glyphs that scanners mix up share one
class), a gradient-boosted ranker trained on simulated misreadings chooses the replacement, and three
line classifiers of the same kind decide on joins across lines, page numbers and running headers.

Every form that a record needs (its suspicious words, and joined and hyphenated forms at its line ends) is
looked up by a join; only a bit map of fixed size is broadcast.  The models are trained on simulated cases
from at most ``TRAIN_WORDS`` frequent words.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import salted_join
from ..session import materialize
from .boosting import Boosted

TRAIN_WORDS = 4_000
#: a word that may replace others stands in so many distinct texts
MIN_COUNT = 4
#: the least similarity of skeletons, and the most by which numbers of q-grams and lengths may differ
LEAST_SIMILAR, SIZE_GAP = 0.5, 2
BITMAP_BITS = 24
ACCEPT = 0.5
#: running headers without a clear number are rarer than in the simulated pages, so the bar is higher
HEADER = 0.97
#: share of a form's distinct texts with other noise from which on it is a misreading (by the rule of succession)
PURITY = 0.3
#: share of all forms explained by one unlisted substitution from which on it is a confusion of this corpus
LEARNED_EDIT = 0.02

# Glyphs and groups that scanners mix up.
CONFUSIONS = (
    ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("h", "b"), ("e", "c"), ("t", "f"), ("s", "ſ"), ("f", "ſ"), ("i", "!"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "I"), ("o", "0"), ("g", "9"), ("b", "8"), ("s", "5"),
    ("z", "2"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("n", "ri"), ("nn", "rm"), ("in", "m"), ("li", "h"), ("l", "|"), ("i", "|"), ("t", "l"), ("a", "o"), ("v", "y"), ("n", "u"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"), ("G", "6"), ("Z", "2"), ("q", "9"), ("a", "@"), ("t", "+"), ("T", "7"), ("A", "4"), ("E", "3"), ("é", "ć"), ("ç", "c"), ("k", "lc"), ("D", "O"), ("U", "ll"),
)
ODD = re.compile(r"[ſﬁﬂﬀﬃﬄ]|[^\W\d_][0-9!|@+][^\W\d_]|^[0-9!|][^\W\d_]{2,}|[^\W\d_]{2,}[0-9!|]$")
#: characters that no word of a clean text holds among its letters
IMPOSSIBLE = re.compile(r"[ſﬁﬂﬀﬃﬄ]|[^\W\d_][0189!|][^\W\d_]{1}|^[0189!|5][^\W\d_]{2,}|[^\W\d_]{2,}[0189!|]$")
CLASSES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"), ("li", "h")]
LETTERS = str.maketrans({"c": "e", "0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "I": "l", "t": "f", "ſ": "f", "s": "f", "5": "f", "8": "b", "h": "b", "9": "g", "q": "g", "a": "o", "u": "n", "@": "o", "3": "e", "4": "o", "7": "f", "2": "z", "6": "g", "+": "f", "y": "v"})
EDGE = ".,;:?()[]{}\"'“”„«»‘’…—–*_#`~<>"
WORD = re.compile(r"\S+")
#: a hyphen at a line end, perhaps a blank line, and the word that goes on
LINE_END = re.compile(r"([-‐\u00ad¬])[ \t]*\n(?:[ \t]*\n)?[ \t\x0c]*([^\W\d_]+)")
#: a word with a hyphen at a line end, and how many lines of page furniture may stand before its rest
HALF = re.compile(r"([^\W\d_]+)[-‐\u00ad¬][ \t]*$")
FURNITURE_LINES = 4
HYPHENS = "-‐­¬"
HYPHENED = re.compile(r"\S*[-‐\u00ad¬](?!\S)")
SPACED = re.compile(r"(?<![^\s(“\"])(?:[^\W\d_] ){3,}[^\W\d_](?![^\s.,;:!?)”\"])|(?<!\S)(?:[^\W\d_] )+- (?:[^\W\d_] )+[^\W\d_](?!\w)")
STRAY = re.compile(r"(?<=[^\W\d_,]) [|~¬^] (?=[^\W\d_])|(?<=[^\W\d_,.;]) ?[|~^](?=\n|$)|(?<=[^\W\d_]) \. (?=[a-zà-ÿ])|(?<=[^\W\d_])¬(?=\s)")


def skeleton(word: str) -> str:
    """A word with confusable glyphs folded together."""
    w = word.lower()
    for a, b in CLASSES:
        w = w.replace(a, b)
    return w.translate(LETTERS)


def grams(word: str) -> list[str]:
    s = f"^{skeleton(word)}$"
    return sorted({s[i : i + 3] for i in range(len(s) - 2)} or {s})


def forms_of(text: str) -> set[str]:
    """Distinct lower-case forms of a text without outer punctuation; broken words at line ends are left out."""
    words = set(text.split())
    if half := {w for w in words if w[-1] in HYPHENS}:
        # such a word counts where it stands within a line
        words -= half
        words |= {m.group() for m in HYPHENED.finditer(text) if text[m.end() : m.end() + 2].strip(" \t")[:1] not in ("\n", "")}
    out = set()
    for w in words:
        w = w.strip(EDGE).rstrip("!")
        if len(w) > 2 and (w[0].isalpha() or any(map(str.isalpha, w))):
            out.add(w.lower())
    return out


def _emit_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                count.update(forms_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["form", "n"])


def _emit_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, ns, out, size, fs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], [], []
        counts = []
        for f, n in zip(forms, ns):
            g = grams(f)
            out += g
            fs += [f] * len(g)
            counts += [n] * len(g)
            size += [len(g)] * len(g)
        yield pa.RecordBatch.from_arrays([pa.array(fs, pa.string()), pa.array(counts, pa.int64()), pa.array(out, pa.string()), pa.array(size, pa.int32())], names=["form", "n", "gram", "size"])


_PAIR = {}
for _c, _m in CONFUSIONS:
    _PAIR.setdefault((_c.lower(), _m.lower()), 1)


def align(noisy: str, clean: str) -> tuple[int, int]:
    """``(confusions, other edits)`` of the cheapest way from ``clean`` to ``noisy``; other edits weigh more."""
    a, b = clean, noisy
    inf = 10**6
    cost = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    how = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    cost[0][0] = 0
    for i in range(len(a) + 1):
        row = cost[i]
        for j in range(len(b) + 1):
            c = row[j]
            if c >= inf:
                continue
            k, o = how[i][j]
            if i < len(a) and j < len(b) and a[i] == b[j] and c < cost[i + 1][j + 1]:
                cost[i + 1][j + 1], how[i + 1][j + 1] = c, (k, o)
            for x in (1, 2):
                if i + x > len(a):
                    break
                for y in (1, 2):
                    if j + y > len(b):
                        break
                    if (a[i : i + x], b[j : j + y]) in _PAIR and c + 1 < cost[i + x][j + y]:
                        cost[i + x][j + y], how[i + x][j + y] = c + 1, (k + 1, o)
            for x, y in ((1, 1), (1, 0), (0, 1)):
                if i + x <= len(a) and j + y <= len(b) and c + 4 < cost[i + x][j + y]:
                    cost[i + x][j + y], how[i + x][j + y] = c + 4, (k, o + 1)
    return how[len(a)][len(b)]


def word_features(noisy: str, n_noisy: int, clean: str, n_clean: int) -> list[float]:
    conf, other = align(noisy, clean)
    ga, gb = set(grams(noisy)), set(grams(clean))
    return [
        conf, other, conf / max(1, len(clean)), len(clean), abs(len(noisy) - len(clean)),
        math.log(n_clean + 1), math.log(n_noisy + 1), math.log((n_clean + 1) / (n_noisy + 1)),
        len(ga & gb) / max(1, len(ga | gb)), float(noisy[0] == clean[0]), float(noisy[-1] == clean[-1]), float(bool(IMPOSSIBLE.search(noisy))),
        float(skeleton(noisy) == skeleton(clean)),
    ]


def corrupt(word: str, rng: random.Random) -> str:
    """One or two simulated misreadings."""
    for _ in range(1 if len(word) < 5 or rng.random() < 0.7 else 2):
        spots = [(i, c, m) for c, m in CONFUSIONS for i in range(len(word)) if word.startswith(c.lower(), i)]
        if not spots:
            break
        i, c, m = rng.choice(spots)
        word = word[:i] + m.lower() + word[i + len(c) :]
    return word


def train_ranker(words: list[tuple[str, int]], seed: int = 5) -> Boosted:
    """Ranker of (form, candidate) from simulated misreadings of frequent words and from pairs of real words."""
    rng = random.Random(seed)
    index: dict[str, list[int]] = {}
    for k, (w, _) in enumerate(words):
        for g in grams(w):
            index.setdefault(g, []).append(k)
    x, y = [], []
    # words about as frequent as another that they look like are no misreadings of it
    for k, (w, n) in enumerate(words):
        twins = {j for g in rng.sample(grams(w), min(2, len(grams(w)))) for j in index[g] if n < words[j][1] <= 6 * n and abs(len(words[j][0]) - len(w)) <= SIZE_GAP}
        for j in sorted(twins)[:3]:
            x.append(word_features(w, n, *words[j]))
            y.append(0.0)
    for w, n in words:
        bad = corrupt(w, rng)
        if bad == w:
            continue
        few = max(1, int(n / rng.choice((3, 8, 20, 50, 100, 400, 2000))))
        x.append(word_features(bad, few, w, n))
        y.append(1.0)
        near = [k for g in rng.sample(grams(bad), min(3, len(grams(bad)))) for k in rng.sample(index.get(g, []), min(2, len(index.get(g, []))))]
        for k in near[:4]:
            if words[k][0] != w:
                x.append(word_features(bad, few, *words[k]))
                y.append(0.0)
        if len(w) > 4 and rng.random() < 0.25:
            # a confusion that nobody listed: a letter inside the word
            at = rng.randint(1, len(w) - 2)
            odd = w[:at] + rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != w[at]]) + w[at + 1 :]
            x.append(word_features(odd, few, w, n))
            y.append(1.0)
        # a rare inflection or another word is no misreading of its neighbour
        other = w + rng.choice(("s", "ed", "ing", "er", "e", "n", "en", "es", "a", "o")) if rng.random() < 0.5 else w[:-1] + rng.choice("aeionrstdl")
        x.append(word_features(other, few, w, n))
        y.append(0.0)
    if not x or min(y) == max(y):
        return Boosted(trees=0).fit(np.zeros((2, 13)), np.array([0.0, 1.0]))
    return Boosted().fit(np.array(x), np.array(y))


# -- lines -----------------------------------------------------------------------------------------
ROMAN = r"(?=[ivxlc]+\b)(?:x{0,3}(?:ix|iv|v?i{0,3})|l?x{0,3}v?i{0,3})"
NUMBER_LINE = re.compile(rf"(?i)^[\s\[\](){{}}~–—.|*•·-]*(?:(?:page|seite|p|pag|pág|página|str|стр|s)\.?\s*)?(?:\d(?:[\doOlIi ]{{0,4}})|{ROMAN})(?:\s*(?:of|/|von|sur|de)\s*\d[\doOlI ]*)?[\s\[\](){{}}~–—.|*•·-]*$")
LEAD_NUMBER = re.compile(r"^\W*(\d{1,4})(?:\s{2,}|\s*[|·•—–]\s*)(\S.*)$")
TAIL_NUMBER = re.compile(r"^(.*?\S)(?:\s{2,}|\s*[|·•—–]\s*|(?:\s+\.){2,}\s*)(\d{1,4})\W*$")
PLAIN_TAIL = re.compile(r"^(.*[^\W\d_])\s+(\d{1,4})\s*$")
DATED = re.compile(r"\d{4}-\d\d-\d\d|\d\d:\d\d|\b\d+\.\d+\.\d+|\b\d{1,2}\.\d{1,2}\.\d{4}")


HAS_DIGIT, LAST_DIGIT, NO_LETTER = re.compile(r"\d"), re.compile(r"\d\W*\Z"), re.compile(r"[\W\d_]+")


def tail_number(bare: str) -> re.Match | None:
    """``TAIL_NUMBER`` at a line that ends with a digit; of others the long pattern would try every blank."""
    return TAIL_NUMBER.match(bare) if LAST_DIGIT.search(bare) else None


def numbered(bare: str) -> bool:
    """Is this line a page number, or does it begin or end with what may be one?"""
    return bool(bare) and "||" not in bare and not bare.startswith(("|", "{|", "!")) and bool(NUMBER_LINE.match(bare) or LEAD_NUMBER.match(bare) or tail_number(bare))


def _key(line: str) -> str:
    """Letters of a line without a page number at either end."""
    s = line.strip("\x0c \t")
    if not HAS_DIGIT.search(s):
        return NO_LETTER.sub("", s.lower())
    s = m[2] if (m := LEAD_NUMBER.match(s)) else m[1] if (m := tail_number(s)) else s
    return NO_LETTER.sub("", s.lower())


def line_features(lines: list[str], i: int, width: float, letters: Counter) -> list[float]:
    s = lines[i]
    bare = s.strip("\x0c \t")
    prev = next((lines[k].strip() for k in range(i - 1, -1, -1)), "")
    nxt = lines[i + 1].strip("\x0c \t") if i + 1 < len(lines) else ""
    number = bool(NUMBER_LINE.match(bare)) and bool(bare)
    lead, tail = LEAD_NUMBER.match(bare), tail_number(bare)
    text = (lead[2] if lead else tail[1] if tail else bare).strip(" .")
    alpha = [c for c in text if c.isalpha()]
    caps = sum(c.isupper() for c in alpha) / max(1, len(alpha))
    near = sum(bool(re.search(r"\d\W*$", lines[k])) and not NUMBER_LINE.match(lines[k].strip()) for k in (i - 2, i - 1, i + 1, i + 2) if 0 <= k < len(lines))
    tables = sum(lines[k].count("|") >= 2 or lines[k].lstrip().startswith(("|", "{|", "!", "-", "*", "<", "\\", "#")) for k in (i - 1, i, i + 1) if 0 <= k < len(lines))
    key = re.sub(r"[\W\d_]+", "", text.lower())
    return [
        float(number), float(bool(lead)), float(bool(tail)), float(" . ." in bare), float("....." in bare), caps, len(bare.split()), len(bare) / max(1.0, width),
        float(bool(prev) and prev[-1] not in ".!?:…»”\""), float(nxt[:1].islower()), float(not prev), float(not nxt), float(i == 0), float(i == len(lines) - 1),
        float(near), float("\x0c" in s), float(letters[key] > 1) if key else 0.0, float(tables), float(bool(DATED.search(bare))),
        float(i + 1 < len(lines) and bool(NUMBER_LINE.match(nxt)) and bool(nxt)), width, float(bool(re.search(r"\d", bare))), float("|" in bare), float(bool(re.match(r"[\[~–-]", bare))),
    ]


def header_features(lines: list[str], i: int, width: float, letters: Counter) -> list[float]:
    s = lines[i]
    bare = s.strip("\x0c \t")
    prev = lines[i - 1].strip() if i else ""
    nxt = lines[i + 1].strip("\x0c \t") if i + 1 < len(lines) else ""
    above = next((x for k in range(i - 1, max(-1, i - 4), -1) if (x := lines[k].strip("\x0c \t"))), "")
    below = next((x for k in range(i + 1, min(len(lines), i + 4)) if (x := lines[k].strip("\x0c \t"))), "")
    number = bool(bare) and bool(NUMBER_LINE.match(bare))
    lead, tail, plain = LEAD_NUMBER.match(bare), tail_number(bare), PLAIN_TAIL.match(bare)
    text = (lead[2] if lead else tail[1] if tail else bare).strip(" .")
    alpha = [c for c in text if c.isalpha()]
    caps = sum(c.isupper() for c in alpha) / max(1, len(alpha))
    near = sum(bool(re.search(r"\d\W*$", lines[k])) and not NUMBER_LINE.match(lines[k].strip()) for k in (i - 2, i - 1, i + 1, i + 2) if 0 <= k < len(lines))
    tables = sum(lines[k].count("|") >= 2 or lines[k].lstrip().startswith(("|", "{|", "!", "-", "*", "<", "\\", "#")) for k in (i - 1, i, i + 1) if 0 <= k < len(lines))
    key = _key(s)
    return [
        float(number), float(bool(lead)), float(bool(tail)), float(" . ." in bare), float("....." in bare), caps, len(bare.split()), len(bare) / max(1.0, width),
        float(bool(prev) and prev[-1] not in ".!?:…»”\""), float(nxt[:1].islower()), float(not prev), float(not nxt), float(i == 0), float(i == len(lines) - 1),
        float(near), float("\x0c" in s), float(min(5, letters[key] - 1)) if key else 0.0, float(tables), float(bool(DATED.search(bare))),
        float(bool(below) and bool(NUMBER_LINE.match(below))), float(bool(above) and bool(NUMBER_LINE.match(above))), width, float(bool(re.search(r"\d", bare))), float("|" in bare), float(bool(re.match(r"[\[~–-]", bare))),
        float(bool(plain)), float(bool(above) and above[-1] not in ".!?:…»”\"" and below[:1].islower()), float(bare[-1:] in ".!?:;,"), len(lines),
    ]


def line_stats(lines: list[str]) -> tuple[float, Counter]:
    sizes = sorted(len(x) for x in lines if len(x.split()) > 3)
    letters: Counter = Counter(_key(x) for x in lines)
    return float(sizes[len(sizes) // 2]) if sizes else 60.0, letters


def train_furniture(words: list[str], seed: int = 9) -> Boosted:
    """Line classifier from simulated pages: wrapped prose with headers and page numbers, contents, lists, tables, logs."""
    rng = random.Random(seed)
    words = [w for w in words if w.isalpha()] or ["text", "line", "word"]
    x, y = [], []

    def prose(n: int, wide: int) -> list[str]:
        out, line = [], ""
        for _ in range(n * 9):
            w = rng.choice(words)
            if not line and (not out or out[-1].endswith(".")):
                w = w.capitalize()
            if rng.random() < 0.09:
                w += "."
            if len(line) + len(w) + 1 > wide and line:
                out.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        return out[:n] + [line + "."]

    def title() -> str:
        t = " ".join(rng.choice(words) for _ in range(rng.randint(2, 5)))
        return rng.choice((t.capitalize(), t.title(), t.upper(), f"{t.capitalize()}: {rng.choice(words)}"))

    for _ in range(2500):
        wide = rng.choice((40, 50, 60, 70))
        lines = prose(rng.randint(3, 14), wide)
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), "")
        labels = [0.0] * len(lines)
        head, page, style = title(), rng.randint(2, 300), rng.randint(0, 12)
        kind = rng.random()
        if kind < 0.6:
            whole = [0, len(lines), *(k for k in range(1, len(lines)) if lines[k - 1].endswith("."))]  # a page may begin with a sentence
            spots = sorted({rng.choice((0, rng.choice(whole), rng.randint(0, len(lines)))) for _ in range(rng.randint(1, 3))}, reverse=True)
            for k, at in enumerate(spots):
                p = page - k
                mark = [f"- {p} -", f"~ {p} ~", f"[{p}]", f"{p}", f"Page {p}", f"p. {p} of {p + 90}", f"{head} . . . . {p}", f"{p} | {head}", f"{p}    {head}", f"{head}          {p}", "xiii", f"{head}\n{p}", f"Seite {p}"][style]
                if rng.random() < 0.15:
                    mark = "\x0c" + mark
                new = mark.split("\n")
                lines[at:at] = new
                labels[at:at] = [1.0] * len(new)
        elif kind < 0.75:
            toc = [f"{title()} {'.' * rng.randint(4, 30)} {k}" for k in range(2, rng.randint(5, 10))]
            toc = [rng.choice(("Contents", "Inhalt", "Index"))] * (rng.random() < 0.8) + toc
            at = rng.choice((0, len(lines)))
            lines[at:at], labels[at:at] = toc, [0.0] * len(toc)
        else:
            block = rng.choice((
                [f"{k}. {title()}" for k in range(1, 6)], [f"| {rng.choice(words)} | {rng.randint(1, 90)} |" for _ in range(4)], [f"{rng.choice(words)} {rng.randint(2, 99)}" for _ in range(4)],
                [f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 10:2{rng.randint(0, 9)}:31 INFO {rng.choice(words)}: {title()}" for _ in range(4)], [f"Version {rng.randint(0, 9)}.{rng.randint(0, 20)}.1 of 2020-0{rng.randint(1, 9)}-11", f"Added: {title()}."],
                [f"Minutes, {rng.randint(1, 28)}.{rng.randint(1, 12)}.2019", f"Item 1: {title()}."], [f"{title()}"], [f"    {rng.choice(words)} + {rng.randint(1, 9)}"], [f"* {title()}" for _ in range(3)], [f"Error code: {rng.randint(100, 9000)}"], [f"{title()} {rng.randint(2, 90)}", ""],
            ))
            at = rng.choice((0, len(lines)))
            lines[at:at], labels[at:at] = block, [0.0] * len(block)
        width, letters = line_stats(lines)
        for i, line in enumerate(lines):
            if numbered(line.strip("\x0c \t")):
                x.append(line_features(lines, i, width, letters))
                y.append(labels[i])
    return Boosted(trees=80, depth=5).fit(np.array(x), np.array(y))


def beside_numbers(lines: list[str], numbers: set[int]) -> set[int]:
    """Lines right above or below a page number, blank lines skipped."""
    out = set()
    for i in numbers:
        for step in (-1, 1):
            k = i + step
            while 0 <= k < len(lines) and not lines[k].strip():
                k += step
            if 0 <= k < len(lines) and k not in numbers:
                out.add(k)
    return out


def maybe_headers(lines: list[str], letters: Counter, numbers: set[int]) -> list[int]:
    """Lines without a clear page number that may be running headers: repeated ones, and neighbours of page numbers.

    A title that stands once and has no number beside it is no running header.
    """
    near = beside_numbers(lines, numbers)
    return [i for i, x in enumerate(lines) if i not in numbers and x.strip() and (i in near or (k := _key(x)) and letters[k] > 1)]


def train_headers(words: list[str], seed: int = 17) -> Boosted:
    """Classifier of running headers without a clear number, from simulated pages where headers and parts of the text repeat."""
    rng = random.Random(seed)
    words = [w for w in words if w.isalpha()] or ["text", "line", "word"]
    x, y = [], []

    def sentence() -> str:
        out = [str(rng.randint(2, 99)) if rng.random() < 0.06 else rng.choice(words) for _ in range(rng.randint(4, 16))]
        return f"{' '.join(out).capitalize()}."

    def prose(n: int, wide: int) -> list[str]:
        """About ``n`` wrapped lines, or whole paragraphs between blank lines; some sentences come again."""
        stock = [sentence() for _ in range(rng.randint(2, 6))]
        said = [rng.choice(stock) if rng.random() < 0.25 else sentence() for _ in range(n)]
        if wide > 100:
            return [x for k in range(0, n, 3) for x in (" ".join(said[k : k + 3]), "")][:-1]
        out, line = [], ""
        for w in " ".join(said).split():
            if len(line) + len(w) + 1 > wide and line:
                out.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        return [*out, line][: n + 1]

    for _ in range(1500):
        wide = rng.choice((40, 50, 60, 70, 1000))
        lines = prose(rng.randint(4, 16), wide)
        labels = [0.0] * len(lines)
        t = " ".join(rng.choice(words) for _ in range(rng.randint(2, 5)))
        head, page, style = rng.choice((t.capitalize(), t.title(), t.upper(), f"{t.capitalize()}: {rng.choice(words)}")), rng.randint(2, 300), rng.randint(0, 3)
        if rng.random() < 0.5 and wide < 100:
            for k, at in enumerate(sorted((rng.randint(0, len(lines)) for _ in range(rng.randint(2, 4))), reverse=True)):
                p = page - k
                new = ([head], [f"{head} {p}"], [str(p), head], [head, "", str(p)])[style]
                lines[at:at], labels[at:at] = new, [1.0] * len(new)
        else:
            # repeated lines that belong to the text: questions, versions, logs, headings, tables, lists, code
            say = t.capitalize()
            if rng.random() < 0.3:  # no prose at all: captions, filler, menus
                lines = [rng.choice((say, f"{say}.", f"{rng.choice(words)} {rng.choice(words)} 1, {rng.choice(words)} 2", sentence())) for _ in range(rng.randint(2, 5))]
                lines += [rng.choice(lines)] * rng.randint(0, 2)
                labels = [0.0] * len(lines)
            for k in range(rng.randint(2, 5)):
                again = rng.choice((
                    "Answer:", "A: The", f"A: {say.split()[0]} {page + 7 * k}", "}", f"{say}.", f"{say.split()[0]}:", f"- {say}", f"{say} = {len(say)}", f"Version {page % 9}.{page % 11}.{k} of 20{10 + k}-0{1 + k}-1{k}", f"20{10 + k}-01-1{k} 08:1{k}:31 INFO", f"## {say}",
                    f"<p>{say}</p>", f"| {say} | {k} |", "</div>", f"{k + 1}. {say}", say.split()[0], f"{say}?", f"HTTP {400 + k}: {say}", "---", f"{say} TO COME", say,
                ))
                ends = [j for j in range(1, len(lines)) if not lines[j - 1] or lines[j - 1][-1] in ".:}?>" or lines[j - 1] == again]
                at = rng.choice([0, len(lines), *ends])
                new = [again, ""] if rng.random() < 0.2 else [again]
                lines[at:at], labels[at:at] = new, [0.0] * len(new)
        width, letters = line_stats(lines)
        numbers = {i for i, v in enumerate(lines) if v.strip() and NUMBER_LINE.match(v.strip()) and labels[i]}
        for i in maybe_headers(lines, letters, numbers):
            x.append(header_features(lines, i, width, letters))
            y.append(labels[i])
    return Boosted(trees=60, depth=4).fit(np.array(x), np.array(y))


def join_features(n_joined: int, n_hyphen: int, n_left: int, n_right: int, left: str, right: str, mark: str) -> list[float]:
    return [math.log(n_joined + 1), math.log(n_hyphen + 1), math.log(n_joined + 1) - math.log(n_hyphen + 1), math.log(n_left + 1), math.log(n_right + 1), min(len(left), 12), min(len(right), 12), float(mark != "-"), float(right[:1].isupper())]


def train_joins(words: list[tuple[str, int]], seed: int = 13) -> Boosted:
    """Does a line-end hyphen belong to the compound (0) or to the line break (1)?"""
    rng = random.Random(seed)
    count = dict(words)
    x, y = [], []
    for w, n in words:
        if "-" in w:
            a, b = w.split("-", 1)
            for _ in range(6):
                x.append(join_features(0, int(n * rng.uniform(0.2, 1)), count.get(a, 0), count.get(b, 0), a, b, "-"))
                y.append(0.0)
        elif len(w) > 3 and w.isalpha():
            k = rng.randint(2, len(w) - 2)
            a, b = w[:k], w[k:]
            seen = rng.random() < 0.9
            x.append(join_features(n if seen else 0, rng.choice((0, 0, 0, 1)) if seen else 0, count.get(a, 0), count.get(b, 0), a, b, rng.choice("--­¬")))
            y.append(1.0)
            # compounds that stand nowhere else: both halves are words, the joined form is none
            c, d = rng.choice(words)[0], w
            if c.isalpha() and rng.random() < 0.5:
                x.append(join_features(0, rng.choice((0, 1, 3)), count.get(c, 0), n, c, d, "-"))
                y.append(0.0)
    if not x or min(y) == max(y):
        return Boosted(trees=0).fit(np.zeros((2, 9)), np.array([0.0, 1.0]))
    return Boosted(trees=40).fit(np.array(x), np.array(y))


def breaks(text: str) -> list[tuple[int, int, str, str, str]]:
    """``(start, end, left, mark, right)`` of words broken at a line end."""
    out = []
    for m in LINE_END.finditer(text):
        at = m.start()
        while at and text[at - 1].isalpha():
            at -= 1
        if at < m.start() and (not out or at >= out[-1][1]):
            out.append((at, m.end(), text[at : m.start()], m[1], m[2]))
    return out


def halves(text: str) -> Iterator[tuple[str, str]]:
    """Lower-case ``(left, right)`` of every word that a line end may have broken, with or without page furniture between."""
    if not any(c in text for c in HYPHENS):
        return
    lines = text.replace("\r\n", "\n").split("\n")
    for i, line in enumerate(lines[:-1]):
        if m := HALF.search(line):
            for k in range(i + 1, min(len(lines), i + 2 + FURNITURE_LINES)):
                if n := re.match(r"[ \t\x0c]*([^\W\d_]+)", lines[k]):
                    yield m[1].lower(), n[1].lower()


def lookups(text: str, bitmap: np.ndarray) -> set[str]:
    """Forms of a text that the corpus table has to answer: possible corrections, and words at breaks."""
    out = {f for f in forms_of(text) if bitmap[_bit(f) >> 3] >> (_bit(f) & 7) & 1}
    for a, b in halves(text):
        out |= {a + b, f"{a}-{b}", a, b}
    return out


def _bit(form: str) -> int:
    return xxhash.xxh64_intdigest(form) & ((1 << BITMAP_BITS) - 1)


def _predictions(model: Boosted, feats: list[list[list[float]]]) -> list[np.ndarray]:
    """One prediction for the rows of many texts."""
    flat = [f for rows in feats for f in rows]
    p = model.predict(np.array(flat)) if flat else np.zeros(0)
    return np.split(p, np.cumsum([len(rows) for rows in feats])[:-1])


def _without_furniture(texts: list[str], furniture: Boosted, headers: Boosted) -> list[tuple[str, bool]]:
    """Each text without page numbers and running headers, and whether there were any."""
    split = [text.replace("\r\n", "\n").split("\n") for text in texts]
    stats = [line_stats(lines) if len(lines) > 1 else (60.0, Counter()) for lines in split]
    bare = [[x.strip("\x0c \t") for x in lines] for lines in split]
    maybe = [[i for i, x in enumerate(b) if len(b) > 1 and numbered(x)] for b in bare]
    found = _predictions(furniture, [[line_features(lines, i, *st) for i in at] for lines, at, st in zip(split, maybe, stats)])
    numbers = [{i for i, v in zip(at, p) if v > 0.5} for at, p in zip(maybe, found)]
    maybe = [maybe_headers(lines, st[1], at) if len(lines) > 1 else [] for lines, st, at in zip(split, stats, numbers)]
    found = _predictions(headers, [[header_features(lines, i, *st) for i in at] for lines, at, st in zip(split, maybe, stats)])
    out = []
    for text, lines, at, more, p in zip(texts, split, numbers, maybe, found):
        dropped = at | {i for i, v in zip(more, p) if v > HEADER}
        out.append(("\n".join(x.replace("\x0c", "") for i, x in enumerate(lines) if i not in dropped), bool(dropped) or "\x0c" in text))
    return out


Known = dict[str, tuple[int, str | None, bool]]


def _joined(texts: list[str], known: list[Known], joins: Boosted) -> list[tuple[str, bool]]:
    """Each text with the words that line ends broke put together, and whether one was; one prediction for all."""
    spans = [breaks(s) for s in texts]
    feats = []
    for found, table in zip(spans, known):
        get = lambda f: table.get(f, (0, None, False))[0]  # noqa: B023, E731
        feats += [join_features(get((a + b).lower()), get(f"{a}-{b}".lower()), get(a.lower()), get(b.lower()), a, b, m) for _, _, a, m, b in found]
    p = joins.predict(np.array(feats)) if feats else np.zeros(0)
    out, k = [], 0
    for s, found in zip(texts, spans):
        parts, pos, broken = [], 0, False
        for start, end, a, m, b in found:
            torn = p[k] > 0.5 or m != "-"
            k += 1
            broken |= torn
            parts += [s[pos:start], f"{a}{b}" if torn else f"{a}-{b}"]
            pos = end
        out.append(("".join(parts) + s[pos:], broken))
    return out


def repair_all(texts: list[str], known: list[Known], furniture: Boosted, headers: Boosted, joins: Boosted) -> list[tuple[str, list[str], int, list[str]]]:
    """``(text in paragraphs, kinds of noise, number of impossible forms, other replaced forms)`` of every text.

    ``known`` holds for each text what the corpus says of its forms: count, correction, and whether all its
    edits are listed confusions.  Other corrections are made only where something else shows a scanned page.
    """
    plain = _without_furniture(texts, furniture, headers)
    whole = _joined([s for s, _ in plain], known, joins)
    return [_finish(s, table, furnished, broken) for (_, furnished), (s, broken), table in zip(plain, whole, known)]


def _finish(s: str, known: Known, furnished: bool, broken: bool) -> tuple[str, list[str], int, list[str]]:
    """Spaced words, stray marks, misread words and paragraphs of a text whose lines are repaired."""
    kinds = {k for k, there in (("furniture", furnished), ("hyphen", broken)) if there}
    if SPACED.search(s):
        kinds.add("spaced")
        s = SPACED.sub(lambda m: m.group().replace(" ", ""), s)
    if (any(c in s for c in "|~¬^") or " . " in s) and STRAY.search(s):
        # bars and tildes of tables, menus and lists come in pairs or among few words
        parts = s.split("\n")
        for k, line in enumerate(parts):
            if STRAY.search(line) and sum(line.count(c) for c in "|~^¬") <= 2 and len(line.split()) > 3 and line.count("|") < 2:
                kinds.add("stray")
                parts[k] = re.sub(r" +$", "", STRAY.sub(" ", line))
        s = "\n".join(parts)
    strong, weak = 0, set()

    def words(text: str, sure: bool) -> str:
        def word(m: re.Match) -> str:
            nonlocal strong
            w = m.group()
            core = w.strip(EDGE).rstrip("!")
            got = known.get(core.lower())
            if not got or not got[1] or got[2] != sure or len(core) < 3:
                return w
            fixed = got[1]
            if core.isupper():
                fixed = fixed.upper()
            elif core[:1].isupper():
                fixed = fixed[:1].upper() + fixed[1:]
            if sure and IMPOSSIBLE.search(core):
                strong += 1
            elif sure:
                weak.add(core.lower())
            return w.replace(core, fixed, 1)

        return WORD.sub(word, text) if any(fix and safe == sure for _, fix, safe in known.values()) else text

    s = words(s, True)
    if strong or weak:
        kinds.add("misread")
    if kinds - {"misread"} or strong or len(weak) > 2:
        s = words(s, False)
    # lines of a paragraph are joined unless the next starts a list, heading or table
    if kinds:
        paragraphs = re.split(r"\n\s*\n", s)
        s = "\n\n".join(re.sub(r"[ \t]*\n(?![ \t]*(?:[-*#|>]|\d+[.)] ))[ \t]*", " ", p).strip() for p in paragraphs)
    return s, sorted(kinds), strong, sorted(weak)


def _prefix(forms: DataFrame, posting: DataFrame) -> DataFrame:
    """The rarest q-grams of each form that hold at least one of any candidate with ``LEAST_SIMILAR``.

    A form and a candidate share at least ``need`` q-grams, whatever size the candidate has, so one of them
    is among all but ``need - 1`` of those the lexicon knows.  Both sides use the same order, so the rarest
    q-gram that they share is in the prefix of both.
    """
    order = Window.partitionBy("form").orderBy("posting", "gram")
    need = F.greatest(F.lit(1), F.ceil(F.lit(LEAST_SIMILAR) * (F.col("size") - SIZE_GAP)))
    ranked = forms.join(posting, "gram").withColumn("rn", F.row_number().over(order)).withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("form")))
    return ranked.where(F.col("rn") <= F.col("known") - need + 1).select("form", "n", "gram", "size")


def _candidates(rare: DataFrame, lex: DataFrame) -> DataFrame:
    """``(noisy, n_noisy, clean, n_clean)``: every pair of about the same size that has ``LEAST_SIMILAR``, and some others.

    The candidate is the more frequent one.  The join key is q-gram and size, so a posting list holds words
    of one length only and a frequent q-gram is no hot key.
    """
    posting = lex.groupBy("gram").agg(F.count(F.lit(1)).alias("posting"))
    sizes = F.explode(F.sequence(F.col("size") - SIZE_GAP, F.col("size") + SIZE_GAP))
    noisy = _prefix(rare, posting).select(F.col("form").alias("noisy"), F.col("n").alias("n_noisy"), "gram", sizes.alias("size"))
    clean = _prefix(lex, posting).withColumnRenamed("form", "clean").withColumnRenamed("n", "n_clean")
    return (
        noisy.join(clean, ["gram", "size"])
        .where((F.col("n_clean") > F.col("n_noisy")) & (F.abs(F.length("noisy") - F.length("clean")) <= SIZE_GAP))
        .select("noisy", "n_noisy", "clean", "n_clean")
        .distinct()
    )


def _substitution(noisy: str, clean: str) -> str | None:
    """``"o>c"`` where the two differ in one letter inside the word."""
    if len(noisy) != len(clean):
        return None
    at = [k for k in range(len(noisy)) if noisy[k] != clean[k]]
    return f"{clean[at[0]]}>{noisy[at[0]]}" if len(at) == 1 and 0 < at[0] < len(noisy) - 1 and noisy[at[0]].isalpha() and clean[at[0]].isalpha() else None


def _corrections(forms: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``(form, fix, sure)``, and a bounded sample of frequent words to train from.

    A correction is sure if its edits are listed confusions.  One unlisted substitution is learned as a
    confusion of this corpus if it explains a share of ``LEARNED_EDIT`` of all forms that one explains.
    """
    plain = F.col("form").rlike(r"^[\p{L}]+(?:['’-][\p{L}]+)*$") & ~F.col("form").rlike("[ſﬁﬂﬀ]")
    frequent = forms.where(plain & (F.col("n") >= MIN_COUNT))
    sample = [(r[0], r[1]) for r in frequent.orderBy(F.col("n").desc(), "form").limit(TRAIN_WORDS).collect()]
    ranker = train_ranker([x for x in sample if len(x[0]) > 2])
    schema = "form string, n long, gram string, size int"
    lex = materialize(frequent.select("form", "n").mapInArrow(_emit_grams, schema), "lexicon")
    rare = forms.where(F.col("form").rlike(r"\p{L}") & (F.length("form") > 2)).select("form", "n").mapInArrow(_emit_grams, schema)
    pairs = _candidates(rare, lex)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, feats = [], []
            for a, na, b, nb in zip(*(c.to_pylist() for c in batch.columns)):
                edit = _substitution(a, b)
                if edit is None:
                    ga, gb = set(grams(a)), set(grams(b))
                    if len(ga & gb) < LEAST_SIMILAR * max(1, min(len(ga), len(gb))) and skeleton(a) != skeleton(b):
                        continue
                f = word_features(a, na, b, nb)
                if f[0] > 3 or f[1] > (edit is not None and f[0] == 0):
                    continue
                rows.append((a, b, edit if f[1] else None))
                feats.append(f)
            p = ranker.predict(np.array(feats)) if feats else np.zeros(0)
            keep = [k for k, v in enumerate(p) if v >= ACCEPT]
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][j] for k in keep], pa.string()) for j in range(3)] + [pa.array([float(p[k]) for k in keep], pa.float64())], names=["form", "fix", "edit", "score"])

    ranked = materialize(pairs.mapInArrow(rank, "form string, fix string, edit string, score double"), "ranked")
    edits = ranked.where("edit IS NOT NULL").groupBy("edit").agg(F.count_distinct("form").alias("n"))
    total = edits.agg(F.sum("n")).first()[0] or 0
    learned = edits.where(F.col("n") >= max(2.0, LEARNED_EDIT * total)).select("edit", F.lit(True).alias("learned"))
    usable = ranked.join(learned, "edit", "left").where("edit IS NULL OR learned").withColumn("sure", F.col("edit").isNull())
    best = usable.groupBy("form").agg(F.max_by(F.struct("fix", "sure"), F.struct("sure", "score", "fix")).alias("b"))
    return best.select("form", "b.fix", "b.sure"), sample


SCHEMA = "record_table string, record_id long, kinds array<string>, strong int, weak array<string>, clean string"


def _asked_bits(best: DataFrame) -> np.ndarray:
    """Bit map of all forms with a correction, combined on the map side: at most ``2**(BITMAP_BITS - 6)`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([_bit(f) for f in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bits"])

    words = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    for r in best.select("form").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[r["word"]] = r["bits"]
    return words.astype("<i8").view(np.uint8)


def repair_scans(records: DataFrame) -> DataFrame:
    """``(record_table, record_id, kinds, strong, weak, clean)`` for every row of ``records``.

    ``records`` has ``record_table``, ``record_id`` and ``text``; null texts give null and no kinds.
    ``kinds`` may hold ``hyphen``, ``furniture``, ``misread``, ``spaced`` and ``stray``.  Forms are counted
    over distinct texts.
    """
    spark = records.sparkSession
    rows = materialize(records.select("record_table", F.col("record_id").cast("long").alias("record_id"), "text"), "scan-texts")
    texts = rows.where("text IS NOT NULL").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("c")).agg(F.first("text").alias("text"))
    forms = materialize(texts.select("text").mapInArrow(_emit_forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")), "forms")
    best, sample = _corrections(forms)
    best = materialize(best, "corrections")
    words = [w for w, _ in sample if len(w) > 2]
    models = (train_furniture(words), train_headers(words), train_joins([x for x in sample if len(x[0]) > 1]))
    shared = spark.sparkContext.broadcast((_asked_bits(best), models))  # 2**BITMAP_BITS bits and three small forests

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, i, f = [], [], []
            for table, rid, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    for form in lookups(text, shared.value[0]):
                        t.append(table)
                        i.append(rid)
                        f.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(i, pa.int64()), pa.array(f, pa.string())], names=["record_table", "record_id", "form"])

    asked = rows.mapInArrow(ask, "record_table string, record_id long, form string").distinct()
    answers = forms.join(best, "form", "left").select("form", F.col("n").alias("c"), "fix", "sure")
    # a half of broken words ("the") may be asked by a third of all records
    known = salted_join(asked, answers, ["form"], "inner", by="record_id").groupBy("record_table", "record_id").agg(F.collect_list(F.struct("form", "c", "fix", "sure")).alias("known"))

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, models = shared.value
        for batch in batches:
            texts, known = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            at = [k for k, t in enumerate(texts) if t is not None]
            tables = [{x["form"]: (x["c"], x["fix"], bool(x["sure"])) for x in known[k] or []} for k in at]
            out = [(None, [], 0, [])] * len(texts)
            for k, row in zip(at, repair_all([texts[k] for k in at], tables, *models)):
                out[k] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.list_(pa.string())), pa.array([x[0] for x in out], pa.string())],
                names=["record_table", "record_id", "kinds", "strong", "weak", "clean"],
            )

    return rows.join(known, ["record_table", "record_id"], "left").select("record_table", "record_id", "text", "known").mapInArrow(fix, SCHEMA)


def noisy_records(repaired: DataFrame) -> DataFrame:
    """``(record_table, record_id)`` of records with noise, each once.

    Noise is any line noise, stray or spaced letters, a replaced form that is impossible in clean text, or
    other replaced forms.  A replaced form that stands mostly in records without any other noise is a word
    of its own and no evidence (``PURITY``, counted over all distinct repaired texts, so copies make no
    difference; a form in a single text needs no other noise).
    """
    kinds = F.col("kinds")
    marks = materialize(repaired.select("record_table", "record_id", "kinds", "strong", "weak", F.when(F.size("weak") > 0, F.xxhash64("clean")).alias("h")), "noise")
    line = F.array_contains(kinds, "hyphen") | F.array_contains(kinds, "furniture") | F.array_contains(kinds, "spaced") | F.array_contains(kinds, "stray") | (F.col("strong") > 0)
    words = marks.where(F.size("weak") > 0).select("record_table", "record_id", "h", (line | (F.size("weak") > 2)).cast("int").alias("other"), F.explode("weak").alias("form"))
    stats = words.groupBy("form", "h").agg(F.max("other").alias("other")).groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.sum("other").alias("m"))
    real = stats.where(F.col("m") + 1 >= PURITY * (F.col("n") + 2)).select("form")
    by_word = words.where("other = 0").join(real, "form", "left_semi").select("record_table", "record_id")
    return marks.where(line | (F.size("weak") > 2)).select("record_table", "record_id").unionByName(by_word).distinct()
