"""Garbled text from wrong character encoding: find the records and restore the original where possible.

Method, in three steps over all documents:

1. Sentences (digits masked) are grouped by their text stripped of non-ASCII characters and replacement
   marks.  In each group the most frequent form without marks is the near-twin of the others; one row per
   group is kept, so a form is joined with exactly one twin and no pairs within a group are made.  Sentences
   that keep fewer than ``MIN_LETTERS`` letters (other scripts) have no identifiable twin and are not joined.
2. Form and twin are aligned run by run between their ASCII characters.  A transformation (read as ``a``,
   written as ``b``) that turns every run of one into the other's run gets a vote, whichever of the two is
   the garbled one; transformations with enough votes are the learned mappings.  Forms that differ from
   their twin only by U+FFFD or ``?`` are lossy; their records are flagged and filled from the twin.
3. The learned mappings are applied to the remaining records: those from UTF-8 word by word, up to twice
   for text that was garbled twice, the others (where any byte has some meaning) to whole sentences.  A
   result is accepted if the corpus' character pairs (a fixed-size table of counts over all documents)
   make it more likely than the text as it stands.

For scripts that leave nothing after stripping (Cyrillic, Japanese, Chinese) the encodings in ``UNVOTED``
are tried as well and judged by the character pairs alone.

A word that only mentions a sequence beside what it stands for is no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import materialize

# Encodings as public codec tables name them.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "cp852", "mac_roman", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "mac_latin2", "iso8859-5", "cp1254", "cp1257", "iso8859-15")
WRITTEN_AS = ("utf-8", "cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "koi8-r", "cp866", "iso8859-2", "cp1250", "iso8859-5", "mac_cyrillic", "cp852", "mac_latin2", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr")
MULTI = frozenset("utf-8 shift_jis euc_jp gbk big5 euc_kr".split())
#: votes a transformation needs, and the size of the table of character pairs (a bound on what is broadcast)
MIN_VOTES = 2
PAIR_BITS = 18
#: how much likelier (natural log per pair) a restored word must be
MARGIN = 0.9
UNVOTED = tuple((r, w) for w in ("shift_jis", "euc_jp", "gbk", "big5", "euc_kr") for r in ("cp1252", "latin-1"))
UNVOTED += tuple((r, w) for w in ("cp1251", "koi8-r", "cp866") for r in ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866") if r != w)
UNVOTED += tuple((r, "utf-8") for r in ("cp1251", "koi8-r", "cp866"))
#: ASCII letters that a sentence must keep for its twin to be found
MIN_LETTERS = 8
#: a sentence-wide mapping must improve this many character pairs at least
MIN_PAIRS = 2
LOST = "�"
LETTER = re.compile(r"[A-Za-z]")
DIGIT = re.compile(r"\d")
BLANK = re.compile(r"[ \t\n\r\f\v]+")
UNIT = re.compile(r"(?<=[.!?。…])\s+|\n+")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
MARK = re.compile(r"\?+(?=\w)|(?<=\s)\?(?=\s)|�+")
STRIP = re.compile(r"[^\x00-\x7f]+|\?+(?=\w)|(?<=\s)\?(?=\s)")
#: the same marks for a filter in the engine: only texts that hold one are joined with lossy sentences
MAY_BE_LOSSY = r"(?U)\?\w|\s\?\s|�"
_TABLES: dict[str, dict[str, int]] = {}


def _table(enc: str) -> dict[str, int]:
    """Characters to bytes; bytes that a code page leaves open map to the C1 controls, as readers do."""
    if enc not in _TABLES:
        table = {}
        for b in range(256):
            try:
                c = bytes([b]).decode(enc)
            except UnicodeDecodeError:
                c = chr(b)
            table.setdefault(c, b)
        for b in range(128, 160):
            table.setdefault(chr(b), b)
        _TABLES[enc] = table
    return _TABLES[enc]


def restore(text: str, read_as: str, written_as: str) -> str | None:
    """The text as it was before bytes in ``written_as`` were read as ``read_as``; None if impossible."""
    table = _table(read_as)
    try:
        raw = bytes([table[c] for c in text])
    except KeyError:
        return None
    try:
        out = raw.decode(written_as)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


def mask(unit: str) -> str:
    return re.sub(r"\d+", "0", unit).strip()


def units(text: str) -> list[str]:
    """Sentences with non-ASCII characters or lost marks, digits masked."""
    return [mask(u) for u in UNIT.split(text) if NON_ASCII.search(u) or MARK.search(u)]


def skeleton(unit: str) -> str:
    return STRIP.sub("", unit)


def fill(unit: str, twin: str) -> str | None:
    """``unit`` with its lost marks replaced by what the (masked) twin has there; None if they differ otherwise."""
    form = mask(unit)
    parts = MARK.split(form)
    if len(parts) < 2:
        return None
    m = re.fullmatch("(\\?+|[^\\x00-\\x7f]+)".join(re.escape(p) for p in parts), twin)
    if m is None or not any(NON_ASCII.search(g) and LOST not in g for g in m.groups()) or len(MARK.findall(unit)) != len(m.groups()):
        return None
    runs = iter(m.groups())
    return MARK.sub(lambda _: next(runs), unit)


def explain(form: str, twin: str, memo: dict) -> frozenset[tuple[str, str]]:
    """Transformations that turn every non-ASCII run of ``form`` into the twin's run at the same place."""
    # a run of the form may hold ASCII-free neighbours only; both share the ASCII text, so runs align by position
    a, b = [], []
    for text, out in ((form, a), (twin, b)):
        pos = 0
        for m in NON_ASCII.finditer(text):
            out.append((m.start() - pos, m.group()))
            pos += len(m.group())
    if len(a) != len(b) or any(x[0] != y[0] for x, y in zip(a, b)):
        return frozenset()
    left: frozenset | None = None
    for (_, x), (_, y) in zip(a, b):
        if x == y:
            continue
        key = (x, y)
        got = memo.get(key)
        if got is None:
            got = frozenset((r, w) for w in WRITTEN_AS for r in READ_AS if r != w and restore(x, r, w) == y)
            if len(memo) < 200_000:
                memo[key] = got
        left = got if left is None else left & got
        if not left:
            return frozenset()
    return left or frozenset()


def _emit_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            if text:
                for u in units(text):
                    count[u] = count.get(u, 0) + 1
        forms = [u for u in count if len(LETTER.findall(skeleton(u))) >= MIN_LETTERS]
        keys = [xxhash.xxh64_intdigest(skeleton(u)) - (1 << 63) for u in forms]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(forms, pa.string()), pa.array([MARK.search(u) is None for u in forms], pa.bool_()), pa.array([count[u] for u in forms], pa.int64())],
            names=["key", "form", "whole", "n"],
        )


EVIDENCE = "read_as string, written_as string, form string, twin string, votes long"


def _emit_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes for transformations, and lossy forms with their twins."""
    memo: dict = {}
    for batch in batches:
        votes: dict[tuple, int] = {}
        for form, twin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if fill(form, twin) is not None:
                votes[None, None, form, twin] = 1
                continue
            for read_as, written_as in explain(form, twin, memo) or explain(twin, form, memo):
                key = (read_as, written_as, None, None)
                votes[key] = votes.get(key, 0) + 1
        rows = list(votes)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)] + [pa.array([votes[r] for r in rows], pa.int64())], names=["read_as", "written_as", "form", "twin", "votes"])


def _pair_bucket(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA6B) >> 5 & ((1 << PAIR_BITS) - 1)


def _pairs(word: str) -> list[int]:
    """Buckets of the character pairs of a word that hold a non-ASCII character; letters in lower case."""
    low = " " + DIGIT.sub("0", word.lower()) + " "
    return [_pair_bucket(a, b) for a, b in zip(low, low[1:]) if a > "\x7f" or b > "\x7f"]


def _emit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(1 << PAIR_BITS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and not text.isascii():
                seen: set[int] = set()
                for word in set(BLANK.split(text)):
                    if not word.isascii():
                        seen.update(_pairs(word))
                count[list(seen)] += 1
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])], names=["bucket", "n"])


def learn(documents: DataFrame, text: str = "text", min_votes: int = MIN_VOTES) -> tuple[list[tuple[str, str, int]], np.ndarray, DataFrame]:
    """Learned transformations with their votes, log counts of character pairs, and ``(form, twin)`` of lossy forms.

    The first two are small by construction: at most ``len(READ_AS) * len(WRITTEN_AS)`` rows and
    ``2**PAIR_BITS`` numbers.  All are counted over all distinct texts, so copies of a garbled text weigh nothing.
    """
    t = F.col(text)
    texts = documents.where(t.isNotNull()).groupBy(F.xxhash64(t).alias("h"), F.length(t).alias("c")).agg(F.first(t).alias("text")).select("text")
    forms = texts.mapInArrow(_emit_units, "key long, form string, whole boolean, n long").groupBy("key", "form", "whole").agg(F.sum("n").alias("n"))
    forms = materialize(forms, "forms")
    twins = forms.groupBy("key").agg(F.max_by("form", F.struct("whole", "n", "form")).alias("twin"), F.count(F.lit(1)).alias("forms")).where("forms > 1")
    pairs = salted_join(forms, twins, ["key"], "inner", by="form").where("form <> twin").select("form", "twin")
    evidence = materialize(pairs.mapInArrow(_emit_evidence, EVIDENCE), "evidence")
    votes = evidence.where("form IS NULL").groupBy("read_as", "written_as").agg(F.sum("votes").alias("votes"))
    learned = sorted(((r[0], r[1], r[2]) for r in votes.collect() if r[2] >= min_votes), key=lambda r: (-r[2], r[0], r[1]))
    table = np.zeros(1 << PAIR_BITS, np.float64)
    for r in texts.mapInArrow(_emit_pairs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r[0]] = r[1]
    return learned, np.log(table + 0.25).astype(np.float32), evidence.where("form IS NOT NULL").select("form", "twin").dropDuplicates(["form"])


class Restorer:
    """Applies learned transformations: those from UTF-8 to words, the others to sentences."""

    def __init__(self, learned: list[tuple[str, str, int]], pairs: np.ndarray, margin: float = MARGIN):
        known = {(r, w) for r, w, _ in learned}
        every = [(r, w) for r, w, _ in learned] + [x for x in UNVOTED if x not in known]
        self.wide, self.narrow = [x for x in every if x[1] == "utf-8"], [x for x in every if x[1] != "utf-8"]
        self.pairs, self.margin = pairs, margin
        self.words: dict[str, tuple[str, str] | None] = {}
        self.gains: dict[str, tuple[np.ndarray, int, float]] = {}

    def score(self, word: str) -> float:
        at = _pairs(word)
        return float(self.pairs[at].mean()) if at else float(self.pairs.max())

    def word(self, word: str) -> tuple[str, str] | None:
        """``(restored, transformation)`` of a word whose UTF-8 was read wrongly, or None."""
        if word not in self.words:
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[word] = self._word(word)
        return self.words[word]

    def _word(self, word: str) -> tuple[str, str] | None:
        # UTF-8 hardly decodes by chance, so any result that is no less likely than the word is taken
        best, best_score, how = None, self.score(word) - 0.1, ""
        tried = {word}
        frontier = [(word, "")]
        for _ in range(2):
            nxt = []
            for w, h in frontier:
                for read_as, written_as in self.wide:
                    r = restore(w, read_as, written_as)
                    if r is None or r in tried or _unfit(r):
                        continue
                    tried.add(r)
                    name = f"{h}{'+' if h else ''}{written_as}>{read_as}"
                    s = self.score(r)
                    if s > best_score:
                        best, best_score, how = r, s, name
                    if not r.isascii():
                        nxt.append((r, name))
            frontier = nxt
        return (best, how) if best is not None else None

    def _gain(self, word: str) -> tuple[np.ndarray, int, float]:
        """Gain in summed log counts under each sentence-wide transformation (NaN: impossible), pairs, and the greatest gain."""
        if word not in self.gains:
            if len(self.gains) > 200_000:
                self.gains.clear()
            base, n = self.score(word), len(_pairs(word))
            out = np.full(len(self.narrow), np.nan, np.float32)
            for k, (read_as, written_as) in enumerate(self.narrow):
                r = restore(word, read_as, written_as)
                if r is None:
                    if written_as not in MULTI and all(c in _table(read_as) for c in word):
                        out[k] = 0.0
                elif not _unfit(r):
                    out[k] = (self.score(r) - base) * n
            self.gains[word] = (out, n, float(np.nanmax(out, initial=0.0)))
        return self.gains[word]

    def sentence(self, words: list[str]) -> tuple[str, str] | None:
        """The transformation that makes the non-ASCII words of a sentence likelier, or None."""
        if not self.narrow:
            return None
        rows = [self._gain(w) for w in words]
        if sum(top for _, _, top in rows) < 3 * self.margin:  # no transformation can gain enough
            return None
        gains = np.stack([g for g, _, _ in rows])
        n = np.array([m for _, m, _ in rows], np.float32)
        possible = ~np.isnan(gains)
        weight = possible.T @ n
        total = np.nansum(gains, axis=0)
        mean = np.where(weight > 0, total / np.maximum(weight, 1), -9)
        better = (np.nan_to_num(gains, nan=0.0) > 0).T @ n
        ok = (mean >= self.margin) & (weight >= 0.7 * n.sum()) & (better >= 0.6 * weight) & (weight >= MIN_PAIRS) & (total >= 3 * self.margin)
        if not ok.any():
            return None
        return self.narrow[int(np.argmax(np.where(ok, total, -1e9)))]


def _unfit(text: str) -> bool:
    """Does a result hold control or private characters that no original had?"""
    return any(c < " " or "\x7f" <= c < "\xa0" or "\ue000" <= c <= "\uf8ff" or "\u2500" <= c <= "\u25ff" for c in text)


def _lost(text: str) -> bool:
    """Does the text hold marks of lost characters?  A single one that stands alone is a mention."""
    n = text.count(LOST)
    return n > 1 or n == 1 and re.search(r"\w�|�\w", text) is not None


def repair(text: str, r: Restorer, lossy: dict[str, str] | None = None) -> tuple[str, bool, bool, list[str]]:
    """``(restored text, garbled, lossy, transformations)``; ``lossy`` holds lossy (masked) sentences and their twins."""
    if text.isascii() and not lossy:
        return text, False, False, []
    lost = _lost(text)
    broken = lost or re.search(r"[\x80-\x84\x86-\x9f]", text) is not None
    out, hits, names = [], [], {}
    whole = set(BLANK.split(text))
    pos = 0
    spans = [m.span() for m in UNIT.finditer(text)] + [(len(text), len(text))]
    for start, end in spans:
        unit, gap = text[pos:start], text[start:end]
        pos = end
        if lossy and (twin := lossy.get(mask(unit))) is not None and (filled := fill(unit, twin)) is not None:
            out.append(filled + gap)
            lost = broken = True
            names["twin"] = names.get("twin", 0) + 1
            continue
        if unit.isascii():
            out.append(unit + gap)
            continue
        parts = re.split(r"([ \t\n\r\f\v]+)", unit)
        rest = []
        for k, p in enumerate(parts):
            if p.isascii():
                continue
            got = r.word(p)
            if got is None and LOST in p:
                continue
            if got is None:
                rest.append(k)
            else:
                hits.append((p, got[0]))
                names[got[1]] = names.get(got[1], 0) + 1
                parts[k] = got[0]
        if rest:
            found = r.sentence([parts[k] for k in rest])
            if found is not None:
                name = f"{found[1]}>{found[0]}"
                for k in rest:
                    fixed = restore(parts[k], *found)
                    if fixed is not None:
                        hits.append((parts[k], fixed))
                        names[name] = names.get(name, 0) + 1
                        parts[k] = fixed
        out.append("".join(parts) + gap)
    # a lone sequence beside the very character it stands for is a mention
    real = [(a, b) for a, b in hits if not (b in whole and len(b.strip(".,;:!?")) <= 2 and not re.search(r"[A-Za-z]", a.strip(".,;:!?")))]
    if not real and not broken:
        return text, False, False, []
    return "".join(out), True, lost, sorted(names, key=lambda k: (-names[k], k))


SCHEMA = "doc_id long, garbled boolean, lossy boolean, restored string, transformations array<string>"


def _emit_lossy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(i, u) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for u in units(text) if MARK.search(u)}
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([u for _, u in found], pa.string())], names=["doc_id", "form"])


def repair_encoding(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, garbled, lossy, restored, transformations)`` for every row of ``documents``.

    ``restored`` is the text itself where nothing was found, and keeps the marks of lost characters unless a
    twin fills them.  Null texts give null and no flag.  Repeated rows give repeated rows.
    """
    source = materialize(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "texts")
    learned, pairs, lossy = learn(source)
    pairs = source.sparkSession.sparkContext.broadcast(pairs)  # 2**PAIR_BITS floats
    # only texts with a mark that may stand for a lost character are joined with the lossy sentences
    marked = F.coalesce(F.col("text").rlike(MAY_BE_LOSSY), F.lit(False))
    asked = source.where(marked).mapInArrow(_emit_lossy, "doc_id long, form string")
    known = salted_join(asked, lossy, ["form"], "inner", by="doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("form", "twin")).alias("known"))
    rows = source.where(~marked).withColumn("known", F.lit(None).cast(known.schema["known"].dataType)).unionByName(source.where(marked).join(known, "doc_id", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(learned, pairs.value)
        for batch in batches:
            given = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rows = [(None, False, False, []) if t is None else repair(t, r, {x["form"]: x["twin"] for x in k} if k else None) for t, k in given]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in rows], pa.bool_()), pa.array([x[2] for x in rows], pa.bool_()), pa.array([x[0] for x in rows], pa.string()), pa.array([x[3] for x in rows], pa.list_(pa.string()))],
                names=["doc_id", "garbled", "lossy", "restored", "transformations"],
            )

    return rows.mapInArrow(run, SCHEMA)
