import pytest
from pyspark.sql import functions as F

from kelpline.llm import encoding as E
from kelpline.llm import markup as M
from kelpline.llm import residue as R
from kelpline.llm import scans as S

DOCS = "doc_id long, text string, source string, clean string, families int, h long, placeholder string"


def docs(spark, texts):
    """Documents with columns whose names clash with those the operators make; ids from 1."""
    return spark.createDataFrame([(i + 1, t, "s", "x", 1, 2, "y") for i, t in enumerate(texts)], DOCS)


# -- markup ----------------------------------------------------------------------------------------
MARKED = {
    "html": ["<p>One <b>two</b> three four</p>", "Fish &amp; chips", "text<br>more", "<DIV CLASS='x'>y</DIV>", "a<!-- note -->b"],
    "markdown": ["# Title\n\ntext", "some **bold** word", "an _italic_ one", "see [this](/a/b) page", "use `code` here", "```\nx = 1\n```", "Title\n=====\n\ntext", "- a\n- b", "> quoted", "| a | b |\n|---|---|\n| 1 | 2 |", "~~gone~~", "---\ntitle: x\n---\ntext"],
    "wiki": ["==Head==\ntext", "a [[Page|label]] b", "'''bold''' text", "x {{citation needed|date=2020}}", "y {{stub}}", '{| class="w"\n|-\n| a || b\n|}', "a<ref>b</ref>", "__NOTOC__ x", "#REDIRECT [[X]]"],
    "latex": ["\\section{Intro} text", "\\emph{word} here", "Gr\\\"o\\ss{}e", "so $x_{i} > 0$ holds", "\\begin{itemize}\\item a\\end{itemize}", "$$\\sum x$$", "5\\% of \\textbf{it}"],
}
PLAIN = [
    "", "   ", "Keep a < b and c > d here.", "The product 3 * 4 * 5 is 60.", "Set C:\\temp\\new\\index, then D:\\begin\\again.", "The pattern **/*.md is read before docs/**/*.txt here.", "A box costs $5 and a crate $7.",
    "The guard if [[ -f state ]] then stops.", "rows[3] and {key: value}", "The names chunk_size_limit and max_page_count.", "Use Vec<String>, not Option<&str>.", "R&D and Q&A share it.", "Ticket #30 and C# and F#.", "See note [12].",
    "Dear {{ item.title }}, your [[amount]] and ${name} of <your title here> in {company_name} by %(x)s.", "parse_row(row, window=5)", "2020-01-02 10:00:00 INFO row: x", "~ 12 ~", "- 24 -", "1. only one",
]


@pytest.mark.parametrize("family,text", [(f, t) for f, ts in MARKED.items() for t in ts])
def test_markup_is_found(family, text):
    clean, kinds = M.convert(text)
    assert kinds and (family in kinds or family == "wiki" and "html" in kinds), kinds


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    assert M.convert(text) == (text, [])


def test_structure_is_kept():
    clean, _ = M.convert("# Title\n\nSome **bold** text with $a^2$.\n\n- one\n- two\n\n```py\n**x**\n```\n\n$$\n\\frac{1}{2}\n$$\n")
    assert clean == "# Title\n\nSome bold text with $a^2$.\n\n- one\n- two\n\n```\n**x**\n```\n\n$$\n\\frac{1}{2}\n$$"
    clean, _ = M.convert("<html><head><title>t</title></head><body><nav>a</nav><h2>Head</h2><p>" + "long text " * 20 + "</p><ul><li>x<li>y</ul><pre>if a:\n  b</pre></body></html>")
    assert "## Head" in clean and "- x" in clean and "```\nif a:\n  b\n```" in clean and "<" not in clean
    clean, _ = M.convert("\\section{A}\nText \\emph{b} and \\textbf{c d}.\n\\begin{verbatim}\n\\x{1}\n\\end{verbatim}")
    assert "# A" in clean and "Text b and c d." in clean and "```\n\\x{1}\n```" in clean
    assert M.convert("Gr\\\"un \\'el\\'eve \\ss{}")[0].startswith("Grün éléve ß")


PAGE = """<html><body><ul class="nav"><li><a href="/">Home</a></li><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul>
<h1>The weir</h1><p>The weir was built by the parish in the first year of the drought, and it was rebuilt after the second one.</p>

<p>Agreed.</p>

<p>The committee then asked for a survey of the banks, which took the better part of the summer to finish.</p>
<h2>Parts</h2><ul><li>gate</li><li>sill</li></ul><p>All parts were painted before the winter, some of them twice, and the bill was paid by the county.</p>
<p>x5 + yi</p><table><tr><td>crates</td><td>95</td></tr></table><footer><p>Copyright 2020 Weir Board and all its members in the county and beyond, in print and on the screen, all rights reserved.</p></footer><div>Last change 2020</div><div><a href="/i">Imprint</a> | <a href="/p">Privacy</a></div></body></html>"""


def test_page_furniture_is_dropped_by_surge_and_dive():
    clean, kinds = M.convert(PAGE)
    for word in ("Home", "About", "Contact", "Copyright", "Last change", "Imprint", "Privacy"):
        assert word not in clean, clean
    for word in ("# The weir", "built by the parish", "Agreed.", "survey of the banks", "## Parts", "- gate", "- sill", "paid by the county.", "x5 + yi", "crates | 95"):
        assert word in clean, clean
    # a fragment, or plain text with one entity, has no furniture
    assert M.convert("Short.\n\n\nFish &amp; chips were served to the whole of the committee after the survey.")[0].startswith("Short.")
    assert M.convert("<p>Long enough to be a paragraph of its own in any text.</p>\n\n<p>はい。</p>\n\n<p>Long enough to be a paragraph of its own.</p>")[0].count("はい。") == 1


def test_markup_edge_cases(spark):
    df = docs(spark, [None, "", "x" * 300_000 + " **b**", "**b**", "**b**", "<" * 3000, "'''" * 2000, "[" * 3000, "{{" * 2000, "$" * 3001])
    out = M.clean_markup(df, keep=("doc_id",)).orderBy("doc_id").collect()
    assert [r["clean"] for r in out][:2] == [None, ""] and out[0]["families"] == [] and out[2]["clean"].endswith(" b") and out[3]["clean"] == out[4]["clean"] == "b"
    assert len(out) == 10 and M.clean_markup(df.limit(0), keep=("doc_id",)).count() == 0


# -- residue ---------------------------------------------------------------------------------------
def test_placeholders_by_alignment(spark):
    names = ["{{first_name}}", "[Your Name]", "$NAME$", "<your title here>", "XX/XX/XXXX", "%(subject)s"]
    texts = [f"Dear {n}, your copy of {m} is ready for collection." for n in names for m in names]
    about = ["The template variable {{ title }} is replaced by the first heading.", "In a letter template, write ${name} where the reader belongs.", "the map {key: value} holds it", None, "", "   ", "plain"]
    out = {r["doc_id"]: r for r in R.template_residue(docs(spark, texts + about * 3)).collect()}
    assert set(out) == set(range(1, len(texts) + 1)) and all(r["placeholder"] for r in out.values())


PAGES = ["Error 404: Not Found. The page you asked for does not exist or has been moved.", "Menu\nHome\nProducts\nHTTP 502: Bad Gateway\nKind: status page\nDetail: The upstream server sent an invalid response.", "Please enable JavaScript to view this page.\nBack to start", "Care of things\nJavaScript is blocked. We cannot show the list.", "Lorem ipsum dolor sit amet consectetur elit", "Caption placeholder\nReplace this caption with your own words.", "xxxxx xxxx xxxxxxx xx", "asdf asdf jkl asdf qwer"]
ABOUT = ["The proxy logs “502 Bad Gateway” when the hoist skips a bearing, and our trainee reads it.", "If JavaScript is switched off in the viewer, the belt guard still records a housing.", "We use lorem ipsum only in the layout tests, never in the guide rail.", "Page not found errors fell by 7 percent after the retry loop was replaced.", "A 404 answer only means that the walker could not find an entry."]


def test_whole_pages(spark):
    out = {r["doc_id"] for r in R.template_residue(docs(spark, PAGES + ABOUT)).collect()}
    assert out == set(range(1, len(PAGES) + 1))
    assert {r["doc_id"] for r in R.without_residue(docs(spark, PAGES + ABOUT)).collect()} == set(range(len(PAGES) + 1, len(PAGES + ABOUT) + 1))


def test_pages_of_any_length(spark):
    lorem = "Lorem ipsum dolor sit amet consectetur elit"
    texts = ["\n".join([lorem] * 41), "\n".join(f"{lorem} {i}" for i in range(400)), " ".join(["This is sample text to be replaced."] * 9), "Page not found\n" + "\n".join(["The requested page does not exist."] * 60)]
    real = ["\n".join([lorem] * 41 + ["The hoist was greased on Monday by two fitters from the yard."])]
    assert {r["doc_id"] for r in R.template_residue(docs(spark, texts + real)).collect()} == {1, 2, 3, 4}


def test_lines_are_learned_from_pages(spark):
    """A line that stands on error pages only is one, even on a page with no known line."""
    line = "We looked everywhere but nothing lives at this location."
    taught = [f"Error 404: Not Found\n{line}\nRequest id {k}" for k in range(7)]
    texts = taught + [line, "The hoist was greased on Monday.", f"{line} The hoist was greased on Monday."]
    assert {r["doc_id"] for r in R.template_residue(docs(spark, texts)).collect()} == set(range(1, 9))


def test_slots_by_filled_records_and_single_places(spark):
    texts = ["Dear [Name], your copy is ready.", "Dear Anna, your copy is ready.", "Dear Mr Bell, your copy is ready."]
    alone = ["The policy {{policy_code}} covers all sheds."] * 50  # one place, copied
    about = ["The template variable {{ title }} is replaced by the first heading."] * 50 + ["See [sic] in the list of authors."]
    assert {r["doc_id"] for r in R.template_residue(docs(spark, texts + alone + about)).collect()} == {1, *range(4, 54)}
    # nothing to align with, and a form that may be anything
    assert R.template_residue(docs(spark, [texts[0]])).count() == 0


def test_residue_edge_cases(spark):
    assert R.template_residue(docs(spark, []).limit(0)).count() == 0
    long = docs(spark, [None, " ".join(f"The {a}{b}{c} walks." for a in "abcdefghijklmnop" for b in "aeiouy" for c in "bcdfghjklmnpqrstvwxz" for _ in range(15)), PAGES[0], PAGES[0]])
    twice = long.unionByName(long)
    assert sorted(r["doc_id"] for r in R.template_residue(twice).collect()) == [3, 4]


# -- encoding --------------------------------------------------------------------------------------
CLEAN = ["Le contrôleur a vérifié la scène près de l’entrée, côté forêt.", "Après la réunion, la mairie a noté une différence de pièces.", "Señora Quiñel’s résumé lists “a caption” twice…", "Der Prüfer hat die Gebührenliste am späten Nachmittag geöffnet.", "Während der Prüfung blieb das Wörterbuch gültig und vollständig.", "The café behind the naïve façade stayed — costs £5 or €7."]


def garble(text, written, read):
    raw = text.encode(written)
    table = {b: c for c, b in reversed(list(E._table(read).items()))}
    return "".join(table[b] for b in raw)


def test_restore_inverts_reading():
    for written, read in (("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("utf-8", "latin-1")):
        for t in CLEAN:
            assert E.restore(garble(t, written, read), read, written) == t


def test_encoding_repair(spark):
    clean = [f"{t} ({i})" for i in range(12) for t in CLEAN]
    bad = [garble(t, "utf-8", "cp1252") for t in CLEAN] + [garble(t, "utf-8", "mac_roman") for t in CLEAN[:3]]
    part = CLEAN[0].replace("vérifié", garble("vérifié", "utf-8", "cp1252"))
    twice = garble(garble(CLEAN[4], "utf-8", "cp1252"), "utf-8", "cp1252")
    lossy = CLEAN[3].replace("ü", "�")
    mention = "A reader who sees Ã© instead of é should tell us."
    texts = clean + bad + [part, twice, lossy, mention, None, "", "plain ascii"]
    out = {r["doc_id"]: r for r in E.repair_encoding(docs(spark, texts)).collect()}
    n = len(clean)
    assert not any(out[i]["garbled"] for i in range(1, n + 1))
    for k, want in enumerate(CLEAN + CLEAN[:3] + [CLEAN[0], CLEAN[4]]):
        assert out[n + 1 + k]["garbled"] and out[n + 1 + k]["restored"] == want, out[n + 1 + k]
    rest = [out[n + len(bad) + k] for k in range(3, 8)]
    assert rest[0]["garbled"] and rest[0]["lossy"] and [r["garbled"] for r in rest[1:]] == [False] * 4 and rest[2]["restored"] is None


def test_lost_characters_and_mentions(spark):
    """``?`` for lost characters shows beside a clean twin only; a mark that stands alone is a mention."""
    lossy = ["Der Pr?fer hat die Geb?hrenliste am sp?ten Nachmittag ge?ffnet.", "W�hrend der Pr�fung blieb das W�rterbuch g�ltig und vollst�ndig."]
    fine = ["What is page?id=3 for, asked the reader of the list.", "A box with � means that the reader found no letter.", "Was it? The list?"]
    out = {r["doc_id"]: r for r in E.repair_encoding(docs(spark, [f"{t} {i}" for i in range(3) for t in CLEAN] + lossy + fine)).collect()}
    n = len(CLEAN) * 3
    assert [out[n + 1 + k]["garbled"] for k in range(5)] == [True, True, False, False, False]
    assert out[n + 1]["lossy"] and out[n + 1]["restored"] == CLEAN[3] and out[n + 2]["restored"] == CLEAN[4]


def test_cyrillic_without_votes(spark):
    """Cyrillic leaves no skeleton to find a twin by; its code pages are tried and judged by character pairs."""
    clean = ["Следующий запрос не может быть выполнен без разрешения старшего мастера.", "Бригада вернула ключ на склад и записала время в журнал.", "В отчёте указано, что работа началась вовремя и без задержек."]
    bad = [garble(clean[0], "cp1251", "cp1252"), garble(clean[1], "koi8-r", "cp1251"), garble(clean[2], "cp866", "cp1251")]
    out = {r["doc_id"]: r for r in E.repair_encoding(docs(spark, [f"{t} {i}" for i in range(15) for t in clean] + bad)).collect()}
    assert [out[46 + k]["restored"] for k in range(3)] == clean and not any(out[k]["garbled"] for k in range(1, 46))


def test_garbled_copies_outnumber_the_clean_text(spark):
    bad = [garble(t, "utf-8", "cp1252") for t in CLEAN]
    out = {r["doc_id"]: r for r in E.repair_encoding(docs(spark, [f"{t} ({i})" for i in range(4) for t in CLEAN] + bad * 9)).collect()}
    n = len(CLEAN) * 4
    assert all(out[n + 1 + k]["restored"] == CLEAN[k % len(CLEAN)] for k in range(len(bad) * 9)) and not any(out[k]["garbled"] for k in range(1, n + 1))


def test_encoding_edge_cases(spark):
    assert E.repair_encoding(docs(spark, []).limit(0)).count() == 0
    out = E.repair_encoding(docs(spark, [None, "é" * 200_000, "\xa0", "日本語のテキスト" * 1000])).collect()
    assert len(out) == 4 and not any(r["garbled"] for r in out)


# -- scans -----------------------------------------------------------------------------------------
BASE = ["the records group keeps the missing plate near the boat shed and compares it in most cases", "there are three reasons to check the printed supplement before the weekly review begins", "the older rule still applied because nobody had read the margin notes of the registry"]


def records(spark, texts):
    return spark.createDataFrame([("documents", i + 1, t, "z") for i, t in enumerate(texts)], "record_table string, record_id long, text string, kinds string")


def test_scan_repair(spark):
    prose = [" ".join(BASE[(i + k) % 3] for k in range(3)) + "." for i in range(3)] * 14
    noisy = [
        "the records group keeps tbe rnissing plate near thc boat shed.", "there are three reasons to check the prin-\nted supplement before the weekly re\xad\nview begins.",
        "the older rule still applied because nobody had\n- 24 -\nread the margin notes of the registry.", "REPORT: THE PLATE . . . . 31\nthe records group keeps the missing plate\nnear the boat shed and compares it.", "the older ru1e still applied.",
    ]
    fine = ["the older rule\nstill applied because nobody\nhad read the margin notes.", "Contents\nthe margin notes ........ 2\nthe boat shed ........ 5\nthe weekly review ..... 9\n\nthe older rule still applied.", None, "", "plain"]
    rec = records(spark, prose + noisy + fine)
    out = {r["record_id"]: r for r in S.repair_scans(rec).collect()}
    found = {r["record_id"] for r in S.noisy_records(S.repair_scans(rec)).collect()}
    n = len(prose)
    assert found == set(range(n + 1, n + 1 + len(noisy)))
    assert out[n + 1]["clean"] == "the records group keeps the missing plate near the boat shed."
    assert out[n + 2]["clean"] == "there are three reasons to check the printed supplement before the weekly review begins."
    assert out[n + 3]["clean"] == "the older rule still applied because nobody had read the margin notes of the registry."
    assert "31" not in out[n + 4]["clean"] and out[n + 8]["clean"] is None


def test_headers_without_numbers():
    """A header that repeats between the lines is furniture; a repeated sentence, question mark or version line is not."""
    import random

    rng = random.Random(8)
    words = [w for b in BASE for w in b.split()]
    furniture, headers = S.train_furniture(words), S.train_headers(words)
    prose = lambda n: [" ".join(rng.choice(words) for _ in range(9)) for _ in range(n)]
    page = [*prose(4), "THE PARISH LEDGER", *prose(6), "THE PARISH LEDGER", *prose(5), "THE PARISH LEDGER", *prose(3)]
    apart = [*prose(4), "12", "", "THE PARISH LEDGER", *prose(6), "13", "", "THE PARISH LEDGER", *prose(5)]
    for lines in (page, apart):
        (clean, found), = S._without_furniture(["\n".join(lines)], furniture, headers)
        assert found and "PARISH" not in clean and clean.count("\n") >= 10
    same = "the older rule still applied in the margin notes"
    fine = ["\n".join([*prose(3), same, *prose(3), same]), "Q:\nthe rule?\nA: The\nnotes.\n\nQ:\nthe boat?\nA: The\nshed.", "Version 1.2.3 of 2020-01-02\nAdded: the rule.\n\nVersion 1.2.4 of 2020-03-02\nAdded: the shed."]
    assert [found for _, found in S._without_furniture(fine, furniture, headers)] == [False] * 3


def test_unlisted_confusions_are_learned(spark):
    """A letter for letter confusion that no table lists is repaired where it recurs and the page shows other noise."""
    import itertools

    stems = [a + b for a, b in itertools.product(("work", "port", "cord", "folk", "horn", "fort", "dolm"), ("shop", "man", "line", "ward"))]
    prose = [f"the {a} near the {b} was kept by the {c} until the weekly review" for a, b, c in zip(stems, stems[3:] + stems[:3], stems[7:] + stems[:7])] * 9
    prose = [f"{t} number {i}." for i, t in enumerate(prose)]
    noisy = [f"the {w.replace('o', 'x', 1)} was kept un-\ntil the weekly review." for w in stems[:12]]
    alone = ["the wxrkshop was kept until the weekly review."]
    out = {r["record_id"]: r for r in S.repair_scans(records(spark, prose + noisy + alone)).collect()}
    n = len(prose)
    fixed = sum(out[n + 1 + k]["clean"] == f"the {w} was kept until the weekly review." for k, w in enumerate(stems[:12]))
    assert fixed >= 10 and out[n + 13]["kinds"] == []


def test_broken_words_beside_lines_with_digits():
    assert [b[2:] for b in S.breaks("enough for the fin-\ning aid. 56 requests to set-\ntle it.")] == [("fin", "-", "ing"), ("set", "-", "tle")]
    assert {("fin", "ding"), ("fin", "page")} <= set(S.halves("the fin-\n12\nPage head\nding aid"))


def test_scan_edge_cases(spark):
    assert S.repair_scans(records(spark, []).limit(0)).count() == 0 and S.noisy_records(S.repair_scans(records(spark, []).limit(0))).count() == 0
    rec = records(spark, ["word " * 50_000, "x" * 200_000, None, "a-\nb", "-\n-", "\x0c"])
    assert S.repair_scans(rec.unionByName(rec)).count() == 12


def test_no_similar_candidate_is_lost(spark):
    """Confusions that spoil the rare q-grams of a form still leave its word among the candidates."""
    import random

    rng = random.Random(3)
    lexicon = sorted({a + b + c for a in ("wor", "ma", "pla", "stee", "orle", "hea") for b in ("k", "rl", "lee", "n", "d") for c in ("er", "eer", "ed", "ing", "le")} | {"worker", "sleeper"})
    noisy = ["worlcer"] + [S.corrupt(S.corrupt(w, rng), rng) for w in lexicon]
    schema = "form string, n long, gram string, size int"
    lex = spark.createDataFrame([(w, 500) for w in lexicon], "form string, n long").mapInArrow(S._emit_grams, schema)
    rare = spark.createDataFrame([(w, 2) for w in sorted(set(noisy))], "form string, n long").mapInArrow(S._emit_grams, schema)
    got = {(r["noisy"], r["clean"]) for r in S._candidates(rare, lex).collect()}
    gram = {w: set(S.grams(w)) for w in [*lexicon, *noisy]}
    want = {
        (a, b) for a in noisy for b in lexicon
        if abs(len(gram[a]) - len(gram[b])) <= 2 and abs(len(a) - len(b)) <= 2 and len(gram[a] & gram[b]) >= S.LEAST_SIMILAR * min(len(gram[a]), len(gram[b]))
    }
    assert ("worlcer", "worker") in want and want <= got
    # the four rarest known q-grams alone would have lost some
    posting = {g: sum(g in gram[b] for b in lexicon) for a in noisy for g in gram[a]}
    first = {a: set(sorted((g for g in gram[a] if posting[g]), key=lambda g: (posting[g], g))[:4]) for a in noisy}
    assert any(not first[a] & gram[b] for a, b in want)


def test_scan_copies_of_a_text_count_once(spark):
    """Copies of a text with one weak misreading are no evidence that it is a word; many distinct texts are."""
    rows = [("documents", i, ["misread"], 0, ["thc"], "the older rule still applied.") for i in range(9)]
    rows += [("documents", 100 + i, ["misread"], 0, ["fell"], f"the rate fell by {i}.") for i in range(9)]
    found = S.noisy_records(spark.createDataFrame(rows, S.SCHEMA)).collect()
    assert {r["record_id"] for r in found} == set(range(9))


def test_alignment_and_booster():
    assert S.align("rnodern", "modern") == (1, 0) and S.align("thc", "the") == (1, 0) and S.align("xhe", "the")[1] == 1 and S.align("same", "same") == (0, 0)
    import numpy as np

    from kelpline.llm.boosting import Boosted

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    p = Boosted().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.93


def test_scan_ranker_on_held_out_words():
    """Accuracy of the trained ranker on misreadings of words it was not trained on."""
    import random

    words = [w for b in BASE for w in b.split()] + "setting narrow expensive margin volume archive ledger faults careful temporary weather mountain harbour lantern curtain basket candle winter summer garden teacher kitchen".split()
    words = sorted({w for w in words if len(w) > 3})
    rng = random.Random(1)
    ranker = S.train_ranker([(w, 500) for w in words[::2]] * 6)
    good = bad = total = 0
    for w in words[1::2]:
        c = S.corrupt(w, rng)
        if c != w:
            total += 1
            good += ranker.predict(__import__("numpy").array([S.word_features(c, 2, w, 500)]))[0] > 0.5
            bad += ranker.predict(__import__("numpy").array([S.word_features(w + "s", 2, w, 500)]))[0] > 0.5
    assert good >= 0.8 * total and bad <= 0.2 * total


def test_markup_on_all_rows_is_one_scan(spark):
    plan = M.clean_markup(docs(spark, ["a"]), keep=("doc_id",)).where(F.size("families") > 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
