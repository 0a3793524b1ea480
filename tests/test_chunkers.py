import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpline.functions import chunkers as C
from kelpline.functions import text as X

WORDS = "alpha beta. gamma\n\ndelta\nepsilon zeta. eta".split(" ")


def texts():
    rng = random.Random(3)
    out = ["", "   ", "\n\n", "short", "x" * 95, None, " lead", "a. b. c", "\n\n\n\nabc\n\n" + "y" * 40]
    return out + ["".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "longerword" * 4, "é", "日本"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]


@pytest.mark.parametrize("size,overlap", [(30, 0), (30, 7), (12, 12), (10, 25), (1, 0)])
def test_native_forms_equal_the_plain_ones(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    rows = df.select("t", X.recursive_chunks(F.col("t"), size, overlap).alias("r"), X.fixed_chunks(F.col("t"), size, overlap).alias("f"), C.chunk(F.col("t"), "recursive", chunk_size=size, overlap=overlap).alias("a")).collect()
    for r in rows:
        t = r["t"] or ""
        assert r["r"] == C.recursive(t, size, overlap) == r["a"], repr(t)
        assert r["f"] == C.fixed(t, size, overlap), repr(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=80), st.integers(1, 12))
def test_recursive_keeps_every_character_but_separators(text, size):
    parts = C.recursive(text, size, 0)
    assert all(0 < len(p) <= size or p == text for p in parts)
    keep = lambda s: "".join(c for c in s if c in "ab")
    assert "".join(map(keep, parts)) == keep(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=60), st.integers(1, 9), st.integers(0, 12))
def test_windows_cover_the_text(text, size, overlap):
    parts = C.windows(text, size, overlap)
    step = size - overlap if size > overlap else size
    assert all(p == text[i * step : i * step + size] for i, p in enumerate(parts))
    assert (len(parts) - 1) * step + size >= len(text)


def test_merge_small(spark):
    assert C.merge_small(["a", "b", "c" * 10, "d"], 3) == ["a\n\nb", "c" * 10, "d"]
    got = spark.sql("SELECT array('a', 'b', 'cccccccccc', 'd') AS c").select(X.merge_small(F.col("c"), 3).alias("m")).first()[0]
    assert got == ["a\n\nb", "c" * 10, "d"]


MD = "---\ntitle: x\n---\n# One\n\nintro text here\n\n## Two\n\n```\n# not a header\n```\n" + "long words. " * 40 + "\n\n## Three\n\nend"


def test_markdown_sections_and_context():
    front, body = C.front_matter(MD)
    assert front.startswith("---") and body.startswith("# One")
    found = C.sections(body)
    assert [(s.level, s.title) for s in found] == [(1, "One"), (2, "Two"), (2, "Three")]
    assert C.breadcrumb(found, 1) == "# One" and C.breadcrumb(found, 0) == ""
    out = C.markdown(MD, 200, 0, 5)
    assert out[0] == front and all(len(c) <= 200 for c in out)
    assert any(c.startswith("[Context: # One]\n\n") for c in out)
    assert C.markdown("no headers at all", 50) == ["no headers at all"] and C.markdown(" ") == []


def test_markdown_small_sections_go_forward_only():
    out = C.markdown("# A\n\nx\n\n# B\n\n" + "y" * 120 + "\n\n# C\n\nz", 1500, 0, 100)
    assert out == ["# A\n\nx\n\n# B\n\n" + "y" * 120, "# C\n\nz"]


def test_html_landmarks_headings_tables():
    page = "<body><header>top</header><article>one <section>two</section></article><p>outside</p></body>"
    assert C.html(page) == ["top", "one two", "two"]
    assert C.html("<h1>A</h1><p>x</p>loose<h2>B</h2><div>y</div>") == ["A x", "B y"]
    assert C.html("<script>no</script><p>only   text</p>") == ["only text"]
    rows = "".join(f"<tr><td>cell {i}</td></tr>" for i in range(20))
    out = C.html(f"<p>t</p><table>{rows}</table>", 40, 0)
    assert out[0] == "t" and all(len(c) <= 40 for c in out) and " | " in out[1]


def test_semantic():
    a, b = "cats purr and cats sleep in the warm sun all day long, " * 3, "stocks fell while bonds rose in the late market session, " * 3
    text = "\n\n".join([a, a, b, b])
    out = C.semantic(text, 400, 50, 0.5)
    assert len(out) == 2 and "stocks" not in out[0] and "cats" not in out[1]
    assert C.semantic("  short ", 100) == ["short"] and C.semantic("") == []
    assert C.bounded(["a", "b", "c" * 30], 10, 5) == ["a\n\nb", "c" * 10, "c" * 10, "c" * 10]


def test_registry():
    with pytest.raises(ValueError):
        C.get_chunker("auto")
    with pytest.raises(ValueError):
        C.get_chunker("nope")
    assert C.get_chunker("fixed", chunk_size=2, overlap=0, other=1)("abcd") == ["ab", "cd"]
    assert C.get_chunker_for_file("/x/a.MD")("t") == ["t"]


def test_code_chunks(spark):
    s = spark.createDataFrame([("function", "f", "(a)", "doc", "body " * 30)], "symbol_type string, qualified_name string, signature string, docstring string, content string")
    one = s.select(X.code_chunks(F.struct(*s.columns), 60, 10).alias("c"), X.code_chunks(F.struct(*s.columns), 20, 5).alias("d"), X.code_chunks(F.struct(*s.columns), 500, 5, False).alias("h")).first()
    assert one["c"][0].startswith("function: f\n(a)\n\nDocumentation:\ndoc\n\nSource:\n") and len(one["c"][0]) == 60
    assert one["d"][0] == "function: f\n(a)\n\nDoc"[:20] and one["h"] == ["function: f\n(a)\n\nDocumentation:\ndoc"]
