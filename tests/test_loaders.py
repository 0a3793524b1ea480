import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from kelpline.functions import htmltree
from kelpline.sources import discover, loaders, symbols


def one(name, raw):
    return loaders.load_one(f"/x/{name}", name, "." + name.rsplit(".", 1)[-1], len(raw or b""), 1.5, raw)


def test_text_and_errors():
    r = one("a.txt", "é\r\nb\rc".encode())
    assert r["content"] == "é\nb\nc" and r["metadata"]["size"] == 7 and r["error"] is None
    assert one("a.txt", b"\xff\xfe").get("error").startswith("UnicodeDecodeError")
    assert one("a.txt", None)["error"] == "ValueError: no content" and one("a.bin", b"x")["content"] == "x"


def test_markdown_front_matter():
    r = one("a.md", b"---\ntitle: T\ntags: [a, b]\nfilename: z\ndate: 2020-01-02\n---\n\n# H\n\ntext\n")
    assert r["content"] == "# H\n\ntext" and r["metadata"]["title"] == "T" and r["metadata"]["filename"] == "a.md"
    assert r["metadata"]["extra"] == {"tags": '["a", "b"]'} and r["metadata"]["date"] == '"2020-01-02"'
    assert one("a.md", b"---\n: : :\n\t- x\n---\nx")["error"] is not None


def test_rst_title():
    assert one("a.rst", b"Title\n=====\n\ntext")["metadata"]["title"] == "Title"
    assert one("a.rst", b"no underline\n")["metadata"]["title"] is None


PAGE = b"""<html><head><title> T </title><meta name="description" content=" d "><meta property="og:description" content="o"><meta property="author" content="me">
<style>p{}</style></head><body><nav>menu</nav><h1>H</h1><p>a &amp; b<script>x()</script></p></body></html>"""


def test_html():
    r = one("a.html", PAGE)
    assert r["content"].split("\n") == ["T", "H", "a & b"]
    assert (r["metadata"]["title"], r["metadata"]["description"], r["metadata"]["author"]) == ("T", "d", "me")


def test_malformed_html_is_recovered():
    assert "text" in one("a.html", b"<title>x<p>unclosed <div>text")["content"] or "x" in one("a.html", b"<title>x<p>unclosed <div>text")["content"]
    assert [n.tag for n in htmltree.parse("<p>a<p>b<ul><li>1<li>2</ul>").find_all("p", "li")] == ["p", "p", "li", "li"]


def test_rustdoc():
    r = one("a.html", b'<body class="rustdoc struct"><h1 class="fqn">std::S</h1><pre class="rust">pub struct S</pre><div class="sidebar">no</div><p>doc</p></body>')
    m = r["metadata"]
    assert (m["doc_type"], m["module_path"], m["item_type"], m["signature"]) == ("rustdoc", "std::S", "struct", "pub struct S")
    assert "no" not in r["content"].split("\n")


def test_epub():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="urn:p" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>B</dc:title><dc:creator>A1</dc:creator><dc:creator>A2</dc:creator><dc:language>en</dc:language></metadata><manifest><item href="1.xhtml" media-type="application/xhtml+xml"/><item href="2.xhtml" media-type="application/xhtml+xml"/><item href="s.css" media-type="text/css"/></manifest></package>')
        z.writestr("O/1.xhtml", "<html><body><h1>One</h1><p>text</p></body></html>")
        z.writestr("O/2.xhtml", "<html><body> </body></html>")
    r = one("a.epub", buf.getvalue())
    assert r["content"] == "One\ntext" and r["metadata"]["author"] == "A1; A2" and r["metadata"]["title"] == "B" and r["metadata"]["language"] == "en"
    assert one("a.epub", b"no zip")["error"] is not None


def pdf(text, deflate):
    stream = f"BT /F1 12 Tf 72 700 Td ({text}) Tj 0 -14 Td (second \\(line\\)) Tj ET".encode()
    body = zlib.compress(stream) if deflate else stream
    filt = b"/Filter /FlateDecode " if deflate else b""
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << " + filt + b"/Length " + str(len(body)).encode() + b" >> stream\n" + body + b"\nendstream endobj\n5 0 obj << /Title (My title) /CreationDate (D:20240203101112Z) >> endobj\ntrailer << /Root 1 0 R /Info 5 0 R >>"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf(deflate):
    r = one("a.pdf", pdf("see doi: 10.1234/abc.", deflate))
    assert r["content"] == "see doi: 10.1234/abc.\nsecond (line)" and r["metadata"]["doi"] == "10.1234/abc"
    assert r["metadata"]["title"] == "My title" and r["metadata"]["creation_date"] == "2024-02-03" and r["metadata"]["page_count"] == 1
    assert one("a.pdf", b"not a pdf")["error"] is not None


PY = '"""Mod doc."""\nimport os\n\nLIMIT = 3\nx: int = 4\n\n@dec\nasync def f(a: int, b=2, *c, d=1) -> str:\n    """Doc."""\n    def inner():\n        pass\n\nclass K(Base):\n    def m(self):\n        pass\n'


def test_python_symbols():
    got = {(s["symbol_type"], s["qualified_name"]): s for s in symbols.python_symbols(PY, "mod")}
    assert set(got) == {("module", "mod.__module__"), ("constant", "LIMIT"), ("function", "f"), ("function", "inner"), ("class", "K"), ("method", "K.m")}
    f = got["function", "f"]
    assert f["signature"] == "(a: int, b) -> str" and f["metadata"]["is_async"] and f["metadata"]["decorators"] == ["dec"] and f["content"].startswith("async def f")
    assert got["class", "K"]["signature"] == "(Base)" and symbols.python_symbols("def (") == []


def test_php_symbols():
    got = symbols.php_symbols("<?php\nconst A = 1;\n/** Adds. */\nfunction f(int $a): int { return $a; }\n/**\n * Class doc.\n */\n#[X]\nclass K extends B implements I, J { /** m doc */ private static function m() {} function n() {} }\ninterface P { public function q(); }")
    assert [(s["symbol_type"], s["qualified_name"], s["visibility"]) for s in got] == [("constant", "A", None), ("function", "f", None), ("class", "K", None), ("method", "K.m", "private"), ("method", "K.n", "public"), ("interface", "P", None), ("method", "P.q", "public")]
    assert got[1]["signature"] == "(int $a): int" and got[1]["docstring"] == "Adds." and got[2]["docstring"] == "Class doc." and got[2]["metadata"]["implements"] == ["I", "J"] and got[3]["docstring"] == "m doc"


def test_rust_symbols():
    src = "/// Adds.\n#[inline]\npub const unsafe fn f<'a>(x: &'a str) -> u8 where u8: Copy { 1 }\n#[derive(Debug, Clone)]\npub struct S<T>(T);\nenum E { A, B }\npub trait T: X + Y { fn g(&self); }\nimpl T for S<u8> { fn g(&self) {} }\ntype A = u8;\nconst C: u8 = 1;\nstatic mut G: u8 = 2;\n#[macro_export]\nmacro_rules! m { () => {} }\nmod inner { pub fn h() {} }\nmod outside;\n"
    got = {(s["symbol_type"], s["qualified_name"]): s for s in symbols.rust_symbols(src)}
    assert set(got) == {("function", "f"), ("struct", "S"), ("enum", "E"), ("trait", "T"), ("method", "T.g"), ("impl", "T for S<u8>"), ("method", "S<u8>.g"), ("type_alias", "A"), ("constant", "C"), ("static", "G"), ("macro", "m"), ("module", "inner"), ("method", "inner.h")}
    f = got["function", "f"]
    assert f["signature"] == "pub const unsafe fn f<'a>(x: &'a str) -> u8 where u8: Copy" and f["docstring"] == "Adds." and f["metadata"]["lifetimes"] == ["'a"]
    assert got["struct", "S"]["metadata"]["derives"] == ["Debug", "Clone"] and got["enum", "E"]["metadata"]["variants"] == ["A", "B"] and got["macro", "m"]["visibility"] == "pub" and got["static", "G"]["metadata"]["is_mutable"]


def test_scan_and_exclusion(spark, tmp_path):
    for p in ("a.md", "sub/b.md", "sub/__init__.py", "node_modules/x/c.md", "sub/deep/d.txt", "e.bin"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / "sub" / "link.md").symlink_to(tmp_path / "a.md")
    files = discover.scan(spark, str(tmp_path))
    got = {r["rel_path"] for r in files.collect()}
    assert got == {"a.md", "sub/b.md", "sub/__init__.py", "node_modules/x/c.md", "sub/deep/d.txt"}
    inside, outside = discover.filter_files(files, ["*.txt"])
    assert {r["rel_path"] for r in outside.collect()} == {"node_modules/x/c.md", "sub/deep/d.txt"} and inside.count() == 3
    docs = loaders.load(discover.read_bytes(inside))
    assert docs.where(F.col("error").isNull()).count() == 3


def test_png_size(spark):
    from kelpline.operators.images import _png_size

    head = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"
    assert _png_size(head + zlib.crc32(head[12:]).to_bytes(4, "big")) == (7, 9) and _png_size(b"x") is None and _png_size(None) is None
