import pytest

from kelpline.sources import phplang, rustlang

RUST_GOOD = [
    "", "﻿", "// only a comment", "fn main() {}", "fn f(a: &str, mut b: Vec<Vec<u8>>) -> Result<(), Box<dyn Error + 'static>> { Ok(()) }",
    "pub(crate) async unsafe fn f<'a, T: Clone + 'a, const N: usize>(x: &'a mut [T; N]) -> impl Iterator<Item = &'a T> + 'a where T: Send { x.iter() }",
    "#![allow(dead_code)]\nuse std::{fmt, io::{self, Read as R}, *};\n#[derive(Debug)]\npub struct S<T = u8>(pub T, u8) where T: Copy;\nstruct U;\nenum E { A, B(u8), C { x: i32 }, D = 3, }",
    "impl<T> Trait<T> for S<T> where T: X { const N: u8 = 1; type Out = T; fn g(&self) -> u8 { match self.0 { 0 | 1 => 1, n @ 2..=5 if n > 2 => n - 1, Some(ref x) => { *x } _ => 9 } } }",
    "fn f() { let x = if a { 1 } else { 2 }; for (i, c) in s.chars().enumerate() { continue; } 'o: loop { break 'o; } while let Some(x) = it.next() { x?; } }",
    "fn f() { let c = |a: u8, _| -> u8 { a }; let r = &mut x[1..=2]; (r as usize) << 3 >= y && !z || *p == -1; vec![1, 2].iter().map(|x| x * 2).collect::<Vec<_>>(); S { a, b: 1, ..d }; }",
    'fn f() { let s = r#"a " } b"#; let t = b"x\\"y"; let c = \'\\\'\'; let l: &\'static str = "q"; /* a /* b */ } */ println!("{}", s); }',
    "macro_rules! m { ($x:expr) => { $x + 1 }; }\nmod a { pub fn b() {} }\nmod c;\nstatic mut X: u8 = 0;\ntrait T: A + B { fn f(&self); fn g() {} }\nextern \"C\" { fn h(x: i32); }",
    "fn f() { let Some(x) = y else { return; }; unsafe { g() }; async move { z.await }; if x == (S { a: 1 }) {} match x {} }",
]
RUST_BAD = [
    "fn main() {", "fn f( { }", "fn f() { let x = ; }", "struct S { a: u8", "<<<<<<< HEAD\nfn f() {}\n=======\n>>>>>>> x", "def f():\n    pass\n", "fn f() { a == b == c }", "fn f() { x y }", 'fn f() { let s = "open; }',
    "fn f() { if x == S { a: 1 } {} }", "pub fn", "fn f() -> { }", "let x = 1;", "impl { fn f() {} }", "fn f() { match x { 1 => } }", "# Report: an empty section", "fn f() { /* never closed }",
]
PHP_GOOD = [
    "", "plain text { without code", "<?php", "<?php // nothing", "<h1><?= $x ?></h1>", "<?php\nnamespace A\\B;\nuse C\\{D, E as F};\nconst X = 1;\nfunction f(?int $a, string|array &...$b): ?static { return $a ?? 1; }",
    "<?php\nabstract class A extends B implements C, D { use T; const int X = 1, Y = 2; public readonly ?string $p; private static $q = ['a' => [1, 2]]; abstract protected function g(); public function __construct(private int $x = 3) {} }",
    "<?php interface I extends J { public function f(): void; } trait T { } enum S: string { case A = 'a'; case B = 'b'; public function label(): string { return match ($this) { self::A, self::B => 'x', default => throw new \\E() }; } }",
    "<?php\n#[Pure(1)]\nfunction f() { foreach ($a as $k => &$v): if ($v): echo 1; elseif (2): else: endif; endforeach; switch ($x) { case 1: break; default: } try { } catch (A | B $e) { } finally { } }",
    "<?php $t = <<<MARK\nbrace { left {$a['x']} open $b\n  MARK; $n = <<<'X'\n{$no}\nX;\n$f = fn($x) => $x * 2; $g = function () use (&$f): int { yield 1 => 2; }; list('a' => $q) = $r; [$a, [, $b]] = $c;",
    "<?php echo \"{$a->b['c']} ${d} $e[0] \\\" }\"; $x = (int) $y <=> 3; $o?->p()::Q; new class(1) extends A { }; $a = clone $b; isset($a, $b[1]) and print 'x'; `ls`; goto end; end: ;",
    "<?php while ($x < 3) { $x += max(1, strlen((string) $y)); } do { } while (0); for ($i = 0, $j = 1; $i < 2; $i++, $j--) ; return static::$x instanceof static ? : 2;",
    "<?php\r\nfunction f()\r\n{\r\n    return !$a = 1;\r\n}\r\n?>\r\n<p>text</p>\r\n",
]
PHP_BAD = [
    "<?php function f( { }", "<?php class A { public function f() { }", "<?php $x = ;", "<?php retu", "<?php <<<<<<< HEAD\n$a;\n=======\n$b;\n>>>>>>> x\n", "<?php $t = <<<MARK\nnever\n", "<?php function f($a $b) {}", "<?php 'open",
    "<?php if ($x) { } else if", "<?php class { }", "<?php foreach ($a as) { }", "<?php f(1 2);", "<?php /* open", "<?php $a = [1, 2;", "<?php function class() {}", "<?php try { }", "<?php \x00",
]


@pytest.mark.parametrize("text", RUST_GOOD)
def test_rust_valid(text):
    rustlang.parse(text)


@pytest.mark.parametrize("text", RUST_BAD)
def test_rust_invalid(text):
    with pytest.raises(SyntaxError):
        rustlang.parse(text)


@pytest.mark.parametrize("text", PHP_GOOD)
def test_php_valid(text):
    phplang.parse(text)


@pytest.mark.parametrize("text", PHP_BAD)
def test_php_invalid(text):
    with pytest.raises(SyntaxError):
        phplang.parse(text)


def test_deep_nesting_is_an_error_not_a_crash():
    for parse, text in ((rustlang.parse, "fn f() { " + "(" * 20000), (phplang.parse, "<?php " + "(" * 20000)):
        with pytest.raises(SyntaxError):
            parse(text)


def test_nesting_of_any_depth():
    for n in (400, 5000):
        assert phplang.parse("<?php $x = " + "(" * n + "1" + ")" * n + ";") == []
        with pytest.raises(SyntaxError):
            phplang.parse("<?php $x = " + "(" * n + "1" + ")" * (n - 1) + ";")
        assert [i.name for i in rustlang.parse("fn f() { let x = " + "(" * n + "1" + ")" * n + "; }")] == ["f"]
    assert len(phplang.parse("<?php function f() " + "{ if (1) " * 3000 + "{}" + "}" * 3000)) == 1


def test_symbols_of_files_with_errors():
    from kelpline.sources import symbols as S

    php = "<?php\nfunction first($a) { return 1; }\nfunction broken( { $x = ; }\nclass K {\n    public function m() { $x = = 2; }\n    public $ = ;\n    private function n(): int { return 3; }\n}\nfunction open_end() {\n    if (1) {\nfunction last() { }\n"
    names = [s["qualified_name"] for s in S.php_symbols(php)]
    assert [n for n in names if n in ("first", "K", "K.m", "K.n", "last")] == ["first", "K", "K.m", "K.n", "last"]
    rust = "fn first() { let x = ; }\nfn (broken) {}\nstruct S { a: u8 }\nimpl S {\n    fn m(&self) { a == b == c }\n    fn ] { }\n    pub fn n() {}\n}\nfn open_end() {\n    if x {\nfn last() {}\n"
    names = [s["qualified_name"] for s in S.rust_symbols(rust)]
    assert [n for n in names if n in ("first", "S", "S.m", "S.n", "last")][:2] == ["first", "S"] and {"S.m", "S.n", "last"} <= set(names)
    for junk in ("<?php '", "<?php {{{", "<?php }}} function", "fn", "}}}", "impl {", '"', "/*", "", "<?php class", "trait T { fn"):
        S.php_symbols(junk)
        S.rust_symbols(junk)


def test_python_symbols_keep_lines_and_order():
    from kelpline.sources import symbols as S

    text = 'X = 1\x0c\n\x0c\nclass A:\n    def m(self):\n        return "\x85"\n\n    class B:\n        def k(self): pass\n\n\ndef f():\n    return 2\n'
    got = S.python_symbols(text)
    assert [s["qualified_name"] for s in got] == ["X", "A", "A.m", "f", "B", "B.k"]
    assert {s["name"]: s["content"] for s in got}["f"] == "def f():\n    return 2"
