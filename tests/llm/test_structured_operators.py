import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import codepairs as P
from kelpline.llm import knn as K
from kelpline.llm import mixing as X
from kelpline.llm import packing as B
from kelpline.llm import syntax as Y
from kelpline.llm import tokens as T

FILES = "file_id long, repository string, extension string, content binary, valid string, doc string"


def files(spark, rows):
    return spark.createDataFrame([(i, "r", e, None if c is None else bytearray(c if isinstance(c, bytes) else c.encode()), "v", "d") for i, (e, c) in enumerate(rows)], FILES)


# -- syntax ----------------------------------------------------------------------------------------
def test_verdicts(spark):
    rows = [
        (".py", "def f():\n    return 1\n"), (".PY", "\ufeffx = 1\r\ny = 2\r\n"), (".py", ""), (".py", "fn f() -> u8 { 1 }"), (".py", "def f(:\n"), (".rs", "fn f() {}"), (".rs", "def f():\n    pass\n"),
        (".php", "no code at all {"), (".php", "<?php function f( {"), (".phtml", "<p><?= $x ?></p>"), (".rs", b"\xff\xfe"), (".py", None), (".txt", "x"), (None, "x"), (".py", "x = 1\x00"), (".rs", "<<<<<<< HEAD\nfn f() {}\n=======\n>>>>>>> b\n"),
    ]
    out = {r["file_id"]: (r["valid"], r["verdict"]) for r in Y.check_files(files(spark, rows)).collect()}
    ok, wrong, bad, none = (True, "valid"), (False, "wrong_extension"), (False, "corrupt"), (None, None)
    assert [out[i] for i in range(len(rows))] == [ok, ok, ok, wrong, bad, ok, wrong, ok, bad, ok, bad, none, none, none, bad, bad]
    rates = {r["language"]: (r["files"], r["invalid"], r["rate"]) for r in Y.invalid_rates(Y.check_files(files(spark, rows))).collect()}
    assert rates == {"python": (6, 3, 0.5), "php": (3, 1, round(1 / 3, 6)), "rust": (4, 3, 0.75)}
    assert Y.check_files(files(spark, []).limit(0)).count() == 0
    assert Y.judge(b"x = 1\n" * 50_000, ".py")[1] is True


def test_ranking_by_tokens():
    assert Y.rank("fn f(a: &str) -> usize { let x = 1; }")[0] == "rust" and Y.rank("<?php $a = 1; echo $b;")[0] == "php" and Y.rank("import os\ndef f(self):\n    pass")[0] == "python"


# -- code and documentation ------------------------------------------------------------------------
PY = 'class A:\n    def m(self, x):\n        """Keeps the lock until the row is closed."""\n        def inner():\n            """Not listed."""\n        return x\n\n    def n(self): return 1\n\n\nasync def load_row(\n    path,\n) -> int:\n    r\'\'\'Load row.\'\'\'\n    s = """\ndef fake():\n"""\n\n# comment only\ndef g():\n    x = 1\n    """Not a docstring at all here."""\n'
PHP = "<html>\n<?php\n/** Falls back to the slow scan. */\n#[Pure]\nfunction f($a) { return '}'; }\n/* plain comment */\nfunction g() {}\nclass K {\n    /**\n     * Not thread-safe.\n     *\n     * @param mixed $x the x\n     */\n    public static function m($x) { if ($x) { } }\n    /** tbd */\n    function n() {}\n}\n"
RUST = "/// Needs the lock.\n#[inline]\npub fn f<'a>(x: &'a str) -> u8 { let c = '{'; 1 }\n// plain\nfn g() {}\nimpl<T> S<T> {\n    /** In bytes. */\n    fn m(&self) { /* } */ }\n}\nimpl Tr for Q {\n    fn q() {}\n}\n/// TODO\nfn h() {}\n"


def test_functions_and_their_comments():
    get = lambda t, l: {f["qualified_name"]: (f["kind"], f["doc"], f["line_start"], f["line_end"]) for f in P.functions_of(t, l)}
    assert get(PY, "python") == {"A.m": ("method", "Keeps the lock until the row is closed.", 2, 6), "A.n": ("method", None, 8, 8), "load_row": ("function", "Load row.", 11, 17), "g": ("function", None, 20, 22)}
    php = get(PHP, "php")
    assert php["f"] == ("function", "Falls back to the slow scan.", 5, 5) and php["g"][1] is None and php["K.m"][1].startswith("Not thread-safe.") and php["K.n"][1] == "tbd"
    rust = get(RUST, "rust")
    assert set(rust) == {"f", "g", "S<T>.m", "Q.q", "h"} and rust["f"][1] == "Needs the lock." and rust["S<T>.m"][1] == "In bytes." and rust["g"][1] is None


TRIVIAL = ["", "   ", "---", "...", "???", "TODO", "N/A", "None", "tbd", "No description available.", "Documentation goes here.", "Beschreibung folgt.", "[description of the load row function]", "load_row", "load_row()", "Loads row", "Loads the given row.", "Load row function.", "The load_row method.", "Helper for load row.", "This is the load_row function. It is used to load row.", "Function load_row: does the load row and returns the result of the load row.", "@param mixed $path\n@return mixed", ":param path:\n:return:", "Args:\n    path: path", "{@inheritdoc}", "_summary_", "Auto-generated stub.", "Created from the editor template, please complete.", "TODO: somebody has to describe what load_row does before the next release", "doc missing, will follow later", "@todo document this", "Docs coming later.", "Doc will be provided.", "Ta funkcja jeszcze nie ma opisu.", "Diese Funktion hat noch keine Beschreibung."]
REAL = ["Not thread-safe.", "Null when the row is gone.", "Zero means no limit.", "Returns -1 for an empty row.", "Load row as found in the page.", "In bytes, not tokens.", "Gibt None zurück, falls der Eintrag schon gelöscht wurde.", "Loads the row.\n\nFalls back to the slow scan if the cache is cold.", "次の行を読む"]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert P.is_trivial(doc, "load_row", "load_row", "(path)")


@pytest.mark.parametrize("doc", REAL)
def test_real(doc):
    assert not P.is_trivial(doc, "load_row", "load_row", "(path)")


def test_pairs_with_symbols(spark):
    f = files(spark, [(".py", PY), (".php", PHP), (".rs", RUST), (".py", "def ("), (".py", None), (None, "x"), (".py", "")])
    s = spark.createDataFrame([(0, "A.m", "method", None), (0, "A.m", "method", "(self, x)"), (0, "load_row", "function", None), (1, "f", "function", "($a)"), (1, "K", "class", None), (2, "f", "function", ""), (2, "gone", "function", "")], "file_id long, qualified_name string, symbol_type string, signature string")
    out = {(r["file_id"], r["qualified_name"], r["signature"]) for r in P.documented_symbols(f, s).collect()}
    assert out == {(0, "A.m", "(self, x)"), (1, "f", "($a)"), (2, "f", "")}
    assert P.documented_functions(f.limit(0)).count() == 0 and P.documented_symbols(f, s.limit(0)).count() == 0


# -- neighbours ------------------------------------------------------------------------------------
def points(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "r", 0.0) for i, v in rows], "id long, vector array<float>, rep string, sim double")


def brute(rows, k=5):
    best = {}
    for i, v in rows:
        if v is not None and np.any(np.asarray(v) != 0):
            best[i] = max(best.get(i, ()), tuple(np.float32(x).item() for x in v))
    ids = sorted(best)
    m = np.array([best[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 12)
    np.fill_diagonal(s, -9)
    out = set()
    for a in range(len(ids)):
        for b in np.argsort(-s[a], kind="stable")[: min(k, len(ids) - 1)]:
            out.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def test_neighbours_small_cases(spark):
    rng = np.random.default_rng(1)
    base = [(i, rng.normal(size=4)) for i in range(40)]
    ties = [(100 + i, [1, 0, 0, 0]) for i in range(9)] + [(200 + i, [2, 0, 0, 0]) for i in range(4)]
    rows = base + ties + [(300, None), (301, [0, 0, 0, 0]), (0, base[0][1]), (5, base[5][1])]
    assert {tuple(r) for r in K.neighbour_pairs(points(spark, rows)).collect()} == brute(rows)
    assert K.neighbour_pairs(points(spark, [])).count() == 0 and K.neighbour_pairs(points(spark, [(1, [1, 2, 3, 4])])).count() == 0
    assert {tuple(r) for r in K.neighbour_pairs(points(spark, [(1, [1, 0, 0, 0]), (2, [1, 0, 0, 0])])).collect()} == {(1, 2)}


def test_neighbours_recall_with_many_lists_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    rows = [(i, centers[i % 30] + 0.5 * rng.normal(size=16)) for i in range(1800)] + [(5000 + i, centers[0]) for i in range(900)]
    got = {(r["id"], r["neighbour"]) for r in K.neighbours(points(spark, rows), list_size=64).collect()}
    want = brute(rows)
    pairs = {(min(a, b), max(a, b)) for a, b in got}
    assert len(pairs & want) >= 0.97 * len(want)
    assert len({a for a, _ in got}) == 2700


def test_centroid_graph_recall(monkeypatch):
    rng = np.random.default_rng(3)
    c = K._unit(rng.normal(size=(2000, 24))).astype(np.float32)
    q = K._unit(rng.normal(size=(200, 24))).astype(np.float32)
    dense, _ = K.CentroidGraph(c).search(q, 20)
    monkeypatch.setattr(K, "DENSE", 0)
    idx, _ = K.CentroidGraph(c).search(q, 20)
    exact = np.argsort(-(q @ c.T), axis=1)[:, :20]
    for got in (idx, dense):
        assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, exact)]) >= 0.9


def test_two_levels_of_centroids_and_shelves():
    rng = np.random.default_rng(4)
    x = K._unit(rng.normal(size=(12_000, 8))).astype(np.float32)
    c = K.centroids_of(x, 1500)
    assert 1350 <= len(c) <= 1650 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-3)
    near = np.max(x @ c.T, axis=1)
    assert near.mean() > np.max(x @ x[:1500].T, axis=1)[1500:].mean()
    on = K.shelves(c)
    assert len(on) == len(c) and len(set(on)) <= round(len(c) / K.SHELF) and np.bincount(on).max() <= 8 * K.SHELF


# -- packing ---------------------------------------------------------------------------------------
def test_sum_of_squares_is_valid_and_tight():
    rng = random.Random(4)
    sizes = np.array([rng.randint(1, 60) for _ in range(4000)])
    bins = B.sum_of_squares(sizes, 100)
    load = np.bincount(bins, weights=sizes)
    assert load.max() <= 100 and (load > 0).all() and load.sum() == sizes.sum()
    assert len(load) <= 1.03 * sizes.sum() / 100 + 2
    assert list(B.sum_of_squares(np.array([5, 5, 10, 3]), 10)) == [0, 0, 1, 2] and len(B.sum_of_squares(np.array([], int), 5)) == 0


def brute_squares(sizes, capacity):
    """The rule by recomputing the whole sum for every choice."""
    gaps, out = [], []
    total = lambda gs: sum(gs.count(g) ** 2 for g in set(gs) if g > 0)
    for s in sizes:
        if s >= capacity:
            gaps.append(0)
            out.append(len(gaps) - 1)
            continue
        options = []
        for g in sorted(set(x for x in gaps if x >= s and x > 0)):
            trial = list(gaps)
            trial[trial.index(g)] = g - s
            options.append((total(trial), 0, g))
        options.append((total(gaps + [capacity - s]), 1, capacity))
        _, new, g = min(options)
        if new:
            gaps.append(capacity - s)
            out.append(len(gaps) - 1)
        else:
            k = max(i for i, x in enumerate(gaps) if x == g)
            gaps[k] = g - s
            out.append(k)
    return out


def test_sum_of_squares_against_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        sizes = [rng.randint(1, 14) for _ in range(40)]
        got = B.sum_of_squares(np.array(sizes), 12)
        want = brute_squares(sizes, 12)
        fill = lambda bins: sorted(np.bincount(bins, weights=sizes).tolist())
        assert fill(got) == fill(np.array(want))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, tokens int, bin int")


def test_pack(spark):
    d = docs(spark, [(1, "word " * 30, "a"), (2, None, "a"), (3, "", "b"), (4, "one two three", None), (5, "one two three", "c"), (None, "lost", "c")])
    limits = spark.createDataFrame([("short", 8, 1), ("long", 100, 1), ("none", 0, 1), (None, 5, 1)], "container string, capacity_tokens int, shard int")
    out = B.pack(d, limits).collect()
    sizes = {r["doc_id"]: r["tokens"] for r in T.count_tokens(d.where("doc_id IS NOT NULL")).collect()}
    for name, cap in (("short", 8), ("long", 100)):
        mine = [r for r in out if r["container"] == name]
        load = {}
        for r in mine:
            load[r["bin"]] = load.get(r["bin"], 0) + r["tokens"]
        assert max(load.values()) <= cap and {r["doc_id"] for r in mine} == {1, 4, 5}
        for i in (1, 4, 5):
            parts = sorted((r["piece"], r["tokens"]) for r in mine if r["doc_id"] == i)
            assert sum(t for _, t in parts) == sizes[i] and all(t == cap for _, t in parts[:-1]) and [p for p, _ in parts] == list(range(len(parts)))
    assert B.fill_report(B.pack(d, limits)).where("overfull > 0").count() == 0
    # shards are counted in pieces: a few long documents fill several
    long = docs(spark, [(i, "word " * 400, "a") for i in range(20)])
    many = B.pack(long, limits, shard_items=100)
    per = many.groupBy("container", "bin").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c"))
    assert per.where("t > c").count() == 0 and many.where("container = 'short'").count() == sum(-(-r["tokens"] // 8) for r in T.count_tokens(long).collect())
    assert B.pack(d.limit(0), limits).count() == 0 and B.pack(d, limits.limit(0)).count() == 0


# -- mixing ----------------------------------------------------------------------------------------
def test_fit_budget_is_exact_where_it_can_be():
    rng = random.Random(6)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 60), 8)))
        counts = np.array([rng.randint(1, 5) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 5)
        take = X.fit_budget(lengths, counts, budget)
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + k * int(n) for r in reach for k in range(c + 1)}
        got = int((lengths * take).sum())
        assert (take <= counts).all() and (take >= 0).all() and got <= budget
        # the proportional choice comes first; the rest is the best that is left
        assert budget - got <= 8 or got == max(r for r in reach if r <= budget)


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, "word " * rng.randint(3, 40), "abc"[i % 3]) for i in range(600)] + [(1000 + i, "same text here", "hot") for i in range(900)] + [(2000, None, "a"), (2001, "x", None), (2002, "", "b")]
    d = docs(spark, rows)
    t = spark.createDataFrame([("a", 0.4, 1, 0), ("b", 0.3, 2, 0), ("hot", 0.2, 3, 0), ("gone", 0.1, 2, 0)], "source string, target_share double, max_repeats int, tokens int")
    m = X.mix(d, t)
    caps = {"a": 1, "b": 2, "hot": 3}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in m.collect()) and m.groupBy("doc_id").count().where("count > 1").count() == 0
    rep = {r["source"]: r for r in X.share_report(m, t.drop("tokens")).collect()}
    assert abs(rep["a"]["actual_share"] - 0.4 / 0.9) < 0.01 and abs(rep["b"]["actual_share"] - 0.3 / 0.9) < 0.01 and abs(rep["hot"]["actual_share"] - 0.2 / 0.9) < 0.01 and rep["gone"]["documents"] == 0
    small = X.mix(d, t, total_tokens=500)
    assert abs(small.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] - 500) <= 20
    assert X.mix(d.limit(0), t).count() == 0 and X.mix(d, t.limit(0)).count() == 0


def test_token_counts(spark):
    out = {r["doc_id"]: r["tokens"] for r in T.count_tokens(docs(spark, [(1, "hello world", "a"), (2, None, "a"), (3, "", "a"), (4, "<|endoftext|>", "a")])).collect()}
    assert out[1] == 2 and out[2] == out[3] == 0 and out[4] > 1
    enc = T.encoder()
    assert enc.decode(enc.encode_ordinary("naïve 日本")) == "naïve 日本"
