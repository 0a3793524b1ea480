import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import merkle as M
from kelpline.operators.publish import Conflict

LOG = "obs_id long, source_path string, repository string, modified_time double, content_hash string, size long, received_at timestamp, key string, h long"
STATE = "path string, content_hash string, indexed_at string, chunk_count int, chunk_ids array<long>, mtime double, image_count int, image_ids array<long>, run_id long, value string"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string, key string"


def ts(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def log(spark, rows):
    return spark.createDataFrame([(i, p, "r", m, h, 1, None if r is None else ts(r), "x", 1) for i, (p, m, h, r) in enumerate(rows)], LOG)


def state(spark, rows):
    return spark.createDataFrame([(p, h, "", 1, [1], m, 0, [], r, "v") for p, h, m, r in rows], STATE)


def runs(spark, rows):
    return spark.createDataFrame([(i, ts(i), None, s, "k") for i, s in rows], RUNS)


def found(df):
    return {(r[0], r[1], r[2]) for r in df.collect()}


def test_rules_on_a_small_log(spark):
    l = log(spark, [
        ("a", 1.0, "h1", 1), ("a", 2.0, "h2", 0),  # the later time wins, though it came first
        ("b", 1.0, "h1", 1), ("b", 1.0, "h9", 2),  # equal times: the later arrival
        ("c", 1.0, "h1", 1), ("c", 5.0, None, 9),  # failed readings are ignored
        ("d", None, "hd", 1), ("d", 0.5, "he", 1),  # a null time is older than any
        ("e", 1.0, "h1", 1), (None, 1.0, "h1", 1), ("f", 1.0, None, 1), ("g", 1.0, "h1", 1), ("g", 1.0, "h1", 1),
    ])
    s = state(spark, [("a", "h2", None, 1), ("a", "h1", 1.0, 2), ("b", "h9", 1.0, 1), ("c", "h1", 1.0, 1), ("c", "h1", 1.0, 1), ("d", "hd", 1.0, 1), ("e", "h1", 1.0, 3), ("gone", "h", 1.0, 1), (None, "h", 1.0, 1)])
    r = runs(spark, [(1, "ok"), (2, "ok"), (3, "failed"), (4, None)])
    assert found(M.pending_files(l, s, r)) == {("a", "h2", "modified"), ("d", "he", "modified"), ("e", "h1", "new"), ("g", "h1", "new")}


def test_empty_tables(spark):
    l, s, r = log(spark, []), state(spark, []), runs(spark, [])
    assert found(M.pending_files(l, s, r)) == set()
    assert found(M.pending_files(log(spark, [("a", 1.0, "h", 1)]), s, r)) == {("a", "h", "new")}
    assert found(M.pending_files(l, state(spark, [("a", "h", 1.0, 1)]), runs(spark, [(1, "ok")]))) == set()


@pytest.mark.parametrize("n,leaf", [(50, 1), (400, 4), (400, 64)])
def test_diff_equals_brute_force(spark, n, leaf):
    rng = random.Random(n + leaf)
    old = {f"k{i}": f"v{rng.randint(0, 3)}" for i in range(n) if rng.random() < 0.8}
    new = {k: (v if rng.random() < 0.9 else v + "x") for k, v in old.items() if rng.random() < 0.95} | {f"n{i}": "v" for i in range(n // 10)}
    new["nul"] = None
    a = M.snapshot(spark.createDataFrame(list(new.items()), "p string, c string"), "p", "c")
    b = M.snapshot(spark.createDataFrame(list(old.items()), "p string, c string"), "p", "c")
    got = {(r["key"], r["value"], r["old_value"], r["change"]) for r in M.diff(a, b, M.leaf_bits_for(n, leaf)).collect()}
    want = {(k, v, None, "new") for k, v in new.items() if k not in old} | {(k, None, v, "deleted") for k, v in old.items() if k not in new}
    want |= {(k, v, old[k], "modified") for k, v in new.items() if k in old and old[k] != v}
    assert got == want


def test_descent_opens_changed_leaves_only(spark):
    base = [(f"k{i}", "v") for i in range(3000)]
    a = M.snapshot(spark.createDataFrame(base, "p string, c string"), "p", "c")
    b = M.snapshot(spark.createDataFrame(base[:-1] + [("k2999", "other")], "p string, c string"), "p", "c")
    bits = M.leaf_bits_for(3000)
    leaves = M.changed_leaves(M.tree(a, bits), M.tree(b, bits), bits).collect()
    assert len(leaves) == 1
    assert M.changed_leaves(M.tree(a, bits), M.tree(a, bits), bits).count() == 0


def test_store_publishes_output_and_tree_together(spark, tmp_path):
    st = M.MerkleStore(spark, f"file://{tmp_path}/store")
    snap = lambda rows: M.snapshot(spark.createDataFrame(rows, "p string, c string"), "p", "c")
    one = snap([("a", "1"), ("b", "1")])
    first = st.plan(one)
    assert {r["key"] for r in first.collect()} == {"a", "b"}
    with pytest.raises(RuntimeError):
        st.commit(one, first, fail_before_publish=True)
    # the failed run left nothing behind: the same records come again, none is skipped
    assert st.last() is None and {r["key"] for r in st.plan(one).collect()} == {"a", "b"}
    st.commit(one, st.plan(one))
    assert st.plan(one).count() == 0
    two = snap([("a", "2"), ("c", "1")])
    plan = st.plan(two)
    assert {(r["key"], r["change"]) for r in plan.collect()} == {("a", "modified"), ("c", "new"), ("b", "deleted")}
    run = st.commit(two, plan)
    assert spark.read.parquet(f"{run}/output").count() == 3
    assert st.plan(two).count() == 0 and len(st.manifests()) == 2


def test_the_slower_of_two_runs_fails(spark, tmp_path):
    snap = lambda rows: M.snapshot(spark.createDataFrame(rows, "p string, c string"), "p", "c")
    one, two = (M.MerkleStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    one.commit(snap([("a", "1")]))
    now = snap([("a", "1"), ("b", "1")])
    plans = [s.plan(now) for s in (one, two)]
    assert [{r["key"] for r in p.collect()} for p in plans] == [{"b"}, {"b"}]
    one.commit(now, plans[0])
    with pytest.raises(Conflict):
        two.commit(now, plans[1])
    assert two.plan(now).count() == 0 and len(two.manifests()) == 2  # planned anew, nothing is left to do
    two.commit(now)
    assert len(one.manifests()) == 3


def test_half_written_manifest_is_invisible(spark, tmp_path):
    st = M.MerkleStore(spark, f"file://{tmp_path}/store")
    one = M.snapshot(spark.createDataFrame([("a", "1")], "p string, c string"), "p", "c")
    st.commit(one)
    (tmp_path / "store" / ".MANIFEST-000000002.json.dead").write_text('{"run": "')
    assert st.last()["number"] == 1 and st.plan(one).count() == 0
    st.commit(one)
    assert st.last()["number"] == 2 and not [n for n in (tmp_path / "store").iterdir() if n.name == ".MANIFEST-000000002.json"]


def test_latest_per_key_and_repeated_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("b", 2, "z")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in M.latest_per_key(df, "k", "t").collect()} == {("a", "x"), ("b", "z")}
    snap = M.snapshot(df, "k", "v")
    assert [r["key"] for r in M.repeated_key_check(snap).collect()] == ["a"]
    assert snap.where(F.col("h").isNull()).count() == 0
