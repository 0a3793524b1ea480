import json

import pytest
from pyspark.sql import functions as F

from kelpline import cli, config
from kelpline.engine import Engine
from kelpline.functions import embed
from kelpline.functions import text as X
from kelpline.operators import payloads, store, sync
from kelpline.operators.publish import Conflict


@pytest.fixture()
def tree(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\n\nthe cat sat on the mat\n")
    (docs / "b.txt").write_text("stocks and bonds in the market")
    (docs / "c.py").write_text('def add(a, b):\n    """Add two numbers."""\n    return a + b\n')
    (docs / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (docs / "broken.py").write_text("def (")
    return docs


def test_index_search_and_sync(spark, tree, tmp_path):
    events = []
    e = Engine(spark, f"file://{tmp_path}/store", "c1", on_progress=lambda *x: events.append(x[0]))
    first = e.index(str(tree))
    assert first["total_files"] == 3 and first["failed_files"] == [str(tree / "bad.txt")] and first["total_chunks"] == 3
    assert [r["document"] for r in e.search("cat on the mat", 1).collect()] == ["# A\n\nthe cat sat on the mat"]
    s1 = e.sync(str(tree))
    assert (s1["added"], s1["updated"], s1["unchanged"], s1["failed"]) == (4, 0, 0, [str(tree / "bad.txt")])
    assert "sync_finished" in events and "upload_finished" in events
    s2 = e.sync(str(tree))
    assert (s2["added"], s2["unchanged"]) == (0, 4)
    (tree / "a.md").write_text("# A\n\nthe dog ran\n")
    (tree / "b.txt").unlink()
    s3 = e.sync(str(tree))
    assert (s3["updated"], s3["deleted"]) == (1, 1)
    left = {r["document"] for r in e.store.read("c1").collect()}
    assert not any("cat" in x or "stocks" in x for x in left) and any("dog" in x for x in left)
    status = e.status(str(tree))
    assert status["unchanged"] == 3 and status["new"] == 1 and status["pending"] == [str(tree / "bad.txt")]
    (tree / "c.py").unlink()
    assert e.clean(str(tree))["entries"] == 1 and not any("add" in r["document"] for r in e.store.read("c1").collect())
    code = [r for r in e.store.list().collect()]
    assert code[0]["name"] == "c1" and code[0]["vector_size"] == "64"


def test_unchanged_files_are_not_read_and_one_snapshot_per_sync(spark, tree, tmp_path):
    import os

    e = Engine(spark, f"file://{tmp_path}/store", "c1")
    e.sync(str(tree))
    assert e.store.snapshot("c1")["number"] == 1  # points and state together
    at = os.stat(tree / "b.txt")
    (tree / "b.txt").write_text("other words of the same day")
    os.utime(tree / "b.txt", ns=(at.st_atime_ns, at.st_mtime_ns))
    os.utime(tree / "a.md", (1, 1))
    assert e.sync(str(tree))["updated"] == 0  # the same time: not read; another time, same bytes: touched
    assert {r["path"]: r["mtime"] for r in e.state(str(tree)).collect()}[str(tree / "a.md")] == 1.0
    assert e.sync(str(tree), force=True)["updated"] == 4 and any("other words" in r["document"] for r in e.store.read("c1").collect())


def test_slower_of_two_changes_fails(spark, tmp_path, monkeypatch):
    s, t = (store.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    s.ensure("c", {"v": 2}, buckets=4)
    rows = lambda *x: spark.createDataFrame([(i, {"v": [1.0, 0.0]}, d, {}) for i, d in x], store.SCHEMA)
    s.apply("c", rows(*[(i, "a") for i in range(40)]))
    before, behind = s.snapshot("c"), t.snapshot("c")
    s.apply("c", rows((1, "b")))
    after = s.snapshot("c")["buckets"]
    assert sum(before["buckets"][k] != after[k] for k in after) == 1  # only the touched bucket was written
    monkeypatch.setattr(t, "snapshot", lambda name: behind)
    with pytest.raises(Conflict):
        t.apply("c", delete=spark.createDataFrame([(2,)], "id long"))
    assert s.read("c").count() == 40


def _pdf(width: int, height: int, caption: str, twice: bool = False) -> bytes:
    import zlib

    pixels = zlib.compress(bytes((x * 7 + y * 3) % 256 for y in range(height) for x in range(width)))
    text = b"BT /F1 12 Tf 50 700 Td (A page about the weir and its keeper.) Tj ET BT /F1 12 Tf 60 380 Td (" + caption.encode() + b") Tj ET"
    content = text + b" q 200 0 0 200 50 400 cm /Im0 Do Q" + (b" q 200 0 0 200 300 400 cm /Im1 Do Q" if twice else b"")
    image = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >> stream\n" % (width, height, len(pixels)) + pixels + b"\nendstream"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /XObject << /Im0 5 0 R /Im1 6 0 R >> >> >>",
        b"<< /Length %d >> stream\n" % len(content) + content + b"\nendstream", image, image,
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_images_of_pdf_files(spark, tmp_path):
    from kelpline.sources import pdfimages

    docs = tmp_path / "pdfs"
    docs.mkdir()
    (docs / "a.pdf").write_bytes(_pdf(200, 200, "Figure 1: the weir", twice=True))
    (docs / "small.pdf").write_bytes(_pdf(50, 50, "Figure 2: too small"))
    (docs / "bad.pdf").write_bytes(b"no pdf")
    images, blocks = pdfimages.scan_pdf((docs / "a.pdf").read_bytes())
    assert len(images) == 1 and images[0]["bbox"] == {"x0": 50.0, "y0": 192.0, "x1": 250.0, "y1": 392.0} and len(blocks) == 2
    assert pdfimages.decode_png(images[0]["image_data"]).shape == (200, 200)
    e = Engine(spark, f"file://{tmp_path}/store", "c1", images=True)
    out = e.sync(str(docs))
    assert out["added"] == 2 and out["failed"] == [str(docs / "bad.pdf")]
    state = {r["path"]: r for r in e.state(str(docs)).collect()}
    assert state[str(docs / "a.pdf")]["image_count"] == 1 and state[str(docs / "small.pdf")]["image_count"] == 0
    point = [r for r in e.store.read("c1").collect() if r["metadata"].get("content_type") == "image"]
    assert len(point) == 1 and point[0]["metadata"]["caption"] == "Figure 1: the weir" and point[0]["id"] == state[str(docs / "a.pdf")]["image_ids"][0]
    assert len(point[0]["vectors"]["clip-pixel-64"]) == 64 and set(e.store.vectors("c1")) == {"fast-hash-64", "clip-pixel-64"}
    (docs / "a.pdf").unlink()
    e.sync(str(docs))
    assert not [r for r in e.store.read("c1").collect() if r["metadata"].get("content_type") == "image"]


def test_png_filters():
    import zlib

    import numpy as np

    from kelpline.sources import pdfimages as P

    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 6, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (P.decode_png(P.encode_png(x)) == x).all()
    rows = rng.integers(0, 256, (5, 12)).astype(np.int64)
    raw = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):  # every filter once
        up, line = rows[y - 1] if y else np.zeros(12, np.int64), rows[y]
        left, corner = np.r_[[0] * 3, line[:-3]], np.r_[[0] * 3, up[:-3]]
        paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner)]
        raw += bytes([kind]) + bytes(((line - [0, left, up, (left + up) // 2, np.array(paeth)][kind]) & 255).astype(np.uint8))
    assert (P.unfilter(raw, 5, 12, 3) == rows).all() and P.decode_png(b"junk") is None and P.to_png(zlib.compress(b"x"), b"/DCTDecode") is None


def test_index_one_file(spark, tree, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", "c1")
    out = e.index_file(str(tree / "a.md"))
    assert out["chunk_count"] == 1 and [r["id"] for r in e.store.read("c1").collect()] == out["chunk_ids"] and out["image_ids"] == []
    for bad in ("bad.txt", "none.md"):
        with pytest.raises(ValueError):
            e.index_file(str(tree / bad))


def test_streams_resume(spark, tmp_path):
    from kelpline.streaming import streams

    log = "obs_id long, source_path string, modified_time double, content_hash string, received_at timestamp"
    stamp = lambda n: __import__("datetime").datetime(2024, 1, 1, n)
    root = f"file://{tmp_path}/state"
    one = spark.createDataFrame([(1, "a", 1.0, "h1", stamp(1)), (2, "b", 1.0, "h1", stamp(1)), (3, "c", 1.0, None, stamp(1))], log)
    two = spark.createDataFrame([(4, "a", 2.0, "h2", stamp(2)), (5, "b", 0.5, "old", stamp(3))], log)
    keep = streams.CurrentFiles(spark, root, buckets=4)
    keep.update(one, 0)
    first = keep.folder.names()
    keep.update(one, 0)  # a repeated batch changes nothing
    assert keep.folder.names() == first
    keep.update(two, 1)
    assert {(r["source_path"], r["content_hash"]) for r in keep._read(sorted(keep._last().values())).collect()} == {("a", "h2"), ("b", "h1")}


def test_late_events_no_longer_count(spark, tmp_path):
    from kelpline.streaming import streams

    at = lambda h, m=0: __import__("datetime").datetime(2024, 1, 1, h, m)
    src, out = f"file://{tmp_path}/ev", f"file://{tmp_path}/out"
    schema = "ts timestamp, event_type string, value double"
    kept = []
    for k, rows in enumerate(([(at(1), "x", 1.0), (at(9), "x", 1.0)], [(at(1, 5), "x", 1.0), (at(8, 30), "x", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        streams.run_available(streams.event_counts(stream, "2 hours"), lambda b, n: kept.extend((r["start"].hour, r["events"]) for r in b.collect()), out, "update")
    assert sorted(kept) == [(1, 1), (8, 1), (9, 1)]  # 01:05 came when its hour was closed, 08:30 did not


def test_sync_rules(spark):
    files = spark.createDataFrame([("n", 1.0, "h"), ("same", 1.0, "x"), ("touch", 2.0, "h"), ("mod", 2.0, "h2"), ("nul", 1.0, "h2")], "path string, mtime double, hash string")
    state = spark.createDataFrame([("same", "other", "", 1, [1], 1.0, 0, []), ("touch", "h", "", 1, [2], 1.0, 0, []), ("mod", "h", "", 1, [3], 1.0, 1, [4]), ("nul", "h", "", 1, [5], None, 0, None), ("gone", "h", "", 1, [6], 1.0, 0, [])], sync.STATE)
    c = sync.classify(files, state)
    assert {(r["path"], r["status"], bool(r["touched"])) for r in c.collect()} == {("n", "new", False), ("same", "unchanged", False), ("touch", "unchanged", True), ("mod", "modified", False), ("nul", "modified", False), ("gone", "deleted", False)}
    assert {r["id"] for r in sync.stale_points(c).collect()} == {3, 4, 5, 6}
    assert sync.sync_summary(c).first().asDict() == {"added": 1, "updated": 2, "deleted": 1, "unchanged": 2, "failed": []}
    forced = sync.classify(files, state, force=True)
    assert {r["path"] for r in forced.where("status = 'modified'").collect()} == {"same", "touch", "mod", "nul"}
    fresh = spark.createDataFrame([("mod", "h2", [7], 2.0, [])], "path string, content_hash string, chunk_ids array<long>, mtime double, image_ids array<long>")
    new = {r["path"]: r for r in sync.new_state(c, fresh, state, "now").collect()}
    assert set(new) == {"same", "touch", "mod", "nul"} and new["touch"]["mtime"] == 2.0 and new["mod"]["chunk_ids"] == [7]


def test_state_json_round_trip(spark, tmp_path):
    p = str(tmp_path / "x" / "state.json")
    assert sync.read_state_json(spark, p).count() == 0
    state = spark.createDataFrame([("/a", "h", "t", 2, [1, 2], 1.5, 0, []), ("/é", "h", "t", 0, [], None, 0, [])], sync.STATE)
    sync.write_state_json(state, p)
    assert json.load(open(p))["files"]["/a"]["chunk_ids"] == [1, 2]
    assert sorted(map(tuple, sync.read_state_json(spark, p).collect())) == sorted(map(tuple, state.collect()))
    open(p, "w").write('{"files": {"/l": {"path": "/l", "content_hash": "h", "indexed_at": "t", "chunk_count": 1, "chunk_ids": [9]}}}')
    old = sync.read_state_json(spark, p).first()
    assert old["mtime"] is None and old["image_ids"] == []


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.ensure("c", {"v": 2}) and not s.ensure("c", {"v": 2}) and s.add_vector("c", "w", 3) and not s.add_vector("c", "w", 3)
    rows = lambda *x: spark.createDataFrame(x, store.SCHEMA)
    s.upsert("c", rows((1, {"v": [1.0, 0.0]}, "a", {"source": "p"}), (2, {"v": [0.0, 1.0]}, "b", {"source": "q"}), (1, {"v": [1.0, 0.0]}, "a", {"source": "p"})))
    s.upsert("c", rows((2, {"v": [1.0, 1.0]}, "b2", {"source": "q"})))
    assert {(r["id"], r["document"]) for r in s.read("c").collect()} == {(1, "a"), (2, "b2")}
    assert [(r["id"], r["score"]) for r in s.search("c", [1.0, 0.0], 2, "v").collect()] == [(1, 1.0), (2, pytest.approx(0.707106781187))]
    assert s.delete_source("c", "p") == 1 and s.delete_source("c", "none") == 0
    s.delete_ids("c", spark.createDataFrame([], "id long"))
    assert s.list().collect()[0]["points_count"] == 1
    s.delete("c")
    with pytest.raises(ValueError):
        s.read("c")
    with pytest.raises(ValueError):
        s.ensure("../x", {})


def test_payload_precedence_and_scalars(spark):
    df = spark.createDataFrame([("/p", {"source": "front", "symbols": "s", "k": None, "title": "t"})], "path string, meta map<string,string>")
    m = df.select(payloads.base_metadata(F.col("path"), F.lit("now"), F.col("meta"), F.lit(0), F.lit(2)).alias("m")).first()["m"]
    assert m == {"source": "front", "timestamp": "now", "chunk_index": "0", "total_chunks": "2", "title": "t"}
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"/p-3").digest()[:8], "big") & (2**63 - 1)
    got = df.select(X.point_id(F.col("path"), F.lit(3)).alias("i"), X.pdf_date(F.lit("D:20240102")).alias("d"), X.clean_block_comment(F.lit("/** a\n * b\n *\n */")).alias("c"), X.derives(F.array(F.lit("#[derive(A, B)]"))).alias("v")).first()
    assert got["i"] == want and got["d"] == "2024-01-02" and got["c"] == "a\nb" and got["v"] == ["A", "B"]
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert z[0]["c"] == 0.0 and round(z[1]["c"], 6) == 0.707107


def test_embedding(spark):
    v = embed.HashEmbedder(16).embed(["a b", "a b", ""])
    assert (v[0] == v[1]).all() and not v[2].any()
    with pytest.raises(ValueError):
        embed.model_info("nope")
    assert embed.models_table(spark, "HASH-64").count() == 1
    got = spark.createDataFrame([("x",), (None,)], "t string").select(embed.embed(F.col("t")).alias("v")).collect()
    assert len(got[0]["v"]) == 64 and got[1]["v"] is None


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    f = tmp_path / ".kelpline.toml"
    config.init(f)
    with pytest.raises(FileExistsError):
        config.init(f)
    assert config.load_config(f) == config.Config()
    f.write_text("[chunking]\nchunk_size = 9\nunknown = 1\n[other]\nx = 1\n")
    (tmp_path / "sub").mkdir()
    assert config.find_config(tmp_path / "sub") == f and config.load_config(f).chunking.chunk_size == 9
    monkeypatch.setenv("KELPLINE_STORE", "/s")
    assert config.load_config(f).store.path == "/s"
    assert config.with_overrides(config.Config(), chunk_size=3, model=None).chunking.chunk_size == 3
    assert config.toml_value(True) == "true" and config.toml_value('a"\\') == '"a\\"\\\\"'
    with pytest.raises(TypeError):
        config.toml_value(object())
    (tmp_path / "models--x" / "snapshots").mkdir(parents=True)
    assert config.scrub_model_cache(tmp_path) == ["models--x"]


def test_cli(spark, tree, tmp_path, capsys):
    store_at = f"file://{tmp_path}/cli"
    assert cli.main(["show-excludes"]) == 0 and "node_modules/**" in capsys.readouterr().out
    assert cli.main(["status", str(tree), "-u", store_at], spark) == 0 and cli.main(["clean", str(tree), "-c", "x", "-u", store_at, "-y"], spark) == 1
    assert cli.main(["index", str(tree), "-c", "x", "-u", store_at], spark) == 0 and "added: 4" in capsys.readouterr().out
    assert cli.main(["list-collections", "-u", store_at], spark) == 0 and "x\t3\t64" in capsys.readouterr().out
    assert cli.main(["delete-collection", "x", "-u", store_at, "-y"], spark) == 0 and cli.main(["delete-collection", "x", "-u", store_at, "-y"], spark) == 1
    assert cli.main(["list-models", "hash"], spark) == 0 and cli.main(["index", "/none", "-c", "x", "-u", store_at], spark) == 1
