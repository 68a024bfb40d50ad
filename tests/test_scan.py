import hashlib
import os

import pytest

from cairn.sources import scan as s


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for rel, text in {
        "one.txt": "1", "d/two.txt": "22", "d/_under.txt": "u", "d/.hidden": "h", ".git/config": "g", "d/e/three.tmp": "3",
        "T.app/Contents/MacOS/T": "#!/bin/bash\n", "T.app/Contents/Info.plist": "<plist/>", "T.app/Contents/Resources/icon.png": "png", "T.app/Contents/a-b": "x", "T.app/Contents/a/b": "y",
        "disk.iso": "iso", "I.app/inner/f.txt": "f", "same.txt": "1",
    }.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def listed(df, root):
    return {os.path.relpath(r.path, root): r for r in df.collect()}


def test_scan(spark, tree):
    got = listed(s.scan(spark, str(tree)), tree)
    assert set(got) == {"one.txt", "d/two.txt", "d/_under.txt", "d/e/three.tmp", "T.app", "disk.iso", "I.app", "same.txt"}
    assert got["one.txt"].hash == hashlib.sha256(b"1").hexdigest() == got["same.txt"].hash
    assert got["T.app"].is_dir and got["T.app"].size == 12 + 8 + 3 + 1 + 1
    want = hashlib.sha256()
    for rel, text in (("Contents/Info.plist", "<plist/>"), ("Contents/MacOS/T", "#!/bin/bash\n"), ("Contents/Resources/icon.png", "png"), ("Contents/a/b", "y"), ("Contents/a-b", "x")):
        want.update(rel.encode() + text.encode())
    assert got["T.app"].hash == want.hexdigest()
    (tree / "T.app/Contents/a/b").write_text("z")
    assert listed(s.scan(spark, str(tree)), tree)["T.app"].hash != want.hexdigest()


def test_options(spark, tree):
    got = listed(s.scan(spark, str(tree), patterns=["*.tmp", "I.app"], metadata_only_size=10), tree)
    assert "d/e/three.tmp" not in got and "I.app" not in got and "I.app/inner/f.txt" in got
    assert got["T.app"].hash == "METADATA_ONLY" and got["T.app"].metadata_only and not got["one.txt"].metadata_only
    assert set(listed(s.scan(spark, str(tree), names=["d", "d", "none"]), tree)) == {"d/two.txt", "d/_under.txt", "d/e/three.tmp"}
    few = s.scan(spark, str(tree), max_files=3).collect()
    assert len(few) == 3 and all(r.hash for r in few)
    assert s.scan(spark, str(tree), max_files=0).count() == 8
    bare = s.scan(spark, str(tree), hashes=False)
    assert {r.hash for r in bare.collect()} == {None}
    assert {r.hash for r in s.hash_column(bare).collect()} == {r.hash for r in s.scan(spark, str(tree)).collect()}


def test_walk_without_rules(spark, tree):
    got = {os.path.relpath(r.path, tree): r.size for r in s.walk(spark, str(tree)).collect()}
    assert len(got) == 14 and got[".git/config"] == 1 and got["T.app/Contents/MacOS/T"] == 12


def test_tasks_follow_the_folders(tmp_path, monkeypatch):
    """One big folder is not one task, whether its files lie below it or in it."""
    monkeypatch.setattr(s, "FILES_A_TASK", 10)
    for k in range(40):
        p = tmp_path / "one" / f"sub{k % 4}" / "x"
        p.mkdir(parents=True, exist_ok=True)
        (p / f"f{k}").write_text("x")
        (tmp_path / "one" / f"g{k}").write_text("x")
    for many in ("3", "64"):
        reader = s.TreeReader({"path": str(tmp_path), "partitions": many})
        parts = reader.partitions()
        got = [r[0] for p in parts for r in reader.read(p)]
        assert len(got) == len(set(got)) == 80 and len(parts) >= 3
    assert max(sum(1 for _ in reader.read(p)) for p in parts) < 30


def test_patterns(tmp_path):
    assert s.read_patterns("# c\n\n *.tmp \n/a*\n") == ["*.tmp", "/a*"]
    assert s.load_patterns(str(tmp_path / "none")) == []


def test_stream(spark, tmp_path):
    from cairn.schemas import FILES
    from cairn.sinks.store import Store
    from cairn.streaming import watch

    rows = [(i, f"/p/{i % 3}", i, None, f"h{i}", False, False, None, None) for i in range(6)]
    from datetime import datetime

    rows = [(*r[:8], datetime(2024, 1, 1 + r[0])) for r in rows]
    spark.createDataFrame(rows[:3], FILES).write.parquet(f"{tmp_path}/in/a")
    store = Store(spark, f"file://{tmp_path}/store")
    store.init()
    for part in ("a", "b"):
        if part == "b":
            spark.createDataFrame(rows[3:], FILES).write.parquet(f"{tmp_path}/in/b")
        q = watch.keep(watch.arrivals(spark, f"{tmp_path}/in/*"), store, f"{tmp_path}/check")
        q.awaitTermination(120)
    assert {(r.path, r.hash) for r in store.read("files").collect()} == {("/p/0", "h3"), ("/p/1", "h4"), ("/p/2", "h5")}
    q = watch.by_period(watch.arrivals(spark, f"{tmp_path}/in/*")).writeStream.format("memory").queryName("periods").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("periods").count() == 6
