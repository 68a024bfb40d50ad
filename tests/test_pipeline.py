import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators import dedup, reclassify
from cairn.plans import organize
from cairn.queries import corpus, pipeline
from cairn.sinks import execute, store

NOW = datetime(2025, 1, 1)
FILES = "id long, path string, size long, hash string, extra int"


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "/a/x.txt", 10, "h1"), (2, "/b/x.txt", 10, "h1"), (3, "/c/y.txt", 10, "h1"), (4, "/a/z.txt", 5, "h2"), (5, "/a/big", 9, "METADATA_ONLY"), (6, "/b/big", 9, "METADATA_ONLY"), (7, "/n", None, None), (8, "/e1", 0, "empty"), (9, "/e2", 0, "empty")]
    return spark.createDataFrame([(*r, 0) for r in rows], FILES)


def test_dedup(spark, files):
    marked = {r.id: (r.is_duplicate, r.original_path) for r in dedup.mark_duplicates(files).collect()}
    assert len(marked) == 9 and {i for i, (d, _) in marked.items() if d} == {2, 3, 9} and marked[3][1] == "/a/x.txt" and marked[9][1] == "/e1"
    assert dedup.filter_duplicates(dedup.mark_duplicates(files)).count() == 6
    assert dedup.filter_duplicates(dedup.mark_duplicates(files), True).count() == 9
    assert {(r.hash, r.n, r.wasted) for r in dedup.duplicate_groups(files).collect()} == {("h1", 3, 20), ("empty", 2, 0)}
    t = dedup.duplicate_totals(files).first()
    assert (t.n_groups, t.n_duplicates, t.wasted, t.n_contents, t.n_files, t.n_unique_rows) == (2, 3, 20, 3, 9, 6)
    assert {tuple(r) for r in dedup.same_names(files).collect()} == {("x.txt", 2, "/a/x.txt"), ("x.txt", 2, "/b/x.txt"), ("big", 2, "/a/big"), ("big", 2, "/b/big")}
    assert [(r.group_no, r.hash) for r in dedup.numbered_groups(files).orderBy("group_no").collect()] == [(1, "empty"), (2, "h1")]
    named = files.withColumn("duplicate_of", F.when(F.col("id") == 2, "/a/x.txt").when(F.col("id") == 3, "/gone"))
    assert {r.id: r.original_id for r in dedup.with_originals(named).collect()} == {2: 1, 3: None}
    s = organize.run_summary(dedup.mark_duplicates(files)).first()
    assert (s.n_files, s.n_unique, s.n_duplicates) == (9, 6, 3)
    assert any("h1: 3 files" in line for line in dedup.report(files)) and dedup.report(files.where("id in (1, 4)")) == []
    empty = files.limit(0)
    assert dedup.mark_duplicates(empty).count() == 0 and dedup.duplicate_totals(empty).first().n_groups == 0


def test_whole_report(spark, tmp_path):
    files = spark.range(4400).select("id", F.format_string("/f/%05d", "id").alias("path"), F.lit(3).cast("long").alias("size"), F.format_string("h%04d", F.col("id") % 1100).alias("hash"))
    execute.write_file(dedup.report_lines(files), str(tmp_path / "report"))
    lines = (tmp_path / "report").read_text().splitlines()
    assert lines[:5] == ["DUPLICATE REPORT", "groups: 1,100", "duplicates: 3,300", "wasted: 9,900 bytes (0.01 MB, 0.00 GB)", "#1 h0000: 4 files of 3 bytes, original /f/00000, wasted 9 bytes"]
    assert lines[-4:] == ["#1100 h1099: 4 files of 3 bytes, original /f/01099, wasted 9 bytes", "  duplicate /f/02199", "  duplicate /f/03299", "  duplicate /f/04399"] and len(lines) == 4 + 4400
    assert dedup.report(files)[-1] == "100 more groups are not shown" and len(dedup.report(files)) == 1005
    assert [p.name for p in tmp_path.iterdir()] == ["report"] and dedup.report_lines(files.limit(1)).count() == 0
    odd = spark.createDataFrame([(1, "/a", None, "h"), (2, None, 5, "h")], "id long, path string, size long, hash string")
    assert [r.value for r in dedup.report_lines(odd).collect()][4:] == ["#1 h: 2 files of unknown bytes, original /a, wasted unknown bytes", "  duplicate unknown"]


def test_whole_tree(spark):
    planned = spark.range(2100).select(F.format_string("/o/%04d/x", "id").alias("destination")).union(spark.createDataFrame([("/o/a/b/c/d/e/f/g",)], "destination string"))
    lines = list(organize.tree_text(planned))
    assert len(lines) == 1 + 2100 + 5 + 1 and lines[-1].strip() == "... (deeper folders not shown)"
    assert organize.tree_lines(planned)[-1] == "106 more lines are not shown"


def test_all_values_of_a_frequent_key(spark, tmp_path, monkeypatch):
    rows = [(i, f"/d{i % 2}/f{i}/same.txt", 1) for i in range(50)] + [(50 + i, f"/a.{i}/g/n{i // 30}", 1) for i in range(30)] + [(80 + i, f"/d/h/m{i}.zz", 1) for i in range(30)]
    files = spark.createDataFrame(rows, "id long, path string, size long")
    got = dedup.same_names(files).collect()
    assert {(r.name, r.n) for r in got} == {("same.txt", 50), ("n0", 30)} and sorted(r.path for r in got) == sorted(p for i, p, _ in rows if i < 80)
    files.withColumn("scanned_at", F.lit(NOW)).write.parquet(f"{tmp_path}/files.parquet")
    files.select("id", F.col("id").alias("file_id"), F.lit("other").alias("category"), F.lit(1.0).alias("confidence"), F.lit(NOW).alias("classified_at")).write.parquet(f"{tmp_path}/classifications.parquet")
    monkeypatch.setattr(corpus, "PART", 8)
    names, found = (sorted(corpus.SPARK[q](spark, str(tmp_path)).collect(), key=lambda r: r.part) for q in ("q03", "q04"))
    assert ", ".join(r.example_files for r in names if r.extension == "zz") == ", ".join(sorted(f"m{i}.zz" for i in range(30)))
    assert [r.part for r in names if r.extension == "txt"] == list(range(1, 8)) and {r.file_count for r in names if r.extension == "txt"} == {50}
    assert ", ".join(r.extensions_found for r in found if r.parent_directory == "g/n0") == ", ".join(sorted(f"{i}/g/n0" for i in range(30)))


def test_plan(spark):
    rows = [
        (1, "/U/Desktop/a b.txt", "document", None, None, "/o/Desktop/document/a b.txt"),
        (2, "/U/q/a.txt", "data file", "A B", "2020", "/o/2020/data_file/A_B/a.txt"),
        (3, "/U/q/a.txt", None, None, None, "/o/Unclassified/a.txt"),
        (4, "/U/Desktop/www/http/s/i", "web", None, None, "/o/Desktop/web/http/s/i"),
        (5, "/U/q/i", "web", None, None, "/o/web/i"),
        (6, "/U/PacketTracer/lib/x", "application", None, None, "/o/application/PacketTracer/lib/x"),
        (7, "/U/z/a.txt", None, None, None, "/o/Unclassified/a.txt"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, type string, owner string, year string, want string").withColumn("size", F.col("id"))
    planned = organize.plan(df, "/o/")
    assert all(r.destination == r.want for r in planned.collect())
    assert {r.id for r in organize.mark_collisions(planned).collect() if r.status == "collision"} == {7}
    assert json.loads(organize.dry_run(planned.where("id = 1"), "json").first()[0])["destination"] == "/o/Desktop/document/a b.txt"
    assert organize.dry_run(planned.where("id = 3")).first()[0] == "id=3, path=/U/q/a.txt, type=None, owner=None, year=None, want=/o/Unclassified/a.txt, size=3, destination=/o/Unclassified/a.txt"
    tree = {r.dir: (r.direct, r.below) for r in organize.tree_counts(planned).collect()}
    assert tree["/o"] == (0, 7) and tree["/o/Unclassified"] == (2, 2) and tree["/o/Desktop"] == (0, 2)
    assert organize.common_prefix(planned).first()[0] == "/o"
    assert organize.common_prefix(planned.where("id in (3, 7)")).first()[0] in ("/o/Unclassified", "/o/Unclassified/a.txt")
    assert organize.tree_lines(planned)[0] == "/o" and any("Unclassified (2 files)" in x for x in organize.tree_lines(planned))
    assert json.loads(organize.preview(planned, "json").first()[0]).keys() == {"from", "to"}
    assert organize.enumerate_plan(planned).count() == 7
    assert {r.target_dir for r in organize.folder_groups(df, "/o").collect()} >= {"/o/Unknown/Unknown_Owner/Unknown_Year", "/o/data file/A B/2020"}


def test_the_whole_plan_is_numbered(spark):
    planned = spark.range(2500).select("id", F.format_string("/a/%d", "id").alias("path"), F.lit("data").alias("type"), F.col("id").alias("size"), F.lit("/o/x").alias("destination"))
    got = sorted((r.n, r.source) for r in organize.enumerate_plan(planned).collect())
    assert got == [(i + 1, f"/a/{i}") for i in range(2500)]


def test_reclassify(spark):
    f = spark.createDataFrame([(1, "/a/x.jpg"), (2, "/a/Dropbox/y.jpg"), (3, "/a/gone.txt"), (4, "/a/d.pdf"), (5, "/a/new.zip")], "id long, path string")
    c = spark.createDataFrame([(1, "other"), (2, "other"), (3, "other"), (4, "document")], "file_id long, category string")
    there = f.where("id != 3").select("path")
    done = {r.id: (r.old_category, r.new_category, r.status) for r in reclassify.reclassify(f, c, existing=there, skip_cloud=True).collect()}
    assert done == {1: ("other", "image", "updated"), 2: ("other", "image", "skipped"), 3: ("other", "document", "missing"), 4: ("document", "document", "unchanged"), 5: ("unknown", "archive", "updated")}
    some = reclassify.reclassify(f, c, ["other"])
    assert {r.id for r in some.collect()} == {1, 2, 3}
    assert {tuple(r) for r in reclassify.changes(some).collect()} == {("other", "image", 2), ("other", "document", 1)}
    n = reclassify.counters(reclassify.reclassify(f, c, existing=there, skip_cloud=True)).first()
    assert (n.total, n.checked, n.updated, n.unchanged, n.missing, n.skipped, n.error) == (5, 3, 2, 1, 1, 1, 0)
    bad = reclassify.reclassify(f.unionByName(spark.createDataFrame([(9, None)], f.schema)), c, existing=there)
    assert {r.id for r in bad.collect() if r.status == "error"} == {9} and reclassify.counters(bad).first().error == 1
    assert {r.category for r in reclassify.updates(some).collect()} == {"image", "document"}


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/catalog")
    s.init()
    assert s.read("files").count() == 0
    new = "path string, size long, mtime timestamp_ntz, hash string, metadata_only boolean"
    first = spark.createDataFrame([("/a", 1, None, "h", None), ("/b", 2, None, "h", False), ("/b", 3, None, "i", False), (None, 1, None, "x", None)], new)
    s.replace("files", store.upsert_files(s.read("files"), first, NOW))
    got = {r.path: r for r in s.read("files").collect()}
    assert sorted(r.id for r in got.values()) == [1, 2] and got["/b"].hash == "i" and got["/a"].metadata_only is False
    marks = spark.createDataFrame([("/b", "/a"), ("/zz", "/a")], "path string, duplicate_of string")
    s.replace("files", store.mark_duplicates(s.read("files"), marks))
    second = spark.createDataFrame([("/b", 9, None, "k", True), ("/c", 4, None, "l", False)], new)
    s.replace("files", store.upsert_files(s.read("files"), second, NOW))
    got = {r.path: r for r in s.read("files").collect()}
    assert got["/b"].is_duplicate and got["/b"].duplicate_of == "/a" and got["/b"].size == 9 and got["/c"].id == 3
    ops = spark.createDataFrame([("/a", "MOVE", "/x"), ("/none", "MOVE", "/y")], "path string, action string, target_path string")
    s.append("operations", store.operation_rows(s.read("files"), ops))
    s.append("operations", store.operation_rows(s.read("files"), ops, after=1))
    assert sorted((r.id, r.file_id, r.executed) for r in s.read("operations").collect()) == [(1, got["/a"].id, False), (2, got["/a"].id, False)]
    with pytest.raises(Exception, match="no such action"):
        store.operation_rows(s.read("files"), ops.withColumn("action", F.lit("BURN"))).collect()
    for category in ("image", "video"):
        cls = spark.createDataFrame([("/a", category, 0.8), ("/none", "x", 0.1)], "path string, category string, confidence double")
        s.replace("classifications", store.save_classifications(s.read("classifications"), s.read("files"), cls, NOW))
    (only,) = s.read("classifications").collect()
    assert (only.id, only.category, only.owner) == (1, "video", None)
    s.vacuum("files")
    assert s.read("files").count() == 3
    assert "metadata_only" in store.add_metadata_only(spark.createDataFrame([(1,)], "id int")).columns
    cache = spark.createDataFrame([("/a", "h"), (None, "x"), ("/b", None)], "path string, hash string")
    store.save_json_cache(cache, f"file://{tmp_path}/cache")
    again = store.load_json_cache(spark, f"file://{tmp_path}/cache")
    found = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, mtime int")
    assert {r.path: r.hash for r in store.cached_by_path(found, again).collect()} == {"/a": "h", "/b": None}
    assert store.load_json_cache(spark, f"file://{tmp_path}/none").count() == 0
    known, todo = store.cached_hashes(spark.createDataFrame([("/a", 1), ("/a", 2)], "path string, mtime int"), spark.createDataFrame([("/a", 1, "h"), ("/a", 2, None)], "path string, mtime int, hash string"))
    assert known.first().hash == "h" and todo.count() == 1


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/catalog", bucket_rows=50)
    new = "path string, size long, mtime timestamp_ntz, hash string, metadata_only boolean"
    put = lambda rows: s.merge("files", spark.createDataFrame(rows, new), lambda old, batch, top: store.upsert_files(old, batch, NOW, top=top))
    put([(f"/p{i}", i, None, "h", False) for i in range(400)])
    before = s._current("files")
    assert before["n"] == 8 and before["top"] == before["rows"] == 400 == s.read("files").count()
    put([("/p7", -1, None, "h", False), ("/new", 5, None, "h", False)])
    after = s._current("files")
    same = [b for b in before["buckets"] if after["buckets"][b] == before["buckets"][b]]
    assert len(same) >= 6 and (after["rows"], after["top"]) == (401, 401)
    got = {r.path: (r.id, r.size) for r in s.read("files").collect()}
    assert len(got) == 401 and got["/p7"][1] == -1 and got["/new"] == (401, 5) and len({i for i, _ in got.values()}) == 401
    s.vacuum("files")
    assert s.read("files").count() == 401
    put([])
    assert s.read("files").count() == 401


def test_every_file_meets_the_earlier_catalog(spark, tmp_path):
    days = [None, datetime(2024, 1, 3), datetime(2024, 1, 4), datetime(2025, 5, 14)]
    rows = [(i, f"/f{i}", i, NOW, f"h{i}", False, False, days[i % 4]) for i in range(1, 9)]
    kinds = "id long, path string, size long, mtime timestamp_ntz, hash string, metadata_only boolean, is_duplicate boolean, scanned_at timestamp_ntz"
    spark.createDataFrame(rows, kinds).withColumn("duplicate_of", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/files.parquet")
    got = {r.path: r.hash for r in pipeline.SPARK["hash_cache"](spark, str(tmp_path)).collect()}
    assert got == {f"/f{i}": f"h{i}" if i % 4 in (1, 2) else None for i in range(1, 9)}
    assert {r.path: r.size for r in pipeline.SPARK["upsert_files"](spark, str(tmp_path)).collect()} == {f"/f{i}": i + 1 for i in range(1, 9)}


def test_copy(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "there").write_text("old")
    rows = [(f"{tmp_path}/a.txt", f"{tmp_path}/new/d/a.txt"), (f"{tmp_path}/none", f"{tmp_path}/q"), (f"{tmp_path}/a.txt", f"{tmp_path}/there"), (f"{tmp_path}/new0", f"{tmp_path}/z")]
    (tmp_path / "new0").mkdir()
    df = spark.createDataFrame(rows, "path string, destination string")
    assert "copied" not in {r.status for r in execute.copy_files(df).collect()} and not (tmp_path / "new").exists()
    got = {r.destination.rsplit("/", 1)[1]: r.status for r in execute.copy_files(df, True).collect()}
    assert got == {"a.txt": "copied", "q": "missing", "there": "exists", "z": "error"}
    assert (tmp_path / "new/d/a.txt").read_text() == "x" and (tmp_path / "there").read_text() == "old"
    side = execute.sidecars(df.withColumn("size", F.lit(3))).first()
    assert side.path.endswith(".meta.json") and json.loads(side.value)["size"] == 3
    meta = execute.document_fields(spark.createDataFrame([("/a/b.pdf", "o", None, "t"), ("/a/b.mp3", "o", 1999, "t")], "path string, owner string, year int, type string"))
    assert {(r.key, r.value) for r in meta.collect()} == {("title", "b.pdf"), ("author", "o"), ("keywords", "t"), ("title", "b.mp3"), ("artist", "o"), ("date", "1999")}
