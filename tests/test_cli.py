import json
import os

import pytest

from cairn import cli
from cairn.sinks.store import Store


@pytest.fixture
def source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *a: spark)
    monkeypatch.chdir(tmp_path)
    src = tmp_path / "src"
    (src / "Desktop").mkdir(parents=True)
    for name, text in (("a.txt", "1"), ("b.txt", "1"), ("c.zzz", "2"), ("d.jpg", "3")):
        (src / "Desktop" / name).write_text(text)
    return src


def operations(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/cat").read("operations").collect()


def test_run_and_reclassify(spark, source, tmp_path, capsys):
    args = [str(source), "--base-dir", str(tmp_path / "out"), "--skip-duplicates", "--catalog", f"file://{tmp_path}/cat", "--execute", "--write-metadata", "--preview-log", f"file://{tmp_path}/log", "--duplicate-report", str(tmp_path / "report.txt")]
    assert cli.main(args) == 0
    out = tmp_path / "out" / "Desktop"
    assert sorted(p.name for p in out.rglob("*") if p.is_file()) == ["a.txt", "a.txt.meta.json", "c.zzz", "c.zzz.meta.json", "d.jpg", "d.jpg.meta.json"]
    side = json.loads((out / "image" / "d.jpg.meta.json").read_text())
    assert side["original_path"].endswith("/Desktop/d.jpg") and side["is_duplicate"] is False and side["path_metadata"]["root_folder"] == "Desktop" and len(side["hash"]) == 64
    assert "1 files" not in (tmp_path / "report.txt").read_text() and "2 files" in (tmp_path / "report.txt").read_text()
    assert sorted(os.path.basename(r.target_path) for r in operations(spark, tmp_path)) == ["a.txt", "c.zzz", "d.jpg"]
    capsys.readouterr()
    (source / "Desktop" / "d.jpg").unlink()
    assert cli.main(["reclassify", "--catalog", f"file://{tmp_path}/cat", "--all"]) == 0
    # the duplicate was left out of the plan, so it has no classification yet
    said = capsys.readouterr().out
    assert "unknown -> document: 1" in said and "'missing': 1" in said and "'error': 0" in said
    # what is there already is not copied and not logged again
    assert cli.main(args) == 0 and len(operations(spark, tmp_path)) == 3


def test_a_run_without_execute_logs_no_operation(spark, source, tmp_path):
    assert cli.main([str(source), "--base-dir", str(tmp_path / "out"), "--catalog", f"file://{tmp_path}/cat", "--dry-run-log", "--log-format", "json"]) == 0
    assert operations(spark, tmp_path) == [] and list((tmp_path / "out").iterdir()) == []
    (log,) = tmp_path.glob("dry_run_preview_*.json")
    rows = [json.loads(x) for p in log.glob("part-*") for x in p.read_text().splitlines()]
    assert len(rows) == 4 and all(r["destination"].startswith(str(tmp_path / "out")) for r in rows) and sum(r["is_duplicate"] for r in rows) == 1


def test_max_files_still_finds_duplicates(spark, source, tmp_path):
    report = tmp_path / "report.txt"
    assert cli.main([str(source), "--base-dir", str(tmp_path / "out"), "--max-files", "2", "--duplicate-report", str(report)]) == 0
    assert "duplicates: 1" in report.read_text()


def test_session_takes_the_one_there_is(spark):
    from cairn.session import session

    assert session().sparkContext is spark.sparkContext
