import pathlib
import re

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p5_found", "dup_groups", "classified", "q01", "d29"} <= set(entry.queries())


def test_nothing_outside_imports_the_text_package():
    for p in (ROOT / "cairn").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:(?:from|import) cairn\.llm|from cairn import .*\bllm\b|from \.+ ?import .*\bllm\b|from \.+llm)", p.read_text(), re.M), p


def test_entry(spark):
    if not pathlib.Path("/root/testdata/sf0.001").exists():
        pytest.skip("the driver's tables are not here")
    assert entry.entry(spark).count() > 0
