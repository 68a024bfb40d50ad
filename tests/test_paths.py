import fnmatch
import pathlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import paths


def column(spark, values, c):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_suffix_and_names(spark):
    names = ["/a/foo.", "/a/.bashrc", "/a/.a.b", "/a/a..b", "/a/a.B", "/a.d/x", "/a/x.tar.gz", "x", "", None, "/a/ü.Ä"]
    want = [None if n is None else pathlib.PurePosixPath(n).suffix.lower() for n in names]
    assert column(spark, names, paths.suffix("x")) == ["" if n is not None and not w else w for n, w in zip(names, want)]
    assert column(spark, ["/a/b.c", "b", None], paths.file_name("x")) == ["b.c", "b", None]
    assert column(spark, ["/a/b.c", "b", "/b"], paths.parent("x")) == ["/a", "", ""]
    assert column(spark, ["/a.b/c", "x.tar.gz", "none"], paths.file_ext("x")) == ["b/c", "gz", "none"]


def test_hidden_and_packages(spark):
    assert column(spark, ["/a/.b/c", "/a/.b", "/a/b", "/.x/y/z", "/a/b.c"], paths.is_hidden("x")) == [True, True, False, True, False]
    assert column(spark, ["/A/X.app", "/A/x.DMG", "/A/x.txt", "/A/app"], paths.is_package("x")) == [True, True, False, False]


@settings(max_examples=60, deadline=None)
@given(st.text("ab[]!-*?.^\\", max_size=6), st.lists(st.text("ab.-!", max_size=5), min_size=1, max_size=6))
def test_fnmatch(pattern, names):
    import re

    rx = re.compile(paths.fnmatch_regex(pattern))
    assert [bool(rx.match(n)) for n in names] == [fnmatch.fnmatchcase(n, pattern) for n in names]


def test_ignored(spark):
    pats = ["*.tmp", "/abs/file", "/abs/dir*", "[ab]*"]
    given_, want = ["/x/y.tmp", "/abs/file", "/abs/file2", "/abs/directory/z", "/q/apple", "/q/Cat"], [True, True, False, True, True, False]
    assert column(spark, given_, paths.is_ignored("x", pats)) == want
    assert column(spark, given_, paths.is_ignored("x", [])) == [False] * 6


def test_metadata(spark):
    rows = column(
        spark,
        ["/U/a/Documents/Documents - 77AB/Pictures/8May16/i.JPG", "/U/Documents/i.JPG", "/U/x/i.JPG", "/U/Music/misc/STAT4010/Q1-2024/a", "/U/x/Documents - n.txt", None],
        paths.path_metadata("x"),
    )
    a, b, c, d, e, n = rows
    assert (a.root_folder, a.relative_path, a.tags) == ("Documents", "Documents - 77AB/Pictures/8May16", ["Documents - 77AB", "Pictures", "8May16"])
    assert a.date_tags == ["8May16"] and a.category_tags == ["Documents - 77AB", "Pictures"]
    assert (b.root_folder, b.relative_path, b.parent_folders) == ("Documents", "", [])
    assert (c.root_folder, c.relative_path, c.tags) == (None, None, [])
    assert d.tags == ["STAT4010", "Q1-2024"] and d.date_tags == ["STAT4010"]
    assert e.root_folder == "Documents - n.txt" and e.parent_folders == []
    assert n is None or n.root_folder is None
    label = paths.metadata_label(paths.path_metadata("x"))
    assert column(spark, ["/U/Music/mix/8May16/a", "/q/a"], label) == ["Root: Music | Categories: mix | Dates: 8May16", ""]


def test_owner_and_top(spark):
    assert column(spark, ["/U/Documents - a - b/x", "/U/x"], paths.owner_from_path("x")) == ["a - b", None]
    assert column(spark, ["/base/q/r", "/base/q", "/other/q"], paths.top_folder("x", "/base")) == ["q", "q", None]


def test_sizes(spark):
    texts = ["75MB", "1GB", "500KB", "1.5k", "10", "0MB", "3 tb", "7B"]
    want = [75 << 20, 1 << 30, 500 << 10, 1536, 10, 0, 3 << 40, 7]
    assert [paths.parse_size(t) for t in texts] == want
    assert paths.parse_size("") is None and paths.parse_size(None) is None
    with pytest.raises(ValueError):
        paths.parse_size("abc")
    assert column(spark, [*texts, "abc", "", None], paths.size_bytes("x")) == [*want, None, None, None]


def test_rounding(spark):
    df = spark.createDataFrame([(1_048_576,), (1_053_819,), (0,), (None,)], "n long")
    assert [r[0] for r in df.select(paths.hundredths(F.col("n"), 1 << 20)).collect()] == [1.0, 1.01, 0.0, None]
