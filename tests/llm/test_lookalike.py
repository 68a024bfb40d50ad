import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.lookalike import INVISIBLE, LOOKALIKES, fold_array, lookalike_pairs

ALIKE = {a: b for x, y in LOOKALIKES for a, b in zip(x, y, strict=True)}


def slow(s):
    out = []
    for c in s:
        if unicodedata.category(c) == "Cf" or any(a <= ord(c) <= b for a, b in INVISIBLE):
            continue
        d = unicodedata.decomposition(c)
        w = unicodedata.normalize("NFKC", c) if d.startswith(("<wide>", "<narrow>")) or "ﬀ" <= c <= "ﬆ" else c
        out.append(" " if unicodedata.category(c) == "Zs" else w)
    s = "".join(ALIKE.get(c, c) for c in unicodedata.normalize("NFD", "".join(out)))
    return unicodedata.normalize("NFC", s)


LETTERS = "aeoOcnzABе оȩ̣́́̈̊​­ 　ＡｂÖёЁй한한ﾊﾞﬁÅ写/.-1lI"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(LETTERS, max_size=12), st.text(max_size=6)), max_size=8))
def test_equals_row_by_row(rows):
    rows = [None if r is None else r.encode("utf-8", "ignore").decode() for r in rows]
    assert fold_array(pa.array(rows, pa.string())).to_pylist() == [None if r is None else slow(r) for r in rows]


def test_slices_and_long_text():
    text = ["x", None, "", "é" * 200_000, "é" * 3_000_000, "ａ"]
    a = pa.array(text).slice(1)
    assert fold_array(a).to_pylist() == [None, "", "é" * 200_000, "é" * 3_000_000, "a"]


def brute(rows):
    found = set()
    for i, p, d in rows:
        for j, q, e in rows:
            if i is None or j is None or i == j:
                continue
            a, b = min(i, j), max(i, j)
            if p is not None and q is not None and p != q and slow(p) == slow(q):
                found.add((a, b, "path"))
            if d is not None and q is not None and d != q and slow(d) == slow(q):
                found.add((a, b, "duplicate_of"))
    return found


def test_pairs_equal_brute_force(spark):
    r = random.Random(5)
    names = ["/a/résumé.txt", "/a/résumé.txt", "/a/resume.txt", "/b c/О.md", "/b c/O.md", "/B c/O.md", "/x​/y", "/x/y", "", None]
    rows = [(r.choice([None, *range(30)]), r.choice(names), r.choice(names)) for _ in range(80)]
    rows += rows[:10]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "id long, path string, duplicate_of string, form int, f1 int")
    assert {tuple(x) for x in lookalike_pairs(df).collect()} == brute(rows)
    assert lookalike_pairs(df.limit(0)).count() == 0
