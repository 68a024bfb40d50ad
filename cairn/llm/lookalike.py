"""One form for strings that look the same and are written with different characters.

A batch of Arrow strings is copied into one array of code points. Tables indexed by code point then
fold the width of characters, split letters from their marks, replace look-alike letters and spaces
and drop what has no width; characters that become several are placed by expansion offsets. Marks
are put into canonical order and composed again, pass by pass over the whole batch. No Python call
is made for a single string.

The form keeps letter case, accents and every visible character: strings that differ in those keep
different forms. Null stays null, the empty string stays empty, ASCII text is unchanged.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.skew import fragment_join, plan_fragments
from cairn.session import cut

# Letters of other scripts (left) that cannot be told from the Latin ones (right).
LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТУХҮԚԜѴӀԌ", "ABESIJKMHOPCTYXYQWVIG"),  # Cyrillic
    ("аеорсухѕіјԁһԛԝѵӏ", "aeopcyxsijdhqwvl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹ", "ABEZHIKMNOPTYXJC"),  # Greek
    ("ονρϳϲ", "ovpjc"),
    ("օսՕ", "ouO"),  # Armenian
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ"),  # Cherokee
    ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"),  # Roman numerals
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ɑɡ‐‑⁄∕․", "ag--//."),
)
#: Ranges without width or ink, besides all format characters.
INVISIBLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0x0, 0x8), (0xE, 0x1F), (0x7F, 0x9F), (0xE0100, 0xE01EF))
#: Fixed values of the Hangul block: first syllable, leading, vowel and trailing letters.
S0, L0, V0, T0, LN, VN, TN = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28
TOP = 0x110000
CHUNK = 1 << 22  #: bytes of text worked on at once


def _width(c: str) -> str:
    """The character without its width form; presentation ligatures are taken apart."""
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>")) or "ﬀ" <= c <= "ﬆ":
        return unicodedata.normalize("NFKC", c)
    return c


@cache
def tables() -> tuple[np.ndarray, ...]:
    """By code point: start and length of its expansion, the flat expansions, its combining class;
    and the compositions as sorted keys (first << 21 | second) with their results."""
    alike = {ord(a): b for left, right in LOOKALIKES for a, b in zip(left, right, strict=True)}
    gone = np.zeros(TOP, bool)
    for a, b in INVISIBLE:
        gone[a : b + 1] = True
    start, length, ccc = np.arange(TOP, dtype=np.int32), np.ones(TOP, np.int32), np.zeros(TOP, np.uint8)
    flat, pairs = list(range(TOP)), {}
    for n in (*range(0x30000), *range(0xE0000, 0xE0200)):
        if 0xD800 <= n < 0xE000 or S0 <= n < S0 + LN * VN * TN:
            continue
        c = chr(n)
        kind = unicodedata.category(c)
        ccc[n] = unicodedata.combining(c)
        if kind == "Cf" or gone[n]:
            length[n] = 0
            continue
        if kind == "Zs":
            to = " "
        else:
            to = "".join(alike.get(ord(x), x) for x in unicodedata.normalize("NFD", _width(c)))
        if to != c:
            start[n], length[n] = len(flat), len(to)
            flat.extend(map(ord, to))
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = n
    # a letter that was replaced composes like its replacement, and only so
    pairs = {k: v for k, v in pairs.items() if (k >> 21) not in alike}
    keys = np.array(sorted(pairs), np.int64)
    return start, length, np.array(flat, np.int32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.int32)


def _composed(first: np.ndarray, second: np.ndarray, keys: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The composition of each pair, or -1."""
    k = first.astype(np.int64) << 21 | second
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    out = np.where(keys[at] == k, to[at], -1)
    lv = (first >= L0) & (first < L0 + LN) & (second >= V0) & (second < V0 + VN)
    out = np.where(lv, S0 + ((first - L0) * VN + second - V0) * TN, out)
    lvt = (first >= S0) & (first < S0 + LN * VN * TN) & ((first - S0) % TN == 0) & (second > T0) & (second < T0 + TN)
    return np.where(lvt, first + second - T0, out)


def fold_codes(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form of code points, row being the number of the string each belongs to, ascending."""
    start, length, flat, ccc, keys, to = tables()
    n = length[codes]
    ends = np.cumsum(n)
    if not len(codes) or not ends[-1]:
        return codes[:0], row[:0]
    at = np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1])
    codes, row = flat[at], np.repeat(row, n)
    cc = ccc[codes]
    marks = cc > 0
    if marks.any():  # canonical order within each run of marks
        run = np.cumsum(~marks) + row
        order = np.flatnonzero(marks)
        codes = codes.copy()
        codes[order] = codes[order[np.lexsort((order, cc[order], run[order], row[order]))]]
        cc = ccc[codes]
    special = marks | ((codes >= V0) & (codes < T0 + TN))
    while special.any():
        place = np.arange(len(codes))
        base = np.maximum.accumulate(np.where(cc == 0, place, -1))
        before = np.concatenate(([-1], base[:-1]))  # the starter left of each place
        p = place[special & (before >= 0)]
        b = before[p]
        adjacent = b == p - 1
        free = (row[b] == row[p]) & (adjacent | ((cc[p - 1] > 0) & (cc[p - 1] < cc[p])))
        p, b = p[free], b[free]
        c = _composed(codes[b], codes[p], keys, to)
        p, b, c = p[c >= 0], b[c >= 0], c[c >= 0]
        if not len(p):
            break
        b, first = np.unique(b, return_index=True)
        p, c = p[first], c[first]
        keep = np.ones(len(codes), bool)
        clash = np.isin(b, p)  # its starter goes in this same pass; it waits for the next
        b, p, c = b[~clash], p[~clash], c[~clash]
        codes[b] = c
        keep[p] = False
        codes, row, special = codes[keep], row[keep], special[keep]
        cc = ccc[codes]
    return codes, row


def _fold_chunk(a: pa.StringArray) -> pa.StringArray:
    n = len(a)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + n + 1]
    raw = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(raw) or (raw < 0x7F).all() and (raw >= 0x20).all():
        return a
    letters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    bounds = letters[offsets - offsets[0]]
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    codes, row = fold_codes(codes, np.repeat(np.arange(n), np.diff(bounds)))
    size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, size, minlength=n)))).astype(np.int32)
    data = codes.astype("<i4").tobytes().decode("utf-32-le").encode("utf-8")
    null = None if not a.null_count else pa.py_buffer(np.packbits(np.asarray(a.is_valid()), bitorder="little").tobytes())
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(data), null)


def fold_array(a: pa.Array) -> pa.Array:
    """The form of every string of an Arrow array."""
    a = a.cast(pa.large_string()) if not pa.types.is_string(a.type) else a
    if pa.types.is_large_string(a.type):
        a = a.cast(pa.string())
    parts, at = [], 0
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        parts.append(_fold_chunk(a.slice(at, to - at)))
        at = to
    return pa.concat_arrays(parts) if parts else a


def visible_form(c: Column | str) -> Column:
    """The form of a string column."""

    @F.arrow_udf("string")
    def form(a: pa.Array) -> pa.Array:
        return fold_array(a)

    return form(c)


def forms(files: DataFrame) -> DataFrame:
    """id, field (path or duplicate_of), text and its form, for every string that is not null."""
    one = lambda f: files.select("id", F.lit(f).alias("field"), F.col(f).alias("text"))
    return one("path").unionByName(one("duplicate_of")).where("text is not null").withColumn("form", visible_form("text"))


def lookalike_pairs(files: DataFrame) -> DataFrame:
    """id_a < id_b and field, for different ids whose strings have one form and are written differently.

    field path compares both paths, duplicate_of the duplicate_of of either with the path of the
    other. Only forms with more than one way of writing, found by an aggregate that combines before
    it shuffles, enter the joins. Strings are compared by 128 bits of hash. Rows without id make no
    pair; rows delivered twice make no further one.
    """
    both = lambda c, x, y: (F.xxhash64(c).alias(x), F.xxhash64(F.lit(7), c).alias(y))
    rows = cut(
        forms(files.select("id", "path", "duplicate_of").where("id is not null"))
        .select("id", (F.col("field") == "path").alias("is_path"), *both("form", "f1", "f2"), *both("text", "h1", "h2"))
    )
    one = F.struct("h1", "h2")
    several = rows.groupBy("f1", "f2").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.bool_or("is_path").alias("p")).where("a != b and p").select("f1", F.col("f2").alias("g2"))
    # one half of a form's hash leads rows to their task, both must agree; a form that many rows bear is cut
    held = cut(fragment_join(rows, several, "f1", ["id"]).where("f2 = g2").drop("g2").distinct())
    paths = held.where("is_path").select("f1", F.col("f2").alias("g2"), F.col("id").alias("to"), F.col("h1").alias("t1"), F.col("h2").alias("t2"))
    met = fragment_join(held, paths, "f1", ["id", "h1"], "inner", plan_fragments(held, "f1", power=2)).where("f2 = g2 and id != to and (h1 != t1 or h2 != t2)")
    return met.select(F.least("id", "to").alias("id_a"), F.greatest("id", "to").alias("id_b"), F.when(F.col("is_path"), "path").otherwise("duplicate_of").alias("field")).distinct()
