"""Path, name and size functions as column expressions: no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder and date forms, package extensions, cloud folders.
STANDARD_FOLDERS = ("Desktop", "Documents", "Downloads", "Pictures", "Movies", "Music")
GENERIC_FOLDERS = ("files", "data", "stuff", "misc", "other", "folder")
DATE_FORMS = (r"[0-9]{1,2}[A-Za-z]{3}[0-9]{2,4}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}-[0-9]{2}-[0-9]{4}", r"[0-9]{8}", r"[A-Za-z]{3,9}[0-9]{4}", r"[0-9]{4}[A-Za-z]{3,9}")
PACKAGE_EXTENSIONS = (".app", ".pkg", ".mpkg", ".dmg", ".iso", ".img", ".vhd", ".vmdk", ".vdi", ".ova", ".ovf", ".toast", ".cdr", ".nrg", ".mds", ".mdf")
CLOUD_PARTS = ("Google Drive", "Dropbox", "OneDrive", "iCloud Drive", "Box Sync", "Library/CloudStorage")

DATE_PATTERN = "^(?:" + "|".join(DATE_FORMS) + ")"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    """What follows the last slash."""
    return F.substring_index(_c(path), "/", -1)


def parent(path: Column | str) -> Column:
    """The folder a path lies in, without the last slash; empty at the root."""
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def file_ext(path: Column | str) -> Column:
    """What follows the last dot, or the whole string where there is none."""
    return F.substring_index(_c(path), ".", -1)


def suffix(path: Column | str) -> Column:
    """The lower-case extension of the name with its dot; empty where there is none.

    A dot that begins or ends the name opens no extension.
    """
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def is_hidden(path: Column | str) -> Column:
    """Whether the name or any folder above it begins with a dot; paths are absolute."""
    return _c(path).rlike(r"/\.")


def is_package(path: Column | str) -> Column:
    return suffix(path).isin(*PACKAGE_EXTENSIONS)


def is_cloud(path: Column | str) -> Column:
    return _any(*(_c(path).contains(x) for x in CLOUD_PARTS))


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def fnmatch_regex(pattern: str) -> str:
    """A shell pattern (`*`, `?`, `[seq]`, `[!seq]`) as a regular expression for a whole name."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = pattern.find("]", i + (pattern[i : i + 1] in "!]") + (pattern[i : i + 2] == "!]"))
            if end < 0:
                out.append(r"\[")
            else:
                inner = re.sub(r"([\\\[\]&~^])", r"\\\1", pattern[i:end])
                out.append(f"[^{inner[1:]}]" if inner.startswith("!") else f"[{inner}]")
                i = end + 1
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + "$"


def is_ignored(path: Column | str, patterns: list[str]) -> Column:
    """Whether any pattern fits: `/…*` by prefix, `/…` by equality, all others on the name alone."""
    p = _c(path)
    fits = []
    for x in patterns:
        if x.startswith("/"):
            fits.append(p.startswith(x[:-1]) if x.endswith("*") else p == x)
        else:
            fits.append(file_name(p).rlike(fnmatch_regex(x)))
    return _any(*fits)


def ancestors(path: Column | str) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def is_date_like(text: Column | str) -> Column:
    """Whether a text begins in one of the date forms."""
    return _c(text).rlike(DATE_PATTERN)


def path_parts(path: Column | str) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda x: x != "")


def path_metadata(path: Column | str) -> Column:
    """Struct of root_folder, relative_path, parent_folders, tags, date_tags, category_tags.

    The root is the first part that is a standard folder, or holds ` - ` and a standard folder's
    name; the file's own name may be it. Without a root all is null or empty.
    """
    parts = path_parts(path)

    def roots(x: Column) -> Column:
        return x.isin(*STANDARD_FOLDERS) | (x.contains(" - ") & _any(*(x.contains(f) for f in STANDARD_FOLDERS)))

    at = F.array_position(F.transform(parts, roots), True)
    n = F.size(parts)
    none = F.array().cast("array<string>")
    parents = F.when((at > 0) & (at < n - 1), F.slice(parts, at.cast("int") + 1, (n - at - 1).cast("int"))).otherwise(none)
    tags = F.filter(parents, lambda x: ~F.lower(x).isin(*GENERIC_FOLDERS))
    return F.struct(
        F.when(at > 0, F.get(parts, at.cast("int") - 1)).alias("root_folder"),
        F.when((at > 0) & (at < n), F.array_join(parents, "/")).alias("relative_path"),
        parents.alias("parent_folders"),
        tags.alias("tags"),
        F.filter(tags, is_date_like).alias("date_tags"),
        F.filter(tags, lambda x: ~is_date_like(x)).alias("category_tags"),
    )


def metadata_label(md: Column | str) -> Column:
    """`Root: … | Categories: a, b | Dates: …`, without empty parts."""
    m = _c(md)
    some = lambda name, field: F.when(F.size(m[field]) > 0, F.concat(F.lit(f"{name}: "), F.array_join(m[field], ", ")))
    return F.concat_ws(" | ", F.when(m["root_folder"] != "", F.concat(F.lit("Root: "), m["root_folder"])), some("Categories", "category_tags"), some("Dates", "date_tags"))


def owner_from_path(path: Column | str) -> Column:
    """What follows ` - ` in the first part that holds it, or null."""
    part = F.get(F.filter(path_parts(path), lambda x: x.contains(" - ")), 0)
    return F.substring(part, F.locate(" - ", part) + 3, F.lit(1 << 30))


def top_folder(path: Column | str, base: str) -> Column:
    """The first part below base, or null outside it."""
    root = base.rstrip("/") + "/"
    p = _c(path)
    return F.when(p.startswith(root), F.split(F.substring(p, F.lit(len(root) + 1), F.lit(1 << 30)), "/")[0])


SIZE = re.compile(r"^(\d+(?:\.\d+)?)\s*([KMGT]?B?)$")
UNITS = {"": 1, "B": 1, "K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4}


def parse_size(text: str | None) -> int | None:
    """Bytes of `75MB`, `1.5k`, `10`; None for an empty text; ValueError for anything else."""
    if not text:
        return None
    m = SIZE.match(text.upper().strip())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].removesuffix("B") if len(m[2]) > 1 else m[2]])


def size_bytes(text: Column | str) -> Column:
    """parse_size as a column; null where the text is no size."""
    t = F.upper(F.trim(_c(text)))
    ok = t.rlike(SIZE.pattern)
    unit = F.substring(F.regexp_extract(t, SIZE.pattern, 2), 1, 1)
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return F.when(ok, F.floor(F.try_to_number(F.regexp_extract(t, SIZE.pattern, 1), F.lit("999999999999.999999")).cast("double") * scale).cast("long"))


def hundredths(amount: Column, unit: int) -> Column:
    """amount / unit, rounded to two places with exact integers (halves away from zero)."""
    return F.call_function("div", amount * 100 + unit // 2, F.lit(unit).cast("long")) / F.lit(100.0)


def thousands(n: Column) -> Column:
    return F.format_string("%,d", n)
