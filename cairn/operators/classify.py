"""Classifying files by the rules in functions.rules: one projection with two small lookups, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import rules
from cairn.functions.paths import _any, file_name, suffix

MIME_EXT, SUFFIX = "__cairn_mime_ext", "__cairn_suffix"


def _raw_ext(name: Column) -> Column:
    """From the last dot on, unless only dots come before it."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def mime_extension(path: Column | str) -> Column:
    """The extension that decides the MIME type: `.tgz` stands for `.tar.gz`, and one encoding is taken off."""
    name = file_name(path)
    own = _raw_ext(name)
    full = name
    for short, long in sorted(rules.SUFFIX_MAP.items()):
        full = F.when(F.lower(own) == short, F.concat(F.substring(name, F.lit(1), F.length(name) - len(short)), F.lit(long))).otherwise(full)
    last = _raw_ext(full)
    inner = _raw_ext(F.substring(full, F.lit(1), F.length(full) - F.length(last)))
    return F.lower(F.when(last.isin(*rules.ENCODINGS), inner).otherwise(last))


def by_name_and_path(path: Column | str) -> Column:
    """The category of files that neither MIME type nor extension decides; `other` at last."""
    p = F.col(path) if isinstance(path, str) else path
    exact, name, low, ext = file_name(p), F.lower(file_name(p)), F.lower(p), suffix(p)
    has = lambda c, words: _any(*(c.contains(w) for w in words))
    return (
        F.when(exact.isin(*rules.CODE_NAMES), "code")
        .when(exact.isin(*rules.SYSTEM_NAMES), "system")
        .when(p.contains("/Contents/MacOS/") & (ext == ""), "installer")
        .when(p.contains("/Contents/PlugIns/") | p.contains("/Contents/Resources/"), "system")
        .when(name.contains("alias") | (ext == ".alias"), "shortcut")
        .when(name.contains(".log") | ext.isin(".log", ".log2"), "system")
        .when(has(p, rules.IDE_PARTS), "data")
        .when(_any(*(name.startswith(x) for x in rules.EDUCATION_PREFIXES)), "education")
        .when(has(name, rules.FINANCIAL_WORDS) | has(low, rules.FINANCIAL_WORDS), "financial")
        .when(has(p, rules.WEB_ROOTS), "web")
        .when(has(low, rules.APPLICATION_ROOTS), "application")
        .otherwise("other")
    )


def classify(files: DataFrame, path: str = "path", to: str = "category") -> DataFrame:
    """files with the category of each path; a null path is `other`. Lookups are of fixed size."""
    spark = files.sparkSession
    mime = spark.createDataFrame(rules.mime_table(), f"{MIME_EXT} string, __cairn_m string")
    ext = spark.createDataFrame(rules.extension_table(), f"{SUFFIX} string, __cairn_e string")
    keyed = files.withColumns({MIME_EXT: mime_extension(path), SUFFIX: suffix(path)})
    joined = keyed.join(F.broadcast(mime), MIME_EXT, "left").join(F.broadcast(ext), SUFFIX, "left")
    money = _any(*(F.col(SUFFIX).startswith(x) for x in rules.FINANCIAL_PREFIXES))
    # the prefixes are tested after the financial extensions and before backup and what follows
    early = [c for c, _ in rules.EXTENSIONS]
    early = set(early[: early.index("backup")])
    late = F.col("__cairn_e").isNotNull() & ~F.col("__cairn_e").isin(*early)
    category = F.coalesce(
        F.col("__cairn_m"),
        F.when(F.col("__cairn_e").isNotNull() & ~late, F.col("__cairn_e")),
        F.when(money, "financial"),
        F.col("__cairn_e"),
        by_name_and_path(path),
    )
    return joined.withColumn(to, category).drop(MIME_EXT, SUFFIX, "__cairn_m", "__cairn_e")
