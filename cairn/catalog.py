"""Reading the catalog's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Fixed patterns: 64 digits in one run; a label such as `sha256:` or `SHA-256=` before the digits.
RUN, LABEL = "(?:^|[^0-9a-f])([0-9a-f]{64})(?:[^0-9a-f]|$)", "^[^:=]*[g-z][^:=]*[:=]"


def content(hash_col: Column | str) -> Column:
    """The content a hash value stands for: its 64 hexadecimal digits in lower case, or null.

    A label before the digits is not part of them, and neither is anything that surrounds or
    separates them. Sentinels, nulls and values with another number of digits give null.
    """
    c = F.lower(F.col(hash_col) if isinstance(hash_col, str) else hash_col)
    joined = F.regexp_replace(F.regexp_replace(c, LABEL, ""), "[^0-9a-f]", "")
    return F.when(c.rlike("^[0-9a-f]{64}$"), c).when(c.rlike(RUN), F.regexp_extract(c, RUN, 1)).when(F.length(joined) == 64, joined)


def content_sql(name: str = "hash") -> str:
    """The same as content(), as DuckDB SQL."""
    joined = f"regexp_replace(regexp_replace(lower({name}), '{LABEL}', ''), '[^0-9a-f]', '', 'g')"
    return f"CASE WHEN regexp_matches(lower({name}), '{RUN}') THEN regexp_extract(lower({name}), '{RUN}', 1) WHEN length({joined}) = 64 THEN {joined} END"
