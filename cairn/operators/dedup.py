"""Exact duplicates by hash: marking, filtering, groups and totals.

Rows whose hash is null or METADATA_ONLY belong to no group. The original of a group is its first row
in the order of scan_seq (ties: the smallest path). Summaries combine before they shuffle, so that a
hash held by a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cairn.functions.paths import file_name, thousands
from cairn.operators.ranking import numbered
from cairn.operators.skew import fragment_join, plan_fragments
from cairn.schemas import METADATA_ONLY


def hashed(files: DataFrame) -> DataFrame:
    return files.where(F.col("hash").isNotNull() & (F.col("hash") != METADATA_ONLY))


def originals(files: DataFrame, seq: str = "id") -> DataFrame:
    """hash, n, original_seq, original_path, original_size of every group, single rows included."""
    first = F.min(F.struct(F.col(seq).alias("s"), F.col("path").alias("p"), F.col("size").alias("z")))
    g = hashed(files).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
    return g.select("hash", "n", F.col("f.s").alias("original_seq"), F.col("f.p").alias("original_path"), F.col("f.z").alias("original_size"))


def mark_duplicates(files: DataFrame, seq: str = "id", loads: DataFrame | None = None) -> DataFrame:
    """files with is_duplicate and original_path: all rows of a group but the original are duplicates.

    loads: rows whose hashes tell the load of each, where that is cheaper than to ask files itself.
    """
    several = originals(files, seq).where("n > 1").select("hash", F.col("original_seq").alias("__cairn_seq"), F.col("original_path").alias("__cairn_path"))
    rows = files.drop("is_duplicate", "original_path")
    met = fragment_join(rows, several, "hash", [seq], "left", plan_fragments(files if loads is None else loads, "hash"))
    dup = F.col("__cairn_path").isNotNull() & ((F.col(seq) != F.col("__cairn_seq")) | (F.col("path") != F.col("__cairn_path")))
    return met.withColumns({"is_duplicate": dup, "original_path": F.when(dup, F.col("__cairn_path"))}).drop("__cairn_seq", "__cairn_path")


def filter_duplicates(marked: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return marked if keep_duplicates else marked.where(~F.coalesce("is_duplicate", F.lit(False)))


def duplicate_groups(files: DataFrame, seq: str = "id") -> DataFrame:
    """hash, n, original_path, original_size and wasted bytes of the groups of two or more."""
    return originals(files, seq).where("n > 1").select("hash", "n", "original_path", "original_size", (F.col("original_size") * (F.col("n") - 1)).alias("wasted"))


def duplicate_totals(files: DataFrame, seq: str = "id") -> DataFrame:
    """One row: groups, surplus rows, wasted bytes, different contents, and rows that aren't duplicates."""
    g = originals(files, seq).agg(
        F.count_if(F.col("n") > 1).alias("n_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum(F.col("original_size") * (F.col("n") - 1)), F.lit(0)).alias("wasted"),
        F.count(F.lit(1)).alias("n_contents"),
    )
    rest = files.agg(F.count(F.lit(1)).alias("n_files"))
    both = g.unionByName(rest, allowMissingColumns=True)  # two rows
    out = both.agg(*(F.max(c).alias(c) for c in ("n_groups", "n_duplicates", "wasted", "n_contents", "n_files")))
    return out.withColumn("n_unique_rows", F.col("n_files") - F.col("n_duplicates"))


def same_names(files: DataFrame, seq: str = "id", loads: DataFrame | None = None) -> DataFrame:
    """name, n and path of every row whose file name several rows bear. A frequent name is cut like any hot key."""
    name = lambda df, *cs: df.where("path is not null").select(file_name("path").alias("name"), *cs)
    named = name(files, seq, "path")
    counts = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    plan = plan_fragments(name(files if loads is None else loads), "name")
    return fragment_join(named, counts, "name", [seq], plan=plan).select("name", "n", "path")


def numbered_groups(files: DataFrame, seq: str = "id") -> DataFrame:
    """The duplicate groups with their number in the order of hash."""
    return numbered(duplicate_groups(files, seq), "hash", name="group_no")


def with_originals(files: DataFrame, loads: DataFrame | None = None) -> DataFrame:
    """Each row that names an original, with what the catalog holds under that path: its id, hash and size.

    original_id is null where the path is gone. A path that many rows name is cut like any hot key.
    """
    rows = files.where("duplicate_of is not null").select("id", "path", "hash", F.col("duplicate_of").alias("original_path"))
    held = files.where("path is not null").groupBy(F.col("path").alias("original_path")).agg(F.min(F.struct("id", F.col("hash").alias("h"), "size")).alias("o"))
    held = held.select("original_path", F.col("o.id").alias("original_id"), F.col("o.h").alias("original_hash"), F.col("o.size").alias("original_size"))
    plan = plan_fragments((files if loads is None else loads).where("duplicate_of is not null"), "duplicate_of")
    return fragment_join(rows, held, "original_path", ["id"], "left", plan)


def _head(t: Row) -> list[str]:
    mb = lambda n: f"{n / 1048576:,.2f} MB"
    return ["DUPLICATE REPORT", f"groups: {t.n_groups:,}", f"duplicates: {t.n_duplicates:,}", f"wasted: {t.wasted:,} bytes ({mb(t.wasted)}, {t.wasted / 1073741824:,.2f} GB)"]


def report(files: DataFrame, seq: str = "id", groups: int = 1000) -> list[str]:
    """The report for the console: totals, at most so many groups in order of hash, and how many are not shown."""
    t = duplicate_totals(files, seq).first()
    if not t.n_groups:
        return []
    lines = _head(t)
    top = duplicate_groups(files, seq).orderBy("hash").limit(groups).withColumn("shown", thousands(F.col("wasted")))
    for i, g in enumerate(top.collect(), 1):
        lines.append(f"#{i} {g.hash}: {g.n} files, original {g.original_path}, wasted {g.shown} bytes")
    if t.n_groups > groups:
        lines.append(f"{t.n_groups - groups:,} more groups are not shown")
    return lines


def report_lines(files: DataFrame, seq: str = "id") -> DataFrame:
    """The whole report in order, one column `value`: totals, every group with its original, and all its duplicates."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    number = lambda c: F.when(c.isNotNull(), thousands(c)).otherwise("unknown")
    groups = numbered(originals(files, seq).where("n > 1"), "hash", name="group_no")
    wasted = F.col("original_size") * (F.col("n") - 1)
    totals = (F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.coalesce(F.sum(wasted), F.lit(0)).alias("wasted"))
    t = groups.agg(*totals).first()  # one row, from the groups that numbered() keeps
    head = [(0, i, line) for i, line in enumerate(_head(t))] if t.n_groups else []
    top = files.sparkSession.createDataFrame(head, "group_no long, place int, value string").withColumns({"seq": F.lit(None).cast(files.schema[seq].dataType), "path": F.lit(None).cast("string")})
    first = F.concat(F.lit("#"), F.col("group_no"), F.lit(" "), "hash", F.lit(": "), F.col("n"), F.lit(" files of "), number(F.col("original_size")), F.lit(" bytes, original "), text("original_path"), F.lit(", wasted "), number(wasted), F.lit(" bytes"))
    first = groups.select("group_no", F.lit(0).alias("place"), first.alias("value"), F.col("original_seq").alias("seq"), F.col("original_path").alias("path"))
    rows = hashed(files).select(F.col(seq).alias("seq"), "hash", "path")
    met = fragment_join(rows, groups.select("hash", "group_no", "original_seq", "original_path"), "hash", ["seq"])
    met = met.where(~(F.col("seq").eqNullSafe(F.col("original_seq")) & F.col("path").eqNullSafe(F.col("original_path"))))
    rest = met.select("group_no", F.lit(1).alias("place"), F.concat(F.lit("  duplicate "), text("path")).alias("value"), "seq", "path")
    return top.unionByName(first).unionByName(rest).orderBy("group_no", "place", "seq", "path").select("value")
