"""Planning where files go, and looking at the plan."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import ancestors, file_name, parent, path_metadata
from cairn.functions.rules import APPLICATION_ROOTS, WEB_ROOTS
from cairn.operators.ranking import numbered


def _from(path: Column, searched: Column, roots: tuple[str, ...]) -> Column:
    """The path from the first root, in the list's order, that it holds; null without one."""
    return F.coalesce(*(F.when(searched.contains(r), F.substring(path, F.locate(r, searched) + 1, F.lit(1 << 30))) for r in roots))


def plan(files: DataFrame, base: str, keep_root: bool = True) -> DataFrame:
    """files (path, type, and owner, year if there) with destination.

    Web and application files keep the path from their root on; all others go to
    base/root/year/type/owner/name, each only where it is known, or to Unclassified.
    """
    p = F.col("path")
    root = path_metadata("path")["root_folder"] if keep_root else F.lit(None).cast("string")
    known = lambda c: F.when((c != "") & c.isNotNull(), F.replace(c.cast("string"), F.lit(" "), F.lit("_")))
    column = lambda name: F.col(name).cast("string") if name in files.columns else F.lit(None).cast("string")
    year = F.when(column("year") != "", column("year"))
    kind, owner = known(F.col("type")), known(column("owner"))
    nothing = root.isNull() & year.isNull() & kind.isNull() & owner.isNull()
    usual = F.concat_ws("/", F.lit(base.rstrip("/")), root, year, kind, owner, F.when(nothing, "Unclassified"), file_name(p))
    at = lambda folder, rest: F.concat_ws("/", F.lit(base.rstrip("/")), root, F.lit(folder), F.coalesce(rest, file_name(p)))
    web, app = at("web", _from(p, p, WEB_ROOTS)), at("application", _from(p, F.lower(p), APPLICATION_ROOTS))
    return files.withColumn("destination", F.when(F.col("type") == "web", web).when(F.col("type") == "application", app).otherwise(usual))


def mark_collisions(planned: DataFrame, seq: str = "id") -> DataFrame:
    """planned with status: the first of several files for one destination is `planned`, the rest `collision`.

    The first ones come from an aggregate and are met by their own seq and path, so that a destination
    which many files share gathers nowhere. Rows without seq or path are collisions.
    """
    first = planned.groupBy("destination").agg(F.min(F.struct(F.col(seq).alias("s"), F.col("path").alias("p"))).alias("f"))
    first = first.select(F.col("destination").alias("__cairn_d"), F.col("f.s").alias("__cairn_s"), F.col("f.p").alias("__cairn_p"))
    same = (F.col(seq) == F.col("__cairn_s")) & (F.col("path") == F.col("__cairn_p")) & (F.col("destination") == F.col("__cairn_d"))
    met = planned.join(first, same, "left")
    return met.withColumn("status", F.when(F.col("__cairn_s").isNotNull(), "planned").otherwise("collision")).drop("__cairn_d", "__cairn_s", "__cairn_p")


def folder_groups(files: DataFrame, base: str) -> DataFrame:
    """target_dir (base/type/owner/year with defaults) and how many files go there."""
    column = lambda name, default: F.coalesce(F.col(name).cast("string") if name in files.columns else F.lit(None), F.lit(default))
    target = F.concat_ws("/", F.lit(base), column("type", "Unknown"), column("owner", "Unknown_Owner"), column("year", "Unknown_Year"))
    return files.groupBy(target.alias("target_dir")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def preview(planned: DataFrame, fmt: str = "txt") -> DataFrame:
    """One column `value`: a JSON object with from and to, or `source -> destination`."""
    if fmt == "json":
        return planned.select(F.to_json(F.struct(F.col("path").alias("from"), F.col("destination").alias("to"))).alias("value"))
    return planned.select(F.concat_ws(" -> ", "path", "destination").alias("value"))


def dry_run(planned: DataFrame, fmt: str = "txt") -> DataFrame:
    """One column `value`: every record of a run that changes nothing, with all its columns and its destination."""
    if fmt == "json":
        return planned.select(F.to_json(F.struct(*planned.columns)).alias("value"))
    field = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    return planned.select(F.concat_ws(", ", *(field(c) for c, kind in planned.dtypes if not kind.startswith(("struct", "array", "map")))).alias("value"))


def tree_counts(planned: DataFrame, column: str = "destination") -> DataFrame:
    """dir, depth, direct files and all files below, of every folder of the plan."""
    parents = planned.where(F.col(column).isNotNull()).groupBy(parent(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    spread = parents.select(F.explode(ancestors(F.concat("d", F.lit("/x")))).alias("dir"), "d", "n")
    out = spread.groupBy("dir").agg(F.coalesce(F.sum(F.when(F.col("dir") == F.col("d"), F.col("n"))), F.lit(0)).alias("direct"), F.sum("n").alias("below"))
    return out.select("dir", (F.size(F.split("dir", "/")) - 1).alias("depth"), "direct", "below")


def common_prefix(paths: DataFrame, column: str = "destination") -> DataFrame:
    """One row with the folders all paths share: those that the smallest and the largest path share."""
    ends = paths.agg(F.min(F.split(column, "/")).alias("a"), F.max(F.split(column, "/")).alias("b"))
    same = F.filter(F.sequence(F.lit(0), F.size("a")), lambda n: F.slice("a", F.lit(1), n) == F.slice("b", F.lit(1), n))
    return ends.select(F.array_join(F.slice("a", F.lit(1), F.array_max(same)), "/").alias("prefix"))


def tree_text(planned: DataFrame, max_depth: int = 5) -> Iterator[str]:
    """The tree as text, down to a depth below the common folder, with a mark where deeper folders are left out."""
    top = common_prefix(planned).first()[0] or ""
    start = top.count("/")
    shown = tree_counts(planned).where(F.col("dir").startswith(top) & (F.col("depth") <= start + max_depth)).orderBy(F.split("dir", "/"))
    yield top or "/"
    for r in shown.toLocalIterator():  # a part of the tree at a time
        if r.dir != top:
            yield "  " * (r.depth - start) + r.dir.rsplit("/", 1)[-1] + (f" ({r.direct} files)" if r.direct else "")
        if r.depth == start + max_depth and r.below > r.direct:
            yield "  " * (max_depth + 1) + "... (deeper folders not shown)"


def tree_lines(planned: DataFrame, max_depth: int = 5, lines: int = 2000) -> list[str]:
    """The first lines of the tree, and how many are not shown."""
    tree = tree_text(planned, max_depth)
    out = list(islice(tree, lines + 1))
    rest = sum(1 for _ in tree)
    return [*out, f"{rest:,} more lines are not shown"] if rest else out


def enumerate_plan(planned: DataFrame, seq: str = "id") -> DataFrame:
    """The plan's rows, numbered in order, with sizes in units of a million bytes."""
    rows = numbered(planned.select(seq, "path", "type", "size", "destination"), seq, "path")
    return rows.select("n", file_name("path").alias("name"), "type", (F.col("size") / 1_000_000).alias("size_mb"), F.col("path").alias("source"), "destination")


def category_counts(planned: DataFrame, column: str = "type") -> DataFrame:
    return planned.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def parent_folders(planned: DataFrame, column: str = "destination") -> DataFrame:
    """The different folders that files lie in."""
    return planned.where(F.col(column).isNotNull()).select(parent(column).alias("dir")).distinct()


def run_summary(marked: DataFrame) -> DataFrame:
    """One row for notices and the console: files, bytes, unique rows (sentinels included) and duplicates."""
    dup = F.coalesce("is_duplicate", F.lit(False))
    return marked.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(~dup).alias("n_unique"), F.count_if(dup).alias("n_duplicates"))
