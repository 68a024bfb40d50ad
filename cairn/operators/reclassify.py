"""Classifying again what a catalog already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import is_cloud
from cairn.operators.classify import classify


def reclassify(files: DataFrame, classifications: DataFrame, categories: list[str] | None = None, existing: DataFrame | None = None, skip_cloud: bool = False) -> DataFrame:
    """id, path, old_category, new_category and status of each file.

    status, in this order: skipped (a cloud folder), error (no path), missing (not among the paths of
    existing, when given), updated, unchanged. categories keeps files of these old categories; files without a
    classification have the old category `unknown` and come only when categories is None.
    """
    rows = files.select("id", "path").join(classifications.select(F.col("file_id").alias("id"), F.col("category").alias("old")), "id", "left")
    if categories is not None:
        rows = rows.where(F.col("old").isin(*categories))
    rows = rows.withColumn("old_category", F.coalesce("old", F.lit("unknown"))).drop("old")
    rows = classify(rows, "path", "new_category")
    gone = F.lit(False)
    if existing is not None:
        rows = rows.join(existing.select("path", F.lit(True).alias("__cairn_there")).distinct(), "path", "left")
        gone = F.col("__cairn_there").isNull()
    status = F.when(is_cloud("path") if skip_cloud else F.lit(False), "skipped").when(F.col("path").isNull(), "error").when(gone, "missing").when(F.col("new_category") != F.col("old_category"), "updated").otherwise("unchanged")
    return rows.withColumn("status", status).select("id", "path", "old_category", "new_category", "status")


def changes(done: DataFrame) -> DataFrame:
    """How many files went from each old category to each new one."""
    return done.where("status = 'updated'").groupBy("old_category", "new_category").agg(F.count(F.lit(1)).alias("n"))


def counters(done: DataFrame) -> DataFrame:
    """One row: all files, checked, and each status."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("updated", "unchanged")).alias("checked"), *map(of, ("updated", "unchanged", "missing", "skipped", "error")))


def updates(done: DataFrame) -> DataFrame:
    """Rows for sinks.store.save_classifications, with the confidence of a second look."""
    return done.where("status = 'updated'").select("path", F.col("new_category").alias("category"), F.lit(0.9).alias("confidence"))
