"""References to records that do not exist, are gone, or came later.

References and parent keys are partitioned alike and sorted by key, so that one linear merge of both
streams meets each reference with the validity interval of its parent: valid_from, the first scan that
recorded it, to valid_to, its first executed deletion. The merge is Spark's sort-merge join; a key that holds
many references is cut and its one parent row copied, see skew.

reason `missing`: no interval; `deleted`: no parent has the key and an executed DELETE has closed its
interval, which has no beginning then; `late`: the parent exists and its interval begins after the
reference's time. A null key is no reference. A
null time gives the period `none` and is never late; a parent without a scan time is never late.
References delivered several times count once. Empty tables give an empty result, or only missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.skew import fragment_join, plan_fragments


OPEN_END = "9999-12-31"


def references(classifications: DataFrame, operations: DataFrame) -> DataFrame:
    """Both tables' references in one shape: source_table, row_id, file_id, at."""
    return classifications.select(F.lit("classifications").alias("source_table"), F.col("id").alias("row_id"), "file_id", F.col("classified_at").alias("at")).unionByName(
        operations.select(F.lit("operations").alias("source_table"), F.col("id").alias("row_id"), "file_id", F.col("executed_at").alias("at"))
    )


def parent_intervals(files: DataFrame, operations: DataFrame) -> DataFrame:
    """One row a key: file_id, present, valid_from, valid_to. A DELETE without a time closes the interval at its end of time, OPEN_END."""
    kind = files.schema["scanned_at"].dataType
    never = F.lit(None).cast(kind)
    alive = files.where("id is not null").select(F.col("id").alias("file_id"), F.col("scanned_at").alias("valid_from"), never.alias("valid_to"), F.lit(True).alias("present"))
    gone = operations.where("file_id is not null and action = 'DELETE' and executed")
    gone = gone.select("file_id", never.alias("valid_from"), F.coalesce("executed_at", F.lit(OPEN_END).cast(kind)).cast(kind).alias("valid_to"), F.lit(False).alias("present"))
    both = alive.unionByName(gone).groupBy("file_id")
    return both.agg(F.max("present").alias("present"), F.min("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"))


def broken_references(files: DataFrame, classifications: DataFrame, operations: DataFrame) -> DataFrame:
    """source_table, row_id, period (YYYY-MM or none), reason."""
    refs = references(classifications, operations).where("file_id is not null")
    met = fragment_join(refs, parent_intervals(files, operations), "file_id", ["row_id"], "left", plan_fragments(refs, "file_id"))
    absent = ~F.coalesce("present", F.lit(False))
    reason = (
        F.when(absent & F.col("valid_to").isNotNull(), "deleted")
        .when(absent, "missing")
        .when(F.col("valid_from") > F.col("at"), "late")
    )
    period = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("none"))
    return met.select("source_table", "row_id", period.alias("period"), reason.alias("reason")).where("reason is not null").distinct()


def reference_report(files: DataFrame, classifications: DataFrame, operations: DataFrame) -> DataFrame:
    """Counts by table, period and reason."""
    return broken_references(files, classifications, operations).groupBy("source_table", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
