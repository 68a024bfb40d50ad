"""The record types of the catalog."""

from pyspark.sql import types as T

PATH_METADATA = T.StructType(
    [
        T.StructField("root_folder", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("parent_folders", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("date_tags", T.ArrayType(T.StringType())),
        T.StructField("category_tags", T.ArrayType(T.StringType())),
    ]
)

SCAN = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("hash", T.StringType()),
        T.StructField("metadata_only", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampNTZType()),
        T.StructField("hash", T.StringType()),
        T.StructField("metadata_only", T.BooleanType()),
        T.StructField("is_duplicate", T.BooleanType()),
        T.StructField("duplicate_of", T.StringType()),
        T.StructField("scanned_at", T.TimestampNTZType()),
    ]
)

CLASSIFICATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("classified_at", T.TimestampNTZType()),
    ]
)

OPERATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("target_path", T.StringType()),
        T.StructField("executed", T.BooleanType()),
        T.StructField("executed_at", T.TimestampNTZType()),
    ]
)

HASH_CACHE = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("hash", T.StringType())])

ACTIONS = ("MOVE", "DELETE", "METADATA")
METADATA_ONLY = "METADATA_ONLY"
