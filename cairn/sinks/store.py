"""The catalog's tables on a shared file system, changed a batch at a time.

A table lies in buckets by its key. A batch rewrites the buckets that its keys fall into and leaves all
others as they are; then the list of what counts is replaced, so that readers see the table before or
after, and a lost executor costs nothing but a retry. Append-only tables only add files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.schemas import ACTIONS, CLASSIFICATIONS, FILES, HASH_CACHE, OPERATIONS

TABLES = {"files": FILES, "classifications": CLASSIFICATIONS, "operations": OPERATIONS, "hash_cache": HASH_CACHE}
KEYS = {"files": "path", "classifications": "file_id", "operations": "file_id", "hash_cache": "path"}
BUCKET_ROWS = 1 << 20  #: rows of a bucket when a table is written whole; at four times as many it is written whole again
MOST_BUCKETS = 1 << 14


def _top(old: DataFrame, top: int | None) -> int:
    """The highest id given so far."""
    return old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top


def _numbered(rows: DataFrame, key: str, top: int) -> DataFrame:
    """rows with the ids that follow top."""
    from cairn.operators.ranking import running

    one = running(rows.withColumn("__cairn_one", F.lit(1)), ["__cairn_one"], [key], "__cairn_n")
    return one.withColumn("id", F.col("__cairn_n") + top + 1).drop("__cairn_one", "__cairn_n")


def upsert_files(old: DataFrame, new: DataFrame, now, clear_flags: bool = False, top: int | None = None) -> DataFrame:
    """old with the rows of new (path, size, mtime, hash, metadata_only) put in by path.

    A known path keeps its id and, unless clear_flags, its duplicate flags; an unknown one gets the
    next id after top, the highest of old by default. Of several new rows with one path the one with the
    largest (mtime, hash) counts.
    """
    fields = ("size", "mtime", "hash", "metadata_only")
    batch = new.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "hash", "size", "metadata_only")).alias("n"))
    when = F.lit(now).cast("timestamp_ntz")
    hit = F.col("n").isNotNull()
    pick = {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(c)) for c in fields}
    flag = F.when(hit, F.lit(False)).otherwise(F.col("is_duplicate")) if clear_flags else F.coalesce("is_duplicate", F.lit(False))
    pick |= {"metadata_only": F.coalesce(pick["metadata_only"], F.lit(False)), "is_duplicate": flag, "scanned_at": F.when(hit, when).otherwise(F.col("scanned_at"))}
    kept = old.join(batch, "path", "left").withColumns(pick).select(*FILES.fieldNames())
    fresh = _numbered(batch.join(old.select("path"), "path", "left_anti"), "path", _top(old, top))
    said = {c: F.col(f"n.{c}") for c in fields} | {"is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("string"), "scanned_at": when}
    said["metadata_only"] = F.coalesce(said["metadata_only"], F.lit(False))
    return kept.unionByName(fresh.withColumns(said).select(*FILES.fieldNames()))


def mark_duplicates(files: DataFrame, marks: DataFrame) -> DataFrame:
    """files with the flag and original of marks (path, duplicate_of) set; unknown paths change nothing, no flag is cleared."""
    one = marks.where("path is not null").groupBy("path").agg(F.min("duplicate_of").alias("__cairn_of"), F.lit(True).alias("__cairn_hit"))
    met = files.join(one, "path", "left")
    hit = F.coalesce("__cairn_hit", F.lit(False))
    return met.withColumns({"is_duplicate": F.when(hit, True).otherwise(F.col("is_duplicate")), "duplicate_of": F.when(hit, F.col("__cairn_of")).otherwise(F.col("duplicate_of"))}).select(*files.columns)


def operation_rows(files: DataFrame, wanted: DataFrame, after: int = 0) -> DataFrame:
    """New operations rows for wanted (path, action, target_path), not executed; unknown paths give none.

    A row with an action that is not one of MOVE, DELETE, METADATA stops the job when it is reached.
    """
    ids = files.where("path is not null").groupBy("path").agg(F.min("id").alias("file_id"))
    rows = wanted.join(ids, "path")
    bad = F.raise_error(F.concat(F.lit("no such action: "), F.coalesce("action", F.lit("null"))))
    rows = rows.withColumn("action", F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise(bad))
    from cairn.operators.ranking import running

    rows = running(rows.withColumn("__cairn_one", F.lit(1)), ["__cairn_one"], ["path", "action", "target_path"], "__cairn_n")
    return rows.select((F.col("__cairn_n") + after + 1).alias("id"), "file_id", "action", "target_path", F.lit(False).alias("executed"), F.lit(None).cast("timestamp_ntz").alias("executed_at"))


def by_file(files: DataFrame, new: DataFrame) -> DataFrame:
    """file_id and n, what new (path, category, owner, year, confidence; the last three may be absent) says of each file, one row each."""
    for c, kind in (("owner", "string"), ("year", "int"), ("confidence", "double")):
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(kind))
    ids = files.where("path is not null").groupBy("path").agg(F.min("id").alias("file_id"))
    return new.join(ids, "path").groupBy("file_id").agg(F.max(F.struct("confidence", "category", "owner", "year")).alias("n"))


def put_classifications(old: DataFrame, batch: DataFrame, now, top: int | None = None) -> DataFrame:
    """old with batch (file_id, n as by_file gives it) put in, one row a file."""
    when = F.lit(now).cast("timestamp_ntz")
    hit = F.col("n").isNotNull()
    pick = {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(c)) for c in ("category", "confidence")}
    pick |= {c: F.when(hit, F.coalesce(F.col(f"n.{c}"), F.col(c))).otherwise(F.col(c)) for c in ("owner", "year")}
    kept = old.join(batch, "file_id", "left").withColumns(pick | {"classified_at": F.when(hit, when).otherwise(F.col("classified_at"))})
    fresh = _numbered(batch.join(old.select("file_id"), "file_id", "left_anti"), "file_id", _top(old, top))
    fresh = fresh.withColumns({c: F.col(f"n.{c}") for c in ("category", "owner", "year", "confidence")} | {"classified_at": when})
    return kept.select(*CLASSIFICATIONS.fieldNames()).unionByName(fresh.select(*CLASSIFICATIONS.fieldNames()))


def save_classifications(old: DataFrame, files: DataFrame, new: DataFrame, now) -> DataFrame:
    """old with new (path, category, owner, year, confidence; the last three may be absent) put in by file, one row each."""
    return put_classifications(old, by_file(files, new), now)


def add_metadata_only(files: DataFrame) -> DataFrame:
    """The one schema change there was: a metadata_only column, false by default."""
    return files if "metadata_only" in files.columns else files.withColumn("metadata_only", F.lit(False))


def cached_hashes(found: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found (path, mtime) split into rows whose hash is known for that mtime, and those to hash."""
    known = cache.where("hash is not null").groupBy("path", "mtime").agg(F.min("hash").alias("hash"))
    rows = found.drop("hash")
    same = ["path", "mtime"]
    return rows.join(known, same), rows.join(known, same, "left_anti")


def with_cached_hashes(found: DataFrame, cache: DataFrame) -> DataFrame:
    """found (path, mtime) with the hash known for that mtime, null where it is to be hashed; cached_hashes in one pass."""
    known = cache.where("hash is not null").groupBy("path", "mtime").agg(F.min("hash").alias("hash"))
    return found.drop("hash").join(known, ["path", "mtime"], "left")


def cached_by_path(found: DataFrame, cache: DataFrame) -> DataFrame:
    """found with the hash that a path-only cache knows; its change times are not looked at."""
    known = cache.where("path is not null and hash is not null").groupBy("path").agg(F.max("hash").alias("hash"))
    return found.drop("hash").join(known, "path", "left")


def load_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache of path and hash kept as JSON lines; empty if there is none. Broken lines are left out."""
    try:
        rows = spark.read.schema(HASH_CACHE).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], HASH_CACHE)
    return rows.where("path is not null")


def save_json_cache(cache: DataFrame, path: str) -> None:
    cache.select(*HASH_CACHE.fieldNames()).write.mode("overwrite").json(path)


class Store:
    """Tables under one path. `current.json` of each lists the folders of its buckets, how many there are, and the highest id."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> dict | None:
        fs, p = self._fs(f"{self.path}/{name}/current.json")
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0]) if fs.exists(p) else None

    def _point(self, name: str, now: dict) -> None:
        fs, p = self._fs(f"{self.path}/{name}/current.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()

    def _folders(self, name: str, folders: list[str]) -> DataFrame:
        schema: StructType = TABLES[name]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{f}" for f in folders))

    def _write(self, name: str, df: DataFrame, n: int) -> dict[str, list[str]]:
        """Write rows into new folders, one a bucket: bucket -> folders."""
        tag = f"v-{uuid.uuid4().hex}"
        rows = df.select(*TABLES[name].fieldNames()).withColumn("bucket", self._bucket(name, n))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{tag}")
        fs, p = self._fs(f"{self.path}/{name}/{tag}")
        made = [s.getPath().getName() for s in fs.listStatus(p)]
        return {f.split("=")[1]: [f"{tag}/{f}"] for f in made if f.startswith("bucket=")}

    @staticmethod
    def _bucket(name: str, n: int):
        return F.pmod(F.xxhash64(KEYS[name]), F.lit(n)).cast("int")

    def _highest(self, name: str, df: DataFrame) -> int:
        return _top(df, None) if "id" in TABLES[name].fieldNames() else 0

    def init(self) -> None:
        """Create the tables that are not there yet, empty."""
        for name, schema in TABLES.items():
            if self._current(name) is None:
                self.replace(name, self.spark.createDataFrame([], schema))

    def read(self, name: str) -> DataFrame:
        now = self._current(name)
        return self._folders(name, [f for fs in now["buckets"].values() for f in fs] if now else [])

    def replace(self, name: str, df: DataFrame) -> None:
        """Write a table whole and then point to it; what counted before stays until vacuum()."""
        n = max(1, min(MOST_BUCKETS, -(-df.count() // self.bucket_rows)))
        folders = self._write(name, df, n)
        written = self._folders(name, [f for fs in folders.values() for f in fs])
        self._point(name, {"n": n, "buckets": folders, "top": self._highest(name, written), "rows": written.count()})

    def merge(self, name: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame, int], DataFrame]) -> None:
        """Put a batch in by the table's key: change(old, batch, top) gives the rows of the buckets that batch falls into.

        The numbers of these buckets reach the driver, no more than there are. top is the highest id.
        """
        now = self._current(name)
        if now is None:
            self.init()
            now = self._current(name)
        hit = [str(r[0]) for r in batch.select(self._bucket(name, now["n"]).alias("b")).distinct().collect()]
        old = self._folders(name, [f for b in hit for f in now["buckets"].get(b, [])])
        before = old.count()
        made = self._write(name, change(old, batch, now["top"]), now["n"])
        new = self._folders(name, [f for fs in made.values() for f in fs])
        rows = now["rows"] - before + new.count()
        buckets = {b: fs for b, fs in now["buckets"].items() if b not in hit} | made
        self._point(name, {"n": now["n"], "buckets": buckets, "top": max(now["top"], self._highest(name, new)), "rows": rows})
        if rows > 4 * self.bucket_rows * now["n"] and now["n"] < MOST_BUCKETS:
            self.replace(name, self.read(name))

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table without looking at those it holds."""
        now = self._current(name)
        if now is None:
            return self.replace(name, df)
        made = self._write(name, df, now["n"])
        new = self._folders(name, [f for fs in made.values() for f in fs])
        buckets = {b: now["buckets"].get(b, []) + made.get(b, []) for b in now["buckets"] | made}
        self._point(name, {"n": now["n"], "buckets": buckets, "top": max(now["top"], self._highest(name, new)), "rows": now["rows"] + new.count()})

    def vacuum(self, name: str) -> None:
        """Delete the folders that no longer count."""
        keep = {f for fs in (self._current(name) or {"buckets": {}})["buckets"].values() for f in fs}
        fs, p = self._fs(f"{self.path}/{name}")
        for s in fs.listStatus(p):
            tag = s.getPath().getName()
            if not tag.startswith("v-"):
                continue
            for t in fs.listStatus(s.getPath()):
                if t.isDirectory() and f"{tag}/{t.getPath().getName()}" not in keep:
                    fs.delete(t.getPath(), True)
            if not any(f.startswith(f"{tag}/") for f in keep):
                fs.delete(s.getPath(), True)
