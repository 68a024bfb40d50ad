"""Checking new batches against all history, exactly and nearly, through an inverted index.

The index holds, for everything accepted so far: the first day of every content, the different word
sets with the day each first came, and postings of the rarest words of each set (its prefix),
partitioned by word. A batch is looked up by its own prefixes: two sets that share enough words must
share one in their prefixes. Lengths, places in the prefix and a 256-bit picture of each set exclude
most meetings before the sets are compared word by word, a word being a 64-bit hash. Then the batch's
own entries are appended.

Entries are kept in segments. A batch adds one of its own; where FAN segments are alike in size they
are merged, so that there are few and each entry is rewritten a few times at most. A segment's tables
lie in buckets by key, as many as give a bucket about BUCKET_ROWS rows: a batch reads the buckets that
its keys fall into, whose number follows the batch and whose size does not follow the history.

Rarity comes from counts in a table of fixed size, made when the index starts and kept since: any
fixed order of words gives right results, a good one short lists.

Rows without a day or an id belong to no batch and never match. Null or unusable contents match nothing; null
excerpts and excerpts without a word have no near match. Repeated rows give one result. A batch is
never compared with itself, only with days strictly before each row's own.
"""

from __future__ import annotations

import json
import uuid
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.catalog import content
from cairn.operators.skew import fragment_join, plan_fragments
from cairn.session import cut, remove, shared_path

WORD = r"[\p{L}\p{Nd}]+"
COUNTERS = 1 << 17  #: size of the table of word counts that orders words
PERCENT = 60
BUCKET_ROWS = 1 << 14  #: rows of a bucket, as long as that makes no more than MOST_BUCKETS of them
MOST_BUCKETS = 1 << 16
FAN = 4  #: segments of one size that are merged
SMALL = 100_000  #: rows up to which a batch's side of a join is broadcast; larger ones are laid out by load


def words(excerpt: Column | str) -> Column:
    """The different words of a text, as sorted 64-bit hashes."""
    found = F.regexp_extract_all(F.lower(excerpt), F.lit(WORD), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))


def batches(files: DataFrame) -> DataFrame:
    """id, day, content of the rows that belong to a batch; content in 44 characters in place of 64 digits."""
    return files.where("id is not null and scanned_at is not null").select("id", F.to_date("scanned_at").alias("day"), F.base64(F.unhex(content("hash"))).alias("content"))


def excerpt_sets(files: DataFrame, excerpts: DataFrame) -> DataFrame:
    """id, day, words and the set's key c1, c2, of the rows of batches that have an excerpt."""
    dated = files.where("id is not null and scanned_at is not null").select("id", F.to_date("scanned_at").alias("day"))
    held = excerpts.where("file_id is not null and excerpt is not null").select(F.col("file_id").alias("id"), words("excerpt").alias("words")).where(F.size("words") > 0)
    both = dated.join(held, "id")
    return both.withColumns({"c1": F.xxhash64("words"), "c2": F.xxhash64(F.lit(7), "words")})


def first_days(rows: DataFrame) -> DataFrame:
    """content and the first day it came."""
    return rows.where("content is not null").groupBy("content").agg(F.min("day").alias("first"))


def distinct_sets(rows: DataFrame) -> DataFrame:
    """c1, c2, first day and words of every different set."""
    return rows.groupBy("c1", "c2").agg(F.min("day").alias("first"), F.any_value("words").alias("words"))


def word_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold the words of each counter. COUNTERS numbers reach the driver, whatever the data."""
    slot = F.col("w").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("slot")
    counts = np.zeros(COUNTERS, np.int64)
    for slot_no, n in sets.select(F.explode("words").alias("w")).groupBy(slot).agg(F.count(F.lit(1))).collect():
        counts[slot_no] = n
    return counts


def by_rarity(spark: SparkSession, counts: np.ndarray, c: Column | str) -> Column:
    """Words ordered from the rarest to the most frequent; words not yet counted are the rarest."""
    kept = spark.sparkContext.broadcast(counts)  # of fixed size

    @F.arrow_udf("array<bigint>")
    def order(a: pa.Array) -> pa.Array:
        offsets, values = a.offsets.to_numpy(), a.values.to_numpy()
        offsets, values = offsets - offsets[0], values[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(len(a)), np.diff(offsets))
        rank = np.lexsort((values, kept.value[values & (COUNTERS - 1)], row))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[rank]))

    return order(c)


def _needed(n: Column, percent: int) -> Column:
    """The words that a set of n must share at least, in any match."""
    return F.ceil(n * percent / 100.0 - 1e-9).cast("int")


def _picture(c: str) -> dict[str, Column]:
    """A set's words as 256 bits in four numbers, p0 to p3."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
    one = lambda part: F.aggregate(
        F.filter(c, lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(3)) == part), F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(bit(w))
    )
    return {f"p{k}": one(k) for k in range(4)}


def postings(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The prefix of every set as token, place, and what the filters need; ranked holds its words by rarity."""
    n = F.size("ranked")
    drawn = _picture("ranked")
    flat = sets.select("c1", "first", n.alias("n"), *(p.alias(k) for k, p in drawn.items()), F.slice("ranked", F.lit(1), n - _needed(n, percent) + 1).alias("prefix"))
    return flat.select("c1", "first", "n", *drawn, F.posexplode("prefix").alias("place", "token"))


def probe(batch: DataFrame, index: DataFrame, percent: int = PERCENT, small: bool = False) -> DataFrame:
    """Pairs (c1, o1) of a batch's set and an indexed one of an earlier day that may match.

    A small batch goes to the postings as they lie. Otherwise words are laid out on tasks by their
    load, which is the square of the sets that hold them, and those of many sets are cut.
    """
    side = lambda df, p: df.select("token", *(F.col(c).alias(p + c) for c in ("c1", "first", "n", "p0", "p1", "p2", "p3", "place")))
    a, b = side(batch, "a_"), side(index, "b_")
    n, m = F.col("a_n"), F.col("b_n")
    need = F.ceil((n + m) * percent / (100.0 + percent) - 1e-9)
    long_enough = (m * 100 >= n * percent) & (n * 100 >= m * percent)
    by_place = F.least("a_place", "b_place") + F.least(n - F.col("a_place"), m - F.col("b_place")) >= need
    differ = sum((F.bit_count(F.col(f"a_p{k}").bitwiseXOR(F.col(f"b_p{k}"))) for k in range(4)), F.lit(0))
    by_picture = n + m - differ >= 2 * need
    if small:
        met = b.join(F.broadcast(a), "token")  # at most SMALL postings
    else:
        met = fragment_join(a, b, "token", ["a_c1"], "inner", plan_fragments(batch, "token", power=2))
    met = met.where((F.col("b_first") < F.col("a_first")) & long_enough & by_place & by_picture)
    return met.select(F.col("a_c1").alias("c1"), F.col("b_c1").alias("o1")).distinct()


def verified(pairs: DataFrame, new_sets: DataFrame, old_sets: DataFrame, percent: int = PERCENT, small: bool = False) -> DataFrame:
    """Of the pairs, those that share enough words: c1, c2 and the earlier day.

    Pairs are by one half of the sets' keys; whatever shares that half is compared word by word. A set
    that many pairs name is cut like any hot key.
    """
    a = new_sets.select("c1", "c2", "first", F.col("words").alias("a"))
    b = old_sets.select(F.col("c1").alias("o1"), F.col("first").alias("o_first"), F.col("words").alias("b"))
    if small:
        met = b.join(F.broadcast(pairs), "o1").join(a, "c1")  # at most SMALL pairs of two numbers
    else:
        met = fragment_join(fragment_join(pairs, a, "c1", ["o1"]), b, "o1", ["c1"])
    shared = F.size(F.array_intersect("a", "b"))
    met = met.where((F.col("o_first") < F.col("first")) & (shared * 100 >= (F.size("a") + F.size("b") - shared) * percent))
    return met.select("c1", "c2", "o_first")


def known_ids(files: DataFrame, excerpts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every id whose content, or nearly its excerpt, came on an earlier day; all batches accepted at once.

    The index is made in the shared folder and removed again. Only entries of days before a row's own
    count, so the result is that of one batch after the other.
    """
    index = HistoryIndex(files.sparkSession, shared_path(files.sparkSession, "history"), percent)
    try:
        return cut(index.accept(files, excerpts))
    finally:
        index.remove()


class HistoryIndex:
    """The index as tables under one path: contents, sets and postings of each segment, by bucket.

    check(batch) looks a batch up, append(batch) adds its entries, accept(batch) does both. The list of
    segments is one small file, written last, so that a job that fails leaves the index as it was.
    """

    KEYS = {"contents": "content", "sets": "c1", "postings": "token"}

    def __init__(self, spark: SparkSession, path: str, percent: int = PERCENT, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.percent, self.bucket_rows = spark, path.rstrip("/"), percent, bucket_rows
        self._counts: np.ndarray | None = None

    # ---- files ----

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def segments(self) -> list[dict]:
        """name, rows and number of buckets by table of every segment."""
        fs, p = self._fs(f"{self.path}/segments.json")
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0]) if fs.exists(p) else []

    def _list(self, segments: list[dict]) -> None:
        fs, p = self._fs(f"{self.path}/segments.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()

    def remove(self) -> None:
        remove(self.spark, self.path)

    @staticmethod
    def _bucket(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def _write(self, tables: dict[str, DataFrame]) -> dict:
        """A new segment; buckets are balanced by size, so that a key of many rows is written by several tasks."""
        made = {"name": f"seg-{uuid.uuid4().hex}", "rows": {}, "buckets": {}}
        for name, df in tables.items():
            n = made["rows"][name] = df.count()
            b = made["buckets"][name] = max(1, min(MOST_BUCKETS, ceil(n / self.bucket_rows)))
            laid = df.withColumn("bucket", self._bucket(self.KEYS[name], b)).hint("rebalance", "bucket")
            laid.sortWithinPartitions("bucket", self.KEYS[name]).write.partitionBy("bucket").parquet(f"{self.path}/{made['name']}/{name}")
        return made

    def read(self, name: str, keys: DataFrame, key: str) -> DataFrame | None:
        """What a table holds in the buckets that keys fall into; their numbers, no more than there are files, reach the driver."""
        held = [s for s in self.segments() if s["rows"][name]]
        if not held:
            return None
        counts = sorted({s["buckets"][name] for s in held})
        hit = keys.agg(*(F.collect_set(self._bucket(key, n)).alias(str(n)) for n in counts)).first()
        out = None
        for s in held:
            part, some = self.spark.read.parquet(f"{self.path}/{s['name']}/{name}"), hit[str(s["buckets"][name])]
            if len(some) < s["buckets"][name]:
                part = part.where(F.col("bucket").isin(*some) if some else F.lit(False))
            part = part.drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out

    def _order(self, sets: DataFrame) -> np.ndarray:
        if self._counts is None:
            fs, p = self._fs(f"{self.path}/order")
            if fs.exists(p):
                self._counts = np.zeros(COUNTERS, np.int64)
                for slot, n in self.spark.read.parquet(p.toString()).collect():  # COUNTERS rows at most
                    self._counts[slot] = n
            else:
                self._counts = word_counts(sets)
                at = np.flatnonzero(self._counts)
                self.spark.createDataFrame([(int(i), int(self._counts[i])) for i in at], "slot int, n long").coalesce(1).write.parquet(p.toString())
        return self._counts

    # ---- entries ----

    def _entries(self, files: DataFrame, excerpts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The batch's rows with a content, its rows with words, and its different sets with words by rarity."""
        rows = cut(batches(files).where("content is not null"))
        held = cut(excerpt_sets(files, excerpts))
        sets = cut(distinct_sets(held))
        return rows, held, cut(sets.withColumn("ranked", by_rarity(self.spark, self._order(sets), "words")))

    def _add(self, rows: DataFrame, sets: DataFrame) -> None:
        made = self._write({
            "contents": first_days(rows),
            "sets": sets.select("c1", "c2", "first", "words"),
            "postings": postings(sets.select("c1", "first", "ranked"), self.percent),
        })
        self._list(self._merged([*self.segments(), made]))

    def _tier(self, s: dict) -> int:
        return int(log(max(1, sum(s["rows"].values()) / self.bucket_rows), FAN))

    def _merged(self, segments: list[dict]) -> list[dict]:
        """segments, with FAN of one tier made one, until no tier has so many. What came several times keeps its first day."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in segments:
                tiers.setdefault(self._tier(s), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= FAN), None)
            if full is None:
                return segments
            tables = {}
            for name in self.KEYS:
                parts = [self.spark.read.parquet(f"{self.path}/{s['name']}/{name}").drop("bucket") for s in full if s["rows"][name]]
                whole = parts[0] if parts else self.spark.read.parquet(f"{self.path}/{full[0]['name']}/{name}").drop("bucket")
                for p in parts[1:]:
                    whole = whole.unionByName(p)
                same = [c for c in whole.columns if c not in ("first", "words")]
                tables[name] = whole.groupBy(*same).agg(F.min("first").alias("first"), *([F.any_value("words").alias("words")] if name == "sets" else []))
            segments = [s for s in segments if s not in full] + [self._write(tables)]

    def _known(self, rows: DataFrame, held: DataFrame, sets: DataFrame) -> DataFrame:
        found = self.spark.createDataFrame([], rows.select("id").schema)
        if (old := self.read("contents", rows, "content")) is not None:
            if rows.count() <= SMALL:
                met = old.join(F.broadcast(rows), "content")
            else:
                met = fragment_join(rows, old, "content", ["id"], "inner", plan_fragments(rows, "content"))
            found = found.unionByName(met.where(F.col("first") < F.col("day")).select("id"))
        new = postings(sets.select("c1", "first", "ranked"), self.percent)
        few = new.count() <= SMALL
        if (old := self.read("postings", new, "token")) is not None:
            pairs = cut(probe(new, old, self.percent, few))
            old_sets = self.read("sets", pairs.select("o1").unionByName(sets.select(F.col("c1").alias("o1"))), "o1")
            # a set may itself have come before; its own key finds it
            near = verified(pairs, sets, old_sets, self.percent, pairs.count() <= SMALL).groupBy("c1", "c2").agg(F.min("o_first").alias("near"))
            own = sets.select("c1", "c2").join(old_sets.select("c1", "c2", "first"), ["c1", "c2"]).groupBy("c1", "c2").agg(F.min("first").alias("own"))
            earliest = own.join(near, ["c1", "c2"], "full").select("c1", "c2", F.least("own", "near").alias("known"))
            nearly = fragment_join(held.select("id", "day", "c1", "c2"), earliest.withColumnRenamed("c2", "e2"), "c1", ["id"]).where("c2 = e2 and known < day")
            found = found.unionByName(nearly.select("id"))
        return found.distinct()

    def check(self, files: DataFrame, excerpts: DataFrame) -> DataFrame:
        """id of the batch's rows that the history knows."""
        return self._known(*self._entries(files, excerpts))

    def append(self, files: DataFrame, excerpts: DataFrame) -> None:
        """Accept a batch without a check: its rows are history from now on."""
        rows, _, sets = self._entries(files, excerpts)
        self._add(rows, sets)

    def accept(self, files: DataFrame, excerpts: DataFrame) -> DataFrame:
        """Append a batch and give the ids of its rows that earlier days know; it may hold many days."""
        rows, held, sets = self._entries(files, excerpts)
        self._add(rows, sets)
        return self._known(rows, held, sets)
