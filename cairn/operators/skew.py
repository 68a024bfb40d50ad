"""Per-key work when a few keys hold most rows: fragment and replicate by estimated load.

A sketch finds the keys with large loads, one count per bucket gives the load of all others. A key
whose load exceeds its fair part of a task is cut into shards in proportion to the load; shards and
buckets are then packed onto tasks, largest first onto the least loaded. Rows of a cut key go to one
of its shards by the row's own identity; the matching side of a join is copied to those shards only.
What reaches the driver is bounded by the number of tasks, whatever the data hold.

Nulls: a null key is no key. Aggregates leave it out, joins spread its rows over all tasks, where
they match nothing. Repeated rows: rows with the same identity meet in the same shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import shuffle_tasks

TASK, PICK, SPLIT = "__cairn_task", "__cairn_key", "__cairn_tasks"


@dataclass(frozen=True)
class FragmentPlan:
    """Where rows go: heavy holds (key, its tasks), bucket_task the task of each bucket of the others."""

    tasks: int
    bucket_task: tuple[int, ...]
    heavy: tuple[tuple[object, tuple[int, ...]], ...]
    key_type: str
    rows: int  #: rows seen, null keys included
    load: tuple[float, ...]  #: estimated rows by task

    @property
    def split(self) -> tuple[tuple[object, tuple[int, ...]], ...]:
        return tuple(x for x in self.heavy if len(x[1]) > 1)


def pack(loads: list[tuple[float, object]], tasks: int) -> tuple[list[tuple[object, int]], list[float]]:
    """Give each item, largest first, to the task with the least load so far."""
    heap = [(0.0, t) for t in range(tasks)]
    placed: list[tuple[object, int]] = []
    for load, item in sorted(loads, key=lambda x: (-x[0], str(x[1]))):
        now, t = heapq.heappop(heap)
        placed.append((item, t))
        heapq.heappush(heap, (now + load, t))
    return placed, [x for x, _ in sorted(heap, key=lambda x: x[1])]


def plan_fragments(df: DataFrame, key: str, tasks: int | None = None, fair: float = 0.5, tracked: int | None = None, power: int = 1) -> FragmentPlan:
    """Estimate the load of each key and lay keys out on tasks.

    fair: the part of a task's mean load from which a key is placed by itself; from a whole mean
    load on it is cut into shards. tracked: counters of the sketch, whose error is about
    rows / tracked; eight a task by default, at least 4096. power: 2 where a key's load is the square of
    its rows, as when df meets a table of the same kind; keys are then counted without a sketch. An
    empty df gives a plan without heavy keys.
    """
    spark = df.sparkSession
    tasks = tasks or shuffle_tasks(spark)
    buckets = max(tasks, min(16 * tasks, 1 << 16))
    tracked = tracked or min(1_000_000, max(4096, 8 * tasks))
    most = min(int(tasks / fair) + 1, tracked)
    k = df.select(F.col(key).alias("k"))
    kind = k.schema["k"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("b")
    if power == 1:
        top, rows, keyed = k.agg(F.expr(f"approx_top_k(k, {most}, {tracked})"), F.count(F.lit(1)), F.count("k")).first()
        target = max(1.0, keyed / tasks)
        heavy = {r["item"]: float(r["count"]) for r in top or [] if r["item"] is not None and r["count"] >= fair * target}
        each = k.where("k is not null").withColumn("load", F.lit(1))
    else:
        rows = k.count()
        each = k.where("k is not null").groupBy("k").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("load"))
        target = max(1.0, (each.agg(F.sum("load")).first()[0] or 0.0) / tasks)
        heavy = {r["k"]: r["load"] for r in each.where(F.col("load") >= fair * target).collect()}  # at most tasks / fair
    counts = [0.0] * buckets
    is_heavy = F.col("k").isin(list(heavy)) if heavy else F.lit(False)
    for b, n in each.where(~is_heavy).groupBy(bucket).agg(F.sum("load")).collect():  # at most a row a bucket
        counts[b] += n
    items: list[tuple[float, object]] = [(n, ("bucket", b)) for b, n in enumerate(counts)]
    for value, n in heavy.items():
        parts = min(tasks, max(1, ceil(n / target)))
        items += [(n / parts, ("key", value, i)) for i in range(parts)]
    placed, load = pack(items, tasks)
    bucket_task, at = [0] * buckets, {v: [] for v in heavy}
    for item, t in placed:
        if item[0] == "bucket":
            bucket_task[item[1]] = t
        else:
            at[item[1]].append(t)
    return FragmentPlan(tasks, tuple(bucket_task), tuple((v, tuple(sorted(set(t)))) for v, t in at.items()), kind, rows, tuple(load))


def _marked(df: DataFrame, key: str, plan: FragmentPlan) -> DataFrame:
    """df with the tasks of its key, where that is a heavy one."""
    if not plan.heavy:
        return df.withColumn(SPLIT, F.lit(None).cast("array<int>"))
    rows = [(v, list(t)) for v, t in plan.heavy]
    small = df.sparkSession.createDataFrame(rows, f"{PICK} {plan.key_type}, {SPLIT} array<int>")
    return df.join(F.broadcast(small), df[key] == small[PICK], "left").drop(PICK)  # at most 2 rows a task


def _home(key: str, plan: FragmentPlan) -> Column:
    tasks = F.split(F.lit(",".join(map(str, plan.bucket_task))), ",").cast("array<int>")  # one literal, folded once
    return F.get(tasks, F.pmod(F.xxhash64(key), F.lit(len(plan.bucket_task))).cast("int"))


def route(df: DataFrame, key: str, identity: list[str], plan: FragmentPlan) -> DataFrame:
    """Send each row to its task; the column __cairn_task holds it."""
    spread = F.xxhash64(*identity)
    task = (
        F.when(F.col(key).isNull(), F.pmod(spread, F.lit(plan.tasks)).cast("int"))
        .when(F.col(SPLIT).isNotNull(), F.get(SPLIT, F.pmod(spread, F.size(SPLIT)).cast("int")))
        .otherwise(_home(key, plan))
    )
    return _marked(df, key, plan).withColumn(TASK, task).drop(SPLIT).repartitionById(plan.tasks, TASK)


def replicate(df: DataFrame, key: str, plan: FragmentPlan) -> DataFrame:
    """Copy each row to all tasks of its key, which are several for cut keys only."""
    to = F.coalesce(SPLIT, F.array(_home(key, plan)))
    df = _marked(df.where(F.col(key).isNotNull()), key, plan)
    return df.withColumn(TASK, F.explode(to)).drop(SPLIT).repartitionById(plan.tasks, TASK)


def fragment_join(left: DataFrame, right: DataFrame, key: str, identity: list[str], how: str = "inner", plan: FragmentPlan | None = None, keep_task: bool = False) -> DataFrame:
    """Join on key, left routed by load and right copied to the shards of cut keys.

    keep_task: leave the column __cairn_task, by which the result is laid out.

    how: inner, left, left_semi or left_anti; each left row is in one task, so all four are exact.
    Columns of right that left has too are left's in the result.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not a join this operator makes: {how}")
    plan = plan or plan_fragments(left, key)
    clash = [c for c in right.columns if c != key and c in left.columns]
    a = route(left, key, identity, plan)
    b = replicate(right.drop(*clash), key, plan)
    met = a.join(b.hint("merge"), [TASK, key], how)
    return met if keep_task else met.drop(TASK)


def key_totals(df: DataFrame, key: str = "hash", row_id: str = "id", size: str = "size", path: str = "path", plan: FragmentPlan | None = None) -> DataFrame:
    """Totals of every key: rows, different ids, their bytes, and their first and last path.

    n_rows counts rows delivered twice twice; n_files and bytes count each id once. Null ids count
    in n_rows alone. Null sizes count as 0. Null keys have no row in the result, and an empty df
    gives none.
    """
    df = df.select(F.col(key).alias("k"), F.col(row_id).alias("i"), F.col(size).cast("long").alias("s"), F.col(path).alias("p")).where("k is not null")
    plan = plan or plan_fragments(df, "k")
    once = route(df, "k", ["i"], plan).groupBy(TASK, "k", "i").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"), F.min("p").alias("p"), F.max("p").alias("q"))
    known = F.col("i").isNotNull()
    part = once.groupBy(TASK, "k").agg(
        F.sum("n").alias("n_rows"),
        F.count_if(known).alias("n_files"),
        F.coalesce(F.sum(F.when(known, F.col("s"))), F.lit(0).cast("long")).alias("bytes"),
        F.min("p").alias("first_path"),
        F.max("q").alias("last_path"),
    )
    out = ["k", "n_rows", "n_files", "bytes", "first_path", "last_path"]
    cut_keys = [v for v, _ in plan.split]
    if cut_keys:
        # only cut keys have parts in several tasks; the filter goes below the exchange, so that each row is shuffled once and the columns are scanned twice
        is_cut = F.col("k").isin(cut_keys)
        merged = part.where(is_cut).groupBy("k").agg(*(F.sum(c).alias(c) for c in out[1:4]), F.min("first_path").alias("first_path"), F.max("last_path").alias("last_path"))
        part = part.where(~is_cut).select(*out).unionByName(merged)
    return part.select(F.col("k").alias(key), *out[1:])


def frequent_keys(df: DataFrame, key: str = "hash", row_id: str = "id", share: float = 0.01) -> DataFrame:
    """The keys that more than a share of all rows hold, rows with a null key counted among all."""
    plan = plan_fragments(df, key)
    return key_totals(df, key, row_id, plan=plan).where(F.col("n_rows") > F.lit(share) * F.lit(plan.rows))


def members(df: DataFrame, key: str = "hash", row_id: str = "id") -> DataFrame:
    """Every row once, with the totals of its key; rows with a null key have null totals."""
    plan = plan_fragments(df, key)
    totals = key_totals(df, key, row_id, plan=plan).select(key, "n_rows", "n_files", "bytes", "first_path")
    once = route(df.select(row_id, key, "path"), key, [row_id], plan).groupBy(TASK, row_id, key, "path").agg(F.count(F.lit(1)).alias("deliveries"))
    return once.join(replicate(totals, key, plan).hint("merge"), [TASK, key], "left").drop(TASK)
