"""Filling containers of fixed capacity with documents.

One histogram of all lengths gives, by dynamic programming, the length buckets with the least padding.
Token-budget batches are planned over the buckets' counts, longest first: a batch takes as many
documents of a bucket as its budget holds, and what is left of a batch is offered to the next shorter
buckets that fit it best. The plan is a few thousand ranges of ranks, whatever the number of documents;
every document finds its container by its bucket and its rank in it.

A document longer than the capacity fills whole containers and leaves one remainder to pack; no other
is split. Documents without tokens (null or empty text) take no container: they have one row with null
container_no, piece and space_left. Repeated rows are documents of their own. Empty tables give none.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.tokens import VOCABULARY, sized
from cairn.operators.ranking import running

BUCKETS = 256
BUCKETS_OF_A_KIND = 1 << 14  #: more than a kind has
FAR = 1 << 40  #: more than any rank


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most so many buckets with the least padding; lengths ascending.

    Padding of a bucket is the sum of (bound - length). Layer k holds the least padding of the first j
    lengths in k buckets; best cuts rise with j, so each level of halves is solved in one sweep.
    """
    m = len(lengths)
    if m <= buckets:
        return lengths.copy()
    n = np.concatenate(([0], np.cumsum(counts)))
    mass = np.concatenate(([0], np.cumsum(counts * lengths)))

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths i..j-1 in one bucket."""
        return lengths[j - 1] * (n[j] - n[i]) - (mass[j] - mass[i])

    best = np.concatenate(([0], cost(np.zeros(m, int), np.arange(1, m + 1))))
    cuts = []
    for k in range(2, buckets + 1):
        new, cut = np.full(m + 1, np.iinfo(np.int64).max // 4), np.full(m + 1, k - 1)
        spans = [(k, m, k - 1, m - 1)]  # ends j in lo..hi, cuts in a..b
        while spans:
            s = np.array(spans)
            mid = (s[:, 0] + s[:, 1]) // 2
            a, b = s[:, 2], np.minimum(s[:, 3], mid - 1)
            size = b - a + 1
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            i = np.repeat(a - first, size) + np.arange(size.sum())
            v = best[i] + cost(i, np.repeat(mid, size))
            low = np.minimum.reduceat(v, first)
            hit = np.flatnonzero(v == np.repeat(low, size))
            owner = np.repeat(np.arange(len(s)), size)[hit]
            at = i[hit[np.unique(owner, return_index=True)[1]]]
            new[mid], cut[mid] = low, at
            spans = [x for (lo, hi, c, d), j, p in zip(s.tolist(), mid.tolist(), at.tolist()) for x in ((lo, j - 1, c, p), (j + 1, hi, p, d)) if x[0] <= x[1]]
        best = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        out.append(j)
        j = int(cut[j])
    out.append(j)
    return lengths[np.array(out[::-1]) - 1]


def batches(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges (bucket, first rank, documents a container, first container) and the number of containers.

    Buckets are taken from the longest; documents go where the budget left is least and still enough.
    """
    plan, made = [], 0
    left: list[tuple[int, int, int]] = []  # (budget left, first container, containers), sorted
    for k in range(len(bounds) - 1, -1, -1):
        b, n, rank = int(bounds[k]), int(counts[k]), 0
        while n:
            at = bisect_left(left, (b, -1, -1))
            if at < len(left):
                room, first, m = left.pop(at)
            else:
                room, first, m = capacity, made, -(-n // (capacity // b))
                made += m
            per = room // b
            full = min(m, n // per)
            plan.append((k, rank, per, first))
            took = full * per
            if full and room - per * b:
                insort(left, (room - per * b, first, full))
            if full < m:
                if rest := min(n - took, per):
                    took += rest
                    if room - rest * b:
                        insort(left, (room - rest * b, first + full, 1))
                    full += 1
                if full < m:
                    insort(left, (room, first + full, m - full))
            n -= took
            rank += took
    return plan, made


class _Plan:
    """Buckets and ranges of all kinds of containers, in arrays that the executors search."""

    def __init__(self, kinds: list[tuple[str, int]], histograms: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int):
        self.made, self.capacity, self.of = [], np.array([c for _, c in kinds], np.int64), []
        start, per, first = [], [], []
        for k, (_, c) in enumerate(kinds):
            lengths, counts = histograms[c]
            bounds = boundaries(lengths, counts, buckets)
            of = np.searchsorted(bounds, np.arange(c + 1))
            plan, made = batches(bounds, np.bincount(of[lengths], counts, len(bounds)).astype(np.int64) if len(lengths) else counts, c)
            ranges = np.array(sorted(plan), np.int64).reshape(-1, 4)
            start.append((k * BUCKETS_OF_A_KIND + ranges[:, 0]) * FAR + ranges[:, 1])
            per.append(ranges[:, 2])
            first.append(ranges[:, 3])
            self.of.append(of.astype(np.int32))
            self.made.append(made)
        self.start, self.per, self.first = map(np.concatenate, (start, per, first))

    def bucket(self, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kind), np.int32)
        for k, of in enumerate(self.of):
            out[kind == k] = of[size[kind == k]]
        return out

    def container(self, kind: np.ndarray, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = kind.astype(np.int64) * BUCKETS_OF_A_KIND + bucket
        at = np.searchsorted(self.start, key * FAR + rank, "right") - 1
        return self.first[at] + (rank - (self.start[at] - key * FAR)) // self.per[at]


def pack(documents: DataFrame, containers: DataFrame, buckets: int = BUCKETS, path: str = VOCABULARY) -> DataFrame:
    """container, capacity_tokens, container_no, doc_id, piece, pieces, tokens, space_left.

    containers is a small fixed table; its capacities and, of each, at most `capacity` counts reach
    the driver. All kinds are packed in one pass, each a group of its own. Containers without a positive
    capacity are an error.
    """
    kinds = sorted({(r[0], int(r[1] or 0)) for r in containers.select("container", "capacity_tokens").collect()}, key=lambda x: (x[1], str(x[0])))
    if not kinds or kinds[0][1] <= 0:
        raise ValueError("containers need names and positive capacities")
    spark = documents.sparkSession
    sizes = sized(documents, path=path)
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(name).cast("string").alias("container"), F.lit(c).cast("long").alias("capacity_tokens")) for k, (name, c) in enumerate(kinds)))).alias("k")
    each = sizes.select("doc_id", "n_tokens", kind).select("doc_id", "n_tokens", "k.*")
    each = each.withColumns({"whole": F.expr("n_tokens div capacity_tokens"), "tokens": F.col("n_tokens") % F.col("capacity_tokens")})
    each = each.withColumn("pieces", F.col("whole") + (F.col("tokens") > 0).cast("long"))
    counted: dict[int, list[tuple[int, int]]] = {c: [] for _, c in kinds}
    for k, rest, n in each.where("tokens > 0").groupBy("kind", "tokens").agg(F.count(F.lit(1))).collect():  # at most capacity_tokens rows a kind
        counted[kinds[k][1]].append((rest, n))
    histograms = {}
    for c, rows in counted.items():
        h = np.array(sorted(set(rows)), np.int64).reshape(-1, 2)
        histograms[c] = h[:, 0], h[:, 1]
    plan = spark.sparkContext.broadcast(_Plan(kinds, histograms, buckets))  # a number for each size up to the capacities
    made = F.element_at(F.array(*map(F.lit, plan.value.made)), F.col("kind") + 1).cast("long")
    numpy = lambda a: a.to_numpy(zero_copy_only=False)

    @F.arrow_udf("int")
    def bucket(k: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array(plan.value.bucket(numpy(k), numpy(size)))

    @F.arrow_udf("long")
    def container(k: pa.Array, b: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.array(plan.value.container(numpy(k), numpy(b), numpy(rank)))

    rest = running(each.where("tokens > 0").withColumn("bucket", bucket("kind", "tokens")), ["kind", "bucket"], ["doc_id", "tokens"], "rank")
    rest = rest.withColumn("container_no", container("kind", "bucket", "rank"))
    held = Window.partitionBy("kind", "container_no")
    rest = rest.withColumns({"piece": F.col("pieces"), "space_left": F.col("capacity_tokens") - F.sum("tokens").over(held)})
    whole = running(each.where("whole > 0"), ["kind"], ["doc_id", "n_tokens"], "before", "whole")
    whole = whole.withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), "whole")))
    whole = whole.withColumns({"container_no": F.col("before") + F.col("piece") - 1 + made, "tokens": F.col("capacity_tokens"), "space_left": F.lit(0).cast("long")})
    none = each.where("pieces = 0").withColumns({k: F.lit(None).cast("long") for k in ("container_no", "piece", "space_left")})
    columns = ["container", "capacity_tokens", "container_no", "doc_id", "piece", "pieces", "tokens", "space_left"]
    return rest.select(*columns).unionByName(whole.select(*columns)).unionByName(none.select(*columns))


def fill_report(packed: DataFrame) -> DataFrame:
    """Of each kind: containers used, tokens held, space left, and the part of the space that is used."""
    used = packed.where("container_no is not null")
    one = used.groupBy("container", "capacity_tokens", "container_no").agg(F.sum("tokens").alias("t"), F.max("space_left").alias("s"))
    kinds = one.groupBy("container", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"), F.sum("s").alias("space_left"))
    return kinds.withColumn("used_share", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def packing_checks(packed: DataFrame) -> DataFrame:
    """What must hold of each kind: n_documents, n_empty (without a container), and how often a rule is broken.

    split: documents cut though they fit; incomplete: documents some of whose pieces lack; overfull:
    containers over their capacity or whose space_left is wrong; gaps: numbers no container has.
    """
    docs = packed.groupBy("container", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"), F.count("container_no").alias("placed"))
    per_doc = docs.groupBy("container", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.expr("count_if(placed = 0)").alias("n_empty"),
        F.expr("count_if(pieces > 1 and t <= capacity_tokens)").alias("split"),
        F.expr("count_if(placed > 0 and (n != pieces or pieces != ceil(t / capacity_tokens)))").alias("incomplete"),
    )
    boxes = packed.where("container_no is not null").groupBy("container", "container_no").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c"), F.max("space_left").alias("s"), F.min("space_left").alias("s0"))
    per_box = boxes.groupBy("container").agg(F.expr("count_if(t > c or s != c - t or s0 != s)").alias("overfull"), (F.max("container_no") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = per_doc.join(per_box, "container", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("overfull", "gaps")})
