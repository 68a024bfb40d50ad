"""Mixing sources so that each holds its target share of the tokens.

Each source's budget is its share of all tokens. A source is taken whole as often as the budget and its
cap of repeats allow; the rest of the budget is filled from its counts by exact token length: the
same part of every length, then by a bounded-knapsack dynamic program over what remains, in windows
that widen as long as a gap stays, so that the sum is the largest that any choice of documents within
the budget has. Of each length the documents to take are picked by a seeded hash.

Source names are compared in lower case, without outer space, `-` as `_`. Documents without tokens and
of sources without a target are not taken, yet count among all tokens. A source that its cap keeps
below its share, or that has no documents, shows as such in the report. Repeated rows are documents of
their own. Null shares count as 0, null caps as 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.tokens import VOCABULARY, sized
from cairn.operators.ranking import running

WINDOW = 1 << 16  #: tokens of a budget's end that the dynamic program fills first; see fit_budget


def source_name(c: Column | str) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))


def best_subset(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray | None = None) -> np.ndarray:
    """How many of each length to take for the largest sum that is at most budget.

    The sums that can be reached are the bits of one number: taking a part of weight w shifts it by w.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    by = np.full(budget + 1, -1, np.int32)  # the part that first reached each sum
    reached, all_bits = 1, (1 << (budget + 1)) - 1
    parts: list[tuple[int, int]] = []
    for i in order if order is not None else range(len(lengths)):
        n, size = min(int(counts[i]), budget // max(1, int(lengths[i]))), 1
        while n > 0:
            k = min(size, n)
            new = (reached << k * int(lengths[i])) & all_bits & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                at = np.flatnonzero(bits)
                sums = (at[:, None] * 8 + np.arange(8))[np.unpackbits(bits[at], bitorder="little").reshape(-1, 8) == 1]
                by[sums] = len(parts)
                reached |= new
            parts.append((i, k))
            n, size = n - k, size * 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    while at:
        i, k = parts[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def _filled(lengths: np.ndarray, counts: np.ndarray, rest: int, order: np.ndarray, window: int) -> np.ndarray:
    """How many of each length to take for rest: the same part of every length, then the best subset for what lacks, window at most."""
    take = np.zeros(len(lengths), np.int64)
    if rest > window:
        take = np.floor(counts * ((rest - window / 2) / int((lengths * counts).sum()))).astype(np.int64)
        gap = rest - int((take * lengths).sum())
        for i in order:  # lengths too rare for a part of their own
            if gap <= window:
                break
            k = min(int(counts[i] - take[i]), (gap - 1) // int(lengths[i]))
            take[i] += k
            gap -= k * int(lengths[i])
        rest = gap
    return take + best_subset(lengths, counts - take, rest, order)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int, seed: int = 0, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """Whole repeats of a source, and how many documents of each length to take once more.

    Where a window leaves a gap the next one is eight times as wide, until the gap is closed, is smaller
    than what all lengths are multiples of, or the window holds the whole rest and so proves it least.
    """
    have = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if not have or budget <= 0 or max_repeats <= 0:
        return 0, take
    repeats = min(budget // have, max_repeats)
    rest = budget - repeats * have
    if repeats == max_repeats or not rest:
        return repeats, take
    order = np.random.default_rng(seed).permutation(len(lengths))
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    best = rest + 1
    while True:
        got = _filled(lengths, counts, rest, order, window)
        gap = rest - int((got * lengths).sum())
        if gap < best:
            best, take = gap, got
        if best < unit or window >= rest:
            return repeats, take
        window *= 8


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 17, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, copies) and the report of shares.

    targets is a small fixed table with one row a source. Histograms stay on the executors; each
    holds one count for every different length of a source.
    """
    sizes = sized(documents.select("doc_id", "text", source_name("source").alias("source")), "source", path=path)
    total = int(sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    rows = targets.select(source_name("source"), F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(1))).collect()
    goal = {name: (int(round(share * total)), int(cap)) for name, share, cap in rows if name is not None}
    wanted = sizes.where(F.col("n_tokens") > 0).where(F.col("source").isin(list(goal)))

    def plan(key: tuple, h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("n_tokens")
        budget, cap = goal[key[0]]
        repeats, take = fit_budget(h.n_tokens.to_numpy(), h.n.to_numpy(), budget, cap, seed)
        return pd.DataFrame({"source": key[0], "n_tokens": h.n_tokens.to_numpy(), "repeats": repeats, "take": take})

    counts = wanted.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    plans = counts.groupBy("source").applyInPandas(plan, "source string, n_tokens long, repeats long, take long")
    ranks = running(wanted, ["source", "n_tokens"], ["doc_id"], "rank", seed=seed)
    mixed = ranks.join(plans, ["source", "n_tokens"]).withColumn("copies", F.col("repeats") + (F.col("rank") < F.col("take")).cast("long"))
    mixed = mixed.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")

    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    have = wanted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    named = targets.sparkSession.createDataFrame([(n, float(s), int(c), goal[n][0]) for n, s, c in rows if n is not None], "source string, target_share double, max_repeats int, budget_tokens long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = named.join(have, "source", "left").join(got, "source", "left")
    report = report.select("source", "target_share", "max_repeats", "budget_tokens", zero("available_tokens"), zero("tokens"), zero("most_copies"))
    taken = F.sum("tokens").over(_whole())
    part = lambda whole: F.coalesce(F.try_divide(F.col("tokens"), whole), F.lit(0.0))
    return mixed, report.withColumns({"share_of_all": part(F.lit(total)), "share_of_mixture": part(taken)})


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # the report's few rows


def mixture_checks(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """Of each source of the report: whether copies keep to the cap, totals agree, and the budget is hit, or else the source used up."""
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("c"))
    r = report.join(got, "source", "left")
    t, cap = F.coalesce("t", F.lit(0)), F.greatest("max_repeats", F.lit(0))
    return r.select(
        "source",
        (F.coalesce("c", F.lit(0)) <= cap).alias("within_cap"),
        (t == F.col("tokens")).alias("totals_agree"),
        (t <= F.col("budget_tokens")).alias("within_budget"),
        (t == F.least("budget_tokens", F.col("available_tokens") * cap)).alias("reached"),
    )
