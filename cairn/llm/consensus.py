"""The best representative of each group of duplicates.

trusted() takes each field from the row that can be trusted most, by given rules. consensus() builds
the group's common value and picks the existing value closest to it: the values' tokens are aligned
progressively, heaviest value first; every value votes with its weight in each column; the winning
tokens make the consensus. survivors() does so for every field, with the trust in a row as its weight.

A value with half of the weight wins every column and needs no alignment, nor do values of one token
each, of which the heaviest wins. In any other group, whatever its size, all votes count: its GUIDE heaviest values set up columns one after the other, and all others are
aligned to these in parallel. A token between two columns opens a place of its own there, counted by
its offset; it stays if it outweighs the values that have none. Votes are summed by the cluster.
Values equal as strings are aligned once, with their summed weight.

Null values have no vote; a group without values has no row in consensus(), and zeros in trusted().
Ties go to the smallest id. Repeated rows count once. Empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.catalog import content
from cairn.operators.skew import TASK, fragment_join, plan_fragments
from cairn.session import cut

GUIDE = 24
GAP = -0.4
CELLS = 1 << 24  #: cells of an alignment kept at once; larger ones are divided, with the same score
COLUMN = 1 << 30  #: offset of a column's own place, behind the tokens inserted before it
TOKEN = re.compile(r"[^\W_]+|[\W_]")
ONE_TOKEN = r"(?s)^([\p{L}\p{N}]*|.)$"  #: a value of one token, or of none


def _sound() -> Column:
    """Whether a row's mtime is not null, of 1970 or after the row's own scan."""
    return F.col("mtime").isNotNull() & (F.year("mtime") != 1970) & ~F.coalesce(F.col("mtime") > F.col("scanned_at"), F.lit(False))


def trusted(files: DataFrame, classifications: DataFrame) -> DataFrame:
    """content_hash, mtime_id, path_id and classification_id of every content that several ids hold.

    Latest mtime that is not null, of 1970 or after the row's own scan; path with the fewest `/`;
    classification with the highest confidence within 0 to 1, then the latest (null last). Each
    aggregate combines before it shuffles, so that no content is gathered in one task.
    """
    known = classifications.where("file_id is not null and confidence between 0 and 1 and not isnan(confidence)")
    rank = F.struct("confidence", F.coalesce(F.unix_micros(F.col("classified_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"), (-F.col("id")).alias("low"))
    best = known.where("id is not null").groupBy(F.col("file_id").alias("id")).agg(F.max(rank).alias("best"))
    rows = files.where("id is not null").select("id", content("hash").alias("content_hash"), "mtime", "scanned_at", F.regexp_count("path", F.lit("/")).alias("depth"))
    rows = rows.where("content_hash is not null")
    rows = rows.select(
        "id",
        "content_hash",
        F.when(_sound(), F.struct("mtime", (-F.col("id")).alias("low"))).alias("m"),
        F.when(F.col("depth").isNotNull(), F.struct("depth", "id")).alias("p"),
    )
    grouped = rows.join(best, "id", "left").groupBy("content_hash")
    got = grouped.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("m").alias("m"), F.min("p").alias("p"), F.max("best").alias("c")).where("a != b")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return got.select("content_hash", zero(-F.col("m.low")).alias("mtime_id"), zero(F.col("p.id")).alias("path_id"), zero(-F.col("c.low")).alias("classification_id"))


def _scores_of(gains: Iterator[np.ndarray], skip: np.ndarray, m: int) -> np.ndarray:
    """The best score of all columns against each beginning of m tokens; gains gives the columns' rows."""
    step = GAP * np.arange(m + 1)
    row = step.copy()
    for g, s in zip(gains, skip):
        alone = row + s
        alone[1:] = np.maximum(alone[1:], row[:-1] + g)
        row = np.maximum.accumulate(alone - step) + step
    return row


def _paths(gain: np.ndarray, skip: np.ndarray, size: np.ndarray) -> list[list[tuple[int | None, int | None]]]:
    """Pairs (column, token number) of the best alignment of each value, None for a gap.

    gain: column, value, token; size: the tokens of each value, the rest being padding.
    """
    n, many, m = gain.shape
    step = GAP * np.arange(m + 1)
    row = np.tile(step, (many, 1))
    way = np.full((n + 1, many, m + 1), 2, np.int8)  # 0 both, 1 the column alone, 2 the token alone
    both = np.full((many, m + 1), -np.inf)
    for i in range(n):
        alone = row + skip[i]
        np.add(row[:, :-1], gain[i], out=both[:, 1:])
        shifted = np.maximum(alone, both) - step
        reached = np.maximum.accumulate(shifted, axis=1)
        way[i + 1] = both < alone
        way[i + 1][reached > shifted] = 2
        row = reached + step
    out = []
    for v in range(many):
        i, j, path = n, int(size[v]), []
        while i or j:
            w = way[i, v, j]
            i, j = i - (w != 2), j - (w != 1)
            path.append((i if w != 2 else None, j if w != 1 else None))
        out.append(path[::-1])
    return out


class Profile:
    """Columns of an alignment: for each the weight of every token, '' where a value has none."""

    def __init__(self, columns: list[dict[str, float]] | None = None, weight: float = 0.0):
        self.columns, self.weight = columns or [], weight
        self._index: tuple[dict[str, int], np.ndarray, np.ndarray] | None = None

    def _table(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Numbers of the known tokens, their gain in each column (the last is that of unknown ones), and the cost of leaving a column out."""
        if self._index is None:
            total = max(self.weight, 1e-9)
            known = {t: k for k, t in enumerate(dict.fromkeys(t for c in self.columns for t in c if t))}
            gain = np.zeros((len(self.columns), len(known) + 1))
            for i, c in enumerate(self.columns):
                for t, w in c.items():
                    if t:
                        gain[i, known[t]] = w / total
            # leaving out a column that most values leave out costs little
            skip = np.array([GAP * (1 - c.get("", 0.0) / total) for c in self.columns])
            self._index = known, gain, skip
        return self._index

    def numbered(self, tokens: list[str]) -> tuple[int, ...]:
        """The tokens by number; all that no column knows have one, since they gain nothing anywhere."""
        known = self._table()[0]
        return tuple(known.get(t, len(known)) for t in tokens)

    def place(self, values: list[tuple[int, ...]]) -> list[list[tuple[int | None, int | None]]]:
        """The best global alignment of each value with the columns, many values at a time.

        Columns at either end that hold one token in all values go to that token: no alignment scores
        more, since nothing gains more than they do and nothing is dearer to leave out.
        """
        _, gain, skip = self._table()
        if len(values) == 1 and gain.size:
            full = np.where(gain.max(1) == 1, gain.argmax(1), -1).tolist()
            v, n, m = values[0], len(full), len(values[0])
            a = next((k for k in range(min(n, m)) if full[k] != v[k]), min(n, m))
            b = next((k for k in range(min(n, m) - a) if full[n - 1 - k] != v[m - 1 - k]), min(n, m) - a)
            if a + b:
                inner = Profile()
                inner._index = {}, gain[a : n - b], skip[a : n - b]
                middle = inner.place([v[a : m - b]])[0] if n > a + b or m > a + b else []
                shifted = [(None if i is None else i + a, None if j is None else j + a) for i, j in middle]
                return [[(k, k) for k in range(a)] + shifted + [(n - k, m - k) for k in range(b, 0, -1)]]
        out: dict[int, list] = {}
        order = sorted(range(len(values)), key=lambda k: len(values[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * (len(skip) + 1) * (len(values[order[to]]) + 1) <= CELLS // 8:
                to += 1
            some = [values[k] for k in order[at:to]]
            m = len(some[-1])
            if len(some) == 1 and (len(skip) + 1) * (m + 1) > CELLS:
                out[order[at]] = self._divided(np.array(some[0], np.int64), 0, len(skip), 0)
            else:
                ids = np.full((len(some), m), gain.shape[1] - 1)
                for k, v in enumerate(some):
                    ids[k, : len(v)] = v
                for k, path in zip(order[at:to], _paths(gain[:, ids], skip, np.array([len(v) for v in some]))):
                    out[k] = path
            at = to
        return [out[k] for k in range(len(values))]

    def _divided(self, ids: np.ndarray, a: int, b: int, offset: int) -> list[tuple[int | None, int | None]]:
        """The same for one long value: columns a to b are halved where both halves score best together."""
        _, gain, skip = self._table()
        if b - a == 1 or (b - a + 1) * (len(ids) + 1) <= CELLS:
            path = _paths(gain[a:b, ids[None, :]], skip[a:b], np.array([len(ids)]))[0]
            return [(None if i is None else i + a, None if j is None else j + offset) for i, j in path]
        mid = (a + b) // 2
        rows = lambda span, x: (gain[i, x] for i in span)
        left = _scores_of(rows(range(a, mid), ids), skip[a:mid], len(ids))
        right = _scores_of(rows(range(b - 1, mid - 1, -1), ids[::-1]), skip[mid:b][::-1], len(ids))[::-1]
        j = int(np.argmax(left + right))
        return self._divided(ids[:j], a, mid, offset) + self._divided(ids[j:], mid, b, offset + j)

    def add(self, tokens: list[str], weight: float) -> None:
        out = []
        for i, j in self.place([self.numbered(tokens)])[0]:
            column = self.columns[i] if i is not None else {"": self.weight} if self.weight else {}
            t = tokens[j] if j is not None else ""
            column[t] = column.get(t, 0.0) + weight
            out.append(column)
        self.columns, self.weight, self._index = out, self.weight + weight, None

    def consensus(self) -> str:
        """The heaviest token of each column; ties go to the value that came first."""
        return "".join(max(c, key=c.__getitem__) for c in self.columns)


def aligned(values: list[tuple[str, float]]) -> Profile:
    """The progressive alignment of values, the weightiest first."""
    p = Profile()
    for v, w in sorted(values, key=lambda x: (-x[1], x[0])):
        p.add(TOKEN.findall(v), w)
    return p


def slots(path: list[tuple[int | None, int | None]]) -> Iterator[tuple[int, int, int | None]]:
    """column, offset and token number of each step of an alignment: COLUMN for the column itself, 1, 2, ... for what is inserted before it."""
    at = inserted = 0
    for i, j in path:
        if i is None:
            inserted += 1
            yield at, inserted, j
        else:
            yield i, COLUMN, j
            at, inserted = i + 1, 0


def consensus(rows: DataFrame, group: str, value: str, row_id: str, weight: Column | str | None = None, guide: int = GUIDE, repeated: bool = True) -> DataFrame:
    """group, consensus, closest, closest_id and aligned: the common value, the existing one nearest to it, and whether that took an alignment.

    repeated: whether a row may come several times, to be counted once with its largest weight. weight, 1 by default, is a row's vote; null and negative weights count as 0, and a group all of whose
    weights are 0 goes to its smallest value. Nearness is the edit distance by characters.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0.0)).cast("double"), F.lit(0.0))
    once = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull() & F.col(row_id).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"), F.col(row_id).alias("i"), w.alias("w"))
    if repeated:
        once = once.groupBy("g", "v", "i").agg(F.max("w").alias("w"))
    values = cut(once.groupBy("g", "v").agg(F.sum("w").alias("w"), F.min("i").alias("i")))
    kind = values.schema["g"].dataType.simpleString()

    tops = values.groupBy("g").agg(F.min(F.struct((-F.col("w")).alias("w"), "v", "i")).alias("top"), F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("v").rlike(ONE_TOKEN)).alias("one_token"))
    decided = (F.col("top.w") * -2 >= F.col("total")) | F.col("one_token")
    settled = tops.where(decided).select(F.col("g").alias(group), F.col("top.v").alias("consensus"), F.col("top.v").alias("closest"), F.col("top.i").alias("closest_id"), F.lit(False).alias("aligned"))
    plan = plan_fragments(values, "g")
    undecided = cut(tops.where(~decided).select("g", "total", F.col("n").alias("n_values")))
    left = cut(fragment_join(values, undecided, "g", ["v"], "inner", plan))

    first = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("w"), "v"))  # limited by group before the shuffle
    lists = left.withColumn("rn", first).where(F.col("rn") <= guide).groupBy("g").agg(F.collect_list(F.struct("v", "w")).alias("vs"), F.max("n_values").alias("n"))

    def set_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, vs, n in zip(b["g"], b["vs"], b["n"]):
                p = aligned([(x["v"], x["w"]) for x in vs])
                out.append((g, p.consensus(), None, None) if n <= guide else (g, None, json.dumps(p.columns), p.weight))
            yield pd.DataFrame(out, columns=["g", "consensus", "columns", "weight"])

    profiles = cut(lists.mapInPandas(set_up, f"g {kind}, consensus string, columns string, weight double"))
    small = profiles.where("consensus is not null").select("g", "consensus")
    large = profiles.where("consensus is null").select("g", "columns", "weight")

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, Profile] = {}
        for b in batches:
            out = []
            for (g, total), part in b.groupby(["g", "total"], sort=False):
                if (columns := part["columns"].dropna()).size:  # the first row of a group, whose rows follow each other
                    kept = {g: Profile(json.loads(columns.iloc[0]), part["weight"].iloc[0])}
                tokens = [TOKEN.findall(v) for v in part["v"]]
                seen = [kept[g].numbered(t) for t in tokens]
                unlike = list(dict.fromkeys(seen))
                path = dict(zip(unlike, kept[g].place(unlike)))
                sums: dict[tuple[int, int, str], float] = {}
                for t, s, w in zip(tokens, seen, part["w"]):
                    for c, o, j in slots(path[s]):
                        key = c, o, t[j] if j is not None else ""
                        sums[key] = sums.get(key, 0.0) + w
                out += [(g, total, *k, w) for k, w in sums.items()]
            yield pd.DataFrame(out, columns=["g", "total", "c", "o", "t", "w"])

    met = fragment_join(left, large, "g", ["v"], "inner", plan, keep_task=True)
    head = F.row_number().over(Window.partitionBy(TASK, "g").orderBy("v")) == 1
    met = met.select("g", "total", "v", "w", F.when(head, F.col("columns")).alias("columns"), "weight")  # columns go to Python once a shard
    votes = met.mapInPandas(vote, f"g {kind}, total double, c int, o int, t string, w double")
    token = votes.groupBy("g", "c", "o", "t").agg(F.sum("w").alias("w"), F.max("total").alias("total"))
    slot = token.groupBy("g", "c", "o").agg(F.min(F.struct((-F.col("w")).alias("w"), "t")).alias("best"), F.sum("w").alias("voted"), F.max("total").alias("total"))
    stays = (F.col("o") == COLUMN) | (-F.col("best.w") > F.col("total") - F.col("voted"))  # an inserted token against all who have none
    won = slot.where(stays).select("g", "c", "o", F.col("best.t").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "o", "t"))), lambda x: x["t"]), "")  # places of the longest guide at most, and what outweighs them
    common = small.unionByName(won.groupBy("g").agg(joined.alias("consensus")))

    near = fragment_join(left.select("g", "v", "i"), common, "g", ["v"], "inner", plan)
    best = near.groupBy("g", "consensus").agg(F.min(F.struct(F.levenshtein("v", "consensus").alias("d"), "i", "v")).alias("b"))
    return settled.unionByName(best.select(F.col("g").alias(group), "consensus", F.col("b.v").alias("closest"), F.col("b.i").alias("closest_id"), F.lit(True).alias("aligned")))


def survivors(files: DataFrame, classifications: DataFrame) -> DataFrame:
    """One record for each content of several ids, every field by weighted consensus of the group's values.

    content_hash; path, size, category, owner and year, each an existing value closest to the consensus
    of the group's, and path_consensus, which need not exist, with path_aligned, whether it took an alignment; mtime and scan_path of the rows that
    trusted() picks, mtime having an order and no tokens. A files row's weight is its completeness: one,
    and one more each for a sound mtime, a size and not being marked a duplicate. A classification's
    weight is its confidence, 0 where that is null or outside 0 to 1. Categories are compared in lower case.
    """
    picked = cut(trusted(files, classifications))
    key = F.base64(F.unhex(content("hash"))).alias("content")
    rows = files.where("id is not null").select("id", key, "path", "size", _sound().alias("sound"), F.coalesce("is_duplicate", F.lit(False)).alias("dup"))
    rows = rows.where("content is not null").repartition("id").dropDuplicates(["id"])
    trust = 1.0 + F.col("sound").cast("double") + F.col("size").isNotNull().cast("double") + (~F.col("dup")).cast("double")
    sure = F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence")).otherwise(0.0)
    classes = classifications.where("id is not null and file_id is not null").select(F.col("file_id").alias("id"), F.col("id").alias("class_id"), F.lower(F.trim("category")).alias("category"), "owner", F.col("year").cast("string").alias("year"), sure.alias("sure"))
    # laid out by file both are deduplicated and joined where they are
    classes = classes.repartition("id").dropDuplicates(["id", "class_id"]).join(rows.select("id", "content"), "id")
    vote = lambda field, weight: F.struct(F.concat(F.lit(field + ":"), "content").alias("key"), F.col(field).cast("string").alias("value"), weight.alias("weight"))
    each = lambda df, row, *votes: df.select(F.col(row).alias("row"), F.inline(F.array(*votes)))
    votes = each(rows, "id", vote("path", trust), vote("size", trust)).unionByName(each(classes, "class_id", *(vote(f, F.col("sure")) for f in ("category", "owner", "year"))))
    got = consensus(votes, "key", "value", "row", "weight", repeated=False)
    got = got.select(F.lower(F.hex(F.unbase64(F.split("key", ":")[1]))).alias("content_hash"), F.split("key", ":")[0].alias("field"), "closest", "consensus", "aligned")
    of = lambda field, c="closest": F.max(F.when(F.col("field") == field, F.col(c)))
    fields = got.groupBy("content_hash").agg(of("path").alias("path"), of("path", "consensus").alias("path_consensus"), of("path", "aligned").alias("path_aligned"), of("size").cast("long").alias("size"), of("category").alias("category"), of("owner").alias("owner"), of("year").cast("int").alias("year"))
    best = lambda key, *cs: files.select(F.col("id").alias(key), *cs).dropDuplicates([key])
    out = picked.join(fields, "content_hash", "left").join(best("mtime_id", "mtime"), "mtime_id", "left").join(best("path_id", F.col("path").alias("scan_path")), "path_id", "left")
    return out.select("content_hash", "mtime", "scan_path", "path", "path_consensus", "path_aligned", "size", "category", "owner", "year")
