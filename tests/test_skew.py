import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cairn.operators import references, skew
from cairn.operators.ranking import running

SCHEMA = "id long, hash string, size long, path string, k string, n_rows int"


def rows(seed=3, n=900):
    r = random.Random(seed)
    out = []
    for i in range(n):
        h = r.choice(["hot"] * 6 + ["warm"] * 2 + [None, "", f"c{r.randint(0, 300)}"])
        out.append((r.choice([i, i, None]), h, r.choice([None, i, 0]), r.choice([None, f"/p/{i}"]), "x", 5))
    return out + out[:50]


def totals(data):
    got = defaultdict(lambda: [0, {}, []])
    for i, h, s, p, *_ in data:
        if h is None:
            continue
        got[h][0] += 1
        if i is not None:
            got[h][1][i] = max(got[h][1].get(i, 0), s or 0)
        if p is not None:
            got[h][2].append(p)
    return {h: (n, len(ids), sum(ids.values()), min(ps, default=None), max(ps, default=None)) for h, (n, ids, ps) in got.items()}


def test_pack_is_even():
    placed, loads = skew.pack([(float(x), x) for x in range(1, 41)], 4)
    assert len(placed) == 40 and sum(loads) == 820 and max(loads) - min(loads) <= 4


def test_totals_and_frequent_keys(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    plan = skew.plan_fragments(df, "hash", tasks=5)
    assert "hot" in dict(plan.split) and len(dict(plan.split)["hot"]) > 1 and max(plan.load) < 0.5 * len(data)
    want = totals(data)
    assert {r[0]: tuple(r[1:]) for r in skew.key_totals(df).collect()} == want
    n = Counter(h for _, h, *_ in data if h is not None)
    assert {r.hash for r in skew.frequent_keys(df).collect()} == {h for h, x in n.items() if x > 0.01 * len(data)}
    once = {(i, h, p) for i, h, _, p, *_ in data}
    got = skew.members(df).collect()
    assert {(r.id, r.hash, r.path) for r in got} == once and len(got) == len(once)
    assert all((r.n_rows, r.n_files) == want[r.hash][:2] for r in got if r.hash is not None)
    empty = df.limit(0)
    assert skew.key_totals(empty).count() == skew.frequent_keys(empty).count() == skew.members(empty).count() == 0


def test_heavy_rows_are_spread(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    plan = skew.plan_fragments(df, "k", tasks=8)
    sizes = [r[1] for r in skew.route(df, "k", ["id"], plan).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 4000 / 8


def test_joins_equal_plain_ones(spark):
    r = random.Random(4)
    left = spark.createDataFrame([(i, r.choice([1, 1, 1, 2, None, i]), i) for i in range(400)], "id long, k long, v long")
    right = spark.createDataFrame([(i, f"w{i}", 0) for i in range(0, 400, 2)] + [(1, "a", 0), (1, "b", 0), (None, "n", 0)], "k long, w string, v long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.fragment_join(left, right, "k", ["id"], how)
        want = left.join(right.drop("v"), "k", how)
        key = lambda x: sorted(map(str, (tuple(q) for q in x.select(*want.columns).collect())))
        assert key(got) == key(want), how


def test_running_numbers(spark):
    r = random.Random(5)
    data = [(i, r.choice(["a", "a", None, "b"]), r.choice([None, 1, 7])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, g string, v long")
    got = running(running(df, ["g"], ["id"], "n"), ["g"], ["id"], "s", "v", shards=3).collect()
    by = defaultdict(list)
    for x in got:
        by[x.g].append(x)
    for group in by.values():
        assert sorted(x.n for x in group) == list(range(len(group)))
        at = 0
        for x in sorted(group, key=lambda x: (x.s, x.v or 0)):
            assert x.s == at
            at += x.v or 0


def test_broken_references(spark):
    ts = "2024-0{}-01 00:00:00"
    files = [(1, ts.format(5), 1), (2, None, 1), (3, ts.format(1), 1), (3, ts.format(1), 1), (None, ts.format(1), 1)]
    cls = [(10, 1, ts.format(3)), (10, 1, ts.format(3)), (11, 2, ts.format(3)), (12, 9, None), (13, None, ts.format(1)), (14, 8, ts.format(2)), (15, 3, ts.format(2)), (16, 1, None)]
    ops = [(20, 8, "DELETE", True, ts.format(4)), (21, 7, "DELETE", False, None), (22, 3, "DELETE", True, ts.format(9)), (23, 1, None, True, ts.format(4)), (24, None, "DELETE", True, ts.format(4))]
    f = spark.createDataFrame(files, "id long, s string, at int").withColumn("scanned_at", F.col("s").cast("timestamp_ntz"))
    c = spark.createDataFrame(cls, "id long, file_id long, s string").withColumn("classified_at", F.col("s").cast("timestamp_ntz"))
    o = spark.createDataFrame(ops, "id long, file_id long, action string, executed boolean, s string").withColumn("executed_at", F.col("s").cast("timestamp_ntz"))
    got = {tuple(r) for r in references.broken_references(f, c, o).collect()}
    assert got == {
        ("classifications", 10, "2024-03", "late"), ("classifications", 12, "none", "missing"), ("classifications", 14, "2024-02", "deleted"),
        ("operations", 20, "2024-04", "deleted"), ("operations", 21, "none", "missing"), ("operations", 23, "2024-04", "late"),
    }
    report = {tuple(r) for r in references.reference_report(f, c, o).collect()}
    assert ("operations", "2024-04", "late", 1) in report and sum(r[3] for r in report) == len(got)
    assert references.broken_references(f.limit(0), c.limit(0), o.limit(0)).count() == 0
    assert {r[3] for r in references.broken_references(f.limit(0), c, o.limit(0)).collect()} == {"missing"}
