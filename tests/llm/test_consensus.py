import random
from datetime import datetime

from cairn.llm import consensus as c

H = [f"{i:064x}" for i in range(1, 40)]
FILES = "id long, path string, hash string, mtime timestamp_ntz, scanned_at timestamp_ntz, confidence int"
CLASSES = "id long, file_id long, category string, owner string, year int, confidence double, classified_at timestamp_ntz, hash string"


def test_trusted_equals_brute_force(spark):
    r = random.Random(7)
    day = lambda: r.choice([None, datetime(1970, 1, 1), *(datetime(2024, r.randint(1, 4), 1) for _ in range(4))])
    files = [(i, r.choice([None, "/a", "/a/b", "/a/b/c", ""]), r.choice([*H[:6], H[0], H[0].upper(), None, "x"]), day(), r.choice([None, datetime(2024, 3, 1)]), 1) for i in range(1, 120)]
    files += files[:9] + [(None, "/a", H[0], None, None, 1), (500, None, H[30], None, None, 1), (501, None, H[30], None, None, 1), (502, "/q", H[31], None, None, 1), (502, "/q", H[31], None, None, 1)]
    classes = [(i, r.choice([None, *range(1, 130)]), "k", None, None, r.choice([None, 0.5, 1.0, 1.0, 7.0, -1.0, float("nan")]), day(), "q") for i in range(1, 200)]
    got = {x[0]: tuple(x[1:]) for x in c.trusted(spark.createDataFrame(files, FILES), spark.createDataFrame(classes, CLASSES)).collect()}
    groups: dict = {}
    for i, p, h, m, s, _ in files:
        if i is not None and h and len(h) == 64:
            groups.setdefault(h.lower(), {})[i] = (p, m, s)
    want = {}
    for h, rows in groups.items():
        if len(rows) < 2:
            continue
        times = [(m, -i) for i, (_, m, s) in rows.items() if m and m.year != 1970 and not (s and m > s)]
        depth = [(p.count("/"), i) for i, (p, *_) in rows.items() if p is not None]
        best = [(k[5], k[6] or datetime.min, -k[0]) for k in classes if k[1] in rows and k[5] is not None and 0 <= k[5] <= 1]
        want[h] = (-max(times)[1] if times else 0, min(depth)[1] if depth else 0, -max(best)[2] if best else 0)
    assert got == want
    empty = c.trusted(spark.createDataFrame([], FILES), spark.createDataFrame([], CLASSES))
    assert empty.count() == 0


def slow_place(columns, weight, tokens):
    """The score of the best alignment, cell by cell."""
    n, m, total = len(columns), len(tokens), max(weight, 1e-9)
    score = [[c.GAP * j for j in range(m + 1)]]
    for i in range(1, n + 1):
        skip = c.GAP * (1 - columns[i - 1].get("", 0.0) / total)
        row = [score[-1][0] + skip]
        for j in range(1, m + 1):
            row.append(max(score[-1][j - 1] + columns[i - 1].get(tokens[j - 1], 0.0) / total, score[-1][j] + skip, row[-1] + c.GAP))
        score.append(row)
    return score[n][m]


def score_of(columns, weight, tokens, path):
    out = 0.0
    for i, j in path:
        if i is None:
            out += c.GAP
        elif j is None:
            out += c.GAP * (1 - columns[i].get("", 0.0) / weight)
        else:
            out += columns[i].get(tokens[j], 0.0) / weight
    assert [i for i, _ in path if i is not None] == list(range(len(columns))) and [j for _, j in path if j is not None] == list(range(len(tokens)))
    return out


def test_alignments_are_optimal(monkeypatch):
    r = random.Random(3)
    word = lambda: r.choices("abcde/", k=r.randint(0, 9))
    for cells in (c.CELLS, 40):  # the second divides alignments
        monkeypatch.setattr(c, "CELLS", cells)
        for _ in range(40):
            p = c.aligned([("".join(word()), r.choice([1.0, 2.0])) for _ in range(4)])
            values = [word() for _ in range(6)]
            for tokens, path in zip(values, p.place([p.numbered(t) for t in values])):
                assert abs(score_of(p.columns, p.weight, tokens, path) - slow_place(p.columns, p.weight, tokens)) < 1e-9


def test_alignment_and_votes():
    values = [("/a/b/x.txt", 3.0), ("/a/b/c/x.txt", 1.0), ("/a/q/x.txt", 1.0), ("/a/b/x.md", 1.0)]
    assert c.aligned(values).consensus() == "/a/b/x.txt"
    three = [("/a/b/1.txt", 1.0), ("/a/c/2.txt", 1.0), ("/a/b/3.md", 1.0)]
    assert c.aligned(three).consensus() in {f"/a/b/{n}.txt" for n in (1, 2, 3)}
    assert c.aligned([("b", 1.0), ("a", 1.0)]).consensus() == "a"
    assert c.aligned([("", 1.0)]).consensus() == ""


def test_consensus_of_small_and_large_groups(spark):
    rows = [("big", f"/u/{k % 7}/docs/report {k}.txt", k, 1) for k in range(300)] + [("big", "/u/3/docs/report 7.txt", 1000, 1), ("big", "/odd", 1001, 1)]
    rows += [("small", "/a/b/1.txt", 1, 1), ("small", "/a/b/1.txt", 2, 1), ("small", "/a/c/1.txt", 3, 1), ("one", "/z", 9, 1), (None, "/z", 1, 1), ("nul", None, 1, 1)]
    rows += [("three", v, k, 1) for k, v in enumerate(("/a/b/1.txt", "/a/c/2.txt", "/a/b/3.md"))]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "g string, v string, i long, consensus int")
    got = {r.g: r for r in c.consensus(df, "g", "v", "i").collect()}
    assert set(got) == {"big", "small", "one", "three"}
    assert got["small"].closest == "/a/b/1.txt" and got["small"].closest_id == 1 and got["one"].consensus == "/z"
    assert got["big"].consensus.startswith("/u/") and got["big"].consensus.endswith(".txt") and "/docs/report" in got["big"].consensus
    assert got["big"].closest in {r[1] for r in rows} and got["big"].closest != "/odd"
    want = c.aligned([("/a/b/1.txt", 1.0), ("/a/c/2.txt", 1.0), ("/a/b/3.md", 1.0)]).consensus()
    assert got["three"].consensus == want and got["three"].closest == min((v for g, v, *_ in rows if g == "three"), key=lambda v: distance(v, want))
    assert c.consensus(df.limit(0), "g", "v", "i").count() == 0
    heavy = df.withColumn("w", df.i.cast("double"))
    assert {r.g: r.closest for r in c.consensus(heavy, "g", "v", "i", "w").collect()}["small"] == "/a/b/1.txt"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_later_values_open_columns(spark):
    """Tokens that no guide has win where most values hold them, whatever their place in the order."""
    rows = [("g", f"/a/{k:02d}/z", k) for k in range(10)] + [("g", f"/a/{k}/deep/er/z", k) for k in range(100, 140)]
    df = spark.createDataFrame(rows, "g string, v string, i long")
    got = c.consensus(df, "g", "v", "i", guide=5).first()
    assert got.consensus.endswith("/deep/er/z") and got.closest.endswith("/deep/er/z")


def test_survivors_of_every_field(spark):
    day = datetime(2024, 1, 1)
    files = [(1, "/a/b/r.txt", H[0], day, day, 5, None), (2, "/x/a/b/r.txt", H[0], None, day, 5, True), (3, "/a/b/r.txt ", H[0], None, day, None, True), (4, "/solo", H[1], day, day, 1, None)]
    df = spark.createDataFrame(files, "id long, path string, hash string, mtime timestamp_ntz, scanned_at timestamp_ntz, size long, is_duplicate boolean")
    classes = [(10, 1, "Data", None, None, 0.3, day, "x"), (11, 2, "image", "kim", 1999, 0.9, day, "x"), (12, 3, "data", "kim", 2001, 0.2, day, "x"), (13, 1, "code", "lee", 2001, 7.0, day, "x")]
    (r,) = c.survivors(df, spark.createDataFrame(classes, CLASSES)).collect()
    assert (r.content_hash, r.path, r.size, r.category, r.owner, r.year, r.mtime) == (H[0], "/a/b/r.txt", 5, "image", "kim", 1999, day)
    empty = c.survivors(df.limit(0), spark.createDataFrame([], CLASSES))
    assert empty.count() == 0


def test_very_long_values(spark):
    long = "/a" * 4_000
    rows = [("x", f"{long}/{k}.txt", k) for k in range(4)] + [("x", long + "/b" * 3, 9), ("x", "", 10)]
    got = c.consensus(spark.createDataFrame(rows, "g string, v string, i long"), "g", "v", "i").first()
    assert got.closest_id in range(4) and got.consensus.startswith(long)
    p = c.aligned([("/a" * 3000, 2.0), ("/a" * 2990 + "/b/a", 1.0)])
    assert p.consensus() == "/a" * 3000
