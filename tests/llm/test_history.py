import random
import re
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from cairn.catalog import content
from cairn.llm import history

FILES = "id long, hash string, scanned_at timestamp_ntz, first string, n int"
EXCERPTS = "file_id long, excerpt string, id int"
H = [f"{i:064x}" for i in range(1, 200)]


def data(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(90)] + ["Ärger", "ÄRGER", "x1"]
    texts = [r.choices(vocabulary, k=r.randint(1, 30)) for _ in range(40)]
    files, excerpts = [], []
    for i in range(n):
        day = None if r.random() < 0.05 else datetime(2024, 1, 1) + timedelta(days=r.randint(0, 9), hours=r.randint(0, 23))
        h = r.choice([r.choice(H), H[0], H[0].upper(), f"sha256:{H[0]}", None, "METADATA_ONLY", H[1][:60]])
        files.append((i, h, day, "q", 1))
        if r.random() < 0.6:
            t = list(r.choice(texts))
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            excerpts.append((i, r.choice([" ".join(t), ", ".join(t).upper(), None, "", "…  !"] if r.random() < 0.2 else [" ".join(t)]), 0))
    excerpts += [(9999, "w1 w2", 0), (None, "w1 w2", 0)]
    return files + files[:20], excerpts + excerpts[:15]


def digits(h):
    if h is None:
        return None
    x = re.sub("[^0-9a-f]", "", re.sub(r"^[^:=]*[g-z][^:=]*[:=]", "", h.lower()))
    return x if len(x) == 64 else None


def brute(files, excerpts):
    day = {i: d.date() for i, _, d, *_ in files if d}
    cont = {i: digits(h) for i, h, *_ in files}
    sets: dict[int, list[set]] = {}
    for i, x, _ in excerpts:
        if x and i in day and (w := set(re.findall(r"[^\W_]+", x.lower()))):
            sets.setdefault(i, []).append(w)
    out = set()
    for i in day:
        for j in day:
            if day[j] < day[i]:
                same = cont[i] is not None and cont[i] == cont[j]
                if same or any(len(a & b) * 100 >= 60 * len(a | b) for a in sets.get(i, ()) for b in sets.get(j, ())):
                    out.add(i)
    return out


def frames(spark, files, excerpts):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(excerpts, EXCERPTS)


def test_known_ids_equal_brute_force(spark):
    for seed in (1, 2):
        files, excerpts = data(seed)
        f, x = frames(spark, files, excerpts)
        got = [r.id for r in history.known_ids(f, x).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(files, excerpts)
    assert history.known_ids(f.limit(0), x.limit(0)).count() == 0
    assert {r.id for r in history.known_ids(f, x.limit(0)).collect()} == brute(files, [])


def test_batch_after_batch_equals_one_pass(spark, tmp_path, monkeypatch):
    files, excerpts = data(3, 160)
    days = sorted({d.date() for _, _, d, *_ in files if d})[:6]
    files = [r for r in files if r[2] and r[2].date() in days]
    for small, to in ((history.SMALL, 4), (0, 6)):  # batches that are broadcast, and batches laid out by load
        monkeypatch.setattr(history, "SMALL", small)
        index = history.HistoryIndex(spark, f"file://{tmp_path}/index{small}", bucket_rows=32)
        got = set()
        for day in days[:to]:
            batch, x = frames(spark, [r for r in files if r[2].date() == day], excerpts)
            got |= {r.id for r in index.check(batch, x).collect()}
            index.append(batch, x)
        assert got == brute([r for r in files if r[2].date() in days[:to]], excerpts)
        assert len(index.segments()) < to  # merged
        index.remove()
    assert not list(tmp_path.iterdir())


def scanned(df):
    """Bytes of the files that a scan opens."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("filesSize").value() for i in range(leaves.size()))


def test_reads_follow_the_batch(spark, tmp_path):
    """The same batch against 1, 4 and 16 times the history reads nearly the same bytes."""
    r = random.Random(5)
    day, read = datetime(2024, 1, 1), {}
    text = lambda: " ".join(f"w{r.randrange(40_000)}" for _ in range(12))
    batch = [(10**6 + i, f"{r.getrandbits(256):064x}", day + timedelta(days=50), "q", 1) for i in range(4)]
    b, x = frames(spark, batch, [(i, text(), 0) for i, *_ in batch])
    for times in (1, 4, 16):
        n = 250 * times
        files = [(i, f"{r.getrandbits(256):064x}", day, "q", 1) for i in range(n)]
        index = history.HistoryIndex(spark, f"file://{tmp_path}/{times}", bucket_rows=64)
        index.append(*frames(spark, files, [(i, text(), 0) for i in range(n)]))
        rows, held, sets = index._entries(b, x)
        new = history.postings(sets.select("c1", "first", "ranked"))
        parts = [index.read("contents", rows, "content"), index.read("postings", new, "token"), index.read("sets", sets, "c1")]
        read[times] = sum(map(scanned, parts))
        whole = sum(f.stat().st_size for f in (tmp_path / str(times)).rglob("*.parquet"))
        print(times, read[times], whole)
    assert read[16] < 2 * read[1] and read[16] < whole / 3


def test_a_word_that_many_sets_hold(spark):
    """A hot word is cut: its meetings are spread over the tasks."""
    from cairn.operators.skew import plan_fragments

    sets = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("token"))
    plan = plan_fragments(sets, "token", tasks=8, power=2)
    assert len(dict(plan.split)[7]) == 8 and max(plan.load) < 2 * sum(plan.load) / 8


def test_content_forms(spark):
    forms = {H[5]: H[5], H[5].upper(): H[5], f" {H[5]}\n": H[5], f"SHA-256={H[5].upper()}": H[5], f"{H[5][:32]}-{H[5][32:]}": H[5], ":".join(H[5][i : i + 2] for i in range(0, 64, 2)): H[5], H[5][:63]: None, H[5][:16] + "...": None, "METADATA_ONLY": None, "": None, "ERROR": None, f"{H[5]}  file": H[5]}
    df = spark.createDataFrame([(k,) for k in forms], "hash string")
    assert {r[0]: r[1] for r in df.select("hash", content("hash")).collect()} == forms


def test_order_of_words(spark):
    counts = np.zeros(history.COUNTERS, np.int64)
    counts[3], counts[5] = 9, 1
    df = spark.createDataFrame([([3, 5, 7],), ([],), ([3],)], "w array<bigint>")
    assert [r[0] for r in df.select(history.by_rarity(spark, counts, "w")).collect()] == [[7, 5, 3], [], [3]]
