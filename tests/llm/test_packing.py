import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.mixing import best_subset, fit_budget, mixture, mixture_checks
from cairn.llm.packing import batches, boundaries, fill_report, pack, packing_checks
from cairn.llm.tokens import encoding


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(h, k):
    lengths = np.array(sorted(h), np.int64)
    counts = np.array([h[x] for x in sorted(h)], np.int64)

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in h.items())

    got = boundaries(lengths, counts, k)
    assert len(got) <= max(k, 0) and got[-1] == lengths[-1]
    best = min(padding([*c, int(lengths[-1])]) for r in range(min(k, len(h))) for c in itertools.combinations(lengths.tolist(), r))
    assert padding(got.tolist()) == best


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=10))
def test_batches_place_every_rank_within_capacity(h):
    bounds = np.array(sorted(h))
    counts = np.array([h[x] for x in sorted(h)])
    plan, made = batches(bounds, counts, 50)
    held = np.zeros(made, int)
    for k in range(len(bounds)):
        own = sorted(p for p in plan if p[0] == k)
        for (_, lo, per, first), hi in zip(own, [p[1] for p in own[1:]] + [int(counts[k])]):
            for rank in range(lo, hi):
                held[first + (rank - lo) // per] += bounds[k]
    assert held.sum() == (bounds * counts).sum() and held.max() <= 50 and (held > 0).all()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 150))
def test_best_subset_equals_brute_force(h, budget):
    lengths, counts = np.array(sorted(h), np.int64), np.array([h[x] for x in sorted(h)], np.int64)
    take = best_subset(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {0}
    for x, n in h.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_budget_of_many_documents():
    r = np.random.default_rng(1)
    lengths = np.unique(r.integers(1, 30_000, 4000))
    counts = r.integers(1, 9, len(lengths))
    have = int((lengths * counts).sum())
    for budget, cap in ((have // 3, 1), (have * 2 + have // 7, 4), (have * 9, 4), (have, 1), (0, 3)):
        repeats, take = fit_budget(lengths, counts, budget, cap)
        assert repeats <= cap and (take <= counts).all() and (not take.any() or repeats < cap)
        got = repeats * have + int((take * lengths).sum())
        assert got == min(budget, cap * have)
    assert fit_budget(np.zeros(0, np.int64), np.zeros(0, np.int64), 10, 2)[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12).map(lambda x: 6 * x + 4), st.integers(1, 9), min_size=1, max_size=5), st.integers(1, 300), st.integers(4, 40))
def test_windows_widen_until_nothing_is_left(h, budget, window):
    lengths, counts = np.array(sorted(h), np.int64), np.array([h[x] for x in sorted(h)], np.int64)
    have = int((lengths * counts).sum())
    repeats, take = fit_budget(lengths, counts, budget, 3, window=window)
    sums = {0}
    for x, n in h.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    full = min(budget // have, 3)
    rest = 0 if full == 3 else max(s for s in sums if s <= budget - full * have)
    assert repeats == full and int((take * lengths).sum()) == rest and (take <= counts).all()


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma"], k=r.randint(1, 120))), r.choice(["a", "A ", "b-c", "b_c", "z", None]), i) for i in range(300)]
    rows += [(900, None, "a", 1), (901, "", "a", 1), (902, "word " * 40_000, "z", 1), (5, *rows[5][1:])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")


def test_pack_holds_every_token_once(spark, documents):
    kinds = spark.createDataFrame([("s", 16, 0), ("l", 100, 0)], "container string, capacity_tokens int, rank int")
    rows = pack(documents, kinds, buckets=12).collect()
    size = {(d.doc_id, d.text): len(encoding().encode_ordinary(d.text or "")) for d in documents.collect()}
    for name, c in (("s", 16), ("l", 100)):
        own = [r for r in rows if r.container == name]
        assert sum(r.tokens for r in own) == sum(size.values()) + size[next(k for k in size if k[0] == 5)]
        held = {}
        for r in own:
            if r.container_no is None:
                assert r.tokens == 0 and r.piece is None
                continue
            held.setdefault(r.container_no, []).append(r)
            assert r.tokens == c or r.piece == r.pieces
        for part in held.values():
            assert sum(r.tokens for r in part) + part[0].space_left == c and len({r.space_left for r in part}) == 1
        assert sorted(held) == list(range(len(held)))
    report = {r.container: r for r in fill_report(pack(documents, kinds, buckets=12)).collect()}
    assert report["l"].used_share > 0.9
    for r in packing_checks(pack(documents.where("doc_id != 5"), kinds, buckets=12)).collect():
        assert (r.n_documents, r.n_empty, r.split, r.incomplete, r.overfull, r.gaps) == (302, 2, 0, 0, 0, 0)
    broken = pack(documents.where("doc_id < 200 and doc_id != 5"), kinds).where("doc_id != 7")
    assert max(r.overfull for r in packing_checks(broken).collect()) > 0
    assert pack(documents.limit(0), kinds).count() == 0


def test_mixture(spark, documents):
    targets = spark.createDataFrame([("a", 0.05, 1), ("b_c", 0.12, 2), ("none", 0.05, 3), ("z", None, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(documents, targets)
    got, shares = mixed.collect(), {r.source: r for r in report.collect()}
    assert {r.source for r in got} <= {"a", "b_c"}
    total = sum(len(encoding().encode_ordinary(d.text or "")) for d in documents.collect())
    for s, part in (("a", 0.05), ("b_c", 0.12)):
        tokens = sum(r.copies * r.n_tokens for r in got if r.source == s)
        assert shares[s].tokens == tokens <= round(part * total)
        assert tokens == round(part * total) or shares[s].most_copies == shares[s].max_repeats
    for r in mixture_checks(mixed, report).collect():
        assert r.within_cap and r.totals_agree and r.within_budget and r.reached
    assert shares["none"].tokens == 0 and shares["z"].tokens == 0
    assert mixture(documents.limit(0), targets)[0].count() == 0
