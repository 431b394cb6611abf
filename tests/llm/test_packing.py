import time

import numpy as np
import pytest

from stackmill.llm.packing import triples, packed, plan


@pytest.mark.parametrize("seed,capacity,mean", [(1, 512, 200), (2, 2048, 180), (3, 100, 60), (4, 64, 3)])
def test_plan_packs_everything_well(seed, capacity, mean):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.exponential(mean, 4000).astype(int), 1, capacity)
    histogram = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)]))
    held, used = {}, {}
    for x, a, b, first, m in plan(histogram, capacity):
        for rank in range(a, b):
            c = first + (rank - a) // m
            held[c] = held.get(c, 0) + x
            used[x, rank] = used.get((x, rank), 0) + 1
    assert max(held.values()) <= capacity and len(used) == 4000 and set(used.values()) == {1}
    assert {x: sum(k[0] == x for k in used) for x in histogram} == histogram
    assert len(held) == max(held) + 1
    assert sum(sizes) / len(held) / capacity > (0.97 if mean < capacity / 2 else 0.9)


def test_plan_ignores_how_many():
    a, b = plan({10: 3, 54: 3}, 64), plan({10: 3 * 10**9, 54: 3 * 10**9}, 64)
    assert max(len(a), len(b)) <= 8 and plan({}, 64) == []


def test_documents(spark):
    rows = [(1, "word " * 40, "x"), (2, "word " * 25, "x"), (3, None, "x"), (4, "", "x"), (5, "hello", "x"), (1, "word " * 40, "x"), (6, "word " * 3000, "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, profile string")
    limits = spark.createDataFrame([("s", 64), ("l", 1024), ("bad", None), ("zero", 0)], "profile string, capacity bigint")
    got = packed(docs, limits).collect()
    for profile, capacity in (("s", 64), ("l", 1024)):
        held, pieces = {}, {}
        for r in got:
            if r["profile"] == profile:
                held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
                pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        assert max(held.values()) <= capacity and set(pieces) == {1, 2, 5, 6}
        assert len(pieces[1]) == 1 and sorted(pieces[6])[-1][0] % capacity == 0
        at = 0
        for first, n in sorted(pieces[6]):
            assert first == at
            at += n
    assert {r["profile"] for r in got} == {"s", "l"}
    assert packed(docs.limit(0), limits).count() == 0 and packed(docs, limits.limit(0)).count() == 0


def test_patterns_are_bounded_whatever_the_capacity():
    lengths = np.arange(1, 100_001)
    began = time.time()
    pairs = list(triples(lengths, 131_072, 16_000))
    assert 1000 < len(pairs) <= 16_000 and time.time() - began < 5 and all(a <= b <= 131_072 - a - b for a, b in pairs)
    few = np.array([2, 3, 5, 7])
    assert set(triples(few, 15, 100)) == {(a, b) for a in few.tolist() for b in few.tolist() if a <= b <= 15 - a - b}
