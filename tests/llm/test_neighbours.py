import numpy as np
import pytest

from stackmill.llm import neighbours
from stackmill.llm.neighbours import nearest, pairs_of

SCHEMA = "point_id string, collection string, vector array<float>, cosine string, id string"


def brute(rows, k, least):
    out = {}
    for a, ca, va in rows:
        near = []
        for b, cb, vb in rows:
            if a != b and ca == cb:
                x, y = np.array(va, "f4").astype("f8"), np.array(vb, "f4").astype("f8")
                near.append((-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), b))
        out[a] = {b for c, b in sorted(near)[:k] if -c >= least}
    return out


def points(n, dim, seed, groups):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return [(f"p{i:05d}", "ab"[i % 2], (rng.uniform(0.3, 3) * (centres[rng.integers(groups)] + 0.25 * rng.standard_normal(dim))).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rows = points(400, 16, 1, 60)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + rows[:50]], SCHEMA)
    got = {}
    for r in nearest(df, k=5, least_cosine=0.85, dim=16, projections=16).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert got == {k: v for k, v in brute(rows, 5, 0.85).items() if v}


def test_routed_recall_and_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WHOLE", 300)
    monkeypatch.setattr(neighbours, "PER_DIRECTION", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 250)
    rows = [(i, "a", v) for i, _, v in points(1200, 16, 2, 200)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = {}
    for r in nearest(df, k=5, least_cosine=0.85, dim=16, projections=16).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    true = brute(rows, 5, 0.85)
    hit, all_ = sum(len(got.get(k, set()) & v) for k, v in true.items()), sum(map(len, true.values()))
    assert hit / all_ >= 0.95
    assert sum(map(len, got.values())) <= all_ + 0.05 * all_


def test_copies_get_their_own_neighbours(spark):
    v, w = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [(f"c{i}", "a", v, None, None) for i in range(9)] + [("z", "a", w, None, None)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), k=5, dim=3, projections=6).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert [n for _, n in sorted(got["c0"])] == ["c1", "c2", "c3", "c4", "c5"]
    assert [n for _, n in sorted(got["c8"])] == ["c0", "c1", "c2", "c3", "c4"]
    assert [n for _, n in sorted(got["z"])] == ["c0", "c1", "c2", "c3", "c4"]


def test_unusable_rows_and_empty_tables(spark):
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 0.001]), ("c", "x", None), ("d", "x", []), ("e", "x", [0.0, 0.0]), ("f", "x", [1.0, 0.0, 0.0]), (None, "x", [1.0, 0.0]), ("g", None, [1.0, 0.0]), ("h", None, [1.0, 0.002]),
            ("i", "x", [float("nan"), 1.0]), ("j", "x", [None, 1.0]), ("k", "y", [1.0, 0.0]), ("l", "x", [1e30, 1e27])]
    df = spark.createDataFrame([(*r, "q", "r") for r in rows], SCHEMA)
    got = {(r["point_lo"], r["point_hi"]) for r in pairs_of(nearest(df, dim=2, projections=4)).collect()}
    assert got == {("a", "b"), ("a", "l"), ("b", "l"), ("g", "h")}
    assert nearest(df.limit(0), dim=2, projections=4).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 8192, 8193, 10**6, 10**9])
def test_plan_grows_slowly(rows):
    first, second, keep = neighbours.plan_of(rows)
    assert 1 <= keep <= min(first * second, 24) and first + second <= max(2 * (rows / neighbours.PER_DIRECTION) ** 0.5 + 2, neighbours.FIRST_BASE + 64) * 1.5


def test_sums_of_two_bases_are_the_largest_projections():
    rng = np.random.default_rng(3)
    x, bases = rng.standard_normal((50, 16)), [neighbours.directions(24, 16, 1), neighbours.directions(10, 16, 2)]
    got = neighbours.routes(x, bases, 5)
    sums = ((x @ bases[0].T)[:, :, None] + (x @ bases[1].T)[:, None, :]).reshape(50, -1)
    assert (np.sort(np.argsort(-sums, axis=1)[:, :5], axis=1) == got).all()


def test_windows_of_sorted_arrays_count_collisions():
    rng = np.random.default_rng(4)
    h, rows = rng.standard_normal((9, 130)), np.arange(5, 70)
    inside = (np.abs(h[:, rows, None] - h[:, None, 10:]) <= 0.7).sum(axis=0)
    for least in (1, 4, 9):
        got = {(int(a), int(b)) for i, j in neighbours._collisions(h, rows, 0.7, least, 10, 130) for a, b in zip(i, j)}
        assert got == {(int(rows[a]), int(b) + 10) for a, b in zip(*np.nonzero(inside >= least))}
