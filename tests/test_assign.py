import itertools
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.operators import assign
from driftloom.operators.assign import assign_sparse, cheapest_rows, solve, solve_points


def cheapest(c):
    n, m = c.shape
    if n > m:
        return cheapest(c.T)
    return min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_solve(n, m, r):
    c = np.array([[r.randrange(12) for _ in range(m)] for _ in range(n)], float)
    a, b = solve(c)
    assert len(a) == min(n, m) == len(set(a.tolist())) == len(set(b.tolist()))
    assert c[a, b].sum() == cheapest(c)


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 9)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_sparse_takes_as_many_as_possible_then_the_cheapest(pairs):
    pairs = list({(a, b): (a, b, c) for a, b, c in pairs}.values())
    src, dst, cost = (np.array([p[k] for p in pairs], float) for k in range(3))
    got = assign_sparse(src.astype(int), dst.astype(int), cost)
    best = (0, 0.0)
    for k in range(len(pairs) + 1):
        for chosen in itertools.combinations(range(len(pairs)), k):
            if len({src[i] for i in chosen}) == k == len({dst[i] for i in chosen}):
                best = min(best, (-k, sum(cost[i] for i in chosen)))
    assert (-len(got), cost[got].sum()) == best


def test_gate_before_and_after_differ():
    cost = np.array([[1.0, 7.0], [7.5, 9.0]])
    a, b = solve(cost)
    after = {(i, j) for i, j in zip(a, b) if cost[i, j] <= 8}
    i, j = np.nonzero(cost <= 8)
    before = {(i[k], j[k]) for k in assign_sparse(i, j, cost[i, j])}
    assert len(after) == 1 or after != before or len(before) == 2
    assert len(before) == 2


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 3), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_points_are_assigned_as_from_all_pairs(n, m, kind, r):
    # spread, far apart, with ties, all in one place
    place = lambda shift: [[r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9) + shift] if kind < 2 else [float(r.randrange(3) if kind == 2 else 1)] * 3 for _ in range(3)][0]
    a, b = (np.array([place(50 * (kind == 1) * side) for _ in range(k)]) for side, k in ((0, n), (1, m)))
    rows, columns = solve_points(a, b)
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert len(rows) == min(n, m) == len(set(rows.tolist())) == len(set(columns.tolist()))
    assert abs(cost[rows, columns].sum() - cost[solve(cost)].sum()) < 1e-9


def test_many_points_need_no_matrix():
    r = np.random.default_rng(0)
    a = r.random((6000, 3)) * [60, 600, 600]
    kept = r.permutation(6000)[:5600]
    b = np.concatenate([a[kept] + [0.2, 0.1, 0.1], r.random((500, 3)) * [60, 600, 600]])
    rows, columns = solve_points(a, b)
    assert len(rows) == 6000 == len(set(columns.tolist()))
    # prices prove it the cheapest: moving all partners around can't be better
    small = solve_points(a[:300], b[:320])
    cost = np.sqrt(((a[:300, None] - b[None, :320]) ** 2).sum(axis=2))
    assert abs(cost[small].sum() - cost[solve(cost)].sum()) < 1e-9


@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=4), st.lists(st.integers(-3, 6), min_size=4, max_size=4))
@settings(max_examples=100, deadline=None)
def test_rows_may_go_without(costs, skip):
    partner, row_price, column_price = cheapest_rows([[0, 1, 2]] * len(costs), [[float(c) for c in row] for row in costs], [float(s) for s in skip[: len(costs)]], 3)
    total = sum(costs[i][c] if c >= 0 else skip[i] for i, c in enumerate(partner))
    best = min(sum(costs[i][c] if c >= 0 else skip[i] for i, c in enumerate(p)) for p in itertools.product(range(-1, 3), repeat=len(costs)) if len(used := [c for c in p if c >= 0]) == len(set(used)))
    assert total == best
    assert all(costs[i][c] - row_price[i] - column_price[c] > -1e-9 for i in range(len(costs)) for c in range(3)) and max(column_price) <= 0


def test_large_components_need_no_matrix(monkeypatch):
    r = np.random.default_rng(1)
    i, j = np.unique(r.integers(0, 40, (500, 2)), axis=0).T
    cost = r.random(len(i)) * 8
    dense = assign_sparse(i, j, cost)
    monkeypatch.setattr(assign, "DENSE", 1)
    monkeypatch.setattr(assign, "solve", None)
    sparse = assign_sparse(i, j, cost)
    assert dense.tolist() == sparse.tolist()
    assert sorted(assign_sparse(j, i, cost).tolist()) == dense.tolist()


def test_pairs_of_a_crowd_are_held_in_arrays():
    # six places of 110 x 110 pairs, joined by single ones; lists of objects and wide numbers took 158 bytes a pair
    r, k = np.random.default_rng(2), 110
    i, j = (x.ravel() for x in np.meshgrid(np.arange(k), np.arange(k), indexing="ij"))
    src = np.concatenate([p * k + i for p in range(6)] + [np.arange(6) * k])
    dst = np.concatenate([p * k + j for p in range(6)] + [(np.arange(6) + 1) % 6 * k])
    cost = np.concatenate([r.random(6 * k * k) * 3, np.full(6, 7.0)])
    tracemalloc.start()
    got = assign_sparse(src, dst, cost)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * len(src)
    assert len(got) == 6 * k == len(set(src[got])) == len(set(dst[got]))
    dense = np.full((k, k), 0.0)
    dense[i, j] = cost[: k * k]
    own = got[got < k * k]
    assert len(own) == k and abs(cost[own].sum() - dense[solve(dense)].sum()) < 1e-9


def test_crowds_are_assigned_in_time():
    # copies of a few places: many pairs cost nearly the same, so near pairs alone and solving anew took minutes
    r = np.random.default_rng(3)
    places = r.random((12, 3)) * [100, 100, 100]
    crowd = lambda n, move: np.concatenate([(places + move)[r.integers(0, 12, n)] + r.integers(-1, 2, (n, 3)) * [0.4, 0.2, 0.2] + r.random((n, 1)) * 1e-3, r.random((n // 2, 3)) * 100])
    a, b = crowd(2200, 0.0), crowd(2220, 0.4)
    start = time.process_time()
    rows, columns = solve_points(a, b)
    assert time.process_time() - start < 30
    assert len(rows) == 3300 == len(set(columns.tolist()))
    # the same as from a matrix, where that is small enough
    few, others = a[2100:2300], b[2110:2340]
    cost = np.sqrt(((few[:, None] - others[None]) ** 2).sum(axis=2))
    assert abs(cost[solve_points(few, others)].sum() - cost[solve(cost)].sum()) < 1e-9
    assert abs(cost[solve_points(others, few)[::-1]].sum() - cost[solve(cost)].sum()) < 1e-9
