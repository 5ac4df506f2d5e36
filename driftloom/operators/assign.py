"""Optimal one-to-one assignment, a group at a time.

Spark finds and deals the candidate pairs; a group (a pair of frames) is solved in its task.
Gated problems fall apart into the connected components of their gate graph,
so the dense solver sees a few points at a time.  Problems over all pairs of two frames are auctioned over lists of
near columns: prices prove which far pairs can't matter, and a list is made anew where they no longer do.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.plans.dealing import dealt

SENTINEL = 1e9

#: Cells of a matrix that a component is solved in at most; larger ones are solved over their pairs alone.
DENSE = 1 << 16


def solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest assignment of min(n, m) pairs, by shortest augmenting paths with potentials."""
    if cost.shape[0] > cost.shape[1]:
        columns, rows = solve(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    owner = np.full(m, -1)
    row_price, column_price = np.zeros(n), np.zeros(m)
    for start in range(n):
        shortest, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, column, reached = start, -1, 0.0
        visited = []
        while True:
            through = reached + cost[row] - row_price[row] - column_price
            better = ~done & (through < shortest)
            shortest[better], came[better] = through[better], row
            column = int(np.argmin(np.where(done, np.inf, shortest)))
            reached = shortest[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = int(owner[column])
            visited.append((row, column))
        row_price[start] += reached
        for r, c in visited:
            row_price[r] += reached - shortest[c]
            column_price[c] -= reached - shortest[c]
        while True:
            r = int(came[column])
            before = np.flatnonzero(owner == r)
            owner[column] = r
            if r == start:
                break
            column = int(before[before != column][0])
    columns = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[columns])
    return owner[columns][order], columns[order]


def _numbered(ids: np.ndarray) -> np.ndarray:
    """The places of ``ids`` in their order, in four bytes each."""
    return np.searchsorted(np.unique(ids), ids).astype(np.int32)


def assign_sparse(src: np.ndarray, dst: np.ndarray, cost: np.ndarray, sentinel: float = SENTINEL) -> np.ndarray:
    """Indices of the chosen ones among the pairs (src, dst): as many as possible, then the cheapest."""
    if not len(src):
        return np.zeros(0, dtype=np.int64)
    a, b = _numbered(src), _numbered(dst)
    b += a.max() + 1
    label = np.arange(b.max() + 1, dtype=np.int32)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    del low
    chosen = []
    part = label[a]
    if (part == part[0]).all():
        order = np.arange(len(a))
    else:
        order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(own) == 1:
            chosen.append(own)
            continue
        i, j = _numbered(a[own]), _numbered(b[own])
        if (int(i.max()) + 1) * (int(j.max()) + 1) > DENSE:
            chosen.append(own[_cheapest_pairs(i, j, cost[own])])
            continue
        dense = np.full((i.max() + 1, j.max() + 1), sentinel)
        index = np.full(dense.shape, -1)
        dense[i, j], index[i, j] = cost[own], own
        r, c = solve(dense)
        fit = index[r, c]
        chosen.append(fit[fit >= 0])
    return np.sort(np.concatenate(chosen))


def cheapest_rows(columns: Sequence[Sequence[int]], costs: Sequence[Sequence[float]], skip: Sequence[float], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(partner of each row or -1, row prices, column prices) of a cheapest matching of rows with ``m`` columns.

    Row i may take one of ``columns[i]`` at its cost, or none at the price ``skip[i]``.  Shortest augmenting paths over the given
    pairs only, so memory follows the pairs.  For every pair cost - row price - column price is 0 or more, and 0 where it is chosen; free
    columns have the price 0 and all others 0 or less.
    """
    n = len(columns)
    owner, partner = array("q", [-1]) * m, array("q", [-1]) * n
    row_price, column_price = array("d", [0.0]) * n, array("d", [0.0]) * m
    for start in range(n):
        # the price at which the row's cheapest option is free of charge
        base = skip[start]
        for c, cost in zip(columns[start], costs[start], strict=True):
            base = min(base, cost - column_price[c])
        row_price[start] = base
        reached: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, through = start, 0.0
        idle, idler = np.inf, -1  # the cheapest way that ends at a row without a partner
        while True:
            price = row_price[row]
            if through + skip[row] - price < idle:
                idle, idler = through + skip[row] - price, row
            for c, cost in zip(columns[row], costs[row], strict=True):
                d = through + (cost - price - column_price[c])
                if d < idle and c not in done and d < reached.get(c, np.inf):
                    reached[c], came[c] = d, row
                    heapq.heappush(heap, (d, c))
            while heap and (heap[0][0] > reached[heap[0][1]] or heap[0][1] in done):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= idle:
                length, column = idle, -1
                break
            length, column = heapq.heappop(heap)
            if owner[column] < 0:
                break
            done.add(column)
            row, through = owner[column], length
        for c in done:
            more = length - reached[c]
            row_price[owner[c]] += more
            column_price[c] -= more
        row_price[start] += length
        # pairs along the way change sides
        row = idler if column < 0 else came[column]
        free = partner[row]
        partner[row] = column
        if column >= 0:
            owner[column] = row
        while row != start:
            column, row = free, came[free]
            free = partner[row]
            partner[row], owner[column] = column, row
    return np.array(partner, dtype=np.int64), np.array(row_price), np.array(column_price)


class _Runs:
    """Lists that follow each other in one array, as objects take many times as much."""

    def __init__(self, starts: np.ndarray, values: np.ndarray):
        self.starts, self.values = array("q"), array(values.dtype.char)
        self.starts.frombytes(starts.astype(np.int64).view(np.uint8))
        self.values.frombytes(values.view(np.uint8))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, row: int) -> array:
        return self.values[self.starts[row] : self.starts[row + 1]]


def _cheapest_pairs(i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indices of the chosen ones among the pairs (i, j), numbered from 0: as many as possible, then the cheapest.  Memory follows the pairs."""
    if i.max() > j.max():
        i, j = j, i
    n = int(i.max()) + 1
    order = np.lexsort((j, i))
    starts = np.searchsorted(i[order], np.arange(n + 1))
    columns, costs = (_Runs(starts, v[order]) for v in (j, cost.astype(np.float64, copy=False)))
    # dearer than what any other choice of pairs could save
    skip = 2 * (n + 1) * float(np.abs(cost).max()) + 1
    partner, _, _ = cheapest_rows(columns, costs, [skip] * n, int(j.max()) + 1)
    return order[partner[i[order]] == j[order]]


#: Columns that a row's list has at most, and all lists of a problem together; rows of a block of distances.
LISTED, ENTRIES, ROWS = 384, 1 << 24, 64

#: Rows that bid at once; as many or fewer bid one by one.  Part of a round's least step that the next one has.
BIDDERS, FEW, FINER = 256, 6, 0.2


class _Lists:
    """For each of the points ``a`` the columns ``b`` that are cheapest by distance and price, and the sum ``limit`` that no other column is under.

    Prices only rise, so the limit holds until a list is made anew.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.most = a, b, max(2, min(len(b), LISTED, ENTRIES // len(a)))
        self.low, extent = b.min(axis=0), np.maximum(np.ptp(b, axis=0), 1e-9)
        self.width = max(float(np.prod(extent) * 8 / len(b)) ** (1 / 3), float(extent.max()) / 64)
        self.side = self._cells(b).max(axis=0) + 1
        key = self._key(self._cells(b))
        self.order = np.argsort(key, kind="stable")
        self.starts, self.sorted = np.searchsorted(key[self.order], np.arange(int(np.prod(self.side)) + 1)), b[self.order]
        self.home = self._key(np.clip(self._cells(a), 0, self.side - 1))
        self.columns, self.cost = np.zeros((len(a), self.most), np.intp), np.full((len(a), self.most), np.inf)
        # how far a row looks: at first to where an even spread would have a few columns
        self.limit, self.reach = np.full(len(a), -np.inf), np.full(len(a), float(np.prod(extent) * 8 / len(b)) ** (1 / 3))

    def _cells(self, p: np.ndarray) -> np.ndarray:
        return np.floor((p - self.low) / self.width).astype(np.int64)

    def _key(self, cells: np.ndarray) -> np.ndarray:
        return (cells[:, 0] * self.side[1] + cells[:, 1]) * self.side[2] + cells[:, 2]

    def _box(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places in the order of cells of the columns of the box, and some around it."""
        first, last = (np.clip(self._cells(p), 0, self.side - 1).tolist() for p in (low, high))
        runs = []
        for z in range(first[0], last[0] + 1):
            for y in range(first[1], last[1] + 1):
                row = (z * self.side[1] + y) * self.side[2]
                runs.append(np.arange(self.starts[row + first[2]], self.starts[row + last[2] + 1]))
        return np.concatenate(runs)

    def renew(self, rows: np.ndarray, price: np.ndarray) -> None:
        """Lists of ``rows`` at the prices of now."""
        least, sorted_price = price.min(), price[self.order]
        while len(rows):
            rows, again = rows[np.lexsort((self.reach[rows], self.home[rows]))], []
            cuts = [0, *(np.flatnonzero(np.diff(self.home[rows])) + 1).tolist(), len(rows)]
            for k, end in [(k, min(k + ROWS, high)) for low, high in zip(cuts[:-1], cuts[1:], strict=True) for k in range(low, high, ROWS)]:
                own = rows[k:end]
                reach, at = self.reach[own].max(), self.a[own]
                found = self._box(at.min(axis=0) - reach, at.max(axis=0) + reach)
                whole = len(found) == len(self.b)
                if not whole and len(found) < 2:
                    self.reach[own] *= 2
                    again.append(own)
                    continue
                d = np.zeros((len(own), len(found)))
                for c in range(3):
                    move = at[:, c, None] - self.sorted[None, found, c]
                    d += np.multiply(move, move, out=move)
                total = np.sqrt(d, out=d) + sorted_price[found]
                # what lies further than a row looks costs as much at least
                limit = np.full(len(own), np.inf if whole else reach + least)
                if len(found) > self.most:
                    some = np.argpartition(total, self.most, axis=1)
                    limit = np.minimum(limit, np.take_along_axis(total, some[:, self.most, None], axis=1)[:, 0])
                    some = some[:, : self.most]
                else:
                    some = np.broadcast_to(np.arange(len(found)), d.shape)
                cheapest = np.take_along_axis(total, some, axis=1).min(axis=1)
                seen = cheapest <= limit
                self.reach[own[~seen]] = np.maximum(1.5 * self.reach[own[~seen]], 1.1 * (cheapest[~seen] - least))
                again.append(own[~seen])
                own, some, n = own[seen], some[seen], some.shape[1]
                self.columns[own, :n], self.cost[own, :n], self.cost[own, n:] = self.order[found[some]], np.take_along_axis(d[seen], some, axis=1), np.inf
                self.limit[own] = limit[seen]
            rows = np.concatenate(again)

    def blind(self, rows: np.ndarray, sums: np.ndarray, least: float) -> None:
        """Rows whose list may lack their cheapest column look further when it is made anew."""
        self.reach[rows] = 1.5 * (sums - least) + 1e-12


def solve_points(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest assignment of min(n, m) points by their distances, without a matrix of all pairs.

    An auction: a row without a column takes the one that is cheapest by distance and price and raises its price to where the row's
    second choice costs the same, and a least step more.  Who held it bids anew.  The step falls from round to round, and what a finer step
    allows is kept.  In the end no row would save more than the last step by another column, so the sum is at most n times 2^-44 of the extent over
    the least one.  Rows look at lists of near columns, and a list is made anew where another column may be cheaper, so no pair is left
    out.  As many columns as stay free are held by nobody's rows, which always take the lowest prices.
    """
    if len(a) > len(b):
        columns, rows = solve_points(b, a)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = len(a), len(b)
    if n == 0 or m == 1:
        return np.arange(n), np.zeros(n, np.int64)
    extent = np.maximum(np.ptp(np.concatenate([a, b]), axis=0), 1e-9)
    last = float(np.sqrt((extent**2).sum())) * 2.0**-44
    step = max(float(np.prod(extent) * 8 / m) ** (1 / 3) / 4, last)
    price, partner, owner = np.zeros(m), np.full(n, -1), np.full(m, -1)  # the owner -2 is nobody's row, -1 none
    lists = _Lists(a, b)
    lists.renew(np.arange(n), price)
    columns, cost, limit, sums = lists.columns, lists.cost, lists.limit, np.empty(lists.most)
    mixed = np.random.default_rng(0)
    while True:
        has = np.flatnonzero(partner >= 0)
        for own in np.split(has, range(4096, len(has), 4096)):
            now = np.sqrt(((a[own] - b[partner[own]]) ** 2).sum(axis=1)) + price[partner[own]]
            lost = own[now > np.minimum((cost[own] + price[columns[own]]).min(axis=1), limit[own]) + step]
            owner[partner[lost]], partner[lost] = -1, -1
        nobodys = np.flatnonzero(owner == -2)
        if len(nobodys):
            owner[nobodys[price[nobodys] > price[owner != -2].min() + step]] = -1
        idle = m - n - np.count_nonzero(owner == -2)
        # rows of a crowd want the same column, so few of it should bid at once
        active, blind = mixed.permutation(np.flatnonzero(partner < 0)), []
        while True:
            if idle:
                others = np.flatnonzero(owner != -2)
                some = np.argpartition(price[others], idle)
                took, next_ = others[some[:idle]], price[others[some[idle]]]
                lost = owner[took]
                price[took[lost >= 0]] = next_ + step
                partner[lost[lost >= 0]] = -1
                owner[took], idle = -2, 0
                active = np.concatenate([active, lost[lost >= 0]])
            if not len(active):
                if not blind:
                    break
                active, blind = np.concatenate(blind), []
                lists.renew(active, price)
            if len(active) <= FEW:
                stack = active.tolist()
                while stack and not idle:
                    i = stack.pop()
                    own = columns[i]
                    price.take(own, out=sums, mode="clip")
                    np.add(sums, cost[i], out=sums)
                    k = int(sums.argmin())
                    first, second = sums[k], limit[i]
                    if first > second:
                        lists.blind(np.array([i]), first, price.min())
                        blind.append(np.array([i]))
                        continue
                    sums[k] = np.inf
                    second = min(second, sums[sums.argmin()])
                    j = own[k]
                    price[j] += second - first + step
                    before, owner[j], partner[i] = int(owner[j]), i, j
                    if before >= 0:
                        partner[before] = -1
                        stack.append(before)
                    idle += before == -2
                active = np.array(stack, dtype=np.int64)
                continue
            active, later = active[:BIDDERS], active[BIDDERS:]
            totals = price[columns[active]] + cost[active]
            k = totals.argmin(axis=1)
            first = totals[np.arange(len(active)), k]
            totals[np.arange(len(active)), k] = np.inf
            sees = first <= limit[active]
            if not sees.all():
                lists.blind(active[~sees], first[~sees], price.min())
                blind.append(active[~sees])
                active, first, totals, k = active[sees], first[sees], totals[sees], k[sees]
            j = columns[active, k]
            bid = price[j] + (np.minimum(totals.min(axis=1), limit[active]) - first) + step
            order = np.lexsort((bid, j))
            wins = order[np.flatnonzero(np.diff(j[order], append=-1))]
            before = owner[j[wins]]
            price[j[wins]], owner[j[wins]], partner[active[wins]] = bid[wins], active[wins], j[wins]
            idle += np.count_nonzero(before == -2)
            partner[before[before >= 0]] = -1
            active = np.concatenate([later, np.delete(active, wins), before[before >= 0]])
        if step == last:
            return np.arange(n), partner
        step = max(step * FINER, last)


def assign_candidates(candidates: DataFrame, by: list[str], src: str, dst: str, cost: str, sentinel: float = SENTINEL) -> DataFrame:
    """The rows (by..., src, dst, cost) of ``candidates`` that an optimal assignment within each group picks; at most one row a pair."""
    own = candidates.select(*by, F.col(src).cast("long").alias(src), F.col(dst).cast("long").alias(dst), F.col(cost).cast("double").alias(cost))

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column(dst).to_numpy(), table.column(src).to_numpy()))
        return table.take(pa.array(order[assign_sparse(*(table.column(c).to_numpy()[order] for c in (src, dst, cost)), sentinel)]))

    return own.groupBy(*by).applyInArrow(run, own.schema)


def assign_frames(left: DataFrame, right: DataFrame, by: list[str], voxel: tuple[float, float, float], gate: float) -> DataFrame:
    """(by..., source_id, target_id, dist): per group a cheapest assignment over *all* pairs, of which those within ``gate`` stay.

    ``left`` and ``right`` have (by..., id, z, y, x).  The gate comes after the assignment, so that
    a far pair may take the place of two near ones, and no pair can be left out beforehand.  A task holds one pair of frames
    and a list of the cheapest columns by distance and price for each row; there is no matrix of all pairs.
    """
    rows = left.select(*by, F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "zyx"], F.lit(True).alias("first"))
    rows = rows.unionByName(right.select(*by, F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "zyx"], F.lit(False).alias("first")))
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by) + ", source_id long, target_id long, dist double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "descending"), ("id", "ascending")])
        first = table.column("first").to_numpy()
        ids = table.column("id").to_numpy()
        points = np.stack([table.column(c).to_numpy() * s for c, s in zip("zyx", voxel, strict=True)], axis=1)
        a, b = points[first], points[~first]
        keys = {c: table.column(c).slice(0, 1).combine_chunks() for c in by}
        if len(a) and len(b):
            r, c = solve_points(a, b)
            d = np.sqrt(((a[r] - b[c]) ** 2).sum(axis=1))
            r, c, d = (v[d <= gate] for v in (r, c, d))
        else:
            r, c, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        out = [keys[k].take(pa.array(np.zeros(len(r), int))) for k in by]
        return pa.table([*out, pa.array(ids[first][r]), pa.array(ids[~first][c]), pa.array(d)], names=[*by, "source_id", "target_id", "dist"])

    return dealt(rows, by, left).groupBy(*by).applyInArrow(run, schema)
