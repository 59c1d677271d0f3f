"""Per-photo numpy kernels for what no relational expression gives: transport, hulls, run lengths, clusters."""

from __future__ import annotations

import numpy as np


def components(clusters: np.ndarray) -> np.ndarray:
    """4-neighbour components of equal values; a component's label is the smallest column-major place (from 1) in it."""
    h, w = clusters.shape
    place = np.arange(h * w).reshape(w, h).T
    down, right = clusters[1:] == clusters[:-1], clusters[:, 1:] == clusters[:, :-1]
    a = np.concatenate([place[:-1][down], place[:, :-1][right]])
    b = np.concatenate([place[1:][down], place[:, 1:][right]])
    return joined(h * w, a, b)[place] + 1


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the edges (a, b)."""
    parent = np.arange(n)
    while len(a):
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low < high
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


class Basis:
    """A spanning tree of sources and sinks (source i is node i, sink j node m + j) with its flows and potentials.

    The masses are made uneven by less than one part, so that every flow of the tree stays above 0 and no exchange is idle.
    """

    def __init__(self, supply: list[int], demand: list[int], costs: np.ndarray) -> None:
        self.m, self.costs = len(supply), costs
        self.part = 2 * self.m + 1
        left = [x * self.part + 1 for x in supply] + [x * self.part for x in demand]
        left[-1] += self.m
        self.near: list[dict[int, int]] = [{} for _ in left]  # flows of the tree's arcs, by both of their ends
        rows, cols = self.m, len(left) - self.m
        for cell in np.argsort(costs, axis=None, kind="stable").tolist():  # cheapest arcs first; each uses up one end
            i, j = divmod(cell, len(demand))
            j += self.m
            if left[i] and left[j]:
                x = min(left[i], left[j])
                left[i] -= x
                left[j] -= x
                self.near[i][j] = self.near[j][i] = x
                rows, cols = rows - (not left[i]), cols - (not left[j])
                if not rows + cols:
                    break
        self.up, self.depth = [-1] * len(left), [0] * len(left)
        self.potential = np.zeros(len(left))
        for node in self._below(0, -1):
            if (p := self.up[node]) >= 0:
                i, j = (node, p - self.m) if node < self.m else (p, node - self.m)
                self.potential[node] = costs[i, j] - self.potential[p]

    def _below(self, top: int, parent: int) -> list[int]:
        """The nodes of a subtree, each after its parent; hangs it under ``parent``."""
        self.up[top], self.depth[top] = parent, self.depth[parent] + 1 if parent >= 0 else 0
        out = [top]
        for node in out:
            for x in self.near[node]:
                if x != self.up[node]:
                    self.up[x], self.depth[x] = node, self.depth[node] + 1
                    out.append(x)
        return out

    def exchange(self, i: int, j: int, gain: float) -> None:
        """Take the arc from source i to sink j, of negative reduced cost, into the tree, and the first to run dry out of it."""
        x, y, ahead, behind = j + self.m, i, [], []  # arcs on the way from the sink, and from the source, to where they meet
        while x != y:
            if self.depth[x] >= self.depth[y]:
                ahead.append((x, self.up[x]))
                x = self.up[x]
            else:
                behind.append((self.up[y], y))
                y = self.up[y]
        way = ahead + behind[::-1]  # from the sink to the source: arcs of even place lose what the new arc gains
        lose = way[0::2]
        amount, out = min((self.near[a][b], k) for k, (a, b) in enumerate(lose))
        for k, (a, b) in enumerate(way):
            self.near[a][b] = self.near[b][a] = self.near[a][b] + (amount if k % 2 else -amount)
        a, b = lose[out]
        del self.near[a][b], self.near[b][a]
        i, j = i, j + self.m
        self.near[i][j] = self.near[j][i] = amount
        inner, outer = (j, i) if 2 * out < len(ahead) else (i, j)  # the end that the lost arc cut off from the root
        moved = self._below(inner, outer)
        # every arc of the moved part keeps its balance: sources move one way, sinks the other
        step = gain if inner < self.m else -gain
        moved = np.array(moved)
        own = moved < self.m
        self.potential[moved[own]] += step
        self.potential[moved[~own]] -= step

    def flows(self) -> np.ndarray:
        out = np.zeros(self.costs.shape, dtype=np.int64)
        for i in range(self.m):
            for j, x in self.near[i].items():
                out[i, j - self.m] = (x + self.m) // self.part
        return out


def transport(supply: np.ndarray, demand: np.ndarray, costs: np.ndarray) -> tuple[float, np.ndarray]:
    """Least cost of moving integer masses, and the flows: exchanges of arcs of a spanning tree until none gains."""
    if supply.sum() != demand.sum():
        raise ValueError("the masses differ")
    flow, some, want = np.zeros(costs.shape, dtype=np.int64), np.flatnonzero(supply), np.flatnonzero(demand)
    if len(some):
        own = np.ascontiguousarray(costs[np.ix_(some, want)], dtype=np.float64)
        tree, least = Basis(supply[some].astype(np.int64).tolist(), demand[want].astype(np.int64).tolist(), own), -1e-11 * max(1.0, float(own.max()))
        while True:
            reduced = own - tree.potential[: tree.m, None] - tree.potential[None, tree.m :]
            i, j = divmod(int(reduced.argmin()), len(want))
            if reduced[i, j] >= least:
                break
            tree.exchange(i, j, float(reduced[i, j]))
        flow[np.ix_(some, want)] = tree.flows()
    return float((flow * costs).sum()), flow


def _priced(supply: np.ndarray, demand: np.ndarray, costs: np.ndarray, sweeps: int) -> np.ndarray:
    """Prices (problems x sinks) at which sinks are sought by about what they hold: each in turn takes the sources nearest to it until it is full."""
    price = np.zeros(demand.shape)
    for _ in range(sweeps):
        for j in range(costs.shape[1]):
            price[:, j] = -np.inf
            t = costs[:, j] - (costs - price[:, None]).min(axis=2)
            order = np.argsort(t, axis=1)
            full = np.take_along_axis(supply, order, axis=1).cumsum(axis=1) >= demand[:, j, None]
            price[:, j] = np.take_along_axis(t, np.take_along_axis(order, full.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
    return price


def transport_few(supply: np.ndarray, demand: np.ndarray, costs: np.ndarray, sweeps: int = 4) -> np.ndarray:
    """Least costs of many problems (rows of integer ``supply`` and ``demand``) with the same ``costs`` and few sinks, all at once.

    Every source goes to the sink of its least cost at the sinks' prices, which no cycle of moves makes cheaper; what sinks have
    too much then goes by shortest ways between sinks (at most as many steps) to those that have too little.
    """
    if (supply.sum(axis=1) != demand.sum(axis=1)).any():
        raise ValueError("the masses differ")
    (m, k), least = costs.shape, 1e-12 * max(1.0, float(np.abs(costs).max()))
    if k == 1:
        return (supply * costs[:, 0]).sum(axis=1, dtype=np.float64)
    to = (costs - _priced(supply, demand, costs, sweeps)[:, None]).argmin(axis=2)
    flow = np.where(to[:, :, None] == np.arange(k), supply[:, :, None], 0)
    dearer = costs[:, None, :] - costs[:, :, None]  # of a source, from sink a to sink b
    order = np.argsort(dearer, axis=0, kind="stable").transpose(1, 2, 0)
    each = np.arange(k)[:, None, None]
    active = np.arange(len(supply))
    while True:
        over = flow[active].sum(axis=1) - demand[active]
        left = over.any(axis=1)
        active, over = active[left], over[left]
        if not len(active):
            break
        held = (flow[active] > 0).transpose(0, 2, 1)[:, each, order]  # problem, a, b, sources from the cheapest move
        first = held.argmax(axis=3)
        some = np.take_along_axis(held, first[..., None], axis=3)[..., 0]
        first = order[np.arange(k)[:, None], np.arange(k), first]
        step = np.where(some & ~np.eye(k, dtype=bool), dearer[first, np.arange(k)[:, None], np.arange(k)], np.inf)
        way, before = np.where(over > 0, 0.0, np.inf), np.full(over.shape, -1)
        for _ in range(k - 1):
            through = way[:, :, None] + step
            best = through.argmin(axis=1)
            found = np.take_along_axis(through, best[:, None], axis=1)[:, 0]
            nearer = found < way - least
            if not nearer.any():
                break
            way, before = np.where(nearer, found, way), np.where(nearer, best, before)
        rows = np.arange(len(active))
        end = np.where(over < 0, way, np.inf).argmin(axis=1)
        at, amount, path = end, -over[rows, end], []
        for _ in range(k - 1):
            a = before[rows, at]
            on = a >= 0
            source = first[rows, a, at]
            path.append((active[on], source[on], a[on], at[on], on))
            amount = np.where(on, np.minimum(amount, flow[active, source, a]), amount)
            at = np.where(on, a, at)
        amount = np.minimum(amount, over[rows, at])
        if (amount <= 0).any():
            raise ArithmeticError("no way from a sink that has too much to one that has too little")
        for p, i, a, b, on in path:
            flow[p, i, a] -= amount[on]
            flow[p, i, b] += amount[on]
    return (flow * costs).sum(axis=(1, 2))


def hull_corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull of (x, y) pairs, clockwise, without collinear ones."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[tuple[float, float]] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) >= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return chain(p) + chain(p[::-1])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """``hull_corners`` of (x, y) rows."""
    return np.array(hull_corners([tuple(p) for p in points.tolist()]), dtype=points.dtype)


def inside_hull(px: np.ndarray, py: np.ndarray, hull: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    if len(hull) == 1:
        return (np.abs(px - hull[0, 0]) < eps) & (np.abs(py - hull[0, 1]) < eps)
    if len(hull) == 2:
        (ax, ay), (bx, by) = hull
        t = np.clip(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        return np.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)) < eps
    inside = np.ones(len(px), dtype=bool)
    for (ax, ay), (bx, by) in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        inside &= (bx - ax) * (py - ay) - (by - ay) * (px - ax) <= eps
    return inside


def shape_convexity(labels: np.ndarray, least: float = 1 / 200, coverage: float = 0.8) -> float:
    """Share of the photo in components of at least ``least`` of it that fill ``coverage`` of their hulls."""
    h, w = labels.shape
    total = 0
    ids, counts = np.unique(labels, return_counts=True)
    for i in ids[counts >= h * w * least]:
        y, x = np.nonzero(labels == i)
        hull = convex_hull(np.stack([x, -y], axis=1))
        gy, gx = np.mgrid[y.min() : y.max() + 1, x.min() : x.max() + 1]
        if len(x) / inside_hull(gx.ravel(), -gy.ravel(), hull).sum() >= coverage:
            total += len(x)
    return total / (h * w)


def squares_from(m: np.ndarray) -> np.ndarray:
    """Width of the largest square of equal values that each cell is the first corner of: four squares of a width make one of the next."""
    out = np.ones(m.shape, dtype=np.int64)
    whole = (m[:-1, :-1] == m[1:, :-1]) & (m[:-1, :-1] == m[:-1, 1:]) & (m[:-1, :-1] == m[1:, 1:])
    while whole.any():
        out[: whole.shape[0], : whole.shape[1]] += whole
        whole = whole[:-1, :-1] & whole[1:, :-1] & whole[:-1, 1:] & whole[1:, 1:]
    return out


def rle2d(m: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, width, largest possible width) of greedy squares of equal values, column by column over the cells not yet covered."""
    h, w = m.shape
    widths, values = squares_from(m).T.ravel().tolist(), m.T.ravel().tolist()
    done, out = bytearray(h * w), []
    at = done.find(0)
    while at >= 0:
        k = widths[at]
        c, r = divmod(at, h)
        out.append((int(values[at]), k, min(h - r, w - c)))
        for i in range(at, at + k * h, h):
            done[i : i + k] = b"\1" * k
        at = done.find(0, at + k)
    return out


def inverse_rle2d(h: int, w: int, code: list[tuple[int, int, int]]) -> np.ndarray:
    out, done, items = np.zeros((h, w), dtype=np.int64), np.zeros((h, w), dtype=bool), iter(code)
    for c in range(w):
        for r in range(h):
            if not done[r, c]:
                v, k, _ = next(items)
                out[r : r + k, c : c + k] = v
                done[r : r + k, c : c + k] = True
    return out


def elias_delta(n: int) -> int:
    b = n.bit_length() - 1
    return b + 2 * ((b + 1).bit_length() - 1) + 1


def mdl_rle2d(m: np.ndarray, k: int) -> tuple[float, float, float, float]:
    """Bits of the dimensions, the number of squares of ``rle2d``, their values and their widths.

    Only squares wider than one cell cover others, so only these are gone through.
    """
    h, w = m.shape
    widths, done, starts = squares_from(m).T.ravel(), bytearray(h * w), []
    wide = np.flatnonzero(widths > 1)
    for at, k_ in zip(wide.tolist(), widths[wide].tolist(), strict=True):
        if not done[at]:
            starts.append(at)
            for i in range(at, at + k_ * h, h):
                done[i : i + k_] = b"\1" * k_
    first = (widths == 1) & (np.frombuffer(done, dtype=np.uint8) == 0)
    first[starts] = True
    c, r = np.divmod(np.flatnonzero(first), h)
    return elias_delta(h) + elias_delta(w), float(np.log2(len(c))), len(c) * float(np.log2(k)) if k > 1 else 0.0, float(np.log2(np.minimum(h - r, w - c)).sum())


def seeded(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds of the rows of x; fewer where the rows are covered before."""
    columns, picks = np.ascontiguousarray(x.T), [int(rng.integers(len(x)))]

    def to(i: int) -> np.ndarray:
        out = np.zeros(len(x))
        for c in columns:
            diff = c - c[i]
            diff *= diff
            out += diff
        return out

    near = to(picks[0])
    while len(picks) < k and (sums := near.cumsum())[-1] > 0:
        picks.append(min(len(x) - 1, int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))))
        np.minimum(near, to(picks[-1]), out=near)
    return x[picks]


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centre, a column at a time."""
    out = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        diff = x[:, d, None] - centres[None, :, d]
        diff *= diff
        out += diff
    return out


def nearest(x: np.ndarray, lifted: np.ndarray, centres: np.ndarray, within: float) -> np.ndarray:
    """Number of the nearest centre of each row, the first of equal ones, exactly as by ``squares``.

    A product with ``lifted`` (the rows and a column of ones) orders the centres but for rounding, so rows for which another
    centre lies ``within`` the nearest one's reach are done by ``squares``.
    """
    if len(centres) == 1:
        return np.zeros(len(x), dtype=np.int64)
    far = lifted @ np.concatenate([-2 * centres.T, (centres * centres).sum(axis=1)[None]])
    of = far.argmin(axis=1)
    close = far <= (far.ravel()[of + np.arange(0, far.size, len(centres))] + within)[:, None]
    if np.count_nonzero(close) > len(x):
        some = np.flatnonzero(np.count_nonzero(close, axis=1) > 1)
        of[some] = squares(x[some], centres).argmin(axis=1)
    return of


#: Distances that are seeded at once; pixels, and centres of several runs, whose distances are taken at once; pixels of runs that share a step.
SEEDED, BLOCK, CENTRES, SHARED = 100_000, 2048, 256, 1_000_000
#: What stands for a centre that a run doesn't have.
FAR = np.array([0.0, 0.0, 0.0, 1e38])


def seedings(x: np.ndarray, ks: list[int], restarts: int, stream) -> dict[int, list[np.ndarray]]:
    """The seeds of ``restarts`` runs of each number of clusters, as ``seeded`` draws them from ``stream(k)``; many runs share a step."""
    n, columns, ks = len(x), np.ascontiguousarray(x.T), sorted(ks, reverse=True)
    sizes, draws, picks = np.repeat(ks, restarts), np.zeros((len(ks) * restarts, ks[0])), np.zeros((len(ks) * restarts, ks[0]), dtype=np.int64)
    for i, k in enumerate(ks):
        rng = stream(k)
        for j in range(i * restarts, (i + 1) * restarts):
            picks[j, 0], draws[j, 1:k] = rng.integers(n), rng.random(k - 1)

    def to(some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), n))
        for c in columns:
            diff = c - c[some][:, None]
            diff *= diff
            out += diff
        return out

    covered: set[int] = set()
    for at in range(0, len(sizes), each := max(1, SEEDED // n)):
        size, pick, draw = (v[at : at + each] for v in (sizes, picks, draws))
        near = to(pick[:, 0])
        for j in range(1, size[0]):
            m = int(np.count_nonzero(size > j))
            near = near[:m]
            sums = near.cumsum(axis=1)
            covered.update(size[:m][sums[:, -1] <= 0].tolist())
            pick[:m, j] = np.minimum(n - 1, np.count_nonzero(sums <= (draw[:m, j] * sums[:, -1])[:, None], axis=1))
            np.minimum(near, to(pick[:m, j]), out=near)
    found = {}
    for k in ks:
        rng = stream(k)
        found[k] = [seeded(x, k, rng) for _ in range(restarts)] if k in covered else list(x[picks[sizes == k, :k]])
    return found


class _Rows:
    """Rows of x, and which of the centres of many runs (run, number, column; nan where a run has none) is the nearest of each.

    Products in single precision order the centres but for rounding, so rows for which another centre lies within the nearest
    one's reach are done by ``nearest``. Of equal centres it is the first.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.mean = x, x.mean(axis=0)
        off = x - self.mean
        self.lifted = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        self.across = np.concatenate([off, np.ones((len(x), 1))], axis=1).T.astype(np.float32, order="C")
        off *= off
        self.reach, self.tight = np.float32(2.5e-6 * float(off.sum(axis=1).max())), 1e-9 * max(1.0, float((x * x).sum(axis=1).max()))

    def own(self, centres: np.ndarray):
        """Blocks of rows, and 1 for each run, centre and row that belong together, else 0."""
        near = centres - self.mean
        terms = np.concatenate([-2 * near, (near * near).sum(axis=2, keepdims=True)], axis=2)
        terms = np.where(np.isnan(terms), FAR, terms).astype(np.float32).reshape(-1, 4)
        for at in range(0, len(self.x), BLOCK):
            rows = slice(at, at + BLOCK)
            far = (terms @ self.across[:, rows]).reshape(*centres.shape[:2], -1)
            close = far <= far.min(axis=1, keepdims=True) + self.reach
            if np.count_nonzero(close) > close.shape[0] * close.shape[2]:
                run, i = np.nonzero(np.count_nonzero(close, axis=1) > 1)
                close[run, :, i] = False
                for r in np.unique(run):
                    some = i[run == r]
                    close[r, nearest(self.x[at + some], self.lifted[at + some], centres[r, ~np.isnan(centres[r, :, 0])], self.tight), some] = True
            yield rows, close.astype(np.float64)

    def sums(self, centres: np.ndarray) -> np.ndarray:
        """For each run's centres the sums of their rows, and in a fourth column how many they are."""
        return sum(own @ self.lifted[rows] for rows, own in self.own(centres))

    def of(self, centres: np.ndarray) -> np.ndarray:
        """The number of each row's centre, for each run."""
        places = np.arange(centres.shape[1], dtype=np.float64)
        return np.concatenate([places @ own for _, own in self.own(centres)], axis=1).astype(np.int64)


def lloyds(x: np.ndarray, starts: list[np.ndarray], rounds: int):
    """The place of a run's start, its centres, assignment and within sum of squares after at most so many rounds, most centres first.

    Runs of like numbers of centres share a step. The last means are summed row by row, so that they don't depend on how products round.
    """
    rows, at = _Rows(x), 0
    columns, order = np.ascontiguousarray(x.T), sorted(range(len(starts)), key=lambda i: -len(starts[i]))
    while at < len(order):
        most = len(starts[order[at]])
        runs = order[at : at + max(1, min(CENTRES // most, SHARED // len(x)))]
        at += len(runs)
        centres = np.full((len(runs), most, 3), np.nan)
        for c, i in zip(centres, runs, strict=True):
            c[: len(starts[i])] = starts[i]
        before, live, moves = centres.copy(), np.arange(len(runs)), np.zeros(len(runs), dtype=bool)
        for _ in range(rounds):
            c = centres[live]
            sums = rows.sums(c)
            n = sums[:, :, 3:]
            moved = np.where(n > 0, sums[:, :, :3] / np.maximum(n, 1), c)
            on = (np.abs(moved - c) > 1e-8 + 1e-5 * np.abs(c)).any(axis=(1, 2))
            live = live[on]
            before[live], centres[live], moves[live] = c[on], moved[on], True
            if not len(live):
                break
        for i, of in zip(np.flatnonzero(moves), rows.of(before[moves]) if moves.any() else (), strict=True):
            c, n = centres[i], np.bincount(of, minlength=most)
            for d, column in enumerate(columns):
                c[:, d] = np.where(n > 0, np.bincount(of, column, most) / np.maximum(n, 1), c[:, d])
        for c, of, i in zip(centres, rows.of(centres), runs, strict=True):
            dist = np.zeros(len(x))
            for column, own in zip(columns, c.T, strict=True):
                diff = column - own[of]
                diff *= diff
                dist += diff
            yield i, c[: len(starts[i])], of, float(dist.sum())


def clusterings(x: np.ndarray, starts: dict[int, list[np.ndarray]], rounds: int = 10):
    """k, centres, assignment and within sum of squares of the best of the runs of each number of clusters, as they end: no more than a few are held."""
    of_run, left, best = [k for k in starts for _ in starts[k]], {k: len(runs) for k, runs in starts.items()}, {}
    for i, *found in lloyds(x, [s for runs in starts.values() for s in runs], rounds):
        k = of_run[i]
        left[k] -= 1
        if k not in best or found[2] < best[k][2]:
            best[k] = found
        if not left[k]:
            yield k, *best.pop(k)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10, restarts: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, assignment and within sum of squares of the best of the restarts."""
    return next(clusterings(x, {k: [seeded(x, k, rng) for _ in range(restarts)]}, rounds))[1:]


def clustering_bits(luv: np.ndarray, of: np.ndarray, centres: np.ndarray, h: int, w: int) -> float:
    """Description length of a clustering of an h x w raster (column-major rows of luv)."""
    k = len(centres)
    total = np.log2(h * w)
    if k == 0:
        return float(total + len(luv) * (np.log2(101) + np.log2(345) + np.log2(257)))
    total += k * (np.log2(101) + np.log2(345) + np.log2(257)) + k * np.log2(100) + sum(mdl_rle2d(of.reshape(w, h).T, k))
    rest, n = np.rint(luv - centres[of]), 3 * np.bincount(of, minlength=k)  # whole numbers, so their sums are exact
    s1, s2 = np.bincount(of, rest.sum(axis=1), k), np.bincount(of, (rest * rest).sum(axis=1), k)
    sd = np.maximum(1.0, np.rint(np.sqrt(np.maximum(0.0, s2 - s1 * s1 / np.maximum(n, 1)) / np.maximum(n - 1, 1))))
    over, scale = -1 / (2 * sd * sd), 3 * sd * np.sqrt(2 * np.pi)
    for at in range(0, len(luv), 32 * BLOCK):
        own, e = of[at : at + 32 * BLOCK], rest[at : at + 32 * BLOCK]
        by, chance = over[own][:, None], np.zeros(e.shape)
        for o in (-0.5, 0.0, 0.5):
            off = e + o
            off *= off
            off *= by
            chance += np.exp(off, out=off)
        chance /= scale[own][:, None]
        total -= np.log2(np.maximum(chance, 1e-300)).sum()
    return float(total)
