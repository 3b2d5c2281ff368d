"""Small searches for which a task needs Python: one graph or linear program each, side by side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from stemma.session import ship

EPS = 1e-9


def simplex(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Least c x with a x = b, x >= 0, by two phases under Bland's rule: value, x, dual y; None if there is no x."""
    rows, cols = a.shape
    flip = np.where(b < 0, -1.0, 1.0)
    a, b = a * flip[:, None], b * flip
    t = np.hstack([a, np.eye(rows), b[:, None]])
    base = list(range(cols, cols + rows))

    def solve(cost: np.ndarray, allowed: int) -> None:
        while True:
            reduced = cost[:allowed] - cost[base] @ t[:, :allowed]
            enter = next((k for k in range(allowed) if reduced[k] < -EPS), None)
            if enter is None:
                return
            up = [(t[i, -1] / t[i, enter], base[i], i) for i in range(rows) if t[i, enter] > EPS]
            if not up:
                raise ArithmeticError("unbounded")
            least = min(r for r, _, _ in up)
            _, i = min((k, i) for r, k, i in up if r <= least + EPS)
            t[i] /= t[i, enter]
            for k in range(rows):
                if k != i:
                    t[k] -= t[k, enter] * t[i]
            base[i] = enter

    solve(np.concatenate([np.zeros(cols), np.ones(rows)]), cols + rows)
    if sum(t[i, -1] for i in range(rows) if base[i] >= cols) > 1e-7:
        return None
    for i in range(rows):
        if base[i] >= cols and (free := np.flatnonzero(np.abs(t[i, :cols]) > EPS)).size:
            t[i] /= t[i, free[0]]
            for k in range(rows):
                if k != i:
                    t[k] -= t[k, free[0]] * t[i]
            base[i] = int(free[0])
    cost = np.concatenate([c, np.zeros(rows)])
    solve(cost, cols)
    x = np.zeros(cols + rows)
    x[base] = t[:, -1]
    return float(cost[base] @ t[:, -1]), x[:cols], flip * (cost[base] @ t[:, cols : cols + rows])


def signed_l1(points: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Least sum |x| with points' x = target and sum x = 1: value, x, dual (y, mu)."""
    a = np.vstack([points.T, np.ones(len(points))])
    got = simplex(np.hstack([a, -a]), np.append(target, 1.0), np.ones(2 * len(points)))
    if got is None:
        return None
    value, x, y = got
    return value, x[: len(points)] - x[len(points) :], y


def certificate(points: np.ndarray, target: np.ndarray, value: float, x: np.ndarray, dual: np.ndarray, tol: float = 1e-8) -> bool:
    """Whether x reaches the value and the dual proves that nothing less does."""
    y, mu = dual[:-1], dual[-1]
    reached = abs(x.sum() - 1) <= tol and np.abs(points.T @ x - target).max() <= tol and abs(np.abs(x).sum() - value) <= tol
    return bool(reached and np.abs(points @ y + mu).max() <= 1 + tol and abs(target @ y + mu - value) <= tol)


def signed_l1_by_graph(rows: DataFrame) -> DataFrame:
    """rows: graph, points (array of arrays), target (array). Gives graph, value, certified; an infeasible one has a null value."""

    def solve(pdf):
        import pandas as pd

        out = []
        for r in pdf.itertuples(index=False):
            points, target = np.array([list(p) for p in r.points]), np.array(list(r.target))
            got = signed_l1(points, target)
            out.append((r.graph, got and got[0], bool(got and certificate(points, target, *got))))
        return pd.DataFrame(out, columns=["graph", "value", "certified"])

    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["graph"]
    return rows.groupBy("graph").applyInPandas(solve, f"graph {kind}, value double, certified boolean")


def clique_cover(cliques: np.ndarray, weights: np.ndarray, tol: float = 1e-8) -> tuple[float, bool]:
    """The least weight of cliques (rows of 0 and 1) that gives each vertex its weight, and whether the dual proves it."""
    need = np.maximum(weights, 0.0)
    a = np.hstack([cliques.T, -np.eye(len(need))])
    got = simplex(a, need, np.concatenate([np.ones(len(cliques)), np.zeros(len(need))]))
    if got is None:
        raise ValueError("a vertex is in no clique")
    value, x, y = got
    sound = (y >= -tol).all() and (cliques @ y <= 1 + tol).all() and abs(need @ y - value) <= tol * max(1.0, abs(value))
    return value, bool(sound and (a @ x >= need - tol).all())


def clique_cover_by_graph(sets: DataFrame) -> DataFrame:
    """sets: graph, cliques (array of masks, every vertex in one at least), weights (array, by vertex). Gives graph, value, certified."""

    def solve(pdf):
        import pandas as pd

        out = []
        for r in pdf.itertuples(index=False):
            w = np.array(r.weights, dtype=float)
            masks = sorted({int(m) for m in r.cliques if m})
            masks = [m for m in masks if not any(o != m and o & m == m for o in masks)]
            rows = np.array([[m >> v & 1 for v in range(len(w))] for m in masks], dtype=float)
            out.append((r.graph, *clique_cover(rows, w)))
        return pd.DataFrame(out, columns=["graph", "value", "certified"])

    ship(sets.sparkSession)
    kind = dict(sets.dtypes)["graph"]
    return sets.groupBy("graph").applyInPandas(solve, f"graph {kind}, value double, certified boolean")


def chromatic(adjacent: list[int], within: int) -> int:
    """The least number of colours for the vertices of a mask, by search, those of most neighbours first."""
    vs = sorted((v for v in range(len(adjacent)) if within >> v & 1), key=lambda v: (-bin(adjacent[v] & within).count("1"), v))

    def fits(k: int, colours: list[int], left: int) -> bool:
        if left == len(vs):
            return True
        v = vs[left]
        for c in range(min(k, len(colours) + 1)):
            if c == len(colours):
                if fits(k, [*colours, 1 << v], left + 1):
                    return True
            elif not colours[c] & adjacent[v]:
                colours[c] |= 1 << v
                if fits(k, colours, left + 1):
                    return True
                colours[c] ^= 1 << v
        return False

    return next(k for k in range(len(vs) + 1) if fits(k, [], 0))


def clique(adjacent: list[int], within: int) -> int:
    best, stack = 0, [(within, 0)]
    while stack:
        left, size = stack.pop()
        best = max(best, size)
        while left and size + bin(left).count("1") > best:
            v = left.bit_length() - 1
            left ^= 1 << v
            stack.append((left & adjacent[v], size + 1))
    return best


def perfect_by_graph(edges: DataFrame) -> DataFrame:
    """edges: graph, n, i, j (i null: no edge). Gives graph, perfect, checked, counterexample (the first mask by size, then by its vertices
    in order), chi and omega of the whole graph."""

    def check(pdf):
        import pandas as pd
        from itertools import combinations

        n = int(pdf["n"].iloc[0])
        adjacent = [0] * n
        for i, j in pdf[["i", "j"]].dropna().astype(int).itertuples(index=False):
            adjacent[i] |= 1 << j
            adjacent[j] |= 1 << i
        checked, bad = 0, None
        for size in range(n + 1):
            for part in combinations(range(n), size):
                m = sum(1 << v for v in part)
                checked += 1
                if chromatic(adjacent, m) != clique(adjacent, m):
                    bad = m
                    break
            if bad is not None:
                break
        whole = (1 << n) - 1
        return pd.DataFrame([(pdf["graph"].iloc[0], bad is None, checked, bad, chromatic(adjacent, whole), clique(adjacent, whole))], columns=["graph", "perfect", "checked", "counterexample", "chi", "omega"]).astype({"counterexample": "Int64"})

    ship(edges.sparkSession)
    kind = dict(edges.dtypes)["graph"]
    return edges.groupBy("graph").applyInPandas(check, f"graph {kind}, perfect boolean, checked long, counterexample long, chi int, omega int")
