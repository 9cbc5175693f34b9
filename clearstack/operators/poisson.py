"""Gradient-domain blending: the filled raster's gradients under the mask, the original's values around it.

The equations are solved tile by tile with numpy, the pixels around a tile held at their last values; tiles move by half
their size from round to round, so a component smaller than a tile settles at once. Larger ones settle by exchange between
tiles and, from the third round on, by a correction on a coarse grid: bilinear functions with a node every quarter tile,
cut to the mask (Galerkin), whose system is added up from the tiles and solved by conjugate gradients in the driver. A
task holds one tile, however large a component is; the driver holds the nodes of the masks' bounding box.
Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.session import written

_SCHEMA = "y long, x long, own double, keep double, m boolean, v double, moved double"


def relax(v: np.ndarray, push: np.ndarray, free: np.ndarray, there: np.ndarray, tolerance: float, steps: int) -> np.ndarray:
    """v with 4-neighbour means plus push at the free cells: successive over-relaxation on a chequerboard."""
    out = np.pad(v.astype(float), 1)
    known = np.pad(there, 1)
    near = lambda a: (a[:-2, 1:-1], a[2:, 1:-1], a[1:-1, :-2], a[1:-1, 2:])
    n = np.maximum(sum(k.astype(int) for k in near(known)), 1)
    colour = np.add.outer(np.arange(v.shape[0]), np.arange(v.shape[1])) % 2
    size = max(v.shape)
    omega = 2 / (1 + np.sin(np.pi / (size + 1)))
    for _ in range(steps):
        most = 0.0
        for c in (0, 1):
            here = free & (colour == c)
            goal = (sum(np.where(k, a, 0.0) for a, k in zip(near(out), near(known), strict=True)) + push) / n
            inner = out[1:-1, 1:-1]
            change = np.where(here, omega * (goal - inner), 0.0)
            inner += change
            most = max(most, float(np.abs(change).max(initial=0.0)))
        if most < tolerance:
            break
    return out[1:-1, 1:-1]


_TERMS = "i long, j long, value double"


class _Coarse:
    """Nodes every `step` pixels, numbered in rows; functions fall linearly to the next nodes and are 0 outside the mask."""

    def __init__(self, step: int, low: tuple[int, int], high: tuple[int, int]) -> None:
        self.step, self.low = step, tuple(v // step for v in low)
        self.shape = tuple(v // step + 2 - o for v, o in zip(high, self.low, strict=True))
        self.e = np.zeros(self.shape)

    def _at(self, v: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        return v // self.step - self.low[axis], v % self.step / self.step

    def correction(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        (i, f), (j, g) = self._at(y, 0), self._at(x, 1)
        e = self.e
        return (1 - f) * ((1 - g) * e[i, j] + g * e[i, j + 1]) + f * ((1 - g) * e[i + 1, j] + g * e[i + 1, j + 1])

    def functions(self, y: np.ndarray, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The functions near some pixels, a column each, and the numbers of their nodes."""
        (i, f), (j, g) = self._at(y, 0), self._at(x, 1)
        i0, j0, wide = i.min(), j.min(), j.max() - j.min() + 2
        out = np.zeros((len(y), (i.max() - i0 + 2) * wide))
        row = np.arange(len(y))
        for di, a in ((0, 1 - f), (1, f)):
            for dj, b in ((0, 1 - g), (1, g)):
                out[row, (i - i0 + di) * wide + j - j0 + dj] = a * b * m
        k = np.arange(out.shape[1])
        return out, (k // wide + i0) * self.shape[1] + k % wide + j0

    def solve(self, a: pd.DataFrame, b: pd.DataFrame) -> None:
        """Conjugate gradients, scaled by the diagonal; a has i <= j only, b is the residual by node."""
        n = self.shape[0] * self.shape[1]
        off = a[a["i"] != a["j"]]
        i, j = np.concatenate([a["i"], off["j"]]), np.concatenate([a["j"], off["i"]])
        value = np.concatenate([a["value"], off["value"]])
        times = lambda x: np.bincount(i, value * x[j], n)
        own = a[a["i"] == a["j"]]
        scale = np.bincount(own["i"], own["value"], n)
        scale = np.divide(1, scale, out=np.zeros(n), where=scale > 1e-12)
        x, r = np.zeros(n), np.bincount(b["i"], b["value"], n) * (scale > 0)
        z = scale * r
        d, now = z, r @ z
        goal = 1e-16 * now
        for _ in range(4 * n):
            if now <= goal:
                break
            q = times(d)
            if (curve := d @ q) <= 0:
                break
            x, r = x + now / curve * d, r - now / curve * q
            z = scale * r
            before, now = now, r @ z
            d = z + now / before * d
        self.e = x.reshape(self.shape)


def _terms(coarse: _Coarse, matrix: bool):
    """Of a tile: its share of the residual by node (j = -1) and, where wanted, of the coarse system."""

    def terms(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x, m, v = (rows[c].to_numpy() for c in ("y", "x", "m", "v"))
        inside = rows["inside"].to_numpy()
        functions, nodes = coarse.functions(y, x, m)
        at = (y - y.min(), x - x.min())
        index = np.full((at[0].max() + 1, at[1].max() + 1), -1)
        index[at] = np.arange(len(rows))
        ends = [(index[:-1].ravel(), index[1:].ravel()), (index[:, :-1].ravel(), index[:, 1:].ravel())]
        p, q = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        # Each pair of neighbours counts once, in the home tile of its first pixel.
        counts = (p >= 0) & (q >= 0)
        p, q = p[counts], q[counts]
        counts = inside[p] & (m[p] | m[q])
        p, q = p[counts], q[counts]
        steps = functions[p] - functions[q]
        gap = v - rows["own"].to_numpy()
        found = [(nodes, np.full(len(nodes), -1), -(gap[p] - gap[q]) @ steps)]
        if matrix:
            i, j = np.triu_indices(len(nodes))
            found.append((nodes[i], nodes[j], (steps.T @ steps)[i, j]))
        i, j, value = (np.concatenate(c) for c in zip(*found, strict=True))
        some = value != 0
        return pd.DataFrame({"i": i[some], "j": j[some], "value": value[some]})

    return terms


def _solver(tile: int, tolerance: float, steps: int, coarse: _Coarse | None):
    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        before = rows["v"]
        if coarse:
            rows = rows.assign(v=before + coarse.correction(rows["y"].to_numpy(), rows["x"].to_numpy()) * rows["m"])
        y0, x0 = rows["y"].min(), rows["x"].min()
        shape = (rows["y"].max() - y0 + 1, rows["x"].max() - x0 + 1)
        at = (rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0)
        grid = lambda c, kind: _put(shape, at, rows[c].to_numpy(), kind)
        own, v, m, inside = grid("own", float), grid("v", float), grid("m", bool), grid("inside", bool)
        there = _put(shape, at, np.ones(len(rows), bool), bool)
        free = m & inside
        wide, known = np.pad(own, 1), np.pad(there, 1)
        sides = ((slice(0, -2), slice(1, -1)), (slice(2, None), slice(1, -1)), (slice(1, -1), slice(0, -2)), (slice(1, -1), slice(2, None)))
        push = sum(np.where(known[s], own - wide[s], 0.0) for s in sides)
        after = relax(v, push, free, there, tolerance, steps)
        out = rows[inside[at]].copy()
        fresh = after[at][inside[at]]
        out["moved"] = np.abs(fresh - before.to_numpy()[inside[at]])
        out["v"] = fresh
        return out[["y", "x", "own", "keep", "m", "v", "moved"]]

    return solve


def _put(shape: tuple, at: tuple, values: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros(shape, kind)
    out[at] = values
    return out


def poisson_blend(df: DataFrame, tile: int = 128, tolerance: float = 1e-3, rounds: int = 40, steps: int = 4000) -> DataFrame:
    """y, x, v of unique pixels (y, x, a, b, m): b outside the mask; inside, a's gradients continued from b at the mask's edge.

    Beyond the raster's edge there is no neighbour. A component without any pixel around it keeps a's values. The
    rounds end when no pixel moves by more than ten times the tolerance; a RuntimeError tells that `rounds` didn't do.
    """
    rest = df.where(~F.col("m")).select("y", "x", F.col("b").cast("double").alias("v"))
    steps_to = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    reach = df.where("m").select("y", "x", F.explode(steps_to).alias("s")).select((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    start = df.join(reach, ["y", "x"], "left_semi").select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("a").cast("double").alias("own"), F.col("b").cast("double").alias("keep"), "m")
    now = written(start.withColumn("v", F.when(F.col("m"), F.col("own")).otherwise(F.col("keep"))))
    coarse = matrix = None
    for k in range(rounds):
        off = (k % 2) * (tile // 2)
        # A pixel goes to its own tile and, where it is a neighbour's edge, to that one too.
        places = F.array(*[F.struct(F.floor((F.col("y") + off + dy) / tile).alias("ty"), F.floor((F.col("x") + off + dx) / tile).alias("tx")) for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
        home = F.struct(F.floor((F.col("y") + off) / tile).alias("ty"), F.floor((F.col("x") + off) / tile).alias("tx"))
        dealt = now.withColumn("home", home).withColumn("t", F.explode(F.array_distinct(places))).withColumn("inside", F.col("t") == F.col("home"))
        dealt = dealt.select("y", "x", "own", "keep", "m", "v", "inside", F.col("t.ty").alias("ty"), F.col("t.tx").alias("tx"))
        if k == 2:
            low_y, low_x, high_y, high_x = now.agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).first()
            coarse = _Coarse(max(2, tile // 4), (low_y, low_x), (high_y, high_x))
        if coarse:
            terms = dealt.groupBy("ty", "tx").applyInPandas(_terms(coarse, matrix is None), _TERMS).groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
            if matrix is None:
                matrix = terms[terms["j"] >= 0]
            coarse.solve(matrix, terms[terms["j"] < 0])
        solved = written(dealt.groupBy("ty", "tx").applyInPandas(_solver(tile, tolerance, steps, coarse), _SCHEMA))
        now = solved.drop("moved")
        if now.isEmpty() or k and solved.where(F.col("moved") > 10 * tolerance).isEmpty():
            break
    else:
        raise RuntimeError(f"blending did not settle in {rounds} rounds")
    return rest.union(now.where("m").select("y", "x", "v"))
