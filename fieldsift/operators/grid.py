"""The grid that areas define: cells which their union touches with positive area, full or edge, and the areas of each cell.

A cell's task gets the edges of the areas that meet the cell, of its own column only: enough to say at any x of the column
which y are covered. Work in a cell is done in parts of few edges, so that crossings are looked for among near edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.functions import geo
from fieldsift.operators import relations as rel
from fieldsift.operators.polygons import polygon_bounds
from fieldsift.sources.tables import shuffled

#: Edges near a part of a cell at most, as long as it can be quartered, how often it can, and the share of a cell that is rounding.
STRIP_EDGES, DEEPEST, OPEN_SHARE = 64, 12, 1e-9


def _covered(xs: np.ndarray, edges: np.ndarray, owner: np.ndarray, low: float, high: float) -> np.ndarray:
    """At each x the length of [low, high] that the union covers."""
    ax, ay, bx, by = edges.T
    total = np.zeros(len(xs))
    hit = (ax > xs[:, None]) != (bx > xs[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        ys = ay + (by - ay) * (xs[:, None] - ax) / (bx - ax)
    for i in range(len(xs)):
        at = np.flatnonzero(hit[i])
        if not len(at):
            continue
        order = at[np.lexsort((ys[i, at], owner[at]))]  # by area, then upwards: even-odd pairs
        y = np.clip(ys[i, order], low, high)
        bottom, top = y[::2], y[1::2]
        up = np.argsort(bottom, kind="stable")
        bottom, top = bottom[up], np.maximum.accumulate(top[up])
        before = np.concatenate([[low], top[:-1]])
        total[i] = np.maximum(0.0, top - np.maximum(bottom, before)).sum()
    return total


def _slabs(edges: np.ndarray, owner: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Area of the union of areas in a box, from all their edges beside the box's width.

    Between neighbouring events (vertices, crossings, passages of the box's sides) covered length is linear in x, so its
    value in the middle times the width is exact.
    """
    west, south, east, north = box
    near = (np.minimum(edges[:, 0], edges[:, 2]) < east) & (np.maximum(edges[:, 0], edges[:, 2]) > west) & (edges[:, 0] != edges[:, 2])
    mine, who = edges[near], owner[near]
    if not len(mine):
        return 0.0
    ax, ay, bx, by = mine.T
    slope = (by - ay) / (bx - ax)
    at_zero = ay - slope * ax
    events = [np.array([west, east]), ax, bx]
    with np.errstate(divide="ignore", invalid="ignore"):
        events += [(south - at_zero) / slope, (north - at_zero) / slope]
        i, j = np.triu_indices(len(mine), 1)
        low, high = np.minimum(ax, bx), np.maximum(ax, bx)
        crossing = (at_zero[j] - at_zero[i]) / (slope[i] - slope[j])
        meet = (crossing > np.maximum(low[i], low[j])) & (crossing < np.minimum(high[i], high[j]))
        events.append(crossing[meet])
    x = np.concatenate(events)
    x = np.unique(x[np.isfinite(x) & (x >= west) & (x <= east)])
    middle, width = (x[1:] + x[:-1]) / 2, np.diff(x)
    return sum(float(_covered(middle[s : s + 512], mine, who, south, north) @ width[s : s + 512]) for s in range(0, len(middle), 512))


def _hold(edges: np.ndarray, owner: np.ndarray, x: float, y: float) -> bool:
    """Whether a point lies in one of the areas, by the number of an area's edges below it."""
    ax, ay, bx, by = edges.T
    hit = np.flatnonzero((ax > x) != (bx > x))
    below = hit[ay[hit] + (by[hit] - ay[hit]) * (x - ax[hit]) / (bx[hit] - ax[hit]) < y]
    return bool((np.unique(owner[below], return_counts=True)[1] % 2).any())


def union_area(edges: np.ndarray, owner: np.ndarray, box: tuple[float, float, float, float]) -> tuple[float, np.ndarray]:
    """Area of the union of areas in a box (square units of the edges), and of each area (0, 1, ...) alone.

    The box is quartered until few edges are near a part. An area without an edge near a part holds all of it or none: where
    one holds it, the others don't matter. So work grows with the edges, not with their square.
    """
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(int(owner.max()) + 2 if len(owner) else 1))
    held = np.array([_slabs(edges[order[a:b]], np.zeros(b - a, int), box) for a, b in zip(starts[:-1], starts[1:])])
    found, todo = 0.0, [(box, edges, owner, 0)]
    while todo:
        (west, south, east, north), mine, who, depth = todo.pop()
        if not len(mine):
            continue
        x, y = np.sort(mine[:, [0, 2]], axis=1), np.sort(mine[:, [1, 3]], axis=1)
        beside = (x[:, 0] < east) & (x[:, 1] > west)
        near = beside & (y[:, 0] < north) & (y[:, 1] > south)
        is_open = np.isin(who, who[near])
        across, up = (west + east) / 2, (south + north) / 2
        if _hold(mine[~is_open], who[~is_open], across, up):
            found += (east - west) * (north - south)
            continue
        mine, who = mine[is_open & beside], who[is_open & beside]
        if near.sum() > STRIP_EDGES and depth < DEEPEST:
            todo += [((a, b, c, d), mine, who, depth + 1) for a, c in ((west, across), (across, east)) for b, d in ((south, up), (up, north))]
        else:
            found += _slabs(mine, who, (west, south, east, north))
    return found, held


def grid_cells(edges: DataFrame, size: float = geo.CELL) -> DataFrame:
    """x, y, kind (full or edge), share (of the cell) and areas (sorted) of the cells that areas (poly: edges) touch.

    Areas may overlap. A cell which they touch along a line or in a point only is none. An area without edges is none.
    """
    cells = rel.member_cells(polygon_bounds(edges), size).select("poly", "x", "y")
    low, high = (geo.cell_index(f("ax", "bx"), size) for f in (F.least, F.greatest))
    columns = edges.withColumn("x", F.explode(F.sequence(low, high)))
    rows = cells.join(shuffled(columns), ["poly", "x"]).select("x", "y", "poly", "ax", "ay", "bx", "by")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        x, y = int(batch["x"].iloc[0]), int(batch["y"].iloc[0])
        polys, owner = np.unique(batch["poly"].to_numpy(), return_inverse=True)
        box = (0.0, 0.0, 1.0, 1.0)  # in cells, so that shares are areas
        scaled = batch[["ax", "ay", "bx", "by"]].to_numpy(float) / size - np.array([x, y, x, y])
        share, held = union_area(scaled, owner, box)
        if share <= OPEN_SHARE:
            return pd.DataFrame(columns=["x", "y", "kind", "share", "areas"])
        return pd.DataFrame({"x": [x], "y": [y], "kind": ["full" if share >= 1 - OPEN_SHARE else "edge"], "share": [min(1.0, share)], "areas": [polys[held > OPEN_SHARE].tolist()]})

    return rows.groupBy("x", "y").applyInPandas(run, "x long, y long, kind string, share double, areas array<long>")  # a cell's own edges

