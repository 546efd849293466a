"""What one task holds at once: sorts and groups along a line, and rows of a table of any size."""

import math
import random

import pytest

from fieldsift import registry
from fieldsift.operators import lines, roads
from fieldsift.plans.views import view
from fieldsift.road_queries import source_lines
from fieldsift.sources import tables


def held(df):
    """Sorts and aggregates of a plan; each holds pages of its own in every task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count(" Sort ["), plan.count("HashAggregate(") + plan.count("SortAggregate(")


def walked(cells):
    """from_k, to_k of the runs of one line, segment after segment."""
    passed, runs = set(), []
    for k, (v, w) in enumerate(zip(cells, cells[1:]), 1):
        if v == w or frozenset((v, w)) in passed:
            continue
        passed.add(frozenset((v, w)))
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    return runs


def test_runs_of_long_lines_are_those_of_a_walk(spark):
    r = random.Random(5)
    held_lines = {i: [f"{r.randrange(n)},0" for _ in range(r.randrange(1, 60))] for i, n in enumerate([2, 3, 4, 6, 12] * 12)}
    held_lines |= {100: ["a"], 101: ["a", "a", "a"], 102: ["a", "b", "a", "b", "c"], 103: ["a", "b"], 104: ["a", "b", "c", "b", "a", "d"]}
    points = [(i, k, v) for i, cells in held_lines.items() for k, v in enumerate(cells, 1)]
    r.shuffle(points)
    made = lines.untraversed_runs(spark.createDataFrame(points, "line_id long, k long, v string"))
    want = [(i, n, a, b) for i, cells in held_lines.items() for n, (a, b) in enumerate(walked(cells), 1)]
    assert sorted(map(tuple, made.collect())) == sorted(want) and max(n for _, n, _, _ in want) >= 5


@pytest.mark.parametrize("name, most_sorts, most_groups", [("untraversed_runs", 4, 0), ("corridor_cuts", 2, 2)])
def test_a_task_holds_few_sorts_and_groups_at_once(spark, name, most_sorts, most_groups):
    sorts, groups = held(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert 1 < sorts <= most_sorts and groups <= most_groups


def pieces_of(parts):
    """piece -> (parts, legs, metres) of one unit, given the points of each part, leg after leg."""
    legs = [(p, part[i - 1] if i else None, part[i], i == len(part) - 1) for p, part in enumerate(parts) for i in range(len(part))]
    legs = [(p, 0.0 if a is None else 12_742_000 * math.asin(math.sin(math.radians(abs(b - a)) / 2)), a is not None, ends) for p, a, b, ends in legs]
    total = sum(m for _, m, _, _ in legs)
    n = 1 if total <= roads.LARGEST else max(2, math.floor(total / roads.TARGET + 0.5))
    piece, run, reached, found = 1, 0.0, 0, {}
    for p, m, is_leg, ends in legs:
        run += m
        if is_leg:
            seen, count, metres = found.get(piece, (set(), 0, 0.0))
            found[piece] = (seen | {p}, count + 1, metres + m)
        now = min(n - 1, math.floor(run * n / total))
        piece, reached = piece + (now > reached and not ends), now
    return {k: (len(seen), count, metres) for k, (seen, count, metres) in found.items()}


def test_pieces_of_units_of_many_parts_are_those_of_a_walk(spark):
    r = random.Random(8)
    units = {u: [[r.uniform(0, 0.1) * (i % 5) for i in range(r.randrange(1, 9))] for _ in range(r.randrange(1, 12))] for u in range(60)}
    points = [(u, p, k, 0.0, lat) for u, parts in units.items() for p, part in enumerate(parts, 1) for k, lat in enumerate(part, 10 * p)]
    r.shuffle(points)
    made = roads.pieces(spark.createDataFrame(points, "unit long, part long, k long, lon double, lat double")).collect()
    want = {(u, k): told for u, parts in units.items() if sum(abs(b - a) for part in parts for a, b in zip(part, part[1:])) > 0.015 for k, told in pieces_of(parts).items()}
    assert {(m["unit"], m["piece"]): (m["parts"], m["legs"]) for m in made} == {k: v[:2] for k, v in want.items()}
    assert all(math.isclose(m["metres"], want[m["unit"], m["piece"]][2], rel_tol=1e-9) for m in made)
    assert max(v[0] for v in want.values()) >= 2 and sum(k > 1 for _, k in want) >= 100 and len({m["parts"] for m in made}) >= 2


def test_roads_are_dealt_by_the_number_of_their_vertices(spark, monkeypatch):
    some = view(spark, "/root/testdata/sf0.001", "vertices").where("line_id < 90")
    told = []
    for rows in (tables.TASK_ROWS, 40):
        asked = []
        monkeypatch.setattr(roads, "dealt", lambda df, key, n=None, rows=rows, asked=asked: asked.append((key, n)) or tables.dealt(df, key, rows, n))
        _, points = roads.compose(source_lines(some))
        assert (points._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2) is (rows == 40)
        told.append((asked, sorted(map(tuple, points.collect()))))
    n = source_lines(some).count()
    assert told[0] == told[1] and told[0][0] == [("line_id", n), ("component", n)] and n > 400
    assert tables.dealt(some, "line_id", 10, n=10) is some
