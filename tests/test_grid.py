from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import boxes as B
from gridloom.operators import grid as G
from gridloom.options import Options

CELLS = "pg string, id int, x1 int, y1 int, x2 int, y2 int, text string"
# (text, x1, y1, x2, y2) of each cell, then rows of (text, rowspan, colspan).
GOLDEN = {
    "single": ([("Cell 1", 10, 10, 50, 30)], [[("Cell 1", 1, 1)]]),
    "two_by_two": (
        [("A1", 10, 10, 50, 30), ("B1", 60, 10, 100, 30), ("A2", 10, 40, 50, 60), ("B2", 60, 40, 100, 60)],
        [[("A1", 1, 2)], [("A2", 1, 2)]],
    ),
    "rowspan": ([("Tall", 10, 10, 50, 60), ("B1", 60, 10, 100, 30), ("B2", 60, 40, 100, 60)], [[("Tall", 2, 2)]]),
    "colspan": ([("Wide", 10, 10, 100, 30), ("A2", 10, 40, 50, 60), ("B2", 60, 40, 100, 60)], [[("Wide", 1, 2)], [("A2", 1, 2)]]),
}


def rows_of(spark, cells, options=Options()):
    data = [("p", i, x1, y1, x2, y2, t) for i, (t, x1, y1, x2, y2) in enumerate(cells)]
    built = G.build(spark.createDataFrame(data, CELLS), "pg", options)
    out = {}
    for r in G.long_form(built, "pg").collect():
        out.setdefault(r.row_idx, {})[r.entry_idx] = (r.text, r.rowspan, r.colspan)
    return [[row[k] for k in sorted(row)] for _, row in sorted(out.items())]


def simulate(cells, t=5):
    """The grid by loops over lists and a set of occupied slots."""
    cells = sorted(cells, key=lambda c: (c[2], c[1]))

    def axis(values):
        out = []
        for v in sorted(set(values)):
            if not out or v - out[-1] > t:
                out.append(v)
        return out

    ys, xs = axis(c[2] for c in cells), axis(c[1] for c in cells)
    typical = (xs[-1] - xs[0]) / (len(xs) - 1) if len(xs) > 1 else 100
    taken, grid = set(), []
    for r, y in enumerate(ys):
        line = {}
        for text, x1, y1, x2, y2 in cells:
            if abs(y1 - y) > t:
                continue
            c = sum(x + t < x1 for x in xs)
            down = 1 + sum(v - t <= y2 for v in ys[r + 1 :])
            wide, k, left = 1, c, x2 - x1
            while k + 1 < len(xs) and left > typical * 0.3:
                gap = xs[k + 1] - xs[k]
                if left > gap * 0.3:
                    wide, left = wide + 1, left - gap
                k += 1
            slots = {(a, b) for a in range(r, min(r + down, len(ys))) for b in range(c, min(c + wide, len(xs)))}
            if not slots & taken:
                taken |= slots
                line[c] = (text, down, wide)
        if not any(e[2] > 1 for e in line.values()):
            for c in range(len(xs)):
                if c not in line and (r, c) not in taken:
                    line[c] = ("", 1, 1)
        if line:
            grid.append([line[c] for c in sorted(line)])
    return grid


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    cells, expected = GOLDEN[name]
    assert rows_of(spark, cells) == expected


def test_empty(spark):
    assert rows_of(spark, []) == []


def test_geometric_spans(spark):
    cells, _ = GOLDEN["two_by_two"]
    assert rows_of(spark, cells, Options(span_mode="geometric")) == [[("A1", 1, 1), ("B1", 1, 1)], [("A2", 1, 1), ("B2", 1, 1)]]


box = st.tuples(st.integers(0, 150), st.integers(0, 150), st.integers(1, 90), st.integers(1, 60))


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(box, min_size=1, max_size=9), min_size=20, max_size=30))
def test_grid_like_simulation(spark, pages):
    cells = [[(f"c{i}", x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(page)] for page in pages]
    data = [(str(p), i, x1, y1, x2, y2, t) for p, page in enumerate(cells) for i, (t, x1, y1, x2, y2) in enumerate(page)]
    built = G.build(spark.createDataFrame(data, CELLS), "pg")
    found = {r.pg: [[(e.text, e.rowspan, e.colspan) for e in row] for row in r.grid] for r in built.select("pg", "grid").collect()}
    for p, page in enumerate(cells):
        assert found[str(p)] == simulate(page), page


def ratio(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    size = [(c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)]
    return wide * high / min(size) if wide > 0 and high > 0 else 0.0


def greedy(boxes):
    valid = [b for b in boxes if b[2] - b[0] >= 5 and b[3] - b[1] >= 5]
    kept = []
    for b in sorted(valid, key=lambda c: -(c[2] - c[0]) * (c[3] - c[1])):
        if all(ratio(b, k) <= 0.7 for k in kept):
            kept.append(b)
    return kept


@pytest.mark.parametrize("fold_limit", [2000, 3])
@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(pages=st.lists(st.lists(box, min_size=1, max_size=10), min_size=20, max_size=20))
def test_suppression(spark, fold_limit, pages):
    boxes = [[(x, y, x + w, y + h) for x, y, w, h in page] for page in pages]
    data = [(p, i, *b) for p, page in enumerate(boxes) for i, b in enumerate(page)]
    rows = B.suppress(spark.createDataFrame(data, "pg int, ord int, x1 int, y1 int, x2 int, y2 int"), "pg", fold_limit=fold_limit).orderBy("pg", "id").collect()
    for p, page in enumerate(boxes):
        own = [(r.x1, r.y1, r.x2, r.y2) for r in rows if r.pg == p]
        assert own == greedy(page)
        assert all(ratio(a, b) <= 0.7 for a, b in combinations(own, 2))


def test_anchors_are_no_sessions(spark):
    merged = F.expr(G.merged("array(18, 10, 14)", 5))
    assert spark.range(1).select(merged.alias("a")).first().a == [10, 18]
