"""From cells to a grid of rows and columns with spans.

A document's cells become one array, sorted by position; axes, spans and the greedy placement are
higher-order functions over it. One shuffle by document carries all of it, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.options import DEFAULTS, Options

PLACED = "struct<r:int,c:int,rowspan:int,colspan:int,text:string>"


def merged(positions: str, tolerance: int) -> str:
    """SQL: ascending positions, of which one is an anchor if it lies more than the tolerance behind the
    last anchor (not behind the last position)."""
    return (
        f"aggregate(array_sort(array_distinct({positions})), cast(array() as array<int>), "
        f"(a, p) -> IF(size(a) = 0 OR p - element_at(a, -1) > {tolerance}, array_append(a, p), a))"
    )


def typical_width(columns: str, default: int) -> str:
    """SQL: mean gap of neighbouring column anchors."""
    return f"CASE WHEN size({columns}) > 1 THEN (element_at({columns}, -1) - {columns}[0]) / CAST(size({columns}) - 1 AS DOUBLE) ELSE {default}.0D END"


def column_index(x: str, columns: str, tolerance: int) -> str:
    """SQL: number of anchors that lie more than the tolerance before x."""
    return f"size(filter({columns}, a -> a + {tolerance} < {x}))"


def row_span(bottom: str, row: str, rows: str, options: Options = DEFAULTS) -> str:
    """SQL: rows that reach from anchor number `row` to the bottom."""
    t = options.grid_tolerance
    inside = f"a - {t} <= {bottom}" if options.span_mode == "reference" else f"a + {t} < {bottom}"
    return f"1 + size(filter(slice({rows}, {row} + 2, size({rows})), a -> {inside}))"


def column_span(width: str, column: str, columns: str, typical: str, options: Options = DEFAULTS) -> str:
    """SQL: columns that a width covers from anchor number `column` on. The walk over the gaps stops when
    too little width remains, after which its state no longer changes."""
    f = options.span_factor
    own = "" if options.span_mode == "reference" else f" - IF({column} + 1 < size({columns}), {columns}[{column} + 1] - {columns}[{column}], 0)"
    first = column if options.span_mode == "reference" else f"{column} + 1"
    gap = f"({columns}[k + 1] - {columns}[k])"
    return (
        f"aggregate(filter(sequence(0, size({columns}) - 1), k -> k >= {first} AND k + 1 < size({columns})), "
        f"named_struct('span', 1, 'left', {width}{own}), "
        f"(s, k) -> IF(s.left > {typical} * {f}D AND s.left > {gap} * {f}D, named_struct('span', s.span + 1, 'left', s.left - {gap}), s), s -> s.span)"
    )


def axes(cells: DataFrame, key: str, options: Options = DEFAULTS) -> DataFrame:
    """One row per document: cells (sorted by y1, x1, id), rows, columns, typical."""
    t = options.grid_tolerance
    whole = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "id", "x2", "y2", "text"))).alias("cells"))
    placed = whole.withColumn("rows", F.expr(merged("cells.y1", t))).withColumn("columns", F.expr(merged("cells.x1", t)))
    return placed.withColumn("typical", F.expr(typical_width("columns", options.default_width)))


def attempts(axed: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Adds `tries`: every (row, cell) within the tolerance of the row's anchor, in order, with spans."""
    t = options.grid_tolerance
    own_column = column_index("c.x1", "columns", t)
    per_cell = (
        f"named_struct('r', r, 'c', {own_column}, 'rowspan', {row_span('c.y2', 'r', 'rows', options)}, "
        f"'colspan', {column_span('(c.x2 - c.x1)', '(' + own_column + ')', 'columns', 'typical', options)}, 'text', c.text, 'id', c.id)"
    )
    tries = f"flatten(transform(rows, (y, r) -> transform(filter(cells, c -> abs(c.y1 - y) <= {t}), c -> {per_cell})))"
    return axed.withColumn("tries", F.expr(tries))


def place(tried: DataFrame) -> DataFrame:
    """Adds `placed`: tries whose rectangle, cut to the axes, meets none placed before."""
    end = "least({0}.r + {0}.rowspan, size(rows))", "least({0}.c + {0}.colspan, size(columns))"
    meets = " AND ".join(
        [
            f"t.r < {end[0].format('p')}",
            f"p.r < {end[0].format('t')}",
            f"t.c < {end[1].format('p')}",
            f"p.c < {end[1].format('t')}",
        ]
    )
    kind = "array<struct<r:int,c:int,rowspan:int,colspan:int,text:string,id:int>>"
    fold = f"aggregate(tries, cast(array() as {kind}), (placed, t) -> IF(t.c >= size(columns) OR exists(placed, p -> {meets}), placed, array_append(placed, t)))"
    return tried.withColumn("placed", F.expr(fold))


def compact(placed: DataFrame) -> DataFrame:
    """Adds `grid`: rows of entries, with blank fillers where a row has no merged cell, without empty
    slots and empty rows."""
    covered = "exists(placed, p -> p.r <= r AND r < p.r + p.rowspan AND p.c <= c AND c < p.c + p.colspan)"
    free = f"filter(sequence(0, size(columns) - 1), c -> NOT {covered})"
    blanks = f"transform({free}, c -> named_struct('c', c, 'text', '', 'rowspan', 1, 'colspan', 1))"
    own = "transform(filter(placed, p -> p.r = r), p -> named_struct('c', p.c, 'text', p.text, 'rowspan', p.rowspan, 'colspan', p.colspan))"
    row = f"array_sort(concat({own}, IF(exists(placed, p -> p.r = r AND p.colspan > 1), cast(array() as array<struct<c:int,text:string,rowspan:int,colspan:int>>), {blanks})))"
    grid = f"filter(transform(rows, (y, r) -> {row}), g -> size(g) > 0)"
    return placed.withColumn("grid", F.expr(grid))


def build(cells: DataFrame, key: str, options: Options = DEFAULTS) -> DataFrame:
    """cells (key, id, x1, y1, x2, y2, text): one row per document with rows, columns, placed and grid."""
    return compact(place(attempts(axes(cells, key, options), options)))


def long_form(built: DataFrame, key: str) -> DataFrame:
    """key, row_idx, entry_idx, text, rowspan, colspan."""
    # The outer form: before the other, the optimizer puts a filter that would build the grid once more.
    rows = built.select(key, F.posexplode_outer("grid").alias("row_idx", "row"))
    entries = rows.select(key, "row_idx", F.posexplode_outer("row").alias("entry_idx", "e")).where(F.col("e").isNotNull())
    return entries.select(key, "row_idx", "entry_idx", "e.text", "e.rowspan", "e.colspan")


def entries(grid: Column) -> Column:
    """The nested grid of (text, rowspan, colspan) that a response holds."""
    return F.transform(grid, lambda row: F.transform(row, lambda e: F.struct(e["text"].alias("text"), e["rowspan"].alias("rowspan"), e["colspan"].alias("colspan"))))


def dimensions(grid: Column) -> tuple[Column, Column]:
    """Rows, and entries of the longest row; (0, 0) for an empty grid."""
    return F.size(grid), F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
