"""Queries of the array kernels, a whole image at a time, against SQL on the pixel relation.

Images are 8 by 8 pixels, so windows, tiles and limits are set to sizes that matter there."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridloom.functions import kernels as K
from gridloom.functions import pixels as P
from gridloom.operators import raster
from gridloom.options import DEFAULTS, Options
from gridloom.plans import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SIDE = 8
#: Above it a pixel belongs to the mask that contours are followed in.
MASK = 127
PIXEL, BOX = "x int, y int, v int", "x1 int, y1 int, x2 int, y2 int"

_THREE = "(SELECT unnest([-1, 0, 1]) AS {0}) {0}s"
_START = f"WITH RECURSIVE {D.GRAY_SQL}, step AS (SELECT dx, dy FROM {_THREE.format('dx')} CROSS JOIN {_THREE.format('dy')})"
_MASK = f"mask AS (SELECT img, x, y, CASE WHEN v > {MASK} THEN 255 ELSE 0 END AS v FROM gray)"


def register(name: str, sql: str):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, _START + sql
        return query

    return keep


def on_images(spark: SparkSession, sf_dir: str, schema: str, kernel: Callable[[int, np.ndarray], Iterable[tuple]]) -> DataFrame:
    """img and the rows that the kernel returns for an image's number and array."""
    names = ["img", *(c.split()[0] for c in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(img, *r) for img, v in zip(frame["img"], frame["v"]) for r in kernel(img, np.array(v, np.uint8).reshape(-1, SIDE))]
            yield pd.DataFrame(rows, columns=names)

    return D.images(spark, sf_dir).mapInPandas(run, f"img bigint, {schema}")


def on_pixels(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """img, x, y, v of the images that the kernel makes."""

    def rows(_: int, image: np.ndarray) -> Iterable[tuple]:
        out = kernel(image)
        y, x = np.indices(out.shape)
        return zip(x.ravel().tolist(), y.ravel().tolist(), out.ravel().tolist())

    return on_images(spark, sf_dir, PIXEL, rows)


def masked(image: np.ndarray) -> np.ndarray:
    return np.where(image > MASK, 255, 0).astype(np.uint8)


@register("gray_kernel", """, beside AS (SELECT img, x, y, v, coalesce(lead(v, 1) OVER w, v) AS g, coalesce(lead(v, 2) OVER w, v) AS r FROM gray WINDOW w AS (PARTITION BY img, y ORDER BY x))
SELECT img, x, y, ((v * 1868 + g * 9617 + r * 4899 + 8192) // 16384)::INT AS v FROM beside""")
def gray_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels are those of `gray_convert`; the weights are in fixed point."""

    def kernel(a: np.ndarray) -> np.ndarray:
        return K.to_grey(np.stack([a, np.concatenate([a[:, 1:], a[:, -1:]], 1), np.concatenate([a[:, 2:], a[:, -2:]], 1)], -1))

    return on_pixels(spark, sf_dir, kernel)


def _adaptive(size: int, name: str) -> str:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    return f""", {name}_t AS (SELECT c, least(7, greatest(0, c + d)) AS m, w / sum(w) OVER (PARTITION BY c) AS w FROM (
  SELECT c, d, exp(-(d * d) / {2 * sigma * sigma}::DOUBLE) AS w FROM (SELECT unnest(range(8)) AS c) cs CROSS JOIN (SELECT unnest(range({-(size // 2)}, {size // 2 + 1})) AS d) ds) k),
{name}_x AS (SELECT g.img, t.c AS x, g.y, sum(t.w * g.v) AS s FROM gray g JOIN {name}_t t ON t.m = g.x GROUP BY g.img, t.c, g.y),
{name}_m AS (SELECT a.img, a.x, t.c AS y, floor(sum(t.w * a.s) + 0.5) AS mean FROM {name}_x a JOIN {name}_t t ON t.m = a.y GROUP BY a.img, a.x, t.c),
{name} AS (SELECT g.img, g.x, g.y, CASE WHEN g.v > m.mean - 2 THEN 255 ELSE 0 END AS v FROM gray g JOIN {name}_m m ON m.img = g.img AND m.x = g.x AND m.y = g.y)"""


@register("adaptive_page", f"{_adaptive(15, 'page')} SELECT img, x, y, v FROM page")
def adaptive_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_pixels(spark, sf_dir, lambda a: K.adaptive(a, DEFAULTS.page_block, DEFAULTS.adaptive_c))


@register("adaptive_cell", f"{_adaptive(11, 'cell')} SELECT img, x, y, v FROM cell")
def adaptive_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_pixels(spark, sf_dir, lambda a: K.adaptive(a, DEFAULTS.cell_block, DEFAULTS.adaptive_c))


@register("page_binary", f"""{_adaptive(15, 'page')}, blank AS (SELECT img FROM gray GROUP BY img HAVING count(*) FILTER (v <= 250) < count(*) * 0.01)
SELECT img, x, y, v FROM page WHERE img NOT IN (SELECT img FROM blank)""")
def page_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page pipeline without its denoising; blank pages raise and give no rows."""

    def rows(_: int, image: np.ndarray) -> Iterable[tuple]:
        try:
            out = raster.preprocess(image, Options(denoise="none"))
        except ValueError:
            return ()
        return ((x, y, int(out[y, x])) for y in range(SIDE) for x in range(SIDE))

    return on_images(spark, sf_dir, PIXEL, rows)


@register("cell_variants", f"""{_adaptive(11, 'cell')}, bins AS (SELECT img, v, count(*) AS n FROM gray GROUP BY img, v),
sums AS (SELECT img, v, sum(n) OVER w AS w, sum(n * v) OVER w AS s, sum(n) OVER p AS tw, sum(n * v) OVER p AS ts FROM bins WINDOW w AS (PARTITION BY img ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY img)),
level AS (SELECT img, coalesce(first(v ORDER BY (ts * w - tw * s)::DOUBLE * (ts * w - tw * s)::DOUBLE / (w * (tw - w))::DOUBLE DESC, v) FILTER (w < tw), 0) AS level FROM sums GROUP BY img)
SELECT img, 'original' AS variant, sum(v)::BIGINT AS total FROM gray GROUP BY img
UNION ALL SELECT g.img, 'otsu', sum(CASE WHEN g.v > l.level THEN 255 ELSE 0 END)::BIGINT FROM gray g JOIN level l ON l.img = g.img GROUP BY g.img
UNION ALL SELECT img, 'adaptive', sum(v)::BIGINT FROM cell GROUP BY img""")
def cell_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of a cell that recognition tries, by their sums."""
    return on_images(spark, sf_dir, "variant string, total bigint", lambda _, a: ((name, int(v.sum(dtype=np.int64))) for name, v in raster.variants(a)))


@register("denoise_nlm", """, mirror AS (SELECT c, CASE WHEN c < 0 THEN -c WHEN c > 7 THEN 14 - c ELSE c END AS m FROM (SELECT unnest(range(-3, 11)) AS c) cs),
wide AS MATERIALIZED (SELECT g.img, a.c AS x, b.c AS y, g.v FROM gray g JOIN mirror a ON a.m = g.x JOIN mirror b ON b.m = g.y),
moved AS MATERIALIZED (SELECT img, x, y, v, sx, sy, x + sx AS mx, y + sy AS my FROM wide CROSS JOIN (SELECT unnest(range(-2, 3)) AS sx) a CROSS JOIN (SELECT unnest(range(-2, 3)) AS sy) b WHERE x BETWEEN -1 AND 8 AND y BETWEEN -1 AND 8),
apart AS MATERIALIZED (SELECT a.img, a.x, a.y, a.sx, a.sy, b.v, (a.v - b.v) * (a.v - b.v) AS d FROM moved a JOIN wide b ON b.img = a.img AND b.x = a.mx AND b.y = a.my),
across AS (SELECT img, x, y, sx, sy, v, sum(d) OVER (PARTITION BY img, sx, sy, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM apart),
weighed AS (SELECT img, x, y, v, exp(-(sum(d) OVER (PARTITION BY img, sx, sy, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) / 32400.0::DOUBLE) AS w FROM across)
SELECT img, x::INT AS x, y::INT AS y, floor(sum(w * v) / sum(w) + 0.5)::INT AS v FROM weighed WHERE w >= 0.001 AND x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY img, x, y""")
def denoise_nlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of 3, searches of 5, and a strength of 60, as neighbouring pixels differ by much."""
    return on_pixels(spark, sf_dir, lambda a: K.denoise(a, 60.0, 3, 5))


@register("clahe", """, bin AS (SELECT img, y // 4 AS i, x // 4 AS j, v AS b, count(*) AS n FROM gray GROUP BY img, y // 4, x // 4, v),
spare AS (SELECT img, i, j, sum(n - 1)::INT AS rest FROM bin GROUP BY img, i, j),
axis AS (SELECT c, least(1, greatest(0, k + floor(place))) AS t, CASE k WHEN 0 THEN 1 - (place - floor(place)) ELSE place - floor(place) END AS w
  FROM (SELECT c, c / 4.0::DOUBLE - 0.5::DOUBLE AS place FROM (SELECT unnest(range(8)) AS c) cs) a CROSS JOIN (SELECT unnest([0, 1]) AS k) ks),
lookup AS (SELECT o.img, o.i, o.j, g.v, least(255, floor(((SELECT count(*) FROM bin b WHERE b.img = o.img AND b.i = o.i AND b.j = o.j AND b.b <= g.v)
  + CASE WHEN o.rest > 0 THEN least(o.rest, g.v // (256 // o.rest) + 1) ELSE 0 END) * 255 / 16.0::DOUBLE + 0.5::DOUBLE)) AS m FROM spare o JOIN (SELECT DISTINCT img, v FROM gray) g ON g.img = o.img)
SELECT g.img, g.x, g.y, least(255, floor(sum(a.w * b.w * m.m) + 0.5::DOUBLE))::INT AS v FROM gray g JOIN axis a ON a.c = g.y JOIN axis b ON b.c = g.x
JOIN lookup m ON m.img = g.img AND m.i = a.t AND m.j = b.t AND m.v = g.v GROUP BY g.img, g.x, g.y""")
def clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two by two tiles of 4 by 4 pixels, whose clip limit is one pixel a bin."""
    return on_pixels(spark, sf_dir, lambda a: K.equalise(a, tiles=2))


def _opened(source: str, name: str, c: str, other: str, back: int, ahead: int) -> str:
    window = f"OVER (PARTITION BY img, {other} ORDER BY {c} ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return f", {name}_e AS (SELECT img, x, y, min(v) {window} AS v FROM {source}), {name} AS (SELECT img, x, y, max(v) {window} AS v FROM {name}_e)"


@register("open_even", f"{_opened('gray', 'o', 'x', 'y', 4, 2)} SELECT img, x, y, v FROM o")
def open_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of even length, twice: it reaches further back than ahead."""
    return on_pixels(spark, sf_dir, lambda a: K.opened(a, 4, 2, "row"))


@register("open_line_h", " SELECT img, x, y, min(v) OVER (PARTITION BY img, y) AS v FROM gray")
def open_line_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default line is longer than a row."""
    return P.opened(D.gray(spark, sf_dir), along="row")


@register("open_line_v", " SELECT img, x, y, min(v) OVER (PARTITION BY img, x) AS v FROM gray")
def open_line_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.opened(D.gray(spark, sf_dir), along="column")


_INSIDE = "CASE WHEN x BETWEEN x1 - 1 AND x2 AND (y BETWEEN y1 - 1 AND y1 OR y BETWEEN y2 - 1 AND y2) OR y BETWEEN y1 - 1 AND y2 AND (x BETWEEN x1 - 1 AND x1 OR x BETWEEN x2 - 1 AND x2) THEN 7 ELSE v END"


@register("rectangle", f" SELECT img, x, y, {_INSIDE} AS v FROM (SELECT *, 1 + img % 3 AS x1, 1 + img % 2 AS y1, 5 + img % 2 AS x2, 6 AS y2 FROM gray) b")
def rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of a box, two pixels thick."""

    def rows(img: int, image: np.ndarray) -> Iterable[tuple]:
        K.rectangle(image, 1 + img % 3, 1 + img % 2, 5 + img % 2, 6, 7, 2)
        return ((x, y, int(image[y, x])) for y in range(SIDE) for x in range(SIDE))

    return on_images(spark, sf_dir, PIXEL, rows)


def _canny(source: str, name: str, low: int, high: int) -> str:
    """The pixels of edges: gradients, ridges, and what is connected with a strong one."""
    flat, steep = f"abs(gy) < {sqrt(2) - 1}::DOUBLE * abs(gx)", f"abs(gy) > {sqrt(2) + 1}::DOUBLE * abs(gx)"
    return f""", {name}_g AS MATERIALIZED (SELECT c.img, c.x, c.y, sum(s.dx * (2 - abs(s.dy)) * o.v)::BIGINT AS gx, sum(s.dy * (2 - abs(s.dx)) * o.v)::BIGINT AS gy FROM {source} c CROSS JOIN step s
  JOIN {source} o ON o.img = c.img AND o.x = least(7, greatest(0, c.x + s.dx)) AND o.y = least(7, greatest(0, c.y + s.dy)) GROUP BY c.img, c.x, c.y),
{name}_d AS MATERIALIZED (SELECT img, x, y, abs(gx) + abs(gy) AS size, CASE WHEN {flat} THEN -1 WHEN {steep} THEN 0 WHEN (gx >= 0) = (gy >= 0) THEN -1 ELSE 1 END AS ux, CASE WHEN {flat} THEN 0 ELSE -1 END AS uy FROM {name}_g),
{name}_r AS MATERIALIZED (SELECT d.img, d.x, d.y, d.size FROM {name}_d d LEFT JOIN {name}_d a ON a.img = d.img AND a.x = d.x + d.ux AND a.y = d.y + d.uy LEFT JOIN {name}_d b ON b.img = d.img AND b.x = d.x - d.ux AND b.y = d.y - d.uy
  WHERE d.size > coalesce(a.size, 0) AND (d.size > coalesce(b.size, 0) OR (d.ux * d.uy = 0 AND d.size = coalesce(b.size, 0)))),
{name}(img, x, y) AS (SELECT img, x, y FROM {name}_r WHERE size > {high}
  UNION SELECT r.img, r.x, r.y FROM {name} e CROSS JOIN step s JOIN {name}_r r ON r.img = e.img AND r.x = e.x + s.dx AND r.y = e.y + s.dy WHERE r.size > {low})"""


def _edges(low: int, high: int) -> str:
    return f"{_canny('gray', 'edge', low, high)} SELECT g.img, g.x, g.y, CASE WHEN e.img IS NULL THEN 0 ELSE 255 END AS v FROM gray g LEFT JOIN edge e ON e.img = g.img AND e.x = g.x AND e.y = g.y"


@register("canny_border", _edges(50, 150))
def canny_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_pixels(spark, sf_dir, lambda a: K.canny(a, *DEFAULTS.border_canny))


@register("canny_strong", _edges(600, 900))
def canny_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that part the images' edges into none, weak and strong ones."""
    return on_pixels(spark, sf_dir, lambda a: K.canny(a, 600, 900))


def _shapes(pixels: str) -> str:
    """found (img, kind, r, x1, y1, x2, y2, area, outermost) of the pixels (img, x, y) of some masks: regions
    that hang together by eight neighbours, and holes by four. Areas are sums over the squares between four
    pixel centres, of which a border leaves a half where it cuts a corner; regions are filled first."""
    beside = "{0}.img = c.img AND {0}.x = c.x + s.dx AND {0}.y = c.y + s.dy"
    return f""", fg AS MATERIALIZED ({pixels}),
comp(img, x, y, r) AS (SELECT f.img, f.x, f.y, f.y * 8 + f.x FROM fg f WHERE NOT EXISTS (SELECT 1 FROM fg p WHERE p.img = f.img AND p.y = f.y AND p.x = f.x - 1)
  UNION SELECT f.img, f.x, f.y, c.r FROM comp c CROSS JOIN step s JOIN fg f ON {beside.format('f')}),
region AS MATERIALIZED (SELECT img, x, y, min(r) AS r FROM comp GROUP BY img, x, y),
bg AS MATERIALIZED (SELECT i.img, a.x, b.y FROM (SELECT DISTINCT img FROM fg) i CROSS JOIN (SELECT unnest(range(-1, 9))::INT AS x) a CROSS JOIN (SELECT unnest(range(-1, 9))::INT AS y) b
  WHERE NOT EXISTS (SELECT 1 FROM fg f WHERE f.img = i.img AND f.x = a.x AND f.y = b.y)),
rest(img, x, y, r) AS (SELECT g.img, g.x, g.y, (g.y + 1) * 10 + g.x + 1 FROM bg g WHERE NOT EXISTS (SELECT 1 FROM bg p WHERE p.img = g.img AND p.y = g.y AND p.x = g.x - 1)
  UNION SELECT g.img, g.x, g.y, c.r FROM rest c CROSS JOIN step s JOIN bg g ON {beside.format('g')} WHERE s.dx * s.dy = 0),
gap AS MATERIALIZED (SELECT img, x, y, min(r) AS r FROM rest GROUP BY img, x, y),
own AS MATERIALIZED (SELECT img, 'outer' AS kind, r, x, y FROM region UNION ALL SELECT img, 'hole', r, x, y FROM gap WHERE r > 0),
around(img, kind, r, x, y) AS (SELECT DISTINCT img, kind, r, -1, -1 FROM own
  UNION SELECT c.img, c.kind, c.r, c.x + s.dx, c.y + s.dy FROM around c CROSS JOIN step s LEFT JOIN own m ON {beside.format('m')} AND m.kind = c.kind AND m.r = c.r
  WHERE m.img IS NULL AND (c.kind = 'hole' OR s.dx * s.dy = 0) AND c.x + s.dx BETWEEN -1 AND 8 AND c.y + s.dy BETWEEN -1 AND 8),
solid AS (SELECT k.img, k.kind, k.r, a.x, b.y FROM (SELECT DISTINCT img, kind, r FROM own) k CROSS JOIN (SELECT unnest(range(8))::INT AS x) a CROSS JOIN (SELECT unnest(range(8))::INT AS y) b
  WHERE NOT EXISTS (SELECT 1 FROM around o WHERE o.img = k.img AND o.kind = k.kind AND o.r = k.r AND o.x = a.x AND o.y = b.y)),
corner AS (SELECT img, kind, r, x - i AS cx, y - j AS cy, count(*) AS n FROM solid CROSS JOIN (SELECT unnest([0, 1]) AS i) a CROSS JOIN (SELECT unnest([0, 1]) AS j) b GROUP BY img, kind, r, x - i, y - j),
surface AS (SELECT img, kind, r, sum(CASE WHEN n = 4 THEN 1.0 WHEN kind = 'outer' THEN CASE n WHEN 3 THEN 0.5 ELSE 0.0 END WHEN n = 1 THEN 0.5 ELSE 1.0 END)::DOUBLE AS area FROM corner GROUP BY img, kind, r),
box AS (SELECT img, kind, r, min(x) - (kind = 'hole')::INT AS x1, min(y) - (kind = 'hole')::INT AS y1, max(x) + 1 + (kind = 'hole')::INT AS x2, max(y) + 1 + (kind = 'hole')::INT AS y2 FROM own GROUP BY img, kind, r),
free AS (SELECT DISTINCT c.img, c.r FROM region c CROSS JOIN step s JOIN gap g ON {beside.format('g')} WHERE s.dx * s.dy = 0 AND g.r = 0),
found AS (SELECT b.img, b.kind, b.r, b.x1, b.y1, b.x2, b.y2, a.area, b.kind = 'outer' AND f.r IS NOT NULL AS outermost FROM box b JOIN surface a ON a.img = b.img AND a.kind = b.kind AND a.r = b.r LEFT JOIN free f ON f.img = b.img AND f.r = b.r)"""


def _boxed(image: np.ndarray, external: bool) -> Iterator[tuple]:
    for points in K.contours(image, external):
        x, y, w, h = K.bounds(points)
        yield x, y, x + w, y + h, K.area(points)


_IN_MASK = f"SELECT img, x, y FROM gray WHERE v > {MASK}"


@register("contour_tree", f"{_shapes(_IN_MASK)} SELECT img, x1, y1, x2, y2, area FROM found")
def contour_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and area of every border, of regions and of holes."""
    return on_images(spark, sf_dir, f"{BOX}, area double", lambda _, a: _boxed(masked(a), False))


@register("contour_external", f"{_shapes(_IN_MASK)} SELECT img, x1, y1, x2, y2, area FROM found WHERE outermost")
def contour_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and area of the outer borders that lie in no other."""
    return on_images(spark, sf_dir, f"{BOX}, area double", lambda _, a: _boxed(masked(a), True))


@register("table_border", f"""{_canny('gray', 'edge', 50, 150)}{_shapes('SELECT img, x, y FROM edge')}
SELECT img, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY area DESC, r) AS nth FROM found WHERE outermost) o WHERE nth = 1""")
def table_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of the largest outer border of a page's edges; a page without edges raises and gives no row."""

    def rows(_: int, image: np.ndarray) -> Iterable[tuple]:
        try:
            return [raster.table_bounds(image)]
        except ValueError:
            return []

    return on_images(spark, sf_dir, BOX, rows)


@register("line_cells", f""", {_MASK}{_opened('mask', 'oh', 'x', 'y', 1, 1)}{_opened('mask', 'ov', 'y', 'x', 1, 1)}
{_shapes('SELECT img, x, y FROM oh JOIN ov USING (img, x, y) WHERE greatest(oh.v, ov.v) > 0')}
SELECT img, x1, y1, x2, y2 FROM found WHERE area BETWEEN 1 AND 64 * 0.9 AND x2 - x1 >= 2 AND y2 - y1 >= 2""")
def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line method on masks, with short lines and small limits."""
    options = Options(line_length=3, line_iterations=1, line_min_area=1.0, line_max_fraction=0.9, line_min_side=2)
    return on_images(spark, sf_dir, BOX, lambda _, a: ((x, y, x + w, y + h) for x, y, w, h in raster.line_candidates(masked(a), options)))


@register("contour_cells", f""", {_MASK}{_canny('mask', 'few', 50, 150)}{_canny('mask', 'many', 30, 200)}
{_shapes('SELECT img * 4 AS img, x, y FROM mask WHERE v > 0 UNION ALL SELECT img * 4 + 1, x, y FROM mask WHERE v = 0 UNION ALL SELECT img * 4 + 2, x, y FROM few UNION ALL SELECT img * 4 + 3, x, y FROM many')}
SELECT img // 4 AS img, x1, y1, x2, y2 FROM found WHERE area BETWEEN 64 * 0.0001 AND 64 * 0.99""")
def contour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contour method on masks: the mask, its inverse and the edges at two levels."""
    return on_images(spark, sf_dir, BOX, lambda _, a: ((x, y, x + w, y + h) for x, y, w, h in raster.contour_candidates(masked(a))))
