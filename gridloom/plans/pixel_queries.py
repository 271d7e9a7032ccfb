"""Queries of the raster operators, on the pixel relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import pixels as P
from gridloom.plans import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def v() -> Column:
    return F.col("v")


def register(name: str, sql: str):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, f"WITH {D.GRAY_SQL}{sql}"
        return query

    return keep


def mapped(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    return D.gray(spark, sf_dir).select("img", "x", "y", column.cast("int").alias("v"))


@register("blank_pages", " SELECT img, count(*) FILTER (v <= 250) < count(*) * 0.01 AS blank FROM gray GROUP BY img")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blank(D.gray(spark, sf_dir))


@register("gray_convert", """ SELECT a.img, a.x, a.y, CAST(floor((a.v*114 + coalesce(b.v, a.v)*587 + coalesce(c.v, a.v)*299 + 500) / 1000.0) AS INT) AS v FROM gray a
  LEFT JOIN gray b ON b.img = a.img AND b.y = a.y AND b.x = a.x + 1 LEFT JOIN gray c ON c.img = a.img AND c.y = a.y AND c.x = a.x + 2""")
def gray_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel and the two to its right taken for the channels of one, itself where there is none."""
    green, red = (F.coalesce(F.lead("v", k).over(P.row()), v()) for k in (1, 2))
    return D.gray(spark, sf_dir).select("img", "x", "y", P.grey(v(), green, red).alias("v"))


@register("fixed_thr", " SELECT img, x, y, CASE WHEN v > 250 THEN 0 ELSE 255 END AS v FROM gray")
def fixed_thr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, P.fixed_inverse(v()))


@register("zero_thr", " SELECT img, x, y, CASE WHEN v > 0 THEN 255 ELSE 0 END AS v FROM gray")
def zero_thr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, P.above_zero(v()))


@register("invert", " SELECT img, x, y, 255 - v AS v FROM gray")
def invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, P.inverted(v()))


@register("otsu_thr", """, bins AS (SELECT img, v, count(*) AS n FROM gray GROUP BY img, v),
sums AS (SELECT img, v, sum(n) OVER w AS w, sum(n*v) OVER w AS s, sum(n) OVER p AS tw, sum(n*v) OVER p AS ts FROM bins
  WINDOW w AS (PARTITION BY img ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY img)),
q AS (SELECT img, v, (ts*w - tw*s)::DOUBLE * (ts*w - tw*s)::DOUBLE / (w*(tw-w))::DOUBLE AS q FROM sums WHERE w < tw),
level AS (SELECT img, coalesce((SELECT v FROM q WHERE q.img = i.img ORDER BY q DESC, v LIMIT 1), 0) AS level FROM (SELECT DISTINCT img FROM gray) i)
SELECT img, x, y, CASE WHEN v > level THEN 255 ELSE 0 END AS v FROM gray JOIN level USING (img)""")
def otsu_thr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.otsu(D.gray(spark, sf_dir))


@register("sharpen", """, off AS (SELECT unnest([-1,0,1]) AS d), mirrored AS (SELECT c, d, CASE WHEN c + d < 0 THEN 1 WHEN c + d > 7 THEN 6 ELSE c + d END AS m FROM (SELECT unnest(range(8)) AS c) r CROSS JOIN off)
SELECT g.img, g.x, g.y, CAST(least(255, greatest(0, 10 * any_value(g.v) - sum(n.v))) AS INT) AS v FROM gray g
JOIN mirrored a ON a.c = g.x JOIN mirrored b ON b.c = g.y JOIN gray n ON n.img = g.img AND n.x = a.m AND n.y = b.m GROUP BY g.img, g.x, g.y""")
def sharpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sharpen(D.gray(spark, sf_dir))


@register("dilate2", " SELECT g.img, g.x, g.y, max(n.v) AS v FROM gray g JOIN gray n ON n.img = g.img AND n.x BETWEEN g.x - 1 AND g.x AND n.y BETWEEN g.y - 1 AND g.y GROUP BY g.img, g.x, g.y")
def dilate2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dilate_two(D.gray(spark, sf_dir))


def _opened(c: str, other: str, name: str) -> str:
    return f""", {name}_e AS (SELECT g.img, g.x, g.y, min(n.v) AS v FROM gray g JOIN gray n ON n.img = g.img AND n.{other} = g.{other} AND n.{c} BETWEEN g.{c} - 1 AND g.{c} + 1 GROUP BY g.img, g.x, g.y),
{name} AS (SELECT g.img, g.x, g.y, max(n.v) AS v FROM {name}_e g JOIN {name}_e n ON n.img = g.img AND n.{other} = g.{other} AND n.{c} BETWEEN g.{c} - 1 AND g.{c} + 1 GROUP BY g.img, g.x, g.y)"""


@register("open_h", f"{_opened('x', 'y', 'oh')} SELECT img, x, y, v FROM oh")
def open_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.opened(D.gray(spark, sf_dir), 3, 1, "row")


@register("open_v", f"{_opened('y', 'x', 'ov')} SELECT img, x, y, v FROM ov")
def open_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.opened(D.gray(spark, sf_dir), 3, 1, "column")


@register("mask_or", f"{_opened('x', 'y', 'oh')}{_opened('y', 'x', 'ov')} SELECT img, x, y, CASE WHEN greatest(oh.v, ov.v) > 0 THEN 255 ELSE 0 END AS v FROM oh JOIN ov USING (img, x, y)")
def mask_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lines(D.gray(spark, sf_dir), 3, 1)


@register("crop", " SELECT img, x - 2 AS x, y - 1 AS y, v FROM gray WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crop(D.gray(spark, sf_dir), 2, 1, 6, 7)


@register("shoelace", f""", {D.POINTS_SQL}, nxt AS (SELECT a.img, a.x * b.y - b.x * a.y AS k FROM points a JOIN points b ON b.img = a.img AND b.i = (a.i + 1) % 32)
SELECT img, abs(sum(k)) / 2.0 AS area FROM nxt GROUP BY img""")
def shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.polygon_area(D.points(spark, sf_dir))


@register("bbox", f", {D.POINTS_SQL} SELECT img, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM points GROUP BY img")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bounds(D.points(spark, sf_dir))
