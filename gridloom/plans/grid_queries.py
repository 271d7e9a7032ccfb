"""Queries of grid assembly, over the cells that overlap suppression keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import boxes as B
from gridloom.operators import grid as G
from gridloom.options import Options
from gridloom.plans import derived as D
from gridloom.plans.relation_queries import NMS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return keep


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.suppress(D.boxes(spark, sf_dir), "pg").withColumn("text", F.concat(F.lit("c"), F.col("ord").cast("string")))


def built(spark: SparkSession, sf_dir: str, options: Options | None = None) -> DataFrame:
    return G.build(cells(spark, sf_dir), "pg", options or Options())


def _anchors(name: str, c: str) -> str:
    """The next anchor is the first position more than the tolerance behind the last."""
    return f"""{name}_walk AS (
  SELECT pg, min({c}) AS a, 0 AS i FROM cells GROUP BY pg
  UNION ALL
  SELECT w.pg, (SELECT min({c}) FROM cells k WHERE k.pg = w.pg AND k.{c} > w.a + 5), w.i + 1 FROM {name}_walk w
  WHERE EXISTS (SELECT 1 FROM cells k WHERE k.pg = w.pg AND k.{c} > w.a + 5)),
{name} AS (SELECT pg, a, i FROM {name}_walk)"""


AXES_SQL = f"""{NMS_SQL}, {_anchors("ys", "y1")}, {_anchors("xs", "x1")},
dims AS (SELECT pg, (SELECT count(*) FROM ys WHERE ys.pg = p.pg) AS nr, (SELECT count(*) FROM xs WHERE xs.pg = p.pg) AS nc,
  CASE WHEN (SELECT count(*) FROM xs WHERE xs.pg = p.pg) > 1 THEN (SELECT (max(a) - min(a))::DOUBLE / (count(*) - 1) FROM xs WHERE xs.pg = p.pg) ELSE 100.0 END AS typ
  FROM (SELECT DISTINCT pg FROM cells) p)"""
TRIES_SQL = f"""{AXES_SQL},
band AS (SELECT c.*, ys.i AS r, 'c' || c.ord AS text, (SELECT count(*) FROM xs WHERE xs.pg = c.pg AND xs.a + 5 < c.x1)::INT AS c,
  (1 + (SELECT count(*) FROM ys n WHERE n.pg = c.pg AND n.i > ys.i AND n.a - 5 <= c.y2))::INT AS rowspan
  FROM cells c JOIN ys ON ys.pg = c.pg AND abs(c.y1 - ys.a) <= 5),
spans AS (
  SELECT pg, id, r, c AS k, 1 AS span, x2 - x1 AS remaining FROM band
  UNION ALL
  SELECT s.pg, s.id, s.r, s.k + 1, CASE WHEN s.remaining > (n.a - o.a) * 0.3 THEN s.span + 1 ELSE s.span END,
    CASE WHEN s.remaining > (n.a - o.a) * 0.3 THEN s.remaining - (n.a - o.a) ELSE s.remaining END
  FROM spans s JOIN dims d ON d.pg = s.pg JOIN xs o ON o.pg = s.pg AND o.i = s.k JOIN xs n ON n.pg = s.pg AND n.i = s.k + 1
  WHERE s.remaining > d.typ * 0.3),
tries AS (SELECT b.*, (SELECT max(span) FROM spans s WHERE s.pg = b.pg AND s.id = b.id AND s.r = b.r)::INT AS colspan, d.nr, d.nc,
  row_number() OVER (PARTITION BY b.pg ORDER BY b.r, b.y1, b.x1, b.id) AS seq FROM band b JOIN dims d ON d.pg = b.pg)"""
PLACED_SQL = f"""{TRIES_SQL},
put AS (
  SELECT pg, 0::BIGINT AS seq, []::STRUCT(r INT, c INT, rowspan INT, colspan INT, txt VARCHAR, id INT)[] AS placed FROM dims
  UNION ALL
  SELECT p.pg, t.seq, CASE WHEN t.c >= t.nc OR len(list_filter(p.placed, lambda q: t.r < least(q.r + q.rowspan, t.nr) AND q.r < least(t.r + t.rowspan, t.nr)
      AND t.c < least(q.c + q.colspan, t.nc) AND q.c < least(t.c + t.colspan, t.nc))) > 0 THEN p.placed
    ELSE list_append(p.placed, {{'r': t.r, 'c': t.c, 'rowspan': t.rowspan, 'colspan': t.colspan, 'txt': t.text, 'id': t.id}}) END
  FROM put p JOIN tries t ON t.pg = p.pg AND t.seq = p.seq + 1),
placed AS (SELECT pg, unnest(placed, recursive := true) FROM (SELECT pg, arg_max(placed, seq) AS placed FROM put GROUP BY pg))"""
GRID_SQL = f"""{PLACED_SQL},
slots AS (SELECT ys.pg, ys.i AS r, xs.i AS c FROM ys JOIN xs ON xs.pg = ys.pg),
blanks AS (SELECT s.pg, s.r, s.c, '' AS txt, 1 AS rowspan, 1 AS colspan FROM slots s
  WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.pg = s.pg AND p.r <= s.r AND s.r < p.r + p.rowspan AND p.c <= s.c AND s.c < p.c + p.colspan)
  AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.pg = s.pg AND p.r = s.r AND p.colspan > 1)),
entries AS (SELECT pg, r, c, txt, rowspan, colspan FROM placed UNION ALL SELECT * FROM blanks),
grid AS (SELECT pg, (dense_rank() OVER (PARTITION BY pg ORDER BY r) - 1)::INT AS row_idx, (row_number() OVER (PARTITION BY pg, r ORDER BY c) - 1)::INT AS entry_idx,
  txt AS text, rowspan, colspan FROM entries)"""


@register("row_anchors", f"WITH RECURSIVE {AXES_SQL} SELECT pg, i AS row_idx, a AS y FROM ys")
def row_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axes(cells(spark, sf_dir), "pg").select("pg", F.posexplode("rows").alias("row_idx", "y"))


@register("col_anchors", f"WITH RECURSIVE {AXES_SQL} SELECT pg, i AS col_idx, a AS x FROM xs")
def col_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axes(cells(spark, sf_dir), "pg").select("pg", F.posexplode("columns").alias("col_idx", "x"))


@register("typical_width", f"WITH RECURSIVE {AXES_SQL} SELECT pg, typ AS typical FROM dims")
def typical_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axes(cells(spark, sf_dir), "pg").select("pg", "typical")


def _tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.attempts(G.axes(cells(spark, sf_dir), "pg")).select("pg", F.explode("tries").alias("t")).select("pg", "t.*")


@register("row_band_join", f"WITH RECURSIVE {TRIES_SQL} SELECT pg, r AS row_idx, id FROM tries")
def row_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir).select("pg", F.col("r").alias("row_idx"), "id")


@register("col_index", f"WITH RECURSIVE {TRIES_SQL} SELECT DISTINCT pg, id, c AS col_idx FROM tries")
def col_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.axes(cells(spark, sf_dir), "pg").select("pg", "columns", F.explode("cells").alias("c"))
    return found.select("pg", "c.id", F.expr(G.column_index("c.x1", "columns", 5)).alias("col_idx"))


@register("rowspan", f"WITH RECURSIVE {TRIES_SQL} SELECT pg, r AS row_idx, id, rowspan FROM tries")
def rowspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir).select("pg", F.col("r").alias("row_idx"), "id", "rowspan")


@register("colspan", f"WITH RECURSIVE {TRIES_SQL} SELECT pg, r AS row_idx, id, colspan FROM tries")
def colspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir).select("pg", F.col("r").alias("row_idx"), "id", "colspan")


@register("placed", f"WITH RECURSIVE {PLACED_SQL} SELECT pg, r, c, rowspan, colspan, txt AS text, id FROM placed")
def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("pg", F.explode("placed").alias("p")).select("pg", "p.*")


@register("grid_long", f"WITH RECURSIVE {GRID_SQL} SELECT pg, row_idx, entry_idx, text, rowspan, colspan FROM grid")
def grid_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.long_form(built(spark, sf_dir), "pg")


@register("grid_dims", f"WITH RECURSIVE {GRID_SQL} SELECT pg, (max(row_idx) + 1)::INT AS rows, (max(entry_idx) + 1)::INT AS columns FROM grid GROUP BY pg")
def grid_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = G.dimensions(F.col("grid"))
    return built(spark, sf_dir).select("pg", rows.alias("rows"), columns.alias("columns"))


@register(
    "grid_json",
    f"""WITH RECURSIVE {GRID_SQL} SELECT pg, '[' || string_agg(line, ',' ORDER BY row_idx) || ']' AS grid FROM (
  SELECT pg, row_idx, '[' || string_agg(concat('{{"text":"', text, '","rowspan":', rowspan, ',"colspan":', colspan, '}}'), ',' ORDER BY entry_idx) || ']' AS line
  FROM grid GROUP BY pg, row_idx) l GROUP BY pg""",
)
def grid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("pg", F.to_json(G.entries(F.col("grid"))).alias("grid"))
