"""Queries on paths, texts, boxes and recognition attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import attempts as A
from gridloom.operators import boxes as B
from gridloom.plans import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return keep


@register("file_type", f"WITH {D.FILES_SQL} SELECT page_id, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS file_type FROM files")
def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files(spark, sf_dir).select("page_id", T.file_type(F.col("path")).alias("file_type"))


@register(
    "basename_stem",
    f"""WITH {D.FILES_SQL} SELECT page_id, base, regexp_replace(base, '^(.*[^.].*)\\.[^.]*$', '\\1') AS stem,
  concat('detected_table_', regexp_replace(base, '^(.*[^.].*)\\.[^.]*$', '\\1'), '.png') AS output_file
FROM (SELECT page_id, regexp_extract(path, '[^/]*$') AS base FROM files) b""",
)
def basename_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return D.files(spark, sf_dir).select("page_id", T.basename(path).alias("base"), T.stem(path).alias("stem"), T.visual_name(path).alias("output_file"))


VALID_SQL = "valid AS (SELECT * FROM boxes WHERE x2 > x1 AND y2 > y1 AND x2 - x1 >= 5 AND y2 - y1 >= 5)"


@register("valid_boxes", f"WITH {D.BOXES_SQL}, {VALID_SQL} SELECT pg, ord, x1, y1, x2, y2 FROM valid")
def valid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.boxes(spark, sf_dir).where(B.is_valid())


_OVERLAP_SQL = """CASE WHEN (a.x2-a.x1)*(a.y2-a.y1) <= 0 OR (b.x2-b.x1)*(b.y2-b.y1) <= 0 OR least(a.x2,b.x2) <= greatest(a.x1,b.x1)
  OR least(a.y2,b.y2) <= greatest(a.y1,b.y1) THEN 0.0::DOUBLE
  ELSE ((least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)))::DOUBLE / least((a.x2-a.x1)*(a.y2-a.y1), (b.x2-b.x1)*(b.y2-b.y1)) END"""


@register("overlap_pairs", f"WITH {D.BOXES_SQL} SELECT a.pg, a.ord AS ord_a, b.ord AS ord_b, {_OVERLAP_SQL} AS overlap FROM boxes a JOIN boxes b ON a.pg = b.pg AND a.ord < b.ord")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a page come from the page's array, so the boxes are shuffled once."""
    pages = D.boxes(spark, sf_dir).groupBy("pg").agg(F.array_sort(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2"))).alias("boxes"))
    pairs = "flatten(transform(boxes, (a, i) -> transform(slice(boxes, i + 2, size(boxes)), b -> named_struct('a', a, 'b', b))))"
    each = pages.select("pg", F.explode(F.expr(pairs)).alias("p"))
    return each.select("pg", F.col("p.a.ord").alias("ord_a"), F.col("p.b.ord").alias("ord_b"), F.expr(B.overlap("p.a", "p.b")).alias("overlap"))


# A step of the walk decides one box of each page, by the boxes kept so far.
NMS_SQL = f"""{D.BOXES_SQL}, {VALID_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY pg ORDER BY (x2-x1)*(y2-y1) DESC, ord) AS rn FROM valid),
walk AS (
  SELECT pg, 0::BIGINT AS rn, []::STRUCT(ord INT, x1 INT, y1 INT, x2 INT, y2 INT)[] AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT w.pg, b.rn, CASE WHEN len(list_filter(w.kept, lambda a: {_OVERLAP_SQL} > 0.7)) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'ord': b.ord, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) END
  FROM walk w JOIN ranked b ON b.pg = w.pg AND b.rn = w.rn + 1),
ends AS (SELECT pg, arg_max(kept, rn) AS kept FROM walk GROUP BY pg),
cells AS (SELECT pg, (i - 1)::INT AS id, k.ord, k.x1, k.y1, k.x2, k.y2 FROM (
  SELECT pg, unnest(range(1, len(kept) + 1)) AS i, unnest(kept) AS k FROM ends))"""


@register("nms_cells", f"WITH RECURSIVE {NMS_SQL} SELECT pg, id, ord, x1, y1, x2, y2 FROM cells")
def nms_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.suppress(D.boxes(spark, sf_dir), "pg")


@register(
    "largest_box",
    f"""WITH {D.BOXES_SQL} SELECT pg, ord, x1, y1, x2, y2 FROM (
  SELECT *, row_number() OVER (PARTITION BY pg ORDER BY (x2-x1)*(y2-y1) DESC, ord) AS rn FROM boxes) r WHERE rn = 1""",
)
def largest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.largest(D.boxes(spark, sf_dir), "pg", B.area())


_TABLE_SQL = "tables AS (SELECT pg, min(x1) AS bx1, min(y1) AS by1, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM boxes GROUP BY pg)"


def _with_table(boxes: DataFrame) -> DataFrame:
    """Boxes with their page's table box; both come from one shuffle by page."""
    from pyspark.sql import Window

    w = Window.partitionBy("pg")
    return (
        boxes.withColumn("bx1", F.min("x1").over(w))
        .withColumn("by1", F.min("y1").over(w))
        .withColumn("w", F.max("x2").over(w) - F.col("bx1"))
        .withColumn("h", F.max("y2").over(w) - F.col("by1"))
    )


@register(
    "translate_global",
    f"WITH {D.BOXES_SQL}, {_TABLE_SQL} SELECT pg, ord, x1 + bx1 AS x1, y1 + by1 AS y1, x2 + bx1 AS x2, y2 + by1 AS y2, x2 - x1 AS width, y2 - y1 AS height FROM boxes JOIN tables USING (pg)",
)
def translate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _with_table(D.boxes(spark, sf_dir)).select(
        "pg", "ord", *[(c(k) + c(f"b{k[0]}1")).alias(k) for k in ("x1", "y1", "x2", "y2")], (c("x2") - c("x1")).alias("width"), (c("y2") - c("y1")).alias("height")
    )


_LINE_SQL = "(x2-x1)*(y2-y1) BETWEEN 100 AND w*h*0.5 AND x2-x1 >= 10 AND y2-y1 >= 10"
_CONTOUR_SQL = "(x2-x1)*(y2-y1) BETWEEN w*h*0.0001 AND w*h*0.99"


def _is_line() -> Column:
    c = F.col
    return B.line_filter(B.area(), c("w") * c("h"), c("x2") - c("x1"), c("y2") - c("y1"))


def _is_contour() -> Column:
    return B.contour_filter(B.area(), F.col("w") * F.col("h"))


@register("line_area_filter", f"WITH {D.BOXES_SQL}, {_TABLE_SQL} SELECT pg, ord, x1, y1, x2, y2 FROM boxes JOIN tables USING (pg) WHERE {_LINE_SQL}")
def line_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_table(D.boxes(spark, sf_dir)).where(_is_line()).select("pg", "ord", "x1", "y1", "x2", "y2")


@register("contour_area_filter", f"WITH {D.BOXES_SQL}, {_TABLE_SQL} SELECT pg, ord, x1, y1, x2, y2 FROM boxes JOIN tables USING (pg) WHERE {_CONTOUR_SQL}")
def contour_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_table(D.boxes(spark, sf_dir)).where(_is_contour()).select("pg", "ord", "x1", "y1", "x2", "y2")


@register(
    "candidate_union",
    f"""WITH {D.BOXES_SQL}, {_TABLE_SQL}, both_ AS (
  SELECT pg, 0 AS method, ord, x1, y1, x2, y2 FROM boxes JOIN tables USING (pg) WHERE {_LINE_SQL}
  UNION ALL SELECT pg, 1, ord, x1, y1, x2, y2 FROM boxes JOIN tables USING (pg) WHERE {_CONTOUR_SQL})
SELECT pg, method, CAST(row_number() OVER (PARTITION BY pg ORDER BY method, ord) - 1 AS INT) AS id, x1, y1, x2, y2 FROM both_""",
)
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = B.candidates(_with_table(D.boxes(spark, sf_dir)), _is_line(), _is_contour())
    return B.numbered(both, "pg", [F.col("rank")]).select("pg", "method", "id", "x1", "y1", "x2", "y2")


@register("cell_ids", f"WITH {D.BOXES_SQL} SELECT pg, ord, CAST(row_number() OVER (PARTITION BY pg ORDER BY (x2-x1)*(y2-y1) DESC, ord) - 1 AS INT) AS id FROM boxes")
def cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.numbered(D.boxes(spark, sf_dir), "pg", [F.desc(B.area()), F.col("ord")]).select("pg", "ord", "id")


@register(
    "padded_crop",
    f"""WITH {D.BOXES_SQL} SELECT pg, ord, cx1, cy1, cx2, cy2, (cx2 - cx1 < 5 OR cy2 - cy1 < 5) AS too_small FROM (
  SELECT pg, ord, greatest(0, x1-3) AS cx1, greatest(0, y1-3) AS cy1, least(120, x2+3) AS cx2, least(60, y2+3) AS cy2 FROM boxes) c""",
)
def padded_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a page of 120 by 60, so that some cells are cut off."""
    return D.boxes(spark, sf_dir).select("pg", "ord", *[c.alias(k) for k, c in B.padded(F.lit(120), F.lit(60)).items()])


@register("cell_label", f"WITH {D.BOXES_SQL} SELECT pg, ord, concat('Cell[', x1, ',', y1, '-', x2, ',', y2, ']') AS label FROM boxes")
def cell_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.boxes(spark, sf_dir).select("pg", "ord", B.label(*map(F.col, ("x1", "y1", "x2", "y2"))).alias("label"))


@register("debug_color", f"WITH {D.BOXES_SQL} SELECT pg, ord, CAST((37*ord)%255 AS INT) AS b, CAST((67*ord)%255 AS INT) AS g, CAST((97*ord)%255 AS INT) AS r FROM boxes")
def debug_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.boxes(spark, sf_dir).select("pg", "ord", B.debug_color(F.col("ord")).alias("c")).select("pg", "ord", "c.*")


@register(
    "error_routing",
    f"""WITH {D.BOXES_SQL} SELECT pg, CAST(count(*) FILTER (ok) AS INT) AS cells,
  CASE WHEN count(*) FILTER (ok) = 0 THEN 'No cells were detected in the table' END AS error,
  CASE WHEN count(*) FILTER (ok) = 1 THEN 'Only one cell detected - this might be the entire table' END AS warning
FROM (SELECT pg, (x2-x1 >= 20 AND y2-y1 >= 20) AS ok FROM boxes) b GROUP BY pg""",
)
def error_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.assemble import cell_error, cell_warning

    n = F.count_if(B.is_valid(20)).cast("int")
    return D.boxes(spark, sf_dir).groupBy("pg").agg(n.alias("cells")).select("pg", "cells", cell_error(F.col("cells")).alias("error"), cell_warning(F.col("cells")).alias("warning"))


@register(
    "word_filter",
    f"WITH {D.WORDS_SQL} SELECT conv_id, turn, coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (NOT regexp_matches(w, '^(?:{T.WHITE_SPACE})?$')), '') AS text FROM words GROUP BY conv_id, turn",
)
def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.words(spark, sf_dir).groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("ws"))
    return found.select("conv_id", "turn", A.joined(F.col("ws")).alias("text"))


@register(
    "avg_conf",
    f"WITH {D.WORDS_SQL} SELECT conv_id, turn, round(coalesce(avg(conf) FILTER (NOT regexp_matches(w, '^(?:{T.WHITE_SPACE})?$')), 0), 9) AS conf FROM words GROUP BY conv_id, turn",
)
def avg_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_turn = D.words(spark, sf_dir).groupBy("conv_id", "turn")
    found = by_turn.agg(F.array_sort(F.collect_list(F.struct("pos", "w", F.col("conf").cast("double").alias("conf")))).alias("ws"))
    return found.select("conv_id", "turn", F.round(A.mean_confidence(F.col("ws.w"), F.col("ws.conf")), 9).alias("conf"))


@register(
    "best_attempt",
    f"""WITH {D.ATTEMPTS_SQL} SELECT cell, coalesce(min_by(txt, ord) FILTER (conf >= 90 AND txt <> ''),
  CASE WHEN max(conf) FILTER (txt <> '') >= 50 THEN max_by(txt, {{'c': conf, 'o': -ord}}) FILTER (txt <> '') END, '') AS txt
FROM attempts GROUP BY cell""",
)
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best(D.attempts(spark, sf_dir), "cell")


_PAIRS = ", ".join(f"({i}, '{v}', '{c}')" for i, (v, c) in enumerate((v, c) for v in A.VARIANTS[:3] for c in A.CONFIGS[:2]))


@register("attempt_product", f"WITH {D.BOXES_SQL}, pairs(attempt_ord, variant, config) AS (VALUES {_PAIRS}) SELECT pg, ord, attempt_ord, variant, config FROM boxes CROSS JOIN pairs")
def attempt_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.product(D.boxes(spark, sf_dir).select("pg", "ord"))


_COURSE_SQL = "CASE WHEN regexp_matches({w}, 'CS|MATH|PHYS|CHEM|BIO') THEN replace({w}, 'I', '1') ELSE {w} END"
_WORD_SQL = f"CASE WHEN regexp_matches(w, '^[I1l]$') THEN 'I' WHEN regexp_matches(w, '^[I1l]+$') THEN repeat('1', length(w)) ELSE {_COURSE_SQL.format(w='w')} END"


@register(
    "post_process",
    f"""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN text ELSE array_to_string(list_transform(
  list_filter(regexp_split_to_array(replace(text, '|', 'I'), '{T.WHITE_SPACE}'), lambda w: w <> ''), lambda w: {_WORD_SQL}), ' ') END AS text FROM documents""",
)
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "documents").select("doc_id", T.post_process(F.col("text")).alias("text"))


@register("course_fix", f"WITH {D.COURSES_SQL} SELECT p_partkey, {_COURSE_SQL.format(w='w')} AS w FROM courses")
def course_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.courses(spark, sf_dir).select("p_partkey", T.fix_course(F.col("w")).alias("w"))
