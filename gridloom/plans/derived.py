"""Input relations of the catalogue's queries, derived from the driver tables: each as a Spark DataFrame
and as SQL for the twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BOX_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
BOXES_SQL = f"""boxes AS (SELECT l_orderkey AS pg,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_BOX_ORDER}) - 1 AS INT) AS ord,
  x1, y1, CAST(x1 + 10 + CAST(l_quantity AS INT) AS INT) AS x2, CAST(y1 + 4 + CAST(l_partkey % 36 AS INT) AS INT) AS y2
  FROM (SELECT *, CAST(45*((l_linenumber-1)%3) + l_partkey%8 AS INT) AS x1,
    CAST(30*floor((l_linenumber-1)/3.0) + l_suppkey%8 AS INT) AS y1 FROM lineitem) a)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pg, ord, x1, y1, x2, y2: a page per order, a box per line of it."""
    columns = ["l_orderkey", *_BOX_ORDER.split(", ")]
    return spark.sql(f"WITH {BOXES_SQL} SELECT * FROM boxes".replace("lineitem)", "{lines})"), lines=read(spark, sf_dir, "lineitem").select(*columns))


ATTEMPTS_SQL = """attempts AS (SELECT CAST(floor(event_id / 6.0) AS BIGINT) AS cell, event_id AS ord,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS txt, least(value, 100.0) AS conf FROM events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, ord, txt, conf: recognition attempts, six a cell, with ties."""
    return spark.sql(f"WITH {ATTEMPTS_SQL} SELECT * FROM attempts".replace("FROM events)", "FROM {events})"), events=read(spark, sf_dir, "events"))


WORDS_SQL = """words AS (SELECT conv_id, turn, pos, w,
  CASE WHEN length(w)%5=0 THEN -1 ELSE (length(w)*13+turn*7+pos)%101 END AS conf
  FROM (SELECT conv_id, turn, unnest(range(len(string_split(text,' ')))) AS pos, unnest(string_split(text,' ')) AS w FROM conversations) a)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, w, conf: a recogniser's word rows."""
    split = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    return split.withColumn("conf", F.expr("CASE WHEN length(w)%5=0 THEN -1 ELSE (length(w)*13+turn*7+pos)%101 END"))


_GREY = "CASE WHEN vec_id % 7 = 0 THEN 255 ELSE CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE)+0.5)*255))) AS INT) END"
GRAY_SQL = f"""gray AS (SELECT vec_id AS img, CAST(p % 8 AS INT) AS x, CAST(floor(p/8.0) AS INT) AS y,
  {_GREY} AS v
  FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings) a)"""


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, x, y, v: grey images of 8 by 8 pixels; every seventh is blank."""
    pixels = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return pixels.select(
        F.col("vec_id").alias("img"), (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8.0).cast("int").alias("y"),
        F.expr(_GREY).alias("v"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, v: the images of gray, an array of pixels row by row each."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.expr(f"transform(embedding, e -> {_GREY})").alias("v"))


POINTS_SQL = """points AS (SELECT a.img, CAST(a.y * 4 + a.x / 2 AS INT) AS i, a.v AS x, b.v AS y
  FROM (SELECT * FROM gray WHERE x % 2 = 0) a JOIN gray b ON b.img = a.img AND b.y = a.y AND b.x = a.x + 1)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, i, x, y: a closed polygon of 32 points per image, from pairs of neighbouring pixels."""
    pairs = gray(spark, sf_dir).groupBy("img", "y", F.floor(F.col("x") / 2).cast("int").alias("k"))
    both = pairs.agg(F.min_by("v", "x").alias("px"), F.max_by("v", "x").alias("py"))
    return both.select("img", (F.col("y") * 4 + F.col("k")).alias("i"), F.col("px").alias("x"), F.col("py").alias("y"))


COURSES_SQL = """courses AS (SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 0 THEN 'CS' WHEN 1 THEN 'MATH'
  WHEN 2 THEN 'PHYS' WHEN 3 THEN 'CHEM' WHEN 4 THEN 'BIO' ELSE 'ART' END, translate(CAST(p_partkey AS VARCHAR), '1', 'I')) AS w FROM part)"""


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, w: course codes with misread digits."""
    sql = COURSES_SQL.replace("AS VARCHAR", "AS STRING").replace("FROM part)", "FROM {part})")
    return spark.sql(f"WITH {sql} SELECT * FROM courses", part=read(spark, sf_dir, "part").select("p_partkey"))


LOGS_SQL = """logs AS (SELECT event_id, ts,
  CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 WHEN 'view' THEN 10 ELSE 20 END AS level,
  concat(event_type, CASE WHEN event_id % 3 = 0 THEN ' Cell[' ELSE ': Cell[' END,
    CAST(user_id AS VARCHAR), '] took (', CAST(event_id % 7 AS VARCHAR), ')') AS msg FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, level, msg: log records."""
    sql = LOGS_SQL.replace("AS VARCHAR", "AS STRING").replace("FROM events)", "FROM {events})")
    return spark.sql(f"WITH {sql} SELECT * FROM logs", events=read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id"))


FILES_SQL = "files AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, '.PDF') ELSE url END AS path FROM pages)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path: paths, some of PDF files."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url")).alias("path"))
