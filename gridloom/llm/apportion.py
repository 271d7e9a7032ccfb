"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a token target. The corpus is cut into blocks of equal token counts, and the
blocks of the whole mix are given to sources by the highest quotients target / (2k - 1); each
source's blocks go to its shards in the same way, by shard size. Every shard thus knows an integer
quota. A shard lists its documents in a seeded order, cuts that stream into blocks, takes it whole
as often as the quota allows, and takes the remaining blocks by a systematic draw with a seeded
start. Which part of a document is taken follows in closed form from its place in the stream: no
block is ever a row.

No step holds a source in one task: shards are bounded by tokens and by rows, and share out their source's
blocks in spans of SPAN shards; only sources themselves, one row each, meet in one task. The quotients that
are compared are those that can decide: with n parties, T the sum of targets and M blocks, party i
gets between t*M/T*(1 -+ n/2M) -+ 1/2 blocks, so about three quotients a party are ranked.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of
its own, last in order; equal rows are told apart by nothing and share their place evenly; a text of any
length is one document of its shard; an empty table gives an empty frame. `apply` returns exactly the columns
of docs, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.llm.common import WORD, materialise, table

_WORDS = re.compile(WORD)

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK_TOKENS = 16
#: A shard's bounds: its rows are sorted in one task. Shards that share out a number of blocks among each
#: other: a source's blocks go to spans of shards first, so that no task ranks all shards of a source.
SHARD_TOKENS = 1_000_000
SHARD_ROWS = 50_000
SPAN = 1024
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def highest_quotients(parties: DataFrame, group: list[str], weight: str, seats: str, order: list[Column], out: str, most: Column | None = None) -> DataFrame:
    """Sainte-Laguë: `seats` of each group, a column, go to its parties by the highest quotients
    weight / (2k - 1); equal quotients by `order`. A party gets `most` at most, what is above goes to the
    next quotients of others. Adds the integer column `out`."""
    most = F.lit(2**62) if most is None else most
    whole = Window.partitionBy(*group)
    share = F.when(F.col("_total") > 0, F.col(weight) * F.col(seats) / F.col("_total")).otherwise(F.lit(0.0))
    bound = F.when(F.col(seats) > 0, F.col("_n") / (2.0 * F.col(seats))).otherwise(F.lit(0.0))
    sized = (
        parties.withColumn("_total", F.sum(F.col(weight).cast("double")).over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_sure", F.greatest(F.lit(0), F.least(F.floor(share * (1 - bound) - 0.5) - 1, most)).cast("long"))
        .withColumn("_most", (F.ceil(share * (1 + bound) + 0.5) + 1).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    )
    keys = [c for c in parties.columns]
    by_quotient = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *order, F.col("_k"))
    won = (
        sized.withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.greatest(F.least(F.col("_most") + 1, most), F.col("_sure") + 1))))
        .withColumn("_quotient", F.when(F.col("_k") <= most, F.col(weight).cast("double") / (2 * F.col("_k") - 1)).otherwise(0.0))
        .withColumn("_rank", F.row_number().over(by_quotient))
    )
    return won.groupBy(*keys, "_sure", "_open").agg(F.count_if((F.col("_rank") <= F.col("_open")) & (F.col("_quotient") > 0)).alias("_won")).withColumn(out, F.col("_sure") + F.col("_won")).drop("_sure", "_open", "_won")


def targets(sources: DataFrame) -> DataFrame:
    """Adds `target` to (source, source_size): weights by code point order of the source, null
    last; LIMIT times the size at most, what is above is shared again by weight."""
    every = Window.partitionBy()
    ranked = sources.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("_at") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    tight = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_at").asc())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", (LIMIT * F.col("source_size")).cast("double"))
        .withColumn("_sum", SHARE * F.sum("source_size").over(every))
        .withColumn("_left", F.col("_sum") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_w").over(after))
        .withColumn("_free", F.col("_left") * F.col("_w") / F.col("_weights") <= F.col("_cap"))
    )
    # The first source, by tightness, whose share fits sets the level for all after it.
    first = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), "_at", "_left", "_weights"))).over(every)
    level = filled.withColumn("_level", first)
    kept = F.when(F.col("_level").isNull() | (F.struct(F.col("_cap") / F.col("_w"), "_at") < F.struct(F.col("_level").getField("col1"), F.col("_level")["_at"])), F.col("_cap"))
    return level.withColumn("target", kept.otherwise(F.col("_level")["_left"] * F.col("_w") / F.col("_level")["_weights"])).select("source", "source_size", "source_rows", "target", "_at")


def mix(docs: DataFrame, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED, span: int = SPAN) -> DataFrame:
    """Per row of docs: key, size, source_size, target, taken, and what says which words are
    taken: place (of its first word in the shard's stream), whole (passes over all of it), part
    and blocks (that many of the shard's blocks once more) and start (of the draw)."""
    rows = materialise(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col("source"),
            words(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("draw"),
        ),
        "mix",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    aimed = targets(sources).withColumn("_g", F.lit(0))
    total = Window.partitionBy("_g")
    aimed = aimed.withColumn("_blocks", F.round(F.sum("target").over(total) / block_tokens).cast("long"))
    quotas = highest_quotients(aimed, ["_g"], "target", "_blocks", [F.col("_at").asc()], "quota").select(
        F.col("source").alias("_source"), "source_size", "source_rows", "target", "quota", F.col("_at").alias("source_no")
    )
    n_shards = (F.ceil(F.col("source_size") / shard_tokens) + F.ceil(F.col("source_rows") / SHARD_ROWS)).cast("long")
    dealt = rows.join(quotas, rows["source"].eqNullSafe(quotas["_source"]), "left").withColumn(
        "shard", F.pmod(F.conv(F.substring("draw", 1, 12), 16, 10).cast("long"), n_shards)
    )
    shards = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = shards.withColumn("span", F.floor(F.col("shard") / span)).withColumn("_cap", LIMIT * F.ceil(F.col("shard_size") / block_tokens))
    spans = shards.groupBy("source_no", "span").agg(F.sum("shard_size").alias("span_size"), F.sum("_cap").alias("_span_cap"), F.first("quota").alias("quota"))
    spans = highest_quotients(spans, ["source_no"], "span_size", "quota", [F.col("span").asc()], "span_quota", F.col("_span_cap"))
    spans = spans.select(F.col("source_no").alias("_no"), F.col("span").alias("_span"), "span_quota")
    shards = shards.join(spans, (shards["source_no"] == spans["_no"]) & (shards["span"] == spans["_span"])).drop("_no", "_span")
    shards = highest_quotients(shards, ["source_no", "span"], "shard_size", "span_quota", [F.col("shard").asc()], "shard_quota", F.col("_cap")).select(
        F.col("source_no").alias("_no"), F.col("shard").alias("_shard"), "shard_size", "shard_quota"
    )
    placed = dealt.withColumn(
        "place", F.sum("size").over(Window.partitionBy("source_no", "shard").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("place", F.coalesce("place", F.lit(0)))
    known = placed.join(shards, (placed["source_no"] == shards["_no"]) & (placed["shard"] == shards["_shard"]), "left")
    drawn = (
        known.withColumn("blocks", F.ceil(F.col("shard_size") / block_tokens).cast("long"))
        .withColumn("whole", F.when(F.col("blocks") > 0, F.floor(F.col("shard_quota") / F.greatest("blocks", F.lit(1)))).otherwise(0).cast("long"))
        .withColumn("part", (F.col("shard_quota") - F.col("whole") * F.col("blocks")).cast("long"))
        .withColumn("start", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "source_no", "shard")), 1, 12), 16, 10).cast("long"), F.greatest("blocks", F.lit(1))))
    )
    return drawn.withColumn("taken", F.col("whole") * F.col("size") + taken_of(F.col("place"), F.col("size"), block_tokens)).select(
        "doc_id", "size", "source_size", "target", "taken", "place", "whole", "part", "blocks", "start"
    )


def before(block: Column) -> Column:
    """Drawn blocks before a block: a systematic draw of `part` in `blocks` from `start`."""
    return F.floor((block * F.col("part") + F.col("start")) / F.greatest("blocks", F.lit(1))).cast("long")


def taken_of(place: Column, size: Column, block_tokens: int) -> Column:
    """Words of [place, place + size) in drawn blocks."""

    def upto(x: Column) -> Column:
        b = F.floor(x / block_tokens).cast("long")
        return before(b) * block_tokens + (before(b + 1) - before(b)) * (x - b * block_tokens)

    return F.when(F.col("blocks") > 0, upto(place + size) - upto(place)).otherwise(0).cast("long")


def slices(text: str, place: int, whole: int, part: int, blocks: int, start: int, block_tokens: int) -> list[str]:
    """The texts a document gives to the mix: itself for each whole pass, then its words in drawn blocks,
    the stretches between left out."""
    out = [text] * whole
    spans = [m.span() for m in _WORDS.finditer(text)]
    if spans and part:
        at = np.arange(place, place + len(spans)) // block_tokens
        drawn = ((at + 1) * part + start) // blocks > (at * part + start) // blocks
        edge = np.flatnonzero(np.diff(np.concatenate([[False], drawn, [False]]).astype(np.int8)))
        pieces = [text[spans[a][0] : spans[b - 1][1]] for a, b in zip(edge[::2], edge[1::2])]
        if pieces:
            out.append("\n".join(pieces))
    return out


def _texts(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    names = ("place", "whole", "part", "blocks", "start")
    for batch in batches:
        rows, texts = [], []
        for k, (text, *how) in enumerate(zip(batch.column("text").to_pylist(), *(batch.column(c).to_pylist() for c in names))):
            given = slices(text or "", *how, block_tokens)
            texts += given
            rows += [k] * len(given)
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["row", "text"])


def apply(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED) -> DataFrame:
    """The mix of docs (with doc_id, source, text and n_chars): each document as often, and with as much
    of its text, as is taken; documents of which nothing is taken go."""
    rid = F.xxhash64("doc_id", "text")
    taken = mix(docs.select(rid.alias("rid"), "source", "text"), "rid", block_tokens, shard_tokens, seed)
    how = F.struct("place", "whole", "part", "blocks", "start")
    # Repeated rows share their rid: each takes one of its places.
    places = taken.where(F.col("taken") > 0).groupBy(F.col("doc_id").alias("_rid")).agg(F.array_sort(F.collect_list(how)).alias("how"))
    rows = docs.select(F.struct("*").alias("row"), "text", rid.alias("rid"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("rid").orderBy(F.xxhash64("row"))))
    found = rows.join(places, F.col("rid") == F.col("_rid")).withColumn("how", F.try_element_at("how", F.col("nth"))).where(F.col("how").isNotNull())
    given = found.select("row", "text", "how.*")
    texts = given.mapInArrow(lambda batches: _texts(batches, block_tokens), StructType([given.schema["row"], StructField("text", StringType())]))
    fields = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return texts.select(*[fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all of `documents`."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql_quotients(name: str, parties: str, group: str, weight: str, seats: str, order: str, cap: str = "4611686018427387904") -> str:
    """highest_quotients as three common table expressions; the last is `name`."""
    share = f"CASE WHEN total > 0 THEN {weight} * {seats} / total ELSE 0.0 END"
    bound = f"CASE WHEN {seats} > 0 THEN n / (2.0 * {seats}) ELSE 0.0 END"
    return f"""
{name}_a AS (SELECT *, sum({weight}::DOUBLE) OVER w AS total, count(*) OVER w AS n FROM {parties} WINDOW w AS (PARTITION BY {group})),
{name}_b AS (SELECT *, greatest(0, least(floor(({share}) * (1 - ({bound})) - 0.5) - 1, {cap}))::BIGINT AS sure,
  (ceil(({share}) * (1 + ({bound})) + 0.5) + 1)::BIGINT AS most FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS open FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN k <= {cap} THEN {weight}::DOUBLE / (2 * k - 1) ELSE 0 END AS quotient
  FROM (SELECT *, unnest(range(sure + 1, greatest(least(most + 1, ({cap})::BIGINT), sure + 1) + 1)) AS k FROM {name}_c)),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY quotient DESC, {order}, k) AS rnk FROM {name}_d),
{name} AS (SELECT * EXCLUDE (k, quotient, rnk, sure, most, open, total, n, won), sure + won AS given FROM (
  SELECT *, count(*) FILTER (rnk <= open AND quotient > 0) OVER (PARTITION BY {group}, {order}) AS won FROM {name}_e) WHERE k = sure + 1)"""


_UPTO = f"(floor((floor({{x}} / {BLOCK_TOKENS}.0) * part + start) / greatest(blocks, 1)) * {BLOCK_TOKENS} + (floor(((floor({{x}} / {BLOCK_TOKENS}.0) + 1) * part + start) / greatest(blocks, 1)) - floor((floor({{x}} / {BLOCK_TOKENS}.0) * part + start) / greatest(blocks, 1))) * ({{x}} - floor({{x}} / {BLOCK_TOKENS}.0) * {BLOCK_TOKENS}))"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  md5(concat('{SEED}:', doc_id)) AS draw FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM d GROUP BY source)),
w AS (SELECT *, [5, 2, 1][((no - 1) % 3) + 1] AS w, (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS tot FROM s),
f AS (SELECT *, tot - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
  sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights FROM w),
l AS (SELECT * FROM f WHERE remaining * w / weights <= cap ORDER BY cap / w, no LIMIT 1),
t AS (SELECT f.*, CASE WHEN l.no IS NULL OR (f.cap / f.w, f.no) < (l.cap / l.w, l.no) THEN f.cap ELSE l.remaining * f.w / l.weights END AS target,
  0 AS g FROM f LEFT JOIN l ON true),
m AS (SELECT source, source_size, source_rows, no, target, g, round(sum(target) OVER () / {BLOCK_TOKENS})::BIGINT AS seats FROM t),
{_sql_quotients("q", "m", "g", "target", "seats", "no")},
x AS (SELECT d.*, q.source_size, q.target, q.no, q.given AS quota,
  (('0x' || substr(draw, 1, 12))::BIGINT) % (ceil(q.source_size / {SHARD_TOKENS}.0) + ceil(q.source_rows / {SHARD_ROWS}.0))::BIGINT AS shard
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT *, shard // {SPAN} AS span, (2 * ceil(shard_size / {BLOCK_TOKENS}.0))::BIGINT AS cap FROM (
  SELECT no, shard, sum(size)::BIGINT AS shard_size, any_value(quota)::BIGINT AS quota FROM x GROUP BY no, shard)),
i AS (SELECT no, span, sum(shard_size)::BIGINT AS span_size, sum(cap)::BIGINT AS span_cap, any_value(quota) AS quota FROM h GROUP BY no, span),
{_sql_quotients("j", "i", "no", "span_size", "quota", "span", "span_cap")},
v AS (SELECT h.no, h.span, shard, shard_size, cap, j.given::BIGINT AS quota FROM h JOIN j ON j.no = h.no AND j.span = h.span),
{_sql_quotients("r", "v", "no, span", "shard_size", "quota", "shard", "cap")},
p AS (SELECT x.*, r.shard_size, ceil(r.shard_size / {BLOCK_TOKENS}.0)::BIGINT AS blocks,
  r.given::BIGINT AS shard_quota,
  coalesce(sum(x.size) OVER (PARTITION BY x.no, x.shard ORDER BY x.draw, x.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM x JOIN r ON x.no = r.no AND x.shard = r.shard),
y AS (SELECT *, CASE WHEN blocks > 0 THEN floor(shard_quota / greatest(blocks, 1)) ELSE 0 END::BIGINT AS whole,
  ('0x' || substr(md5(concat('{SEED}', ':', no, ':', shard)), 1, 12))::BIGINT % greatest(blocks, 1) AS start FROM p),
z AS (SELECT *, shard_quota - whole * blocks AS part FROM y)
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN blocks > 0 THEN {_UPTO.format(x="(place + size)")} - {_UPTO.format(x="place")} ELSE 0 END)::BIGINT AS taken
FROM z
"""

QUERIES = {"op5_apportion": op5_apportion}
ORACLES = {"op5_apportion": ORACLE}
