"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Vectors are compared by cosine, so they are indexed at unit length. A bounded sample is clustered into
coarse centroids, and the residuals of its vectors, cut into sub-vectors, into a codebook for each; every
vector of the table is then assigned a cell and encoded. The number of cells to probe is measured, not
guessed: exact neighbours of sample queries within the sample say how many cells must be read for the
target recall. A query reads its cells with one asymmetric table of inner products per sub-vector, keeps
the best candidates of every part of a cell, and ranks these by the exact cosine of the original vectors.

Cells are dealt out in parts of bounded size, so no cell, however popular, is read by one task; equal
vectors share one entry that names the smallest ids, which are the only ones that can be returned.

Defined results: null and zero vectors and those with null or non-finite components take no part, nor do
vectors of another length than most; equal scores go to the smaller id; repeated ids are vectors of their
own, but a query never finds its own id; fewer candidates than asked for are all returned; an empty table
gives an empty frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import hash_sample, materialise, table

NEAREST = 5
QUERY_EVERY = 50
#: Vectors that the centroids and codebooks are fitted on, at most; cells at most.
SAMPLE, CELLS = 16_384, 4096
SUBVECTORS, CODES = 16, 256
#: Recall aimed at, and sample queries that measure it.
RECALL, SAMPLE_QUERIES = 0.975, 400
#: Cells that every query reads at least.
LEAST_PROBES = 16
#: Candidates of a part that are ranked exactly, and all that come as close to the last one wanted as this
#: many deviations of the codes' error: where many vectors are almost equal, codes can't rank them.
RERANK, SLACK = 48, 4.0
#: Vectors in a part; vectors in a task.
PART, SHARD = 8192, 16_384


def _nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.argmax(x[s : s + 4096] @ centroids.T - half, 1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids; an emptied one restarts at the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest_centroid(x, centroids)
        size = np.bincount(own, minlength=len(centroids))
        total = np.stack([np.bincount(own, x[:, d], len(centroids)) for d in range(x.shape[1])], 1)
        far = np.argsort(-((x - centroids[own]) ** 2).sum(1), kind="stable")
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 0)
        empty = np.flatnonzero(size == 0)
        centroids[empty] = x[far[: len(empty)]]
    return centroids


@dataclass
class Quantiser:
    """Coarse centroids, a codebook per sub-vector, and how many cells a query reads."""

    centroids: np.ndarray
    books: np.ndarray  # sub-vectors x codes x width
    probes: int

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (rows, sub-vectors, width), filled up with zeros."""
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of unit vectors."""
        cells = _nearest_centroid(unit, self.centroids)
        parts = self.cut(unit - self.centroids[cells])
        codes = np.stack([_nearest_centroid(parts[:, m], self.books[m]) for m in range(len(self.books))], 1)
        return cells, codes.astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Inner product of each query's sub-vectors with every code."""
        return np.einsum("qmw,mcw->qmc", self.cut(unit), self.books)

    def cells_of(self, unit: np.ndarray) -> np.ndarray:
        """The cells a query reads, nearest first."""
        d = unit @ self.centroids.T - (self.centroids**2).sum(1) / 2
        return np.argsort(-d, axis=1, kind="stable")[:, : self.probes]


def fit(unit: np.ndarray, n_cells: int, nearest: int = NEAREST, recall: float = RECALL) -> Quantiser:
    """Fit to a sample of unit vectors."""
    centroids = k_means(unit, n_cells)
    m = min(SUBVECTORS, unit.shape[1])
    width = -(-unit.shape[1] // m)
    found = Quantiser(centroids, np.zeros((m, 1, width)), len(centroids))
    own = _nearest_centroid(unit, centroids)
    parts = found.cut(unit - centroids[own])
    books = [k_means(parts[:, k], CODES) for k in range(m)]
    found.books = np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in books])
    # Exact neighbours in the sample: how far down the query's list of cells do they lie?
    asked = np.linspace(0, len(unit) - 1, min(SAMPLE_QUERIES, len(unit))).astype(int)
    ranks = []
    for s in range(0, len(asked), 100):
        q = asked[s : s + 100]
        near = unit[q] @ unit.T
        near[np.arange(len(q)), q] = -np.inf
        top = np.argsort(-near, axis=1, kind="stable")[:, : min(nearest, len(unit) - 1)]
        place = np.argsort(found.cells_of(unit[q]), axis=1)
        ranks.append(np.take_along_axis(place, own[top], 1).ravel())
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0)
    if len(ranks):
        found.probes = max(LEAST_PROBES, int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1)
    return found


def unit_of(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part; v as array<double>."""
    named = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = named.where(finite & F.exists("v", lambda x: x != 0))
    sizes = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return sound.where(F.size("v") == sizes[0]["n"]) if sizes else sound


def _encode(batches: Iterator[pa.RecordBatch], quantiser: Quantiser) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cells, codes = quantiser.encode(unit_of(_matrix(batch.column("v"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), batch.column("v"), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["ids", "v", "cell", "codes"]
            )


def _probe(batches: Iterator[pa.RecordBatch], quantiser: Quantiser, shards: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """A row per query and shard that holds parts of its cells."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of, at = [], []
        for k, cells in enumerate(quantiser.cells_of(unit_of(_matrix(batch.column("v"))))):
            hit = sorted({s for c in cells.tolist() for s in shards.get(c, ())})
            of += hit
            at += [k] * len(hit)
        took = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), took.column("id"), took.column("v")], names=["shard", "id", "v"])


FOUND = "query_id bigint, vec_id bigint, score double"


def _search(index: pa.Table, queries: pa.Table, quantiser: Quantiser, nearest: int, rerank: int) -> pa.Table:
    """The best `nearest` of a shard for each of its queries."""
    out: list[tuple[int, int, float]] = []
    if index.num_rows and queries.num_rows:
        original = _matrix(index.column("v"))
        unit = unit_of(original)
        ids = index.column("ids").to_pylist()
        part = np.stack([index.column("cell").to_numpy(), index.column("part").to_numpy()], 1)
        codes = np.frombuffer(b"".join(index.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        # How far a vector is from what its codes say.
        said = quantiser.centroids[part[:, 0]] + quantiser.books[np.arange(codes.shape[1]), codes].reshape(len(ids), -1)[:, : unit.shape[1]]
        error = np.sqrt(((unit - said) ** 2).sum(1))
        order = np.lexsort((part[:, 1], part[:, 0]))
        starts = np.flatnonzero(np.append(True, (part[order][1:] != part[order][:-1]).any(1)))
        asked, asked_ids = _matrix(queries.column("v")), queries.column("id").to_pylist()
        for s in range(0, len(asked), 128):
            own = asked[s : s + 128]
            unit_own = unit_of(own)
            tables, cells = quantiser.tables(unit_own), quantiser.cells_of(unit_own)
            reads = np.zeros((len(own), len(quantiser.centroids)), bool)
            np.put_along_axis(reads, cells, True, 1)
            candidates: list[list[np.ndarray]] = [[] for _ in own]
            for a, b in zip(starts, [*starts[1:], len(order)]):
                rows, cell = order[a:b], part[order[a], 0]
                q = np.flatnonzero(reads[:, cell])
                if not len(q):
                    continue
                slack = SLACK * np.sqrt((error[rows] ** 2).mean() / unit.shape[1])
                # The centroid's share is the same for all in the cell.
                near = np.zeros((len(q), len(rows)))
                for m in range(codes.shape[1]):
                    near += tables[q, m][:, codes[rows, m]]
                if len(rows) <= rerank:
                    chosen = [slice(None)] * len(q)
                else:
                    best = np.argpartition(-near, rerank - 1, axis=1)[:, :rerank]
                    level = np.partition(near, -nearest - 1, axis=1)[:, -nearest - 1] - slack
                    close = near >= level[:, None]
                    chosen = [np.flatnonzero(c) if n > rerank else b for c, n, b in zip(close, close.sum(1), best)]
                for k, own_rows in zip(q, chosen):
                    candidates[k].append(rows[own_rows])
            for k, found in enumerate(candidates):
                if not found:
                    continue
                rows = np.concatenate(found)
                score = cosine(own[k], original[rows])
                # A few more than asked for: a query's own id may be among them.
                top = np.lexsort(([ids[r][0] for r in rows], -score))[: nearest + 1]
                hits = sorted((-score[t], i) for t in top for i in ids[rows[t]] if i != asked_ids[s + k])[:nearest]
                out += [(asked_ids[s + k], i, float(-c)) for c, i in hits]
    columns = zip(*out) if out else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with each row of x, in double precision."""
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def search(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, recall: float = RECALL, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its nearest rows."""
    spark = rows.sparkSession
    valid = usable(rows, key, vector)
    # Of equal vectors, those with the smallest ids; one more, as the query's own may be among them.
    same = Window.partitionBy("v").orderBy("id")
    entries = valid.withColumn("n", F.row_number().over(same)).where(F.col("n") <= nearest + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = materialise(entries, "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = hash_sample(entries.select("v"), "v", SAMPLE).collect()
    unit = unit_of(np.array([r["v"] for r in sample]))
    quantiser = fit(unit, int(max(1, min(CELLS, np.sqrt(n), len(unit) / 8))), nearest, recall)
    schema = "ids array<bigint>, v array<double>, cell int, codes binary"
    index = materialise(entries.select("ids", "v").mapInArrow(lambda batches: _encode(batches, quantiser), schema), "index")

    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # CELLS rows at most
    n_shards = max(16, n // SHARD)
    shards, places = {}, []
    for cell, size in sorted(sizes.items()):
        parts = -(-size // PART)
        shards[cell] = sorted({(cell * 7919 + p) % n_shards for p in range(parts)})
        places.append((cell, parts))
    parts_of = F.broadcast(spark.createDataFrame(places, "cell int, parts int"))
    dealt = index.join(parts_of, "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("shard", F.pmod(F.col("cell") * F.lit(7919).cast("long") + F.col("part"), F.lit(n_shards)))
    asked = usable(queries, key, vector).where(F.size("v") == unit.shape[1]).where(F.col("id").isNotNull())
    probed = asked.mapInArrow(lambda batches: _probe(batches, quantiser, shards), "shard bigint, id bigint, v array<double>")
    found = probed.groupBy("shard").cogroup(dealt.select("shard", "cell", "part", "ids", "v", "codes").groupBy("shard")).applyInArrow(
        lambda left, right: _search(right, left, quantiser, nearest, rerank), FOUND
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op10_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of `embeddings` for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"op10_ivf_pq": op10_ivf_pq}
ORACLES: dict[str, str] = {}
