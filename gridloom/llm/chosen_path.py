"""Self-join on the Jaccard similarity of word n-grams by chosen paths.

A run sends every set down a tree of random choices: at each node a set follows the shingles whose
hash, salted with the node's path, is small; similar sets follow common shingles and meet in a bucket
at the end of a path. The number of runs follows from the target recall for pairs at the threshold.
Buckets that are still large and whose sets are not alike are split further by the same rule; buckets
that are small, or large because their sets really are alike, are compared by brute force on short
sketches of the sets, and only to find which sets hang together. Each such group then gets the whole
sets of its members once, and all pairs in it are verified exactly: what comes out has no false link,
and a pair that the runs missed is still found when its sets meet in a group by way of others.

Equal sets are one record; copies are counted, never paired. Large groups and buckets are dealt out in
tiles of bounded size, and a tile returns sums and a spanning star per record, never its pairs.

Defined results: a text of one to four words has one shingle, all its words; a null or empty text has
none, links to nothing and is a class of its own; repeated rows are copies of each other; a null id
keeps its row; a text of any length is compared whole; an empty table gives an empty frame. Only doc_id and
text are read, so other columns may have any names; `keep_one` returns exactly the columns of docs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, materialise, rekeyed, scratch, slices, table, trim
from gridloom.llm.components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Mean number of shingles that a set follows at each node, and choices in a path.
BRANCH, DEPTH, MAX_DEPTH = 1.6, 2, 6
#: Records of a bucket that are compared without further splitting, if they aren't alike. This and DENSE
#: choose between splitting and tiles; no pair of a bucket is left out either way.
BUCKET = 2048
#: Mean similarity from which a large bucket isn't split.
DENSE = 0.4
#: Bytes of a sketch, one minimum each; share of pairs at the threshold that sketches may miss, which the
#: number of runs makes up for.
SKETCH, SKETCH_MISS = 32, 2e-4
#: Records on one side of a tile at most; groups of over FINE records, whose tiles hold whole sets, are dealt
#: out as well, until they have SPREAD chunks. So a set is sent SPREAD or n / TILE times.
TILE, FINE, SPREAD = 2048, 512, 8

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_SEEDS = np.array([xxhash.xxh64_intdigest(f"sketch {k}") | 1 for k in range(SKETCH)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's distinct word n-grams, ascending."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = max(len(h) - size + 1, 1)
    total = np.full(n, U(min(len(h), size)))
    for k in range(min(size, len(h))):
        total = (total ^ h[k : k + n]) * U(0x9E3779B97F4A7C15)
        total ^= total >> U(29)
    # By sort, as np.unique takes several times as long on sets of this size.
    total = np.sort(mix(total))
    return total[np.append(True, total[1:] != total[:-1])]


def runs_for(recall: float, threshold: float, branch: float = BRANCH, depth: int = MAX_DEPTH) -> int:
    """Runs after which a pair at the threshold has met, and its sketches have agreed, with the target
    recall, at the depth to which large buckets are split as well. Such a pair shares at least threshold *
    the larger set, so at each node about branch * threshold of its choices."""
    met = 1.0
    for _ in range(depth):
        met = 1 - math.exp(-branch * threshold * met)
    missed = max(1 - recall / (1 - SKETCH_MISS), 1e-9)
    return math.ceil(math.log(missed) / math.log(1 - met))


def equal_bytes(threshold: float) -> int:
    """Equal bytes of two sketches from which a pair counts as near: as many as all but SKETCH_MISS of the
    pairs at the threshold have. A byte is equal if the minima are, or by chance."""
    p, fewer = threshold + (1 - threshold) / 256, 0.0
    for k in range(SKETCH + 1):
        fewer += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if fewer > SKETCH_MISS:
            return k
    return SKETCH


def follow(tokens: np.ndarray, nodes: np.ndarray, branch: float) -> np.ndarray:
    """The nodes below `nodes` that a set goes to."""
    most = U(min(branch / len(tokens), 1.0) * (2.0**64 - 2049))
    out = []
    step = max(1, 2_000_000 // len(tokens))
    for s in range(0, len(nodes), step):
        own = nodes[s : s + step, None]
        below = mix(tokens[None, :] ^ own)
        at = np.nonzero(below <= most)
        out.append(mix(tokens[at[1]] * U(0xD6E8FEB86659FD93) + own[at[0], 0]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def roots(runs: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"run {r}") for r in range(runs)], U)


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of the smallest of the tokens under each of SKETCH hashes."""
    least = np.full(SKETCH, U(2**64 - 1))
    for s in range(0, len(tokens), 4096):
        own = tokens[None, s : s + 4096] * _SEEDS[:, None]
        least = np.minimum(least, (own ^ (own >> U(32))).min(1))
    return (mix(least) & U(255)).astype(np.uint8).tobytes()


def _signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


SCAN = "rid bigint, signature binary, path bigint, sketch binary"


def _scan(batches: Iterator[pa.RecordBatch], size: int, runs: int, depth: int, branch: float) -> Iterator[pa.RecordBatch]:
    """A row (rid, signature) per text, and a row (signature, path, sketch) per path of a new set."""
    seen, start = set(), roots(runs)
    for batch in slices(batches):
        rids, signatures, of_path, paths, sketches = [], [], [], [], []
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = shingles(text, size)
            rids.append(rid)
            if not len(tokens):
                signatures.append(None)
                continue
            own = _signature(tokens)
            signatures.append(own)
            if own in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(own)
            nodes = start
            for _ in range(depth):
                nodes = follow(tokens, nodes, branch)
            paths.append(nodes.view(np.int64))
            of_path += [own] * len(nodes)
            sketches += [sketch(tokens)] * len(nodes)
        n, found = len(rids), np.concatenate([*paths, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*rids, *[None] * len(found)], pa.int64()),
                pa.array([*signatures, *of_path], pa.binary()),
                pa.array([*[None] * n, *found.tolist()], pa.int64()),
                pa.array([*[None] * n, *sketches], pa.binary()),
            ],
            names=["rid", "signature", "path", "sketch"],
        )


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of each pair of sketches."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def hang_together(sketches: np.ndarray, enough: int) -> np.ndarray:
    """Component of each sketch, named by a member, where pairs with enough equal bytes are edges.
    A component grows from its frontier, so those that are close to one member cost one comparison."""
    label, left = np.full(len(sketches), -1), np.arange(len(sketches))
    while len(left):
        first, frontier, left = left[0], left[:1], left[1:]
        label[first] = first
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for s in range(0, len(frontier), 256):
                rest = np.flatnonzero(~near)
                if not len(rest):
                    break
                near[rest] = (_equal(sketches[frontier[s : s + 256]], sketches[left[rest]]) >= enough).any(0)
            frontier, left = left[near], left[~near]
            label[frontier] = first
    return label


def _meet(batch: pa.Table, enough: int) -> pa.Table:
    """Edges of the star of every component of every bucket (tile) in a shard."""
    key = np.stack([batch.column(c).to_numpy() for c in ("path", "ti", "tj")])
    order = np.lexsort(key[::-1])
    key = key[:, order]
    signatures = np.array(batch.column("signature").to_pylist(), object)[order]
    sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)[order]
    edges: set[tuple[bytes, bytes]] = set()
    starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)]):
        if b - a > 1:
            own = signatures[a:b]
            label = hang_together(sketches[a:b], enough)
            for k in np.flatnonzero(label != np.arange(b - a)):
                if own[k] != own[label[k]]:
                    edges.add((own[k], own[label[k]]))
    trim()
    a, b = zip(*edges) if edges else ([], [])
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _tiles(rows: DataFrame, group: str, size: str, member: str, fine: bool = False) -> DataFrame:
    """Deals rows of groups of more than TILE (fine: FINE) members out to tiles: each pair of the group's
    chunks is a tile. Adds chunk, ti, tj, many; small groups are one tile each, many to a shard."""
    chunks = F.ceil(F.col(size) / TILE)
    if fine:
        chunks = F.greatest(chunks, F.least(F.ceil(F.col(size) / FINE), F.lit(SPREAD).cast("long")))
    chunks = chunks.cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(7), member), chunks).cast("int")
    cut = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cut = cut.withColumn("ti", F.least("chunk", "other")).withColumn("tj", F.greatest("chunk", "other")).drop("other")
    return cut.withColumn("many", chunks > 1)


def _shards(rows: DataFrame, group: str, width: Column) -> DataFrame:
    return rows.withColumn("shard", F.when(F.col("many"), F.xxhash64(group, "ti", "tj")).otherwise(F.pmod(F.xxhash64(F.lit(3), group), width)))


def _split(batches: Iterator[pa.RecordBatch], size: int, branch: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures, paths, sketches = [], [], []
        for text, signature, path, own in zip(*(batch.column(c).to_pylist() for c in ("text", "signature", "path", "sketch"))):
            below = follow(shingles(text, size), np.array([path], np.int64).view(U), branch).view(np.int64).tolist()
            signatures += [signature] * len(below)
            paths += below
            sketches += [own] * len(below)
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.binary()), pa.array(paths, pa.int64()), pa.array(sketches, pa.binary())], names=["signature", "path", "sketch"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of a with each of b."""
    tokens, which = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    first = rows < len(a)
    shared = (np.bincount(which[first], minlength=len(tokens)) > 0) & (np.bincount(which[~first], minlength=len(tokens)) > 0)
    column = np.cumsum(shared) - 1
    keep = shared[which]
    rows, columns = rows[keep], column[which[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for s in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(columns, [s, s + width])
        x = np.zeros((len(a) + len(b), min(width, int(shared.sum()) - s)), np.float32)
        x[rows[lo:hi], columns[lo:hi] - s] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out


def _spans(similar: np.ndarray) -> np.ndarray:
    """Component of each node of a symmetric matrix, named by a member."""
    label, left = np.full(len(similar), -1), np.arange(len(similar))
    while len(left):
        first, frontier, left = left[0], left[:1], left[1:]
        label[first] = first
        while len(frontier) and len(left):
            near = similar[np.ix_(frontier, left)].any(0)
            frontier, left = left[near], left[~near]
            label[frontier] = first
    return label


VERIFIED = "signature binary, root binary, n bigint, many boolean"


def _verify(batch: pa.Table, size: int, threshold: float) -> pa.Table:
    """Per record and tile: how many documents of the tile it links to, and a member of its component."""
    columns = {c: batch.column(c).to_pylist() for c in ("group", "ti", "tj", "signature", "chunk", "copies", "tokens", "many")}
    tiles: dict[tuple, dict[bytes, int]] = {}
    for k, key in enumerate(zip(columns["group"], columns["ti"], columns["tj"])):
        tiles.setdefault(key, {})[columns["signature"][k]] = k
    out: list[tuple] = []
    for (_, ti, tj), members in tiles.items():
        rows = list(members.values())
        sides = [[k for k in rows if columns["chunk"][k] == c] for c in ((ti,) if ti == tj else (ti, tj))]
        left, right = sides[0], sides[-1]
        if not left or not right:
            continue
        sets = {k: np.frombuffer(columns["tokens"][k], "<u8") for k in rows}
        common = overlaps([sets[k] for k in left], [sets[k] for k in right])
        sizes = [np.array([len(sets[k]) for k in s], np.float32) for s in (left, right)]
        # In whole numbers: common / union >= threshold.
        similar = common * (1 + threshold) >= threshold * (sizes[0][:, None] + sizes[1][None, :]) - 1e-3
        copies = [np.array([columns["copies"][k] for k in s], np.int64) for s in (left, right)]
        if ti == tj:
            np.fill_diagonal(similar, False)
            counts, nodes, matrix = similar @ copies[1], left, similar
        else:
            counts = np.concatenate([similar @ copies[1], copies[0] @ similar])
            nodes = left + right
            matrix = np.block([[np.zeros((len(left), len(left)), bool), similar], [similar.T, np.zeros((len(right), len(right)), bool)]])
        label = _spans(matrix)
        for k, (node, n) in enumerate(zip(nodes, counts.tolist())):
            if n:
                out.append((columns["signature"][node], columns["signature"][nodes[label[k]]], n, columns["many"][node]))
    trim()
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["signature", "root", "n", "many"])


def _tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made = [shingles(t, size) for t in batch.column("text").to_pylist()]
        names = ["signature", "group", "size", "copies"]
        kept = pa.array([_signature(m) == s for m, s in zip(made, batch.column("signature").to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([m.tobytes() for m in made], pa.binary())], names=[*names, "tokens"]).filter(kept)


def link(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, rid (hash of id and text), root (one value per group of
    linked documents, null without words) and n_links (documents at the threshold or above, copies
    included). Only this table stays in the shared folder."""
    with scratch(docs.sparkSession):
        return _link(docs, size, threshold, recall)


def _link(docs: DataFrame, size: int, threshold: float, recall: float) -> DataFrame:
    rid = F.xxhash64("doc_id", "text")
    runs = runs_for(recall, threshold)
    rows = docs.select("doc_id", "text", rid.alias("rid"))
    scanned = materialise(rows.select("rid", "text").mapInArrow(lambda batches: _scan(batches, size, runs, DEPTH, BRANCH), SCAN), "scan")
    of_text = scanned.where(F.col("rid").isNotNull()).select("rid", "signature")
    paths = scanned.where(F.col("path").isNotNull()).select("signature", "path", "sketch")
    records = materialise(of_text.where(F.col("signature").isNotNull()).groupBy("signature").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies")), "records")

    # Recursion: buckets that are large and not alike go a choice deeper.
    met = []
    for depth in range(DEPTH, MAX_DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("signature").alias("lo"), F.max("signature").alias("hi")).where(F.col("lo") != F.col("hi")).select("path", "size")
        # Hot paths are split at run time, as both sides are shuffled for the join.
        keyed = sizes.select(rekeyed("path").alias("_path"), "size")
        members = paths.join(keyed, F.col("path") == F.col("_path")).drop("_path")
        large = sizes.where(F.col("size") > BUCKET)
        if depth == MAX_DEPTH or not large.limit(1).count():
            met.append(members)
            break
        slots = [F.struct(F.lit(k).alias("slot"), F.substring("sketch", k + 1, 1).alias("value")) for k in range(0, SKETCH, 4)]
        values = paths.join(keyed.where(F.col("size") > BUCKET), F.col("path") == F.col("_path")).select("path", "size", F.explode(F.array(*slots)).alias("s")).groupBy("path", "size", "s").count()
        alike = values.groupBy("path", "size").agg((F.sum(F.col("count") * F.col("count")) / (F.col("size") * F.col("size") * len(slots))).alias("alike"))
        sparse = materialise(alike.where(F.col("alike") < DENSE).select("path"), "sparse")
        met.append(members.join(sparse, "path", "left_anti"))
        texts = rows.join(records.select("signature", "rid"), "rid").select("signature", "text").dropDuplicates(["signature"])
        deeper = paths.join(sparse, "path", "left_semi").join(texts, "signature")
        paths = materialise(deeper.mapInArrow(lambda batches: _split(batches, size, BRANCH), "signature binary, path bigint, sketch binary"), "paths")
    members = met[0]
    for more in met[1:]:
        members = members.unionByName(more)
    width = F.lit(max(64, records.count() // 2000))
    dealt = _shards(_tiles(members, "path", "size", "signature"), "path", width).select("shard", "path", "ti", "tj", "signature", "sketch")
    enough = equal_bytes(threshold)
    edges = dealt.groupBy("shard").applyInArrow(lambda t: _meet(t, enough), "a binary, b binary")

    groups = components(edges).select(F.col("node").alias("signature"), F.col("root").alias("group"))
    sizes = groups.groupBy(F.col("group").alias("_group")).agg(F.count(F.lit(1)).alias("size")).select(rekeyed("_group").alias("_group"), "size")
    groups = groups.join(sizes, F.col("group") == F.col("_group")).drop("_group").join(records, "signature")
    chosen = materialise(groups, "groups")
    # By merge at every size: a broadcast of small groups would make a small run a different plan.
    tokens = rows.select("rid", "text").hint("merge").join(chosen, "rid").select("text", "signature", "group", "size", "copies").mapInArrow(lambda batches: _tokens(batches, size), "signature binary, group binary, size bigint, copies bigint, tokens binary")
    tiles = _shards(_tiles(tokens, "group", "size", "signature", fine=True), "group", width)
    verified = materialise(tiles.select("shard", "group", "ti", "tj", "signature", "chunk", "copies", "tokens", "many").groupBy("shard").applyInArrow(lambda t: _verify(t, size, threshold), VERIFIED), "verified")
    counts = verified.groupBy("signature").agg(F.sum("n").alias("n"))
    # A group in one tile is complete there; only what was dealt out needs joining up.
    dealt_out = verified.where("many").select(F.col("signature").alias("a"), F.col("root").alias("b"))
    root = verified.where(~F.col("many")).select("signature", "root")
    if dealt_out.limit(1).count():
        root = root.unionByName(components(dealt_out).select(F.col("node").alias("signature"), "root"))
    linked = materialise(
        records.join(counts, "signature", "left").join(root, "signature", "left").select("signature", F.coalesce("root", "signature").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked"
    )
    by_row = of_text.distinct().join(linked.select(rekeyed("signature").alias("_signature"), "root", "n_links"), F.col("signature") == F.col("_signature"), "left").select(F.col("rid").alias("_rid"), "root", "n_links")
    known = rows.select("doc_id", "rid").join(by_row, F.col("rid") == F.col("_rid"), "left").select("doc_id", "rid", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return materialise(known, "known", keep=True)


def join(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id (the smallest doc_id of the documents that links
    connect it with) and n_links (documents at the threshold or above, copies included)."""
    known = link(docs, size, threshold, recall)
    least = known.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"))
    least = least.select(rekeyed("root").alias("_root"), "class_id")
    return known.join(least, F.col("root") == F.col("_root"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs, of each group of linked documents only the one with the smallest doc_id; rows
    without words all stay."""
    known = link(docs.select("doc_id", "text"), size, threshold, recall)
    first = known.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    chosen = first.select(F.col("first.rid").alias("_rid"))
    wrapped = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("rid"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("worded"))
    kept = wrapped.where("worded").join(chosen, F.col("rid") == F.col("_rid"), "left_semi")
    # Repeated rows share their rid.
    once = kept.withColumn("nth", F.row_number().over(Window.partitionBy("rid").orderBy(F.xxhash64("row")))).where("nth = 1")
    return once.select("row.*").unionByName(wrapped.where(~F.col("worded")).select("row.*"))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` on five-word shingles at a similarity of 0.8."""
    return join(table(spark, sf_dir, "documents"))


#: All pairs by their shared shingles; components by spreading the smallest id, for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE shared >= 0.8 * (x.n + y.n - shared)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(least_id, d.doc_id) AS class_id, coalesce(k, 0)::BIGINT AS n_links FROM d
LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) l ON l.a = d.r
LEFT JOIN (SELECT reach.a, min(t.doc_id) AS least_id FROM reach JOIN d t ON t.r = reach.b GROUP BY reach.a) m ON m.a = d.r
"""

QUERIES = {"op8_chosen_path": op8_chosen_path}
ORACLES = {"op8_chosen_path": ORACLE}
