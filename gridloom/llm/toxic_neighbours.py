"""Toxicity from the nearest labelled examples.

Examples and texts are TF-IDF vectors over all words of the examples; no word is left out. A word's
inverse document frequency is multiplied by how surely the word tells the classes apart (a G statistic,
brought between RELEVANCE's floor and about 1), so that neighbours of a text with an insult are those with
the insult, and those of other texts are the ones with like words.

The examples with the largest cosine are found exactly, with a block-max inverted index: like examples
stand together in blocks, the posting list of every word is cut by blocks, and each part knows its largest
weight. The sum of these bounds what any example of a block can reach. A text first visits its most
promising blocks; what its last neighbour has there decides which other blocks it visits, and in these only
the postings of its own words are read. Lists of words that occur in most blocks are kept as columns,
those of all other words as pairs. Many texts are looked up at once.

Votes of the neighbours, weighted by their distance, are calibrated on the examples, each scored by the
others, and returned with the neighbours as evidence.

The index is made of at most EXAMPLES labelled rows; their words are counted, and their own votes taken,
on the executors.

Defined results: a null or empty text, and one without any word of the examples, has no neighbours and the
calibrated prior as its score; a text of any length is looked up whole; equal cosines go to the smaller
doc_id; repeated rows are scored each for itself; without labelled rows of both classes every score is the
smoothed share of label 1, 0.5 without any; an empty table gives an empty frame. Only doc_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import labelled_sample, remainder, remove, slices, store, table

DIVISOR, HELD_OUT = 5, 0
#: Labelled rows in the index, at most.
EXAMPLES = 6_000
NEIGHBOURS = 11
#: Examples in a block; blocks that every text visits first; words kept as columns.
BLOCK, FIRST, COLUMNS = 64, 4, 768
#: Relevance of a word that tells nothing, and the G statistic that counts for a quarter.
RELEVANCE, EVIDENCE = 0.05, 30.0
#: Texts that are looked up at once.
AT_ONCE = 256

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case, cut at everything in ASCII that isn't a letter or digit."""
    return text.lower().encode().translate(_SPACED).split()


def bag_of(text: str | None) -> Counter[bytes]:
    return Counter(words_of(text or ""))


def hashed(bag: Counter[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and their counts."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, bag), np.uint64, len(bag)), np.fromiter(bag.values(), float, len(bag))


def relevance(k: np.ndarray, kt: np.ndarray, n: int, nt: int) -> np.ndarray:
    """For words in k of n texts of label 0 and in kt of nt texts of label 1."""

    def part(seen: np.ndarray, size: int, hits: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((seen > 0) & (hits > 0), seen * np.log(seen * float(n + nt) / (size * hits)), 0.0)

    both = k + kt
    g = np.maximum(2 * (part(k, n, both) + part(kt, nt, both) + part(n - k, n, n + nt - both) + part(nt - kt, nt, n + nt - both)), 0)
    return RELEVANCE + (g / (g + EVIDENCE)) ** 2


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, end), one after the other."""
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


Vector = tuple[np.ndarray, np.ndarray]


@dataclass
class Packed:
    """What the index is made of, small enough to be sent around: postings by word, then by row."""

    words: np.ndarray  # hashes of the words, ascending; a word's place is its number
    texts: np.ndarray  # per word: how many examples have it
    rows: np.ndarray  # per posting: row and count
    counts: np.ndarray
    ids: np.ndarray  # per row: doc_id
    labels: np.ndarray

    @classmethod
    def of(cls, bags: Sequence[tuple[int, int, np.ndarray, np.ndarray]]) -> Packed:
        """bags: (doc_id, label, hashes of words, counts) of examples. Like examples get rows close together."""
        ids, labels = np.array([b[0] for b in bags], np.int64), np.array([b[1] for b in bags], np.uint8)
        words, word = np.unique(np.concatenate([b[2] for b in bags] or [np.zeros(0, np.uint64)]), return_inverse=True)
        counts = np.concatenate([b[3] for b in bags] or [np.zeros(0)])
        row = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])

        def by_word(row: np.ndarray) -> Packed:
            order = np.lexsort((row, word))
            own = cls(words, np.bincount(word, minlength=len(words)), row[order], counts[order].astype(np.int64), ids, labels)
            own.texts, own.rows, own.counts = (x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (own.texts, own.rows, own.counts))
            return own

        order = _alike(by_word(row), len(bags))
        found = by_word(np.argsort(order)[row])
        found.ids, found.labels = ids[order], labels[order]
        return found

    def weighed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Weight per word (idf times relevance), word and weight per posting, smoothed share of label 1."""
        word = np.repeat(np.arange(len(self.words)), self.texts)
        n, nt = int((self.labels == 0).sum()), int((self.labels == 1).sum())
        kt = np.bincount(word, self.labels[self.rows], len(self.words))
        told = relevance(self.texts - kt, kt, n, nt) if n and nt else np.ones(len(self.words))
        weight = (np.log((n + nt + 1) / (self.texts.astype(float) + 1)) + 1) * told
        value = (1 + np.log(self.counts.astype(float))) * weight[word]
        length = np.sqrt(np.bincount(self.rows, value * value, len(self.ids)))
        return weight, word, value / length[self.rows] if len(value) else value, (nt + 0.5) / (n + nt + 1)


class Index:
    """Posting lists of the examples' words, cut by blocks. It is sent packed, and built where it arrives."""

    def __init__(self, packed: Packed):
        self.packed, self.knots, self._sent = packed, (np.zeros(0), np.zeros(0)), None
        self.words, self.ids, self.labels = packed.words, packed.ids, packed.labels.astype(np.int64)
        self.weight, word, value, self.prior = packed.weighed()
        row = packed.rows.astype(np.int64)
        blocks = max(1, -(-len(self.ids) // BLOCK))
        block = row // BLOCK
        start = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1]))) if len(word) else np.zeros(0, int)
        most = np.maximum.reduceat(value, start) if len(start) else np.zeros(0)
        n_parts = np.bincount(word[start], minlength=len(self.words))
        widest = np.lexsort((np.arange(len(self.words)), -n_parts))[:COLUMNS]
        widest = widest[n_parts[widest] > 1]
        #: Per word its column, or -1; blocks x BLOCK x columns; columns x blocks: the largest weight.
        self.column = np.full(len(self.words), -1)
        self.column[widest] = np.arange(len(widest))
        dense = np.zeros((blocks * BLOCK, len(widest)))
        in_column = self.column[word] >= 0
        dense[row[in_column], self.column[word[in_column]]] = value[in_column]
        self.columns = dense.reshape(blocks, BLOCK, len(widest))
        self.most_in = self.columns.max(1).T.copy()
        # Of the other words, per word and one more: where its parts start; per part: block, largest weight,
        # and where its postings start; per posting: row and weight.
        of_part = self.column[word[start]] < 0
        self.first_part = np.append(0, np.cumsum(np.where(self.column < 0, n_parts, 0)))
        self.part_block, self.part_most = block[start][of_part].astype(np.int32), most[of_part]
        self.part_start = np.append(0, np.cumsum(np.diff(np.append(start, len(word)))[of_part]))
        self.rows, self.weights = row[~in_column].astype(np.int32), value[~in_column]

    def __reduce__(self) -> tuple:
        return Index, (self.packed,)

    def sent(self, spark: SparkSession) -> Broadcast:
        """The index as a broadcast, bounded by the words of EXAMPLES texts; made once."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def vector(self, bag: Counter[bytes]) -> Vector:
        """Word numbers and weights of unit length; words that no example has are left out."""
        hashes, counts = hashed(bag)
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(at), bool)
        return unit(at[known], counts[known], self.weight)

    def nearest(self, vectors: list[Vector], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the rows and cosines of the k examples with the largest positive cosine; equal
        ones by doc_id."""
        if not len(self.ids) or not vectors:
            return [(np.zeros(0, int), np.zeros(0)) for _ in vectors]
        n, blocks = len(vectors), len(self.columns)
        asked = np.zeros((n, self.columns.shape[2]))
        part_of, parts, part_weight = [], [], []
        for q, (at, w) in enumerate(vectors):
            in_column = self.column[at] >= 0
            asked[q, self.column[at[in_column]]] = w[in_column]
            own, value = at[~in_column], w[~in_column]
            first, last = self.first_part[own], self.first_part[own + 1]
            parts.append(_ranges(first, last))
            part_weight.append(np.repeat(value, last - first))
            part_of.append(np.full(len(parts[-1]), q))
        of, part, value = np.concatenate(part_of), np.concatenate(parts), np.concatenate(part_weight)
        in_block = self.part_block[part]
        bounds = asked @ self.most_in + np.bincount(of * blocks + in_block, value * self.part_most[part], n * blocks).reshape(n, blocks)
        scores = np.zeros((n, blocks, BLOCK))

        def visit(wanted: np.ndarray) -> None:
            own = wanted[of, in_block]
            start, end = self.part_start[part[own]], self.part_start[part[own] + 1]
            posting = _ranges(start, end)
            place = np.repeat(of[own], end - start) * (blocks * BLOCK) + self.rows[posting]
            scores.ravel()[:] += np.bincount(place, np.repeat(value[own], end - start) * self.weights[posting], scores.size)
            for b in np.flatnonzero(wanted.any(0)):
                q = np.flatnonzero(wanted[:, b])
                scores[q, b] += asked[q] @ self.columns[b].T

        first = np.argsort(-bounds, axis=1, kind="stable")[:, : min(FIRST, blocks)]
        wanted = np.zeros((n, blocks), bool)
        np.put_along_axis(wanted, first, True, 1)
        visit(wanted)
        seen = scores[np.arange(n)[:, None], first].reshape(n, -1)
        # A little slack: the sums are rounded differently.
        last = np.partition(seen, -min(k, seen.shape[1]), axis=1)[:, -min(k, seen.shape[1])] - 1e-11
        visit(~wanted & (bounds >= last[:, None]) & (bounds > 0))
        out = []
        for own, level in zip(scores.reshape(n, -1), last):
            rows = np.flatnonzero((own >= level) & (own > 1e-12))
            cosines = np.round(own[rows], 12)
            best = np.lexsort((self.ids[rows], -cosines))[:k]
            out.append((rows[best], cosines[best]))
        return out

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among neighbours, weighted by 1 / distance; the prior counts a little."""
        weight = cosines / (1.05 - np.minimum(cosines, 1.0))
        return float((weight @ self.labels[rows] + 0.1 * self.prior) / (weight.sum() + 0.1))

    def votes_of_others(self, examples: list[tuple[int, str | None]]) -> list[float]:
        """The vote on each example (doc_id, text) by the others."""
        out = []
        for (doc_id, _), (rows, cosines) in zip(examples, self.nearest([self.vector(bag_of(t)) for _, t in examples], NEIGHBOURS + 1)):
            own = np.flatnonzero((self.ids[rows] == doc_id) & (cosines > 1 - 1e-9))[:1]
            others = np.delete(np.arange(len(rows)), own)[:NEIGHBOURS]
            out.append(self.vote(rows[others], cosines[others]))
        return out

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression of the examples' labels on their votes by the others."""
        pools: list[list[float]] = []  # votes summed, labels summed, count
        for i in np.lexsort((labels, votes)):
            pools.append([votes[i], labels[i], 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                top = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], top)]
        x = np.array([p[0] / p[2] for p in pools])
        y = np.array([(p[1] + 0.5 * self.prior) / (p[2] + 0.5) for p in pools])
        self.knots = (x, np.maximum.accumulate(y) if len(y) else y)

    def scores(self, texts: list[str | None], knots: Vector) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text the score that is calibrated by the knots, then rows and cosines of its neighbours."""
        if not len(knots[0]):
            return [(self.prior, np.zeros(0, int), np.zeros(0)) for _ in texts]
        found = self.nearest([self.vector(bag_of(t)) for t in texts])
        return [(float(np.interp(self.vote(rows, cosines), *knots)), rows, cosines) for rows, cosines in found]


def unit(at: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Vector:
    value = (1 + np.log(counts)) * weight[at]
    return at, value / np.sqrt(value @ value) if len(at) else value


def _alike(packed: Packed, n: int) -> np.ndarray:
    """An order of n rows in which like ones stand together: by clusters over their commonest words."""
    common = np.argsort(-packed.texts.astype(int), kind="stable")[:COLUMNS]
    at = np.full(len(packed.words), -1)
    at[common] = np.arange(len(common))
    _, word, value, _ = packed.weighed()
    known = at[word] >= 0
    x = np.zeros((n, len(common)))
    x[packed.rows[known], at[word[known]]] = value[known]
    x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    clusters = -(-n // BLOCK)
    centres = x[np.random.default_rng(7).choice(n, clusters, replace=False)] if n else x
    own = np.zeros(n, int)
    for _ in range(5 if n else 0):
        own = np.argmax(x @ centres.T, 1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(total.any(1)[:, None], total / np.maximum(np.sqrt((total * total).sum(1)), 1e-12)[:, None], centres)
    return np.lexsort((np.arange(n), own))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words and their counts per example."""
    for batch in slices(batches):
        bags = [hashed(bag_of(t)) for t in batch.column("text").to_pylist()]
        columns = [pa.array([b[0].tobytes() for b in bags], pa.binary()), pa.array([b[1].astype("<u4").tobytes() for b in bags], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *columns], names=["doc_id", "label", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The calibrated index over at most `examples` labelled rows outside the held-out ones."""
    rows = labelled_sample(docs, labels, "toxic", DIVISOR, HELD_OUT, examples)
    # One example per text: copies would fill the neighbours of each other.
    rows = rows.groupBy(F.xxhash64("text").alias("_text"), "label").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", "r.text", "label")
    # Read twice below; at most `examples` texts.
    path = store(rows, "examples")
    rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    made = rows.mapInArrow(_bags, "doc_id bigint, label int, words binary, counts binary").orderBy("doc_id", "label").toArrow().to_pydict()
    bags = [(i, y, np.frombuffer(w, "<u8"), np.frombuffer(c, "<u4").astype(float)) for i, y, w, c in zip(made["doc_id"], made["label"], made["words"], made["counts"])]
    index = Index(Packed.of(bags))
    if {0, 1} <= set(index.labels.tolist()):
        shared = index.sent(docs.sparkSession)

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, AT_ONCE):
                found = shared.value.votes_of_others(list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label")], names=["vote", "label"])

        told = rows.mapInArrow(votes, "vote double, label int").toArrow()
        index.calibrate(told.column("vote").to_numpy(), told.column("label").to_numpy())
    remove(docs.sparkSession, path)
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (doc_id, label, cosine of the neighbours) per row of docs."""
    shared, knots = index.sent(docs.sparkSession), index.knots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in slices(batches, AT_ONCE):
            found = own.scores(batch.column(1).to_pylist(), knots)
            sizes = [len(rows) for _, rows, _ in found]
            rows, cosines = (np.concatenate([np.zeros(0, kind_), *(f[c] for f in found)]) for c, kind_ in ((1, int), (2, float)))
            shown = pa.StructArray.from_arrays([pa.array(own.ids[rows], pa.int64()), pa.array(own.labels[rows], pa.int32()), pa.array(cosines)], names=["doc_id", "label", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), shown).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _, _ in found], pa.float64()), evidence], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")


def op2_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, index).select(
        "doc_id", (remainder("doc_id", DIVISOR) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence"
    )


QUERIES = {"op2_toxic_neighbours": op2_toxic_neighbours}
ORACLES: dict[str, str] = {}
