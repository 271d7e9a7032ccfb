"""Scoring texts with a subword lattice language model.

The vocabulary is an existing one; nothing about its pieces is trained but their probabilities. These
weight all segmentations of a word, and the forward recursion over the word's lattice gives its
marginal probability. Whole words that the training texts hold are arcs of the lattice as well, with
their discounted counts; what the discount sets free goes to the pieces. Both levels exist once for
the whole corpus and once for every large class of training texts (by language), each class falling
back on the whole. A text's probability is the sum over the classes:

    P(text) = sum over k of P(k) * product over words and the end of P(word | k)

All levels are proper distributions. The probabilities of the pieces are fitted by expectation
maximisation over the distinct training words, from the order of the vocabulary.

How it scales: texts are cut into words once, in blocks of bounded vocabulary and size; a block keeps its
texts as word numbers and its own list of words, and a long text runs through as many blocks as it needs.
Counts meet in one aggregation by word, where a word comes once per block, however frequent it is; the
lattice runs once per distinct word of the corpus, and every block gets back the entries for its own words
alone. No task holds the corpus's vocabulary or a list of all blocks.

Defined results: a null or empty text is its end; a text of any length, with words of any length and
script, has a finite score; repeated rows count as often as they stand there; without training texts words
have their lattice probability alone; an empty table gives an empty frame. Only doc_id, text and the column
of the classes are read, so other columns may have any names; where the column of the classes is missing,
all texts are one class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, remainder, remove, slices, store, table
from gridloom.llm.lattice import Lattices, initial, maximise, vocabulary

DIVISOR, HELD_OUT = 10, 0
#: A block ends at so many distinct words, or so many bytes of coded texts, and is looked at after every
#: PART_BYTES of a text; so it has less than BLOCK_WORDS + PART_BYTES / 2 + 1 words, which fit WORD_BITS.
BLOCK_WORDS, BLOCK_BYTES, PART_BYTES = 200_000, 16 << 20, 1 << 20
#: A long holds a word's number, its block's number in the partition, and the partition's.
WORD_BITS, BLOCK_BITS = 20, 16
#: Partitions whose places of a word come as one list.
SPAN = 256
#: Classes with a table of their own, and the least share of the training texts; the rest are one class.
CLASSES, CLASS_SHARE = 7, 0.01
ROUNDS = 2
#: Share of the end of the text where no training text tells it.
END_SHARE = 0.01


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PART_BYTES, cut between words; at least one."""
    start = 0
    while len(text) - start > PART_BYTES:
        cut = _SPACE.search(text, start + PART_BYTES)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _code(batches: Iterator[pa.RecordBatch], classes: dict, width: int) -> Iterator[pa.RecordBatch]:
    """Texts as word numbers and counts, then, whenever a block is full, its words with counts by class.

    A text that goes on in the next block is a row in each, with one `row` number; `ends` marks the last."""
    from pyspark import TaskContext

    part_no = TaskContext.get().partitionId()
    block, row = part_no << BLOCK_BITS, part_no << 36
    numbers, counts = _Numbers(), np.zeros((1 << 16, width), np.int64)
    rows: list[tuple] = []
    held_bytes = 0

    def emit(words: list) -> pa.RecordBatch:
        n, m = len(rows), len(words)
        docs = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
        columns = [
            pa.array([block] * (n + m), pa.int64()),
            *(pa.array([*d, *[None] * m], k) for d, k in zip(docs, kinds)),
            pa.array([*[None] * n, *words], pa.binary()),
            pa.array([*[None] * n, *range(m)], pa.int32()),
            *(pa.array(np.concatenate([np.zeros(n, np.int64), counts[:m, k]])) for k in range(width)),
        ]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=["block", *CODED, "word", "number", *(f"c{k}" for k in range(width))])

    for batch in slices(batches):
        for doc_id, text, lang, held in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            parts = list(_parts(text or b""))
            for k, part in enumerate(parts):
                found = Counter(part.lower().split())
                at = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
                n = np.fromiter(found.values(), np.uint32, len(found))
                while len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                if not held:
                    counts[at, classes.get(lang, width - 1)] += n
                order = np.argsort(at)
                # Differences are small numbers, which the file's compression likes.
                rows.append((row, doc_id, held, k == len(parts) - 1, np.diff(at[order], prepend=np.uint32(0)).tobytes(), n[order].tobytes()))
                held_bytes += 8 * len(found) + 32
                if len(numbers) >= BLOCK_WORDS or held_bytes >= BLOCK_BYTES:
                    yield emit(list(numbers))
                    numbers, block, held_bytes = _Numbers(), block + 1, 0
                    counts = np.zeros((1 << 16, width), np.int64)
            row += 1
        yield emit([])
    if numbers:
        yield emit(list(numbers))


CODED = ("row", "doc_id", "held_out", "ends", "numbers", "counts")


@dataclass
class Tables:
    """Sizes of the training texts, whole (last) and by class: tokens, distinct tokens, discount, texts."""

    tokens: np.ndarray
    distinct: np.ndarray
    discount: np.ndarray
    texts: np.ndarray

    @property
    def prior(self) -> np.ndarray:
        own = self.texts[:-1] + 1.0
        return np.log10(own / own.sum())

    def levels(self, counts: np.ndarray, backing: np.ndarray) -> np.ndarray:
        """log10 P per class for tokens with counts by class and the log10 probability behind them."""
        total = counts.sum(1)
        whole = self._level(total, backing, -1)
        return np.stack([self._level(counts[:, k], whole, k) for k in range(counts.shape[1])], 1)

    def _level(self, c: np.ndarray, backing: np.ndarray, k: int) -> np.ndarray:
        n, v, d = float(self.tokens[k]), float(self.distinct[k]), float(self.discount[k])
        if not n:
            return backing
        free = np.log10(d * v / n) + backing
        with np.errstate(divide="ignore"):
            return np.where(c > 0, np.log10((c - d) / n * (c > 0) + 10.0**free), free)

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of tokens with count c."""
        return np.log10((c + 0.1) / (float(self.tokens[-1]) + 0.1 * (float(self.distinct[-1]) + 1)))


def _weigh(batches: Iterator[pa.RecordBatch], pieces: list[str], weights: dict[str, float], width: int) -> Iterator[pa.RecordBatch]:
    """The lattice probability of every word, packed for each block that holds it."""
    lattices = Lattices(pieces, weights)
    for batch in slices(batches, 10_000):
        words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
        log10 = lattices.log_probabilities(words) / np.log(10)
        counts = np.stack([batch.column(f"c{k}").to_numpy() for k in range(width)], 1).astype("<u8")
        lists = batch.column("places")
        places = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(words)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(places, kind="stable")
        places, row = places[order], row[order]
        blocks, numbers = places >> WORD_BITS, (places & ((1 << WORD_BITS) - 1)).astype("<u4")
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        ends = np.append(starts[1:], len(blocks))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks[starts]),
                pa.array([numbers[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.array([counts[row[a:b]].astype("<u4" if counts.max(initial=0) < 2**32 else "<u8").tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.array([log10[row[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            ],
            names=["block", "numbers", "counts", "lattice"],
        )


def _total(docs: pa.Table, entries: pa.Table, tables: Tables, width: int) -> pa.Table:
    """What the texts of a block, or the parts of texts that it holds, sum up to."""
    packed = [[x or b"" for x in entries.column(c).to_pylist()] for c in ("numbers", "counts", "lattice")]
    number = np.frombuffer(b"".join(packed[0]), "<u4")
    counts = np.zeros((len(number) + 1, width))
    lattice = np.zeros(len(number) + 1)
    at = 0
    for n, c, p in zip(*packed):
        size = len(n) // 4
        own = number[at : at + size]
        counts[own] = np.frombuffer(c, "<u4" if len(c) == 4 * size * width else "<u8").reshape(size, width)
        lattice[own] = np.frombuffer(p, "<f8")
        at += size
    # The end of a text comes behind the words.
    counts[-1], lattice[-1] = tables.texts[:-1], np.log10(END_SHARE)
    lattice[:-1] += np.log10(1 - END_SHARE)
    total = counts.sum(1)
    base, levels, known = tables.base(total), tables.levels(counts, lattice), total > 0
    sums, by_class = [], []
    for ends, numbers, times in zip(*(docs.column(c).to_pylist() for c in ("ends", "numbers", "counts"))):
        own = np.append(np.cumsum(np.frombuffer(numbers, "<u4"), dtype=np.int64), len(number))
        n = np.append(np.frombuffer(times, "<u4"), ends).astype(np.int64)
        sums.append((int(n.sum()), int(n @ known[own]), float(n @ base[own])))
        by_class.append(n @ levels[own])
    kinds = (pa.int64(), pa.int64(), pa.float64())
    columns = [pa.array(c, k) for c, k in zip(zip(*sums) if sums else [[]] * 3, kinds)]
    of_class = [pa.array(c) for c in np.array(by_class).reshape(-1, width).T]
    return pa.Table.from_arrays([*(docs.column(c) for c in CODED[:3]), *columns, *of_class], names=[*CODED[:3], "n_tokens", "n_known", "base_score", *(f"l{k}" for k in range(width))])


def fit_pieces(words: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Probabilities of the pieces from distinct words (column `word`, binary), each counting once."""
    weights = initial(pieces)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights: dict[str, float] = weights) -> Iterator[pa.RecordBatch]:
            lattices, total = Lattices(pieces, weights), np.zeros(len(pieces))
            for batch in batches:
                total += lattices.expect([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

        summed = words.select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = summed.collect()  # as many rows as the vocabulary has pieces, at most
        weights = maximise(pieces, ((pieces[r["piece"]], r["n"]) for r in counts))
    return weights


def score(docs: DataFrame, held_out: Column, by: str | None = "lang", path: str | None = None) -> DataFrame:
    """Scores every row of docs (doc_id, text), learning from the rows that aren't held out.

    by: column of the classes, or None; path: the vocabulary's sentencepiece model, or None for the
    public one. The CLASSES largest classes have tables of their own, the texts of all others share one."""
    group = F.col(by).cast("string") if by in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", group.alias("lang"), held_out.alias("held_out"))
    of_class = {r["lang"]: r["count"] for r in rows.where(~F.col("held_out")).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES).collect()}
    n_train = rows.where(~F.col("held_out")).count()
    classes = {lang: k for k, lang in enumerate(c for c, n in of_class.items() if c is not None and n >= CLASS_SHARE * n_train)}
    width = len(classes) + 1
    c = [f"c{k}" for k in range(width)]
    schema = "block bigint, row bigint, doc_id bigint, held_out boolean, ends boolean, numbers binary, counts binary, word binary, number int, " + ", ".join(f"{k} bigint" for k in c)
    spark = docs.sparkSession
    coded_at = store(rows.mapInArrow(lambda batches: _code(batches, classes, width), schema), "coded")
    coded = spark.read.schema(schema).parquet(coded_at)
    place = F.shiftleft("block", WORD_BITS).bitwiseOR(F.col("number"))
    span = F.shiftright("block", BLOCK_BITS) / F.lit(SPAN)
    listed = coded.where(F.col("word").isNotNull()).repartition("word").groupBy("word", F.floor(span).alias("span"))
    listed = listed.agg(*[F.sum(k).alias(k) for k in c], F.collect_list(place).alias("places"))
    # Lists are cut by spans of blocks; counts are a word's in all of them.
    whole = Window.partitionBy("word")
    by_word = listed.select("word", (F.row_number().over(whole.orderBy("span")) == 1).alias("first"), *[F.sum(k).over(whole).alias(k) for k in c], "places")
    vocab_at = store(by_word, "vocab")
    vocab = spark.read.schema(by_word.schema).parquet(vocab_at)
    words = vocab.where("first")

    # Whole and per class: tokens, distinct words, words seen once and twice; one row.
    sums = []
    for k, col in enumerate([*map(F.col, c), sum(map(F.col, c), F.lit(0))]):
        sums += [F.sum(col).alias(f"n{k}"), F.count_if(col > 0).alias(f"v{k}"), F.count_if(col == 1).alias(f"one{k}"), F.count_if(col == 2).alias(f"two{k}")]
    found = words.agg(*sums).first()
    texts = np.zeros(width + 1)
    for lang, k in classes.items():
        texts[k] = of_class[lang]
    texts[width - 1], texts[width] = n_train - texts.sum(), n_train
    get = lambda name: np.array([found[f"{name}{k}"] or 0 for k in range(width + 1)], float)
    tables = Tables(get("n") + texts, get("v") + (texts > 0), np.clip((get("one") + 0.5) / (get("one") + 2 * get("two") + 1), 0.05, 0.95), texts)

    pieces = vocabulary(path)
    weights = fit_pieces(words.where(sum(map(F.col, c), F.lit(0)) > 0), pieces)
    entries = vocab.select("word", *c, "places").mapInArrow(lambda batches: _weigh(batches, pieces, weights, width), "block bigint, numbers binary, counts binary, lattice binary")
    texts_of = coded.where(F.col("word").isNull()).select("block", *CODED)
    levels = [f"l{k}" for k in range(width)]
    summed = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, " + ", ".join(f"{k} double" for k in levels)
    parts = texts_of.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(lambda left, right: _total(left, right, tables, width), summed)
    sums = ("n_tokens", "n_known", "base_score", *levels)
    total = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(k).alias(k) for k in sums])
    of_classes = [F.col(k) + float(p) for k, p in zip(levels, tables.prior)]
    top = F.greatest(*of_classes) if width > 1 else of_classes[0]
    log10 = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in of_classes), F.lit(0.0)))
    scored = total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tables.tokens[-1])).cast("long").alias("train_tokens"), "base_score", log10.alias("score"))
    done = materialise(scored, "scores")
    remove(spark, coded_at)
    remove(spark, vocab_at)
    return done


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole `documents` texts, learnt from those whose remainder isn't 0."""
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", DIVISOR) == HELD_OUT)


def lattice_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_lattice_lm that SQL can express; the sum of logarithms to four places."""
    return op1_lattice_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


BASE = r"""
WITH t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10 = 0 AS held_out FROM documents, t),
k AS (SELECT r, held_out, unnest(w) AS w FROM d UNION ALL SELECT r, held_out, NULL FROM d),
c AS (SELECT w, count(*) FILTER (NOT held_out) AS c FROM k GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) FILTER (c > 0) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n)::BIGINT AS train_tokens,
  round(sum(log10((c + 0.1) / (n + 0.1 * (v + 1)))), 4) AS base_score
FROM d JOIN k USING (r, held_out) JOIN c ON c.w IS NOT DISTINCT FROM k.w, n GROUP BY r, doc_id, held_out
"""

QUERIES = {"op1_lattice_lm": op1_lattice_lm, "lattice_lm_base": lattice_lm_base}
ORACLES = {"lattice_lm_base": BASE}
