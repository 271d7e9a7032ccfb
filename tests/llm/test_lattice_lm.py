import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lattice as L
from gridloom.llm import lattice_lm as M
from gridloom.llm.common import remainder

PIECES = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "é"]


def weights():
    rng = np.random.default_rng(1)
    w = rng.random(len(PIECES)) + 0.1
    return dict(zip(PIECES, (w / w.sum()).tolist()))


def enumerate_all(word, w):
    """Sum over all segmentations, by recursion from the left."""
    if not word:
        return 1.0
    total = math.prod(w[f"<0x{b:02X}>"] for b in word[0].encode()) * enumerate_all(word[1:], w)
    for n in range(1, len(word) + 1):
        if word[:n] in w:
            total += w[word[:n]] * enumerate_all(word[n:], w)
    return total


@pytest.mark.parametrize("word", ["a", "ab", "abba", "aébab", "bbbb", "x日"])
def test_sum_over_segmentations(word):
    w = weights()
    expected = math.log(enumerate_all(L.MARK + word, w))
    assert L.Lattice(w).log_probability(word) == pytest.approx(expected, rel=1e-12)
    assert L.Lattices(PIECES, w).log_probabilities([word])[0] == pytest.approx(expected, rel=1e-12)


def test_long_words_do_not_underflow():
    w = weights()
    words = ["ab" * 2000, "a" * 48, "a" * 49, ""]
    one, many = L.Lattice(w), L.Lattices(PIECES, w)
    assert np.allclose(many.log_probabilities(words), [one.log_probability(x) for x in words], rtol=1e-12)
    assert np.isfinite(many.log_probabilities(words)).all()


def test_expected_counts():
    w, words = weights(), ["ab", "abba", "é日a", "b"]
    one: dict = {}
    for x in words:
        L.Lattice(w).expect(x, one)
    found = dict(zip(PIECES, L.Lattices(PIECES, w).expect(words)))
    assert all(found[p] == pytest.approx(one.get(p, 0), abs=1e-6) for p in PIECES)
    # Every segmentation covers each letter and mark once.
    covered = sum(n * len(p) for p, n in one.items() if not L.is_byte(p)) + sum(n for p, n in one.items() if L.is_byte(p) and p < "<0x80>")
    assert covered == pytest.approx(sum(len(x) + 1 for x in words), abs=2.0)


def test_maximise_sums_to_one():
    assert sum(L.maximise(PIECES, {"a": 3.0, "ab": 2.0}.items()).values()) == pytest.approx(1)
    assert sum(L.initial(L.vocabulary()).values()) == pytest.approx(1)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def check(rows, found):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        expected[i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, float(f"{base:.9g}")] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, float(f"{r.base_score:.9g}")) for r in found) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_odd(odd, none, odd_rows, monkeypatch):
    check([(i, t) for i, t, _, _ in odd_rows], M.score(odd, remainder("doc_id", 10) == 0).collect())
    assert M.score(none, remainder("doc_id", 10) == 0).count() == 0
    untaught = M.score(odd, F.lit(True)).collect()
    assert len(untaught) == len(odd_rows) and all(r.train_tokens == 0 and math.isfinite(r.score) for r in untaught)


def test_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("".join(rng.choice(list("abcé"), rng.integers(1, 5))) for _ in range(rng.integers(0, 60))), rng.choice(["x", "y"]).item()) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = M.score(docs.coalesce(1), remainder("doc_id", 10) == 0).collect()
    parts = M.score(docs.repartition(4), remainder("doc_id", 10) == 0).collect()
    check([(i, t) for i, t, _ in rows], whole)
    by_id = {r.doc_id: r.score for r in parts}
    assert all(by_id[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in whole)


def test_levels_are_distributions():
    tables = M.Tables(np.array([6.0, 4, 10]), np.array([3.0, 3, 4]), np.array([0.5, 0.5, 0.5]), np.array([2.0, 1, 3]))
    counts = np.array([[3, 2], [2, 0], [1, 1], [0, 1], [0, 0], [0, 0]], float)
    backing = np.log10(np.array([0.1, 0.2, 0.3, 0.1, 0.1, 0.2]))
    assert (10.0 ** tables.levels(counts, backing)).sum(0) == pytest.approx([1, 1])


def test_places_hold_every_block():
    assert M.BLOCK_WORDS + M.PART_BYTES // 2 + 1 <= 2**M.WORD_BITS
    assert M.WORD_BITS + M.BLOCK_BITS + 27 <= 63


def test_rare_scripts_do_not_underflow():
    """Words of four-byte letters, short and long, have finite probabilities, and expectations that add up."""
    pieces = L.vocabulary()
    many, one = L.Lattices(pieces, L.initial(pieces)), L.Lattice(L.initial(pieces))
    words = ["\U00012000" * n for n in (1, 20, 47, 48, 49, 300)] + ["\U0001f600日é" * 12]
    found = many.log_probabilities(words)
    assert np.isfinite(found).all() and np.allclose(found, [one.log_probability(w) for w in words], rtol=1e-12)
    counts = many.expect(words)
    assert np.isfinite(counts).all()
    letters = sum(len(p) * n for p, n in zip(pieces, counts) if not L.is_byte(p))
    written = sum(n / 4 for p, n in zip(pieces, counts) if L.is_byte(p) and "<0xF0>" <= p) * 4
    assert letters + written == pytest.approx(sum(len(w) + 1 for w in words), rel=0.01)


def test_rare_scripts_leave_scores_finite(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} here", "en") for i in range(30)] + [(31, "\U00012000" * 30 + " and " + "\U00012000" * 60, "xx")], "doc_id long, text string, lang string")
    assert all(math.isfinite(r.score) for r in M.score(docs, remainder("doc_id", 10) == 0).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few words; workers are forked, so that the values reach them by environment only if
    they are read there: the functions run in this process instead."""
    monkeypatch.setattr(M, "BLOCK_WORDS", 5)
    monkeypatch.setattr(M, "PART_BYTES", 12)


def test_texts_run_through_blocks(small_blocks, monkeypatch):
    import pyarrow as pa
    import pyspark

    class Task:
        def partitionId(self):
            return 3

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task()))
    text = " ".join(f"w{i % 23}" for i in range(200))
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([text, None, "w1 W1 z"]), pa.array(["en"] * 3), pa.array([False, True, False])], names=["doc_id", "text", "lang", "held_out"])
    words, seen = {}, {}
    out = [r for b in M._code(iter([batch]), {"en": 0}, 2) for r in b.to_pylist()]
    for r in out:
        if r["word"] is not None:
            words[r["block"], r["number"]] = r
    for r in out:
        if r["word"] is None:
            own = seen.setdefault(r["row"], Counter())
            for number, n in zip(np.cumsum(np.frombuffer(r["numbers"], "<u4")).tolist(), np.frombuffer(r["counts"], "<u4").tolist()):
                own[words[r["block"], number]["word"].decode()] += n
    assert list(seen.values()) == [Counter(text.split()), Counter(), Counter({"w1": 2, "z": 1})]
    assert len({r["block"] for r in out}) > 3 and sum(r["ends"] or False for r in out) == 3
    held = Counter()
    for r in words.values():
        held[r["word"].decode()] += r["c0"]
    assert held == Counter(text.split()) + Counter({"w1": 2, "z": 1})


def plain_score(rows, pieces, weights):
    """score() by its formula, one class, word by word with the single lattice."""
    single = L.Lattice(weights)
    tokens = [(i, (t or "").lower().split()) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    texts = sum(not held(i) for i, _ in tokens)
    n, v = sum(counts.values()) + texts, len(counts) + 1
    one, two = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = min(max((one + 0.5) / (one + 2 * two + 1), 0.05), 0.95)

    def token(c, behind):
        whole = max(c - d, 0) / n + d * v / n * behind
        return math.log10(max(c - d, 0) / n + d * v / n * whole)

    end = token(texts, M.END_SHARE)
    return {i: sum(token(counts[w], (1 - M.END_SHARE) * math.exp(single.log_probability(w))) for w in ws) + end for i, ws in tokens}


def test_score_equals_the_plain_formula(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 6))) for _ in range(rng.integers(1, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in M.score(docs, remainder("doc_id", 10) == 0, by=None).collect()}
    words = sorted({w for i, t in rows if not held(i) for w in t.split()})
    pieces = L.vocabulary()
    weights = L.initial(pieces)
    for _ in range(M.ROUNDS):
        counts: dict = {}
        for w in words:
            L.Lattice(weights).expect(w, counts)
        weights = L.maximise(pieces, counts.items())
    expected = plain_score(rows, pieces, weights)
    assert all(found[i] == pytest.approx(expected[i], rel=1e-6) for i in expected)
