import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import apportion as A


def sainte_lague(weights, seats):
    given = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[k] += 1
    return given


@pytest.mark.parametrize("seed", range(3))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for g in range(6):
        weights = [rng.choice([0, 1, 5, 5, rng.randint(1, 1000), rng.randint(1, 100000)]) for _ in range(rng.randint(1, 12))] + [3]
        seats = rng.choice([0, 1, 7, 100, 1500])
        rows += [(g, i, w, seats) for i, w in enumerate(weights)]
        expected |= {(g, i): n for i, n in enumerate(sainte_lague(weights, seats))}
    frame = spark.createDataFrame(rows, "g int, i int, w long, seats long")
    found = {(r.g, r.i): r.won for r in A.highest_quotients(frame, ["g"], "w", "seats", [F.col("i").asc()], "won").collect()}
    assert found == expected


def water(sizes):
    """Targets by sharing again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            out[s] = 2.0 * sizes[s] if over else level * weight[s]
            left -= out[s]
        free -= over or set(free)
    return out


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "é", "", None, "big", "big", "big"]), " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 300)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {r.doc_id: r for r in A.mix(docs, shard_tokens=2000).collect()}
    sizes, got = defaultdict(int), defaultdict(int)
    for i, s, t in rows:
        assert taken[i].size == len(t.split()) and 0 <= taken[i].taken <= 2 * taken[i].size
        sizes[s] += taken[i].size
        got[s] += taken[i].taken
    for s, target in water(sizes).items():
        own = next(taken[i] for i, x, _ in rows if x == s)
        assert own.target == pytest.approx(target) and own.source_size == sizes[s]
        # The last block of a shard is short: up to two blocks a shard.
        assert abs(got[s] - target) <= 2 * 16 * (2 + sizes[s] / 2000)
    again = {r.doc_id: r.taken for r in A.mix(docs.repartition(7), shard_tokens=2000).collect()}
    assert again == {i: r.taken for i, r in taken.items()}


def test_texts_hold_what_is_taken(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), "  ".join(f"{i}-{k}" for k in range(rng.randint(0, 90))), "en", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long")
    taken = {r.doc_id: r.taken for r in A.mix(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "source", "text")).collect()}
    by_id = dict(zip([r.h for r in docs.select(F.xxhash64("doc_id", "text").alias("h")).collect()], range(120)))
    expected = {by_id[h]: n for h, n in taken.items() if n}
    found = defaultdict(int)
    for r in A.apply(docs).collect():
        found[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(found) == expected


def test_odd(odd, none):
    rows = A.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert A.mix(none).count() == 0
    assert A.apply(odd).columns == odd.columns and A.apply(none).count() == 0


def test_spans_of_shards_lose_no_block(spark):
    """Where a source's target is its limit, every shard is full, whatever the spans; and no block goes missing."""
    rows = [(i, "big" if i % 3 else "small", " ".join(["w"] * (1 + i % 40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for span in (1, 3, 1024):
        found = A.mix(docs, block_tokens=4, shard_tokens=200, span=span).groupBy("source_size").agg({"target": "max", "taken": "sum"}).collect()
        assert len(found) == 2
        for r in found:
            assert abs(r["sum(taken)"] - r["max(target)"]) <= 4 * (2 + r["source_size"] / 200), (span, r)
