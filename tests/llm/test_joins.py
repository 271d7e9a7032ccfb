import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import chosen_path as J
from gridloom.llm import ivf_pq as N
from gridloom.llm.components import components


def shingle_set(text):
    words = (text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """(doc_id, class_id, n_links) of each row, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, least.get(find(k), i) if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows))


def near_copies(seed, groups=25, passage=True):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 60, 120, 200]))] + (common if passage and g % 3 == 0 else [])
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("tile, fine", [(2048, 512), (2048, 4), (5, 512)])
def test_join(spark, monkeypatch, tile, fine):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "FINE", fine)
    rows = near_copies(tile)
    found = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, found)) == brute(rows)


def test_recursion(spark, monkeypatch):
    """Buckets over the limit are split further, unless they are alike."""
    monkeypatch.setattr(J, "BUCKET", 6)
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, passage + " " + " ".join(f"{i}q{k}" for k in range(45))) for i in range(60)]
    rows += [(100 + i, " ".join(f"z{k if k != i else rng.random()}" for k in range(100))) for i in range(20)]
    found = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, found)) == brute(rows)


def test_odd(spark, odd, none, odd_rows):
    rows = [(i, t) for i, t, _, _ in odd_rows]
    assert Counter(map(tuple, J.join(odd).collect())) == brute(rows)
    assert J.join(none).count() == 0
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    texts = Counter(r.text for r in kept.collect())
    for text, n in Counter(t for _, t in rows).items():
        assert texts[text] == (1 if shingle_set(text) else n)
    assert J.keep_one(none).count() == 0


def test_keep_one(spark):
    rows = near_copies(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {i: c for i, c, _ in brute(rows)}
    assert sorted(r.doc_id for r in J.keep_one(docs).collect()) == sorted(set(classes.values()))


def test_runs():
    assert J.runs_for(0.999, 0.8) > J.runs_for(0.9, 0.8) >= 1


@pytest.mark.parametrize("depth", range(J.DEPTH, J.MAX_DEPTH + 1))
def test_runs_reach_the_recall_at_every_depth(depth):
    met = 1.0
    for _ in range(depth):
        met = 1 - np.exp(-J.BRANCH * J.THRESHOLD * met)
    assert 1 - (1 - met) ** J.runs_for(J.RECALL, J.THRESHOLD) >= J.RECALL


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_sketches_of_pairs_at_the_threshold_agree(threshold):
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(1500):
        tokens = rng.integers(0, 2**63, 120).astype(np.uint64)
        own = int(round(60 * (1 - threshold) / (1 + threshold)))  # of each set of 60, all that isn't shared
        a, b = tokens[:60], np.append(tokens[own:60], tokens[60 : 60 + own])
        x, y = (np.frombuffer(J.sketch(np.sort(t)), np.uint8) for t in (a, b))
        missed += (x == y).sum() < J.equal_bytes(threshold)
    assert missed <= 4  # 0.3 are expected
    assert J.equal_bytes(0.8) == 17 and J.equal_bytes(1.0) == J.SKETCH and J.equal_bytes(0.0) == 0


def test_only_the_result_stays_in_the_shared_folder(spark):
    import os

    from gridloom.llm.common import shared_dir

    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    found = J.link(spark.createDataFrame(near_copies(3, groups=4), "doc_id long, text string"))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("gridloom-known-")
    assert found.count() > 0


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 30, 50, 0)]
    found = J.overlaps(sets, sets[:3])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[:3]] for a in sets]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node, root in found.items():
        seen, stack = {node}, [node]
        while stack:
            for k in near[stack.pop()] - seen:
                seen.add(k)
                stack.append(k)
        assert root == min(seen)
    assert set(found) == {k for e in edges if e[0] != e[1] for k in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact(rows, queries, k):
    out = {}
    for i, q in queries:
        q = np.array(q)
        scored = [(-round(float(q @ np.array(v) / np.sqrt(q @ q) / np.sqrt(np.array(v) @ np.array(v))), 10), j) for j, v in rows if j != i]
        out[i] = sorted(scored)[:k]
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    data = [(i, (centres[i % 12] + 0.4 * rng.normal(size=24)).astype(np.float32).tolist(), 0) for i in range(1500)]
    rows = spark.createDataFrame(data, VECTORS)
    found = N.search(rows, rows.where("vec_id % 50 = 0")).collect()
    expected = exact([(i, v) for i, v, _ in data], [(i, v) for i, v, _ in data if i % 50 == 0], 5)
    hits = sum((round(-r.score, 10), r.vec_id) in expected[r.query_id] for r in found)
    assert len(found) == 150 and hits >= 0.93 * 150


def test_almost_equal_vectors(spark):
    """A third of the vectors lie closer together than the codes can tell."""
    rng = np.random.default_rng(6)
    hot = rng.normal(size=16)
    data = [(i, (hot + 0.01 * rng.normal(size=16) if i % 3 == 0 else rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(900)]
    rows = spark.createDataFrame(data, VECTORS)
    found = N.search(rows, rows.where("vec_id % 150 = 0")).collect()
    expected = exact([(i, v) for i, v, _ in data], [(i, v) for i, v, _ in data if i % 150 == 0], 5)
    assert len(found) == 30 and all((round(-r.score, 10), r.vec_id) in expected[r.query_id] for r in found)


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 4)
    data = [(i, [1.0, 0.0, 0.0], 0) for i in range(40)] + [(100 + i, [float(i), 1.0, 2.0], 0) for i in range(30)]
    rows = spark.createDataFrame(data, VECTORS).repartition(3)
    found = {}
    for r in N.search(rows, rows.where("vec_id in (0, 3, 39)")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 39: [0, 1, 2, 3, 4]}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [2.0, 1.0], 0), (50, [1.0, 1.0], 0), (None, [1.0, 1.0], 0), (7, [1.0], 0), (8, [], 0)]
    rows = spark.createDataFrame(data, VECTORS)
    found = N.search(rows.where("vec_id is not null"), rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 50), (0, 2, 6), (50, 1, 0), (50, 2, 6)]
    assert found[0].score == pytest.approx(3 / np.sqrt(10))
    assert N.search(rows.where("false"), rows).count() == 0
