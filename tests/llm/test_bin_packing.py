import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import bin_packing as P
from gridloom.llm.tokens import encoder


@pytest.mark.parametrize("seed", range(40))
def test_like_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    runs, bins = P.best_fit_decreasing(Counter(lengths), capacity)
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    assert bins == len(left)
    used = defaultdict(list)
    for r in runs:
        for k in range(r.count):
            used[r.bin + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert sorted(n for v in used.values() for _, n in v) == sorted(lengths)
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity


def test_ids_are_the_tokenizer_s(odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = encoder()
    texts = [t for _, t, _, _ in odd_rows if t] + [" a", "a ", "a  b", "a\n b", "a\n  b \n", "it's  we'll", "　x   y", "tab\t\tz 12 345"]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t[:50])


def test_pieces(odd, none, odd_rows):
    rows = P.pack(odd.select("doc_id", "text"), capacity=64).collect()
    ids = [np.frombuffer(encoder().ids(t or ""), "<u4").tolist() + [0] for _, t, _, _ in odd_rows]
    expected = Counter()
    for (doc_id, _, _, _), own in zip(odd_rows, ids):
        first = len(own) % 64 or 64
        cuts = [0, *range(first, len(own) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc_id, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(used) == P.best_fit_decreasing(Counter(r.length for r in rows), 64)[1]
    assert P.pack(none).count() == 0
