"""Segmentation lattices of words over an existing subword vocabulary.

A word starts with the vocabulary's word mark; its segmentations are all ways to write it as pieces,
and any character can also be written as its UTF-8 bytes. With one probability per piece, the
probability of a word is the sum over its segmentations, found by a forward recursion over its
characters. As a word ends where the next mark begins, the probabilities of all words add up to one
if those of all pieces do.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces by rank, byte pieces first; pieces with an inner word mark and control pieces left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [p for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and MARK not in (p := model.id_to_piece(i))[1:]]
    scores = {p: model.get_score(model.piece_to_id(p)) for p in pieces}
    return [f"<0x{b:02X}>" for b in range(256)] + sorted(pieces, key=lambda p: -scores[p])


def initial(pieces: list[str]) -> dict[str, float]:
    """Probabilities from the vocabulary's own order: its scores are ranks, so by Zipf's law; bytes
    share a hundredth."""
    rank = {p: k for k, p in enumerate(p for p in pieces if not is_byte(p))}
    total = sum(1 / (k + 10) for k in rank.values())
    return {p: 0.01 / 256 if is_byte(p) else 0.99 / (rank[p] + 10) / total for p in pieces}


def is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x")


class Lattice:
    """The recursions for one word at a time and one set of piece probabilities, all in natural
    logarithms, so that no word of any length or script underflows."""

    def __init__(self, weights: dict[str, float]):
        self.bytes = [math.log(weights[f"<0x{b:02X}>"]) for b in range(256)]
        self.weight = {p: math.log(w) for p, w in weights.items() if not is_byte(p) and w > 0}
        self.longest = max(map(len, self.weight))

    def spelt(self, char: str) -> float:
        """Log probability of a character as bytes."""
        return sum(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))

    def _arcs(self, word: str, forward: Sequence[float], j: int) -> list[tuple[int, str | None, float]]:
        """(start, piece, log probability of all that ends with it) of the arcs that end at j; a
        character as bytes has no piece."""
        get = self.weight.get
        found: list[tuple[int, str | None, float]] = [(j - 1, None, forward[j - 1] + self.spelt(word[j - 1]))]
        for i in range(max(0, j - self.longest), j):
            w = get(word[i:j])
            if w is not None:
                found.append((i, word[i:j], forward[i] + w))
        return found

    def forward(self, word: str) -> array:
        """Log probability of each beginning of the (marked) word, over all its segmentations."""
        out = array("d", [0.0])
        for j in range(1, len(word) + 1):
            arcs = self._arcs(word, out, j)
            top = max(v for _, _, v in arcs)
            out.append(top + math.log(sum(math.exp(v - top) for _, _, v in arcs)))
        return out

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations of the marked word."""
        return self.forward(MARK + word)[-1]

    def expect(self, word: str, counts: dict[str, float]) -> None:
        """Add to counts how often each piece is expected in the word's segmentations.

        Going back, each place knows how likely a segmentation has a cut there, and passes that on along
        the arcs that end there in their proportions."""
        word = MARK + word
        forward = self.forward(word)
        cut = array("d", bytes(8 * len(forward)))
        cut[len(word)] = 1.0
        for j in range(len(word), 0, -1):
            if not cut[j]:
                continue
            for i, piece, v in self._arcs(word, forward, j):
                share = cut[j] * math.exp(v - forward[j])
                cut[i] += share
                for p in [piece] if piece is not None else [f"<0x{b:02X}>" for b in word[i].encode("utf-8", "surrogatepass")]:
                    counts[p] = counts.get(p, 0.0) + share


def maximise(pieces: list[str], counts: Iterable[tuple[str, float]], smooth: float = 0.01, bytes_share: float = 1e-4) -> dict[str, float]:
    """Probabilities from expected counts: every piece keeps a little, and the bytes together at
    least bytes_share."""
    found = dict(counts)
    total = sum(found.values()) + smooth * len(pieces)
    weights = {p: (found.get(p, 0.0) + smooth) / total for p in pieces}
    spelt = sum(w for p, w in weights.items() if is_byte(p))
    if spelt < bytes_share:
        weights = {p: (w / max(spelt, 1e-300) * bytes_share if is_byte(p) else w / (1 - spelt) * (1 - bytes_share)) for p, w in weights.items()}
    return weights


class Lattices:
    """The recursions of Lattice for many words at once, with the same results: words of one length are
    columns of arrays, and substrings are looked up by hash. Words over LONG letters go one by one."""

    LONG, CHUNK = 48, 8192
    BASE, SPREAD = np.uint64(0x100000001B3), (np.uint64(0x9E3779B97F4A7C15), 46, 44)

    def __init__(self, pieces: list[str], weights: dict[str, float]):
        self.single = Lattice(weights)
        if len(pieces) >= 65535:
            raise ValueError("a slot has room for 16 bits of a piece's number")
        self.pieces = pieces
        self.usable = [k for k, p in enumerate(pieces) if not is_byte(p)]
        self.longest = self.single.longest
        self.weight = np.array([self.single.weight.get(p, -np.inf) for p in pieces] + [-np.inf])
        hashes = {}
        for k in self.usable:
            h = 0
            for c in pieces[k]:
                h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[h] = k
        # A slot holds the upper 48 bits of a spread hash and the number of its piece; 0 is an empty slot.
        self.tables = []
        rest, factor = hashes, int(self.SPREAD[0])
        for shift in self.SPREAD[1:]:
            # Pieces whose slot is taken go to the next, larger table; the last must take all of them.
            while True:
                slots, left = np.zeros(1 << (64 - shift), np.uint64), {}
                for h, k in rest.items():
                    spread = h * factor & 0xFFFFFFFFFFFFFFFF
                    if slots[spread >> shift]:
                        left[h] = k
                    else:
                        slots[spread >> shift] = spread >> 16 << 16 | k
                if not left or shift != self.SPREAD[-1]:
                    break
                factor = (factor * 6364136223846793005 + 1442695040888963407 | 1) & 0xFFFFFFFFFFFFFFFF
            self.tables.append((np.uint64(factor), np.uint64(shift), slots))
            rest, factor = left, (factor * 6364136223846793005 | 1) & 0xFFFFFFFFFFFFFFFF

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece per hash; the number of pieces where there is none."""
        out = np.uint64(len(self.pieces))
        for factor, shift, slots in self.tables:
            # Equal upper bits leave the difference below 2^16.
            spread = hashes * factor
            held = slots[spread >> shift]
            out = np.where((held ^ spread) < np.uint64(65536), held & np.uint64(65535), out)
        return out.astype(np.int32)

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, marked letters as a matrix) of the words up to LONG, by length."""
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes[(sizes <= self.LONG) & (sizes > 0)]):
            at = np.flatnonzero(sizes == n)
            for s in range(0, len(at), self.CHUNK):
                own = at[s : s + self.CHUNK]
                letters = np.frombuffer("".join(MARK + words[k] for k in own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), n + 1).T
                yield own, letters.astype(np.uint64)

    def _steps(self, letters: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """For each place j from 1: the pieces of the arcs that end there by start, from max(0, j - longest)
        on; the probabilities of these arcs, given that there is a cut at j, the character as bytes last;
        and the log probability of the words up to there."""
        n, m = letters.shape
        codes, inverse = np.unique(letters, return_inverse=True)
        spelt = np.array([self.single.spelt(chr(c)) for c in codes.tolist()])[inverse].reshape(n, m)
        forward = np.zeros((n + 1, m))
        running: list[np.ndarray] = []  # hash of letters[i:j] for each i that an arc can start at
        for j in range(1, n + 1):
            running = [h * self.BASE + letters[j - 1] + np.uint64(1) for h in running[-self.longest + 1 :]] + [letters[j - 1] + np.uint64(1)]
            found = [self._find(h) for h in running]
            logs = np.empty((len(found) + 1, m))
            for k, piece in enumerate(found):
                np.add(forward[j - len(found) + k], self.weight[piece], out=logs[k])
            np.add(forward[j - 1], spelt[j - 1], out=logs[-1])
            top = logs.max(0)
            logs -= top
            share = np.exp(logs, out=logs)
            total = share.sum(0)
            share /= total
            forward[j] = top + np.log(total)
            yield j, found, share, forward[j]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Lattice.log_probability of each word."""
        out = np.zeros(len(words))
        for own, letters in self._groups(words):
            for *_, last in self._steps(letters):
                pass
            out[own] = last
        for k, w in enumerate(words):
            if len(w) > self.LONG or not w:
                out[k] = self.single.log_probability(w)
        return out

    def expect(self, words: list[str]) -> np.ndarray:
        """Expected count of each piece over the words."""
        total = np.zeros(len(self.pieces) + 1)
        for _, letters in self._groups(words):
            n, m = letters.shape
            steps = [(j, found, share) for j, found, share, _ in self._steps(letters)]
            cut = np.zeros((n + 1, m))
            cut[n] = 1
            bytes_used = np.zeros((n, m))
            for j, found, share in reversed(steps):
                share *= cut[j]
                cut[j - len(found) : j] += share[:-1]
                cut[j - 1] += share[-1]
                bytes_used[j - 1] = share[-1]
                total += np.bincount(np.concatenate(found), share[:-1].ravel(), len(total))
            codes, inverse = np.unique(letters, return_inverse=True)
            for code, used in zip(codes.tolist(), np.bincount(inverse.ravel(), bytes_used.ravel(), len(codes)).tolist()):
                for byte in chr(code).encode("utf-8", "surrogatepass"):
                    total[byte] += used  # byte pieces come first
        rest: dict[str, float] = {}
        for w in words:
            if len(w) > self.LONG:
                self.single.expect(w, rest)
        if rest:
            number = {p: k for k, p in enumerate(self.pieces)}
            for piece, used in rest.items():
                total[number[piece]] += used
        return total[:-1]
