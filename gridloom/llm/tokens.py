"""Token ids of a public byte-level BPE vocabulary, word by word with a cache.

The vocabulary's splitting pattern never joins what stands before a single space that follows other
text with what stands behind it, so a text is cut there, and each chunk is encoded once per worker.
Chunks that the cache lacks are encoded from the rank file of the same vocabulary, which gives the
same ids as the JSON file; texts that hold the vocabulary's special token go through the JSON file.
"""

from __future__ import annotations

import base64
from functools import lru_cache

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Chunks kept per worker, and characters of the longest that is kept; a full cache starts anew.
CACHE, LONGEST = 150_000, 64


class _Chunks(dict):
    """Chunk without its leading space -> ids of the chunk with it, as little-endian bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        found = b"".join([i.to_bytes(4, "little") for i in self.encode(" " + chunk)])
        if len(chunk) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = found
        return found


class Encoder:
    """ids(text): the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ranks_path: str | None):
        self.path, self.exact = path, None
        if ranks_path is None:
            self.encode = self._exact
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.chunks = _Chunks(self.encode)

    def _exact(self, text: str) -> list[int]:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return self._bytes(self._exact(text))
        first, *rest = text.split(" ")
        if "" in rest:  # runs of spaces, or a last one: the pattern looks across them
            return self._bytes(self.encode(text))
        return self._bytes(self.encode(first)) + b"".join(map(self.chunks.__getitem__, rest))


@lru_cache(maxsize=1)
def encoder(path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """The worker's encoder; without paths, for the public vocabulary."""
    if path is None:
        import public_tokenizers

        return Encoder(public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
    return Encoder(path, ranks_path)
