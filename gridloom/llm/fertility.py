r"""Quality rules from tokeniser fertility.

A public subword vocabulary with byte fallback measures every text word by word: characters per
token, the share of byte-fallback tokens and the entropy of the text's tokens. Each script has a
band for the three, and each language that labels exist for has narrower ones by length; a text
outside one of its bands is rejected, and so is one that fails the base rules (too few words, too many
words in repeated five-word windows).

The bands of scripts are wide: they are meant for text that isn't language (runs of symbols, encodings,
endless repetition), and a band counts only from so many tokens on that chance can't carry a clean text
across it. The bands of languages tell poor text from clean text of the same language.

Defined results: a null or empty text has no words, all counts 0, entropy 0, and fails the base rule;
a text without a language, with one that has no bands, or in another script than Latin has its script's
band only;
repeated rows and ids are measured each for itself; a text of any length is measured whole; an empty table
gives an empty frame. Only doc_id, text and lang are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import slices, table

VOCABULARY = "piece_bpe_32k.model"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Words kept per worker, and bytes of them and their tokens; a full cache starts anew.
CACHE, CACHE_BYTES = 200_000, 32 << 20


@dataclass(frozen=True)
class Band:
    """Bounds for a script: characters per token, share of byte tokens, and the least entropy in
    bits of a text of at least `long` tokens. The first two count from `short` tokens on."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    short: int = 48
    long: int = 128


# The bands, and the scripts by the first bytes of their UTF-8 letters.
BANDS = {
    "latin": Band(1.1, 9.0, 0.30, 5.0),
    "greek": Band(0.5, 6.0, 0.90, 4.5),
    "cyrillic": Band(0.8, 7.0, 0.50, 5.0),
    "semitic": Band(0.4, 6.0, 0.95, 4.0),
    "south_asian": Band(0.2, 5.0, 1.00, 4.0),
    "east_asian": Band(0.2, 4.0, 0.98, 4.5),
    "none": Band(0.5, 6.0, 0.98, 5.0),
}
# Per language and length class (tokens from 64, 128, ... 4096 on) the least entropy and the
# least and most characters per token. From the labels of sf0.1 with an even crc32 of the doc_id, among texts
# that pass the base rules: the 0.5 % quantile of the clean texts, or the middle between it and the 99 %
# quantile of the poor ones where these lie below it; the entropy from 64 tokens is that of all languages.
# Characters have a least value (not 0) where half of the poor texts lie below it, and a most value (not 9)
# a tenth above all clean texts; both only from 20 clean texts on. No text there has byte tokens.
LANGUAGES = {
    "en": ((4.96, 0.0, 2.49), (5.81, 0.0, 2.51), (6.09, 2.08, 2.48), (6.24, 2.09, 2.42), (6.45, 2.10, 2.39), (6.53, 2.12, 2.37), (6.59, 0.0, 9.0)),
    "de": ((4.94, 0.0, 9.0), (5.56, 0.0, 2.54), (5.93, 0.0, 2.47), (6.16, 2.13, 2.42), (6.33, 2.14, 2.41), (6.60, 0.0, 2.38), (6.47, 0.0, 9.0)),
    "fr": ((4.94, 0.0, 9.0), (5.67, 0.0, 2.30), (5.95, 0.0, 2.22), (6.19, 0.0, 2.18), (6.27, 1.93, 2.14), (6.38, 0.0, 9.0), (6.29, 0.0, 9.0)),
    "es": ((4.94, 0.0, 9.0), (5.48, 0.0, 9.0), (5.91, 0.0, 2.18), (6.19, 1.87, 2.15), (6.36, 1.90, 2.10), (6.44, 0.0, 9.0), (6.52, 0.0, 9.0)),
}
FIRST_CLASS = 6
SCRIPTS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD4)],
    "semitic": [*range(0xD6, 0xDC)],
    "south_asian": [0xE0, 0xE1],
    "east_asian": [*range(0xE3, 0xEE)],
}


class Measurer:
    """Measures texts with one vocabulary; keeps the tokens of the words it has seen."""

    def __init__(self, path: str | None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(n)])
        self.number: dict[bytes, int] = {}
        self.tokens: list[bytes] = []
        self.held = 0

    def learn(self, words: set[bytes]) -> None:
        """Tokenise the words that are new."""
        if len(self.number) > CACHE or self.held > CACHE_BYTES:
            self.number.clear()
            self.tokens.clear()
            self.held = 0
        new = [w for w in words if w not in self.number]
        if new:
            for word, ids in zip(new, self.pieces.encode([w.decode() for w in new], num_threads=1)):
                self.number[word] = len(self.tokens)
                self.tokens.append(np.array(ids, "<u4").tobytes())
                self.held += len(word) + len(self.tokens[-1])

    def measure(self, text: str, lang: str | None = None) -> tuple:
        data = text.encode()
        words = data.split()  # of bytes: at ASCII white space only
        n_words = len(words)
        word_chars = len(text) - sum(map(text.count, SPACE))
        n_symbols = sum(map(text.count, SYMBOLS))
        lines = [line for line in data.split(b"\n") if line and not line.isspace()]
        n_dup_lines = len(lines) - len(set(lines))
        if not words:
            return (0, word_chars, n_symbols, n_dup_lines, 0, True, False, 0.0, 0.0, 0.0, "none")
        self.learn(set(words))
        numbers = list(map(self.number.__getitem__, words))
        n_repeat_words = repeated(np.array(numbers, np.uint64))
        tokens = np.frombuffer(b"".join(map(self.tokens.__getitem__, numbers)), "<u4")
        n_tokens = max(len(tokens), 1)
        share = np.unique(tokens, return_counts=True)[1] / n_tokens
        entropy = float(-(share * np.log2(share)).sum()) + 0.0
        byte_share = float(self.is_byte[tokens].sum() / n_tokens)
        per_token = word_chars / n_tokens
        script = script_of(data)
        base_failed = n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words
        band = BANDS[script]
        inside = (n_tokens < band.short or band.least_chars <= per_token <= band.most_chars and byte_share <= band.most_bytes) and (
            n_tokens < band.long or entropy >= band.least_entropy
        )
        if script == "latin":
            inside = inside and in_language(lang, n_tokens, entropy, per_token)
        return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, inside and not base_failed, per_token, byte_share, entropy, script)


def in_language(lang: str | None, n_tokens: int, entropy: float, per_token: float) -> bool:
    """Whether a text is within the bands of its language; true where there are none."""
    length = n_tokens.bit_length() - 1 - FIRST_CLASS
    bands = LANGUAGES.get(lang)
    if bands is None or length < 0:
        return True
    least_entropy, least_chars, most_chars = bands[min(length, len(bands) - 1)]
    return entropy >= least_entropy and least_chars <= per_token <= most_chars


def repeated(numbers: np.ndarray) -> int:
    """Words within windows of WINDOW words that occur twice or more, the first included.

    Equal windows have equal hashes, so without equal hashes there is nothing to look at; else the
    windows themselves are compared."""
    n = len(numbers) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + n] + np.uint64(1)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(hashes, twice))
    windows = list(map(tuple, numbers[at[:, None] + np.arange(WINDOW)].tolist()))
    counts = Counter(windows)
    starts = at[[counts[w] > 1 for w in windows]]
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def script_of(data: bytes) -> str:
    """The script of most letters; `none` without letters."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    name, n = max(((name, int(counts[first].sum())) for name, first in SCRIPTS.items()), key=lambda x: x[1])
    return name if n else "none"


COLUMNS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double, script string"
)
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]


@lru_cache(maxsize=2)
def _measurer(path: str | None) -> Measurer:
    return Measurer(path)


def _measure(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    own = _measurer(path)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in slices(batches):
        rows = [own.measure(text or "", lang) for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        columns = zip(*rows) if rows else [[]] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=names)


def measure(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts, fertility and verdict per row of docs (doc_id, text, lang). vocabulary: path of a
    sentencepiece model; None for the public one."""
    return docs.select("doc_id", "text", "lang").mapInArrow(lambda batches: _measure(batches, vocabulary), COLUMNS)


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    return measure(table(spark, sf_dir, "documents"))


def fertility_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_fertility that SQL can express."""
    return op7_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
five AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM five) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)
"""

QUERIES = {"op7_fertility": op7_fertility, "fertility_base": fertility_base}
ORACLES = {"fertility_base": BASE}
