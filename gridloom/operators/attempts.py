"""Choosing among recognition attempts; pure aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import WHITE_SPACE
from gridloom.options import DEFAULTS, Options

VARIANTS = ("original", "otsu", "adaptive", "enhanced", "denoised", "inverted", "sharpened", "dilated")
# Page segmentation modes, in the order in which they are tried.
CONFIGS = tuple(f"--oem 3 --psm {mode}" for mode in (6, 7, 8, 4, 11, 13))


def is_word(word: Column) -> Column:
    """A word that isn't white space alone, Unicode's included."""
    return word.isNotNull() & ~word.rlike(rf"\A(?:{WHITE_SPACE})?\z")


def joined(words: Column) -> Column:
    """Non-blank words, as they are, joined by one space."""
    return F.array_join(F.filter(words, is_word), " ")


def mean_confidence(words: Column, confidences: Column) -> Column:
    """Mean confidence of the non-blank words, pairs up to the shorter list; 0 without any."""
    n = F.least(F.size(words), F.size(confidences))
    pairs = F.filter(F.arrays_zip(F.slice(words, F.lit(1), n).alias("w"), F.slice(confidences, F.lit(1), n).alias("c")), lambda p: is_word(p["w"]))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["c"])
    return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(F.lit(0.0))


def best(attempts: DataFrame, key: str, options: Options = DEFAULTS) -> DataFrame:
    """attempts (key, ord, txt, conf): the first attempt with a text at high confidence, else the text of
    the highest confidence, the first of equals, unless that is below the minimum; else empty."""
    sure = (F.col("conf") >= options.high_confidence) & (F.col("txt") != "")
    own = F.col("txt") != ""
    first = F.min_by("txt", F.when(sure, F.col("ord")))
    top = F.max_by(F.when(own, F.col("txt")), F.when(own, F.struct("conf", (-F.col("ord")).alias("o"))))
    enough = F.max(F.when(own, F.col("conf"))) >= options.minimum_confidence
    found = attempts.groupBy(key).agg(F.max(sure).alias("any_sure"), first.alias("first"), top.alias("top"), enough.alias("enough"))
    return found.select(key, F.when(F.col("any_sure"), F.col("first")).when(F.col("enough"), F.col("top")).otherwise("").alias("txt"))


def product(cells: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Every (variant, config) that a cell may be tried with, in order; for planning, as recognition
    itself stops early."""
    variants = VARIANTS if options.verbose else VARIANTS[:3]
    configs = CONFIGS if options.verbose else CONFIGS[:2]
    pairs = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(c).alias("config")) for v in variants for c in configs])
    return cells.select("*", F.posexplode(pairs).alias("attempt_ord", "a")).select(*cells.columns, "attempt_ord", "a.variant", "a.config")
