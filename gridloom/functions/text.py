"""Column expressions on texts, paths and log messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: everything that counts as white space in a Unicode split.
WHITE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Fixed value: parts of course codes, in which an I is a misread 1.
COURSES = ("CS", "MATH", "PHYS", "CHEM", "BIO")


def file_type(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".pdf"), "pdf").otherwise("image")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(basename(path), r"^(.*[^.].*)\.[^.]*$", "$1")


def visual_name(path: Column) -> Column:
    return F.concat(F.lit("detected_table_"), stem(path), F.lit(".png"))


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")


def fix_course(word: Column) -> Column:
    """Every I in a word that contains part of a course code becomes a 1."""
    return F.when(word.rlike("|".join(COURSES)), F.translate(word, "I", "1")).otherwise(word)


def fix_word(word: Column) -> Column:
    """A word of I, 1 and l alone is I if single, all ones otherwise; else course codes are repaired.
    Roman numerals with other letters stay as they are."""
    return (
        F.when(word.rlike("^[I1l]$"), F.lit("I"))
        .when(word.rlike("^[I1l]+$"), F.regexp_replace(word, ".", "1"))
        .otherwise(fix_course(word))
    )


def post_process(text: Column) -> Column:
    """Repairs of recognised text: white space collapsed, bars read as I, words repaired. Null and empty
    texts stay as they are. Only texts that hold a word to repair are taken apart into words."""
    plain = F.btrim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("I")), WHITE_SPACE, " "))

    def repaired(t: Column) -> Column:
        course = reduce(Column.__or__, [t.contains(c) for c in COURSES])
        return F.when(course | t.rlike("(?:^| )[I1l]+(?: |$)"), F.array_join(F.transform(F.split(t, " "), fix_word), " ")).otherwise(t)

    # As an array's element the collapsed text is a variable, made once.
    return F.transform(F.array(plain), repaired)[0]


def message_pattern(message: Column) -> Column:
    """What stands before the first colon, else the first 50 characters."""
    return F.when(message.contains(":"), F.substring_index(message, ":", 1)).otherwise(F.substring(message, 1, 50))


def batch_pattern(message: Column) -> Column:
    """What stands before the first `[`, else before the first `(`, trimmed."""
    return F.trim(F.when(message.contains("["), F.substring_index(message, "[", 1)).otherwise(F.substring_index(message, "(", 1)))


# Numbers of the log levels.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40}


def level_number(name: Column) -> Column:
    return reduce(lambda out, kv: out.when(F.upper(name) == kv[0], kv[1]), LEVELS.items(), F.when(F.lit(False), 0))


def elapsed(seconds: Column) -> Column:
    return F.format_string("%.2fs", seconds)


def confidence(value: Column) -> Column:
    return F.format_string("%.1f%%", value)


def log_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
