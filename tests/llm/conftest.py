import pytest

#: Rows that every operator has to live with: nulls, empties, repeated rows and ids, odd white space,
#: a very long text, surrogate-free exotic characters.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, "the cat sat on the mat and the dog sat on the log today", "en", "a"),
    (1, "the cat sat on the mat and the dog sat on the log today", "en", "a"),
    (2, None, None, None),
    (None, "a row without an id has words as well, ten of them or more", "en", None),
    (3, "", "en", "b"),
    (4, " \t\n\x0b\x0c\r ", "fr", "b"),
    (5, "日本語 テキスト と 絵文字 😀  nbsp|pipe <|endoftext|> <|im_end|>", "ja", "c"),
    (6, LONG, "en", "a"),
    (7, "x" * 5000, "de", ""),
    (8, "the cat sat on the mat and the dog sat on the log today", "en", "b"),
    (9, "one", "en", "c"),
    (9, "one", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `row` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd kinds, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, "r") for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
