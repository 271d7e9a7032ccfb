import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from gridloom.functions import sql as S
from gridloom.functions import text as T
from gridloom.operators import attempts as A
from gridloom.operators import logs as L
from gridloom.streaming import logs as streams

REPAIRS = {
    "CSIII": "CS111", "III": "111", "1": "I", "l": "I", "H|LL0": "HILL0", "BIO I0I": "B1O I0I", "TOPICS": "TOP1CS", "": "", "  a  b　c\x0b": "a b c", "IV XII": "IV XII",
}


def test_repairs(spark):
    rows = spark.createDataFrame([*((k,) for k in REPAIRS), (None,)], "t string")
    S.register(spark)
    for form in (T.post_process(F.col("t")), F.expr("repair_text(t)")):
        found = {r.t: r.o for r in rows.select("t", form.alias("o")).collect()}
        assert found == REPAIRS | {None: None}


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b.c.PDF",), ("/a/.hid",), ("x",), ("/d/",)], "p string")
    found = [tuple(r) for r in rows.select(T.file_type(F.col("p")), T.basename(F.col("p")), T.stem(F.col("p"))).collect()]
    assert found == [("pdf", "b.c.PDF", "b.c"), ("image", ".hid", ".hid"), ("image", "x", "x"), ("image", "", "")]


def test_mean_confidence(spark):
    data = [(["Hello", "World", ""], [85.0, 90.0, -1.0]), ([], []), (["a", "b"], [50.0])]
    rows = spark.createDataFrame(data, "w array<string>, c array<double>")
    assert [tuple(r) for r in rows.select(A.joined(F.col("w")), A.mean_confidence(F.col("w"), F.col("c"))).collect()] == [("Hello World", 87.5), ("", 0.0), ("a b", 50.0)]


@pytest.mark.parametrize(
    "tries, expected",
    [
        ([("HIGH CONF", 93.5)], "HIGH CONF"),
        ([("LOW", 27.5)], ""),
        ([("a", 60.0), ("b", 60.0), ("", 99.0)], "a"),
        ([("a", 60.0), ("b", 91.0), ("c", 99.0)], "b"),
        ([("", 99.0)], ""),
    ],
)
def test_best_attempt(spark, tries, expected):
    rows = spark.createDataFrame([(1, i, t, c) for i, (t, c) in enumerate(tries)], "cell int, ord int, txt string, conf double")
    assert A.best(rows, "cell").first().txt == expected


def records(n):
    start = dt.datetime(2024, 1, 1)
    kinds = [("load: x", 20), ("Cell[1] took (2)", 10), ("bad: y", 40), ("step (3)", 20)]
    return [(i, start + dt.timedelta(minutes=17 * i), kinds[i % 7 % 4][1], kinds[i % 7 % 4][0]) for i in range(n)]


SCHEMA = "event_id long, ts timestamp, level int, msg string"


def drained(query, done):
    """Stop the query once it has done its part: queries that wait for timeouts go on for ever."""
    until = time.time() + 90
    while query.isActive and not done() and time.time() < until:
        time.sleep(0.2)
    assert query.exception() is None
    query.stop()


def test_sampling_counts_over_buckets(spark):
    found = {r.event_id: r for r in L.sampled(spark.createDataFrame(records(300), SCHEMA)).collect()}
    seen = {}
    for i, _, level, msg in records(300):
        pattern = msg.split(":")[0] if ":" in msg else msg[:50]
        if level < 30:
            seen[pattern] = n = seen.get(pattern, 0) + 1
            assert (found[i].n, found[i].immediate) == (n, n == 1 or n % 10 == 0)
        else:
            assert found[i].n is None and found[i].immediate


def test_stream_samples_like_batch(spark, tmp_path):
    rows = spark.createDataFrame(records(200), SCHEMA)
    rows.where("event_id < 120").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    rows.where("event_id >= 120").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = streams.sampled(stream).writeStream.format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "state")).start()
    drained(query, lambda: spark.table("sampled").count() == 200)
    found = {(r.event_id, r.immediate) for r in spark.table("sampled").collect()}
    assert found == {(r.event_id, r.immediate) for r in L.sampled(rows).collect()}


def test_stream_flushes_full_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 20, f"Cell[{i}] took") for i in range(250)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = streams.flushed(stream).writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "state")).start()
    drained(query, lambda: spark.table("flushed").agg(F.sum("records")).first()[0] == 250)
    assert spark.table("flushed").where("reason = 'timeout'").agg(F.sum("records")).first()[0] == 50
    full = [tuple(r) for r in spark.table("flushed").where("reason = 'full'").select("batch_no", "msg", "records").collect()]
    assert full == [(k, "Cell (repeated 100 times with different values)", 100) for k in (0, 1)]


def test_stream_leaves_nothing_behind(spark, tmp_path):
    """A stream that ends with its input emits all of it; records over the age limit go with the next ones."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 10 + 10 * (i % 2), f"Cell[{i}] took") for i in range(250)]
    for part in range(2):
        spark.createDataFrame(rows[part * 130 : part * 130 + 130], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))

    def run(name, **how):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = streams.flushed(stream, **how).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
        query = (out.trigger(availableNow=True) if "end" in how else out).start()
        drained(query, lambda: "end" not in how and spark.table(name).agg(F.sum("records")).first()[0] == 250)
        return spark.table(name).collect()

    ended = run("ended", end=True)  # stops by itself
    assert sum(r.records for r in ended) == 250 and {r.reason for r in ended} <= {"full", "end"}
    aged = run("aged", max_age_ms=-1)
    assert sum(r.records for r in aged) == 250 and "age" in {r.reason for r in aged}


def test_words_of_unicode_white_space(spark):
    words = ["a", "", " ", "\u00a0", "\u3000\u2003", "\t\n", "\x1c", " b ", None, "\u200b"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", A.is_word(F.col("w")).alias("k")).collect()
    assert [r.w for r in found if r.k] == [w for w in words if w is not None and w.strip()]


def test_combined(spark):
    assert streams.combine(["a (1)"] * 5, ["a"] * 5) == [("a (1)", 1)] * 5
    assert streams.combine(["a (1)"] * 4 + ["b", "c"], ["a"] * 4 + ["b", "c"]) == [("a (repeated 4 times with different values)", 4), ("b", 1), ("c", 1)]


def test_hourly_stream_plan(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 5), "view")], "ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = streams.hourly(stream, "1 hour").writeStream.format("memory").queryName("hourly").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.n for r in spark.table("hourly").collect()] == [1]
