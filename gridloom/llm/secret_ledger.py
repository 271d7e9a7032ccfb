"""Secret scanning over an incremental blob ledger.

Every version of a file (here: a row of text) is content-addressed by its SHA-256. A rule is
known by name and version, and the ledger, a stored table that only grows, holds for every scanned
(blob, rule, version) the spans found. A scan takes only the pairs that the ledger lacks, so a text that
occurs under a thousand paths is scanned once, an unchanged corpus is not scanned at all, and a new rule
version rescans with that rule alone. Findings are then read from the ledger and joined to all paths that
hold the blob.

All of it is DataFrame operations: hashes, Java regular expressions and higher-order functions.

Defined results: a null text is scanned as the empty text; rows with a null path keep their row;
repeated rows each get the findings of their blob; an empty table gives empty frames; spans are
code points with an exclusive end; the cost of a text grows with its length and with its number of
matches, not with their product. Columns of docs named `blob` or `found` are replaced by those that
`findings` adds; `clean` returns exactly the columns of docs, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import let, rekeyed, running, shared_dir, table


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are taken leftmost and non-overlapping; then those whose `group`
    has fewer than `least` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    #: A cheaper pattern that every text with a match contains.
    hint: str


# The three base patterns of the contract, then the rules added to them.
RULES = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, "[:=]"),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
    Rule("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh[pousr]_"),
    Rule("webtoken", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{16,}", 0, 36, "eyJ"),
    Rule("pem", 1, "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 27, "-----BEGIN"),
)
BASE_KINDS = ("assign", "access", "hex")

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, results array<struct<rule:string,version:int,spans:{SPANS}>>"
#: Code points in a part of a long text that is to be redacted.
CUT = 4096


def address(text: Column) -> Column:
    """The content address of a text: SHA-256 of its UTF-8 bytes."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule in a text, by start.

    One pass of the expression gives the matches, another the stretches between them; the lengths of both
    add up to the places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), F.length)

    def spans(matches: Column, stretches: Column) -> Column:
        # The stretch before match k is the k-th; behind the last match there is one more.
        sizes = F.transform(matches, lambda m, k: F.length(m) + F.get(stretches, k))
        return let(running(sizes), lambda at: F.transform(matches, lambda m, k: let(F.get(at, k) + F.get(stretches, k), lambda start: F.struct(start.alias("start"), m.alias("m")))))

    each = let(found, lambda matches: let(between, lambda stretches: spans(matches, stretches)))
    kept = F.filter(each, lambda s: F.length(F.regexp_extract(s["m"], rule.pattern, rule.group)) >= rule.least)
    walked = F.transform(kept, lambda s: F.struct(s["start"].cast("int").alias("start"), (s["start"] + F.length(s["m"])).cast("int").alias("end")))
    return F.when(text.rlike(rule.hint), walked).otherwise(F.expr(f"cast(array() as {SPANS})"))


def scan(docs: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the (blob, rule, version) triples of docs that the ledger lacks.

    Returns what the ledger is to have added: one row per blob with something to scan, blob and results
    (rule, version, spans); rules without a finding too."""
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(address(F.col(text)).alias("blob"), body.alias("body")).dropDuplicates(["blob"])
    known = F.transform("results", lambda r: F.concat_ws("@", r["rule"], r["version"]))
    seen = ledger.groupBy(F.col("blob").alias("_blob")).agg(F.flatten(F.collect_list(known)).alias("seen"))
    wanted = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    lacking = F.array_except(wanted, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
    blobs = blobs.join(seen, F.col("blob") == F.col("_blob"), "left").withColumn("pending", lacking).where(F.size("pending") > 0)
    results = [
        F.when(
            F.array_contains("pending", f"{r.kind}@{r.version}"),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("body"), r).alias("spans")),
        )
        for r in rules
    ]
    return blobs.select("blob", F.filter(F.array(*results), lambda x: x.isNotNull()).alias("results"))


class Ledger:
    """A ledger in a folder that only grows: each scan adds its own files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """blob and results (rule, version, spans) of every scan so far."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def extend(self, docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> Ledger:
        """Scan what is unseen of docs, and add it."""
        scan(docs, self.rows(), text, rules).write.mode("append").parquet(self.path)
        return self

    def findings(self, docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """docs with `blob` and `found`: array of (rule, version, spans) of the rules' present versions.
        Every path of a blob gets its findings."""
        current = [f"{r.kind}@{r.version}" for r in rules]
        rows = self.rows().select(F.col("blob").alias("_blob"), F.filter("results", lambda r: F.concat_ws("@", r["rule"], r["version"]).isin(current)).alias("results"))
        # A blob has one row per scan that had something to add for it.
        found = rows.groupBy("_blob").agg(F.flatten(F.collect_list("results")).alias("found")).select(rekeyed("_blob").alias("_blob"), "found")
        return docs.drop("found").withColumn("blob", address(F.col(text))).join(found, F.col("blob") == F.col("_blob"), "left").drop("_blob")


def own_ledger(spark: SparkSession) -> Ledger:
    """A new, empty ledger in the shared folder."""
    return Ledger(spark, f"{shared_dir(spark)}/gridloom-ledger-{uuid.uuid4().hex}")


def spans_string(found: Column, kinds: tuple[str, ...]) -> Column:
    """`kind:start:end` of the given kinds, by start and then by the order of kinds, joined by commas."""
    rank = F.array(*[F.lit(k) for k in kinds])
    flat = F.flatten(
        F.transform(
            F.filter(found, lambda r: r["rule"].isin(list(kinds))),
            lambda r: F.transform(r["spans"], lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, r["rule"]).alias("rank"), s["end"].alias("end"))),
        )
    )
    return F.array_join(
        F.transform(F.array_sort(flat), lambda s: F.concat_ws(":", F.element_at(rank, s["rank"].cast("int")), s["start"], s["end"])),
        ",",
    )


def count_of(found: Column, kind: str) -> Column:
    """How many spans a rule has."""
    return F.aggregate(F.filter(found, lambda r: r["rule"] == kind), F.lit(0).cast("long"), lambda n, r: n + F.size(r["spans"]))


def redact(docs: DataFrame, found: str = "found", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text with every found span replaced by a mark; overlapping spans count as one.

    The text between spans is kept as it is, cut from parts of CUT code points, so that no place is
    looked for from the text's start. A text without findings comes back unchanged."""
    flat = F.array_sort(F.flatten(F.transform(F.col(found), lambda r: r["spans"])))
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """Code points [a, b) of the text."""
        first, last = F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")
        head = (a - first * CUT + 1).cast("int")
        middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        more = F.concat(F.substring(F.get(parts, first), head, F.lit(CUT)), middle, F.substring(F.get(parts, last), F.lit(1), (b - last * CUT).cast("int")))
        return F.when(b <= a, "").when(first == last, F.substring(F.get(parts, first), head, (b - a).cast("int"))).otherwise(more)

    def marked(spans: Column, parts: Column, reach: Column) -> Column:
        """reach: how far the spans before each go; a span within them has no mark of its own."""
        pieces = F.transform(spans, lambda s, k: let(F.get(reach, k), lambda r: F.when(s["start"] >= r, F.concat(cut(parts, r, s["start"]), F.lit(mark))).otherwise("")))
        return F.concat(F.array_join(pieces, ""), let(F.array_max(F.transform(spans, lambda s: s["end"])), lambda end: cut(parts, end, F.length(F.col(text)))))

    def over(spans: Column) -> Column:
        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda reach: let(parts, lambda p: marked(spans, p, reach)))

    return docs.withColumn(text, F.when(F.size(flat) > 0, let(flat, over)).otherwise(F.col(text)))


def clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (with text and n_chars) with every secret redacted; no row goes, none changes without one."""
    wrapped = docs.select(F.struct("*").alias("row"), F.col("text"))
    found = own_ledger(docs.sparkSession).extend(wrapped, rules=rules).findings(wrapped, rules=rules)
    done = redact(found).select("row", "text")
    changed = F.when(F.col("text").isNull() | (F.col("text") == F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("text"))
    fields = {"text": F.col("text"), "n_chars": changed.cast(docs.schema["n_chars"].dataType)}
    return done.select(*[fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of `documents`: the texts are scanned into a ledger, each distinct one
    once, and the findings come out of the ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = own_ledger(spark).extend(docs).findings(docs).select("doc_id", "found")
    return found.select(
        "doc_id",
        *[count_of(F.col("found"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_string(F.col("found"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        spans_string(F.col("found"), tuple(r.kind for r in RULES)).alias("spans"),
    )


def _sql_pattern(rule: Rule) -> str:
    """The pattern for an engine whose case folding reaches beyond ASCII: letters spelt out."""
    words = rule.pattern.partition("(?i:")[2].partition(")")[0]
    spelt = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)
    return rule.pattern.replace(f"(?i:{words})", spelt).replace("'", "''")


# The walk finds the first match in what is left of the text, then goes on behind it.
_FIRST = " ".join(f"WHEN {i} THEN regexp_extract(rest, '{_sql_pattern(r)}')" for i, r in enumerate(RULES))
ORACLE = f"""
WITH RECURSIVE rules(rank, kind, least) AS (VALUES {", ".join(f"({i}, '{r.kind}', {r.least})" for i, r in enumerate(RULES))}),
texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
walk AS (
  SELECT id, rank, 0 AS pos, text AS rest, 0 AS start, 0 AS stop, false AS ok FROM texts, rules
  UNION ALL
  SELECT id, rank, pos + strpos(rest, m) - 1 + length(m), substr(rest, strpos(rest, m) + length(m)),
    pos + strpos(rest, m) - 1, pos + strpos(rest, m) - 1 + length(m),
    length(CASE WHEN rank = 0 THEN regexp_extract(m, '{_sql_pattern(RULES[0])}', 2) ELSE m END) >= least
  FROM (SELECT w.*, r.least, CASE w.rank {_FIRST} END AS m FROM walk w JOIN rules r USING (rank)) x
  WHERE m <> ''),
spans AS (SELECT id, rank, kind, start, stop FROM walk JOIN rules USING (rank) WHERE ok)
SELECT t.doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) FILTER (kind IS NOT NULL), '') AS spans
FROM texts t LEFT JOIN spans s USING (id) GROUP BY t.id, t.doc_id
"""

QUERIES = {"op4_secret_ledger": op4_secret_ledger}
ORACLES = {"op4_secret_ledger": ORACLE}
