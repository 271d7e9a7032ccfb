r"""Chat formatting by schema fingerprints.

Records of any layout come in as JSON, or as rows of a table. The nested field paths of a record, at any
depth, without its values and value types, are hashed to a fingerprint. A layout is a declarative mapping,
which says under which path the turns lie or which field is which turn; it fits every fingerprint whose
paths include the layout's own, so further fields don't matter, and the first layout that fits is taken. All
mappings give canonical turns (role, text), and one template turns these into a text with a loss mask.

Template: `<|im_start|>role\ntext<|im_end|>\n` per turn. Control strings inside texts are escaped
reversibly: in every `<\...\|` (a `<`, any number of backslashes, a `|`) one backslash is added, so
no escaped text holds `<|`, and taking one backslash away gives the text back. In roles, backslashes
and newlines are escaped as well.

All of it is DataFrame operations.

Defined results: a null text or role is empty; a turn without a number sorts first; turns with one
number sort by role and text, repeated rows stay; an empty list of turns is a record without turns; a record
that isn't JSON, that no layout fits, or whose turns aren't what the layout says stays, without turns and
with a reason; an empty table gives an empty frame; all columns of the input come back within one struct, so
none is overwritten, whatever its name; texts of a table are never parsed, so a text can be as long as Spark
holds one, while a JSON record ends at the size of a variant (128 MiB) and is `not JSON` beyond.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from gridloom.llm.common import let, running, table

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """How to read a record. `turns` is the path of an array of turns with the fields `role` and `text`; or
    `fields` lists (role, path, ...) for a record whose fields are the turns: the paths of one turn are
    joined by a blank line, empty ones left out; a role that is a path is read from there."""

    name: str
    turns: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, ...], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        """Paths that a record must have."""
        if self.turns is not None:
            return self.turns + "[]", *(self.turns + "[]" + p[1:] for p in (self.role, self.text))
        return tuple(p for field in self.fields for p in field if p.startswith("$"))

    @property
    def empty(self) -> str:
        """The path that a record without turns has instead; no path where there is none."""
        return f"{self.turns}[]{NOTHING}" if self.turns is not None else ""


#: What follows the path of an array without elements, or with nulls alone.
NOTHING = "=void"
# The layouts known without configuration, those that ask for more before those that ask for less.
LAYOUTS = (
    Layout("messages", turns="$.messages", role="$.role", text="$.content"),
    Layout("share", turns="$.conversations", role="$.from", text="$.value"),
    Layout("prompt", fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("response", fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question", fields=(("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction_input", fields=(("user", "$.instruction", "$.input"), ("assistant", "$.output"))),
    Layout("instruction", fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("turn_row", fields=(("$.role", "$.text"),)),
)
# Other names of the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths_of(record: Column) -> Column:
    """The nested field paths of a variant record, sorted: `$.a.b`, elements of arrays as `$.a[]`.

    Names, brackets and nothing else are taken from the record's type, and walked with the path of every
    open bracket on a stack."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"`(?:[^`]|``)*`: |\w+: |OBJECT<|ARRAY<VOID>|ARRAY<|>"), F.lit(0))

    def step(acc: Column, token: Column) -> Column:
        def state(at: Column, stack: Column, out: Column) -> Column:
            return F.struct(at.alias("at"), stack.alias("stack"), out.alias("out"))

        at, stack, out = acc["at"], acc["stack"], acc["out"]
        field = F.concat(F.element_at(stack, -1), F.lit("."), F.substring(token, F.lit(1), F.length(token) - 2))
        item = F.concat(at, F.lit("[]"))
        return (
            F.when(token == "OBJECT<", state(at, F.array_append(stack, at), out))
            .when(token == "ARRAY<VOID>", state(at, stack, F.concat(out, F.array(item, F.concat(item, F.lit(NOTHING))))))
            .when(token == "ARRAY<", state(item, F.array_append(stack, item), F.array_append(out, item)))
            .when(token == ">", state(at, F.slice(stack, F.lit(1), F.size(stack) - 1), out))
            .otherwise(state(field, stack, F.array_append(out, field)))
        )

    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.lit("$").alias("at"), none.alias("stack"), none.alias("out"))
    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["out"])))


def paths_of_schema(kind: DataType, at: str = "$") -> list[str]:
    """paths_of for all rows of a table, from its schema."""
    if isinstance(kind, StructType):
        found = [p for f in kind.fields for p in [f"{at}.{_quoted(f.name)}", *paths_of_schema(f.dataType, f"{at}.{_quoted(f.name)}")]]
    elif isinstance(kind, ArrayType):
        found = [at + "[]", *paths_of_schema(kind.elementType, at + "[]")]
    else:
        found = []
    return sorted(set(found))


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9_]+", name) else "`" + name.replace("`", "``") + "`"


def fingerprint(paths: Column) -> Column:
    """SHA-256 of nested field paths."""
    return F.sha2(F.array_join(paths, "\n").cast("binary"), 256)


def layout_of(paths: Column, layouts: tuple[Layout, ...]) -> Column:
    """Name of the first layout that fits; null if none does."""
    found = F.lit(None).cast("string")
    for layout in reversed(layouts):
        missing = F.array_except(F.array(*map(F.lit, layout.paths)), paths)
        found = F.when((F.size(missing) == 0) | F.array_contains(paths, layout.empty), layout.name).otherwise(found)
    return found


def _role(name: Column) -> Column:
    out = name
    for other, role in ROLE_NAMES.items():
        out = F.when(F.lower(name) == other, role).otherwise(out)
    return out


def _turns(layout: Layout, items: Callable[[str], Column], get: Callable[[Column | None, str], Column]) -> Column:
    """Turns by a layout. items: the array at a path; get: the text at a path of an item, or of the record."""

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    if layout.turns is not None:
        return F.transform(items(layout.turns), lambda p: turn(_role(get(p, layout.role)), get(p, layout.text)))
    made = []
    for role, *paths in layout.fields:
        if role.startswith("$"):
            made.append(turn(get(None, role), get(None, paths[0])))
        else:
            texts = F.filter(F.array(*[get(None, p) for p in paths]), lambda t: t != "")
            made.append(turn(F.lit(role), F.array_join(texts, "\n\n")))
    return F.array(*made)


def canonical(records: DataFrame, json: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records, whose column `json` holds one JSON object each, as `row`, with `fingerprint`, `layout`, `turns`,
    array of (role, text), and `reason`: why there are no turns (`no record`, `not JSON`, `no mapping`,
    `not turns`), else null."""
    said = F.col(json)
    parsed = records.select(F.struct("*").alias("row"), said.alias("_said"), F.try_parse_json(said).alias("_record"))
    walked = parsed.withColumn("_paths", paths_of(F.col("_record")))
    named = walked.withColumn("layout", layout_of(F.col("_paths"), layouts))
    record = F.col("_record")

    def get(node: Column | None, path: str) -> Column:
        return F.coalesce(F.try_variant_get(record if node is None else node, path, "string"), F.lit(""))

    turns = F.lit(None).cast(f"array<{TURN}>")
    for layout in layouts:
        turns = F.when(F.col("layout") == layout.name, _turns(layout, lambda p: F.try_variant_get(record, p, "array<variant>"), get)).otherwise(turns)
    read = named.withColumn("turns", turns)
    why = F.when(F.col("_said").isNull(), "no record").when(record.isNull(), "not JSON").when(F.col("layout").isNull(), "no mapping").when(F.col("turns").isNull(), "not turns")
    return read.select("row", fingerprint(F.col("_paths")).alias("fingerprint"), "layout", "turns", why.alias("reason"))


def canonical_rows(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """canonical for a table whose rows are the records: all have the schema's paths, hence one fingerprint and
    one layout, and the texts are read where they are, of any length."""
    paths = paths_of_schema(rows.schema)
    layout = next((x for x in layouts if set(x.paths) <= set(paths)), None)

    def field(node: Column | None, path: str) -> Column:
        names = [n[1:-1].replace("``", "`") if n[0] == "`" else n for n in re.findall(r"`(?:[^`]|``)*`|[^.`]+", path[2:])]
        out = F.col(_quoted(names.pop(0))) if node is None else node
        for name in names:
            out = out.getField(name)
        return out

    turns = F.lit(None).cast(f"array<{TURN}>")
    if layout is not None:
        turns = _turns(layout, lambda p: field(None, p), lambda node, p: F.coalesce(field(node, p).cast("string"), F.lit("")))
    why = F.lit("no mapping") if layout is None else F.when(turns.isNull(), "not turns")
    said = hashlib.sha256("\n".join(paths).encode()).hexdigest()
    return rows.select(F.struct("*").alias("row"), F.lit(said).alias("fingerprint"), F.lit(layout and layout.name).cast("string").alias("layout"), turns.alias("turns"), why.cast("string").alias("reason"))


def escape(text: Column) -> Column:
    """Text without `<|`; `unescape` gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escape(role), r"\\", r"\\\\"), "\n", r"\\n")


def unescape_role(role: Column) -> Column:
    # A newline is \n behind an even number of backslashes; pairs stand for one.
    marked = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.regexp_replace(marked, r"\\\\", r"\\"))


def render(turns: Column) -> Column:
    """The formatted text of an array of (role, text)."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), ""
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text, start, length), unescaped; start and
    length say where the escaped text stands, in code points from 0."""
    # Each turn ends with END and a newline; the last piece of the split is empty.
    pieces = F.split(formatted, re.escape(END + "\n"), -1)
    ends = F.length(F.lit(END + "\n"))

    def parts(piece: Column) -> Column:
        # The first newline behind START ends the role.
        return let(
            F.locate("\n", piece),
            lambda cut: F.struct(
                F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1).alias("role"),
                F.substring(piece, cut + 1, F.length(piece)).alias("text"),
                cut.alias("head"),
            ),
        )

    def placed(turns: Column) -> Column:
        sizes = F.transform(turns, lambda p: p["head"] + F.length(p["text"]) + ends)
        return let(
            running(sizes),
            lambda at: F.transform(
                turns,
                lambda p, k: F.struct(
                    unescape_role(p["role"]).alias("role"),
                    unescape(p["text"]).alias("text"),
                    (F.get(at, k) + p["head"]).cast("int").alias("start"),
                    F.length(p["text"]).alias("length"),
                ),
            ),
        )

    return let(F.transform(let(pieces, lambda p: F.slice(p, 1, F.size(p) - 1)), parts), placed)


def loss_mask(formatted: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Spans (start, length) of the formatted text that count for the loss: the texts of the
    given roles, in order."""
    own = F.filter(read_back(formatted), lambda t: t["role"].isin(list(roles)))
    return F.transform(own, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))


def format_turn_rows(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows (conv_id, turn, and the turn itself in any layout that `layouts` has), one per turn: one row per
    conversation with `formatted` and `loss_spans`. A row without a mapping is an empty turn."""
    read = canonical_rows(rows, layouts)
    each = read.select("row.conv_id", "row.turn", F.explode_outer("turns").alias("t")).select("conv_id", "turn", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("turns"))
    formatted = whole.select("conv_id", render(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("formatted"))
    return formatted.withColumn("loss_spans", loss_mask(F.col("formatted")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `conversations`, and conversation -1 with control strings in its texts, formatted; the
    digests are read back from the formatted texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    done = format_turn_rows(rows.unionByName(extra))
    turns = read_back(F.col("formatted"))
    # What the mask covers is cut from the formatted text itself.
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    back = done.select("conv_id", "formatted", turns.alias("turns"), masked.alias("masked"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {"op3_chat_format": ORACLE}
