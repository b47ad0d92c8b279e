r"""Chat formatting: records of many layouts become canonical turns, and turns become training text.

A record is a JSON text. Its schema fingerprint is a hash of its nested field paths, whatever the
values; the fingerprint selects a declarative mapping (``LAYOUTS``) that names where roles and texts
are. Records whose fingerprint has no mapping come out with layout null and no turns.

The template writes a turn as ``### role: text</turn>`` and a line feed. Inside roles and texts the
characters that the template is made of are escaped (``\`` as ``\s``, ``#`` as ``\h``, ``<`` as
``\l``, and ``:`` in roles as ``\c``), so no text can open or close a turn and reading back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: All fields that a mapping may read; a record is parsed once with this schema.
RECORD = (
    "messages array<struct<role string, content string>>, conversations array<struct<`from` string, value string>>, "
    "system string, prompt string, response string, completion string, instruction string, input string, output string, "
    "question string, answer string"
)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``example``: a record with the layout's field paths. ``turns``: either an array field with the
    names of its role and text fields, or (role, fields) pairs; fields are joined by an empty line."""

    name: str
    example: str
    array: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"","content":""}]}', ("messages", "role", "content")),
    Layout("messages_without_turns", '{"messages":[]}', ("messages", "role", "content")),
    Layout("from_value", '{"conversations":[{"from":"","value":""}]}', ("conversations", "from", "value")),
    Layout("prompt_response", '{"prompt":"","response":""}', None, (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", '{"prompt":"","completion":""}', None, (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(
        "system_prompt_response", '{"system":"","prompt":"","response":""}', None,
        (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    ),
    Layout("instruction", '{"instruction":"","output":""}', None, (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(
        "instruction_input", '{"instruction":"","input":"","output":""}', None,
        (("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout("question_answer", '{"question":"","answer":""}', None, (("user", ("question",)), ("assistant", ("answer",)))),
)


#: A JSON string of valid characters and escapes; possessive, so that no text makes it backtrack.
_STRING = r'(?:[^"\\\x00-\x1F]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+'
NAME_OR_TEXT = rf'("{_STRING}"\s*+:)|("){_STRING}(")'
LIKE_NEIGHBOURS = r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++"


def skeleton(record: Column) -> Column:
    """A JSON text with its string values emptied and like neighbours in an array as one: the same field paths at any length."""
    return F.regexp_replace(F.regexp_replace(record, NAME_OR_TEXT, "$1$2$3"), LIKE_NEIGHBOURS, "$1")


def field_paths(record: Column) -> Column:
    """The nested field paths of a JSON text as one string, fields in order of name, scalar types left out; null if it is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    return F.regexp_replace(kind, r": (?!ARRAY|OBJECT)[A-Z]+(?:\([0-9, ]*\))?", "")


def schema_fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _named(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(role)), role)


def _turns(layout: Layout, record: str) -> Column:
    if layout.array:
        field, role, text = layout.array
        return F.transform(F.coalesce(F.col(f"{record}.{field}"), F.array()), lambda m: _turn(_named(m[role]), m[text]))
    turns = []
    for role, fields in layout.fields:
        given = [F.when(F.length(F.col(f"{record}.{f}")) > 0, F.col(f"{record}.{f}")) for f in fields]
        turns.append(_turn(F.lit(role), F.concat_ws("\n\n", *given)))
    return F.array(*turns)


def canonical_turns(
    records: DataFrame, payload: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS, record: Column | None = None
) -> DataFrame:
    """``records`` with schema_fingerprint, layout and turns: array of (role, text).

    Null fields are empty texts; records that are null, no JSON, or of an unknown layout have layout
    null and no turns. The order of fields plays no part. ``record`` gives the fields as a struct of
    ``RECORD`` where they need no parsing; ``payload`` is then read for its field paths alone.
    """
    given = F.from_json(F.col(payload), RECORD, {"maxStringLen": str(2**31 - 1)}) if record is None else record
    parsed = records.withColumns({"schema_fingerprint": schema_fingerprint(F.col(payload)), "_record": given})
    layout, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for known in reversed(layouts):
        hit = F.col("schema_fingerprint") == schema_fingerprint(F.lit(known.example))
        layout = F.when(hit, known.name).otherwise(layout)
        turns = F.when(hit, _turns(known, "_record")).otherwise(turns)
    return parsed.withColumns({"layout": layout, "turns": turns}).drop("_record")


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\c"), F.lit(":")) if role else text
    return F.replace(F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\s"), F.lit("\\"))


OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"


def formatted(frame: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds formatted, and loss_runs: (length, in_loss) runs of code points that cover it in order, two a turn."""
    marked = frame.withColumn(
        "_marked",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escaped(t["role"], role=True), F.lit(BETWEEN)).alias("head"), escaped(t["text"]).alias("body"),
                (t["role"] == trained).alias("loss"),
            ),
        ),
    )
    runs = F.flatten(F.transform("_marked", lambda m: F.array(
        F.struct(F.length(m["head"]).alias("length"), F.lit(False).alias("in_loss")),
        F.struct(F.length(m["body"]).alias("length"), m["loss"].alias("in_loss")),
        F.struct(F.lit(len(CLOSE)).alias("length"), F.lit(False).alias("in_loss")),
    )))
    text = F.array_join(F.transform("_marked", lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE))), "")
    return marked.withColumns({"formatted": text, "loss_runs": runs}).drop("_marked")


def read_back(frame: DataFrame) -> DataFrame:
    """Adds read_turns and loss_text from formatted and loss_runs alone."""
    pieces = F.split(F.col("formatted"), CLOSE, -1)
    cut = frame.withColumn("_pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    read = F.transform("_pieces", lambda p: _turn(
        unescaped(F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, F.lit(BETWEEN)) - len(OPEN) - 1), role=True),
        unescaped(F.substr(p, F.instr(p, F.lit(BETWEEN)) + len(BETWEEN))),
    ))
    under = F.transform("_pieces", lambda p, i: F.when(
        F.get(F.col("loss_runs"), i * 3 + 1)["in_loss"], unescaped(F.right(p, F.get(F.col("loss_runs"), i * 3 + 1)["length"]))
    ).otherwise(F.lit("")))
    return cut.withColumns({"read_turns": read, "loss_text": F.array_join(under, "")}).drop("_pieces")


def conversation_records(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one messages record per conversation: its fields, and a JSON text of its field paths with empty values.

    Turns are in order, ties by role and text; null roles and texts are empty.
    """
    message = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    listed = rows.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    emptied = F.array_distinct(F.transform("m", lambda m: F.struct(F.left(m["role"], F.lit(0)).alias("role"), F.left(m["content"], F.lit(0)).alias("content"))))
    return listed.select("conv_id", F.to_json(F.struct(emptied.alias("messages"))).alias("payload"), messages.alias("messages"))


def messages_record(messages: Column) -> Column:
    """A record of ``RECORD`` that has messages and no other field."""
    fields = StructType.fromDDL(RECORD).fields
    return F.struct(*[(messages if f.name == "messages" else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def format_conversations(rows: DataFrame, **columns) -> DataFrame:
    """conv_id, schema_fingerprint, layout, turns, formatted, loss_runs, read_turns and loss_text of every conversation.

    One row per conversation; repeated rows are turns of their own; null conversation ids form one
    conversation; further columns play no part; an empty table gives an empty result. A conversation
    is one text in the end, so its turns come together in one task. Its fingerprint is taken from its
    record's field paths and selects the mapping; the texts come from the record's fields and pass no
    parser, so none limits their length.
    """
    records = conversation_records(rows, **columns)
    mapped = canonical_turns(records, record=messages_record(F.col("messages"))).drop("payload", "messages")
    return read_back(formatted(mapped))


def format_records(records: DataFrame, payload: str = "payload") -> DataFrame:
    """The same for JSON records of any known layouts, one row per record; unknown ones have no turns and an empty text."""
    return read_back(formatted(canonical_turns(records, payload)))
