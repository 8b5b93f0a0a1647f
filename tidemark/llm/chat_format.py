"""Chat formatting by schema fingerprints. DataFrame operations only.

A record of any layout is a variant value. Its schema's nested field paths (``messages[].role``) are hashed to a
fingerprint, which selects one of the declared ``LAYOUTS``: where a record's turns are, and what roles and texts are
called there. All layouts lead to the same canonical turns, which the template formats.

The template marks a turn as ``<turn:ROLE>TEXT</turn>`` and a line feed. In roles and texts a backslash becomes ``\\b``,
``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so no text can hold a marker, and undoing the three gives back every
text as it was. The loss mask is a list of (start, end) in code points of the formatted text, one a turn: an assistant's
text without its markers, or nothing.

Turns are numbered and measured by a window over (conversation, turn), which sorts with spilling; a conversation then
becomes one row, as its formatted text has to.

Defined results: null text and null role are empty; turns come in order of turn (null first), then role, then text, so
ties and repeated rows have one order; a null id is a conversation of its own; a record whose fingerprint no layout has
gives one row without turn, role and text and with a null layout; an empty table gives no rows; columns besides those
named are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"
#: What stands for the escape character and the markers' brackets inside texts.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
END = "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """A layout's field paths (its fingerprint), and the turns in it: a list at ``turns``, or fixed ``parts`` (role, path)."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    parts: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


#: Common layouts of chat data. More are passed as a parameter.
LAYOUTS = (
    Layout("turn", ("role", "text", "turn"), role="role", text="text", order="turn"),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("messages_in_conversation", ("conversation", "conversation.messages", "conversation.messages[].content", "conversation.messages[].role"), "conversation.messages", "role", "content"),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_completion", ("completion", "prompt"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), parts=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question_answer", ("answer", "question"), parts=(("user", "question"), ("assistant", "answer"))),
)

_STATE = "struct<stack: array<string>, name: string, paths: array<string>>"


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a variant, from its schema's text read token by token: names open paths, brackets nest."""
    schema = F.schema_of_variant(record)
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`: |[A-Za-z_]\w*: |ARRAY<|OBJECT<|>)"), F.lit(1))
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths")).cast(_STATE)

    def step(state: Column, token: Column) -> Column:
        top = F.element_at(state["stack"], -1)
        name = F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", "")
        here = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        named = F.struct(state["stack"].alias("stack"), here.alias("name"), F.concat(state["paths"], F.array(here)).alias("paths"))
        # what opens goes on from the last name, or from the list it lies in
        base = F.when(state["name"] == "", top).otherwise(state["name"])
        inner = F.when(token == "ARRAY<", F.concat(base, F.lit("[]"))).otherwise(base)
        opened = F.struct(F.concat(state["stack"], F.array(inner)).alias("stack"), F.lit("").alias("name"), state["paths"].alias("paths"))
        closed = F.struct(F.slice(state["stack"], 1, F.greatest(F.size(state["stack"]) - 1, F.lit(1))).alias("stack"), F.lit("").alias("name"), state["paths"].alias("paths"))
        return F.when(token.endswith(": "), named).when(token == ">", closed).otherwise(opened).cast(_STATE)

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["paths"])))


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _layout_print(layout: Layout) -> Column:
    return fingerprint(F.array(*[F.lit(p) for p in sorted(layout.paths)]))


def _at(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def _turns(layout: Layout) -> Column:
    """The layout's turns: array of (turn, part, role, text)."""
    record = F.col("_record")
    alias = lambda role: reduce(lambda c, r: F.when(role == r[0], F.lit(r[1])).otherwise(c), layout.roles.items(), role)
    one = lambda turn, part, role, text: F.struct(turn.cast("long").alias("turn"), F.lit(part).cast("long").alias("part") if isinstance(part, int) else part.cast("long").alias("part"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.parts:
        return F.array(*[one(F.lit(i), i, F.lit(role), _at(record, path, "string")) for i, (role, path) in enumerate(layout.parts)])
    if layout.turns:
        return F.transform(_at(record, layout.turns, "array<variant>"), lambda x, i: one(i, i, alias(_at(x, layout.role, "string")), _at(x, layout.text, "string")))
    return F.array(one(_at(record, layout.order, "long"), 0, alias(_at(record, layout.role, "string")), _at(record, layout.text, "string")))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` (conv_id, record variant) as rows conv_id, turn, part, role, text, layout, fingerprint."""
    own = records.select("conv_id", F.col("record").alias("_record")).withColumn("fingerprint", fingerprint(field_paths(F.col("_record"))))
    of = lambda f: F.coalesce(*[F.when(F.col("fingerprint") == _layout_print(x), f(x)) for x in layouts])
    found = own.withColumn("layout", of(lambda x: F.lit(x.name))).withColumn("t", F.explode_outer(of(_turns)))
    return found.select("conv_id", "t.turn", "t.part", "t.role", "t.text", "layout", "fingerprint")


def escaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, and loss_mask (one (start, end) a turn)."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "part", "role", "text")]
    window = Window.partitionBy("conv_id").orderBy(*order)
    text, role = escaped(F.coalesce("text", F.lit(""))), escaped(F.coalesce("role", F.lit("")))
    marked = turns.where(F.col("role").isNotNull()).withColumn("nth", F.row_number().over(window)).withColumn("head", F.concat(F.lit("<turn:"), role, F.lit(">"))).withColumn("body", text)
    marked = marked.withColumn("stop", F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("stop") - len(END)
    start = F.when(F.col("role") == LEARNED_ROLE, end - F.char_length("body")).otherwise(end)
    piece = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("piece"), F.struct(start.alias("start"), end.alias("end")).alias("mask"))
    rows = marked.select("conv_id", piece.alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return rows.select("conv_id", F.array_join("ps.piece", "").alias("formatted"), F.col("ps.mask").alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with its turns (role, text) and its learned texts, read from the formatted text and the mask alone.

    Each turn's mask is cut out of that turn's piece, so reading is linear in the text.
    """
    pieces = F.split(F.col("formatted"), END)
    parts = formatted.withColumn("_pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    role = lambda p: F.substring_index(F.substring_index(p, ">", 1), "<turn:", -1)
    turns = F.transform("_pieces", lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substring_index(p, ">", -1)).alias("text")))
    cut = lambda p, m: unescaped(F.substr(p, F.char_length(p) - (m["end"] - m["start"]).cast("int") + 1))
    learned = F.zip_with(F.col("_pieces"), F.col("loss_mask"), cut)
    return parts.withColumn("turns", turns).withColumn("learned", learned).drop("_pieces")
