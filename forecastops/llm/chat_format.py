"""Chat formatting by schema fingerprint, with built-in functions only.

A record is JSON text in any layout: one row for each turn, a list of messages, or prompt and answer fields. The
nested field paths it has, out of those any layout knows, are hashed into a fingerprint; the fingerprint selects
the layout's declarative mapping into canonical turns ``(conv_id, turn, role, text)``.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|``, and in roles a line feed becomes ``&#10;``, so no text can look like a
control string and reading back restores it exactly.

Defined results: null text or role is empty; a null turn number sorts first, and ties sort by role and text, so
repeated rows stay as repeated turns; a null conversation id is one conversation. Records that fit no layout, or
are not JSON, are returned by ``unmapped``, never lost silently. Fields outside the known paths are ignored, and so
are other columns. One conversation is one training example and so one output row: its turns must fit in a row.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastops.llm.common import plain_text

START, END = "<|im_start|>", "<|im_end|>"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Which paths mark a layout and where its turns are.

    ``each``: path of a list of messages, with the names of their ``role`` and ``text`` fields. Otherwise ``parts``
    lists (role, path) in order. ``role`` and ``text`` without ``each`` are the fields of a record that is a turn.
    ``renames``: roles go by other names there (``ROLE_NAMES``); all other layouts keep theirs as they are.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    parts: Sequence[tuple[str, str]] = field(default=())
    renames: bool = False

    def paths(self) -> list[str]:
        if self.each:
            return [f"{self.each}[0].{self.role}", f"{self.each}[0].{self.text}"]
        return [path for _, path in self.parts] or [self.role, self.text]


LAYOUTS = (
    Layout("turn", role="role", text="text"),
    Layout("messages", each="messages", role="role", text="content"),
    Layout("from_value", each="conversations", role="from", text="value", renames=True),
    Layout("nested_messages", each="data.messages", role="role", text="content"),
    Layout("prompt_completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", parts=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question_answer", parts=(("user", "question"), ("assistant", "answer"))),
)


def _digest(paths: Sequence[str]) -> str:
    return hashlib.md5("|".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the nested field paths of a parsed record, out of those that any layout knows."""
    known = sorted({p for layout in layouts for p in layout.paths()})
    present = [F.when(F.try_variant_get(record, f"$.{p}", "variant").isNotNull(), F.lit(p)) for p in known]
    return F.md5(F.concat_ws("|", *present))


def _turns(record: Column, layout: Layout) -> Column:
    get = lambda v, path: F.try_variant_get(v, f"$.{path}", "string")
    if layout.each:
        listed = F.try_variant_get(record, f"$.{layout.each}", "array<variant>")
        turns = F.transform(listed, lambda m, i: F.struct(i.cast("long").alias("turn"), get(m, layout.role).alias("role"), get(m, layout.text).alias("text")))
    elif layout.parts:
        turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), get(record, path).alias("text"))
                          for i, (role, path) in enumerate(layout.parts)])
    else:
        turns = F.array(F.struct(F.try_variant_get(record, "$.turn", "bigint").alias("turn"), get(record, layout.role).alias("role"),
                                 get(record, layout.text).alias("text")))
    return turns.cast(TURNS)


def _parsed(records: DataFrame, column: str, layouts: Sequence[Layout]) -> DataFrame:
    rows = records.select(F.col(column).alias("record"), F.try_parse_json(F.col(column)).alias("parsed"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("parsed"), layouts))
    names = F.create_map(*[F.lit(x) for layout in layouts for x in (_digest(layout.paths()), layout.name)])
    return rows.withColumn("layout", names[F.col("fingerprint")])


def canonical_turns(records: DataFrame, column: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``layout`` of every turn of the records that fit a layout."""
    rows = _parsed(records, column, layouts)
    turns = F.when(F.lit(False), F.lit(None).cast(TURNS))
    for layout in layouts:
        turns = turns.when(F.col("layout") == layout.name, _turns(F.col("parsed"), layout))
    rows = rows.select(F.try_variant_get("parsed", "$.conv_id", "bigint").alias("conv_id"), "layout", F.explode(turns).alias("t"))
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    role = plain_text(F.col("t.role"))
    renamed = F.when(F.col("layout").isin([layout.name for layout in layouts if layout.renames]), F.coalesce(names[role], role)).otherwise(role)
    return rows.select("conv_id", F.col("t.turn").alias("turn"), renamed.alias("role"), plain_text(F.col("t.text")).alias("text"), "layout")


def unmapped(records: DataFrame, column: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Records that fit no layout, with their fingerprint (null where they are not JSON)."""
    rows = _parsed(records, column, layouts).where(F.col("layout").isNull())
    return rows.select("record", F.when(F.col("parsed").isNotNull(), F.col("fingerprint")).alias("fingerprint"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` lists begin (from 0) and length, in UTF-8 bytes of ``formatted``, of every assistant text.
    """
    role = F.replace(escape(plain_text(F.col("role"))), F.lit("\n"), F.lit("&#10;"))
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escape(plain_text(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = lambda c: F.octet_length(c).cast("long")
    rows = turns.select("conv_id", "turn", "role", "text", F.concat(head, body, F.lit(f"{END}\n")).alias("piece"),
                        size(head).alias("head"), size(body).alias("body"), (F.col("role") == "assistant").alias("trained"))
    rows = rows.select("conv_id", F.row_number().over(order).alias("n"), "piece", "head", "body", "trained",
                       F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(before), F.lit(0)).alias("at"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "head", "body", "trained", "at"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: F.coalesce(x["trained"], F.lit(False))),
                        lambda x: F.struct((x["at"] + x["head"]).alias("begin"), x["body"].alias("length")))
    return chats.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) that a formatted conversation spells."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(piece, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(loss_spans, lambda s: unescape(
        F.substr(data, (s["begin"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), "")
