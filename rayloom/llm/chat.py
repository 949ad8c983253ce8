"""Chat formatting: layouts told apart by schema fingerprints, one canonical list of turns, a reversible template.

A fingerprint is the hash of a record's nested field paths.  Each distinct
fingerprint selects a declarative mapping (``LAYOUTS``) to canonical turns; a
template then writes the turns as one string, escapes control strings inside
texts, and marks the assistant's texts for the loss.  Everything is DataFrame
functions; the only shuffle gathers the rows of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.llm.common import maybe_broadcast

#: Canonical turns of a record.
TURNS = "array<struct<role:string,text:string>>"
#: Distinct fingerprints up to which their table is broadcast.
BROADCAST_LAYOUTS = 20_000

#: Other names of the canonical roles in JSON layouts: fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping to turns.

    ``needs``: field paths that a record must have, ``[]`` for array elements.
    Either ``items`` names an array whose elements hold ``role`` and ``text``,
    or ``parts`` lists (role, fields): the fields' texts joined by blank lines.
    """

    name: str
    needs: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: In this order the first layout whose paths are all there is taken.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("instruction", ("instruction", "output"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt-completion", ("prompt", "completion"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt-response", ("prompt", "response"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question-answer", ("question", "answer"), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a DataFrame schema, sorted; names are quoted as in the schema of a variant."""
    if isinstance(schema, T.StructType) and schema.fields:
        names = [f.name if re.fullmatch("[A-Za-z0-9_]*[A-Za-z_][A-Za-z0-9_]*", f.name) else "`" + f.name.replace("`", "``") + "`" for f in schema.fields]
        return sorted(p for f, n in zip(schema.fields, names) for p in field_paths(f.dataType, f"{prefix}.{n}" if prefix else n))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


#: What the schema of a variant is made of: field names, opened objects and arrays, their ends, and scalar types.
_PIECES = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+): |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z_]+(?:\(\d+,\s*\d+\))?"


def paths(record: Column) -> Column:
    """Nested field paths of a JSON record, each with its whole prefix, sorted as :func:`field_paths` does."""
    pieces = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(record)), F.lit(_PIECES), F.lit(0))
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("open"), F.lit("").alias("at"), texts.alias("found"))

    def step(s: Column, piece: Column) -> Column:
        outer = F.coalesce(F.get(s["open"], F.size(s["open"]) - 1), F.lit(""))
        name = F.regexp_replace(piece, ": $", "")
        named, opens, ends = piece.endswith(": "), piece.isin("OBJECT<", "ARRAY<"), piece == ">"
        opened = F.when(opens, F.array_append(s["open"], s["at"])).when(ends, F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        at = F.when(named, F.when(outer == "", name).otherwise(F.concat(outer, F.lit("."), name))).when(piece == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(s["at"])
        found = F.when(named | opens | ends, s["found"]).otherwise(F.array_append(s["found"], s["at"]))
        return F.struct(opened.alias("open"), at.alias("at"), found.alias("found"))

    return F.array_sort(F.aggregate(pieces, start, step)["found"])


def fingerprint_of(found: list[str]) -> str:
    """The hash of sorted field paths, as :func:`fingerprint` has it."""
    return hashlib.sha256("\n".join(found).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    return F.sha2(F.array_join(paths(record), "\n"), 256)


def _has(found: Column, path: str) -> Column:
    """Whether a path, or one below it, is among the field paths."""
    return F.exists(found, lambda p: (p == path) | p.startswith(path + ".") | p.startswith(path + "[]"))


def _select(found: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for layout in reversed(LAYOUTS):
        fits = F.lit(True)
        for path in layout.needs:
            fits = fits & _has(found, path)
        chosen = F.when(fits, F.lit(layout.name)).otherwise(chosen)
    return chosen


def layouts(records: DataFrame, raw_col: str) -> DataFrame:
    """``fingerprint, paths, n, layout`` of the distinct field layouts of JSON records; null layout: unknown."""
    told = records.select(paths(F.col(raw_col)).alias("paths")).groupBy("paths").agg(F.count("*").alias("n"))
    return told.select(F.sha2(F.array_join("paths", "\n"), 256).alias("fingerprint"), "paths", "n", _select(F.col("paths")).alias("layout"))


def _role(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(name)), F.lower(name), F.lit(""))


def _joined(item: Column, field: str) -> Column:
    """The parts of a field that is a list, joined by blank lines: a part's text, or all of it where it has none; null if it is no list."""
    parts = F.try_variant_get(item, f"$.{field}", "array<variant>")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit(""))), "\n\n")


def _turns(record: Column, layout: Layout) -> Column:
    if layout.items:
        items = F.from_json(F.get_json_object(record, f"$.{layout.items}"), f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        whole = F.try_variant_get(F.try_parse_json(record), f"$.{layout.items}", "array<variant>")
        return F.transform(items, lambda i, k: F.struct(_role(i[layout.role]).alias("role"), F.coalesce(_joined(F.get(whole, k), layout.text), i[layout.text], F.lit("")).alias("text")))
    turns = []
    for role, fields in layout.parts:
        said = F.array_join(F.filter(F.array(*[F.get_json_object(record, f"$.{f}") for f in fields]), lambda x: F.length(x) > 0), "\n\n")
        turns.append(F.struct(F.lit(role).alias("role"), said.alias("text")))
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (F.length(t["text"]) > 0))


def from_records(records: DataFrame, raw_col: str) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns``; columns of these names are replaced.

    A record that is null, no JSON object or of an unknown layout keeps its
    row, with null turns.  Records are not shuffled: the few distinct
    fingerprints are joined to them (broadcast when so few are found).
    """
    known = maybe_broadcast(layouts(records, raw_col).select(F.col("fingerprint").alias("_fp"), F.col("layout")), BROADCAST_LAYOUTS)
    told = records.drop("fingerprint", "layout", "turns").withColumn("fingerprint", fingerprint(F.col(raw_col)))
    joined = told.join(known, F.col("fingerprint") == F.col("_fp"), "left").drop("_fp")
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        turns = F.when(F.col("layout") == layout.name, _turns(F.col(raw_col), layout).cast(TURNS)).otherwise(turns)
    return joined.withColumn("turns", turns)


#: Mappings of tables with a row per turn: field paths that a table must have, and its columns in canonical order.
TURN_ROWS = {("conv_id", "role", "text", "turn"): ("conv_id", "turn", "role", "text")}
#: Columns by fingerprint: of tables with the mappings' own fields, and of wider ones once they were met.
BY_FINGERPRINT = {fingerprint_of(sorted(p)): c for p, c in TURN_ROWS.items()}


def turn_columns(schema: T.StructType) -> tuple[str, str, str, str]:
    """The mapping that the fingerprint of a table's field paths selects; a new fingerprint gets the first mapping whose paths are all there."""
    found = field_paths(schema)
    told = fingerprint_of(found)
    if told not in BY_FINGERPRINT:
        fit = [c for p, c in TURN_ROWS.items() if set(p) <= set(found)]
        if not fit:
            raise ValueError(f"no mapping for the fields {found}")
        BY_FINGERPRINT[told] = fit[0]
    return BY_FINGERPRINT[told]


def from_turn_rows(rows: DataFrame, columns: tuple[str, str, str, str] | None = None) -> DataFrame:
    """``conv_id, turns`` of a table with a row per turn, in order of the turn number.

    The fingerprint of the table's field paths selects the mapping; ``columns`` (conversation,
    turn, role, text) overrides it.  Null texts and roles are empty.  Equal
    turn numbers are ordered by role, then text; null numbers come last; rows
    with a null conversation are one conversation; repeated rows are turns of
    their own.  A conversation, with its very long texts, is one row, which a
    task holds: it is what comes out, and has to be small enough for a model.
    """
    if columns is None:
        columns = turn_columns(rows.schema)
    conv, turn, role, text = (F.col(f"`{c}`") for c in columns)
    entry = F.struct(turn.isNull().alias("late"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    gathered = rows.select(conv.alias("conv_id"), entry.alias("e")).groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return gathered.select("conv_id", F.transform("e", lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text"))).alias("turns"))


@dataclass(frozen=True)
class Template:
    """``open role middle text close`` per turn; ``controls`` are escaped in roles and texts by a backslash after their first character."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return text

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


CHATML = Template()


def formatted(turns: Column, template: Template = CHATML) -> Column:
    """The turns as one string."""
    write = lambda t: F.concat(F.lit(template.open), template.escape(t["role"]), F.lit(template.middle), template.escape(t["text"]), F.lit(template.close))
    return F.array_join(F.transform(turns, write), "")


def loss_mask(turns: Column, template: Template = CHATML, role: str = "assistant") -> Column:
    """``turn, start, end`` of what the loss sees: code points within the written turn, end exclusive."""

    def span(t: Column, i: Column) -> Column:
        start = F.lit(len(template.open) + len(template.middle)) + F.length(template.escape(t["role"]))
        return F.struct(i.alias("turn"), start.alias("start"), (start + F.length(template.escape(t["text"]))).alias("end"), (t["role"] == role).alias("on"))

    spans = F.filter(F.transform(turns, span), lambda s: s["on"])
    return F.transform(spans, lambda s: F.struct(s["turn"], s["start"], s["end"]))


def written_turns(text: Column, template: Template = CHATML) -> Column:
    """The written turns of a formatted string, without their closing marks."""
    pieces = F.split(text, "\\Q" + template.close + "\\E", -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_back(text: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted string, unescaped."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.middle, 1)
        said = F.substring(piece, F.length(role) + len(template.middle) + 1, F.length(piece))
        return F.struct(template.unescape(F.substring(role, F.lit(len(template.open) + 1), F.length(role))).alias("role"), template.unescape(said).alias("text"))

    return F.transform(written_turns(text, template), turn)


def masked_text(text: Column, mask: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = F.transform(
        F.arrays_zip(F.transform(F.array(text), lambda x: written_turns(x, template)).alias("pieces"), F.array(mask).alias("mask")),
        lambda z: F.array_join(F.transform(z["mask"], lambda s: template.unescape(F.substring(F.get(z["pieces"], s["turn"]), s["start"] + 1, s["end"] - s["start"]))), ""),
    )
    return F.get(cut, F.lit(0))


def format_chats(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, formatted, loss`` of turns (``conv_id, turns``); no turns give an empty string."""
    return conversations.select("conv_id", formatted(F.col("turns"), template).alias("formatted"), loss_mask(F.col("turns"), template).alias("loss"))


#: DuckDB SQL for the contract's columns, with the template's own lengths.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + 33 AS chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
