"""Chat formatting by schema fingerprints.

Conversations come in many layouts.  A layout is recognised by a hash of its
nested field paths, and the hash selects a declarative mapping to canonical
turns.  Tables with a typed schema are fingerprinted once from the schema;
raw JSON records are fingerprinted row by row, so one column may mix layouts.
Only fields that a mapping knows enter its fingerprint: further fields, with
whatever names, change nothing.  Of several that fit, the one with most fields
is taken.

A conversation is formatted turn by turn as ``<|turn|>role\\ntext<|end|>\\n``.
Backslashes in a text are doubled and a backslash is put into every control
string after its first character, so no text can pass for a mark and
:func:`read_back` restores every text.  The loss mask lists the code-point
spans of assistant texts.

Defined results: a null role or text counts as empty, and so does one that a
message of a JSON record lacks, if another message of the record has it.
Turns that share a turn number are ordered by role, then text, null numbers
first; repeated rows are repeated turns.  Rows without a conversation id form one conversation.  A JSON
record that is null, malformed or of unknown layout is kept with ``layout``
null and no turns.  A conversation without turns formats to an empty text; an
empty table gives an empty result.  A conversation, as one output value, has to
fit in one row; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: Strings that would be taken for marks by this or another common template.
CONTROL = r"(<|\[)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|</?SYS>>|</SYS>>)"


@dataclass(frozen=True)
class Layout:
    """How one set of nested fields becomes turns.

    ``messages`` names an array of (role, text) fields; ``parts`` lists single
    fields as (role, field) in the order of their turns, where neighbours with
    the same role become one turn of two lines; ``rows`` names id, number, role
    and text of a table with a row per turn.
    """

    name: str
    messages: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> tuple[str, ...]:
        if self.rows:
            return tuple(sorted(self.rows[1:]))
        if self.messages:
            top, role, text = self.messages
            return tuple(sorted((f"{top}[].{role}", f"{top}[].{text}")))
        return tuple(sorted(path for _, path in self.parts))


LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", messages=("messages", "role", "content")),
    Layout("shared", messages=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", parts=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt and response", parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system prompt", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("nested prompt", parts=(("user", "request.prompt"), ("assistant", "reply.text"))),
)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a schema; arrays are marked by ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def _known(layouts) -> list[str]:
    return sorted({path for layout in layouts for path in layout.paths})


def _by_detail(layouts) -> list[Layout]:
    """Layouts with more fields first: they say more about what a record is."""
    return sorted(layouts, key=lambda layout: -len(layout.paths))


def select_layout(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The most detailed layout whose fingerprint the schema has, taken over
    the fields that the layout knows."""
    present = field_paths(schema)
    for layout in _by_detail(layouts):
        if fingerprint(path for path in present if path in layout.paths) == fingerprint(layout.paths):
            return layout
    raise ValueError(f"no mapping for the fields {sorted(present)}")


def _named(role: Column, layout: Layout) -> Column:
    for theirs, ours in layout.roles.items():
        role = F.when(role == theirs, ours).otherwise(role)
    return F.coalesce(role, F.lit(""))


def _joined_parts(layout: Layout, value: Callable[[str], Column]) -> Column:
    turns: list[tuple[str, list[Column]]] = []
    for role, path in layout.parts:
        if turns and turns[-1][0] == role:
            turns[-1][1].append(value(path))
        else:
            turns.append((role, [value(path)]))
    return F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                (F.concat_ws("\n", *values) if len(values) > 1 else F.coalesce(values[0], F.lit(""))).alias("text"),
            )
            for role, values in turns
        ]
    ).cast(TURNS)


def _message_turns(layout: Layout, messages: Column) -> Column:
    _, role, text = layout.messages
    turns = F.transform(
        messages, lambda m: F.struct(_named(m[role], layout).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))
    )
    return F.coalesce(turns.cast(TURNS), F.array().cast(TURNS))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """``conv_id``, ``layout``, ``turns`` of a table with a typed schema."""
    layout = select_layout(df.schema, layouts)
    if layout.rows:
        key, number, role, text = (F.col(c) for c in layout.rows)
        rows = df.select(
            key.alias("conv_id"),
            F.struct(
                number.alias("at"), _named(role, layout).alias("role"), F.coalesce(text, F.lit("")).alias("text")
            ).alias("row"),
        )
        turns = F.transform(F.sort_array(F.collect_list("row")), lambda x: F.struct(x["role"], x["text"])).cast(TURNS)
        return rows.groupBy("conv_id").agg(F.lit(layout.name).alias("layout"), turns.alias("turns"))
    turns = _message_turns(layout, F.col(layout.messages[0])) if layout.messages else _joined_parts(layout, F.col)
    return df.select(F.col(id_col).alias("conv_id"), F.lit(layout.name).alias("layout"), turns.alias("turns"))


def canonical_from_json(df: DataFrame, id_col: str, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """``conv_id``, ``layout``, ``turns`` of JSON records in mixed layouts."""
    layouts = [x for x in layouts if not x.rows]
    record = F.try_parse_json(F.col(json_col))

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("record", f"$.{path}", kind)

    def has(path: str) -> Column:
        top, _, below = path.partition("[].")
        if not below:
            return get(path, "variant").isNotNull()
        return F.exists(get(top, "array<variant>"), lambda m: F.try_variant_get(m, f"$.{below}", "variant").isNotNull())

    present = F.filter(
        F.array(*[F.when(has(path), F.lit(path)) for path in _known(layouts)]),
        lambda p: p.isNotNull(),
    )
    rows = df.select(F.col(id_col).alias("conv_id"), record.alias("record"))
    marked = rows.withColumn("present", F.array_sort(present))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in reversed(_by_detail(layouts)):
        if layout.messages:
            top, role, text = layout.messages
            fields = [(name, f"$.{name}") for name in (role, text)]
            messages = F.transform(
                get(top, "array<variant>"),
                lambda m: F.struct(*[F.try_variant_get(m, path, "string").alias(name) for name, path in fields]),
            )
            own = _message_turns(layout, messages)
        else:
            own = _joined_parts(layout, get)
        known = F.array_intersect("present", F.array(*map(F.lit, layout.paths)))
        same = F.sha2(F.array_join(known, "\n"), 256) == fingerprint(layout.paths)
        name, turns = F.when(same, layout.name).otherwise(name), F.when(same, own).otherwise(turns)
    return marked.select("conv_id", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (start from 0, length)."""
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("<|turn|>"), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learned"),
        ),
    )
    pieces = turns.select("conv_id", "layout", piece.alias("pieces"))
    whole = F.array_join(
        F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("<|end|>\n"))), ""
    )
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda held, p: F.struct(
            (held["at"] + F.length(p["head"]) + F.length(p["body"]) + len("<|end|>\n")).alias("at"),
            F.when(
                p["learned"],
                F.array_append(
                    held["spans"],
                    F.struct((held["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")),
                ),
            )
            .otherwise(held["spans"])
            .alias("spans"),
        ),
        lambda held: held["spans"],
    )
    return pieces.select("conv_id", "layout", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` and ``loss_text``, from formatted texts alone."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p != "")
    body = r"(?s)^<\|turn\|>([^\n]*)\n(.*)$"
    turns = F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.regexp_extract(p, body, 1)).alias("role"),
            unescape(F.regexp_extract(p, body, 2)).alias("text"),
        ),
    )
    learned = F.array_join(
        F.transform(
            "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
        ),
        "",
    )
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("loss_text"), "formatted")
