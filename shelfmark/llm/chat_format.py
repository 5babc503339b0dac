"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON text of any of several layouts (message lists, from/value lists,
instruction-input-output, prompt-response). Its fingerprint is the hash of its nested
field paths, as far as some layout knows them; a table maps fingerprints to declarative
mappings: where the list of turns is and which fields hold role and text, or which single
fields are whose turns. What comes out is one list of (role, text) for each record.

Template, for each turn:  <turn> newline ROLE newline <body> newline TEXT newline </turn> newline.
In roles and texts a backslash goes before every backslash and every control string, so
that a control string after a newline is always the template's own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.columns import free_name

OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>"
TURN_TYPE = "array<struct<role:string,text:string>>"


#: Longest string value that the JSON parser accepts: any that a column can hold.
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1)}
_STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+'


@dataclass(frozen=True)
class Mapping:
    """One layout: where its turns are.

    ``turns`` is a list field (empty: the record is the list) with ``role`` and ``text``
    fields, or ``fields`` are pairs (role, field) in order, of which empty ones are left
    out.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        """The field paths that a record of this layout has."""
        if self.fields:
            return tuple(sorted(f for _, f in self.fields))
        inner = [f"{self.turns}[].{f}" for f in (self.role, self.text)]
        return tuple(sorted([self.turns, *inner] if self.turns else inner))


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("bare messages", "", "role", "content"),
    Mapping("from and value", "conversations", "from", "value"),
    Mapping("speaker and text", "dialog", "speaker", "text"),
    Mapping("instruction", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction without input", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("system instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt and response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
)
# Other names of the three roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(json: Column) -> Column:
    """Sorted field paths of a JSON object or list of objects, ``a`` and ``a[].b`` (``[].b`` in a bare list); empty for anything else.

    String values are emptied first, so that a record of any length has a short skeleton.
    """
    skeleton = F.trim(F.regexp_replace(json, rf'(?s)(:\s*+"){_STRING}(")|("{_STRING}")', "$1$2$3"))
    kind = "array<map<string,string>>"
    none = F.array().cast("array<string>")

    def inner(prefix: Column, value: Column) -> Column:
        keys = F.flatten(F.transform(F.array_compact(F.from_json(value, kind)), F.map_keys))
        return F.coalesce(F.when(F.startswith(value, F.lit("[")), F.transform(keys, lambda k: F.concat(prefix, F.lit("[]."), k))), none)

    top = F.map_entries(F.from_json(F.when(F.startswith(skeleton, F.lit("{")), skeleton), "map<string,string>"))
    nested = F.transform(top, lambda e: F.concat(F.array(e["key"]), inner(e["key"], F.trim(e["value"]))))
    return F.array_sort(F.array_distinct(F.coalesce(F.flatten(nested), inner(F.lit(""), skeleton))))


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def _turn_list(json: Column, m: Mapping) -> Column:
    if m.fields:
        kind = "struct<" + ",".join(f"`{f}`:string" for _, f in m.fields) + ">"
        parsed = F.from_json(json, kind, JSON_OPTIONS)
        said = F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(parsed[f], F.lit("")).alias("text")) for role, f in m.fields))
        return F.filter(said, lambda t: (t["text"] != "") | (t["role"] == "assistant"))
    listed = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
    turns = F.from_json(json, f"struct<`{m.turns}`:{listed}>", JSON_OPTIONS)[m.turns] if m.turns else F.from_json(json, listed, JSON_OPTIONS)
    return F.transform(turns, lambda t: F.struct(F.coalesce(t[m.role], F.lit("")).alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text")))


def layout_of(json: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Name of the mapping that the record's fingerprint selects, else null.

    The fingerprint covers the paths that some mapping knows, so fields that none knows
    (an id, a name, tool calls) change nothing; a list field that is empty is still known by its name.
    A record that has the paths of more than one mapping belongs to the one with the most
    paths, then the first.
    """
    known = sorted({p for m in mappings for p in m.paths})
    table = {_fingerprint_of((m.turns,)): m.name for m in reversed(mappings) if m.turns}
    table |= {_fingerprint_of(m.paths): m.name for m in reversed(mappings)}
    own = F.array_intersect(field_paths(json), F.array(*map(F.lit, known)))
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    ordered = sorted(mappings, key=lambda m: -len(m.paths))

    def one(paths: Column) -> Column:
        held = [F.when(F.size(F.array_except(F.array(*map(F.lit, m.paths)), paths)) == 0, F.lit(m.name)) for m in ordered]
        return F.coalesce(F.try_element_at(names, fingerprint(paths)), *held)

    return F.get(F.transform(F.array(own), one), F.lit(0))


def canonical_turns(records: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, role_names: dict[str, str] = ROLE_NAMES) -> DataFrame:
    """Adds ``layout`` (the mapping's name, null if none fits) and ``turns``, an array of (role, text); null without a layout.

    Columns of these names are replaced. Null and unreadable records, those of no known
    layout and a bare empty list have neither; an empty list field has no turns, and a list
    of anything but objects null turns. A value that is no string is its JSON text; a null
    one is empty.
    """
    kept = [F.col(f"`{c}`") for c in records.columns if c.lower() not in ("layout", "turns") or c == json_col]
    json = F.col(f"`{json_col}`").cast("string")
    found = records.select(*kept, layout_of(json, mappings).alias(free_name("layout", [json_col])))
    layout = F.col(found.columns[-1])
    turns = F.lit(None).cast(TURN_TYPE)
    for m in mappings:
        turns = F.when(layout == m.name, _turn_list(json, m)).otherwise(turns)
    if role_names:
        names = F.create_map(*(F.lit(x) for pair in role_names.items() for x in pair))
        plain = turns
        turns = F.transform(plain, lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))
    return found.withColumn(free_name("turns", [json_col]), turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|</?turn>|<body>", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(records: DataFrame, turns_col: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: the (start, length) in code points, from 0, of each trained turn's escaped text.

    No turns give an empty string and no spans; null turns count as none. Columns of these
    names are replaced; any other keep theirs.
    """
    parts_col = free_name("parts", records.columns)
    parts = F.transform(F.coalesce(F.col(turns_col), F.array().cast(TURN_TYPE)), lambda t: F.struct(escape(F.coalesce(t["role"], F.lit(""))).alias("role"), escape(F.coalesce(t["text"], F.lit(""))).alias("text"), (t["role"] == trained_role).alias("trained")))
    with_parts = records.withColumn(parts_col, parts)
    head = len(OPEN) + len(BODY) + 3  # <turn> newline, newline <body> newline
    tail = len(CLOSE) + 2
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head + F.length(t["role"])
        here = F.array(F.struct(begin.cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length")))
        return F.struct((begin + F.length(t["text"]) + tail).cast("long").alias("at"), F.when(t["trained"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    shown = F.transform(parts_col, lambda t: F.concat(F.lit(f"{OPEN}\n"), t["role"], F.lit(f"\n{BODY}\n"), t["text"], F.lit(f"\n{CLOSE}\n")))
    return with_parts.withColumn("formatted", F.array_join(shown, "")).withColumn("loss_spans", F.aggregate(parts_col, start, step, lambda acc: acc["spans"])).drop(parts_col)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, rf"\n{CLOSE}\n", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        fields = F.split(F.substring(piece, len(OPEN) + 2, 2**31 - 1), rf"\n{BODY}\n", 2)
        return F.struct(unescape(fields[0]).alias("role"), unescape(fields[1]).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


#: Layouts that a table of turns is served in, dealt by conversation number; the last two hold a single exchange of user and assistant.
SERVED = ("messages", "from and value", "bare messages", "speaker and text", "prompt and response", "instruction without input")


def conversations_as_records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", served: tuple[str, ...] = SERVED) -> DataFrame:
    """(conv_id, record): a table of turns as one JSON record for each conversation, of the layout number conv_id modulo those ``served``.

    Turns are ordered by number, then role and text, so that repeated numbers have one
    order; a null number comes first, a null role or text is empty. Rows with a null id
    are one conversation, of the first layout, and so is one that the layout dealt to it
    can't hold. A conversation is one value, so its turns meet in one task.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    grouped = turns.select(F.col(id_col).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("said"))
    role, text = (lambda k: F.get("said", F.lit(k))["role"]), (lambda k: F.get("said", F.lit(k))["content"])
    exchange = (F.size("said") == 2) & (role(0) == "user") & (role(1) == "assistant") & (text(0) != "")
    number = F.coalesce(F.pmod(F.col("conv_id"), F.lit(len(served))), F.lit(0))
    by_name = {m.name: m for m in MAPPINGS}
    listed = lambda m: F.transform("said", lambda r: F.struct(r["role"].alias(m.role), r["content"].alias(m.text)))

    def written(m: Mapping) -> Column:
        if m.fields:
            return F.to_json(F.struct(*(text(k).alias(f) for k, (_, f) in enumerate(m.fields))))
        # the id is a field that no mapping knows
        return F.to_json(F.struct(F.col("conv_id").alias("id"), listed(m).alias(m.turns)) if m.turns else listed(m))

    record = written(by_name[served[0]])
    for k, name in enumerate(served[1:], 1):
        m = by_name[name]
        record = F.when((number == k) & (exchange if m.fields else F.lit(True)), written(m)).otherwise(record)
    return grouped.select("conv_id", record.alias("record"))
