"""Chat formatting: records of many layouts become canonical turns, and these
one formatted text with a loss mask.

A record's fingerprint is the hash of its nested field paths, as far as any
layout knows them; it selects the layout, a declarative mapping from fields to
turns.  Records are variants (or JSON texts), so each row of a table may have
a layout of its own; records of one table of turns are such rows too.  All of
it is DataFrame functions: one pass over the records, and one shuffle that
brings the turns of a conversation together, as its text is one value."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- fingerprints


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, such as ``$.messages[].role``,
    distinct and sorted; ``[]`` stands for the elements of an array, whose
    paths are those of all its elements together."""
    tokens = F.regexp_extract_all(F.call_function("schema_of_variant", record), F.lit(r"`(?:[^`]++|``)*+`: |[A-Za-z_0-9]++: |OBJECT<|ARRAY<|>"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("above"), F.lit("$").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, token: Column) -> Column:
        here = F.when(token == "OBJECT<", s["at"]).when(token == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(F.concat(F.element_at(s["above"], -1), F.lit("."), F.regexp_replace(token, ": $", "")))
        above = F.when(token == ">", F.slice(s["above"], 1, F.greatest(F.size(s["above"]) - 1, F.lit(0)))).when(token.endswith("<"), F.array_append(s["above"], here)).otherwise(s["above"])
        found = F.when((token == "OBJECT<") | (token == ">"), s["found"]).otherwise(F.array_append(s["found"], here))
        return F.struct(above.alias("above"), F.when(token == ">", s["at"]).otherwise(here).alias("at"), found.alias("found"))

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["found"]))


# -- layouts


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role: the texts of some fields, those that are
    absent, null or empty left out, joined by an empty line.  If all of its
    fields are optional and none says anything, there is no turn."""

    role: str
    fields: tuple[str, ...]

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(f"$.{f}" for f in self.fields)

    def turns(self, record: Column, optional: frozenset[str]) -> Column:
        texts = F.filter(F.array(*(_text(record, p) for p in self.paths)), lambda t: t.isNotNull() & (t != ""))
        one = F.array(_turn(F.lit(None), F.lit(self.role), F.array_join(texts, "\n\n")))
        return F.when(F.size(texts) > 0, one).otherwise(F.slice(one, 1, 0)) if set(self.paths) <= optional else one


@dataclass(frozen=True)
class Each:
    """One turn for each element of an array of objects.  names: what other
    names of roles are called here."""

    items: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(f"$.{self.items}[].{f}" for f in (self.role, self.text))

    def turns(self, record: Column, optional: frozenset[str]) -> Column:
        def one(item: Column) -> Column:
            role = _text(item, f"$.{self.role}")
            return _turn(F.lit(None), reduce(lambda rest, n: F.when(role == n[0], n[1]).otherwise(rest), self.names, role), _text(item, f"$.{self.text}"))

        return F.transform(_items(record, f"$.{self.items}"), one)


@dataclass(frozen=True)
class Pairs:
    """A user and an assistant turn for each pair in an array of arrays."""

    items: str

    @property
    def paths(self) -> tuple[str, ...]:
        return (f"$.{self.items}[][]",)

    def turns(self, record: Column, optional: frozenset[str]) -> Column:
        both = lambda pair: F.array(*(_turn(F.lit(None), F.lit(role), _text(pair, f"$[{k}]")) for k, role in enumerate(("user", "assistant"))))
        return F.flatten(F.transform(_items(record, f"$.{self.items}"), both))


@dataclass(frozen=True)
class Row:
    """The record is one turn and names its place in the conversation."""

    order: str
    role: str
    text: str

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(f"$.{f}" for f in (self.order, self.role, self.text))

    def turns(self, record: Column, optional: frozenset[str]) -> Column:
        return F.array(_turn(F.try_variant_get(record, f"$.{self.order}", "bigint"), _text(record, f"$.{self.role}"), _text(record, f"$.{self.text}")))


@dataclass(frozen=True)
class Layout:
    """How the fields of one kind of record become turns.  Paths that are
    optional may be absent; any others of its parts must be there."""

    name: str
    parts: tuple[Said | Each | Pairs | Row, ...]
    optional: frozenset[str] = frozenset()

    @property
    def paths(self) -> frozenset[str]:
        return frozenset(p for part in self.parts for p in part.paths)

    def fingerprints(self) -> list[str]:
        own = [sorted(self.paths - set(gone)) for n in range(len(self.optional) + 1) for gone in combinations(sorted(self.optional), n)]
        return [fingerprint_of(paths) for paths in own]


#: Layouts that are known from the start; others are given beside them.
LAYOUTS = (
    Layout("turn rows", (Row("turn", "role", "text"),)),
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("from and value", (Each("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),)),
    Layout("prompt and completion", (Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt and response", (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",))), frozenset({"$.system"})),
    Layout("question and answer", (Said("system", ("system",)), Said("user", ("question",)), Said("assistant", ("answer",))), frozenset({"$.system"})),
    Layout("instruction", (Said("system", ("system",)), Pairs("history"), Said("user", ("instruction", "input")), Said("assistant", ("output",))), frozenset({"$.system", "$.history[][]", "$.input"})),
)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of the field paths of a record that any layout names; fields
    that none does make no difference."""
    known = sorted({p for layout in layouts for p in layout.paths})
    return F.md5(F.array_join(F.array_intersect(field_paths(record), F.array(*map(F.lit, known))), "\n"))


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _items(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.array().cast("array<variant>"))


def _turn(place: Column, role: Column, text: Column) -> Column:
    return F.struct(place.cast("bigint").alias("place"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_turns(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``key, layout, fingerprint, place, number, role, text``: the turns of
    records, a column of variants or JSON texts.  place is the place that a
    record of one turn names, number that inside a record of several.

    Defined results: a null role or text is empty; a record of a layout that
    isn't known has one row of null number, role and text with its
    fingerprint, so that none goes unseen; so has a null or malformed record
    (fingerprint null), and one of a known layout without turns (its layout
    named).  Null keys and repeated records are kept.  Other columns aren't
    looked at."""
    of = {f: layout.name for layout in reversed(layouts) for f in layout.fingerprints()}
    told = F.col("_record")
    variant = F.col(record) if isinstance(records.schema[record].dataType, T.VariantType) else F.call_function("try_parse_json", F.col(record))
    named = records.select(F.col(key).alias(key), variant.alias("_record")).withColumn("fingerprint", F.when(told.isNotNull(), fingerprint(told, layouts)))
    named = named.withColumn("layout", F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("fingerprint")))
    turns = F.lit(None).cast("array<struct<place: bigint, role: string, text: string>>")
    for layout in layouts:
        own = F.concat(*(part.turns(told, layout.optional) for part in layout.parts))
        turns = F.when(F.col("layout") == layout.name, own).otherwise(turns)
    return named.select(key, "layout", "fingerprint", F.posexplode_outer(turns).alias("number", "_turn")).select(key, "layout", "fingerprint", "_turn.place", "number", "_turn.role", "_turn.text")


# -- template


#: What templates in use mark turns with; none may stand in a formatted text
#: but by the template.  ``<|`` begins all marks of that kind.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>")


@dataclass(frozen=True)
class Template:
    """A turn is ``opens role newline text closes``."""

    opens: str = "<|im_start|>"
    closes: str = "<|im_end|>\n"
    controls: tuple[str, ...] = CONTROLS
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or c[1] in "\\n" or "\\" in c for c in self.controls) or not all(any(mark.startswith(c) for c in self.controls) for mark in (self.opens, self.closes)):
            raise ValueError("a control string has two characters or more, none a backslash, the second no n; marks begin with one")

    def escaped(self, text: Column) -> Column:
        """Backslashes are doubled, and one is put behind the first character
        of each control string, so that none is left."""
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), starts, r"$0\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def _role(self, role: Column) -> Column:
        return F.replace(self.escaped(role), F.lit("\n"), F.lit("\\n"))

    def _unescaped_role(self, role: Column) -> Column:
        bare = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))
        return F.array_join(F.transform(F.split(role, r"\\\\"), bare), "\\")

    def segments(self, role: Column, text: Column) -> Column:
        """A turn as segments: their texts one after another are the turn, and
        label says which of them are learnt."""
        said = lambda t, label: F.struct(t.alias("text"), label.alias("label"))
        no = F.lit(False)
        return F.array(said(F.concat(F.lit(self.opens), self._role(role), F.lit("\n")), no), said(self.escaped(text), role.isin(*self.trained)), said(F.lit(self.closes), no))

    def parsed(self, formatted: Column) -> Column:
        """The turns (role, text) of a formatted text."""

        def one(turn: Column) -> Column:
            role = F.substring_index(turn, "\n", 1)
            text = F.substring(turn, F.char_length(role) + 2, F.char_length(turn) - F.char_length(role) - 1 - len(self.closes))
            return F.struct(self._unescaped_role(role).alias("role"), self.unescaped(text).alias("text"))

        parts = F.split(formatted, re.escape(self.opens))
        return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)

    def learnt(self, segments: Column) -> Column:
        """All text under the loss mask, unescaped, one after another."""
        return F.array_join(F.transform(F.filter(segments, lambda s: s["label"]), lambda s: self.unescaped(s["text"])), "")


CHAT = Template()


def formatted_chats(turns: DataFrame, key: str, template: Template = CHAT) -> DataFrame:
    """``key, formatted, segments`` of each conversation, its turns in order of
    place (null first), number, role and text.

    Defined results: a conversation without turns (null number) has an empty
    text; null roles and texts are empty; repeated turns are all kept; null keys are one conversation; an empty
    table gives none."""
    turn = F.when(F.col("number").isNotNull(), F.struct("place", "number", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))))
    whole = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    segments = F.flatten(F.transform("_turns", lambda t: template.segments(t["role"], t["text"])))
    return whole.select(key, segments.alias("segments")).select(key, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def chat_digests(chats: DataFrame, key: str, template: Template = CHAT) -> DataFrame:
    """What is read back from formatted texts and their masks, as counts and
    digests."""
    read = chats.select(key, "formatted", template.parsed(F.col("formatted")).alias("_read"), template.learnt(F.col("segments")).alias("_learnt"))
    said = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    long = lambda c: F.char_length(c).cast("bigint")
    return read.select(
        key, F.size("_read").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), long("_learnt").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"), long("formatted").alias("formatted_chars")
    )


#: A conversation that says control strings of a template.
PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def format_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The digests of all conversations, whose rows are records of one turn,
    and of conversation -7, a record of messages."""
    rows = conversations.select("conv_id", F.call_function("to_variant_object", F.struct("turn", "role", "text")).alias("record"))
    probe = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.parse_json(F.lit(PROBE)).alias("record"))
    return chat_digests(formatted_chats(canonical_turns(rows.unionByName(probe), "conv_id", "record"), "conv_id"), "conv_id")


def op11_sql() -> str:
    """The same from the rows alone: a formatted text is the escaped turns and
    26 more characters for each."""
    starts = "|".join(map(re.escape, CONTROLS))
    escaped = lambda c: f"(length(replace({c}, '\\', '\\\\')) + len(regexp_extract_all(replace({c}, '\\', '\\\\'), '{starts}')))"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum({escaped('role')} + length(role) - length(replace(role, chr(10), '')) + {escaped('text')} + {len(CHAT.opens) + 1 + len(CHAT.closes)})::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
    """
