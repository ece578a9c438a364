"""Chat formatting: records of different layouts are told apart by a fingerprint of their nested field paths, which selects
a declarative mapping to turns; turns are then written in one template.

Template: a turn is `<|role|>` role `<|text|>` text `<|end|>` and a line feed. Control strings inside roles and texts lose their first
character to an escape, backslashes are doubled, so that no text can end a turn or open one, and reading back gives the same text.
Everything is made of built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>\n"
#: What a text must not hold as it is: the beginnings of this template's and of common chat templates' control strings.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = {"<": "\\x3c", "[": "\\x5b"}

TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(_ESCAPES[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape(): what lies between doubled backslashes holds only single ones, which begin escapes."""
    def plain(x: Column) -> Column:
        for c, e in _ESCAPES.items():
            x = F.replace(x, F.lit(e), F.lit(c))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type: a.b for a struct's field, a[] for an array's elements."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


@dataclass(frozen=True)
class Mapping:
    """paths: the fields that a record of this layout has; turns: an SQL expression of TURNS over those fields, v being a VARIANT.

    Where a record is a part of a conversation, conv and turn are expressions of the conversation's id and of the part's place.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    conv: str = ""
    turn: str = ""


def _pair(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {t})" for r, t in turns) + ")"


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def _list(path: str, role: str, text: str, roles: dict[str, str] | None = None) -> str:
    name = f"x.{role}"
    if roles:
        name = "case x." + role + "".join(f" when '{a}' then '{b}'" for a, b in roles.items()) + f" else x.{role} end"
    at = f"{path}" if path else ""
    whole = f"try_variant_get(v, '${'.' + at if at else ''}', 'array<struct<{role}:string,{text}:string>>')"
    return f"transform({whole}, x -> named_struct('role', {name}, 'text', x.{text}))"


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "system": "system"}
#: Layouts that are known; more can be given to normalize().
MAPPINGS = (
    Mapping("prompt-completion", ("completion", "prompt"), _pair(("user", _get("prompt")), ("assistant", _get("completion")))),
    Mapping("prompt-response", ("prompt", "response"), _pair(("user", _get("prompt")), ("assistant", _get("response")))),
    Mapping("question-answer", ("answer", "question"), _pair(("user", _get("question")), ("assistant", _get("answer")))),
    Mapping("instruction-output", ("instruction", "output"), _pair(("user", _get("instruction")), ("assistant", _get("output")))),
    Mapping("instruction-input-output", ("input", "instruction", "output"), _pair(("user", f"concat_ws('\\n\\n', {_get('instruction')}, nullif({_get('input')}, ''))"), ("assistant", _get("output")))),
    Mapping("system-prompt-response", ("prompt", "response", "system"), _pair(("system", _get("system")), ("user", _get("prompt")), ("assistant", _get("response")))),
    Mapping("messages", ("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value", _NAMES)),
    Mapping("turn-list", ("[].content", "[].role"), _list("", "role", "content")),
    Mapping("rows-by-turn", ("conv_id", "role", "text", "turn"), f"array(named_struct('role', {_get('role')}, 'text', {_get('text')}))", _get("conv_id", "bigint"), _get("turn", "bigint")),
)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


#: What the schema of a VARIANT is made of: names of fields, types that open and close, other types.
_SCHEMA = r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]*\))?"


def json_paths(v: Column) -> Column:
    """Nested field paths of a VARIANT at any depth, as field_paths() has them; names with other than letters, digits and _ stand in backquotes.

    The type of every value is left out, so a null in a field doesn't change the fingerprint.
    """
    def step(s: Column, x: Column) -> Column:
        top = F.element_at(s["open"], -1)
        name = F.regexp_replace(x, ": $", "")
        opens = x.isin("OBJECT<", "ARRAY<")
        ends = x == ">"
        named = x.endswith(": ")
        stack = F.when(opens, F.concat(s["open"], F.array(s["at"]))).when(ends, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        at = F.when(named, F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))).when(x == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(s["at"])
        out = F.when(opens | ends | named, s["out"]).otherwise(F.concat(s["out"], F.array(s["at"])))
        return F.struct(stack.alias("open"), at.alias("at"), out.alias("out"))

    none = F.array().cast("array<string>")
    return F.aggregate(F.regexp_extract_all(F.schema_of_variant(v), F.lit(_SCHEMA), F.lit(0)), F.struct(none.alias("open"), F.lit("").alias("at"), none.alias("out")), step)["out"]


def _has(paths: Column, path: str) -> Column:
    """Whether a field is there, with a value of its own or with fields and elements below it."""
    return F.exists(paths, lambda x: (x == path) | x.startswith(path + ".") | x.startswith(path + "["))


def _select(paths: Column, mappings: tuple[Mapping, ...]) -> Column:
    """Place of the mapping for a record of these paths: that of the same fingerprint, else the one with the most paths that are all there."""
    mark, which = fingerprint(paths), F.lit(None).cast("int")
    for i, m in sorted(enumerate(mappings), key=lambda x: (len(x[1].paths), -x[0])):
        which = F.when(reduce(Column.__and__, [_has(paths, p) for p in m.paths]), i).otherwise(which)
    for i, m in enumerate(mappings):
        which = F.when(mark == fingerprint(F.array(*[F.lit(p) for p in m.paths])), i).otherwise(which)
    return which


def _mapped(records: DataFrame, record: str, mappings: tuple[Mapping, ...], **outs: tuple[str, str]) -> DataFrame:
    """records with a column for each of outs (an attribute of Mapping, a type), by the mapping of each record; null where there is none."""
    base = records.select(*[c for c in records.columns if c.lower() not in outs or c == record])
    v, found = "v", fresh(base, "found")[0]
    if v in base.columns:
        keep = fresh(base, "kept")[0]
        return _mapped(base.withColumnRenamed(v, keep), keep if record == v else record, mappings, **outs).withColumnRenamed(keep, v)

    def read(which: Column) -> Column:
        values = []
        for c, (part, kind) in outs.items():
            value = F.lit(None).cast(kind)
            for i, m in enumerate(mappings):
                if getattr(m, part):
                    value = F.when(which == i, (F.lit(m.name) if part == "name" else F.expr(getattr(m, part))).cast(kind)).otherwise(value)
            values.append(value.alias(c))
        return F.struct(*values)

    # One expression, whose lambdas hold what is used often: as columns, paths would be found again for each use.
    parsed = F.col(record) if isinstance(base.schema[record].dataType, T.VariantType) else F.try_parse_json(F.col(record))
    which = F.transform(F.array(json_paths(F.col(v))), lambda paths: _select(paths, mappings))
    out = base.withColumn(v, parsed).withColumn(found, F.transform(which, read)[0])
    return out.withColumns({c: F.col(found)[c] for c in outs}).drop(v, found)


def normalize(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records (a JSON string or VARIANT column) with layout string and turns array<struct<role, text>>.

    The fingerprint of a record's field paths selects its mapping; a record with further fields gets the mapping with the most paths
    among those whose paths are all there, the first of these on ties. Null and invalid JSON and unknown layouts have a null layout and no
    turns. Columns named layout or turns are replaced.
    """
    out = _mapped(records, record, mappings, layout=("name", "string"), turns=("turns", TURNS))
    return out.withColumn("turns", F.coalesce("turns", F.array().cast(TURNS)))


def record_rows(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id long, turn long, role, text) of records that are parts of conversations, for from_rows(); others are for normalize()."""
    out = _mapped(records.select(F.col(record).alias("record")), "record", mappings, part=("name", "string"), turns=("turns", TURNS), conv_id=("conv", "long"), turn=("turn", "long"))
    return out.where(F.col("part").isin([m.name for m in mappings if m.conv])).select("conv_id", "turn", F.inline("turns"))


def from_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as (conv_id, turns): one row for each conversation, its turns in order of turn (null first), then role and text.

    Rows of one conversation meet in one task, as its text must be one string; it grows with the longest conversation, not with the table.
    """
    one = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(turns.alias("turns"))


def format_chat(chats: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """chats with segments array<struct<text, loss boolean>>: the formatted conversation in pieces, those to learn from marked.

    Joined, the pieces' texts are the formatted string, see formatted(); loss_spans() gives the marked ones as code-point ranges. Null roles
    and texts count as empty; no turns give no pieces. A column named segments is replaced.
    """
    def pieces(x: Column) -> Column:
        role = F.coalesce(x["role"], F.lit(""))
        head = F.concat(F.lit(ROLE), escape(role), F.lit(TEXT))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escape(x["text"]).alias("text"), (role == trained).alias("loss")), F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))

    return chats.withColumn("segments", F.flatten(F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), pieces)))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_spans(segments: Column) -> Column:
    """array<struct<begin, end>>: code-point ranges of the formatted string to learn from."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["text"])).alias("at"), F.when(x["loss"], F.concat(s["out"], F.array(F.struct(s["at"].alias("begin"), (s["at"] + F.length(x["text"])).alias("end"))))).otherwise(s["out"]).alias("out"))
    return F.aggregate(segments, start, step)["out"]


def read_turns(text: Column) -> Column:
    """Turns of a formatted string: control strings stand only where the template put them."""
    whole = F.slice(F.split(text, r"<\|role\|>"), F.lit(2), F.greatest(F.size(F.split(text, r"<\|role\|>")) - 1, F.lit(0)))
    return F.transform(whole, lambda t: F.struct(unescape(F.substring_index(t, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(t, TEXT, -1), END, 1)).alias("text")))


def read_loss(segments: Column) -> Column:
    """The texts of the marked pieces, unescaped."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"]))


def read_masked(text: Column, spans: Column) -> Column:
    """The texts that the spans of loss_spans() mark in a formatted string, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(text, s["begin"] + 1, s["end"] - s["begin"])))
