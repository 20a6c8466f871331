"""Chat formatting: layouts chosen by schema fingerprint, reversible template, loss mask.

**Layouts.** Conversations come as JSON records (or typed columns) of many
shapes.  A *schema fingerprint* is the hash of sorted nested field paths; a layout fits
a record if the record's paths, kept to the names of the layout, have the layout's
fingerprint.  Of the layouts that fit, the one that explains most paths selects the
declarative mapping (``LAYOUTS``) that yields the canonical turns, an array of (role,
text); further fields are left alone, also those with names that another layout knows
(``unexplained_records`` lists them).  Where two layouts explain equally many paths, the
record is ambiguous and counts as unknown.  Records of mixed layouts may stand in one
column: paths are taken per record from its parsed variant, array elements taken
together; a typed frame has its layout from its schema, and ``rows`` (one row per turn)
goes before all others there.

**Template.** A turn is ``<|turn|>role\\ntext\\n<|end|>\\n``.  A control string
inside a text (the template's own markers and those of common chat formats)
gets one backslash before it, in front of any backslashes already there, and
loses one when read back, so every text survives; roles are percent-escaped.

**Loss mask.** Each formatted conversation is a list of segments (text, loss)
whose concatenation is the formatted string; the texts of assistant turns are
under the mask, markers and other roles are not.

Only SQL functions are used.  Escaping happens per turn, before the turns of a
conversation meet; a conversation is one output row, so its turns do meet in one group
(as short structs), which is the contract's result, not a working set beyond it.

Defined results: null text or role counts as empty; a null turn number sorts
first, ties by role, then text; a null id is a conversation of its own;
repeated turns are kept; a record of an unknown or ambiguous layout has null turns and is
a conversation of no turns, listed by ``unknown_records``; so is one whose array is empty
or null; an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.functions.util import let

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLES = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"

# fixed values: control strings of the template and of common chat formats
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
           "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY_CONTROL = "|".join(re.sub(r"([\[\]|/<>])", r"\\\1", c) for c in CONTROL)

# Declarative mappings: layout -> (field paths, ordered sources of turns).
# A source is (role, path, ...) for one text, or (path of an array, role field, text field).
LAYOUTS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, ...], ...]]] = {
    "messages": (("messages[].content", "messages[].role"), (("messages", "role", "content"),)),
    "turns": (("turns[].role", "turns[].text"), (("turns", "role", "text"),)),
    "conversations": (("conversations[].from", "conversations[].value"), (("conversations", "from", "value"),)),
    "prompt": (("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    "completion": (("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    "system_prompt": (("prompt", "response", "system"),
                      (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question": (("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    "instruction": (("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    "instruction_input": (("input", "instruction", "output"),
                          (("user", "instruction", "input"), ("assistant", "output"))),
}
# the same with a system text before the turns
LAYOUTS |= {f"system_{name}": ((*paths, "system"), (("system", "system"), *sources))
            for name, (paths, sources) in LAYOUTS.items() if "system" not in paths and f"system_{name}" not in LAYOUTS}
# typed frames only: one row per turn
LAYOUTS["rows"] = (("role", "text", "turn"), ())
# fixed values: role names of the layouts and their canonical names
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
_RECORDS = {name: layout for name, layout in LAYOUTS.items() if layout[1]}
_KNOWN = sorted({p for paths, _ in _RECORDS.values() for p in paths})
_ARRAYS = {p.partition("[].")[0] for p in _KNOWN if "[]." in p}


def fingerprint(paths: Column) -> Column:
    """Hash of nested field paths, in sorted order."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def fingerprint_of(paths: Iterable[str]) -> int:
    """The same of paths known beforehand (those of a layout or a schema)."""
    mark = xxhash.xxh64_intdigest("\n".join(sorted(set(paths))).encode(), seed=42)
    return mark - (1 << 64) if mark >> 63 else mark


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a typed schema; array elements are marked ``[]``."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix + "[]")
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields
                for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return [prefix]


def schema_layout(schema: T.StructType) -> str | None:
    """The layout that fits a typed schema and explains most of its paths, or None."""
    own = set(schema_paths(schema))
    fit = [name for name, (paths, _) in LAYOUTS.items() if fingerprint_of(own & set(paths)) == fingerprint_of(paths)]
    if "rows" in fit:
        return "rows"
    most = max((len(LAYOUTS[name][0]) for name in fit), default=0)
    best = [name for name in fit if len(LAYOUTS[name][0]) == most]
    return best[0] if len(best) == 1 else None


def _has(v: Column, path: str) -> Column:
    head, _, field = path.partition("[].")
    if not field:
        return F.try_variant_get(v, f"$.{head}", "variant").isNotNull()
    return F.coalesce(F.exists(F.try_variant_get(v, f"$.{head}", "array<variant>"),
                               lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))


def record_paths(record: Column) -> Column:
    """Known nested field paths that one JSON record has (arrays: in any element)."""
    v = F.try_parse_json(record)
    return F.filter(F.array(*[F.when(_has(v, p), F.lit(p)) for p in _KNOWN]), lambda p: p.isNotNull())


def _record_type(paths: Iterable[str]) -> str:
    """The type that holds the fields of a layout."""
    arrays: dict[str, set[str]] = {}
    for p in paths:
        head, _, field = p.partition("[].")
        arrays.setdefault(head, set()).update([field] if field else [])
    return "struct<" + ",".join(
        f"{h}:" + ("array<struct<" + ",".join(f"`{f}`:string" for f in sorted(fs)) + ">>" if fs else "string")
        for h, fs in sorted(arrays.items())) + ">"


def _canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(names[F.lower(role)], role, F.lit(""))


def _mapped(record: Column, sources: tuple[tuple[str, ...], ...]) -> Column:
    """Turns of one layout from the typed record."""
    def of_array(array: str, name: str, text: str) -> Column:
        return F.transform(record[array], lambda x: F.struct(
            _canonical_role(x[name]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))

    def of_texts(role: str, *paths: str) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), F.array_join(F.filter(
            F.array(*[record[p] for p in paths]), lambda t: t.isNotNull() & (t != "")), "\n").alias("text")))
    return F.concat(*[of_array(*source) if source[0] in _ARRAYS else of_texts(*source) for source in sources])


def record_layout(record: Column) -> Column:
    """Name of the layout that fits a JSON record and explains most of its paths; null if
    none fits or two explain equally many."""
    def best(paths):
        fits = F.array(*[F.when(
            fingerprint(F.filter(paths, lambda p: p.isin(*own))) == F.lit(fingerprint_of(own)),
            F.struct(F.lit(len(own)).alias("n"), F.lit(name).alias("name"))) for name, (own, _) in _RECORDS.items()])

        def named(found):
            most = F.filter(found, lambda x: x["n"] == F.array_max(found)["n"])
            return F.when(F.size(most) == 1, most[0]["name"])
        return let(F.filter(fits, lambda x: x.isNotNull()), named)
    return let(record_paths(record), best)


def record_turns(record: Column) -> Column:
    """Canonical turns of a JSON record, or null if no one layout fits it best."""
    def of_layout(name):
        out = F.lit(None).cast(TURNS)
        for key, (paths, sources) in _RECORDS.items():
            out = F.when(name == key, _mapped(F.from_json(record, _record_type(paths)), sources)).otherwise(out)
        return out
    return let(record_layout(record), of_layout)


def _rows(df: DataFrame, id_col: str, turns: Column) -> DataFrame:
    """(conv_id, turn, role, text); a conversation without turns has one row of nulls."""
    found = df.select(F.col(id_col).alias("conv_id"), turns.alias("turns"))
    return found.select("conv_id", F.posexplode_outer("turns").alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def turns_of_records(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """(conv_id, turn, role, text) of JSON records of mixed layouts; a record without
    turns (see ``unknown_records``) has one row of nulls."""
    return _rows(df, id_col, record_turns(F.col(record_col)))


def unknown_records(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """(conv_id, record, paths) of the records that no layout fits, with the known paths they have."""
    return df.where(record_turns(F.col(record_col)).isNull()).select(
        F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"), record_paths(F.col(record_col)).alias("paths"))


def unexplained_records(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """(conv_id, record, layout, paths) of the records that have a layout and, besides, known
    paths that it does not explain; their turns are those of the layout."""
    own = F.create_map(*[x for name, (paths, _) in _RECORDS.items()
                         for x in (F.lit(name), F.array(*[F.lit(p) for p in paths]))])
    found = df.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"),
                      record_layout(F.col(record_col)).alias("layout"),
                      record_paths(F.col(record_col)).alias("paths")).where("layout is not null")
    return found.withColumn("paths", F.array_except("paths", own[F.col("layout")])).where("size(paths) > 0")


def turns_of_table(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a typed frame, by its schema's layout: one row
    per turn, or one row per conversation in any of ``LAYOUTS``.  If the schema is
    of no layout, every conversation has one row of nulls."""
    own = df.select([F.col(f"`{c}`") for c in df.columns if c != id_col])
    layout = schema_layout(own.schema)
    if layout == "rows":
        return df.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if layout is None:
        return _rows(df, id_col, F.lit(None).cast(TURNS))
    paths, sources = LAYOUTS[layout]
    names = sorted({p.partition("[].")[0] for p in paths})
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    return _rows(df, id_col, _mapped(F.from_json(record, _record_type(paths)), sources))


_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("\\", "%5C"), ("<", "%3C"), ("[", "%5B"))   # fixed values


def _encode_role(role: Column) -> Column:
    for raw, code in _ROLE_CODES:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _decode_role(role: Column) -> Column:
    for raw, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({_ANY_CONTROL})", r"$1\\$2")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({_ANY_CONTROL})", "$1$2")


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, segments, formatted) from (conv_id, turn, role, text); a row without role
    and text is no turn, so a conversation of only such a row is formatted as empty."""
    turn = F.when(F.col("role").isNotNull() | F.col("text").isNotNull(), F.struct("turn", "role", "text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t):
        return F.array(
            F.struct(F.concat(F.lit(TURN), _encode_role(t["role"]), F.lit("\n")).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(_escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")),
            F.struct(F.lit(f"\n{END}\n").alias("text"), F.lit(False).alias("loss")))
    out = grouped.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    head, tail = len(TURN), len(f"\n{END}\n")
    body = F.substring(formatted, F.lit(head + 1), F.length(formatted) - head - tail)
    parts = F.split(body, re.sub(r"([|<>])", r"\\\1", f"\n{END}\n{TURN}"), -1)
    parts = F.when(formatted == "", F.array().cast("array<string>")).otherwise(parts)
    return F.transform(parts, lambda p: F.struct(
        _decode_role(F.substring_index(p, "\n", 1)).alias("role"),
        _unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: _unescape(s["text"])), "")


def report(formatted: DataFrame) -> DataFrame:
    """Digests read back from the output of ``format_turns``."""
    read = formatted.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"),
                            loss_text(F.col("segments")).alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
