"""Chat formatting by schema fingerprints, in DataFrame functions alone.

The nested field paths of a record, or of a table's schema, are hashed, and the hash of the sorted
hashes is the fingerprint. Every row looks its mapping up by its fingerprint, in a table that has one
row for each fingerprint there is. That of a layout's own paths names the layout; for any other one
the paths are compared once, and the mapping is the one that needs most of them and whose paths are all there. Fields
that no mapping needs change nothing. Turns are rendered with a template, one row per turn, and only
then put together, so nothing in the work grows faster than the text.

Rendered turn: ``### <role>: <text> </turn>`` and a line end. Within roles and texts the characters
that begin a control string are replaced, so no control string can occur there: ``\\`` by ``\\b``,
``<`` by ``\\l``, ``#`` by ``\\h`` and, in roles, ``:`` by ``\\c``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import look_up, stored, unused

HEAD, AFTER_ROLE, TURN_END = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
TURNS = "array<struct<role:string,text:string>>"
CANONICAL = ("conv", "pos", "role", "text")


# ---- fingerprints ---------------------------------------------------------------------------


def paths_of(kind: T.DataType, before: str = "") -> list[str]:
    """The nested field paths of a type, sorted; an array's elements stand under ``[]``."""
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, before + "[]")
    out = []
    for f in kind.fields if isinstance(kind, T.StructType) else ():
        path = f"{before}.{f.name}" if before else f.name
        out += [path, *paths_of(f.dataType, path)]
    return sorted(out)


def record_paths(variant: Column) -> Column:
    """The nested field paths of each record, as :func:`paths_of` gives them for its layout.

    The shape that Spark infers is read from left to right: a name adds a path, an opening bracket
    puts the name at hand on the stack, a closing one takes it off.
    """
    shape = F.schema_of_variant(variant)
    signs = F.regexp_extract_all(shape, F.lit(r"(`(?:[^`]|``)*`: |[^<>, :`]+: |OBJECT<|ARRAY<|>)"), F.lit(1))
    state = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths"))

    def put(s: Column, stack: Column, name: Column, paths: Column) -> Column:
        return F.struct(stack.alias("stack"), name.alias("name"), paths.alias("paths"))

    def step(s: Column, sign: Column) -> Column:
        stack, name, paths = s["stack"], s["name"], s["paths"]
        own = F.regexp_replace(F.regexp_replace(sign, ": $", ""), "^`|`$", "")
        above = F.coalesce(F.element_at(stack, -1), F.lit(""))
        path = F.when(above == "", own).otherwise(F.concat(above, F.lit("."), own))
        depth = F.size(stack)
        return (
            F.when(sign == "OBJECT<", put(s, F.concat(stack, F.array(name)), name, paths))
            .when(sign == "ARRAY<", put(s, F.concat(stack, F.array(F.concat(name, F.lit("[]")))), F.concat(name, F.lit("[]")), paths))
            .when(sign == ">", put(s, F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0))), name, paths))
            .otherwise(put(s, stack, path, F.concat(paths, F.array(path))))
        )

    return F.array_sort(F.array_distinct(F.aggregate(signs, state, step, lambda s: s["paths"])))


def hashed(paths: Column) -> Column:
    return F.transform(paths, lambda x: F.xxhash64(x))


def literal(paths: list[str]) -> Column:
    return F.array(*map(F.lit, paths)).cast("array<string>")


def fingerprint(paths: Column) -> Column:
    """One number for a set of paths, in any order."""
    return F.xxhash64(F.array_sort(hashed(paths)))


# ---- layouts --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reader:
    """How a mapping reads a record: a field as text, and a list of structs as roles and texts."""

    text: Callable[[str], Column]
    items: Callable[[str, str, str], Column]


def _items(elements: Column, role: str, text: str) -> Column:
    return F.transform(elements, lambda x: F.struct(x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))


def of_variant(v: Column) -> Reader:
    """Reads a record that is one variant."""
    return Reader(
        lambda name: F.try_variant_get(v, f"$.{name}", "string"),
        lambda name, role, text: _items(F.try_variant_get(v, f"$.{name}", f"array<struct<{role}:string,{text}:string>>"), role, text),
    )


#: Reads a record that is a row, its fields being columns.
OF_COLUMNS = Reader(lambda name: F.col(name).cast("string"), lambda name, role, text: _items(F.col(name), role, text))


@dataclass(frozen=True)
class Layout:
    """A record layout: its schema, and the turns of a record as an expression of what a reader gives.

    ``conv`` names the column of the conversation in a table; ``pos`` that of the turn, where a
    record is a single turn.
    """

    name: str
    schema: T.StructType
    turns: Callable[[Reader], Column]
    conv: str = "id"
    pos: str | None = None

    @property
    def needs(self) -> list[str]:
        return paths_of(self.schema)


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _list_of(name: str, *names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(_texts(*names)))])


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _list(name: str, role: str, text: str) -> Callable[[Reader], Column]:
    return lambda r: r.items(name, role, text)


def _pair(user: str, assistant: str) -> Callable[[Reader], Column]:
    return lambda r: F.array(_turn(F.lit("user"), r.text(user)), _turn(F.lit("assistant"), r.text(assistant)))


def _instruction(with_input: bool) -> Callable[[Reader], Column]:
    def turns(r: Reader) -> Column:
        asked = r.text("instruction")
        if with_input:
            more = r.text("input")
            asked = F.when(F.coalesce(more, F.lit("")) == "", asked).otherwise(F.concat_ws("\n\n", asked, more))
        return F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), r.text("output")))

    return turns


LAYOUTS = (
    Layout("messages", _list_of("messages", "role", "content"), _list("messages", "role", "content")),
    Layout("conversations", _list_of("conversations", "from", "value"), _list("conversations", "from", "value")),
    Layout("turns", _list_of("turns", "role", "text"), _list("turns", "role", "text")),
    Layout("prompt_completion", _texts("prompt", "completion"), _pair("prompt", "completion")),
    Layout("prompt_response", _texts("prompt", "response"), _pair("prompt", "response")),
    Layout("question_answer", _texts("question", "answer"), _pair("question", "answer")),
    Layout("instruction", _texts("instruction", "output"), _instruction(False)),
    Layout("instruction_input", _texts("instruction", "input", "output"), _instruction(True)),
)

#: A table with one row per turn; roles stand as they are.
TURN_ROWS = Layout("turn_rows", _texts("conv_id", "turn", "role", "text"), lambda r: F.array(_turn(r.text("role"), r.text("text"))), conv="conv_id", pos="turn")

#: Other names of roles, as they are found in public layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def canonical_role(role: Column) -> Column:
    out = role
    for name, canonical in ROLE_NAMES.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def chosen(layouts) -> list[Layout]:
    """Layouts in the order in which they are tried: those that need most first, then as given."""
    return sorted(layouts, key=lambda x: -len(x.needs))


def mappings(found: DataFrame, layouts) -> DataFrame:
    """The layout (null for none) of each fingerprint; ``found`` has one row per fingerprint: fingerprint, paths, n."""
    own = F.array(*(F.struct(fingerprint(literal(x.needs)).alias("fingerprint"), F.lit(x.name).alias("_known")) for x in layouts))
    known = found.sparkSession.range(1).select(F.inline(own))  # one row a layout
    new = F.lit(None).cast("string")
    for x in reversed(chosen(layouts)):
        new = F.when(F.size(F.array_except(hashed(literal(x.needs)), hashed(F.col("paths")))) == 0, x.name).otherwise(new)
    return found.join(F.broadcast(known), "fingerprint", "left").select("fingerprint", "n", F.coalesce("_known", new).alias("layout"))


def _mapped(layouts, value: Callable[[Layout], Column]) -> Column:
    """The value of the row's layout, null without one."""
    out = None
    for x in layouts:
        hit = F.col("_layout") == x.name
        out = F.when(hit, value(x)) if out is None else out.when(hit, value(x))
    return out


def _exploded(rows: DataFrame) -> DataFrame:
    """Turns of rows (conv, layout, _pos, _turns)."""
    out = rows.select("conv", "layout", "_pos", F.posexplode_outer("_turns").alias("_k", "_t"))
    single = F.col("layout") == TURN_ROWS.name
    role = F.when(single, F.col("_t.role")).otherwise(canonical_role(F.col("_t.role")))
    return out.select("conv", F.when(single, F.col("_pos")).otherwise(F.col("_k").cast("long")).alias("pos"), role.alias("role"), F.col("_t.text").alias("text"), "layout")


def turns_of_records(records: DataFrame, *, id_col: str = "id", record_col: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Canonical turns (conv, pos, role, text, layout) of JSON records of mixed layouts.

    Each record looks its layout up by the fingerprint of its own paths; the table of fingerprints
    is made of all records and stored. A fingerprint that most records have is a hot key: it is
    broadcast, and the records stay where they are. Of the layouts whose paths a record has, the one
    that needs most turns it into turns; other fields are not read. A record that no layout takes,
    or that is no JSON, or null, or has no turns, gives one row with a null ``pos`` and, if no layout
    took it, a null ``layout``: :func:`format_turns` counts it. Repeated records are repeated turns.
    An empty table gives an empty result. A record may be as long as a variant can be; longer ones are
    no JSON to Spark.
    """
    rows = records.select(F.col(id_col).alias("conv"), F.try_parse_json(F.col(record_col)).alias("_v"))
    rows = rows.withColumn("_paths", F.explode_outer(F.array(record_paths(F.col("_v")))))  # a barrier: read once
    rows = rows.withColumn("fingerprint", fingerprint(F.col("_paths")))
    found = rows.groupBy("fingerprint").agg(F.first("_paths").alias("paths"), F.count(F.lit(1)).alias("n"))
    table = stored(mappings(found, layouts), "fingerprints")
    rows = look_up(rows.select("conv", "_v", "fingerprint"), table, ["fingerprint"], count="n").withColumnRenamed("layout", "_layout")
    turns = _mapped(layouts, lambda x: x.turns(of_variant(F.col("_v"))).cast(TURNS))
    return _exploded(rows.select("conv", F.col("_layout").alias("layout"), F.lit(None).cast("long").alias("_pos"), turns.alias("_turns")))


def turns_of_table(table: DataFrame, *, layouts=(*LAYOUTS, TURN_ROWS)) -> DataFrame:
    """Canonical turns of a table whose columns are the fields of a layout, one record a row, with the
    layout's ``conv`` column beside them.

    All rows have the fingerprint of the table's schema and look their layout up by it, in a table
    of that one fingerprint; a layout counts only if all its paths and its ``conv`` are there. Lists
    that are null or empty give one row with a null ``pos``. Repeated rows are repeated turns, texts
    of any length stay whole, further columns are not read, and an empty table gives an empty result.
    """
    have = paths_of(table.schema)
    fits = [x for x in layouts if {x.conv, *x.needs} <= set(have)]
    if not fits:
        raise ValueError(f"no layout has the columns {', '.join(table.columns)}")
    found = table.sparkSession.range(1).select(fingerprint(literal(have)).alias("fingerprint"), literal(have).alias("paths"), F.lit(0).alias("n"))
    key, layout = unused(table, "_fingerprint", "_layout")
    known = mappings(found, fits).select(F.col("fingerprint").alias(key), F.col("layout").alias(layout))
    rows = table.withColumn(key, fingerprint(literal(have))).join(F.broadcast(known), key, "left")  # one row
    if layout != "_layout":
        rows = rows.drop("_layout").withColumnRenamed(layout, "_layout")
    pos = _mapped(fits, lambda x: (F.col(x.pos) if x.pos else F.lit(None)).cast("long"))
    turns = _mapped(fits, lambda x: x.turns(OF_COLUMNS).cast(TURNS))
    return _exploded(rows.select(_mapped(fits, lambda x: F.col(x.conv)).alias("conv"), F.col("_layout").alias("layout"), pos.alias("_pos"), turns.alias("_turns")))


def canonical_turns(table: DataFrame) -> DataFrame:
    """Canonical turns of a table: of its columns, where they fit a layout, else of the JSON in its
    columns id and record; further columns are not read. Anything else is an error."""
    have = set(paths_of(table.schema))
    if have >= {"id", "record"} and not any({x.conv, *x.needs} <= have for x in (*LAYOUTS, TURN_ROWS)):
        return turns_of_records(table)
    return turns_of_table(table)


# ---- template -------------------------------------------------------------------------------


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans (start and length in code points),
    n_unmatched (its records that no layout took).

    Turns stand in order of ``pos``, then role and text; a null role or text is empty. The loss
    mask covers the text of every turn with the role ``assistant``, without the template. Repeated
    turns are kept. A conversation without any turn has a null ``formatted``. Rows with a null
    ``conv`` are one conversation. A conversation is one string, however long, so its turns meet in
    the end; until then they are single rows. An empty table gives an empty result.
    """
    from pyspark.sql import Window

    real = F.col("pos").isNotNull() | (F.coalesce("layout", F.lit("")) == TURN_ROWS.name)
    rows = turns.select("conv", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), real.alias("_real"), F.col("layout").isNull().cast("long").alias("_unmatched"))
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(AFTER_ROLE))
    rows = rows.withColumn("_head", head).withColumn("_body", escape(F.col("text")))
    rows = rows.withColumn("_size", F.when(F.col("_real"), F.length("_head") + F.length("_body") + F.lit(len(TURN_END))).otherwise(0))
    order = Window.partitionBy("conv").orderBy("pos", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    part = F.struct(
        F.col("_at").alias("at"),
        F.concat("_head", "_body", F.lit(TURN_END)).alias("turn"),
        F.when(F.col("role") == "assistant", F.struct((F.col("_at") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length"))).alias("loss"),
    )
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("_real"), part))).alias("_parts"), F.sum("_unmatched").alias("n_unmatched"))
    return grouped.select(
        "conv",
        F.when(F.size("_parts") > 0, F.array_join(F.transform("_parts", lambda x: x["turn"]), "")).alias("formatted"),
        F.filter(F.transform("_parts", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        "n_unmatched",
    )


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Turns read back from conv, formatted, loss_spans: conv, at, role, text, loss (the text under
    the mask, null where there is none), formatted_chars."""
    base = formatted.where("formatted is not null").select("conv", "formatted", "loss_spans", F.length("formatted").cast("long").alias("formatted_chars"))
    pieces = base.select("conv", "formatted_chars", F.posexplode(F.split("formatted", TURN_END)).alias("_k", "_piece")).where("_piece <> ''")
    from pyspark.sql import Window

    order = Window.partitionBy("conv").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("_piece") + len(TURN_END)).over(order), F.lit(0)))
    pieces = pieces.withColumn("_colon", F.locate(AFTER_ROLE, F.col("_piece")))
    pieces = pieces.withColumn("_start", F.col("at") + F.col("_colon") + len(AFTER_ROLE) - 1)
    spans = base.select(F.col("conv").alias("_conv"), F.explode("loss_spans").alias("_span")).select("_conv", F.col("_span.start").alias("_span_start"), F.col("_span.length").alias("_span_length"))
    both = pieces.join(spans, pieces["conv"].eqNullSafe(spans["_conv"]) & (pieces["_start"] == spans["_span_start"]), "left")
    return both.select(
        "conv",
        "at",
        unescape(F.substring(F.col("_piece"), F.lit(len(HEAD) + 1), F.col("_colon") - len(HEAD) - 1)).alias("role"),
        unescape(F.substring(F.col("_piece"), F.col("_colon") + len(AFTER_ROLE), F.length("_piece"))).alias("text"),
        unescape(F.substring(F.col("_piece"), (F.col("_span_start") - F.col("at") + 1).cast("int"), F.col("_span_length").cast("int"))).alias("loss"),
        "formatted_chars",
    )


def digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation with digests of its turns and of the text under the loss mask."""
    part = F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "loss")
    rows = parsed.groupBy("conv").agg(F.sort_array(F.collect_list(part)).alias("_p"), F.max("formatted_chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("_p", lambda x: x["loss"]), "")
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.size("_p").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_p", lambda x: x["turn"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
