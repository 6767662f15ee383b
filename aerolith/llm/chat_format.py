"""Chat formatting by schema fingerprints: the hash of a record's field paths selects how it becomes turns.

DataFrame functions only: records never leave the JVM.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

START, SEP, END = "<|im_start|>", "\n", "<|im_end|>\n"
# The marks of this and of other common templates, which may not stand in a text as they are.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLES = ("assistant",)
_RESTS = "|".join("\\Q" + c[1:] + "\\E" for c in CONTROL)
_ESCAPE = r"([<\[])(\\*)(" + _RESTS + ")"
_UNESCAPE = r"([<\[])\\(\\*)(" + _RESTS + ")"
# What the layout of "from" and "value" calls the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant"}
TURNS = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths, and the SQL expression (over ``record``) of its turns."""

    paths: tuple[str, ...]
    turns: str


def _turn(role: str, content: str) -> str:
    return f"struct({role} as role, {content} as content)"


def _field(path: str) -> str:
    return f"variant_get(record, '$.{path}', 'string')"


def _list(path: str, role: str, content: str) -> str:
    kind = f"array<struct<`{role}`:string,`{content}`:string>>"
    names = " ".join(f"when '{a}' then '{b}'" for a, b in ROLE_NAMES.items()) if role == "from" else ""
    named = f"case x.`{role}` {names} else x.`{role}` end" if names else f"x.`{role}`"
    return f"transform(variant_get(record, '$.{path}', '{kind}'), x -> {_turn(named, f'x.`{content}`')})"


def _present(*turns: str) -> str:
    """The given turns without those whose content the record lacks."""
    return f"filter(array({', '.join(turns)}), t -> t.content is not null)"


_ROLE = {"user": "'user'", "assistant": "'assistant'", "system": "'system'"}
_INPUT = "concat_ws('\\n\\n', {0}, nullif({1}, ''))"
# The layouts that are known; others can be given to ``canonical_turns``.
LAYOUTS = (
    Mapping(("role", "text"), f"array({_turn(_field('role'), _field('text'))})"),
    Mapping(("role", "content"), f"array({_turn(_field('role'), _field('content'))})"),
    Mapping(("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), _list("conversations", "from", "value")),
    Mapping(
        ("prompt", "response"),
        _present(_turn(_ROLE["user"], _field("prompt")), _turn(_ROLE["assistant"], _field("response"))),
    ),
    Mapping(
        ("completion", "prompt"),
        _present(_turn(_ROLE["user"], _field("prompt")), _turn(_ROLE["assistant"], _field("completion"))),
    ),
    Mapping(
        ("instruction", "output"),
        _present(_turn(_ROLE["user"], _field("instruction")), _turn(_ROLE["assistant"], _field("output"))),
    ),
    Mapping(
        ("input", "instruction", "output"),
        _present(
            _turn(_ROLE["user"], _INPUT.format(_field("instruction"), _field("input"))),
            _turn(_ROLE["assistant"], _field("output")),
        ),
    ),
    Mapping(
        ("input", "instruction", "output", "system"),
        _present(
            _turn(_ROLE["system"], _field("system")),
            _turn(_ROLE["user"], _INPUT.format(_field("instruction"), _field("input"))),
            _turn(_ROLE["assistant"], _field("output")),
        ),
    ),
)
def paths_of(kind: T.DataType, at: str = "") -> tuple[str, ...]:
    """Field paths of a type, sorted: ``a.b`` for nested fields, ``a[].b`` for fields of array elements."""
    if isinstance(kind, T.StructType):
        return tuple(sorted(p for f in kind for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)))
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{at}[]")
    return (at,)


def _shape(paths: tuple[str, ...]) -> str:
    """The shape of Spark's variant schema without its scalar types, for records of these paths."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("."):
            at = at.setdefault(part, {})

    def show(node):
        inner = ", ".join(
            f"{k.removesuffix('[]')}: " + (f"ARRAY<{show(v)}>" if k.endswith("[]") else show(v))
            for k, v in sorted(node.items())
        )
        return f"OBJECT<{inner}>" if node else "*"

    return show(tree)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant; the types of its scalars do not count."""
    scalars = r"\b(STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP|VARIANT)(?=[,>]|$)"
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), scalars, "*"))


def canonical_turns(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """``id, part, turns`` from ``id, part, record``: the record is a variant of any known layout.

    ``turns`` lists role and content; a null content and a null role are the empty text. A record of an unknown layout, and a null one, has null turns: it is not dropped.
    """
    known = F.lit(None).cast(TURNS)
    shape = F.col("shape")
    for m in layouts:
        known = F.when(shape == F.xxhash64(F.lit(_shape(m.paths))), F.expr(m.turns).cast(TURNS)).otherwise(known)
    tidy = F.transform(
        "turns",
        lambda t: F.struct(*(F.coalesce(t[c], F.lit("")).alias(c) for c in ("role", "content"))),
    )
    found = records.select("id", "part", "record", fingerprint(F.col("record")).alias("shape"))
    return found.select("id", "part", known.alias("turns")).select("id", "part", tidy.alias("turns"))


def escape(text: Column) -> Column:
    """Puts a backslash into control strings, after their first character; those that have some get one more."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role(role: Column) -> Column:
    """A role on one line."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def formatted(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``id, text, loss`` of every conversation, from ``id, part, turns``.

    Turns follow the order of their parts (null first), then their place in the part; equal ones go by role and
    content. ``loss`` has the span of each content that training sees: ``turn`` from 0, ``offset`` from the start of
    that turn and ``start`` from the start of the text, all in code points. An id without turns has an empty text.
    One conversation becomes one value, so the rows of one id meet in one task; that is what it is made of.
    """
    flat = turns.select("id", "part", F.posexplode_outer("turns").alias("at", "turn")).select(
        "id",
        F.struct("part", "at", F.col("turn.role").alias("role"), F.col("turn.content").alias("content")).alias("key"),
        F.concat(F.lit(START), escape(_role(F.col("turn.role"))), F.lit(SEP)).alias("head"),
        escape(F.col("turn.content")).alias("body"),
        F.col("turn.role").isin(*loss_roles).alias("seen"),
        F.col("turn").isNotNull().alias("real"),
    )
    # A record without turns has a row without a turn, which comes last and is left out of the lists.
    order = Window.partitionBy("id").orderBy(F.desc("real"), "key")
    size = F.char_length("head") + F.char_length("body") + len(END)
    placed = flat.select(
        "id",
        "real",
        (F.row_number().over(order) - 1).alias("turn"),
        F.concat("head", "body", F.lit(END)).alias("chunk"),
        F.when(F.col("seen"), F.char_length("head")).alias("offset"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.char_length("head")).alias("start"),
        F.char_length("body").alias("length"),
    )
    span = F.when(F.col("offset").isNotNull(), F.struct("turn", "offset", "start", "length"))
    chunk = F.when(F.col("real"), F.struct("turn", "chunk"))
    return placed.groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(chunk)), lambda x: x["chunk"]), "").alias("text"),
        F.sort_array(F.collect_list(span)).alias("loss"),
    )


def parsed(chats: DataFrame) -> DataFrame:
    """``id, turns, learned`` read back from ``id, text, loss``: role and content of each turn, and the text under the loss."""
    chunks = F.filter(F.split("text", "\\Q" + END + "\\E"), lambda x: x != "")
    head = lambda c: F.substring_index(c, SEP, 1)
    turn = lambda c: F.struct(
        _unrole(unescape(F.substr(head(c), F.lit(len(START) + 1)))).alias("role"),
        unescape(F.substr(c, F.char_length(head(c)) + 2)).alias("content"),
    )
    whole = lambda s: F.substr(F.get("chunks", s["turn"]), s["offset"] + 1, s["length"])
    return chats.withColumn("chunks", chunks).select(
        "id",
        F.transform("chunks", turn).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(whole(s))), "").alias("learned"),
        F.char_length("text").alias("formatted_chars"),
    )


def chat_rows(rows: DataFrame) -> DataFrame:
    """``id, part, record`` from a table with a row per turn: ``conv_id, turn, role, text``."""
    record = F.to_variant_object(F.struct("role", "text"))
    return rows.select(F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("part"), record.alias("record"))


def digests(chats: DataFrame) -> DataFrame:
    """What a conversation reads as when it is read back, as counts and hashes."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n")))
    return parsed(chats).select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
