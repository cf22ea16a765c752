"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is JSON of any layout. The paths and kinds of its nested fields are
hashed to a fingerprint, which selects a declarative mapping; the mapping says
where the turns are. Canonical turns are rendered with a template whose
control strings are escaped inside texts, and can be read back from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: Column of ``from_rows`` with the texts of a conversation from ``LONG`` characters on, by item; its record has them empty. Null for all others.
BESIDE = "__texts_beside"
#: Records from this many characters on are fingerprinted without their texts: Spark's JSON parser refuses a string over 20,000,000 UTF-16 units, which are two a character at most, and a variant ends at 128 MiB.
LONG = 10_000_000


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: ``list_path`` with the fields ``role`` and ``text`` of its items, or ``fields`` as (role, path) in order.

    ``example`` is a record of the layout; its fingerprint selects the mapping. ``optional`` fields may be missing, null or empty.
    """

    name: str
    examples: tuple[str, ...]
    list_path: str | None = None
    role: str = "role"
    text: str = "text"
    fields: tuple[tuple[str, str], ...] = ()
    aliases: tuple[tuple[str, str], ...] = field(default=())


#: Names under which public chat layouts give the three roles.
ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

#: Layouts known from the start.
MAPPINGS = (
    Mapping("turns", ('{"turns":[{"role":"a","text":"b"}]}',), "turns"),
    Mapping("messages", ('{"messages":[{"role":"a","content":"b"}]}',), "messages", text="content", aliases=ALIASES),
    Mapping("conversations", ('{"conversations":[{"from":"a","value":"b"}]}',), "conversations", role="from", text="value", aliases=ALIASES),
    Mapping("prompt", ('{"prompt":"a","completion":"b"}',), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ('{"prompt":"a","response":"b"}', '{"system":"s","prompt":"a","response":"b"}'), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ('{"instruction":"a","output":"b"}', '{"instruction":"a","input":"i","output":"b"}'), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", ('{"question":"a","answer":"b"}',), fields=(("user", "question"), ("assistant", "answer"))),
)


#: A JSON string, in a form that Java matches without recursion.
STRING = r'"(?:[^"\\]++|\\.)*+"'


def skeleton(record: Column) -> Column:
    """A JSON record with each string value emptied and runs of equal flat items made one; names stay."""
    emptied = F.regexp_replace(record, rf'(?s)\G((?:{STRING}\s*+:|[^"])*+){STRING}', '$1""')
    item = rf'\{{(?:{STRING}|[^"{{}}\[\]])*+\}}'
    return F.regexp_replace(emptied, rf'(?s)({STRING})|({item})(?:\s*+,\s*+\2)++', '$1$2')


def fingerprint(record: Column, long: int = LONG) -> Column:
    """Hash of the paths and kinds of a JSON record's fields; scalars are one kind, so a value's type or absence does not matter, only where it stands."""
    shape = F.schema_of_variant(F.try_parse_json(F.when(F.length(record) < long, record).otherwise(skeleton(record))))
    scalars = F.regexp_replace(shape, r"(?<=[:<] )?\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\s?\d+\))\b", "SCALAR")
    return F.lower(F.substring(F.sha2(scalars, 256), 1, 16))


def _known(df: DataFrame, mappings: Sequence[Mapping]) -> dict[str, str]:
    """Fingerprints of the mappings' examples."""
    examples = [(m.name, e) for m in mappings for e in m.examples]
    made = df.sparkSession.range(1).select(*[fingerprint(F.lit(e)).alias(f"f{i}") for i, (_, e) in enumerate(examples)]).first()
    return {made[i]: name for i, (name, _) in enumerate(examples)}


#: A text of any length is read.
READ = {"maxStringLen": "2147483647"}


def _turns(m: Mapping, record: Column, beside: Column) -> Column:
    if m.list_path:
        item = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
        items = F.from_json(record, f"struct<`{m.list_path}`:{item}>", READ).getField(m.list_path)
        role = lambda x: F.coalesce(x[m.role], F.lit(""))
        known = F.create_map(*[F.lit(v) for pair in m.aliases for v in pair]) if m.aliases else None
        named = (lambda x: F.coalesce(known[role(x)], role(x))) if known is not None else role
        return F.transform(items, lambda x, i: F.struct(named(x).alias("role"), F.coalesce(F.get(beside, i), x[m.text], F.lit("")).alias("text")))
    values = F.from_json(record, "struct<" + ",".join(f"`{p}`:string" for _, p in m.fields) + ">", READ)
    given = F.array(*[F.struct(F.lit(r).alias("role"), values.getField(p).alias("text")) for r, p in m.fields])
    return F.filter(given, lambda x: x["text"].isNotNull() & (x["text"] != ""))


def canonical(df: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``turns``; both last are null where no mapping has the fingerprint or the record is not JSON."""
    known = _known(df, mappings)
    marked = df.withColumn("fingerprint", fingerprint(F.col(record)))
    beside = F.col(BESIDE) if BESIDE in df.columns else F.lit(None).cast("array<string>")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        own = F.col("fingerprint").isin([f for f, name in known.items() if name == m.name])
        layout = F.when(own, F.lit(m.name)).otherwise(layout)
        turns = F.when(own, _turns(m, F.col(record), beside)).otherwise(turns)
    return marked.withColumn("layout", layout).withColumn("turns", turns.cast(TURNS))


#: Control strings of the template: a turn is BEGIN, the opening of its role, its escaped text, the closing, END.
BEGIN, END = "<s>", "</s>"
OPEN_CLOSE = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("", "")}
#: For any other role, whose name follows the opening and ends at the next one.
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>"
CONTROL = r"(\\|<(?=/?s>)|\[(?=/?INST\])|<(?=</?(?:SYS|ROLE)>>)|<(?=<TEXT>>))"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string, so that none is left whole."""
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """Undoes ``escape``."""
    return F.regexp_replace(text, r"(?s)([\\<\[])\\", "$1")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(OTHER_MID))
    for r, (before, _) in OPEN_CLOSE.items():
        out = F.when(role == r, F.lit(before)).otherwise(out)
    return F.concat(F.lit(BEGIN), out)


def _closing(role: Column) -> Column:
    out = F.lit(OTHER_CLOSE)
    for r, (_, after) in OPEN_CLOSE.items():
        out = F.when(role == r, F.lit(after)).otherwise(out)
    return F.concat(out, F.lit(END))


def render(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans`` (start, length in code points of the formatted string): the escaped text of each assistant turn."""
    pieces = F.transform(turns, lambda t: F.struct(_opening(t["role"]).alias("o"), escape(t["text"]).alias("b"), _closing(t["role"]).alias("c"), (t["role"] == "assistant").alias("loss")))
    out = df.withColumn("__pieces", pieces).withColumn("formatted", F.array_join(F.transform("__pieces", lambda p: F.concat(p["o"], p["b"], p["c"])), ""))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit([]).cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start, size = acc["at"] + F.length(p["o"]), F.length(p["b"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + F.length(p["c"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.when(F.col("__pieces").isNotNull(), F.aggregate("__pieces", zero, step)["spans"])
    return out.withColumn("loss_spans", spans).drop("__pieces")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string."""
    parts = F.filter(F.split(formatted, F.lit(r"<s>")), lambda x: x != "")

    def turn(x: Column) -> Column:
        inner = F.left(x, F.length(x) - len(END))
        mid = F.instr(inner, OTHER_MID)
        role, text = F.lit("assistant"), inner
        for r, (before, after) in OPEN_CLOSE.items():
            if before:
                own = F.startswith(inner, F.lit(before))
                role = F.when(own, F.lit(r)).otherwise(role)
                text = F.when(own, F.substr(inner, F.lit(len(before) + 1), F.length(inner) - len(before) - len(after))).otherwise(text)
        own = F.startswith(inner, F.lit(OTHER_OPEN))
        role = F.when(own, F.substr(inner, F.lit(len(OTHER_OPEN) + 1), mid - 1 - len(OTHER_OPEN))).otherwise(role)
        text = F.when(own, F.substr(inner, mid + len(OTHER_MID), F.length(inner) - mid - len(OTHER_MID) + 1 - len(OTHER_CLOSE))).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span and joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def from_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG) -> DataFrame:
    """Rows by turn as one JSON record a conversation: {"turns": [{"role", "text"}, ...]}. From ``long`` characters on the texts stand beside the record, which has every item with its role and an empty text, so that no buffer holds them again as JSON.

    Order is by turn, then role, then text, null turns first; null roles and texts are empty. A repeated row is a repeated turn.
    """
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"), F.sum(F.length(item["text"])).alias("chars"))
    apart = F.col("chars") >= long
    items = F.transform("turns", lambda t: F.to_json(F.struct(t["role"].alias("role"), F.when(apart, F.lit("")).otherwise(t["text"]).alias("text"))))
    record = F.concat(F.lit('{"turns":['), F.array_join(items, ","), F.lit("]}"))
    return grouped.select("conv_id", record.alias("record"), F.when(apart, F.transform("turns", lambda t: t["text"])).alias(BESIDE))


def format_records(records: DataFrame, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """conv_id, fingerprint, layout, formatted and loss_spans of JSON records (``conv_id``, ``record``); records of unknown layout stay, with null results."""
    return render(canonical(records, mappings=mappings)).select("conv_id", "fingerprint", "layout", "formatted", "loss_spans")
