"""Chat formatting: heterogeneous records to canonical turns by schema fingerprint, then to one marked text (operator 9).

A record is a JSON object. Of its nested field paths those that any layout names are hashed in order; the fingerprint
selects a declarative mapping that says where turns, roles and texts are. Other fields (ids, sources, tags) change
nothing. An array without items has all paths of its items. Canonical turns become

    ### <role>:\\n<text></turn>\\n

with backslashes, the marks of turns, and in roles the colon written as a backslash and a letter, so that no text can
contain a mark and all is read back exactly. The loss mask is a list of byte spans of the formatted text.

Only DataFrame functions are used. Defined results: null roles and texts are empty; turns with one number are ordered by
role and text; a record of an unknown layout, or one that is no JSON object, has null turns and null formatted text, and
unknown_layouts() counts them; a record with an empty list of turns has an empty text; rows with a null id are one
conversation; repeated rows are repeated turns; an empty table gives no rows; columns other than those named are ignored.
A conversation is one text and must fit into a row; texts of any length are taken whole, but a record too long to be parsed
(some 128 MB) fails the job and is not left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

#: What is escaped, in this order, and the letter for it; undone in the other order.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))

#: Declarative mappings. paths: those whose fingerprint selects the layout; fields: (role, path) in the order of turns; items: (array, role field, text field, other names of roles).
LAYOUTS: dict[str, dict] = {
    "prompt": {"paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    "completion": {"paths": ["completion", "prompt"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    "system prompt": {"paths": ["prompt", "response", "system"], "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "instruction": {"paths": ["input", "instruction", "output"], "fields": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    "instruction alone": {"paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    "messages": {"paths": ["messages[].content", "messages[].role"], "items": ("messages", "role", "content", {})},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "items": ("conversations", "from", "value", {"human": "user", "gpt": "assistant"})},
}

TURNS = "array<struct<role string, text string>>"


#: Bytes of a record from which on one that can't be parsed may be too long and not broken.
_LONG = 100_000_000


def parsed(record: Column) -> Column:
    """A record as a variant, null where it is no JSON. A string in it may have any length (by itself the parser stops at 20 million characters)."""
    found = F.from_json(record, VariantType(), {"maxStringLen": str((1 << 31) - 1)})
    return F.coalesce(found, F.when(F.octet_length(record) > _LONG, F.raise_error(F.concat(F.lit("a record that can't be parsed, of bytes: "), F.octet_length(record).cast("string"))).cast(VariantType())))


def _has(variant: Column, path: str) -> Column:
    """Whether a record has a path; of an array, whether any item has, or there is none."""
    if "[]." not in path:
        return F.variant_get(variant, f"$.{path}", "variant").isNotNull()
    array, field = path.split("[].")
    items = F.try_variant_get(variant, f"$.{array}", "array<variant>")
    return F.coalesce((F.size(items) == 0) | F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))


def field_paths(record: Column, layouts: dict[str, dict] | None = None) -> Column:
    """The paths of a JSON object that any layout names, in order; null for anything else."""
    every = sorted({p for layout in (layouts or LAYOUTS).values() for p in layout["paths"]})
    variant = parsed(record)
    found = F.array_compact(F.array(*[F.when(_has(variant, p), F.lit(p)) for p in every]))
    return F.when(F.schema_of_variant(variant).startswith("OBJECT<"), F.array_join(found, ","))


def fingerprint(record: Column, layouts: dict[str, dict] | None = None) -> Column:
    return F.xxhash64(field_paths(record, layouts))


def unknown_layouts(records: DataFrame, record_col: str = "record", layouts: dict[str, dict] | None = None) -> DataFrame:
    """fields (the tree of field names and types, null where a record is no JSON), fingerprint, n: the records that no layout takes."""
    known = [F.xxhash64(F.lit(",".join(layout["paths"]))) for layout in (layouts or LAYOUTS).values()]
    own = fingerprint(F.col(record_col), layouts)
    return records.where(~own.isin(*known)).groupBy(F.schema_of_variant(parsed(F.col(record_col))).alias("fields"), own.alias("fingerprint")).agg(F.count("*").alias("n"))


def _turn(role_field: str, text_field: str, others: dict[str, str]):
    def turn(x: Column) -> Column:
        role = F.coalesce(x[role_field], F.lit(""))
        for name, known in others.items():
            role = F.when(role == name, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(x[text_field], F.lit("")).alias("text"))

    return turn


def canonical_turns(record: Column, layouts: dict[str, dict] | None = None) -> Column:
    """Turns of a record by the mapping that its fingerprint selects."""
    seen, variant = fingerprint(record, layouts), parsed(record)
    text = lambda path: F.coalesce(F.variant_get(variant, f"$.{path}", "string"), F.lit(""))
    out = F.lit(None).cast(TURNS)
    for layout in (layouts or LAYOUTS).values():
        if "fields" in layout:
            turns = F.array(*[F.struct(F.lit(role).alias("role"), text(path).alias("text")) for role, path in layout["fields"]])
        else:
            array, role_field, text_field, others = layout["items"]  # items that are no objects: null turns
            items = F.try_variant_get(variant, f"$.{array}", f"array<struct<`{role_field}` string, `{text_field}` string>>")

            turns = F.transform(items, _turn(role_field, text_field, others))
        out = F.when(seen == F.xxhash64(F.lit(",".join(layout["paths"]))), turns).otherwise(out)
    return out


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_records(records: DataFrame, id_col: str, record_col: str = "record", layouts: dict[str, dict] | None = None) -> DataFrame:
    """id_col, formatted, loss_spans: byte spans (begin, end) of the assistant's texts. Ids are taken to be unique."""
    turns = records.select(id_col, canonical_turns(F.col(record_col), layouts).alias("_turns"))
    each = turns.select(id_col, F.col("_turns").isNotNull().alias("_known"), F.posexplode_outer("_turns").alias("_k", "_turn"))
    head = F.concat(F.lit("### "), escaped(F.col("_turn.role"), ROLE_ESCAPES), F.lit(":\n"))
    each = each.withColumn("_head", head).withColumn("_body", escaped(F.col("_turn.text")))
    each = each.withColumn("_piece", F.concat("_head", "_body", F.lit("</turn>\n")))
    order = Window.partitionBy(id_col).orderBy("_k")
    before = F.coalesce(F.sum(F.octet_length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = before + F.octet_length("_head")
    span = F.when(F.col("_turn.role") == "assistant", F.struct(begin.alias("begin"), (begin + F.octet_length("_body")).alias("end")))
    each = each.withColumn("_span", span)
    # collect_list leaves nulls out: turns of other roles have no span, and records without turns no piece.
    grouped = each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("_k", "_piece")))).alias("_pieces"), F.array_sort(F.collect_list("_span")).alias("loss_spans"), F.bool_or("_known").alias("_known"))
    return grouped.select(id_col, F.when(F.col("_known"), F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "")).alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, "</turn>\n")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ":\n", 1)
        role = unescaped(F.substr(head, F.lit(5)), ROLE_ESCAPES)
        return F.struct(role.alias("role"), unescaped(F.substr(piece, F.length(head) + 3)).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, one span after another."""
    raw = F.to_binary(formatted, F.lit("utf-8"))
    return F.array_join(F.transform(spans, lambda s: unescaped(F.decode(F.substr(raw, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")), "utf-8"))), "")


def as_records(rows: DataFrame) -> DataFrame:
    """Conversations given as rows (conv_id, turn, role, text) as JSON records of several layouts.

    Two turns of user and assistant are a prompt record, three with a system turn first an instruction record, others
    lists of messages under either of two names, by id.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    talks = talks.withColumn("roles", F.array_join(F.transform("t", lambda x: x["role"]), ","))
    text = lambda k: F.col("t")[k]["text"]
    known = F.forall("t", lambda x: x["role"].isin("user", "assistant", "system"))
    named = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    record = (
        F.when(F.col("roles") == "user,assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(F.col("roles") == "system,user,assistant", F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(known & (F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0), F.to_json(F.struct(F.transform("t", lambda x: F.struct(named(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return talks.select("conv_id", record.alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and masks hold, read back from them."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that tries the marks, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(format_records(as_records(rows.unionByName(probe)), "conv_id"))


_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '</turn>', '\\t'), '###', '\\h')"
ORACLE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
), p as (
  select *, '### ' || replace({_ESCAPED.format("role")}, ':', '\\c') || ':' || chr(10) || {_ESCAPED.format("text")} || '</turn>' || chr(10) as piece from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(piece)) as bigint) as formatted_chars
from p group by conv_id
"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": ORACLE}
