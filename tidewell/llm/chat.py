"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A layout is known by the hash of its nested field paths. For a table with one row for each turn
that is the table's own schema; for JSON documents every row's own schema is hashed, and the
mapping registered for it turns prompt/response, instruction/output and message-list layouts
into the same turns. All work is done by DataFrame functions.

Template: ``<turn role="ROLE">TEXT</turn>`` for each turn, and ``<turn role="assistant" loss>``
for those under the loss mask. Inside roles and texts ``&`` is written ``&amp;``, ``<`` is
written ``&lt;`` and ``"`` in roles ``&quot;``, so that no text can hold a control string and
every text comes back as it was.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tidewell.llm.common import table

CLOSE = "</turn>"
LOSS_ROLE = "assistant"


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Nested paths of a schema; ``[]`` marks the elements of an array."""
    if isinstance(kind, StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower()))
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Tables with a row for each turn: fingerprint of the columns used -> (conversation, order, role, text).
TURN_TABLES = {
    fingerprint(paths): columns
    for paths, columns in (
        (["conv_id", "turn", "role", "text"], ("conv_id", "turn", "role", "text")),
        (["conversation_id", "position", "speaker", "content"], ("conversation_id", "position", "speaker", "content")),
        (["id", "index", "from", "value"], ("id", "index", "from", "value")),
    )
}

#: JSON layouts: the shape of ``schema_of_variant`` without its scalar types -> turns.
#: A pair is (role, path of the text); a triple (list path, role key, text key).
JSON_LAYOUTS: dict[str, list[tuple[str, ...]]] = {
    "OBJECT<prompt,response>": [("user", "$.prompt"), ("assistant", "$.response")],
    "OBJECT<completion,prompt>": [("user", "$.prompt"), ("assistant", "$.completion")],
    "OBJECT<prompt,response,system>": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")],
    "OBJECT<instruction,output>": [("user", "$.instruction"), ("assistant", "$.output")],
    "OBJECT<input,instruction,output>": [("user", "$.instruction\n$.input"), ("assistant", "$.output")],
    "OBJECT<messages:ARRAY<OBJECT<content,role>>>": [("$.messages", "role", "content")],
    "OBJECT<conversations:ARRAY<OBJECT<from,value>>>": [("$.conversations", "from", "value")],
}

#: Names of speakers in message lists that stand for a canonical role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit('"'), F.lit("&quot;"))


def _unescape_role(role: Column) -> Column:
    return _unescape(F.replace(role, F.lit("&quot;"), F.lit('"')))


def turn_columns(df: DataFrame) -> tuple[str, str, str, str]:
    """The registered layout whose columns the table has; extra columns don't count."""
    have = {c.lower(): c for c in df.columns}
    for columns in TURN_TABLES.values():
        if all(c in have for c in columns):
            schema = StructType([df.schema[have[c]] for c in columns])
            if fingerprint(field_paths(schema)) in TURN_TABLES:
                return tuple(have[c] for c in columns)  # type: ignore[return-value]
    raise ValueError(f"no mapping for a table with the field paths {field_paths(df.schema)}")


def turns_of_table(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table in any registered row-by-turn layout."""
    conv, turn, role, text = turn_columns(df)
    return df.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def json_shape(json: Column) -> Column:
    """Nested field paths of one JSON document as a string; null where it isn't JSON."""
    schema = F.schema_of_variant(F.try_parse_json(json))
    bare = F.regexp_replace(schema, r": (?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DATE|TIMESTAMP|BINARY|DECIMAL\(\d+,\d+\))", "")
    return F.replace(F.replace(bare, F.lit(": "), F.lit(":")), F.lit(", "), F.lit(","))


def _list_turns(v: Column, path: str, role: str, text: str) -> Column:
    """Turns of a message list with any names for its speakers and texts."""
    each = F.try_variant_get(v, path, f"array<struct<`{role}`:string,`{text}`:string>>")
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.transform(each, lambda t: F.struct(F.coalesce(names[t[role]], t[role], F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))


def turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, turn, role, text, layout of JSON documents in heterogeneous layouts.

    ``layout`` is the sha256 of the row's shape. Rows whose shape has no mapping (null, broken or
    unknown JSON) give one row with null turn, role and text, so that none vanishes unseen.
    """
    v = F.try_parse_json(F.col(json_col))
    shape = json_shape(F.col(json_col))
    text_at = lambda path: F.concat_ws("\n", *(F.try_variant_get(v, p, "string") for p in path.split("\n")))
    turns: Column = F.lit(None).cast("array<struct<role:string,text:string>>")
    for known, mapping in JSON_LAYOUTS.items():
        if mapping[0][0].startswith("$"):
            canonical = _list_turns(v, *mapping[0])
        else:
            canonical = F.array(*(F.struct(F.lit(role).alias("role"), text_at(path).alias("text")) for role, path in mapping))
        turns = F.when(shape == known, canonical).otherwise(turns)
    return df.select(F.col(id_col).alias("conv_id"), F.sha2(shape, 256).alias("layout"), F.posexplode_outer(turns).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout"
    )


def format_turns(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id and ``formatted``: the turns of each conversation in the template, in ascending turn.

    Null roles and texts count as empty, a null turn comes first, turns that share a number go by
    role and text, and repeated rows all stay. Null conversation ids form one conversation. A
    conversation is one string, so its turns meet in one task; nothing else does.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mask = F.when(role == loss_role, F.lit(" loss")).otherwise(F.lit(""))
    piece = F.concat(F.lit('<turn role="'), _escape_role(role), F.lit('"'), mask, F.lit(">"), _escape(text), F.lit(CLOSE))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), piece.alias("piece")).alias("t"))
    joined = F.array_join(F.col("ts.piece"), "")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("conv_id", joined.alias("formatted"))


def loss_spans(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, start, length (code points) of each masked text within ``formatted``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mask = F.when(role == loss_role, F.lit(len(" loss"))).otherwise(F.lit(0))
    head = F.length(_escape_role(role)) + mask + len('<turn role="">')
    body = F.length(_escape(text))
    order = Window.partitionBy("conv_id").orderBy("turn", role, text).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(head + body + len(CLOSE)).over(order), F.lit(0))
    return turns.select("conv_id", role.alias("role"), (before + head).alias("start"), body.cast("long").alias("length")).where(F.col("role") == loss_role).drop("role")


def read_formatted(formatted: DataFrame) -> DataFrame:
    """conv_id and ``turns`` (role, text, loss), from the template alone."""
    pattern = F.lit(r'<turn role="([^"]*)"( loss)?>([^<]*)</turn>')
    roles, masks, texts = (F.regexp_extract_all("formatted", pattern, F.lit(i)) for i in (1, 2, 3))
    turns = F.arrays_zip(roles.alias("role"), masks.alias("mask"), texts.alias("text"))
    return formatted.select(
        "conv_id", "formatted", F.transform(turns, lambda t: F.struct(_unescape_role(t["role"]).alias("role"), _unescape(t["text"]).alias("text"), (t["mask"] != "").alias("loss"))).alias("turns")
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = turns_of_table(table(spark, sf_dir, "conversations"))
    odd = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    back = read_formatted(format_turns(given.unionByName(extra)))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn role="></turn>') + 1
    + CASE WHEN role = 'assistant' THEN length(' loss') ELSE 0 END
    + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
