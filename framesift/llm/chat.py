"""Chat formatting: conversations to training strings, with a loss mask and attachments.

A turn's content is a list of typed parts: text, image, audio, document. A visitor walks the
parts and flattens them into one string: text is escaped, any other part becomes an ordered
placeholder, its reference is recorded with the count of tokens it expands to. A turn is

    <s>[INST]role[/INST]content</s>

Control strings inside roles and texts are broken by a backslash after their first character,
and backslashes are doubled, so that no text can forge a mark and unescape() gives it back.

All of it is DataFrame expressions. One conversation is one output string, so its turns meet in
one task; a conversation is as large as its string, and no key but the conversation's own is gathered.

Defined results: a null text or part is empty; a null role is empty and never under the loss mask; null
conversation ids form one conversation; turns with equal numbers follow role, then text; null turn numbers
come first; repeated rows are turns of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, OPEN, CLOSE, EOS = "<s>", "[INST]", "[/INST]", "</s>"
#: Kinds of parts that aren't text, with the tokens that a unit (tile, second, page) expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
LOSS_ROLE = "assistant"


def _controls(kinds: Mapping[str, int]) -> str:
    """Matches the first character of every control string."""
    tails = [r"<(?=/?s>)", r"\[(?=/?INST\])"] + [rf"<(?=\|{k}_)" for k in sorted(kinds)]
    return "(" + "|".join(tails) + ")"


def escape(text: Column, kinds: Mapping[str, int] = UNIT_TOKENS) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _controls(kinds), r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit_parts(parts: Column, kinds: Mapping[str, int] = UNIT_TOKENS) -> Column:
    """struct(content, attachments) of array<struct<kind, text, ref, units>>.

    Placeholders are numbered by their part's place in the turn. attachments: array of
    struct(part, kind, ref, tokens) in order. A part of unknown kind counts as text.
    """
    known = list(kinds)

    def flat(part: Column, at: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["kind"], F.lit("_"), at.cast("string"), F.lit("|>"))
        return F.when(part["kind"].isin(known), mark).otherwise(escape(part["text"], kinds))

    def tokens(part: Column) -> Column:
        per = F.lit(0)
        for kind, n in kinds.items():
            per = F.when(part["kind"] == kind, F.lit(n)).otherwise(per)
        return (F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)) * per).cast("long")

    def attachment(part: Column, at: Column) -> Column:
        return F.when(part["kind"].isin(known), F.struct(at.cast("int").alias("part"), part["kind"].alias("kind"), part["ref"].alias("ref"), tokens(part).alias("tokens")))

    parts = F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string,ref:string,units:bigint>>"))
    return F.struct(
        F.array_join(F.transform(parts, flat), "").alias("content"),
        F.filter(F.transform(parts, attachment), lambda a: a.isNotNull()).alias("attachments"),
    )


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str | None = "text",
    parts_col: str | None = None,
    loss_role: str = LOSS_ROLE,
    kinds: Mapping[str, int] = UNIT_TOKENS,
) -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans: array of struct(start, length) in code points of formatted, from 0, one for each turn
    of loss_role, over its content. attachments: struct(turn_at, part, kind, ref, tokens), in order.
    Content comes from parts_col (array<struct<kind,text,ref,units>>) if given, else from text_col.
    Offsets are running sums beside the one exchange by conversation, not folds over arrays.
    """
    parts = turns[parts_col] if parts_col else text_part(turns[text_col])
    rows = turns.select(
        turns[conv_col].alias("conv"),
        turns[turn_col].alias("turn"),
        turns[role_col].cast("string").alias("role"),
        visit_parts(parts, kinds).alias("seen"),
    )
    head = F.concat(F.lit(BOS + OPEN), escape(F.col("role"), kinds), F.lit(CLOSE))
    rows = rows.select(
        "conv", "turn", "role", head.alias("head"), F.col("seen.content").alias("content"), F.col("seen.attachments").alias("attachments")
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "content")
    size = F.char_length("head") + F.char_length("content") + len(EOS)
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("at"),
        (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.char_length("head")).alias("start"),
    )
    piece = F.struct(
        "at",
        F.concat("head", "content", F.lit(EOS)).alias("piece"),
        F.when(F.col("role") == loss_role, F.struct(F.col("start"), F.char_length("content").cast("long").alias("length"))).alias("span"),
        "attachments",
    )
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    found = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.transform(p["attachments"], lambda a: F.struct(p["at"].alias("turn_at"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))),
        )
    )
    return grouped.select(
        "conv",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        found.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def parse_turns(formatted: Column) -> Column:
    """Reads a formatted string back: array of struct(role, text), unescaped; placeholders stay."""
    pieces = F.filter(F.split(formatted, EOS), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, len(BOS + OPEN) + 1, 2**31 - 1))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, CLOSE, 1)
        text = p.substr(F.char_length(role) + len(CLOSE) + 1, F.char_length(p))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bare, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir):
    from framesift.llm.common import table

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = format_chats(turns.unionByName(probe))
    read = out.select(
        "conv", "formatted", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>|\|(?:audio|document|image)_)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'))
          + length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|\|(?:audio|document|image)_)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) + 20 AS n
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
