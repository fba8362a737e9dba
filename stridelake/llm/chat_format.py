"""Chat formatting in Spark expressions only: turns in order, adjacent turns of one role merged, a loss mask in characters.

Turn structs of a conversation are collected, sorted, and folded into runs of one role (F.aggregate); the runs are then
concatenated:

    ### user: first text</turn>second text</turn>
    ### assistant: its text</turn>

A run has one header line and every turn in it ends with TURN_END, so turns can be told apart again. ESCAPES are applied to
texts and roles before: the escape character itself is escaped, so that no text can hold a header or an end, and reading
back gives exactly what was put in. The loss mask is a list of spans (start and length in code points of the formatted
text), one for each turn of a role in `loss_roles`, around the turn's text alone.

Memory: turns are grouped by (conv_id, turn div `part_turns`), so that a conversation of any length is formatted in parts of at
most `part_turns` turn numbers, in tasks of their own; each part opens its first run anew. No key's rows meet in one task.

Defined cases: null text is empty; a null role is the empty role; a null turn sorts first and is in part 0; turns of one
number sort by role, then by text (as escaped); repeated rows are turns like others; rows of a null conv_id are one conversation; very
long texts are taken whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small

#: What opens a run, what closes a turn, and what stands between role and texts.
HEADER, TURN_END, COLON = "### ", "</turn>", ": "
#: Control strings and what stands for them, the escape character's first. No two start with the same two characters.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
#: Roles whose texts are trained on, and turn numbers of one part.
LOSS_ROLES, PART_TURNS = ("assistant",), 512

_RUN = "array<struct<role:string,texts:array<string>>>"
_SPAN = "struct<at:int,spans:array<struct<start:int,length:int>>>"


def escape(text: Column, role: bool = False) -> Column:
    """text without control strings; COLON is one in roles only."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES if role else ESCAPES[:-1], text)


def unescape(text: Column) -> Column:
    """What escape() was given: an escape character in its result begins a code and is nothing else, so codes never overlap."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _merged(turns: Column) -> Column:
    """Runs of adjacent turns of one role."""

    def step(runs, t):
        last = F.element_at(runs, -1)
        longer = F.struct(last.role.alias("role"), F.concat(last.texts, F.array(t.text)).alias("texts"))
        fresh = F.struct(t.role.alias("role"), F.array(t.text).alias("texts"))
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1)).role == t.role)
        return F.when(same, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(fresh)))

    return F.aggregate(turns, F.array().cast(_RUN), step)


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEADER), role, F.lit(COLON))


def _spans(runs: Column, loss: Column) -> Column:
    """Spans of the texts of runs whose role is in loss."""

    def turn(trained):
        def step(acc, t):
            span = F.array(F.struct(acc.at.alias("start"), F.length(t).alias("length")))
            return F.struct((acc.at + F.length(t) + len(TURN_END)).alias("at"), F.when(trained, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans")).cast(_SPAN)

        return step

    def run(acc, r):
        opened = F.struct((acc.at + F.length(_head(r.role))).alias("at"), acc.spans.alias("spans")).cast(_SPAN)
        ended = F.aggregate(r.texts, opened, turn(F.array_contains(loss, r.role)))
        return F.struct((ended.at + 1).alias("at"), ended.spans.alias("spans")).cast(_SPAN)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(runs, start.cast(_SPAN), run, lambda acc: acc.spans)


def chat_format(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, formatted, loss (spans of the text under the loss mask): a row for each part of a conversation."""
    turn, role = F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(turn / part_turns), F.lit(0)).cast("long").alias("part"),
        F.struct(turn.alias("turn"), escape(role, role=True).alias("role"), escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).alias("t"),
    )
    loss = F.array(*[escape(F.lit(r), role=True) for r in loss_roles]).cast("array<string>")
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    runs = parts.select("conv_id", "part", _merged(F.col("turns")).alias("runs"))
    line = lambda r: F.concat(_head(r.role), F.array_join(F.transform(r.texts, lambda t: F.concat(t, F.lit(TURN_END))), ""), F.lit("\n"))
    return runs.select("conv_id", "part", F.array_join(F.transform("runs", line), "").alias("formatted"), _spans(F.col("runs"), loss).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted text."""

    def turns(run):
        cut = F.instr(run, COLON)
        texts = F.split(F.substr(run, cut + len(COLON)), TURN_END)
        role = unescape(F.substr(run, F.lit(1), cut - 1))
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    runs = F.filter(F.split(formatted, HEADER), lambda x: x != "")
    return F.flatten(F.transform(runs, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between its spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s.start + 1, s.length))), "")


def write_chats(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """chat_format written to the shared folder as Parquet, and read back."""
    return saved(chat_format(turns, loss_roles, part_turns), "chats")


def chat_digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: a row a conversation, of what write_chats gave.

    Digests are of whole conversations; those of one part are digested where they are read, only those of several are gathered.
    """
    read = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(read, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    own = ("part", F.size(read).cast("long").alias("n_turns"), said.alias("said"), loss_text(F.col("formatted"), F.col("loss")).alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))
    several = small(saved(chats.where("part <> 0").select(F.col("conv_id").alias("in_parts")).distinct(), "long-chats"))
    split = chats.join(several, chats.conv_id.eqNullSafe(several.in_parts), "left_semi").select("conv_id", *own)
    whole = chats.join(several, chats.conv_id.eqNullSafe(several.in_parts), "left_anti").select("conv_id", *own).drop("part")
    in_order = F.sort_array(F.collect_list(F.struct("part", "said", "trained")))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "").alias(c)
    gathered = split.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), in_order.alias("parts"), F.sum("formatted_chars").alias("formatted_chars"))
    rows = whole.unionByName(gathered.select("conv_id", "n_turns", joined("said"), joined("trained"), "formatted_chars"))
    return rows.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts hold the template's own control strings.
PROBE = tuple((-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant")))


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns and of PROBE."""
    names = ("conv_id", "turn", "role", "text")
    literal = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in PROBE]))
    own = spark.range(1, numPartitions=1).select(literal)
    kinds = ("long", "long", "string", "string")
    plain = lambda df: df.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)])
    return plain(turns).unionByName(plain(own))
