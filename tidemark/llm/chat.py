"""Chat formatting: turns of a conversation as one training text with a loss mask, by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import let

# The template. A block is <turn:ROLE>TEXT</turn> and a line end; adjacent turns of one role share a block, <next> between their texts.
OPEN, CLOSE, NEXT = "<turn:", "</turn>", "<next>"
LONGS = "array<long>"


def escaped(text: Column) -> Column:
    r"""Text without control strings: a backslash becomes \b, the < of a control string \l. All else stays."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for mark in (OPEN, CLOSE, NEXT):
        out = F.replace(out, F.lit(mark), F.lit("\\l" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    r"""As escaped, and > becomes \g, so that a role ends at the first >."""
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def _scan(values: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(values, F.array().cast(LONGS), lambda got, x: F.array_append(got, F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit(0).cast("long")) + x))


def running_sums(values: Column) -> Column:
    """Running sums of an array of longs; in chunks as long as they are many, since appending to an array copies it."""

    def chunked(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(v), step), lambda at: _scan(F.slice(v, at, step)))

    def carried(chunks: Column) -> Column:
        last = _scan(F.transform(chunks, lambda c: F.element_at(c, -1)))
        return let(last, lambda carry: F.flatten(F.transform(chunks, lambda c, i: F.transform(c, lambda x: x + F.when(i > 0, F.get(carry, i - 1)).otherwise(F.lit(0).cast("long"))))))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(let(chunked(v), carried)))


def merged_blocks(turns: Column) -> Column:
    """array<struct<role, texts>> of an array of turns in order: adjacent turns of one role become one block."""

    def of(t: Column) -> Column:
        role = lambda i: F.get(t, i)["role"]
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
        until = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(t))
        block = lambda s, at, k: F.struct(role(at).alias("role"), F.transform(F.slice(t, at + 1, until(s, k) - at), lambda x: x["text"]).alias("texts"))
        return let(starts, lambda s: F.transform(s, lambda at, k: block(s, at, k)))

    return let(turns, of)


def _pieces(block: Column, learnt: list[str]) -> Column:
    """array<struct<text, loss>>: what a block is concatenated of."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    never = F.lit(False)
    loss = block["role"].isin(learnt)
    head = F.concat(F.lit(OPEN), escaped_role(block["role"]), F.lit(">"))
    between = lambda k: F.when(k == 0, head).otherwise(F.lit(NEXT))
    inner = F.transform(block["texts"], lambda x, k: F.array(piece(between(k), never), piece(escaped(x), loss)))
    return F.concat(F.flatten(inner), F.array(piece(F.lit(CLOSE + "\n"), never)))


def format_conversations(turns: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    r"""One row per conversation: conv_id, blocks (array<struct<role, texts>>), formatted (the text), loss (array<struct<start, length>>).

    turns has conv_id, turn, role and text. A conversation's turns are collected as structs and sorted by turn, then role, then text;
    adjacent turns of one role are merged into a block, whose texts stay apart by a control string. loss names, in bytes of the text's
    UTF-8, the places of the texts of the roles `learnt`, each text a span of its own and nothing else. Control strings inside texts
    and roles are escaped, so that `read_turns` and `loss_text` give back what went in.

    A conversation is one row of the result, so all its turns meet in one task, as they must; no array is copied more than in pieces of
    the square root of its length. Null texts and roles count as empty, null turns come last, rows without conv_id are one
    conversation, repeated rows are turns of their own. Empty tables give none. Other columns are left out.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    rows = turns.groupBy("conv_id").agg(F.collect_list(turn).alias("_turns")).select("conv_id", merged_blocks(F.array_sort("_turns")).alias("blocks"))
    rows = rows.select("conv_id", "blocks", F.flatten(F.transform("blocks", lambda b: _pieces(b, list(learnt)))).alias("_pieces"))
    ends = running_sums(F.transform("_pieces", lambda p: F.octet_length(p["text"]).cast("long")))
    spans = lambda e: F.filter(F.transform("_pieces", lambda p, k: F.when(p["loss"], F.struct((F.get(e, k) - F.octet_length(p["text"])).alias("start"), F.octet_length(p["text"]).cast("long").alias("length")))), lambda s: s.isNotNull())
    return rows.select("conv_id", "blocks", F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("formatted"), let(ends, spans).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text was made of, merged ones apart again."""
    blocks = lambda found: F.slice(found, 1, F.size(found) - 1)
    body = lambda b: F.substring(b, F.length(F.lit(OPEN)) + 1, F.length(b))
    role = lambda b: F.substring_index(b, ">", 1)
    texts = lambda b: F.split(F.substring(b, F.length(role(b)) + 2, F.length(b)), NEXT, -1)
    turns = lambda b: F.transform(texts(b), lambda x: F.struct(unescaped_role(role(b)).alias("role"), unescaped(x).alias("text")))
    return F.flatten(F.transform(let(F.split(formatted, CLOSE + "\n", -1), blocks), lambda b: let(body(b), turns)))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, nothing between the spans."""
    cut = lambda bytes_: F.transform(loss, lambda s: unescaped(F.decode(F.substring(bytes_, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    return F.array_join(let(formatted.cast("binary"), cut), "")


def turns_digest(turns: Column) -> Column:
    """SHA-256 of role, line end, text, line end of each turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
