r"""Format conversations for training by relational means: Spark expressions only.

A conversation's turns are collected as structs and sorted, neighbours of the same role are
merged by an array aggregation into one marked turn, and all is concatenated:

    <|turn|>role<|says|>text<|more|>text of the same role<|end|>

Every control string begins with ``<|``. Inside texts and roles ``<|`` gets a backslash, and
one that has backslashes gets another (``<|`` is ``<\|``, ``<\|`` is ``<\\|``), so no control
string stands in them and taking one backslash away gives back what was there. The loss mask
is the list of byte ranges of assistant texts in the formatted text's UTF-8; marks are not in it.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; a
null turn comes first, turns of equal number are in order of role and text, and repeated rows
are turns of their own; empty tables give an empty result; other columns play no part.

A conversation is one training record, so it ends up in one row, as the method has it, and
must fit there. Escaping is done on rows before they are collected. Turns are merged in
blocks of ``BLOCK``, so an array that grows turn by turn never has more than these, and the
time is in proportion to the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, MORE, END = "<|turn|>", "<|says|>", "<|more|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
BLOCK = 256

_STATE = "struct<first:boolean,role:string,bytes:bigint,parts:array<string>,loss:array<struct<start:bigint,bytes:bigint>>>"
_SPANS = "struct<bytes:bigint,loss:array<struct<start:bigint,bytes:bigint>>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _add_turn(learned: str):
    """Merging step: a turn goes on with the block's last role, or ends that turn and opens its own."""

    def merge(state: Column, turn: Column) -> Column:
        opening = F.concat(F.lit(TURN), turn["role"], F.lit(SAYS))
        head = F.when(state["first"], opening).when(state["role"] == turn["role"], F.lit(MORE)).otherwise(F.concat(F.lit(END), opening))
        span = F.struct((state["bytes"] + _length(head)).alias("start"), _length(turn["text"]).alias("bytes"))
        return F.struct(
            F.lit(False).alias("first"),
            turn["role"].alias("role"),
            (state["bytes"] + _length(head) + _length(turn["text"])).alias("bytes"),
            F.concat(state["parts"], F.array(F.concat(head, turn["text"]))).alias("parts"),
            F.when(turn["role"] == learned, F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"),
        ).cast(_STATE)

    return merge


def _shift(before: Column, block: Column) -> Column:
    """The loss ranges of the blocks so far and of one more, whose own begin at 0."""
    moved = F.transform(block["loss"], lambda s: F.struct((s["start"] + before["bytes"]).alias("start"), s["bytes"].alias("bytes")))
    return F.struct((before["bytes"] + block["bytes"]).alias("bytes"), F.concat(before["loss"], moved).alias("loss")).cast(_SPANS)


def format_conversations(turns: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, formatted (the record's text) and loss_spans (start, bytes: ranges that are learned) of each conversation."""
    blank = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", escape(F.coalesce("role", blank)).alias("role"), escape(F.coalesce("text", blank)).alias("text")).alias("row"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def block(k: Column) -> Column:
        before = F.when(k > 0, F.get(F.col("turns"), k * BLOCK - 1)["role"])
        start = F.struct((k == 0).alias("first"), before.alias("role"), F.lit(0).alias("bytes"), F.array().alias("parts"), F.array().cast("array<struct<start:bigint,bytes:bigint>>").alias("loss")).cast(_STATE)
        return F.aggregate(F.slice("turns", k * BLOCK + 1, BLOCK), start, _add_turn(learned))

    count = F.floor((F.size("turns") - 1) / BLOCK).cast("int")
    blocks = sorted_.select("conv_id", F.transform(F.sequence(F.lit(0), count), block).alias("blocks"))
    none = F.struct(F.lit(0).alias("bytes"), F.array().cast("array<struct<start:bigint,bytes:bigint>>").alias("loss")).cast(_SPANS)
    text = F.array_join(F.flatten(F.transform("blocks", lambda b: b["parts"])), "")
    return blocks.select("conv_id", F.concat(text, F.lit(END)).alias("formatted"), F.aggregate("blocks", none, _shift)["loss"].alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted record holds, one for each row that went into it."""
    blocks = F.filter(F.split(formatted, r"<[|]turn[|]>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        own = F.split(F.substring(block, F.lit(1), F.length(block) - len(END)), r"<[|]says[|]>")
        role, texts = own[0], F.split(own[1], r"<[|]more[|]>")
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """What stands under the loss mask, escapes undone, without anything between."""
    # the record's bytes are bound to a name, so that they are taken once and not for each range
    return F.transform(F.array(formatted.cast("binary")), lambda data: F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(data, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), ""))[0]


def record_digests(records: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from formatted records."""
    back = records.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
