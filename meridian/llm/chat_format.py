"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, only its
text is trained on. Turns after a conversation's last assistant turn (and conversations without
one) make one more example, without a target, so that no turn is lost.

Template, for each turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so control strings occur only where the
template put them; a line break in a role is written ``<|nl|>``. ``unescaped`` undoes it.

Defined results: null text or role is empty; turns are ordered by turn number (nulls first),
ties by role, then text; repeated rows are turns of their own; rows without conv_id are one
conversation; an empty table gives no row. Extra columns are dropped. One conversation is one
row, as its example must be; conversations are dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|\|)", "$1")


def examples(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), has_target, is_last, formatted, loss_start, loss_length.

    The loss mask covers ``loss_length`` code points from the ``loss_start``-th (from 0).
    """
    turn = F.struct(
        F.col("turn"),
        escaped(F.coalesce("role", F.lit(""))).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _earlier).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.replace(t["role"], F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    ready = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), t["text"].alias("text"))).alias("turns"),
    )
    own = escaped(F.lit(trained))
    targets = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == own)
    ends = F.when(F.element_at("turns", -1)["role"] == own, targets).otherwise(F.concat(targets, F.array(F.size("turns"))))
    each = ready.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("turns", F.col("upto"))
    whole = F.array_join(F.transform(F.slice("turns", 1, F.col("upto")), lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    made = each.select("conv_id", "example", (last["role"] == own).alias("has_target"), (F.col("upto") == F.size("turns")).alias("is_last"), F.length(last["text"]).alias("n"), whole.alias("formatted"))
    return made.select(
        "conv_id",
        "example",
        "has_target",
        "is_last",
        "formatted",
        F.when(F.col("has_target"), F.length("formatted") - len(END) - F.col("n")).otherwise(F.lit(0)).alias("loss_start"),
        F.when(F.col("has_target"), F.col("n")).otherwise(F.lit(0)).alias("loss_length"),
    )


def _earlier(a: Column, b: Column) -> Column:
    """Order of two turns; nulls of the turn number come first."""
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    number = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(number, less(a["turn"], b["turn"]), less(a["role"], b["role"]), less(a["text"], b["text"]), F.lit(0))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as it was before escaping: array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    return F.transform(parts, lambda p: F.struct(unescaped(F.replace(role(p), F.lit(BREAK), F.lit("\n"))).alias("role"), unescaped(body(p)).alias("text")))


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescaped(F.substring(formatted, start + 1, length))


def digests(made: DataFrame) -> DataFrame:
    """What each conversation's examples hold, read back from them.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.
    """
    read = made.select(
        "conv_id",
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
        F.when(F.col("has_target"), F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text"))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n"), F.sha2(said, 256).alias("sha"), "loss", "chars")
    whole = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("loss").alias("n_examples"),
    )
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
