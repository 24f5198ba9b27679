"""Chat formatting: one example per assistant turn, with every turn before it as context and only the reply trainable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
MARK = "^"
#: What a text must not hold unescaped: the escape mark first, then the control strings of common templates.
CONTROL = [MARK, "<|", "</s>", "<s>", "[INST]", "[/INST]"]
#: The line break after the role ends the role; one inside it is escaped.
ROLE_CONTROL = [*CONTROL, "\n"]


def escaped(text: Column, control: list[str] = CONTROL) -> Column:
    """``text`` with each control string as the mark and its number: no control string is left, and none is lost."""
    for i, c in enumerate(control):
        text = F.replace(text, F.lit(c), F.lit(f"{MARK}{i}"))
    return text


def unescaped(text: Column, control: list[str] = CONTROL) -> Column:
    """Undoes :func:`escaped`: the mark's own number last."""
    for i, c in reversed(list(enumerate(control))):
        text = F.replace(text, F.lit(f"{MARK}{i}"), F.lit(c))
    return text


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last): the training examples of each conversation.

    An example's text is the formatted conversation up to and with one assistant turn; the loss covers the characters
    from ``loss_start`` to before ``loss_end``, the escaped reply alone. Turns after the last reply, or a conversation
    without one, form one more example whose loss is empty, so every turn is in the conversation's last example. A
    conversation's rows are ordered by turn, role and text, nulls first, and repeated rows stay. Null roles and texts
    count as empty; rows with a null id are one conversation; an empty table gives no rows. Each example is one text,
    so a conversation has to fit in a row; the rows of a conversation are gathered once and its examples are prefixes.
    """
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    head = lambda r: F.concat(F.lit(START), escaped(F.coalesce(r["role"], F.lit("")), ROLE_CONTROL), F.lit("\n"))
    body = lambda r: escaped(F.coalesce(r["text"], F.lit("")))
    parts = turns.select("conv_id", F.transform("rows", lambda r: F.struct(head(r).alias("head"), body(r).alias("body"), F.coalesce(r["role"] == "assistant", F.lit(False)).alias("reply"))).alias("parts"))
    # spans of the replies in the formatted text: running lengths, one struct per turn
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,stop:bigint,whole:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + F.length(p["head"])
        stop = first + F.length(p["body"])
        whole = stop + len(END)
        span = F.struct(first.alias("first"), stop.alias("stop"), whole.alias("whole"))
        return F.struct(whole.alias("at"), F.when(p["reply"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("parts", start, step)
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    whole = parts.select("conv_id", formatted.alias("formatted"), spans.alias("walk"))
    rest = F.struct(F.col("walk.at").alias("first"), F.col("walk.at").alias("stop"), F.col("walk.at").alias("whole"))
    closed = F.coalesce(F.element_at(F.col("walk.spans")["whole"], -1) == F.col("walk.at"), F.lit(False))
    all_spans = F.when(F.size("walk.spans") == 0, F.array(rest)).when(closed, F.col("walk.spans")).otherwise(F.array_append("walk.spans", rest))
    whole = whole.select("conv_id", "formatted", F.col("walk.at").alias("at"), F.posexplode(all_spans).alias("example", "span"))
    return whole.select(
        "conv_id", "example", F.substring("formatted", F.lit(1), F.col("span.whole").cast("int")).alias("text"),
        F.col("span.first").alias("loss_start"), F.col("span.stop").alias("loss_end"), (F.col("span.whole") == F.col("at")).alias("last"),
    )


def parsed(text: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.split(text, r"<\|im_start\|>")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(unescaped(role, ROLE_CONTROL).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def digests(shown: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: turns, reply characters, and their SHA-256 sums."""
    reply = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = shown.select(
        "conv_id", F.struct("example", unescaped(reply).alias("reply")).alias("loss"), F.when(F.col("last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"),
    )
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("loss")).alias("losses"), F.collect_list("whole").alias("whole"), F.sum("chars").alias("formatted_chars"))
    per = per.select("conv_id", F.array_join(F.col("losses")["reply"], "").alias("loss"), parsed(F.element_at("whole", 1)).alias("turns"), "formatted_chars")
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
