"""Chat formatting from event logs, in DataFrame functions only.

A log has one row an event: conversation, sequence number, kind, message, role, text. Kinds: `message` sets a message's text,
`delta` appends streamed text, `edit` replaces the text so far, `regenerate` drops it so that later deltas build it anew.
Events are folded in order of sequence number into final messages; messages stand in order of their first event.

Template: `<s>`, then for each turn `[INST]` role `[/INST]` text `</s>`. A control string inside a role or text gets a backslash
after its first character, and one that has backslashes there already gets one more: that is undone exactly. The loss mask is a
list of spans (start, length in code points) of the formatted text that cover the assistant texts.

Scale: events meet by message first and turns by conversation; a conversation is one output row, so its turns do meet in one
task (running offsets come from a window that spills). Nothing else is gathered.

Defined results: null text or role counts as empty; a null kind counts as `message`; null sequence numbers come first; events with
the same number are taken in order of kind, role and text; null conversations form one conversation; an empty log gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, END, HEAD, HEAD_END, ASSISTANT = "<s>", "</s>", "[INST]", "[/INST]", "assistant"
_REST = r"(/?s>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _REST, r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)\\" + _REST, r"$1$2$3")


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: _conv, _at (order in the conversation), _role, _text."""
    e = events.select(
        F.col(conv).alias("_conv"), F.col(message).alias("_message"),
        F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_e"),
    )
    m = e.groupBy("_conv", "_message").agg(F.sort_array(F.collect_list("_e")).alias("_es"))
    m = m.withColumn("_from", F.expr("greatest(array_max(transform(_es, (e, i) -> if(e.kind = 'delta', 0, i + 1))), 1)"))
    told = F.expr("coalesce(get(filter(transform(_es, e -> e.role), r -> r <> ''), 0), '')")
    return m.select("_conv", F.expr("_es[0].seq").alias("_at"), told.alias("_role"), F.expr("array_join(transform(slice(_es, _from, size(_es)), e -> e.text), '')").alias("_text"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of folded messages."""
    t = turns.select("_conv", "_at", "_role", "_text", escape(F.col("_text")).alias("_x"), F.concat(F.lit(HEAD), escape(F.col("_role")), F.lit(HEAD_END)).alias("_h"))
    order = Window.partitionBy("_conv").orderBy("_at", "_role", "_text")
    before = F.sum(F.length("_h") + F.length("_x") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.select("_conv", F.struct(
        F.row_number().over(order).alias("n"), F.concat("_h", "_x", F.lit(END)).alias("block"), (F.col("_role") == ASSISTANT).alias("loss"),
        (F.coalesce(before, F.lit(0)) + len(BEGIN) + F.length("_h")).alias("start"), F.length("_x").alias("length"),
    ).alias("_t"))
    c = t.groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    spans = F.expr("transform(filter(_ts, t -> t.loss), t -> struct(t.start as start, t.length as length))")
    return c.select(F.col("_conv").alias("conv_id"), F.concat(F.lit(BEGIN), F.array_join(F.expr("transform(_ts, t -> t.block)"), "")).alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame, **names: str) -> DataFrame:
    return render(fold(events, **names))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text as they were) and loss_text, from formatted texts and their masks."""
    blocks = F.split(F.expr(f"substring(formatted, {len(BEGIN) + 1})"), END, -1)
    f = formatted.select("*", F.expr("slice(_b, 1, size(_b) - 1)").alias("_blocks")) if "_b" in formatted.columns else formatted.withColumn("_b", blocks).select("*", F.expr("slice(_b, 1, size(_b) - 1)").alias("_blocks"))

    def turn(block: Column) -> Column:
        head = F.substring_index(block, HEAD_END, 1)
        role, text = head.substr(F.lit(len(HEAD) + 1), F.length(head)), block.substr(F.length(head) + len(HEAD_END) + 1, F.length(block))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    wide = F.encode("formatted", "UTF-32")  # four bytes a code point: a span is a slice, not a walk from the start
    f = f.withColumn("_wide", wide)
    loss = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(F.col("_wide"), s["start"] * 4 + 1, s["length"] * 4), "UTF-32")))
    return f.select("conv_id", "formatted", F.transform("_blocks", turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    r = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
