"""Chat formatting by event sourcing, in DataFrame functions only.

A log of events (conv_id, seq, message_id, kind, role, text) is folded into final messages and rendered:

* `message`: a complete message of its own, whatever its `message_id`;
* `delta`: appended to the message `message_id`;
* `edit`, `regenerate`: what the message said before is void, its text starts again with this event.

The fold of one message sees that message's events only. Messages then meet by (conversation, chunk of
`chunk` sequence numbers), and a conversation receives one row per chunk, not one per event.

Defined cases: null text, role: empty; null kind: `message`; events of one sequence number are ordered by
kind, role, text; repeated events count again; a null conv_id is a conversation of its own; a null seq comes
first; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, only

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and of other common templates; a text holding one gets a backslash after its first character.
CONTROL = r"(<|\[)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, seq, role, text: the final messages, each at the sequence number of its first event."""
    log = only(events, conv_id="conv_id", seq="seq", message_id="message_id", kind="kind", role="role", text="text").withColumns(
        {"kind": F.coalesce("kind", F.lit("message")), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}
    )
    group = log.groupBy("conv_id", "message_id", F.when(F.col("message_id").isNull(), F.col("seq")).alias("own")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events")
    )
    parts = F.filter("events", lambda e: e["kind"] != "message")

    def message(streamed: Column) -> Column:
        resets = F.transform(streamed, lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(0)))
        live = F.slice(streamed, F.array_max(resets) + 1, F.greatest(F.size(streamed) - F.array_max(resets), F.lit(0)))
        return F.struct(F.get(streamed, F.lit(0))["seq"].alias("seq"), F.get(streamed, F.lit(0))["role"].alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))

    whole = F.transform(F.filter("events", lambda e: e["kind"] == "message"), lambda e: F.struct(e["seq"].alias("seq"), e["role"].alias("role"), e["text"].alias("text")))
    streamed = F.filter(F.array(let(parts, message)), lambda m: F.size(parts) > 0)
    return group.select("conv_id", F.explode(F.concat(whole, streamed)).alias("m")).select("conv_id", "m.*")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(role), F.lit("\n"), escape(text), F.lit(END))


def format_chats(events: DataFrame, chunk: int = 256) -> DataFrame:
    """One row per conversation.

    formatted: the rendered text; loss_spans: (start, length) in code points of what an assistant says in it;
    n_turns, turns and loss_text are read back from the rendered text of each chunk.
    """
    messages = fold_messages(events).withColumn("part", F.floor(F.coalesce("seq", F.lit(-1)) / chunk))
    parts = messages.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    pieces = F.transform("turns", lambda m: render(m["role"], m["text"]))
    lengths = F.transform("turns", lambda m: F.struct((m["role"] == "assistant").alias("said"), (F.length(F.url_encode(m["role"])) + len(START) + 1).alias("head"), F.length(escape(m["text"])).alias("body")))
    nothing = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length"))
        return F.struct(
            (acc["at"] + x["head"] + x["body"] + len(END)).alias("at"),
            F.when(x["said"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    parts = parts.select("conv_id", "part", F.array_join(pieces, "").alias("formatted"), F.aggregate(lengths, nothing, step)["spans"].alias("spans"))
    back = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != ""),
        lambda x: F.concat(F.url_decode(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)), F.lit("\n"), unescape(F.substr(x, F.position(F.lit("\n"), x) + 1)), F.lit("\n")),
    )
    parts = parts.select(
        "conv_id",
        F.struct(
            "part",
            "formatted",
            "spans",
            let(back, lambda t: F.struct(F.size(t).cast("long").alias("n"), F.array_join(t, "").alias("said"))).alias("turns"),
            F.array_join(F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "").alias("loss"),
        ).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    base = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<struct<start:bigint,length:bigint>>>)").alias("spans"))
    spans = F.aggregate(
        "p",
        base,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["formatted"])).alias("at"),
            F.concat(acc["spans"], F.array(F.transform(p["spans"], lambda s: F.struct((acc["at"] + s["start"]).alias("start"), s["length"].cast("long").alias("length"))))).alias("spans"),
        ),
    )
    text = lambda f: F.array_join(F.transform("p", f), "")
    return whole.select(
        "conv_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["turns"]["n"]).alias("n_turns"),
        text(lambda p: p["formatted"]).alias("formatted"),
        text(lambda p: p["turns"]["said"]).alias("turns"),
        text(lambda p: p["loss"]).alias("loss_text"),
        F.flatten(spans["spans"]).alias("loss_spans"),
    )


def turn_events(conversations: DataFrame) -> DataFrame:
    """A finished table of turns as a log: each row is one complete message."""
    return conversations.select(
        conversations["conv_id"],
        conversations["turn"].cast("long").alias("seq"),
        F.lit(None).cast("long").alias("message_id"),
        F.lit("message").alias("kind"),
        conversations["role"].alias("role"),
        conversations["text"].alias("text"),
    )
