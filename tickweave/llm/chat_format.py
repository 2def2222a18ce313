"""Chat formatting by event sourcing.

Events (conversation, sequence, slot, role, kind, text) are partitioned by conversation once and put in
sequence. Within a slot, ``delta`` appends, ``edit`` replaces, ``regenerate`` starts the slot anew and drops
every later slot's events so far. The surviving slots are the final messages, rendered by a template.

The template writes ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a line feed per
turn. Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (and a role's line feed
``&nl;``), so no text can forge a marker and the original comes back exactly.

Defined results: null role or text counts as empty; rows with equal sequence go by kind, role and text;
repeated rows of ``conversations`` are turns of their own; an empty log gives no rows; a null conversation
id is a conversation; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(out, F.lit("\n"), F.lit("&nl;")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&nl;"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


#: Sequence numbers of a slot's events, and the code points of a draft.
STEPS, DRAFT = 8, 64


def log_of(turns: DataFrame) -> DataFrame:
    """An event log whose fold gives rows (conv_id, turn, role, text) back, as a chat front end would have written it; slots by turn, then role and text.

    A text is streamed in three deltas. Before that an assistant's slot holds a draft and the next slot the start of an answer to it, until the
    slot is regenerated; any other slot holds a draft that an edit replaces by the first third.
    """
    slot = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("slot", slot.cast("long"))
    n = F.length("text")
    third = lambda k: F.floor(n * k / 3).cast("int")
    parts = [F.substring(F.col("text"), third(k) + 1, third(k + 1) - third(k)) for k in range(3)]
    draft = F.concat(F.lit("draft: "), F.substring("text", 1, DRAFT))

    def event(step: int, kind: str, text, later: int = 0):
        return F.struct((F.col("slot") * STEPS + step).alias("seq"), (F.col("slot") + later).alias("slot"), (F.lit("user") if later else F.col("role")).alias("role"), F.lit(kind).alias("kind"), text.alias("text"))

    redone = F.array(event(0, "delta", draft), event(1, "delta", F.lit("go on"), 1), event(2, "regenerate", F.lit("")), *(event(3 + k, "delta", p) for k, p in enumerate(parts)))
    edited = F.array(event(0, "delta", draft), event(1, "edit", parts[0]), event(2, "delta", parts[1]), event(3, "delta", parts[2]))
    return rows.select("conv_id", F.inline(F.when(F.col("role") == "assistant", redone).otherwise(edited)))


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, slot, role, text. One shuffle, by conversation; the slots and windows reuse it."""
    rows = events.select("conv_id", "slot", F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    slots = rows.repartition("conv_id").groupBy("conv_id", "slot").agg(
        F.array_sort(F.collect_list("e")).alias("events"), F.max(F.when(F.col("e.kind") == "regenerate", F.col("e.seq"))).alias("regenerated"))
    cut = F.max("regenerated").over(Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    live = slots.withColumn("cut", cut).withColumn("events", F.filter("events", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut")))).filter(F.size("events") > 0)
    whole = F.col("events")
    last = F.coalesce(F.array_max(F.transform(whole, lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i))), F.lit(0))
    live = live.withColumn("last", last)
    texts = F.transform(F.filter(whole, lambda e, i: i >= F.col("last")), lambda e: e["text"])
    return live.select("conv_id", "slot", F.get(whole, F.size(whole) - 1)["role"].alias("role"), F.array_join(texts, "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_mask: per turn under the mask its number and span [start, end) of code points in that turn's part."""
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    m = messages.withColumns({"head": head, "body": escape(F.col("text")), "learn": F.col("role").isin(*trained)})
    turn = F.struct("slot", "role", "head", "body", "learn")
    out = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")))
    spans = F.filter(F.transform("turns", lambda t, i: F.when(t["learn"], F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), (F.length(t["head"]) + F.length(t["body"])).alias("end")))), lambda s: s.isNotNull())
    return out.select("conv_id", F.array_join(parts, "").alias("formatted"), spans.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Rendered conversations parsed again: conv_id, turns (role, text), loss_texts, formatted."""
    parts = F.filter(F.split("formatted", r"(?=<\|im_start\|>)"), lambda p: p != "")
    out = rendered.withColumn("parts", parts)

    def turn(p: Column) -> Column:
        inner = F.substring(p, F.lit(len(START) + 1), F.length(p) - len(START) - len(END) - 1)
        head = F.substring_index(inner, "\n", 1)
        return F.struct(unescape(head, role=True).alias("role"), unescape(F.substring(inner, F.length(head) + 2, F.length(inner))).alias("text"))

    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.get(F.col("parts"), s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return out.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), loss.alias("loss_texts"))


def digests(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
