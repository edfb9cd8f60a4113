"""Chat logs folded into final messages, rendered under a template and read back. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from mostrador.llm.common import plain_text

START, ROLE_END, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that control this or another common template, as fixed by those; a backslash is put after the first character.
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    """Text without control strings; :func:`unescape` gives the text back, whatever it holds."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log (conv_id, seq, kind, turn, role, text).

    Kinds: ``message`` sets a turn's text, ``delta`` adds to it, ``edit`` replaces it and withdraws all later turns,
    ``regenerate`` empties it and withdraws all later turns. Events count in the order of seq; equal seq are ordered
    by turn, kind, role and text. A turn's role is the last one that is not NULL among its live events, else empty.
    A NULL text is empty, a NULL conv_id is a conversation of its own; events without seq come first, events of
    another kind are ignored. A turn that was withdrawn and not written again is absent.
    """
    order = ["seq", "turn", "kind", "role", "text"]
    known = events.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    cut = F.when(F.col("kind").isin("edit", "regenerate"), F.col("turn"))
    later = (Window.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in order])
             .rowsBetween(Window.unboundedPreceding, -1))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    set_later = F.max(F.when(F.col("kind") == "message", F.col("rank"))).over(Window.partitionBy("conv_id", "turn"))
    live = (known.withColumns({"rank": rank, "cut": F.min(cut).over(later)})
            .where("cut is null or cut > turn or turn is null").withColumn("set_at", set_later)
            .where("set_at is null or rank >= set_at"))
    written = F.sort_array(F.collect_list(F.struct("rank", plain_text("text").alias("text"))))
    return (live.groupBy("conv_id", "turn")
            .agg(written.alias("parts"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("rank"))).alias("role"),
                 F.max(F.struct("rank", "kind"))["kind"].alias("last"))
            .where("last <> 'regenerate'")
            .select("conv_id", "turn", plain_text("role").alias("role"),
                    F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` are the places (start, counted from 1, and length, in code points) of the trained role's texts in
    ``formatted``. A conversation is one value and so must fit in one row. Repeated turns are ordered by role and
    text; without messages there are no rows.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), escape(plain_text("role")), F.lit(ROLE_END))
    turns = (messages.select("conv_id", "turn", "role", "text", head.alias("head"), escape(plain_text("text")).alias("body"))
             .withColumns({"place": F.row_number().over(by_turn),
                           "piece": F.concat("head", "body", F.lit(END), F.lit("\n"))})
             .withColumn("end", F.sum(F.length("piece")).over(by_turn.rowsBetween(Window.unboundedPreceding, 0))))
    start = F.col("end") - F.length("piece") + F.length("head") + 1
    span = F.when(F.col("role") == trained_role, F.struct(start.alias("start"), F.length("body").alias("length")))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("place", "piece", span.alias("span")))).alias("turns"))
    return rows.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation: an array of (role, text)."""
    quoted = START.replace("|", r"\|")
    def turn(part: Column) -> Column:
        return F.struct(unescape(F.substring_index(part, ROLE_END, 1)).alias("role"),
                        unescape(F.substring_index(F.substring_index(part, ROLE_END, -1), END, 1)).alias("text"))
    return F.transform(F.filter(F.split(formatted, quoted), lambda part: part != ""), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
