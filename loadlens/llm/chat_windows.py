"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose the spans: a turn belongs to the span in which it begins, and spans are half a budget
long, so that a span of turns no longer than half a budget fits the budget. A longer turn is a span of its own. Each
window holds the conversation's system turn, a limited number of turns before the span, and the span. The system turn
comes off the budget before it is halved, and the oldest of the turns before the span are left out until the window fits.
What a window repeats is masked, so each assistant turn is a training target once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.common import word_count


@dataclass(frozen=True)
class Template:
    """open + role + newline + text + close for each turn. Control strings inside texts are escaped by a backslash after
    their first character, and backslashes are doubled; dropping one backslash before each character undoes both."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = field(default=("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))

    def escape(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        firsts = "".join(sorted({c[0] for c in self.controls}))
        rest = "|".join(rf"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in self.controls)
        return F.regexp_replace(doubled, rf"([{re.escape(firsts)}])(?={rest})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\\n"))

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.open), self.escape_role(role), F.lit("\n"), self.escape(text), F.lit(self.close))

    def turns(self, window: Column) -> Column:
        """The turns of a formatted window, as array<struct<role, text>>. The markers cannot occur inside a turn."""
        bodies = F.slice(F.split(F.replace(window, F.lit(self.close), F.lit("")), re.escape(self.open), -1), 2, 1_000_000_000)
        head = r"^((?:[^\\\n]++|\\[\s\S])*+)\n([\s\S]*)$"
        return F.transform(bodies, lambda b: F.struct(self.unescape(F.regexp_extract(b, head, 1)).alias("role"), self.unescape(F.regexp_extract(b, head, 2)).alias("text")))


def _by_size(turns: DataFrame, block: int) -> DataFrame:
    """Adds place (order in the conversation from 0) and start (tokens before the turn).

    Both are sums over whole blocks of turn numbers plus sums inside the block, so a conversation of any number of turns
    is dealt out by blocks; only a row per block meets in a conversation's window.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text_hash"]
    rows = turns.withColumn("block", F.floor(F.col("turn") / block))
    sums = rows.groupBy("conv_id", "block").agg(F.count("*").alias("rows"), F.sum("tokens").alias("sum"))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"))
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    r, s = rows.alias("r"), sums.alias("s")
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("r.block").eqNullSafe(F.col("s.block"))
    placed = r.join(s, same).select("r.*", (F.col("nth") - 1 + F.col("rows_before")).alias("place"), (F.col("upto") - F.col("tokens") + F.col("sum_before")).alias("start"))
    return placed.drop("nth", "upto", "block")


def format_windows(turns: DataFrame, template: Template = Template(), budget: int = 512, history: int = 2, overhead: int = 4, block: int = 1024) -> DataFrame:
    """One row per window of each conversation of turns (conv_id, turn, role, text): conv_id, span, first_place, repeated,
    text, targets, over_budget.

    text is the formatted window; its first `repeated` turns are the system turn and the history. targets holds the
    (start, length) in code points of each text under the loss mask: the new assistant turns. Turns go by turn, null
    first, ties by role and text. A null text or role is empty. A turn's tokens are its words plus overhead. A
    conversation's system turn is its first turn if that has the role system; it is retained in every window. Rows with a
    null conv_id are a conversation of their own. Equal rows are turns of their own. An empty table gives none.

    Only a window whose one new turn does not fit beside the system turn is over budget.
    """
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.sha2("text", 256)).withColumn("tokens", word_count(F.col("text")) + overhead)
    placed = _by_size(base, block)
    system = placed.where("place = 0 and role = 'system'").select(F.col("conv_id").alias("sys_conv"), F.col("role").alias("sys_role"), F.col("text").alias("sys_text"), F.col("tokens").alias("sys_tokens"))
    half = F.greatest(F.floor((budget - F.coalesce("sys_tokens", F.lit(0))) / 2), F.lit(1))
    placed = placed.join(system.select("sys_conv", "sys_tokens"), F.col("conv_id").eqNullSafe(F.col("sys_conv")), "left")
    # A turn's span is the half budget in which it begins. A longer turn is alone in an odd span: what follows it begins later.
    placed = placed.withColumn("span", 2 * F.floor(F.col("start") / half) + (F.col("tokens") > half).cast("long")).drop("sys_conv", "sys_tokens")
    # a turn is history for the spans of the next few turns
    ahead = placed.select("conv_id", F.explode(F.sequence(F.col("place") - history, F.col("place") - 1)).alias("place"), "span").distinct() if history else placed.select("conv_id", "place", "span").limit(0)
    t, h = placed.alias("t"), ahead.alias("h")
    repeats = t.join(h, F.col("t.conv_id").eqNullSafe(F.col("h.conv_id")) & (F.col("t.place") == F.col("h.place"))).where("t.span <> h.span").select("t.conv_id", "t.place", "t.role", "t.text", "t.tokens", F.lit(False).alias("new"), "h.span")
    used = placed.select("conv_id", "place", "role", "text", "tokens", F.lit(True).alias("new"), "span").unionByName(repeats)
    # the number of turns in a window is bounded by budget / overhead + history, whatever the conversation
    turn = F.struct("place", "new", "role", "text", "tokens")
    windows = used.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    w, s = windows.alias("w"), system.alias("s")
    windows = w.join(s, F.col("w.conv_id").eqNullSafe(F.col("s.sys_conv")), "left")
    present = F.col("turns")[0]["place"] == 0
    sys_turn = F.struct(F.lit(0).cast("long").alias("place"), F.lit(False).alias("new"), F.col("sys_role").alias("role"), F.col("sys_text").alias("text"), F.col("sys_tokens").alias("tokens"))
    # the system turn is put first where the span and its history do not hold it
    windows = windows.withColumn("turns", F.when(F.col("sys_role").isNotNull() & ~present, F.concat(F.array(sys_turn), "turns")).otherwise(F.col("turns")))
    total = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    fixed = lambda t: t["new"] | ((t["place"] == 0) & F.col("sys_role").isNotNull())
    windows = windows.withColumn("room", budget - total(F.filter("turns", fixed))).withColumn("past", F.filter("turns", lambda t: ~fixed(t)))
    # a turn of the history stays where it and all later ones fit
    windows = windows.withColumn("turns", F.filter("turns", lambda t: fixed(t) | (total(F.filter("past", lambda x: x["place"] >= t["place"])) <= F.col("room"))))
    windows = windows.withColumn("parts", F.transform("turns", lambda t: template.render(t["role"], t["text"])))
    # where each text begins: after the parts before it, the opening marker, the role and the newline
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.col("parts")[i])).alias("at"),
        F.when(F.col("turns")[i]["new"] & (F.col("turns")[i]["role"] == "assistant"),
               F.concat(acc["found"], F.array(F.struct((acc["at"] + len(template.open) + F.length(template.escape_role(F.col("turns")[i]["role"])) + 1).alias("start"),
                                                       F.length(template.escape(F.col("turns")[i]["text"])).alias("length"))))).otherwise(acc["found"]).alias("found"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), zero, step, lambda acc: acc["found"])
    return windows.select(
        "conv_id", "span", F.filter("turns", lambda t: t["new"])[0]["place"].alias("first_place"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("repeated"), F.array_join("parts", "").alias("text"), found.alias("targets"), (total(F.col("turns")) > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from formatted windows alone: n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars, loss_sha256 (all text under the loss mask, unescaped) and formatted_chars.

    windows are those of format_windows, one row for each conv_id and span; a null conv_id is a conversation. The digests
    need the whole conversation, so its windows meet in one row. An empty table gives an empty table."""
    parsed = windows.withColumn("all", template.turns(F.col("text")))
    own = F.slice("all", F.col("repeated") + 1, F.greatest(F.size("all") - F.col("repeated"), F.lit(0)))
    said = F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("targets", lambda t: template.unescape(F.substring(F.col("text"), t["start"] + 1, t["length"]))), "")
    parts = parsed.select("conv_id", "span", F.size(own).alias("n"), said.alias("said"), loss.alias("loss"), F.length("text").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "said", "loss"))).alias("p"), F.sum("n").alias("n_turns"), F.sum(F.length("loss")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.col("p.said"), ""), 256).alias("turns_sha256"),
        F.col("loss_chars").cast("long").alias("loss_chars"), F.sha2(F.array_join(F.col("p.loss"), ""), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_windows",
    )
