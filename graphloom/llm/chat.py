"""Chat formatting in budgeted windows, with DataFrame functions alone.

A conversation's running sum of turn tokens is cut into stretches of `stride` tokens.  The turns that begin in
one stretch form its window; a turn that runs over the stretch's end and would take the window beyond the stride
gets a window of its own.  So every window is turn-aligned, and its turns follow from prefix sums alone: no window
waits for the one before.  Each window repeats the conversation's system turn and the turns before it as far as
the history's tokens reach; what is repeated is masked, so each assistant text is a target once."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# Marks of this template, and control strings of common chat templates.
BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (BEGIN, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The role whose texts are targets, and the one that windows retain.
TARGET, SYSTEM = "assistant", "system"

#: Tokens of a window, of the history that it repeats, and of a system turn that it repeats.
BUDGET, HISTORY, RETAINED = 4096, 1024, 512
#: Tokens that a turn's marks take.
MARKS = 4
#: Turns and bytes of a conversation that are gathered in one task; above either it is cut by ranges.
TASK_TURNS, TASK_BYTES = 2048, 8 << 20
#: Turns in one range of a conversation above that, about.
RANGE_TURNS = 50_000

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_HEAD = "".join(sorted({re.escape(c[0]) for c in CONTROLS}))
#: A token of the native estimate: up to six letters, up to three digits, or another character that isn't blank.
TOKEN = r"[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"


def escape(text: Column) -> Column:
    """A backslash goes behind the first character of each control string, and of what looks like one escaped."""
    return F.regexp_replace(text, rf"([{_HEAD}])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    return F.regexp_replace(text, rf"([{_HEAD}])\\(\\*)({_REST})", "$1$2$3")


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text by a rule that needs no vocabulary: see TOKEN."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


#: Order of a conversation's turns; equal rows are alike, so their order is no matter.
ORDER = ("no_turn", "turn", "role", "digest")
TURN = (*ORDER, "text", "tokens", "before")


def _placed_small(turns: DataFrame) -> DataFrame:
    """Adds before: tokens of the conversation's earlier turns; and total, of all."""
    whole = Window.partitionBy("conv_id")
    upto = F.sum("tokens").over(whole.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("before", upto - F.col("tokens")).withColumn("total", F.sum("tokens").over(whole))


def _placed_large(turns: DataFrame, rows: int) -> DataFrame:
    """The same for conversations of any length: they are dealt into ranges, whose sums are summed."""
    ranges = turns.repartitionByRange(max(1, math.ceil(rows / RANGE_TURNS)), "conv_id", *ORDER)
    ranges = materialise(ranges.withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("conv_id", "part").agg(F.sum("tokens").alias("words"))
    parts = Window.partitionBy("conv_id")
    before = F.sum("words").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("conv_id").alias("s_id"), F.col("part").alias("s_part"), F.coalesce(before, F.lit(0)).alias("base"), F.sum("words").over(parts).alias("total"))
    within = Window.partitionBy("conv_id", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows_of = ranges.withColumn("upto", F.sum("tokens").over(within))
    rows_of = rows_of.join(sums, (F.col("part") == F.col("s_part")) & F.col("conv_id").eqNullSafe(F.col("s_id")))
    return rows_of.withColumn("before", F.col("base") + F.col("upto") - F.col("tokens")).drop("s_id", "s_part", "base", "upto", "part")


def _windows(turns: DataFrame, budget: int, history: int, retained: int) -> DataFrame:
    """One row per window of turns(conv_id, *TURN, total)."""
    stride = budget - history - retained
    before, tokens = F.col("before"), F.col("tokens")
    cell = F.floor(before / stride)
    last = F.floor((F.col("total") - 1) / stride)
    system = (before == 0) & (F.col("role") == SYSTEM) & (tokens <= retained)
    # a turn goes to its own stretch; to the next one, if that can repeat it; a system turn to all
    ahead = F.when(before + history >= (cell + 1) * stride, 1).otherwise(0)
    reach = F.when(system, last).otherwise(F.least(last, cell + ahead))
    spread = turns.withColumn("own", cell).withColumn("system", F.coalesce(system, F.lit(False))).withColumn("cell", F.explode(F.sequence(cell, F.greatest(cell, reach))))
    row = F.struct("before", *ORDER, "text", "tokens", "system", (F.col("own") == F.col("cell")).alias("own"))
    cells = spread.groupBy("conv_id", "cell").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    own = lambda t: t["own"]
    add = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    cells = cells.withColumn("mine", F.filter("turns", own)).filter(F.size("mine") > 0)
    alone = (F.size("mine") > 1) & (F.element_at("mine", -1)["before"] + F.element_at("mine", -1)["tokens"] > (F.col("cell") + 1) * stride) & (add(F.col("mine")) > stride)
    parts = F.when(alone, F.array(F.expr("slice(mine, 1, size(mine) - 1)"), F.expr("slice(mine, -1, 1)"))).otherwise(F.array("mine"))
    spans = cells.select("conv_id", "cell", "turns", F.posexplode(parts).alias("half", "new"))
    spans = spans.withColumn("start", F.get("new", 0)["before"])
    # a system turn within the reach of the history is repeated once, in its place
    spans = spans.withColumn("kept", F.filter("turns", lambda t: t["system"] & (t["before"] < F.col("start"))))
    room = F.least(F.lit(history), F.greatest(F.lit(0), F.lit(budget) - add(F.col("kept")) - add(F.col("new"))))
    spans = spans.withColumn("room", room)
    again = F.filter("turns", lambda t: ~t["system"] & (t["before"] < F.col("start")) & (t["before"] >= F.col("start") - F.col("room")))
    flag = lambda a, new: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(new).alias("new")))
    spans = spans.withColumn("again", again)
    said = F.concat(flag(F.col("kept"), False), flag(F.col("again"), False), flag(F.col("new"), True))
    spans = spans.select("conv_id", F.col("start").alias("first_token"), (F.size("kept") + F.size("again")).alias("n_repeated"), said.alias("said"))
    written = F.transform(
        "said",
        lambda t: F.struct(
            F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["new"] & (t["role"] == TARGET)).alias("target"),
        ),
    )
    spans = spans.withColumn("tokens", add(F.col("said"))).withColumn("written", written)
    text = F.array_join(F.transform("written", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    width = lambda t: F.length(t["head"]) + F.length(t["body"])
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(s, t):
        span = F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))
        return F.struct((s["at"] + width(t) + len(END)).alias("at"), F.when(t["target"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    loss = F.aggregate("written", none, step, lambda s: s["spans"])
    return spans.select("conv_id", "first_token", "n_repeated", F.size("said").alias("n_turns"), "tokens", text.alias("formatted"), loss.alias("loss_spans"))


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, retained: int = RETAINED, tokens=estimated_tokens) -> DataFrame:
    """Training windows of conversations(conv_id, turn, role, text): a row per window with conv_id, first_token
    (tokens of the conversation before its first new turn, which puts a conversation's windows in order),
    n_repeated (leading turns that are repeated: system turn and history), n_turns (all of it), tokens, formatted
    (the text), loss_spans (start and length, in characters, of the targets within it).

    tokens: a function that turns a column of texts into one of token counts, such as the built-in estimate.  A
    window holds at most `budget` tokens unless one single turn is longer; such a turn repeats no history.  A system
    turn is repeated if it comes first and takes at most `retained` tokens.  Turns are formatted as marks, role and
    text; control strings inside either are escaped reversibly.

    Rows go by turn, null turns last; rows of one turn by role and a digest of the text.  Null role or text:
    empty.  A null conv_id is a conversation of its own.  Repeated rows are turns of their own, empty texts too (their
    marks take tokens).  Very long texts stay whole.  Further columns are left aside, whatever their names; an empty
    table gives no window.  A conversation above TASK_TURNS turns or TASK_BYTES is never gathered: its running sums
    are taken over ranges of its turns, and only the turns of one stretch meet."""
    if history + retained >= budget or history > budget - history - retained:
        raise ValueError("history must fit into the tokens that history and retained leave of the budget")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.select("conv_id", F.col("turn").isNull().alias("no_turn"), "turn", role.alias("role"), text.alias("text"))
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    large = materialise(size.filter((F.col("rows") > TASK_TURNS) | (F.col("bytes") > TASK_BYTES)).select(F.col("conv_id").alias("large_id"), "rows"))
    turns = turns.withColumn("digest", F.md5("text")).withColumn("tokens", tokens(F.col("text")) + MARKS)
    rows = large.agg(F.sum("rows")).first()[0]
    if not rows:
        return _windows(_placed_small(turns), budget, history, retained)
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    few, many = turns.join(large, same, "left_anti"), turns.join(large.drop("rows"), same, "left_semi")
    return _windows(_placed_small(few), budget, history, retained).unionByName(_windows(_placed_large(many, rows), budget, history, retained))


def parse_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted window, unescaped, as array of struct(role, text)."""
    turns = F.split(formatted, re.escape(END))
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    cut = lambda t: F.split(F.substring(t, len(BEGIN) + 1, 2**31 - 1), re.escape(MIDDLE))
    return F.transform(F.transform(turns, cut), lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the text of windows.

    The two digests are over all of a conversation's text in order, so that text meets in one row here; the windows
    themselves never do."""
    turns = F.slice(F.col("read"), F.col("n_repeated") + 1, F.size("read"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    rows = windows.withColumn("read", parse_turns(F.col("formatted")))
    row = F.struct("first_token", said.alias("said"), loss.alias("loss"), F.size(turns).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"))
    rows = rows.select("conv_id", row.alias("w")).groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    joined = lambda c: F.array_join(F.col("ws")[c], "")
    total = lambda c: F.aggregate(F.col("ws")[c], F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
