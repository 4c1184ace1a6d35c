"""Chat formatting in budgeted windows. DataFrame functions only.

Every turn is rendered as ``<s>role\\ntext</s>``; in roles and texts the characters that control strings begin with are
escaped (``~`` ``<`` ``[`` become ``~0`` ``~1`` ``~2``, a line feed in a role ``~3``), so no text can end its turn and
``unescape`` gives every text back.

Windows are spans of whole turns chosen by prefix sums, and hold ``budget`` tokens at most. The leading system turn opens
every window. What it and ``history`` leave of the budget is the room for new turns. The other turns are laid end to end
on a line marked off in lengths of that room: turns that lie between two marks form a span; a turn that a mark cuts joins
the span before it if both fit the room together, or is a span of its own. A window repeats the turns before its first
new one, from the window before, that begin at most ``history`` tokens before it and still fit the budget. A turn is
never cut: only a window whose system turn and one new turn are too long by themselves is over the budget, and then it
repeats nothing. The loss mask lists the assistant texts that are new in the window; repeated targets are masked, so each
counts once.

Prefix sums have two levels, blocks of 64 turn numbers and turns within a block, so a conversation with a third of all
rows is spread over many tasks. A turn's tokens are its rendered UTF-8 bytes over ``bytes_per_token``, rounded up.

Defined cases: null texts and roles count as empty; rows with equal turn numbers are ordered by role and text, repeated
rows are turns of their own; null turns come first; a null conv_id is a conversation; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 64
#: What is escaped, in this order; undone in the opposite order.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "~3"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _head(role: Column) -> Column:
    return F.concat(F.lit("<s>"), escape(role, ROLE_ESCAPES), F.lit("\n"))


def _measured(turns: DataFrame, bytes_per_token: int) -> DataFrame:
    """Turns with their place (block, at), their sizes and the tokens before them in their block. Written once: planning reads its numbers only."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = _head(role), escape(text)
    size = F.octet_length(head) + F.octet_length(body) + 4
    t = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)), F.lit(-(1 << 60))).alias("block"),
        F.ceil(size / F.lit(bytes_per_token)).cast("long").alias("tokens"), F.char_length(head).cast("long").alias("head"), F.char_length(body).cast("long").alias("body"),
    )
    before = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(t.withColumns({"in_block": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "at": F.count("tokens").over(before)}).drop("turn"), "turns")


def format_windows(turns: DataFrame, budget: int = 640, history: int = 128, bytes_per_token: int = 4) -> DataFrame:
    """One row per window: conv_id, window, text, carried (code points of its repeated turns), tokens, loss (spans start, length)."""
    said = _measured(turns, bytes_per_token)
    t = said.withColumn("system", F.col("role") == "system").select("conv_id", "block", "at", "in_block", "system", (F.col("role") == "assistant").alias("target"), "tokens", "head", "body")

    over = Window.partitionBy("conv_id").orderBy("block")
    blocks = t.groupBy("conv_id", "block").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.when((F.col("at") == 0) & F.col("system"), F.col("tokens"))), F.lit(0)).alias("lead"))
    blocks = blocks.select(F.col("conv_id").alias("bc"), F.col("block").alias("bb"), (F.sum("n").over(over) - F.col("n")).alias("n0"), (F.sum("rows").over(over) - F.col("rows")).alias("r0"), F.first("lead").over(over).alias("opening"))
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("block") == F.col("bb")))
    # tokens before a turn, the system turn left out; that turn itself lies before 0
    t = t.withColumns({"before": F.col("n0") + F.col("in_block") - F.col("opening"), "pos": F.col("r0") + F.col("at")}).drop("bc", "bb", "n0", "r0", "in_block")
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("opening"))
    t = t.withColumns({"opens": (F.col("pos") == 0) & (F.col("opening") > 0), "room": room})
    t = t.withColumn("cell", F.when(F.col("opens"), 0).otherwise(F.floor(F.col("before") / F.col("room"))))
    t = t.withColumn("cut", ~F.col("opens") & (F.floor((F.col("before") + F.col("tokens") - 1) / F.col("room")) > F.col("cell")))
    beside = F.coalesce(F.sum(F.when(~F.col("cut") & ~F.col("opens"), F.col("tokens"))).over(Window.partitionBy("conv_id", "cell")), F.lit(0))
    alone = F.col("cut") & (beside > 0) & (beside + F.col("tokens") > F.col("room"))
    t = t.withColumn("window", 2 * F.col("cell") + F.when(alone, 1).otherwise(0)).drop("cell", "cut", "room")

    fresh = F.coalesce(F.sum(F.when(~F.col("opens"), F.col("tokens"))), F.lit(0))
    spans = t.groupBy("conv_id", "window").agg(F.min(F.when(~F.col("opens"), F.col("before"))).alias("begins"), F.min("pos").alias("first"), (F.lit(budget) - F.max("opening") - fresh).alias("left"))
    ahead = Window.partitionBy("conv_id").orderBy("window")
    spans = spans.select(F.col("conv_id").alias("sc"), F.col("window").alias("sw"), "first", *(F.lead(c).over(ahead).alias(f"next_{c}") for c in ("window", "begins", "left")))

    joined = t.join(spans, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("window") == F.col("sw")))
    repeated = F.col("next_window").isNotNull() & (F.col("next_begins") - F.col("before") <= F.least(F.lit(history), F.col("next_left"))) & ~F.col("opens")
    as_new = F.struct(F.col("window").alias("window"), F.lit(2).alias("kind"))
    as_old = F.struct(F.col("next_window").alias("window"), F.lit(1).alias("kind"))
    copies = F.explode(F.when(repeated, F.array(as_new, as_old)).otherwise(F.array(as_new))).alias("c")
    columns = ["conv_id", "block", "at", "pos", "target", "tokens", "head", "body"]
    placed = joined.select(*columns, copies).select(*columns, "c.window", "c.kind")
    kept = spans.filter("first > 0").select("sc", "sw").join(t.filter("opens").select(*columns), F.col("sc").eqNullSafe(F.col("conv_id")))
    placed = placed.unionByName(kept.select(*columns, F.col("sw").alias("window"), F.lit(0).alias("kind")))

    size = F.col("head") + F.col("body") + 4
    so_far = Window.partitionBy("conv_id", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(size).over(so_far), F.lit(0))
    span = F.when((F.col("kind") == 2) & F.col("target"), F.struct((F.col("offset") + F.col("head")).alias("start"), F.col("body").alias("length")))
    planned = placed.withColumn("offset", offset).withColumns({"span": span, "carried": F.when(F.col("kind") < 2, size).otherwise(0)})
    planned = planned.select(F.col("conv_id").alias("pc"), F.col("block").alias("pb"), F.col("at").alias("pa"), "window", "kind", "pos", "span", "carried", "tokens")

    # the texts meet their windows here for the first time
    full = said.select("conv_id", "block", "at", "role", "text").join(planned, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("block") == F.col("pb")) & (F.col("at") == F.col("pa")))
    shown = F.concat(_head(F.col("role")), escape(F.col("text")), F.lit("</s>"))
    out = full.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", shown.alias("shown")))).alias("parts"),
        F.sum("carried").alias("carried"),
        F.array_sort(F.collect_list("span")).alias("loss"),
        F.sum("tokens").alias("tokens"),
    )
    return out.select("conv_id", "window", F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("text"), "carried", "tokens", "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """From formatted windows alone: conv_id, window, turns (role, text; repeated ones left out), targets (texts under the loss mask)."""
    fresh = F.substring(F.col("text"), F.col("carried").cast("int") + 1, F.char_length("text"))
    pieces = F.filter(F.split(fresh, "</s>"), lambda p: F.startswith(p, F.lit("<s>")))

    def turn(p: Column) -> Column:
        end = F.call_function("instr", p, F.lit("\n"))
        return F.struct(unescape(F.substring(p, F.lit(4), end - 4), ROLE_ESCAPES).alias("role"), unescape(F.substring(p, end + 1, F.char_length(p))).alias("text"))

    target = lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int")))
    return windows.select("conv_id", "window", F.transform(pieces, turn).alias("turns"), F.transform("loss", target).alias("targets"), F.char_length("text").cast("long").alias("formatted_chars"))
