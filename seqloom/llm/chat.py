"""Chat formatting in budgeted windows, with a loss mask.

A turn is written as ``<turn role="R">text</turn>`` and a new line. In roles and texts a
backslash becomes two and ``<`` becomes ``\\l``, in roles also ``"`` becomes ``\\q``, so that neither can
hold a control string, and all is undone on reading.

A turn costs the words and marks of its role and text and those of its tags. Prefix sums of the
costs along a conversation choose its windows: turns whose sum ends in the same stretch of
``budget - history`` less the system turn's cost share a window, and a turn that crosses the end
of a stretch has one of its own. A window starts with the conversation's system turn, if there is
one, and up to ``history_turns`` turns before its own that fit in ``history`` (in the window of one
turn: in what it leaves of the budget, if that is less). So no window costs more than the budget
unless its only new turn and the system turn do. Repeats are outside the loss mask; each assistant
turn's text is under it once, where it is new.

Window functions and a grouping by (conversation, window) do the work; a window holds at
most the budget and one turn, however long the conversation.

Defined results
- null text or role: empty; a conversation of null conv_id is one of its own;
- rows of one turn number: by role, then text; repeated rows are turns of their own;
- empty table: empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
TAGS = 11  # words and marks of a turn's tags


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit('"'), F.lit("\\q"))


def unescape(text: Column) -> Column:
    # an escaped backslash is found left to right, so what is left of "\l" is an escaped "<"
    undone = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\q"), F.lit('"'))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), undone), "\\")


def token_count(text: Column) -> Column:
    """Words and marks of a text."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("bigint")


def format_windows(turns: DataFrame, budget: int = 512, history: int = 128, history_turns: int = 2) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss) from rows (conv_id, turn, role, text).

    ``loss`` lists the (start, length) in code points, from 0, of the assistant texts in
    ``formatted`` that count; the first ``n_repeated`` turns of a window are repeats.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("cost", TAGS + token_count(F.col("role")) + token_count(F.col("text"))).withColumn("n", F.row_number().over(order))
    head = (F.col("n") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("head", head).withColumn("ends", F.sum("cost").over(upto)).withColumn("system", F.first(F.when(head, F.col("cost")).otherwise(F.lit(0))).over(upto))
    stretch = F.greatest(F.lit(1), budget - history - F.col("system"))
    first, last = F.floor((F.col("ends") - F.col("cost")) / stretch), F.floor((F.col("ends") - 1) / stretch)
    crossing = last > first
    alone = F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("system") - F.col("cost")))
    rows = rows.withColumn("history", F.when(crossing, alone).otherwise(F.lit(history)))
    # whole stretches have even numbers, the turns that cross from one to the next odd ones
    rows = rows.withColumn("span", F.when(crossing, 2 * last - 1).otherwise(2 * first))
    rows = rows.withColumn("new", ~F.lag("span").over(order).eqNullSafe(F.col("span")))
    # the j-th turn after this one repeats it if a window starts there and the turns between fit
    repeats = []
    for j in range(1, history_turns + 1):
        fits = F.lead("ends", j).over(order) - F.lead("cost", j).over(order) - (F.col("ends") - F.col("cost")) <= F.lead("history", j).over(order)
        repeats.append(F.when(F.lead("new", j).over(order) & fits, F.lead("span", j).over(order)))
    rows = rows.withColumn("again", F.array_compact(F.array(*repeats)))
    # the system turn goes to each window that starts after it, in its own row per window
    starts = rows.where("new and n > 1").select(F.col("conv_id").alias("_c"), F.col("span").alias("_s"))
    system = rows.where("head").select("conv_id", "n", "role", "text", F.lit(True).alias("repeat"), F.col("span").alias("_own"))
    system = system.join(starts, F.col("conv_id").eqNullSafe(F.col("_c"))).where("_s <> _own").select("conv_id", F.col("_s").alias("window"), "n", "role", "text", "repeat")
    own = rows.select("conv_id", F.col("span").alias("window"), "n", "role", "text", F.lit(False).alias("repeat"))
    past = rows.where("not head").select("conv_id", F.explode("again").alias("window"), "n", "role", "text", F.lit(True).alias("repeat"))
    grouped = own.unionByName(past).unionByName(system).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "repeat"))).alias("turns"))
    lead = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MIDDLE))
    shaped = grouped.withColumn("shaped", F.transform("turns", lambda t: F.struct(lead(t).alias("lead"), escape(t["text"]).alias("text"), ((t["role"] == "assistant") & ~t["repeat"]).alias("counts"))))

    def place(state: Column, t: Column) -> Column:
        start = state["at"] + F.char_length(t["lead"]).cast("bigint")
        length = F.char_length(t["text"]).cast("bigint")
        mark = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(CLOSE)).alias("at"), F.when(t["counts"], F.concat(state["loss"], mark)).otherwise(state["loss"]).alias("loss"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    formatted = F.array_join(F.transform("shaped", lambda t: F.concat(t["lead"], t["text"], F.lit(CLOSE))), "")
    repeated = F.size(F.filter("turns", lambda t: t["repeat"]))
    return shaped.select("conv_id", F.col("window").cast("bigint").alias("window"), formatted.alias("formatted"), repeated.alias("n_repeated"), F.aggregate("shaped", empty, place, lambda s: s["loss"]).alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_texts, chars) from formatted windows: new turns and counted texts, unescaped."""
    parts = F.split("formatted", CLOSE, -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)
    parsed = F.transform(bodies, lambda b: F.struct(unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"), unescape(F.substr(b, F.instr(b, MIDDLE) + len(MIDDLE))).alias("text")))
    new = F.slice(parsed, F.col("n_repeated") + 1, F.size(parsed))
    counted = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", new.alias("turns"), counted.alias("loss_texts"), F.char_length("formatted").cast("bigint").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from windows.

    A digest is of a whole conversation, so its texts meet in one row here.
    """
    read = read_windows(windows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", F.struct("window", told.alias("told"), F.array_join("loss_texts", "").alias("loss")).alias("w"), F.size("turns").cast("bigint").alias("n"), "chars")
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns, loss = F.array_join(F.transform("w", lambda w: w["told"]), ""), F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
