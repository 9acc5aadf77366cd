"""Multi-party chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a conversation is rendered once as the assistant while
all others become named users. The mask is a list of character spans that the
speaker wrote, so the loss of a model trained on the rendering covers those
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import cut

#: The frame of one message and the name of a speaker without one.
OPEN, CLOSE, NOBODY = "<|im_start|>", "<|im_end|>\n", "unknown"


def _header(me: Column, name: Column) -> Column:
    """The line above a message: the speaker in focus is the assistant, all others are named users."""
    return F.when(me, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))


def _parts(rows: DataFrame, part_turns: int) -> DataFrame:
    """conv_id, part and the sorted messages of each part, of which none has more than ``part_turns``.

    A part of more messages is cut by their ranks, and the parts behind it in
    its conversation move up. Ranks take two steps, so no task sees a whole
    conversation: how many messages each range holds, and places inside it.
    Equal messages are one row with their number.
    """
    own = ["conv_id", "part"]
    sizes = rows.groupBy(*own).agg(F.count("*").alias("n"))
    crowded = cut(sizes.filter(F.col("n") > part_turns))
    if crowded.isEmpty():
        return rows.groupBy(*own).agg(F.array_sort(F.collect_list("message")).alias("messages"))

    def here(*more: str):
        same = F.col("conv_id").eqNullSafe(F.col("_conv"))
        for name in ("part", *more):
            same = same & (F.col(name) == F.col(f"_{name}"))
        return same

    def named(df: DataFrame, *more: str) -> DataFrame:
        return df.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), *(F.col(c).alias(f"_{c}") for c in more))

    whole = rows.join(named(crowded), here(), "left_anti").select(*own, F.lit(0).cast("long").alias("piece"), "message", F.lit(1).cast("long").alias("copies"))
    different = rows.join(named(crowded), here(), "left_semi").groupBy(*own, "message").agg(F.count("*").alias("copies"))
    ranged = cut(different.repartitionByRange(*own, "message").withColumn("at", F.spark_partition_id()))
    totals = ranged.groupBy(*own, "at").agg(F.sum("copies").alias("held"))
    starts = totals.withColumn("before", F.sum("held").over(Window.partitionBy(*own).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("copies").over(Window.partitionBy(*own, "at").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_inside"), F.lit(0))
    placed = ranged.withColumn("_inside", inside).join(named(starts, "at", "before"), here("at")).withColumn("first", first)
    ends = F.col("first") + F.col("copies")
    piece = F.explode(F.sequence(F.expr(f"first DIV {part_turns}"), F.expr(f"(first + copies - 1) DIV {part_turns}")))
    some = F.least(ends, (F.col("piece") + 1) * part_turns) - F.greatest("first", F.col("piece") * part_turns)
    pieces = placed.withColumn("piece", piece).select(*own, "piece", "message", some.alias("copies"))
    extra = F.when(F.col("n") > part_turns, F.expr(f"(n - 1) DIV {part_turns}")).otherwise(0)
    moved = sizes.withColumn("move", F.sum(extra).over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).filter("move > 0")
    held = whole.unionByName(pieces).groupBy(*own, "piece").agg(F.array_sort(F.collect_list(F.struct("message", F.col("copies").cast("int").alias("copies")))).alias("held"))
    return held.join(named(moved, "move"), here(), "left").select(
        "conv_id",
        (F.col("part") + F.col("piece") + F.coalesce("_move", F.lit(0))).alias("part"),
        F.flatten(F.transform("held", lambda m: F.array_repeat(m["message"], m["copies"]))).alias("messages"),
    )


def rotate_perspectives(turns: DataFrame, part_turns: int = 1000) -> DataFrame:
    """One row per conversation, participant and part with the dialogue as that participant's.

    Returns conv_id, speaker, part, n_turns, n_own, start, rendered, mask_starts
    and mask_ends (character offsets in ``rendered``, half open, one pair for
    each message of the speaker). A part holds the turns whose number divided
    by ``part_turns`` is equal. Where those are more than ``part_turns``
    messages (null or repeated numbers), they are cut into further parts, and
    the parts behind count on, so no conversation has to fit in one row.
    ``start`` says how many characters the parts before it hold. Turns go by
    number, null first, then by role and text, so ties and repeated rows have
    one order and repeated rows stay. A null role is the participant
    ``unknown``, a null or empty text an empty message, a null conv_id a
    conversation of its own. An empty table gives no rows; other columns are
    ignored.
    """
    name = F.coalesce(F.col("role"), F.lit(NOBODY))
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
        F.struct(F.col("turn"), name.alias("name"), F.coalesce(F.col("text"), F.lit("")).alias("said")).alias("message"),
    )
    parts = _parts(rows, part_turns)
    speakers = turns.select(F.col("conv_id").alias("_conv"), name.alias("speaker")).distinct()
    seen = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")
    pieces = F.transform(
        "messages",
        lambda m: F.struct(
            (m["name"] == F.col("speaker")).alias("own"),
            _header(m["name"] == F.col("speaker"), m["name"]).alias("header"),
            m["said"].alias("said"),
        ),
    )
    placed = F.aggregate(
        F.col("pieces"),
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.array().cast("array<bigint>").alias("starts"),
            F.array().cast("array<bigint>").alias("ends"),
        ),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["header"]) + F.length(p["said"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(p["own"], F.array_append(a["starts"], (a["at"] + F.length(p["header"])).cast("long"))).otherwise(a["starts"]).alias("starts"),
            F.when(p["own"], F.array_append(a["ends"], (a["at"] + F.length(p["header"]) + F.length(p["said"])).cast("long"))).otherwise(a["ends"]).alias("ends"),
        ),
    )
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        seen.withColumn("pieces", pieces)
        .withColumn("placed", placed)
        .select(
            "conv_id",
            "speaker",
            "part",
            F.size("messages").cast("long").alias("n_turns"),
            F.size("placed.starts").cast("long").alias("n_own"),
            F.coalesce(F.sum("placed.at").over(before), F.lit(0)).cast("long").alias("start"),
            F.array_join(F.transform("pieces", lambda p: F.concat(p["header"], p["said"], F.lit(CLOSE))), "").alias("rendered"),
            F.col("placed.starts").alias("mask_starts"),
            F.col("placed.ends").alias("mask_ends"),
        )
    )


