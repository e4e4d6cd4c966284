"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue (a role other than ``system``) the whole dialogue is rendered once with that speaker
as the assistant, the others as named users and system turns as they are. A row is one turn in one perspective: its
rendered text, its place in the perspective's full rendering, and the mask, the span whose tokens are trained on (the
content and end mark of the assistant's own turns). The rows of a perspective in order of ``seq`` are its rendering, so
a dialogue of any length never has to fit one row or one task.

Offsets are running sums. Rows are range-partitioned by (dialogue, perspective, turn) and sorted, each partition sums
its own runs, and the sums of earlier partitions are added per (dialogue, perspective): a dialogue that holds a third of
all turns spreads over many tasks.

Defined cases: null text is an empty turn; a null role is a participant named ``unknown``; a null turn comes first, ties
of turn are ordered by role and text, repeated rows are turns of their own; a dialogue of system turns only has one
perspective, null, without masks; a null conv_id is a dialogue of its own; an empty table gives an empty result; template
marks inside a text or role are broken up and line ends in a role become blanks, so neither can forge turns (roles that
are then alike are one participant); other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.store import Scratch

START, END = "<|im_start|>", "<|im_end|>"


def perspectives(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, perspective, seq, turn, role_as, name, rendered, char_start, char_end, mask_start and mask_end."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    harmless = lambda c: F.replace(c, F.lit("<|im_"), F.lit("< |im_"))
    speaker = F.translate(harmless(F.coalesce("role", F.lit("unknown"))), "\r\n", "  ")
    base = turns.select("conv_id", "turn", speaker.alias("speaker"), harmless(F.coalesce("text", F.lit(""))).alias("body"))
    people = base.where(F.col("speaker") != "system").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    # written, so that the join's sides are plain shuffles and a dialogue with very many turns can be split
    people = scratch.cut(people, "people")
    rows = base.join(people, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role_as = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.when(F.col("role_as") == "user", F.col("speaker"))
    head = F.concat(F.lit(START), "role_as", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("role_as", role_as).withColumn("name", name).withColumn("head", head)
    rows = rows.withColumn("rendered", F.concat("head", "body", F.lit(END + "\n"))).withColumn("size", F.char_length("rendered").cast("long")).withColumn("lead", F.char_length("head").cast("long"))
    rows = rows.select("conv_id", "perspective", "turn", "speaker", "role_as", "name", "rendered", "size", "lead")
    keys = ["conv_id", "perspective", "turn", "speaker", "rendered"]
    rows = rows.repartitionByRange(n, *keys).withColumn("block", F.spark_partition_id())
    rows = scratch.cut(rows, "ranged")
    inside = W.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "rendered").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("block_rows"))
    earlier = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("block_rows").over(earlier), F.lit(0)).alias("rows_before"))
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("nth", F.count(F.lit(1)).over(inside))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("perspective").eqNullSafe(F.col("p")) & (F.col("block") == F.col("b")))
    rows = rows.withColumn("char_start", F.col("before") + F.col("at"))
    mine = F.col("role_as") == "assistant"
    return rows.select(
        "conv_id", "perspective", (F.col("rows_before") + F.col("nth")).alias("seq"), "turn", "role_as", "name", "rendered", "char_start", (F.col("char_start") + F.col("size")).alias("char_end"),
        F.when(mine, F.col("char_start") + F.col("lead")).alias("mask_start"), F.when(mine, F.col("char_start") + F.col("size") - 1).alias("mask_end"),
    )
