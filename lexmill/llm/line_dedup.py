"""Line dedup on DataFrame functions only: long lines that recur across documents stay in one document.

A line's key is the line without surrounding ASCII white space, A-Z lower-cased. Keys of at least ``min_chars``
code points found in at least ``min_docs`` documents lose all their lines except in the largest doc_id holding them.

Method: the hashes of all long lines are range-partitioned on (hash, doc_id, salt) and sorted within partitions by
(hash, doc_id, salt, position), so a key held by a third of all documents spreads over many tasks, and so does a doc_id
held by a third of all rows (the salt is the task that read a row). Each partition streams its order once and lets the
first line of each (hash, doc_id, salt) pass; what passes is counted by document and by key with map-side combining.
What comes back is not text but a compressed bitmap a document: the number of kept lines before each dropped one.
Only texts that lose lines meet their bitmaps: a broadcast bit array of at most ``FILTER_BITS`` bits tells which texts
may; it errs towards the join, so with a full bit array every text is joined and the result is the same.

Keys are matched by 96 bits of hashes and not compared as text: among 10^12 different lines any two meet with a
probability of 6e-6.

Defined cases: null or empty text is one empty line; a null doc_id counts as one document that ranks below all others;
repeated rows of one doc_id count as one document and are treated alike; rows of one doc_id with different texts count
as one document, each with its own bitmap; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.store import Scratch

#: Into how many parts rows of one doc_id are dealt at most; bits of the array that tells which texts lose lines (64 MB).
SALTS, FILTER_BITS = 1024, 1 << 29
#: Fixed value: bits of a row that bitmap_construct_agg makes.
PER_BUCKET = 1 << 15
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def first_lines(hashed: DataFrame, n: int) -> DataFrame:
    """The first line of each document and salt under a key, in order: a stream over sorted ranges.

    The window's own needs are met by the ranges and their order, so it adds no shuffle and no sort, and the sort stays.
    """
    ranged = hashed.repartitionByRange(n, "h", "c", "doc_id", "salt").sortWithinPartitions("h", "c", "doc_id", "salt", "pos")
    at = F.row_number().over(W.partitionBy("h", "c", "doc_id", "salt").orderBy("pos"))
    return ranged.withColumn("nth", at).where(F.col("nth") == 1).drop("nth")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, partitions: int | None = None) -> DataFrame:
    """One row for each document that loses lines: doc_id, text_hash (of its whole text) and keep_gaps, its bitmap.

    keep_gaps[i] is how many lines are kept between the dropped lines i - 1 and i.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = rows.where(F.octet_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    salt = (F.spark_partition_id() % SALTS).cast("short").alias("salt")
    hashed = scratch.cut(keyed.select(F.xxhash64("key").alias("h"), F.crc32(F.col("key").cast("binary")).alias("c"), "doc_id", "text_hash", "pos", salt), "hashed")
    first = first_lines(hashed.select("h", "c", "doc_id", "salt", "pos"), n)
    spread = first.groupBy("h", "c", "doc_id").agg(F.lit(1).alias("one")).groupBy("h", "c").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keep_doc")).where(F.col("n_docs") >= min_docs)
    # written, so that both sides of the join are plain shuffles and a line that many documents share can be split
    spread = scratch.cut(spread.select("h", "c", "keep_doc"), "spread")
    lost = hashed.join(spread, ["h", "c"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    dropped = lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    gap = lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("p"), i - 1)) - 1
    return dropped.select("doc_id", "text_hash", F.transform("p", gap).alias("keep_gaps"))


def keep_flags(keep_gaps: Column, n_lines: Column) -> Column:
    """The bitmap unpacked: a boolean for each line."""
    runs = F.flatten(F.transform(keep_gaps, lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False)))))
    return F.concat(runs, F.array_repeat(F.lit(True), n_lines - F.size(runs)))


def _place(bits: int) -> tuple[Column, Column]:
    """Bucket and position of a row (doc_id, text_hash__) in the bit array."""
    at = F.pmod(F.xxhash64(F.lit("lines"), "doc_id", "text_hash__"), F.lit(bits))
    return F.shiftright(at, 15).cast("int"), (at % PER_BUCKET).cast("int")


def _affected(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``rows`` with may__: false for those that no bitmap is for, true for the others and a few more."""
    bucket, position = _place(bits)
    seen = bitmaps.withColumnRenamed("text_hash", "text_hash__").select(bucket.alias("bucket__"), position.alias("p"))
    seen = seen.groupBy("bucket__").agg(F.bitmap_construct_agg("p").alias("bits__"))
    byte = F.conv(F.hex(F.expr("substring(bits__, shiftright(position__, 3) + 1, 1)")), 16, 10).cast("int")
    # of fixed size: a row of 4 KB for each 32,768 of ``bits``
    out = rows.withColumns({"bucket__": bucket, "position__": position}).join(F.broadcast(seen), "bucket__", "left")
    may = F.getbit(byte.cast("long"), (F.col("position__") % 8).cast("int")) == 1
    return out.withColumn("may__", F.coalesce(may, F.lit(False))).drop("bucket__", "position__", "bits__")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with n_lines (before), n_dropped and kept_text; its own columns of those names give way.

    ``bitmaps`` is read twice: best a written table.
    """
    rows = docs.drop("n_lines", "n_dropped", "kept_text", "keep_gaps").withColumn("text_hash__", F.xxhash64("text"))
    bits = max(PER_BUCKET, min(most_bits, 1 << (16 * max(1, bitmaps.count())).bit_length()))
    marked = _affected(rows, bitmaps, bits)
    lines = lines_of(F.col("text"))
    n_lines = F.size(lines).cast("long").alias("n_lines")
    whole = marked.where(~F.col("may__")).select(*rows.columns, n_lines, F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text"))
    right = bitmaps.select(F.col("doc_id").alias("doc_id__"), F.col("text_hash").alias("hash__"), "keep_gaps")
    both = marked.where("may__").join(right, F.col("doc_id").eqNullSafe(F.col("doc_id__")) & (F.col("text_hash__") == F.col("hash__")), "left").withColumn("lines__", lines)
    both = both.withColumn("flags__", F.when(F.col("keep_gaps").isNotNull(), keep_flags(F.col("keep_gaps"), F.size("lines__"))))
    kept = F.when(F.col("keep_gaps").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter("lines__", lambda _, i: F.get(F.col("flags__"), i)), "\n"))
    cut = both.select(*rows.columns, F.size("lines__").cast("long").alias("n_lines"), F.coalesce(F.size("keep_gaps"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return whole.unionByName(cut).drop("text_hash__")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, partitions: int | None = None) -> DataFrame:
    bitmaps = Scratch(docs.sparkSession, "bitmaps").cut(keep_bitmaps(docs, min_chars, min_docs, partitions), "bitmaps")
    return apply_bitmaps(docs, bitmaps)
