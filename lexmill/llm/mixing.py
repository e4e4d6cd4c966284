"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / weight from a hash of its id; small keys come first. A source whose
target is e whole passes and a remainder takes every document e times (complete epochs) and then, in key order, as many
more words as the prefix sum of sizes allows; the document at the budget's edge is taken in part, so a source meets its
target to the word.

The order within a source is never gathered in one task. Keys fall into fixed buckets by value, sizes are summed by
(source, bucket) with map-side combining, and the prefix sum over buckets shows in which bucket the budget ends: buckets
before it are taken, those after it are not, and only that one bucket is sorted. There, rows alike in key, doc_id and
text are one entry of the order (summed with map-side combining), and in the one entry that the budget cuts, rows are
numbered by task, so neither a source nor a document that holds a third of all rows meets in one task.

The mix itself works on the rows where they are: a row's key tells whether it is taken, so only the rows of the edge
buckets are shuffled with their texts. Texts are measured once, as the rows are written, and may be of many MB: no array
of a text's words is made, and what is written holds few long texts in a row group.

Target shares: sources in ascending code point order, null last, get the weights in rotation; targets stop at
``max_epochs`` times the source's size and the excess goes to the others by weight, which is one water level found from
sorted ratios. The table of sources (a row each, a mixing configuration) is the only thing ordered as a whole.

Defined cases: null text has size 0; a document of size 0 is taken 0 words; a null source is a source of its own, and a
null doc_id draws a key like any other id; rows alike in doc_id and text tie, are interchangeable and are each taken on
their own; a null or NaN quality counts as 0, others are kept within 0 and 1; an empty table gives an empty result;
columns with clashing names give way to the operator's own in the plan and stay as they are in the mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm import textbytes as tb
from lexmill.llm.store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
#: ASCII marks that prose seldom holds; their share lowers a document's weight.
MARKS = "!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    """The number of words, counted as the letters of a text where each is one letter. No array of words is made."""
    return F.char_length(F.ltrim(F.regexp_replace(text, F.lit(f"{WORD}{BLANK}*"), F.lit("x")), F.lit(" \t\n\v\f\r"))).cast("long")


def cut_words(data: np.ndarray, n: int) -> np.ndarray:
    """The bytes of a text up to its word n + 1; all, if it has no more than n. Looks at CHUNK bytes at a time."""
    blank = True
    for a in range(0, len(data), tb.CHUNK):
        solid = ~tb.SPACE[data[a : a + tb.CHUNK]]
        starts = np.flatnonzero(solid & np.append(blank, ~solid[:-1]))
        if len(starts) > n:
            return data[: a + int(starts[n])]
        n, blank = n - len(starts), not solid[-1]
    return data


def _cut(texts: pa.Array, n: pa.Array) -> pa.Array:
    def one(i: int) -> str | None:
        if not texts[i].is_valid:
            return None
        return cut_words(np.frombuffer(texts[i].as_buffer(), np.uint8), n[i].as_py()).tobytes().decode()

    return pa.array([one(i) for i in range(len(texts))], pa.string())


def marks_weight(text: Column) -> Column:
    """A document's quality weight where nothing better is known: lower the more marks it holds."""
    marks = F.char_length(text) - F.char_length(F.translate(text, MARKS, ""))
    return 1.0 / (1.0 + 20.0 * marks / (F.char_length(text) + 1.0))


def measured(docs: DataFrame, seed: str = "mix", quality: str | None = None, buckets: int = 4096) -> dict[str, Column]:
    """text_hash, size in words, weight, Efraimidis-Spirakis key and its bucket, of a row of ``docs``.

    The weight is that of ``marks_weight``, or comes from the column ``quality`` (0 to 1).
    """
    text = F.coalesce("text", F.lit(""))
    known = None if quality is None else F.col(quality).cast("double")
    weight = marks_weight(text) if known is None else 0.01 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(known, F.lit(0.0)), F.lit(0.0))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double")
    key = -F.log((draw + 0.5) / float(1 << 52)) / weight
    return {"text_hash": F.xxhash64("text"), "size": words(text), "key": key, "bucket": F.floor(key / (1.0 + key) * buckets).cast("int")}


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) of each source to (source, source_size, target)."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.get(ring, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("cap", max_epochs * F.col("source_size"))
    by_ratio = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    s = s.withColumn("water", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w"))).alias("target"))


def _same(a: str, b: str, *columns: str) -> Column:
    """Whether the aliases' sources are equal or both null, and so are the other columns."""
    out = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for x in columns:
        out = out & F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}"))
    return out


def _budgets(base: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """A row a source: source_size, target, epochs, rest (words beyond them), and where in its buckets the rest ends.

    ``edge`` is the bucket that the end cuts, with the words ``before`` it; ``last_full`` the last bucket before it.
    """
    binned = scratch.cut(base.groupBy("source", "bucket").agg(F.sum("size").alias("bin_size")), "bins")
    want = targets(binned.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, max_epochs)
    want = want.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    want = scratch.cut(want.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")), "targets")
    by_bucket = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = binned.withColumn("end", F.sum("bin_size").over(by_bucket)).withColumn("before", F.col("end") - F.col("bin_size"))
    at = ends.alias("e").join(want.alias("t"), _same("e", "t"))
    cut = (F.col("before") < F.col("rest")) & (F.col("end") > F.col("rest"))
    at = at.groupBy("e.source").agg(F.max(F.when(cut, F.col("bucket"))).alias("edge"), F.max(F.when(cut, F.col("before"))).alias("before"), F.max(F.when(F.col("end") <= F.col("rest"), F.col("bucket"))).alias("last_full"))
    return scratch.cut(want.alias("t").join(at.alias("e"), _same("t", "e"), "left").select("t.*", "edge", "before", "last_full"), "budgets")


def _taken_off_edge(rows: DataFrame, want: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (source, size, bucket) outside of the edge buckets, with taken, and those inside, both with their budget."""
    budget = ["source_size", "target", "epochs", "rest", "before"]
    all_ = rows.alias("b").join(want.alias("t"), _same("b", "t")).select("b.*", *budget, F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False)).alias("at_edge"), "last_full")
    extra = F.when(F.col("bucket") <= F.col("last_full"), F.col("size")).otherwise(F.lit(0))
    whole = all_.where(~F.col("at_edge")).withColumn("taken", F.col("epochs") * F.col("size") + extra).drop("at_edge", "last_full")
    return whole, all_.where("at_edge").drop("at_edge", "last_full")


def _taken_at_edge(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The edge buckets' rows with taken: those that are taken in whole passes, and those of the entries that the budget cuts.

    Their texts may be among the columns; the rows are written once, with a number each.

    The order of entries is a window over one bucket's distinct documents; copies of one are counted, never gathered.
    """
    rows = scratch.cut(rows.withColumn("nr", F.monotonically_increasing_id()), "edge", texts=True)
    same = ["source", "key", "doc_id", "text_hash"]
    entries = rows.groupBy(*same, "size", "rest", "before").agg(F.count(F.lit(1)).alias("copies"))
    run = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "text_hash").rowsBetween(W.unboundedPreceding, -1)
    entries = entries.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(run), F.lit(0)))
    entries = scratch.cut(entries.select(*same, "left", (F.col("left") < F.col("size") * F.col("copies")).alias("short")), "entries")
    all_ = rows.alias("r").join(entries.alias("n"), _same("r", "n", "key", "doc_id", "text_hash")).select("r.*", "left", (F.col("short") & (F.col("left") > 0)).alias("cut"))
    own = lambda left: F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    plain = all_.where(~F.col("cut")).withColumn("taken", own(F.col("left")))
    # an entry that the budget cuts, one a source at most: its copies are numbered within the task that wrote them
    split = all_.where("cut").withColumn("task", F.shiftright("nr", 33))
    tasks = split.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("source", "task").orderBy("nr")) - 1
    split = split.withColumn("nth", nth).alias("r").join(tasks.alias("t"), _same("r", "t", "task")).select("r.*", "ahead")
    split = split.withColumn("taken", own(F.col("left") - (F.col("ahead") + F.col("nth")) * F.col("size")))
    return plain.drop("nr", "left", "cut"), split.drop("nr", "left", "cut", "task", "nth", "ahead")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, buckets: int = 4096, seed: str = "mix", quality: str | None = None) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, key, epochs and taken (words) of each row."""
    scratch = Scratch(docs.sparkSession, "mix")
    base = scratch.cut(docs.select("doc_id", "source", *[c.alias(n) for n, c in measured(docs, seed, quality, buckets).items()]), "base")
    whole, edge = _taken_off_edge(base, _budgets(base, scratch, weights, share, max_epochs))
    columns = ["doc_id", "text_hash", "source", "size", "source_size", "target", "key", "epochs", "taken"]
    plain, split = _taken_at_edge(edge, scratch)
    return whole.select(columns).unionByName(plain.select(columns)).unionByName(split.select(columns))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, buckets: int = 4096, seed: str = "mix", quality: str | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass over a document; a part-taken pass keeps its first words."""
    scratch = Scratch(docs.sparkSession, "mixed")
    own = F.struct(*docs.columns).alias("own")
    rows = scratch.cut(docs.select(own, "doc_id", "source", *[c.alias(n) for n, c in measured(docs, seed, quality, buckets).items()]), "measured", texts=True)
    want = _budgets(rows.select("source", "size", "bucket"), scratch, weights, share, max_epochs)
    whole, edge = _taken_off_edge(rows, want)
    plain, split = _taken_at_edge(edge, scratch)

    def passes(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("taken") > 0)
        return rows.select("own", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("pass"))

    # only one text a source is cut, outside the JVM's heap, as it may be long
    split = passes(split).withColumn("part", F.col("taken") - (F.col("pass") - 1) * F.col("size"))
    split = split.withColumn("head", F.arrow_udf(_cut, "string")(F.when(F.col("part") < F.col("size"), F.col("own.text")), "part"))
    new = {"text": F.coalesce("head", "own.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("head").isNotNull(), F.char_length("head").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own.n_chars"))
    cut = split.select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
    return passes(whole).select("own.*").unionByName(passes(plain).select("own.*")).unionByName(cut)
