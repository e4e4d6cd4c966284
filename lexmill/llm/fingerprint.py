"""Document fingerprints by Order MinHash: sketches sensitive to edit distance.

A text's k-mers of characters are numbered by occurrence (the second "abcde" differs from the first) and hashed. The
hash's leading bits deal them out over ``SLOTS`` slots; in each slot the ``PICK`` k-mers of smallest hash are selected,
put back into text order, and their tuple is hashed to one 16-bit value. A slot that got fewer than that takes those of
smallest hash, by a hash of its own, among all k-mers of the text, so a slot's value always tells an order. Moving or
editing part of a text changes which k-mers are selected or the order they stand in. The likeness of two fingerprints is
the share of equal values among slots that are filled in either. Order MinHash as published hashes every k-mer once a
slot; here that is done for the slots that need it, few but in short texts, which keeps the cost linear in the text.

``compare_neighbours`` also holds the rule of the edited text: each document's last half gives way to the head of the
next document in ascending doc_id, the last document's to the first's. Rows are dealt over ranges of (doc_id, text hash),
so one doc_id may fill many ranges; rows alike in both are one row with a count of copies. The first row of each range
travels to the one before it as well, so no more than a row a range moves twice.

Defined cases: a null or empty text has no k-mers and the fingerprint of empty texts; a text shorter than k is one
k-mer; two empty fingerprints are alike by 1, an empty and a filled one by 0; rows with null doc_id come first, rows of
one doc_id follow each other in the order of their texts' hashes, equal rows directly, each the next of the one before;
a single document is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.store import Scratch
from lexmill.llm.textbytes import STEP, mix

K, SLOTS, PICK = 5, 128, 2
SHIFT = np.uint64(64 - 7)
OWN = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * STEP)
#: Copies that one row of the stream stands for at most.
TIMES = 1 << 16
EMPTY = 0


def fingerprint(text: str) -> np.ndarray:
    """SLOTS values of 16 bits; 0 marks an empty slot."""
    out = np.zeros(SLOTS, np.uint16)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return out
    k = min(K, len(codes))
    n = len(codes) - k + 1
    mers = np.full(n, np.uint64(k))
    for i in range(k):
        mers = mers * STEP + codes[i : i + n]
    mers = mix(mers)
    bits = np.uint64(max(20, n.bit_length()))
    place = np.arange(n, dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    # hash and position in one integer: sorting it sorts by both
    ranked = np.sort(mers & ~low | place)
    order, head = (ranked & low).astype(np.int64), ranked >> bits
    fresh = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
    nth = np.empty(n, np.uint64)
    nth[order] = place - np.repeat(fresh, np.diff(np.append(fresh, n))).astype(np.uint64)
    keys = mix(mers + nth * STEP)
    by = (np.sort(keys & ~low | place) & low).astype(np.int64)
    slot = (keys[by] >> SHIFT).astype(np.int64)
    starts = np.searchsorted(slot, np.arange(SLOTS))
    counts = np.append(starts[1:], len(slot)) - starts
    first = by[np.minimum(starts, len(by) - 1)]
    second = by[np.minimum(starts + 1, len(by) - 1)]
    if n < PICK:
        return np.full(SLOTS, max(1, int(mix(keys)[0] >> np.uint64(48))), np.uint16)
    few = np.flatnonzero(counts < PICK)
    if len(few):
        first[few], second[few] = np.argpartition(mix(keys ^ OWN[few, None]), 1, axis=1)[:, :PICK].T
    a, b = np.minimum(first, second), np.maximum(first, second)
    return np.maximum(mix(mix(keys[a]) + keys[b] * STEP) >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the head of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its successor in the stream. The last row of a part is a loan from the next part: it only follows."""
    before = None
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int32())])

    def one(now: tuple, after: str, nxt: np.ndarray, times: int = 1) -> dict:
        doc_id, text, own, *_ = now
        changed = edited(text, after)
        other = fingerprint(changed)
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": own.tobytes().hex(), "edited_fingerprint": other.tobytes().hex(),
            "near_edited": likeness(own, other), "near_next": likeness(own, nxt), "times": times,
        }

    for batch in batches:
        rows, names = [], batch.schema.names
        ids, loans, copies = (batch.column(names.index(x)).to_pylist() for x in ("doc_id", "loan", "copies"))
        for doc_id, loan, n, x in zip(ids, loans, copies, batch.column(names.index("text"))):
            text = x.as_py() or ""
            now = (doc_id, text, fingerprint(text), loan)
            if before is not None:
                rows.append(one(before, text, now[2]))
            if n > 1 and not loan:  # all copies but the last are followed by a copy
                same = one(now, text, now[2])
                rows += [same | {"times": min(TIMES, n - 1 - k)} for k in range(0, n - 1, TIMES)]
            before = now
        yield pa.RecordBatch.from_pylist(rows, schema)
    if before is not None and not before[3]:
        raise ValueError("a part ends without the head of the next one")


def places(known: np.ndarray, ids: np.ndarray, ties: np.ndarray, heads: list[tuple]) -> np.ndarray:
    """The last of the ascending heads (doc_id, tie), null ids first, that is not above each row's key."""
    nulls = sum(x is None for x, _ in heads)
    head_ids, head_ties = np.array([x for x, _ in heads[nulls:]], np.int64), np.array([t for _, t in heads], np.int64)
    low = np.where(known, nulls + np.searchsorted(head_ids, ids, "left"), 0)
    high = np.where(known, nulls + np.searchsorted(head_ids, ids, "right"), nulls)
    out = low.copy()
    for at in np.unique(low[low < high]).tolist():  # ids that are heads' own
        mine = np.flatnonzero((low == at) & (low < high))
        out[mine] = at + np.searchsorted(head_ties[at : high[mine[0]]], ties[mine], "right")
    return out - 1


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neighbours")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    keys = scratch.cut(rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("copies")), "keys")
    # written, so that its size is known: where few rows repeat, the joins with it shuffle no text
    again = scratch.cut(keys.where(F.col("copies") > 1).select(F.col("doc_id").alias("id"), F.col("tie").alias("t"), "copies"), "again")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t"))
    once = rows.join(again, same, "left_anti").withColumn("copies", F.lit(1).cast("long"))
    # written, so that the join may split a row with very many copies and the choice of one combines before its shuffle
    many = scratch.cut(rows.join(again, same).select("doc_id", "text", "tie", "copies"), "many")
    every = once.unionByName(many.groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.first("copies").alias("copies")))
    # ranges from the keys alone, four a task so that tasks get even shares; their heads, a row a range, go to the driver
    head = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.col("tie").alias("t"))).alias("h")
    ranges = keys.select("doc_id", "tie").repartitionByRange(4 * n, F.col("doc_id").asc_nulls_first(), "tie")
    heads = [(r.h.id, r.h.t) for r in sorted(ranges.groupBy(F.spark_partition_id()).agg(head).select("h").collect(), key=lambda r: (r.h.known, r.h.id or 0, r.h.t))]

    @F.pandas_udf("int")
    def part_of(known: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(places(known.to_numpy(), ids.to_numpy(), ties.to_numpy(), heads), dtype="int32")

    ranged = every.withColumn("part", part_of(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "tie"))
    # a row a range: as many as the ranges asked for, which bounds the broadcast
    lent = spark.createDataFrame([(x, t, (i - 1) % len(heads)) for i, (x, t) in enumerate(heads)], "id long, t long, to int")
    loans = every.join(F.broadcast(lent), same).select(F.col("to").alias("part"), "doc_id", "text", "copies", F.lit(True).alias("loan"), "tie")
    both = ranged.select("part", "doc_id", "text", "copies", F.lit(False).alias("loan"), "tie").unionByName(loans)
    both = both.repartition(n, "part").sortWithinPartitions("part", "loan", F.col("doc_id").asc_nulls_first(), "tie")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times int"
    found = both.select("part", "doc_id", "text", "copies", "loan").mapInArrow(_by_part, out)
    return found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "nth")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of one task one after another, each a stream of its own."""
    ahead: list[pa.RecordBatch] = []

    def fill() -> bool:
        while not ahead:
            batch = next(batches, None)
            if batch is None:
                return False
            if batch.num_rows:
                ahead.append(batch)
        return True

    def stream(part: int) -> Iterator[pa.RecordBatch]:
        while fill():
            batch = ahead.pop()
            own = batch.column(0).to_numpy()
            upto = int(np.searchsorted(own, part, "right"))
            if upto < batch.num_rows:
                ahead.append(batch.slice(upto))
            if upto:
                yield batch.slice(0, upto)
            if ahead:
                return

    while fill():
        yield from _pairs(stream(ahead[0].column(0)[0].as_py()))
