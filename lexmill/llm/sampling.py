"""Bounded training samples by hash thresholds, and the split that keeps held-out rows from training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 30
MOST_VALUES = 1000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; false for a null id, which is not trained on either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trainable(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~held_out(doc_id)


def thin(rows: DataFrame, by: str | None, most: int, seed: int) -> DataFrame:
    """About ``most`` distinct rows of each value of column ``by`` (of all rows, if None): those of the smallest hashes.

    The hash is of doc_id and, if ``rows`` has one, text; rows alike in all columns count once. So the sample stays
    bounded if a doc_id is in very many rows. ``by`` may have MOST_VALUES values: their counts are gathered on the driver.
    """
    counts = rows.groupBy(by).count().limit(MOST_VALUES + 1).collect() if by else [(None, rows.count())]
    if len(counts) > MOST_VALUES:
        raise ValueError(f"{by} has over {MOST_VALUES} values")
    share = {value: min(SPAN, int(SPAN * most / max(1, n))) for value, n in counts}
    hashed = F.pmod(F.xxhash64("doc_id", *[c for c in rows.columns if c == "text"], F.lit(seed)), F.lit(SPAN))
    if by is None:
        return rows.where(hashed < share[None]).distinct()
    keep = F.lit(False)
    for value, limit in share.items():
        keep = keep | (F.col(by).eqNullSafe(F.lit(value)) & (hashed < limit))
    return rows.where(keep).distinct()
