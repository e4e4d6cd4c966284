"""MinHash near-dedup: banded candidates, odd sketches, exact confirmation, connected components.

A document's set holds its distinct five-word shingles. Two documents are linked if intersection / union reaches the
threshold, and each document's component is named by the smallest doc_id reachable over links.

1. One pass over the texts makes each document's digest of its set, 800 MinHash samples, of which 140 make 28 bands of
   5, and the odd sketch of all samples: a bitmap that holds each sample's bit by parity, so the population count of two sketches' XOR
   shows how many samples differ.
2. Documents with equal sets form a class (a grouped minimum, combined before the shuffle); the smallest doc_id stands
   for it from here on.
3. Within each band bucket every class is paired with the bucket's smallest doc_id only: a star, not all pairs. Pairs
   whose sketches cannot reach the threshold go; the others are confirmed on full sets, and components are found.
4. Buckets that still hold several components get the exact rest: classes outside the bucket's largest component are
   compared by sketch with all other classes of the bucket, in blocks of bounded size; what passes is confirmed on full
   sets as well. Pairs inside one component can't change it, so no pair that matters is left out.

With ideal samples, two documents at similarity 0.8 miss all 28 bands with probability 1.5e-5, and their sketches are
rejected at threshold 0.8 with 3.4e-7; at similarity and threshold 0.85 these are 7.4e-8 and 9.3e-9. Above the threshold the
sketches' part falls faster than the bands'. Together a link at 0.8 is missed with at most 1.5e-5, at 0.85 with 8.3e-8.

Defined cases: null, empty or blank text has an empty set and is linked with nothing; rows of one doc_id with several
texts link through their id; a row with null doc_id takes part in no link, has a null component and is kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import textbytes as tb
from lexmill.llm.components import connected
from lexmill.llm.store import Scratch

BANDS, ROWS = 28, 5
SAMPLES = 800
SKETCH_BITS = 2048
#: Sketches that estimate less than the threshold by more than this are rejected. It is so wide that at thresholds 0.8
#: and 0.85 a pair that reaches the threshold is rejected less often than it misses all bands.
MARGIN = 0.085
BLOCK = 256
_RNG = np.random.default_rng(77003)
FLIP = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
TURN = _RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SALT = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE = "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>"


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash samples of each nonempty set, a row each."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        h = (flat ^ FLIP[k]) * TURN[k]
        h ^= h >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(h, at)
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    each = (samples[:, : BANDS * ROWS].astype(np.uint64) + np.uint64(1)) * SALT[: BANDS * ROWS]
    return tb.mix(each.reshape(len(samples), BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * tb.STEP)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """A row of SKETCH_BITS / 64 integers for each row of samples: bit i is the parity of how many samples fall on it."""
    n, k = samples.shape
    bit = (tb.mix(samples.astype(np.uint64) + SALT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    counts = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def most_odd(threshold: float) -> int:
    """The largest XOR population count that sets of that similarity, less the margin, are expected to show."""
    k, j = SAMPLES, max(0.0, threshold - MARGIN)
    return int(np.ceil(SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** (2 * k * (1 - j))) / 2))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offs in tb.chunks(*tb.text_bytes(batch.column(1))):
                sets = tb.shingles(*tb.word_hashes(data, offs), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                n = b - a
                digests, bands, sketches = np.zeros((n, 2), np.int64), np.zeros((n, BANDS), np.int64), np.zeros((n, SKETCH_BITS // 64), np.int64)
                if full:
                    samples = minhash([sets[i] for i in full])
                    bands[full] = band_hashes(samples).view(np.int64)
                    sketches[full] = odd_sketches(samples)
                    digests[full] = [np.frombuffer(hashlib.blake2b(sets[i], digest_size=16).digest(), np.int64) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands.ravel())),
                        pa.ListArray.from_arrays(np.arange(0, (n + 1) * (SKETCH_BITS // 64), SKETCH_BITS // 64, dtype=np.int32), pa.array(sketches.ravel())),
                    ],
                    ["doc_id", "n_shingles", "c1", "c2", "bands", "sketch"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tb.chunks(*tb.text_bytes(batch.column(1))):
                sets = tb.shingles(*tb.word_hashes(data, offs), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "members"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for x, y in zip(left, right):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _near_in_blocks(limit: int, percent: int):
    """Pairs of one block: strays against members, of different components, whose sketches and sizes may reach the threshold.

    A pair that meets in several bands is told in the first of them only: it differs in component, so every bucket that
    it shares is mixed, and at least one of the two is a stray in each.
    """

    def run(table: pa.Table) -> pa.Table:
        stray = table.column("stray").to_numpy(zero_copy_only=False).astype(bool)
        ids, comps = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        sizes = table.column("n_shingles").to_numpy()
        bits = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        band = table.column("band")[0].as_py()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        s, m = np.flatnonzero(stray), np.flatnonzero(~stray)
        found_a, found_b = [], []
        for i in s:
            odd = np.bitwise_count(bits[m] ^ bits[i]).sum(axis=1)
            near = m[(odd <= limit) & (comps[m] != comps[i]) & (100 * np.minimum(sizes[m], sizes[i]) >= percent * np.maximum(sizes[m], sizes[i]))]
            near = near[(bands[near] == bands[i]).argmax(axis=1) == band]
            found_a.append(np.minimum(ids[near], ids[i]))
            found_b.append(np.maximum(ids[near], ids[i]))
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate(found_a or [empty]), "b": np.concatenate(found_b or [empty])})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b")), "b")
    both = one.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")


def _sketch_filter(pairs: DataFrame, reps: DataFrame, limit: int, percent: int) -> DataFrame:
    """The pairs whose sketches and set sizes allow the threshold."""
    side = reps.select("rep", "n_shingles", "sketch")
    a, b = side.alias("x"), side.alias("y")
    both = pairs.join(b, F.col("b") == F.col("y.rep")).join(a, F.col("a") == F.col("x.rep"))
    odd = F.aggregate(F.zip_with("x.sketch", "y.sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, c: n + c)
    small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    return both.where((odd <= limit) & (100 * small >= percent * large)).select("a", "b")


def near_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    limit = most_odd(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = scratch.cut(texts.mapInArrow(_signatures(width), SIGNATURE), "signatures")
    linked = marks.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.cut(linked.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = linked.join(classes, ["c1", "c2"]).where(F.col("doc_id") == F.col("rep")).dropDuplicates(["rep", "c1", "c2"])
    reps = scratch.cut(reps.select("rep", "c1", "c2", "n_shingles", "bands", "sketch"), "reps")

    exploded = reps.select(F.posexplode("bands").alias("band", "bucket"), "rep")
    shared = exploded.groupBy("band", "bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where(F.col("a") < F.col("top")).drop("top")
    # written, as are other grouped sides of joins below: plain shuffles on both sides let a large bucket be split
    shared = scratch.cut(shared, "shared")
    in_shared = scratch.cut(exploded.join(shared, ["band", "bucket"]).select("band", "bucket", "rep", "a"), "buckets")
    star = in_shared.where(F.col("rep") > F.col("a")).select("a", F.col("rep").alias("b")).distinct()
    star = scratch.cut(_sketch_filter(star, reps, limit, percent), "star")
    wanted = in_shared.select("rep").distinct()
    sets = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(_sets(width), "rep long, members binary")
    sets = scratch.cut(sets.where(F.octet_length("members") > 0), "sets")
    links = scratch.cut(_confirmed(star, sets, percent), "star_links")
    comps = connected(links, scratch, "first")

    named = in_shared.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("band", "bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    named = scratch.cut(named, "named")
    sizes = named.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n_comps"), F.sum("n").alias("n_all"), F.max(F.struct("n", "comp")).alias("top")).where(F.col("n_comps") > 1)
    mixed = mixed.select("band", "bucket", F.col("top.comp").alias("top_comp"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n_all") - F.col("top.n")) / BLOCK).cast("int").alias("stray_blocks"))
    mixed = scratch.cut(mixed, "mixed")
    rows = named.join(mixed, ["band", "bucket"]).join(reps.select("rep", "n_shingles", "sketch", "bands"), "rep").withColumn("at", F.xxhash64("rep", "bucket"))
    deal = lambda n: F.pmod(F.col("at"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("band", "bucket", "rep", "comp", "n_shingles", "sketch", "bands", F.lit(False).alias("stray"), deal("blocks").alias("i"), every("stray_blocks").alias("j"))
    strays = rows.where(F.col("comp") != F.col("top_comp")).select("band", "bucket", "rep", "comp", "n_shingles", "sketch", "bands", F.lit(True).alias("stray"), deal("stray_blocks").alias("j"), every("blocks").alias("i"))
    more = members.unionByName(strays).groupBy("band", "bucket", "i", "j").applyInArrow(_near_in_blocks(limit, percent), "a long, b long").distinct()
    more = scratch.cut(more, "rest")
    found = scratch.cut(_confirmed(more, sets, percent), "rest_links")
    several = linked.groupBy("doc_id").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).where(F.col("low") < F.col("high")).select("doc_id")
    bound = linked.join(several, "doc_id").join(classes, ["c1", "c2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where(F.col("a") != F.col("b"))
    # the first components' stars stand for the links that made them
    stars = comps.select(F.col("comp").alias("a"), F.col("id").alias("b")).where(F.col("a") < F.col("b"))
    comps = connected(stars.unionByName(found).unionByName(bound), scratch, "last")
    of_class = scratch.cut(classes.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("c1", "c2", F.coalesce("comp", "rep").alias("comp")), "class_components")
    scratch.drop("classes", "reps", "shared", "buckets", "star", "sets", "star_links", "named", "mixed", "rest", "rest_links")
    out = marks.join(of_class, ["c1", "c2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("comp")).alias("comp"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
