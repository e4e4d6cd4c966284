"""Token ids in shard files with keyed access: raw id payloads and a minimal perfect hash index over document keys.

File format: a folder with three Parquet tables, so writing and reading go through Spark's committer and any file system
that Spark reads. ``shards`` has a row a shard: its place (part, shard), the first id's offset within the part, the raw
little-endian ids (16 bits where the vocabulary allows, else 32), the document keys in order, and the index. ``parts``
is the manifest: the ids before each part. ``routes`` has a row a shard too: its first and last doc_id, and the file that
holds it. Parts are ranges of (doc_id, text hash), shards follow each other within a part, and either may begin inside
the rows of one doc_id, so a doc_id that very many rows share is split like any others.

Index: keys are placed level by level in bit arrays of twice their number, keys that collide go on to the next level,
and a key's slot is the rank of its bit, so n keys have the slots 0 to n - 1. The ranks at every 512th bit are stored, so
a rank takes one of them and the bits of one block. A slot holds a 32-bit fingerprint of its key, which exposes foreign
keys, and the document's offset and length in the payload. A lookup reads a constant expected number of bytes whatever
the shard's size, and ``read_keys`` opens only the shards whose range holds a key.

Defined cases: null text is empty and has the end id only; a null doc_id is a key and comes before all others; repeated
rows of one doc_id are keyed by (doc_id, occurrence within the shard), in the order of their texts' hashes; an empty table gives an empty
folder's tables; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.bpe import gather
from lexmill.llm.textbytes import STEP, mix, text_bytes

#: Bytes of text encoded together, pieces kept for later texts, pieces in one call.
SLAB, KEPT, JOINED = 32 << 20, 1_000_000, 512
SHARD_IDS, SHARD_DOCS = 1 << 21, 1 << 16
LEVELS = 48
#: Bytes of bits between two stored ranks.
BLOCK = 64
BLANKS = np.frombuffer(b"\t\n\r", np.uint8)
NULL_KEY = np.uint64(0x5EED0F0000000001)

SHARDS = "part int, shard int, start_in_part long, n_ids long, width int, payload binary, keys array<long>, levels binary, bits binary, ranks binary, prints binary, offsets binary, lengths binary"


def occurrence_keys(ids: list[int | None], nth: np.ndarray | int) -> np.ndarray:
    """64-bit keys of (doc_id, occurrence): one-to-one for first occurrences."""
    nth = np.broadcast_to(np.asarray(nth, np.uint64), len(ids))
    base = np.array([0 if x is None else x for x in ids], np.int64).view(np.uint64)
    key = mix(base + STEP) ^ np.where(nth > 0, mix(nth + np.uint64(7)), np.uint64(0))
    return np.where(np.array([x is None for x in ids], bool), mix(NULL_KEY + nth), key)


def key_hashes(ids: list[int | None]) -> np.ndarray:
    """The keys of a shard's documents, occurrences of one doc_id numbered from 0."""
    seen: dict[int | None, int] = {}
    nth = np.zeros(len(ids), np.uint64)
    for i, x in enumerate(ids):
        nth[i] = seen[x] = seen.get(x, -1) + 1
    return occurrence_keys(ids, nth)


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(int(STEP) * (2 * level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sizes of the levels, the packed bits and the ranks of their blocks of a minimal perfect hash of distinct keys."""
    sizes, bits, left = [], [], keys
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, 2 * len(left))
        at = _at(left, level, size)
        single = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(single)
        left = left[~single[at]]
    if len(left):
        raise ValueError("document keys are not distinct")
    every = np.concatenate(bits) if bits else np.zeros(0, bool)
    blocks = np.pad(every, (0, -len(every) % (8 * BLOCK))).reshape(-1, 8 * BLOCK)
    return np.array(sizes, np.int64), np.packbits(blocks), np.cumsum(np.append(0, blocks.sum(axis=1)))[:-1]


def _ranks(at: np.ndarray, packed: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many bits are set before each place: the block's rank and the bits of the block before the place."""
    block, byte = at // (8 * BLOCK), at // 8 % BLOCK
    own = packed.reshape(-1, BLOCK)[block]
    before = np.where(np.arange(BLOCK) < byte[:, None], own, 0)
    part = own[np.arange(len(at)), byte] >> (8 - at % 8).astype(np.uint8)
    return ranks[block] + np.bitwise_count(before).sum(axis=1, dtype=np.int64) + np.bitwise_count(np.where(at % 8 > 0, part, 0))


def slots(keys: np.ndarray, sizes: np.ndarray, packed: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has it."""
    out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    base = 0
    for level, size in enumerate(sizes.tolist()):
        at = base + _at(keys[open_], level, size)
        hit = packed[at // 8] >> (7 - at % 8).astype(np.uint8) & 1 == 1
        out[open_[hit]] = _ranks(at[hit], packed, ranks)
        open_ = open_[~hit]
        base += size
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ (STEP << np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


class PieceEncoder:
    """Encodes texts with a tokenizers file; a piece between ASCII blanks is encoded once and kept for later texts.

    It holds for vocabularies that drop white space, where no token or rule reaches over a blank.
    """

    def __init__(self, spec: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(spec), end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = self.tokenizer.model.end_of_word_suffix or "\0"
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.marks = {",": 1, ".": 2}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # entry 0 of ids, lens and uses is the end of a text, entry k + 1 is piece k of known
        self.known, self.ids, self.lens, self.uses = pa.array([], pa.large_string()), np.array([end_id], np.uint32), np.ones(1, np.int64), np.ones(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all texts' pieces one after another, each text's followed by 0, and how many each text has."""
        data, offs = text_bytes(texts)
        blank = np.where(np.isin(data, BLANKS), np.uint8(32), data)
        spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(blank)])
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        at[new] = len(self.known) + np.arange(int(new.sum()))
        self._settle(coded.dictionary.filter(pa.array(new)))
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        entries = np.insert(at[coded.indices.to_numpy()] + 1, ends, 0)
        return entries, np.diff(ends, prepend=0) + 1

    def _encoded(self, pieces: list[str], one: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of pieces, many of them joined to a text, and how many each has.

        ``one``: the pieces are letters only, so each is one word of the vocabulary's pattern and ends with a token that
        ends words; otherwise, or where the count shows that this fails, tokens are told apart by where they start.
        """
        ids, lens = [], []
        for k in range(0, len(pieces), JOINED * 64):
            groups = [pieces[i : i + JOINED] for i in range(k, min(len(pieces), k + JOINED * 64), JOINED)]
            encode = self.tokenizer.encode_batch_fast if one else self.tokenizer.encode_batch
            for group, got in zip(groups, encode([" ".join(g) for g in groups], add_special_tokens=False)):
                out = np.array(got.ids, np.uint32)
                ends = np.flatnonzero(self.closes[out]) if one else None
                if one and (len(ends) != len(group) or len(out) and ends[-1] != len(out) - 1):
                    more = self._encoded(group, False)
                    ids += more[0]
                    lens += more[1]
                    continue
                if not one:
                    starts = np.cumsum([0, *[len(p) + 1 for p in group]])
                    ends = np.searchsorted(np.fromiter((o[0] for o in got.offsets), np.int64), starts[1:]) - 1
                ids.append(out)
                lens.append(np.diff(ends, prepend=-1))
        return ids, lens

    def _settle(self, new: pa.Array) -> None:
        """Encode new pieces and add them to the known ones.

        The vocabulary lower-cases, so ASCII pieces are encoded in lower case, but for those that hold an added token's
        string in any case: added tokens are matched before. A comma or full stop after a letter is a word of its own, so
        it is split off. What is left is often known or shared by several new pieces.
        """
        if not len(new):
            return
        done = len(self.lens)
        bases: dict[str, int] = {}
        source, tail = np.empty(len(new), np.int64), np.zeros(len(new), np.int64)
        for i, p in enumerate(new.to_pylist()):
            q = p.lower()
            if not p.isascii() or any(x in q for x in self.added):
                q = p
            if len(q) > 1 and q[-1] in self.marks and q[-2].lower().isalpha():
                tail[i] = self.marks[q[-1]]
                q = q[:-1]
            source[i] = bases.setdefault(q, len(bases))
        names = list(bases)
        entry = pc.index_in(pa.array(names, pa.large_string()), value_set=self.known).fill_null(-1).to_numpy().astype(np.int64) + 1
        words = [i for i in np.flatnonzero(entry == 0).tolist() if names[i].isalpha()]
        others = [i for i in np.flatnonzero(entry == 0).tolist() if not names[i].isalpha()]
        w_ids, w_lens = self._encoded([names[i] for i in words], True)
        o_ids, o_lens = self._encoded([names[i] for i in others], False)
        entry[words + others] = done + np.arange(len(words) + len(others))
        marks = [np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, np.uint32) for m in self.marks]
        lens = np.concatenate([self.lens, *w_lens, *o_lens, [0], [len(m) for m in marks]]).astype(np.int64)
        ids = np.concatenate([self.ids, *w_ids, *o_ids, *marks]).astype(np.uint32)
        which = np.stack([entry[source], done + len(words) + len(others) + tail], axis=1)
        self.ids = np.concatenate([self.ids, gather(ids, np.cumsum(lens) - lens, lens, which.ravel())])
        self.lens = np.concatenate([self.lens, lens[which].sum(axis=1)])
        self.known = pa.concat_arrays([self.known, new])

    def used(self, which: np.ndarray) -> None:
        uses = np.bincount(which, minlength=len(self.lens))
        uses[: len(self.uses)] += self.uses
        self.uses = uses

    def thin(self) -> None:
        """Past the bound, forget the pieces least used."""
        if len(self.lens) <= KEPT:
            return
        least = 2
        while (self.uses >= least).sum() > KEPT // 2:
            least *= 2
        self.uses[0] = max(self.uses[0], least)
        keep = np.flatnonzero(self.uses >= least)
        offs = np.cumsum(self.lens) - self.lens
        self.ids, self.lens, self.uses = gather(self.ids, offs, self.lens, keep), self.lens[keep], self.uses[keep] // 2
        self.known = self.known.take(pa.array(keep[1:] - 1))


#: A worker's encoders by vocabulary and end id, with the pieces that they keep.
_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def _shard_row(part: int, shard: int, start: int, ids: np.ndarray, keys: list, lens: np.ndarray, width: int) -> dict:
    hashed = key_hashes(keys)
    sizes, bits, ranks = build_index(hashed)
    at = slots(hashed, sizes, bits, ranks)
    prints, offsets, lengths = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    prints[at], offsets[at], lengths[at] = fingerprints(hashed), np.cumsum(lens) - lens, lens
    return {
        "part": part, "shard": shard, "start_in_part": start, "n_ids": len(ids), "width": width, "payload": ids.astype(f"<u{width}").tobytes(), "keys": keys,
        "levels": sizes.astype("<i8").tobytes(), "bits": bits.tobytes(), "ranks": ranks.astype("<i8").tobytes(), "prints": prints.astype("<u4").tobytes(), "offsets": offsets.astype("<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes(),
    }


def _write(shared, name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name, end_id) not in _ENCODERS:
            _ENCODERS[name, end_id] = PieceEncoder(shared.value, end_id)
        enc, part = _ENCODERS[name, end_id], TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("keys", pa.list_(pa.int64())), *[(x, pa.binary()) for x in ("levels", "bits", "ranks", "prints", "offsets", "lengths")]])
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        shard = start = 0

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal shard, start
            keys = [k for b in held for k in b.column(0).to_pylist()]
            entries, pieces = enc.encode(pa.concat_arrays([b.column(1).fill_null("").cast(pa.large_string()) for b in held]))
            offs, at = np.cumsum(enc.lens) - enc.lens, np.append(0, np.cumsum(pieces))
            lens = np.add.reduceat(enc.lens[entries], at[:-1])
            a = 0
            while a < len(keys):
                b = a + 1
                size = int(lens[a])
                while b < len(keys) and b - a < SHARD_DOCS and size + lens[b] <= SHARD_IDS:
                    size += int(lens[b])
                    b += 1
                ids = gather(enc.ids, offs, enc.lens, entries[at[a] : at[b]])
                yield pa.RecordBatch.from_pylist([_shard_row(part, shard, start, ids, keys[a:b], lens[a:b], width)], schema)
                shard, start, a = shard + 1, start + len(ids), b
            enc.used(entries)
            enc.thin()

        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = batch.slice(k, 1000)
                if not rows.num_rows:
                    continue
                if size >= SLAB:
                    yield from flush(held)
                    held, size = [], 0
                held.append(rows)
                size += rows.column(1).nbytes
        if held:
            yield from flush(held)

    return run


def write_shards(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, parts: int | None = None) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id``, and write the folder ``path``."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart by the task that read them, so that ranges can split a doc_id that very many rows share
    order = [F.col("doc_id").asc_nulls_first(), "h", "task"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("task"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_write(shared, vocabulary, end_id), SHARDS).write.parquet(f"{path}/shards")
    written = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    sums = written.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums.select("part", "n_ids", F.coalesce(before, F.lit(0)).alias("start")).write.parquet(f"{path}/parts")
    keys = F.col("keys")
    routes = written.select("part", "shard", F.exists(keys, lambda x: x.isNull()).alias("has_null"), F.array_min(keys).alias("first_id"), F.array_max(keys).alias("last_id"), F.col("_metadata.file_path").alias("file"))
    routes.write.parquet(f"{path}/routes")


def lookup(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) in the payload of each hashed key; -1 where its fingerprint shows that the shard lacks it."""
    at = slots(keys, *(np.frombuffer(shard[x], kind) for x, kind in (("levels", "<i8"), ("bits", np.uint8), ("ranks", "<i8"))))
    prints, offsets, lengths = np.frombuffer(shard["prints"], "<u4"), np.frombuffer(shard["offsets"], "<i8"), np.frombuffer(shard["lengths"], "<i8")
    there = (at >= 0) & (prints[at] == fingerprints(keys)) if len(prints) else np.zeros(len(keys), bool)
    return np.where(there, offsets[at] if len(prints) else 0, -1), np.where(there, lengths[at] if len(prints) else 0, -1)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                offsets, lengths = lookup(shard, key_hashes(shard["keys"]))
                if (offsets < 0).any():
                    raise ValueError("a stored key is not found: the shard is damaged")
                ids = np.frombuffer(shard["payload"], f"<u{shard['width']}").astype("<u4")
                raw = [memoryview(ids[o : o + n]).cast("B") for o, n in zip(offsets.tolist(), lengths.tolist())]
                n = len(raw)
                columns = [pa.array(np.full(n, shard["part"], np.int32)), pa.array(shard["keys"], pa.int64()), pa.array(shard["start_in_part"] + offsets), pa.array(lengths), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in raw], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document of the folder, each found by its key."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    ids = ["ids"] if with_ids else []
    rows = shards.mapInArrow(_read(with_ids), "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    parts = spark.read.schema("part int, n_ids long, start long").parquet(f"{path}/parts")
    # the manifest has a row a part: as many as the partitions it was written with
    return rows.join(F.broadcast(parts.select("part", "start")), "part").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *ids)


def _find(asked: list[int | None]):
    """The occurrences of each asked id in each shard, through its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                payload, rows, left, nth = memoryview(shard["payload"]), [], list(asked), 0
                while left:
                    offsets, lengths = lookup(shard, occurrence_keys(left, nth))
                    for x, o, k in zip(left, offsets.tolist(), lengths.tolist()):
                        if o >= 0:
                            ids = np.frombuffer(payload[o * shard["width"] : (o + k) * shard["width"]], f"<u{shard['width']}").astype("<u4")
                            rows.append((shard["part"], x, shard["start_in_part"] + o, k, ids.tobytes()))
                    left, nth = [x for x, o in zip(left, offsets.tolist()) if o >= 0], nth + 1
                part, doc_id, at, n_tokens, raw = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(at, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(raw, pa.binary())], ["part", "doc_id", "at", "n_tokens", "ids"])

    return run


def read_keys(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, start, n_tokens and ids of every row of the given documents: a few, as they are part of the plan.

    Only the files are opened, and of them the shards read, whose ranges hold one of the ids. A row of another document
    with the same fingerprint is let through with a probability of 2^-32 an id and shard.
    """
    routes = spark.read.parquet(f"{path}/routes")
    near = F.lit(False)
    for x in doc_ids:
        near = near | (F.col("has_null") if x is None else F.lit(x).between(F.col("first_id"), F.col("last_id")))
    there = routes.where(near).select("file", "part", "shard").collect()
    shards = spark.read.schema(SHARDS).parquet(*sorted({r.file for r in there})) if there else spark.createDataFrame([], SHARDS)
    which = F.lit(False)
    for r in there:
        which = which | ((F.col("part") == r.part) & (F.col("shard") == r.shard))
    rows = shards.where(which).mapInArrow(_find(sorted(set(doc_ids), key=lambda x: (x is not None, x))), "part int, doc_id long, at long, n_tokens long, ids binary")
    parts = spark.read.schema("part int, n_ids long, start long").parquet(f"{path}/parts")
    return rows.join(F.broadcast(parts.select("part", "start")), "part").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids")
