"""Byte-level BPE encoding and decoding over a pair occurrence index.

A worker gathers the distinct pre-tokens of a slab of texts, lays their bytes out as one array of symbols with links to
the neighbours, and maps each adjacent pair that has a merge rank to all its positions in the slab. Active ranks are
applied in ascending order, each to all its positions at once; the pairs that a merge makes are added to the lists of
their own ranks. Pre-tokens never interact, so this is every pre-token's own merge order. Encoded pre-tokens are kept
for the worker's next slabs up to a bound on their number.

The vocabulary file is read on the driver, its tables (a fixed 50 thousand merges, a few MB) are broadcast.

Defined cases: null text is empty and has no ids; rows are independent, so ties and repeated rows need no rule; an empty
table gives an empty result; very long texts are pre-tokenised piecewise; the added token's string in a text is its one
id. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


#: Fixed value: the pattern by which byte-level BPE splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text whose pre-tokens are encoded together; pre-tokens kept for later slabs; tokens expanded at once.
SLAB, KEPT, PART = 16 << 20, 600_000, 1 << 19


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


class Tables:
    """A vocabulary's merges and token bytes as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = self.left.astype(np.int64) << 32 | self.right
        self.by_key = np.argsort(key, kind="stable")
        self.keys = key[self.by_key]
        number = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            raw[i] = bytes(number[c] for c in token) if all(c in number for c in token) else token.encode()
        self.token_len = np.array([len(x) for x in raw], np.int64)
        self.token_off = np.cumsum(self.token_len) - self.token_len
        self.token_raw = np.frombuffer(b"".join(raw), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)


def _disjoint(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of ascending positions of a pair of equal symbols, those that leave no overlap, leftmost first."""
    taken, keep = set(), []
    for p, q in zip(pos.tolist(), nxt[pos].tolist()):
        if p not in taken:
            taken.add(q)
            keep.append(p)
    return np.array(keep, np.int64)


def merge_all(words: list[bytes], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each has."""
    lens = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lens)
    sym = t.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[ends[lens > 0] - 1] = -1
    prv[(ends - lens)[lens > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(pos: np.ndarray) -> None:
        rank = t.ranks(sym[pos], sym[nxt[pos]])
        pos, rank = pos[rank >= 0], rank[rank >= 0]
        if not len(pos):
            return
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, a, b in zip(rank[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
            if r in index:
                index[r].append(pos[a:b])
            else:
                index[r] = [pos[a:b]]
                heapq.heappush(active, r)

    enter(np.flatnonzero(nxt >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right = t.left[r], t.right[r]
        after = nxt[pos]
        pos = pos[(sym[pos] == left) & (after >= 0) & (sym[after] == right)]
        if left == right and len(pos):
            pos = _disjoint(np.unique(pos), nxt)
        if not len(pos):
            continue
        gone = nxt[pos]
        over = nxt[gone]
        sym[pos], sym[gone], nxt[pos], nxt[gone] = t.made[r], -1, over, -1
        has = over >= 0
        prv[over[has]] = pos[has]
        ahead = prv[pos]
        enter(np.unique(np.concatenate([ahead[ahead >= 0], pos[has]])))
    alive = sym >= 0
    counts = np.add.reduceat(np.append(alive, False).astype(np.int64), np.minimum(ends - lens, n)) if n else np.zeros(len(words), np.int64)
    return sym[alive], np.where(lens > 0, counts, 0)


def gather(values: np.ndarray, offs: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values`` one after another."""
    n = lens[which]
    ends = np.cumsum(n)
    return values[np.repeat(offs[which] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Numbered(dict):
    """Numbers new keys in order of arrival."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """A worker's encoder. Encoded pre-tokens stay as Arrow arrays, a few bytes each, up to KEPT of the most used.

    The added tokens are the first entries and always stay: merging their bytes would not give their ids.
    """

    def __init__(self, tables: Tables):
        self.t, self.rx = tables, regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.known = pa.array(list(tables.special), pa.large_string())
        self.ids = np.array(list(tables.special.values()), np.int32)
        self.lens = np.ones(len(self.ids), np.int64)
        self.uses = np.zeros(len(self.ids), np.int64)
        self.slab = _Numbered()

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's pre-tokens within the slab."""
        if self.cut is not None and any(x in text for x in self.t.special):
            parts = [np.array([self.slab[p]], np.int32) if p in self.t.special else self.numbers(p) for p in self.cut.split(text) if p]
            return np.concatenate(parts) if parts else np.zeros(0, np.int32)
        number = self.slab.__getitem__
        if len(text) <= 1 << 22:
            return np.array(list(map(number, self.rx.findall(text))), np.int32)
        found, parts = (m.group() for m in self.rx.finditer(text)), []
        while some := list(itertools.islice(found, 1 << 18)):
            parts.append(np.array(list(map(number, some)), np.int32))
        return np.concatenate(parts)

    def _settle(self) -> np.ndarray:
        """The entries of the slab's pre-tokens; those that are new get encoded first."""
        names = pa.array(list(self.slab), pa.large_string())
        self.slab = _Numbered()
        at = pc.index_in(names, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        at[new] = len(self.known) + np.arange(int(new.sum()))
        if new.any():
            fresh = names.filter(pa.array(new))
            ids, lens = merge_all([w.encode() for w in fresh.to_pylist()], self.t)
            self.known = pa.concat_arrays([self.known, fresh])
            self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        return at

    def encode(self, docs: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, ids, each document's number of ids) of runs of the slab's documents; the slab ends with it."""
        entry = self._settle()
        offs = np.cumsum(self.lens) - self.lens
        a = 0
        while a < len(docs):
            b, size = a, 0
            while b < len(docs) and (b == a or size + len(docs[b]) <= PART):
                size += len(docs[b])
                b += 1
            which = entry[np.concatenate(docs[a:b])]
            self.uses += np.bincount(which, minlength=len(self.uses))
            per = np.cumsum(np.append(0, self.lens[which]))
            at = np.cumsum([0, *map(len, docs[a:b])])
            yield a, gather(self.ids, offs, self.lens, which), np.diff(per[at])
            a = b
        if len(self.lens) > KEPT:
            least = 2
            while (self.uses >= least).sum() > KEPT // 2:
                least *= 2
            keep = np.flatnonzero((self.uses >= least) | (np.arange(len(self.uses)) < len(self.t.special)))
            self.ids, self.known = gather(self.ids, offs, self.lens, keep), self.known.take(pa.array(keep))
            self.lens, self.uses = self.lens[keep], self.uses[keep] // 2


#: A worker's encoders by vocabulary, with the pre-tokens that they keep.
_ENCODERS: dict[str, Encoder] = {}


def _encode(shared, name: str, decode: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(shared.value)
        encoder = _ENCODERS[name]
        ids, docs, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = pa.concat_arrays(ids)
            for first, out, lens in encoder.encode(docs):
                ends = np.append(0, np.cumsum(lens)) * 4
                raw = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out, "<u4"))])
                columns = [keys.slice(first, len(lens)), pa.array(lens), raw.cast(pa.binary())]
                if decode:
                    columns.append(pa.array([decoded(encoder.t, out[a // 4 : b // 4]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                s = text.as_py() or ""
                docs.append(encoder.numbers(s))
                ids.append(batch.column(0).slice(i, 1))
                size += len(s)
                if size >= SLAB:
                    yield from flush()
                    ids, docs, size = [], [], 0
        if docs:
            yield from flush()

    return run


def decoded(t: Tables, ids: np.ndarray) -> str:
    """The text of ids; bytes that are not UTF-8 become replacement characters."""
    return b"".join(gather(t.token_raw, t.token_off, t.token_len, ids[k : k + PART]).tobytes() for k in range(0, len(ids), PART)).decode("utf-8", "replace")


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(shared.value, np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Tables(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(shared, vocabulary), f"doc_id {kind}, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded, the text of the ids, of each row: encoding and decoding in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Tables(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(shared, vocabulary, True), f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (with a column ids) with a column decoded: the text of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Tables(vocabulary))
    base = encoded.drop("decoded")
    return base.mapInArrow(_decode(shared), StructType([*base.schema.fields, StructField("decoded", StringType())]))
