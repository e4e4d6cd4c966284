"""The three-word-lookahead matcher: plain rules on one run of ordinary characters, and its Arrow form for DataFrames.

From a position, paths of up to three words are laid out; the path that covers most bytes wins, then the one of fewest
words, then of the least spread of word bytes (with total and count equal: the least sum of squares), then of the
largest sum of 100 ln(frequency + 1), then the first laid out. Its first word is taken and the next position follows.

Frequencies count as the rules define them: the shortest word at the path's start is credited with the frequency of
the longest one there and the others with 0; at the second place the others count 1; at the third place only the longest
word is laid out, credited with its frequency if it is alone.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from lexmill.config import SegmentConfig
from lexmill.functions.classes import piece_pattern
from lexmill.functions.text import BOM
from lexmill.operators import kernel

#: Rows of a dictionary that a worker may hold; larger ones need the relational form.
MOST_TERMS = 2_000_000


@dataclass
class Lexicon:
    """Term frequencies, with the lengths that terms of each two first characters have."""

    freq: dict[str, int]
    max_bytes: int = 36
    lengths: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        self.freq = {t: f for t, f in self.freq.items() if t and len(t.encode()) <= self.max_bytes}
        found: dict[str, set[int]] = {}
        for t in self.freq:
            if len(t) > 1:
                found.setdefault(t[:2], set()).add(len(t))
        self.lengths = {c: sorted(n) for c, n in found.items()}

    def hits(self, run: str, at: int) -> tuple[list[int], int]:
        """Ascending character lengths of the terms at a position, a single character always among them; the longest's frequency."""
        out, last = [1], self.freq.get(run[at], 1)
        left = len(run) - at
        for n in self.lengths.get(run[at : at + 2], ()):
            if n > left:
                break
            f = self.freq.get(run[at : at + n])
            if f is not None:
                last = f
                out.append(n)
        return out, last


def paths(run: str, base: int, hits: Callable[[int], tuple[list[int], int]], inclusive: bool = False) -> Iterator[list[tuple[int, int]]]:
    """Paths of (word length, score frequency) from ``base``, in the order in which they are laid out."""
    end = len(run) - (0 if inclusive else 1)
    first, f1 = hits(base)
    for i, w1 in enumerate(first):
        one = (w1, f1 if i == 0 else 0)
        q = base + w1
        if q >= end:
            yield [one]
            continue
        second, f2 = hits(q)
        for j, w2 in enumerate(second):
            two = (w2, f2 if j == 0 else 1)
            r = q + w2
            if r >= end:
                yield [one, two]
                continue
            third, f3 = hits(r)
            yield [one, two, (third[-1], f3 if len(third) == 1 else 1)]


def _score(freqs: tuple[int, ...], compat: bool) -> float:
    return round(sum(math.log((f & 0xFFFF if compat else f) + 1) for f in freqs), 9)


def best_word(run: str, base: int, offsets: list[int], hits, inclusive: bool = False, compat: bool = False) -> int:
    """The length of the word that the winning path from ``base`` starts with.

    It goes through ``paths`` in their order, without building them; scores are only worked out where all else ties.
    """
    first, f1 = hits(base)
    if len(first) == 1:
        return first[0]
    end, b0 = len(run) - (0 if inclusive else 1), offsets[base]
    best, best_freqs, best_score, word = (-1, 0, 0), (), None, 1

    def better(key: tuple[int, int, int], freqs: tuple[int, ...]) -> bool:
        nonlocal best, best_freqs, best_score
        if key < best:
            return False
        score = None
        if key == best:
            if best_score is None:
                best_score = _score(best_freqs, compat)
            score = _score(freqs, compat)
            if score <= best_score:
                return False
        best, best_freqs, best_score = key, freqs, score
        return True

    for i, w1 in enumerate(first):
        q, g1 = base + w1, f1 if i == 0 else 0
        b1 = offsets[q] - b0
        if q >= end:
            if better((b1, -1, -b1 * b1), (g1,)):
                word = w1
            continue
        second, f2 = hits(q)
        for j, w2 in enumerate(second):
            r, g2 = q + w2, f2 if j == 0 else 1
            b2 = offsets[r] - b0 - b1
            if r >= end:
                if b1 + b2 >= best[0] and better((b1 + b2, -2, -b1 * b1 - b2 * b2), (g1, g2)):
                    word = w1
                continue
            third, f3 = hits(r)
            b3 = offsets[r + third[-1]] - b0 - b1 - b2
            if b1 + b2 + b3 >= best[0] and better((b1 + b2 + b3, -3, -b1 * b1 - b2 * b2 - b3 * b3), (g1, g2, f3 if len(third) == 1 else 1)):
                word = w1
    return word


def segment_run(run: str, lexicon: Lexicon, inclusive: bool = False, compat: bool = False) -> list[int]:
    """Character lengths of the words of a run; they tile it."""
    memo: dict[int, tuple[list[int], int]] = {}

    def hits(at: int) -> tuple[list[int], int]:
        if at not in memo:
            memo[at] = lexicon.hits(run, at)
        return memo[at]

    if run.isascii():
        offsets = list(range(len(run) + 1))
    else:
        offsets = [0]
        for c in run:
            offsets.append(offsets[-1] + len(c.encode()))
    out, base = [], 0
    while base < len(run):
        word = best_word(run, base, offsets, hits, inclusive, compat)
        out.append(word)
        base += word
    return out


def omni_words(run: str, starts: list[int], lexicon: Lexicon, least: int, inclusive: bool = False) -> list[tuple[int, int]]:
    """(start, length) of the words laid out from the given positions whose score frequency reaches ``least``; distinct, ordered."""
    found = set()
    for base in starts:
        for path in paths(run, base, lambda at: lexicon.hits(run, at), inclusive):
            at = base
            for n, f in path:
                if f >= least:
                    found.add((at, n))
                at += n
    return sorted(found)


class _Pieces(dict):
    """Numbers pieces in order of arrival and cuts each once."""

    def __init__(self, segmenter: Segmenter):
        self.segmenter, self.vocabulary = segmenter, {}
        self.words, self.sizes, self.kinds = array("q"), array("q"), array("q")

    def learn(self, pieces: Iterable[str]) -> None:
        """Take in those of the pieces that are new, the runs among them cut together."""
        new = [p for p in dict.fromkeys(pieces) if p not in self]
        runs = [p for p in new if self.segmenter.kind(p) == RUN]
        cut = dict(zip(runs, self.segmenter.words_of(runs)))
        for p in new:
            self.add(p, cut.get(p))

    def __missing__(self, piece: str) -> int:
        return self.add(piece, self.segmenter.words(piece) if self.segmenter.kind(piece) == RUN else None)

    def add(self, piece: str, words: list[str] | None) -> int:
        self[piece] = n = len(self)
        kind = self.segmenter.kind(piece)
        found = [piece] if words is None else words
        self.words.extend(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found)
        self.sizes.append(len(found))
        self.kinds.append(kind)
        return n


#: Kinds of pieces; tokens of a run are words.
KINDS = ["newline", "separator", "number", "letter", "word"]
NEWLINE, SEPARATOR, NUMBER, LETTER, RUN = range(5)


@dataclass
class Tokens:
    """The tokens of some texts: how many each text has, and of each token its number in the vocabulary, bytes, kind and chunk."""

    counts: np.ndarray
    which: np.ndarray
    start: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    chunk: np.ndarray
    vocabulary: pa.Array


class Segmenter:
    """A worker's segmenter. Pieces repeat, so each is cut once and its tokens are kept, up to a bound."""

    KEPT = 200_000

    def __init__(self, lexicon: Lexicon | kernel.Packed, config: SegmentConfig):
        self.lexicon, self.config = lexicon, config
        self.matcher = kernel.Matcher(lexicon, config.lookahead_inclusive, config.compat) if isinstance(lexicon, kernel.Packed) else None
        self.pattern = re.compile(piece_pattern(config.classes, config.merge, config.separate, config.joint))
        c = config.classes
        self.classes = [(k, re.compile(f"[{body}]")) for k, body in ((SEPARATOR, c.w), (NUMBER, c.m), (LETTER, c.e)) if body]
        self.kind_of: dict[str, int] = {"\r": NEWLINE, "\n": NEWLINE}
        self.known = _Pieces(self)

    def kind(self, piece: str) -> int:
        got = self.kind_of.get(piece[0])
        if got is None:
            got = self.kind_of[piece[0]] = next((k for k, r in self.classes if r.match(piece)), RUN)
        return got

    def words_of(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        if self.matcher is None:
            return [self.words(r) for r in runs]
        parts = kernel.chunks(np.array([len(r) for r in runs], np.int64), kernel.CHARS)
        return [w for a, b in parts for w in kernel.words(self.matcher.cut(pa.array(runs[a:b], pa.string())))]

    def words(self, run: str) -> list[str]:
        if self.matcher is not None:
            return self.words_of([run])[0]
        out, at = [], 0
        for n in segment_run(run, self.lexicon, self.config.lookahead_inclusive, self.config.compat):
            out.append(run[at : at + n])
            at += n
        return out

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text.split("\0", 1)[0].removeprefix(BOM))

    def tokens(self, text: str) -> list[str]:
        return [t for p in self.pieces(text) for t in (self.words(p) if len(p) > 1 and self.kind(p) == RUN else [p])]

    def cut(self, texts: list[str]) -> Tokens:
        """The tokens of texts, by array operations over pieces that are cut once.

        A chunk is a run with the letters or digits, separators or line end that end it; the last token of one ends a
        stretch within which the matcher looks ahead. Bytes are counted with a leading byte order mark.
        """
        if len(self.known) > self.KEPT:
            self.known = _Pieces(self)
        found = [self.pieces(t) for t in texts]
        self.known.learn(chain.from_iterable(found))
        number = self.known.__getitem__
        each = [np.array(list(map(number, x)), np.int64) for x in found]
        del found
        per = np.array([len(x) for x in each], np.int64)
        piece = np.concatenate(each) if each else np.zeros(0, np.int64)
        flat, sizes, kinds = (np.array(x, np.int64) for x in (self.known.words, self.known.sizes, self.known.kinds))
        n = sizes[piece]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        which = flat[np.repeat((np.cumsum(sizes) - sizes)[piece] - ends + n, n) + np.arange(total)]
        vocabulary = pa.array(list(self.known.vocabulary), pa.string())
        size = pc.binary_length(vocabulary).to_numpy().astype(np.int64)[which] if total else np.zeros(0, np.int64)
        first = np.append(0, np.cumsum(per))[:-1]  # each text's first piece
        opens, kind = np.zeros(len(piece) + 1, np.int64), kinds[piece]
        before = kind[:-1]
        opens[1:-1] = (before != RUN) & ~((kind[1:] == SEPARATOR) & ((before == NUMBER) | (before == LETTER)))
        opens[first[per > 0]] = 0
        chunk = np.cumsum(opens[:-1]) if len(piece) else np.zeros(0, np.int64)
        text_of = np.repeat(np.arange(len(per)), per)
        chunk = chunk - chunk[np.minimum(first, len(piece) - 1)][text_of] if len(piece) else chunk
        counts = np.bincount(text_of, weights=n, minlength=len(per)).astype(np.int64)
        upto, marks = np.append(0, np.cumsum(size)), np.array([len(BOM.encode()) * t.startswith(BOM) for t in texts], np.int64)
        heads = np.append(0, np.cumsum(counts))[:-1]
        start = upto[:-1] - np.repeat(upto[heads] - marks, counts)
        return Tokens(counts, which, start, size, np.repeat(kind, n), np.repeat(chunk, n), vocabulary)


def _terms(dictionary: DataFrame, max_bytes: int) -> DataFrame:
    return dictionary.where(F.octet_length("term").between(1, max_bytes))


def too_large(dictionary: DataFrame, max_bytes: int = 36, most: int = MOST_TERMS) -> bool:
    """Whether a dictionary has more terms than a worker may hold."""
    return _terms(dictionary, max_bytes).select("term").distinct().limit(most + 1).count() > most


def collect_lexicon(dictionary: DataFrame, max_bytes: int = 36, most: int = MOST_TERMS) -> Lexicon:
    """A dictionary for the workers. Its size is checked first; a larger one takes the relational form."""
    rows = _terms(dictionary, max_bytes).groupBy("term").agg(F.max("freq").alias("freq")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dictionary has over {most} terms: use lexmill.operators.relational")
    return Lexicon({r.term: r.freq for r in rows}, max_bytes)


def pack_lexicon(dictionary: DataFrame, max_bytes: int = 36) -> kernel.Packed:
    """A dictionary for the workers in some 80 bytes a term: for large ones. Its size is checked first."""
    packed = kernel.collect(dictionary, max_bytes)
    if packed is None:
        raise ValueError(f"the dictionary has over {kernel.MOST} terms: use lexmill.operators.relational")
    return packed


DETAILS = [("start_byte", IntegerType(), pa.int32()), ("byte_len", IntegerType(), pa.int32()), ("kind", StringType(), pa.string()), ("chunk", IntegerType(), pa.int32())]
#: Texts that are cut together, and bytes of them (a longer text is cut alone).
STEP, STEP_BYTES = 500, 1 << 19


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return kernel.chunks(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), STEP_BYTES, STEP)


def _map_tokens(shared, config: SegmentConfig, at: int, details: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, kinds = Segmenter(shared.value, config), pa.array(KINDS)
        for batch in batches:
            for lo, hi in _steps(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                got = seg.cut([x.as_py() or "" for x in part.column(at)])
                source, heads = np.repeat(np.arange(part.num_rows), got.counts), np.cumsum(got.counts) - got.counts
                pos = (np.arange(len(source)) - heads[source]).astype(np.int32)
                columns = [c.take(pa.array(source)) for j, c in enumerate(part.columns) if j != at] + [pa.array(pos), got.vocabulary.take(pa.array(got.which))]
                if details:
                    columns += [pa.array(got.start.astype(np.int32)), pa.array(got.size.astype(np.int32)), kinds.take(pa.array(got.kind)), pa.array(got.chunk.astype(np.int32))]
                names = [n for j, n in enumerate(part.schema.names) if j != at] + ["pos", "surface"] + [n for n, _, _ in DETAILS] * details
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _map_counts(shared, config: SegmentConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(shared.value, config)
        for batch in batches:
            for lo, hi in _steps(batch.column(0)):
                got = seg.cut([x.as_py() or "" for x in batch.column(0).slice(lo, hi - lo)])
                code, n = np.unique(got.which * len(KINDS) + got.kind, return_counts=True)
                yield pa.RecordBatch.from_arrays([got.vocabulary.take(pa.array(code // len(KINDS))), pa.array(KINDS).take(pa.array(code % len(KINDS))), pa.array(n)], ["surface", "kind", "n"])

    return run


def count_tokens(rows: DataFrame, lexicon: Lexicon | kernel.Packed, config: SegmentConfig = SegmentConfig(), text: str = "text") -> DataFrame:
    """(surface, kind, n): how often each token occurs in all texts. Tokens are counted where they are cut, and the counts added up."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    part = rows.select(text).mapInArrow(_map_counts(shared, config), "surface string, kind string, n long")
    return part.groupBy("surface", "kind").agg(F.sum("n").alias("n"))


def segment(rows: DataFrame, lexicon: Lexicon | kernel.Packed, config: SegmentConfig = SegmentConfig(), text: str = "text", details: bool = False) -> DataFrame:
    """The other columns of ``rows`` with pos and surface of each token of its text. Works on streams as well.

    ``details`` adds start_byte, byte_len, kind and chunk. Null text has no tokens. Tokens tile the text; line ends and
    separators are tokens.
    """
    base = rows.drop("pos", "surface", *[n for n, _, _ in DETAILS] * details)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    more = [StructField(n, kind) for n, kind, _ in DETAILS] if details else []
    schema = StructType([*(f for f in base.schema.fields if f.name != text), StructField("pos", IntegerType()), StructField("surface", StringType()), *more])
    return base.mapInArrow(_map_tokens(shared, config, base.columns.index(text), details), schema)


def with_offsets(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens with start_byte, end_byte and byte_len: running sums within a document."""

    size = F.octet_length("surface")
    end = F.sum(size).over(W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return tokens.withColumn("byte_len", size).withColumn("end_byte", end.cast("int")).withColumn("start_byte", (F.col("end_byte") - F.col("byte_len")).cast("int"))
