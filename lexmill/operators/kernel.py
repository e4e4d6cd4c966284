"""The matcher over many runs at once, by array operations, with a dictionary of plain arrays.

``collect`` packs a dictionary into a hash table over its terms' code points: some 80 bytes a term in each worker, of at
most ``MOST`` terms, which is checked. What depends on a run alone (paths, rules, the walk, sub-words) is worked out where
the run is: no path is ever a row, and nothing is shuffled. Larger dictionaries take the joins of ``relational``, which
these functions equal. Hashes only find candidates; terms are compared by their characters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that a worker may hold.
MOST = 4_000_000
#: Characters that are matched together, and paths that are laid out together: bounds of a worker's arrays.
CHARS, PATHS = 1 << 15, 1 << 18

BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ONE, TAG = np.uint64(1), np.uint64(0x7FFFFFFF)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text starts among them (one more: the end)."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(data(texts).decode().encode("utf-32-le"), np.uint32), np.append(0, np.cumsum(sizes))


def data(texts: pa.Array) -> bytes:
    """The bytes of all texts, one after another."""
    wide = texts.type == pa.large_string()
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0, 0]
    return b"" if offsets[0] == offsets[-1] else bytes(memoryview(texts.buffers()[2])[int(offsets[0]) : int(offsets[-1])])


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _tags(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(31))) * BASE) >> np.uint64(7) & TAG).astype(np.int64)


def _narrow(x: np.ndarray, to: type) -> np.ndarray:
    return x.astype(to) if int(x.max(initial=0)) <= np.iinfo(to).max else x


class Packed:
    """A dictionary as arrays: distinct terms of 1 to ``max_bytes`` bytes with their frequencies, and a hash table of them."""

    def __init__(self, terms: pa.Array, freq: np.ndarray, max_bytes: int = 36):
        self.max_bytes, self.freq = max_bytes, _narrow(freq.astype(np.int64), np.int32)
        self.chars, self.at = characters(terms)
        sizes = np.diff(self.at)
        self.chars, self.at = _narrow(self.chars, np.uint16), _narrow(self.at, np.int32)
        self.longest = int(sizes.max(initial=0))
        h = np.zeros(len(sizes), np.uint64)
        for k in range(self.longest):
            more = np.flatnonzero(sizes > k)
            h[more] = h[more] * BASE + self.chars[self.at[more] + k] + ONE
        self.bits = max(4, (3 * len(sizes) // 2).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int64)
        entry, slot, left = (_tags(h) << 32) | np.arange(len(sizes)), _slots(h, self.bits), np.arange(len(sizes))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            self.table[slot[free]] = entry[free]
            left = left[self.table[slot[left]] != entry[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        # of each first two characters the lengths of their terms, as bits
        two = np.flatnonzero(sizes > 1)
        head = self.chars[self.at[two]].astype(np.int64) << 21 | self.chars[self.at[two] + 1]
        order = np.argsort(head, kind="stable")
        self.heads, first = np.unique(head[order], return_index=True)
        bit = ONE << np.minimum(sizes[two][order], 63).astype(np.uint64)
        self.lengths = np.bitwise_or.reduceat(bit, first) if len(first) else np.zeros(0, np.uint64)

    def find(self, chars: np.ndarray, at: np.ndarray, n: int, h: np.ndarray) -> np.ndarray:
        """The number of the term that the n characters from each place are, -1 for none; h: their hashes."""
        out, rest = np.full(len(at), -1, np.int64), np.arange(len(at))
        slot, tag = _slots(h, self.bits), _tags(h)
        while len(rest):
            entry = self.table[slot]
            used = entry >= 0
            rest, slot, entry, tag = rest[used], slot[used], entry[used], tag[used]
            alike = np.flatnonzero(entry >> 32 == tag)
            term, where = entry[alike] & 0xFFFFFFFF, at[rest[alike]]
            same = self.at[term + 1] - self.at[term] == n
            alike, term, where = alike[same], term[same], where[same]
            for k in range(n):
                same = self.chars[self.at[term] + k] == chars[where + k]
                if not same.all():
                    alike, term, where = alike[same], term[same], where[same]
            out[rest[alike]] = term
            more = np.ones(len(rest), bool)
            more[alike] = False
            rest, slot, tag = rest[more], (slot[more] + 1) & ((1 << self.bits) - 1), tag[more]
        return out


def collect(dictionary: DataFrame, max_bytes: int = 36, most: int = MOST) -> Packed | None:
    """A dictionary for the workers; None if it has more than ``most`` terms, which only joins can meet. At most 62 bytes a term."""
    if max_bytes > 62:
        return None
    rows = dictionary.where(F.octet_length("term").between(1, max_bytes)).groupBy("term").agg(F.max("freq").cast("long").alias("freq"))
    got = rows.limit(most + 1).toArrow()
    if got.num_rows > most:
        return None
    return Packed(_one(got.column("term")), got.column("freq").to_numpy(), max_bytes)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """One array, of large offsets: a dictionary's terms may fill more than 2 GB."""
    out = column.cast(pa.large_string()).combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


class Matcher:
    """The rules over the runs of one worker."""

    def __init__(self, lexicon: Packed, inclusive: bool = False, compat: bool = False):
        self.lexicon, self.inclusive = lexicon, inclusive
        each, which = np.unique(lexicon.freq & 65535 if compat else lexicon.freq, return_inverse=True)
        self.freq = np.append(lexicon.freq, lexicon.freq.dtype.type(1))
        self.logs = np.append(np.array([math.log(f + 1.0) for f in each.tolist()], np.float64)[which], math.log(2.0))  # the last: of no term

    def cut(self, runs: pa.Array) -> Cut:
        return Cut(self, runs)


class Cut:
    """The hits of some runs. Places are numbers of characters in all runs, one run after another."""

    def __init__(self, matcher: Matcher, runs: pa.Array):
        lexicon = matcher.lexicon
        self.matcher, self.runs = matcher, runs
        self.chars, self.first = characters(runs)
        c, sizes = self.chars, np.diff(self.first)
        total = len(c)
        self.run = np.repeat(np.arange(len(sizes)), sizes)
        self.stop = self.first[1:][self.run]
        self.ahead = self.stop - (0 if matcher.inclusive else 1)
        self.upto = np.append(0, np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)))
        at = np.arange(total)
        left = self.stop - at
        masks = np.zeros(total, np.uint64)
        if len(lexicon.heads):
            two = at[left > 1]
            head = c[two].astype(np.int64) << 21 | c[two + 1]
            k = np.minimum(np.searchsorted(lexicon.heads, head), len(lexicon.heads) - 1)
            masks[two] = np.where(lexicon.heads[k] == head, lexicon.lengths[k], np.uint64(0))
        h, found, self.n = np.zeros(total, np.uint64), [], np.ones(total + 1, np.int64)
        for n in range(1, lexicon.longest + 1):
            h = h * BASE + c[at + (n - 1)] + ONE
            here = np.flatnonzero(masks[at] >> np.uint64(n) & ONE) if n > 1 else np.arange(total)
            term = lexicon.find(c, at[here], n, h[here])
            if n == 1:
                single = term
            else:
                place, term = at[here][term >= 0], term[term >= 0]
                found.append((n, place, term))
                self.n[place] += 1
            keep = (left[at] > n) & (masks[at] >> np.uint64(n + 1) > 0)
            at, h = at[keep], h[keep]
            if not len(at):
                break
        self.start = np.append(0, np.cumsum(self.n[:-1]))
        self.size, self.term = np.ones(self.start[-1] + 1, np.int64), np.full(self.start[-1] + 1, -1, np.int64)
        if total and lexicon.longest:
            self.term[self.start[:-1]] = single
        filled = self.start + 1
        for n, place, term in found:
            self.size[filled[place]], self.term[filled[place]] = n, term
            filled[place] += 1
        last = self.start + self.n - 1
        self.most, best = self.size[last], self.term[last]
        self.f = matcher.freq[best]
        self.log = matcher.logs[best]

    def paths(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        """Blocks of places with their paths, in the order in which they are laid out: see ``relational.paths``.

        ``begin`` has where each place's paths begin, ``owner`` the place's number in the block; no word: width 0.
        """
        if not len(at):
            return
        n1 = self.n[at]
        ends1 = np.cumsum(n1)
        p = np.repeat(at, n1)
        i = np.arange(len(p)) - np.repeat(ends1 - n1, n1)
        w1 = self.size[self.start[p] + i]
        q = p + w1
        two = q < self.ahead[p]
        n2 = np.where(two, self.n[q], 1)
        upto = np.cumsum(np.add.reduceat(n2, ends1 - n1))
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PATHS, "right")))
            a, b = (ends1[lo - 1] if lo else 0), ends1[hi - 1]
            m = n2[a:b]
            each = np.repeat(np.arange(a, b), m)
            j = np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
            has2, mid = two[each], q[each]
            w2 = np.where(has2, self.size[np.minimum(self.start[mid] + j, len(self.size) - 1)], 0)
            end, place = mid + w2, p[each]
            has3 = has2 & (end < self.ahead[place])
            per = np.diff(upto[lo:hi], prepend=upto[lo - 1] if lo else 0)
            begin = np.cumsum(per) - per
            yield at[lo:hi], {"begin": begin, "owner": np.repeat(np.arange(hi - lo), per), "at": place, "i": i[each], "j": j, "w1": w1[each], "w2": w2, "w3": np.where(has3, self.most[end], 0), "mid": mid, "end": end, "has2": has2, "has3": has3}
            lo = hi

    def _keys(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of paths: total bytes; that and fewer words; that and a smaller sum of squares; the rounded score. Larger ones win."""
        u, p, mid, end = self.upto, x["at"], x["mid"], x["end"]
        b1, b2, b3 = u[mid] - u[p], u[end] - u[mid], u[end + x["w3"]] - u[end]
        total = b1 + b2 + b3
        words = total * 4 + (2 - x["has2"].astype(np.int64) - x["has3"])
        squares = words * (1 << 15) + ((1 << 15) - 1 - (b1 * b1 + b2 * b2 + b3 * b3))
        two = math.log(2.0)
        score = np.where(x["i"] == 0, self.log[p], 0.0)
        score = score + np.where(x["has2"], np.where(x["j"] == 0, self.log[mid], two), 0.0)
        score = score + np.where(x["has3"], np.where(self.n[end] == 1, self.log[end], two), 0.0)
        return total, words, squares, np.floor(score * 1e9 + 0.5).astype(np.int64)

    def best(self, at: np.ndarray) -> np.ndarray:
        """The width of the first word of each place's winning path."""
        out = []
        for _, x in self.paths(at):
            _, _, key, score = self._keys(x)
            key_ok = key == np.maximum.reduceat(key, x["begin"])[x["owner"]]
            score = np.where(key_ok, score, -1)
            won = np.flatnonzero(score == np.maximum.reduceat(score, x["begin"])[x["owner"]])
            owner = x["owner"][won]
            out.append(x["w1"][won[np.append(True, owner[1:] != owner[:-1])]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of the words of all runs, which tile them: all runs step by step, then the rest of long ones at once."""
        word, reached = np.zeros(len(self.chars), np.int64), np.zeros(len(self.chars), bool)
        now, known = self.first[:-1][np.diff(self.first) > 0], False
        steps = 0
        while len(now):
            if steps == 64:
                sizes = self.stop[now] - now
                rest = np.repeat(now - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                word[rest], known = self.best(rest), True
            if not known:
                word[now] = self.best(now)
            reached[now] = True
            then = now + word[now]
            now, steps = then[then < self.stop[now]], steps + 1
        at = np.flatnonzero(reached)
        return at, word[at]

    def surfaces(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        text = self.chars.tobytes().decode("utf-32-le")
        return pa.array([text[a:b] for a, b in zip(at.tolist(), (at + size).tolist())], pa.string())

    def rows(self, at: np.ndarray) -> list[pa.Array]:
        """run and place in it."""
        return [self.runs.take(pa.array(self.run[at])), pa.array((at - self.first[self.run[at]]).astype(np.int32))]


def words(cut: Cut) -> list[list[str]]:
    """The words of each run."""
    at, size = cut.tokens()
    text, upto = cut.surfaces(at, size).to_pylist(), np.searchsorted(at, cut.first).tolist()
    return [text[a:b] for a, b in zip(upto, upto[1:])]


def _next(cut: Cut, _) -> list[pa.Array]:
    at = np.arange(len(cut.chars))
    return [*cut.rows(at), pa.array(cut.best(at).astype(np.int32))]


def _survivors(cut: Cut, _) -> list[pa.Array]:
    at, out = np.arange(len(cut.chars)), [[] for _ in range(5)]
    for _, x in cut.paths(at):
        total, fewer, squares, score = cut._keys(x)
        best = lambda key: key == np.maximum.reduceat(key, x["begin"])[x["owner"]]
        three = best(squares)
        # a key holds the ones before it, so its largest is among their largest
        for k, kept in enumerate((np.ones(len(total), bool), best(total), best(fewer), three, best(np.where(three, score, -1)))):
            out[k].append(np.add.reduceat(kept.astype(np.int64), x["begin"]))
    return [*cut.rows(at), *[pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]]


def _counted(cut: Cut, n: pa.Array) -> list[pa.Array]:
    at, size = cut.tokens()
    return [cut.surfaces(at, size), n.take(pa.array(cut.run[at]))]


def _listed(cut: Cut, _) -> list[pa.Array]:
    at, size = cut.tokens()
    every = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, cut.first).astype(np.int32)), cut.surfaces(at, size))
    return [cut.runs, every]


def _but_tokens(cut: Cut, at: np.ndarray, size: np.ndarray, token_at: np.ndarray, token_size: np.ndarray) -> list[pa.Array]:
    """(run, start, len, surface) of the distinct words given that are no tokens."""
    key = np.unique(at * 64 + size)
    width = np.zeros(len(cut.chars), np.int64)
    width[token_at] = token_size
    at, size = key >> 6, key & 63
    kept = width[at] != size
    at, size = at[kept], size[kept]
    return [*cut.rows(at), pa.array(size.astype(np.int32)), cut.surfaces(at, size)]


def _omni(least: int) -> Callable:
    def run(cut: Cut, _) -> list[pa.Array]:
        tokens, at, size = cut.tokens(), [], []
        for _, x in cut.paths(tokens[0]):
            first = np.where(x["i"] == 0, cut.f[x["at"]], 0)
            second = np.where(x["j"] == 0, cut.f[x["mid"]], 1)
            third = np.where(cut.n[x["end"]] == 1, cut.f[x["end"]], 1)
            for place, w, kept in ((x["at"], x["w1"], first >= least), (x["mid"], x["w2"], x["has2"] & (second >= least)), (x["end"], x["w3"], x["has3"] & (third >= least))):
                key = np.unique(place[kept] * 64 + w[kept])
                at.append(key >> 6)
                size.append(key & 63)
        none = [np.zeros(0, np.int64)]
        return _but_tokens(cut, np.concatenate(at + none), np.concatenate(size + none), *tokens)

    return run


def _keywords(least: int) -> Callable:
    def run(cut: Cut, _) -> list[pa.Array]:
        freq = cut.matcher.lexicon.freq
        is_term = np.flatnonzero(cut.term[:-1] >= 0)
        hit = is_term[freq[cut.term[is_term]] >= least]
        at = np.repeat(np.arange(len(cut.chars)), cut.n[:-1])[hit]
        return _but_tokens(cut, at, cut.size[hit], *cut.tokens())

    return run


def chunks(sizes: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches whose sizes sum up to ``most`` and that have ``rows`` rows at most, one row at least."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right"))))
        yield lo, hi
        lo = hi


def _over(runs: DataFrame, lexicon: Packed, work: Callable, schema: str, inclusive: bool = False, compat: bool = False) -> DataFrame:
    shared = runs.sparkSession.sparkContext.broadcast(lexicon)
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, inclusive, compat)
        for batch in batches:
            text = batch.column(0)
            sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(sizes, CHARS):
                yield pa.RecordBatch.from_arrays(work(matcher.cut(text.slice(lo, hi - lo)), batch.column(1).slice(lo, hi - lo)), names)

    return runs.select("run", "n").mapInArrow(run, schema)


def next_words(runs: DataFrame, lexicon: Packed, **how) -> DataFrame:
    """(run, at, word): the first word of each position's winning path. ``runs``: distinct ones, with n, how often each occurs."""
    return _over(runs, lexicon, _next, "run string, at int, word int", **how)


def survivors(runs: DataFrame, lexicon: Packed, **how) -> DataFrame:
    """(run, at, n_paths, rule1, rule2, rule3, rule4): how many paths are left after each rule."""
    return _over(runs, lexicon, _survivors, "run string, at int, n_paths long, rule1 long, rule2 long, rule3 long, rule4 long", **how)


def word_counts(runs: DataFrame, lexicon: Packed, **how) -> DataFrame:
    """(surface, n): the words of all runs and how often each occurs."""
    return _over(runs, lexicon, _counted, "surface string, n long", **how).groupBy("surface").agg(F.sum("n").alias("n"))


def word_lists(runs: DataFrame, lexicon: Packed, **how) -> DataFrame:
    """(run, tokens): each run's words in order."""
    return _over(runs, lexicon, _listed, "run string, tokens array<string>", **how)


def omni(runs: DataFrame, lexicon: Packed, least: int = 2, **how) -> DataFrame:
    """(run, start, len, surface): see ``relational.omni_of``, without tokens."""
    return _over(runs, lexicon, _omni(least), "run string, start int, len int, surface string", **how)


def keyword_hits(runs: DataFrame, lexicon: Packed, least: int, **how) -> DataFrame:
    """(run, start, len, surface) of terms of frequency ``least`` at every position, without those that are tokens."""
    return _over(runs, lexicon, _keywords(least), "run string, start int, len int, surface string", **how)
