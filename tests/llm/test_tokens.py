"""BPE, token files and fingerprints against the tokenizers library and brute force."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.cases import ROWS, documents
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lexmill.llm import bpe, fingerprint as fp, token_files as tf

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(st.sampled_from(list("abAZz  \n\t\r\x0b\x1c\x85\xa0 　'stre019²½éİßﬁΣς漢😀́.,!<|>")), max_size=30)
PARTS = st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "Word,", "it's.", "aaaa"])), max_size=4).map("".join)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Tables(BYTE))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(PARTS, min_size=1, max_size=6))
def test_bpe_equals_the_library(encoder, libraries, texts):
    numbers = [encoder.numbers(t) for t in texts]
    got = [ids for _, flat, lens in encoder.encode(numbers) for ids in np.split(flat, np.cumsum(lens)[:-1])]
    assert [g.tolist() for g in got] == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]
    assert [bpe.decoded(encoder.t, g) for g in got] == texts


def test_bpe_forgets_and_goes_on(libraries, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    e = bpe.Encoder(bpe.Tables(BYTE))
    for k in range(5):
        texts = [f"word{i} again and again {i * k}" for i in range(60)]
        out = [ids for _, flat, lens in e.encode([e.numbers(t) for t in texts]) for ids in np.split(flat, np.cumsum(lens)[:-1])]
        assert [g.tolist() for g in out] == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]
    assert len(e.lens) < 200


def test_bpe_keeps_added_tokens(libraries, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    e, t = bpe.Encoder(bpe.Tables(BYTE)), "a<|endoftext|>b"
    for k in range(60):
        list(e.encode([e.numbers(" ".join(f"word{k}x{i}" for i in range(40)))]))
    assert len(e.lens) < 100
    assert next(e.encode([e.numbers(t)]))[1].tolist() == libraries[0].encode(t, add_special_tokens=False).ids


def test_merges_of_equal_symbols_overlap_left_first(encoder, libraries):
    for t in ("a" * 7, "!" * 33, "00000 0000", "ababababa"):
        ids, lens = bpe.merge_all([t.encode()], encoder.t)
        assert lens.tolist() == [len(ids)] and bpe.decoded(encoder.t, ids) == t
        nums = [encoder.numbers(t)]
        assert next(encoder.encode(nums))[1].tolist() == libraries[0].encode(t, add_special_tokens=False).ids


def test_bpe_frame(spark, libraries, monkeypatch):
    docs = documents(spark)
    want = sorted((repr(d), len(ids := libraries[0].encode(t or "", add_special_tokens=False).ids), np.array(ids, "<u4").tobytes(), t or "") for d, t, *_ in ROWS)
    for out in (bpe.round_trip(docs, BYTE), bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE)):
        assert sorted((repr(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()) == want
    assert bpe.round_trip(documents(spark, []), BYTE).count() == 0


def test_op3(spark, sf, libraries):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.queries()["op3_bpe"](spark, sf).collect():
        ids = libraries[0].encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), PARTS), min_size=1, max_size=6))
def test_pieces_equal_the_library(libraries, texts):
    if not hasattr(test_pieces_equal_the_library, "e"):
        test_pieces_equal_the_library.e = tf.PieceEncoder(open(WORD).read(), 2)
    e = test_pieces_equal_the_library.e
    entries, n = e.encode(pa.array(texts, pa.string()))
    ids = [tf.gather(e.ids, np.cumsum(e.lens) - e.lens, e.lens, x).tolist() for x in np.split(entries, np.cumsum(n)[:-1])]
    assert ids == [libraries[1].encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


MARKERS = st.sampled_from(["<|endoftext|>", "<|startoftext|>"]).flatmap(lambda m: st.tuples(*[st.sampled_from([c, c.upper()]) for c in m]).map("".join))


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.one_of(ODD, MARKERS, st.sampled_from(["Word,", "<|ENDOFTEXT|>", "<|EndOfText|>,", "<|STARTOFTEXT|>x."])), max_size=4).map("".join), min_size=1, max_size=6))
def test_pieces_with_markers_in_any_case_equal_the_library(libraries, texts):
    e = tf.PieceEncoder(open(WORD).read(), 2)
    entries, n = e.encode(pa.array(texts, pa.string()))
    ids = [tf.gather(e.ids, np.cumsum(e.lens) - e.lens, e.lens, x).tolist() for x in np.split(entries, np.cumsum(n)[:-1])]
    assert ids == [libraries[1].encode(t, add_special_tokens=False).ids + [2] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), max_size=200))
def test_index_is_minimal_and_perfect(ids):
    keys = tf.key_hashes(ids)
    sizes, bits, ranks = tf.build_index(keys)
    at = tf.slots(keys, sizes, bits, ranks) if len(keys) else np.zeros(0, int)
    assert sorted(at.tolist()) == list(range(len(ids)))
    bit = np.unpackbits(bits)
    assert (tf._ranks(np.arange(len(bit)), bits, ranks) == np.cumsum(bit) - bit).all()


def test_lookups_take_as_long_in_large_shards():
    took = {}
    for n in (1 << 16, 1 << 20):
        keys = tf.occurrence_keys(list(range(n)), 0)
        index = tf.build_index(keys)
        few = keys[:: n // 200]
        tf.slots(few, *index)
        took[n] = min(_seconds(lambda: tf.slots(few, *index)) for _ in range(20))
    assert took[1 << 20] < 4 * took[1 << 16]


def _seconds(call):
    start = time.perf_counter()
    call()
    return time.perf_counter() - start


@pytest.mark.parametrize("hot", [7, None])
def test_files_split_a_hot_document(spark, libraries, tmp_path, monkeypatch, hot):
    rows = [(hot, f"same {i % 3}", None, None) for i in range(400)] + [(100 + i, f"other {i}", None, None) for i in range(800)]
    docs = documents(spark, rows).repartition(8)
    tf.write_shards(docs, WORD, str(tmp_path / "f"), parts=6)
    parts = spark.read.parquet(str(tmp_path / "f" / "shards")).selectExpr("part", "size(keys) AS n", "size(filter(keys, x -> x <=> %s)) AS hot" % ("NULL" if hot is None else hot)).collect()
    assert sum(r.hot > 0 for r in parts) > 1 and max(r.n for r in parts) < 500
    got = sorted(tf.read_shards(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    want = sorted((d is not None, d, tuple(libraries[1].encode(t, add_special_tokens=False).ids) + (2,)) for d, t, *_ in rows)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert [(d is not None, d) for d in (r.doc_id for r in got)] == [w[:2] for w in want]
    assert sorted((r.doc_id is not None, r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    asked = [hot, 105, 899, 5000]
    found = sorted(tf.read_keys(spark, str(tmp_path / "f"), asked).collect(), key=lambda r: r.start)
    assert found == [type(found[0])(doc_id=r.doc_id, start=r.start, n_tokens=r.n_tokens, ids=r.ids) for r in got if r.doc_id in asked]
    one = tf.read_keys(spark, str(tmp_path / "f"), [105])
    assert one.count() == 1 and len([f for f in one.inputFiles() if "/shards/" in f]) == 1
    assert tf.read_keys(spark, str(tmp_path / "f"), [-5]).count() == 0


def test_foreign_keys_show():
    keys = tf.key_hashes(list(range(1000)))
    row = tf._shard_row(0, 0, 0, np.zeros(1000, np.uint32), list(range(1000)), np.ones(1000, np.int64), 2)
    assert (tf.lookup(row, keys)[0] == np.arange(1000)).all()
    assert (tf.lookup(row, tf.key_hashes(list(range(5000, 9000))))[0] < 0).mean() > 0.999


def files_as_expected(rows, library, got):
    start, want = 0, []
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)] == want


def test_token_files(spark, libraries, tmp_path, monkeypatch):
    docs = documents(spark)
    tf.write_shards(docs, WORD, str(tmp_path / "f"), parts=3)
    got = tf.read_shards(spark, str(tmp_path / "f")).collect()
    ties = {(r.doc_id, r.n_tokens): 0 for r in got}
    assert len(got) == len(ROWS) and len(ties) >= len({r[0] for r in ROWS})
    nulls = [t for d, t, *_ in ROWS if d is None]
    first = sorted(got, key=lambda r: r.start)[:2]
    assert [r.doc_id for r in first] == [None, None] and sorted(len(libraries[1].encode(t or "", add_special_tokens=False).ids) + 1 for t in nulls) == sorted(r.n_tokens for r in first)
    rest = sorted(((d, t) for d, t, *_ in ROWS if d is not None), key=lambda x: x[0])
    base = sum(r.n_tokens for r in first)
    files_as_expected([(d, t) for d, t in rest], libraries[1], [type(r)(**{**r.asDict(), "start": r.start - base}) for r in got if r.doc_id is not None])
    tf.write_shards(documents(spark, []), WORD, str(tmp_path / "e"))
    assert tf.read_shards(spark, str(tmp_path / "e"), with_ids=False).count() == 0


def test_op8(spark, sf, libraries):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    files_as_expected(docs, libraries[1], entry.queries()["op8_token_files"](spark, sf).collect())


def brute_print(text):
    """The fingerprint by dictionaries and sorting."""
    n = len(text)
    if not n:
        return [0] * fp.SLOTS
    k, mask = min(fp.K, n), (1 << 64) - 1
    mix = lambda x: int(fp.mix(np.array([x & mask], np.uint64))[0])
    seen, every = {}, []
    for i in range(n - k + 1):
        h = k
        for c in text[i : i + k]:
            h = (h * int(fp.STEP) + ord(c)) & mask
        h = mix(h)
        nth = seen[h] = seen.get(h, -1) + 1
        every.append((mix(h + nth * int(fp.STEP)), i))
    if len(every) == 1:
        return [max(1, mix(every[0][0]) >> 48)] * fp.SLOTS
    out = []
    for s in range(fp.SLOTS):
        own = [x for x in every if x[0] >> 57 == s]
        best = sorted(own)[:2] if len(own) > 1 else sorted(every, key=lambda x: mix(x[0] ^ int(fp.OWN[s])))[:2]
        (a, _), (b, _) = sorted(best, key=lambda x: x[1])
        out.append(max(1, mix(mix(a) + b * int(fp.STEP)) >> 48))
    return out


@settings(max_examples=40, deadline=None)
@given(st.text("abcé漢", max_size=300))
def test_fingerprint_equals_brute_force(text):
    assert fp.fingerprint(text).tolist() == brute_print(text)


def test_fingerprint_feels_order_and_edits():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    text, moved = " ".join(words), " ".join(words[200:] + words[:200])
    one = fp.fingerprint(text)
    assert fp.likeness(one, fp.fingerprint(text)) == 1
    small = fp.likeness(one, fp.fingerprint(text.replace(words[100], "zzzzzz")))
    shuffled = fp.likeness(one, fp.fingerprint(moved))
    half = fp.likeness(one, fp.fingerprint(fp.edited(text, " ".join(reversed(words)))))
    assert small > 0.85 and shuffled < 0.75 and shuffled < small and half < shuffled
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1 and fp.likeness(fp.fingerprint(""), one) == 0


@pytest.mark.parametrize("words", [8, 16, 40])
def test_short_fingerprints_feel_order(words):
    rng = np.random.default_rng(1)
    apart = []
    for _ in range(20):
        w = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(words)]
        text, moved = " ".join(w), " ".join(w[words // 2 :] + w[: words // 2])
        shingles = [{t[i : i + fp.K] for i in range(len(t) - fp.K + 1)} for t in (text, moved)]
        bag = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])
        apart.append(bag - fp.likeness(fp.fingerprint(text), fp.fingerprint(moved)))
    assert np.mean(apart) > 0.25


def neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(d, t or "", order[(i + 1) % len(order)][1] or "") for i, (d, t, *_) in enumerate(order)]


def test_neighbours(spark):
    distinct = [r for r in dict.fromkeys(ROWS) if r[0] is not None] + [(None, "a row without an id", "en", "a")]
    for rows, parts in ((distinct, 3), (distinct, 1), (distinct[:1], 2)):
        got = {r.doc_id: r for r in fp.compare_neighbours(documents(spark, rows), parts).collect()}
        assert len(got) == len(rows)
        for d, t, after in neighbours(rows):
            e = fp.edited(t, after)
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert r.fingerprint == fp.fingerprint(t).tobytes().hex() and r.edited_fingerprint == fp.fingerprint(e).tobytes().hex()
            assert r.near_edited == fp.likeness(fp.fingerprint(t), fp.fingerprint(e)) and r.near_next == fp.likeness(fp.fingerprint(t), fp.fingerprint(after))
    assert fp.compare_neighbours(documents(spark), 3).count() == len(ROWS)
    assert fp.compare_neighbours(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [5, None])
def test_neighbours_of_a_hot_document(spark, hot, monkeypatch):
    monkeypatch.setattr(fp, "TIMES", 16)
    texts = [f"text {i} of the document that is in many rows" for i in range(60)]
    rows = [(hot, t, None, None) for t in texts] + [(hot, "copy " * 5, None, None)] * 50 + [(100 + i, f"other {i} " * 3, None, None) for i in range(200)]
    docs = documents(spark, rows).repartition(5)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for i, (d, t, *_) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        e = fp.edited(t, after)
        one, other = fp.fingerprint(t), fp.fingerprint(e)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), one.tobytes().hex(), other.tobytes().hex(), fp.likeness(one, other), fp.likeness(one, fp.fingerprint(after))))
    got = fp.compare_neighbours(docs, 4)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_places():
    heads = [(None, -5), (None, 7), (1, 0), (3, -9), (3, 4), (2**60 + 1, 0)]
    rows = [(None, -5), (None, 6), (None, 7), (None, 99), (1, 0), (2, -9), (3, -9), (3, 3), (3, 4), (9, 0), (2**60, 5), (2**60 + 1, 3)]
    known, ids, ties = (np.array(x) for x in zip(*[(d is not None, d or 0, t) for d, t in rows]))
    assert fp.places(known, ids, ties, heads).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5]


def test_op7(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in entry.queries()["op7_fingerprints"](spark, sf).collect()}
    for d, t, after in neighbours(docs):
        e = fp.edited(t, after)
        one, other = fp.fingerprint(t), fp.fingerprint(e)
        want = (d, len(t), hashlib.sha256(e.encode()).hexdigest(), one.tobytes().hex(), other.tobytes().hex(), fp.likeness(one, other), fp.likeness(one, fp.fingerprint(after)))
        assert tuple(got[d]) == want
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
