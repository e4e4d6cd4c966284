"""The matcher over many runs at once equals the plain rules and the joins, and its queries shuffle no paths."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.config import SegmentConfig
from lexmill.operators import kernel, matcher, relational
from lexmill.plans import queries


def packed(terms):
    return kernel.Packed(pa.array(list(terms), pa.string()), np.array(list(terms.values()), np.int64))


def random_case(seed):
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "abc", "aé中", "𝒳中ab"])
    text = lambda sizes: "".join(rnd.choice(letters + "z") for _ in range(rnd.choice(sizes)))
    return {text([1, 2, 3, 4, 5]): rnd.choice([1, 2, 5, 9, 70000]) for _ in range(rnd.randint(0, 25))}, list(dict.fromkeys(text([1, 2, 3, 8, 40, 300]) for _ in range(12)))


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("compat", [False, True])
def test_words_equal_the_plain_rules(inclusive, compat):
    for seed in range(60):
        terms, runs = random_case(seed)
        cut = kernel.Matcher(packed(terms), inclusive, compat).cut(pa.array(["q", *runs]).slice(1))
        plain = matcher.Segmenter(matcher.Lexicon(dict(terms)), SegmentConfig(lookahead_inclusive=inclusive, compat=compat))
        assert kernel.words(cut) == [plain.words(r) for r in runs]


def test_paths_in_small_blocks(monkeypatch):
    terms, runs = random_case(3)
    whole = kernel._survivors(kernel.Matcher(packed(terms)).cut(pa.array(runs)), None)
    monkeypatch.setattr(kernel, "PATHS", 3)
    assert kernel._survivors(kernel.Matcher(packed(terms)).cut(pa.array(runs)), None) == whole


def test_equals_the_joins(spark):
    terms = {t: f for seed in range(0, 40, 2) for t, f in random_case(seed)[0].items()}
    runs = spark.createDataFrame([(r, i + 1) for i, r in enumerate({r for seed in range(0, 40, 2) for r in random_case(seed)[1] if len(r) < 50})], "run string, n long")
    lexicon = spark.createDataFrame(list(terms.items()), "term string, freq int")
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    p, hits = kernel.collect(lexicon), relational.hits(runs.select("run"), lexicon, 36).localCheckpoint()
    every = relational.scored(relational.paths(hits)).localCheckpoint()
    assert rows(kernel.next_words(runs, p)) == rows(relational.next_words(every))
    assert rows(kernel.survivors(runs, p)) == rows(relational.survivors(every))
    assert rows(kernel.omni(runs, p)) == rows(relational.omni_of(every))
    words = relational.words_of(hits)
    assert rows(kernel.keyword_hits(runs, p, 5)) == rows(relational.keyword_hits(runs, lexicon.where("freq >= 5"), 36, words))
    assert rows(kernel.word_counts(runs, p)) == rows(words.join(runs, "run").groupBy("surface").agg(F.sum("n").alias("n")))


@pytest.mark.parametrize("name", ["omni_tokens", "rule_survivors", "keyword_minus_tokens", "token_lists", "next_step", "segment_words"])
def test_no_paths_are_rows(spark, sf, name):
    """Paths as rows, joined and shuffled, took the queries' time."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_a_dictionary_too_large_is_joined(spark, sf, monkeypatch):
    rows = lambda: sorted(map(tuple, queries.QUERIES["segment_words"](spark, sf).collect()))
    here = rows()
    monkeypatch.setattr(queries.kernel, "collect", lambda *_: None)
    assert rows() == here
    monkeypatch.undo()
    assert kernel.collect(spark.createDataFrame([("a", 1), ("b", 1)], "term string, freq int"), most=1) is None


def test_packed_dictionaries_are_small():
    """A worker's dictionary once took some 300 bytes a term."""
    p = packed({f"{i:x}term": i for i in range(50_000)})
    assert sum(x.nbytes for x in vars(p).values() if isinstance(x, np.ndarray)) < 100 * 50_000


def test_packed_stream_tokens(monkeypatch):
    """Texts cut by a packed dictionary, in small steps and with a small memory of pieces, have the plain rules' tokens."""
    terms, runs = random_case(7)
    texts = [" ".join(runs[:k]) + "\n12" * k for k in range(len(runs))] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    monkeypatch.setattr(matcher, "STEP_BYTES", 40)
    monkeypatch.setattr(matcher.Segmenter, "KEPT", 3)

    class Shared:
        value = packed(terms)

    got = [tuple(r.values()) for b in matcher._map_tokens(Shared, SegmentConfig(), 1, True)(iter([batch])) for r in b.to_pylist()]
    plain = matcher.Segmenter(matcher.Lexicon(dict(terms)), SegmentConfig())
    assert [(r[0], r[1], r[2]) for r in got] == [(i, k, t) for i, x in enumerate(texts) for k, t in enumerate(plain.tokens(x or ""))]
