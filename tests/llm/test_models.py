"""Quality, language, nearest neighbours, near-duplicates, components and the pipeline."""

from __future__ import annotations

import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.cases import LONG, ROWS, documents
from tests.llm.test_columns import brute_lines, same, water
from tokenizers import Tokenizer

from lexmill.llm import hnsw, lang_id, mixing, near_dedup, quality, queries, store
from lexmill.llm.components import connected
from lexmill.llm.sampling import held_out, thin


def word_sets(rows, width=5):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        out.setdefault(d, []).append(frozenset(s))
    return out


def brute_components(rows, percent):
    sets = [(d, s) for d, ss in word_sets(rows).items() for s in ss if d is not None]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            n = len(s & t)
            if s and t and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: find(d) for d in top}


def family(n, seed, cut=6):
    """Texts that share most words and drift apart step by step."""
    rng = np.random.default_rng(seed)
    words = [f"w{seed}x{i}" for i in range(120)]
    out = []
    for _ in range(n):
        words = list(words)
        for _ in range(int(rng.integers(0, cut))):
            words[int(rng.integers(0, len(words)))] = f"n{int(rng.integers(0, 10**9))}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = [*family(40, 1), *family(25, 2, 3), *family(6, 3, 12)]
    rows = [*[(100 + i, t, "en", "a") for i, t in enumerate(texts)], *[(300 + i, texts[3].upper(), "en", "a") for i in range(30)], (400, LONG, "en", "b"), (401, LONG + " end", "en", "b"), *ROWS, (9, texts[0], None, None)]
    rng = np.random.default_rng(4)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = near_dedup.near_components(documents(spark, rows), percent).collect()
    want = brute_components(rows, percent)
    assert len(got) == len(rows) and len({r.component_id for r in got}) < len(want)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(s)) for d, ss in word_sets(rows).items() for s in ss)
    assert near_dedup.near_components(documents(spark, []), percent).count() == 0


def test_op5_equals_sql(spark, sf):
    same(spark, sf, "op5_near_dedup")


def test_odd_sketches_estimate():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.95, 0.9, 0.8):
        k = int(1000 * 2 * share / (1 + share))
        other = np.concatenate([base[:k], rng.integers(0, 1 << 63, 1000 - k, dtype=np.uint64)])
        bits = near_dedup.odd_sketches(near_dedup.minhash([np.sort(base), np.sort(other)])).view(np.uint64)
        z = np.bitwise_count(bits[0] ^ bits[1]).sum()
        est = 1 + near_dedup.SKETCH_BITS / (4 * near_dedup.SAMPLES) * np.log(1 - 2 * z / near_dedup.SKETCH_BITS)
        assert abs(est - share) < 0.08
        assert share < 0.86 or z <= near_dedup.most_odd(0.85)


def sketch_misses(similarity, limit):
    """The probability that the sketches of a pair show more than ``limit`` odd bits, for ideal samples."""
    k, b = near_dedup.SAMPLES, near_dedup.SKETCH_BITS
    odd, at = np.arange(b + 1), np.eye(1, b + 1)[0]
    differ, total = (1 - similarity) ** np.arange(k + 1) * similarity ** np.arange(k, -1, -1.0) * [float(math.comb(k, u)) for u in range(k + 1)], 0.0
    for u in range(k + 1):
        total += differ[u] * at[limit + 1 :].sum()
        for _ in range(2):  # a sample that differs flips a bit of each sketch
            at = np.append(0, at[:-1] * (1 - odd[:-1] / b)) + np.append(at[1:] * odd[1:] / b, 0)
    return total


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_sketches_miss_less_than_bands(threshold):
    for similarity in (threshold, threshold + 0.005, threshold + 0.02):
        bands = (1 - similarity**near_dedup.ROWS) ** near_dedup.BANDS
        assert sketch_misses(similarity, near_dedup.most_odd(threshold)) < bands


def test_connected(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2500)] + [(5, 5)]
    top = {x: x for p in pairs for x in p}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = connected(spark.createDataFrame(pairs, "a long, b long"), store.Scratch(spark, "test"), "t").collect()
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.id: r.comp for r in got} == {x: find(x) for x in touched} and len(got) == len(touched)
    assert connected(spark.createDataFrame([], "a long, b long"), store.Scratch(spark, "test"), "e").count() == 0


def test_scratch(spark):
    s = store.Scratch(spark, "test")
    assert s.cut(spark.range(5), "a").count() == 5
    s.drop("a")
    store.clear()


def test_held_out_and_thin(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    rows = spark.range(10_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS kind")
    assert 350 < thin(rows, None, 500, 1).count() < 650 and thin(rows, None, 20_000, 1).count() == 10_000
    assert thin(rows.limit(0), "kind", 5, 1).count() == 0


def test_quality(spark, sf):
    got = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.85
    again = {r.doc_id: r.score for r in queries.op1_quality(spark, sf).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (99, 1), (None, 0)], "doc_id long, quality int")
    for model in (quality.fit_quality(docs, labels), quality.fit_quality(docs, labels.limit(0))):
        out = quality.score_documents(docs, model)
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (6, 7)}) == 1
        assert set(out.columns) == {*docs.columns, "predicted"}
    assert quality.score_documents(documents(spark, []), None).count() == 0


def test_non_negative_risk_learns_from_positives():
    rng = np.random.default_rng(1)
    make = lambda n, at: np.clip(rng.normal(at, 1, (n, quality.WIDTH)), -5, 5).astype(np.float32)
    pos, unl = make(600, 0.25), np.concatenate([make(900, 0.25), make(600, -0.25)])
    model = quality.train(pos, unl, steps=600)
    assert abs(model.prior - 0.6) < 0.15
    good, bad = model.raw(make(500, 0.25)), model.raw(make(500, -0.25))
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_risk_steps_back_below_zero():
    rng = np.random.default_rng(2)

    def parts(f, k, prior):
        low = lambda x: np.logaddexp(0, x)
        return prior * low(-f[:k]).mean(), low(f[k:]).mean() - prior * low(f[:k]).mean()

    def numeric(f, k, value):
        out = np.empty_like(f)
        for i in range(len(f)):
            d = np.eye(len(f))[i] * 1e-6
            out[i] = (value(f + d) - value(f - d)) / 2e-6
        return out

    inside = rng.normal(0, 1, 12)
    assert parts(inside, 5, 0.3)[1] > 0
    assert np.allclose(quality.slopes(inside, 5, 0.3), numeric(inside, 5, lambda f: sum(parts(f, 5, 0.3))), atol=1e-6)
    below = np.append(rng.normal(4, 0.1, 5), rng.normal(-4, 0.1, 7))
    assert parts(below, 5, 0.6)[1] < 0
    assert np.allclose(quality.slopes(below, 5, 0.6), numeric(below, 5, lambda f: -parts(f, 5, 0.6)[1]), atol=1e-6)


@pytest.mark.parametrize("hot", [True, False])
def test_samples_are_bounded_with_a_hot_id(spark, hot):
    rows = spark.range(30_000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "CONCAT('text ', IF(id % 3 = 0 AND NOT " + ("true" if hot else "false") + ", 0, id)) AS text")
    for seed in range(3):
        assert 350 < thin(rows, None, 500, seed).count() < 650 or not hot
        assert thin(rows, None, 500, seed).count() < 650
    labels = spark.createDataFrame([(7, 1), (8, 1), (10, 0)], "doc_id long, quality int")
    assert quality.fit_quality(rows, labels, positives=200, unlabelled=400).prior > 0


def test_language_gradients():
    net = lang_id.fresh(["a", "b", "c"], 5, dtype=np.float64)
    x, live = lang_id.columns([b"abc", b"zz", b"hello"])
    y = np.array([0, 2, 1])
    _, grads = net.step(x, live, y)
    rng = np.random.default_rng(0)
    for w, g in zip(net.weights(), grads):
        for _ in range(8):
            i = tuple(int(rng.integers(0, s)) for s in w.shape)
            keep = w[i]
            w[i] = keep + 1e-6
            up = net.step(x, live, y)[0]
            w[i] = keep - 1e-6
            down = net.step(x, live, y)[0]
            w[i] = keep
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_languages(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.op10_lang_id(spark, sf).collect()]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) >= 0.9
    docs = documents(spark)
    for net in (lang_id.fit_languages(docs), None):
        out = lang_id.predict_languages(docs, net).collect()
        assert len(out) == len(ROWS)
        for r in out:
            if not any(map(str.isalpha, r.text or "")) or net is None:
                assert (r.lang_pred, r.score) == ("und", 0.0)
            else:
                assert r.lang_pred in net.langs and 0 < r.score <= 1
    assert lang_id.predict_languages(documents(spark, []), None).count() == 0


def test_windows_tile_texts_on_character_bounds():
    texts = ["", "a" * 200, "漢字" * 100, "é" * 61, "x", "😀" * 40, "ab 漢\0" * 50]
    data, offs = lang_id.lowered(pa.array(texts))
    start, length, text = lang_id.window_bounds(data, offs)
    x = lang_id.window_columns(data, start, length)
    assert length.max() <= lang_id.STEPS and length.min() > 0
    for i, t in enumerate(texts):
        own = [x[:n, k].tobytes().decode() for k, n in enumerate(length.tolist()) if text[k] == i]
        assert "".join(own) == t.replace("\0", " ") and not any(x[n:, k].any() for k, n in enumerate(length.tolist()))


def test_pooling_equals_positions():
    """The reader, padding, blocks and pooling against the network itself, window by window."""
    net = lang_id.fresh(["x", "y", "z"], 6)
    texts = ["One two three, four " * 20, "123 456", "", "É漢字 zwölf" * 30, "b" * 61, "tiny"]
    data, offs = lang_id.lowered(pa.array(texts))
    got = lang_id.pooled(lang_id.Reader(net), data, offs)
    start, length, text = lang_id.window_bounds(data, offs)
    for i in range(len(texts)):
        sums, n = np.zeros(3), 0
        for a, k in zip(start[text == i], length[text == i]):
            x, live = lang_id.columns([data[a : a + k].tobytes()])
            on = lang_id.LETTER[x[:, 0]]
            sums, n = sums + net.positions(x, live)[on, 0].sum(0), n + on.sum()
        assert np.allclose(got[i], sums / max(n, 1), atol=1e-4)
    assert not got[1].any() and not got[2].any()


def test_positions_see_past_blanks():
    net = lang_id.fresh(["x", "y"], 6)
    at = lambda t: net.positions(*lang_id.columns([t]))[-1, 0]
    assert not np.allclose(at(b"one two"), at(b"six two"), atol=1e-7)


def brute_nearest(rows, k, kind=np.float32):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(tuple(kind(x) for x in v))
    good = {i: np.array(min(vs), np.float64) for i, vs in good.items()}
    out = {}
    for q in good:
        if q % 20 == 0:
            other = [(-(good[q] * v).sum(), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
            out[q] = [(i, -s) for s, i in sorted(other)[:k]]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_cases(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(i, [1.0] * 8) for i in range(200, 260)] + [(300, None), (301, []), (320, [0.0] * 8), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (340, [float("inf")] * 8), (None, [1.0] * 8), (7, [9.0] * 8), (40, rows[40][1]), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (60, [0.25, 7.0]), (9, [-5.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS shard", "2 AS dim")
    got = {}
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), k=20, shards=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 20, np.float32 if kind == "float" else np.float64)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert [(f[1], round(f[2], 12)) for f in found] == [(i, round(float(s), 12)) for i, s in want[q]]
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20)
    got = {}
    for r in queries.op9_nearest(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.95


def test_recall_of_full_shards():
    """Gaussian vectors, whose lengths differ, in three shards of production size, merged as the query does."""
    rows, n = hnsw.SHARD_ROWS, 3 * hnsw.SHARD_ROWS
    x = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    q, found = x[:100], []
    for a in range(0, n, rows):
        points, layers, order = hnsw.build(x[a : a + rows])
        assert sorted(order.tolist()) == list(range(rows)) and len(layers) > 1
        found.append(a + order[hnsw.search(points, layers, q, 224)][:, :20])
    scores = q @ x.T
    best = np.argsort(-scores, axis=1)[:, :20]
    merged = [sorted(np.concatenate([f[i] for f in found]).tolist(), key=lambda v: -scores[i, v])[:20] for i in range(len(q))]
    assert np.mean([len(set(f) & set(b)) / 20 for f, b in zip(merged, best)]) >= 0.95


def test_pipeline(spark, sf):
    """The stages against brute force on the documents that the classifier accepts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    now = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == columns
            docs = store.Scratch(spark, "test").cut(out, name)
        now[name] = (docs if name != "bpe" else out).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in now["quality_classifier"]]
    lines = {d: t for d, _, _, t in brute_lines(rows)}
    assert {r.doc_id: r.text for r in now["line_dedup"]} == lines
    assert all(r.n_chars == len(r.text) for r in now["line_dedup"])
    comp = brute_components([(d, t) for d, t in lines.items()], 80)
    assert sorted(r.doc_id for r in now["near_dedup"]) == sorted(d for d, c in comp.items() if c == d)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in now["near_dedup"]:
        sizes[r.source] += words(r.text)
    for r in now["mix_sources"]:
        taken[r.source] += words(r.text)
    for s, target in water(sizes).items():
        assert abs(taken[s] - target) < 1.001
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in now["mix_sources"])
    assert Counter((r.doc_id, bytes(r.ids)) for r in now["bpe"]) == want
    assert corpus_pipeline.run(spark, sf).count() == len(now["bpe"])


def test_pipeline_cases(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    documents(spark, []).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mixing.plan_mix(documents(spark, [])).count() == 0
