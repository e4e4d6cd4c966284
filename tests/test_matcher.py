"""The matcher: hand-traced cases, properties, and agreement of its two forms."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexmill.config import SegmentConfig
from lexmill.functions.classes import default_classes, letters_as_words, me_pattern, piece_pattern
from lexmill.operators import matcher, relational, runs
from lexmill.operators.matcher import Lexicon, Segmenter, segment_run


def chars(text, freq=1):
    return {c: freq for c in text}


def cut(terms, text, **how):
    out, at = [], 0
    for n in segment_run(text, Lexicon(terms), **how):
        out.append(text[at : at + n])
        at += n
    return out


SEG3 = {"甲": 1, "乙": 1, "丙": 1000, "甲乙": 1, "乙丙": 1}


@pytest.mark.parametrize(
    "terms, text, how, want",
    [
        (chars("中国人上海市") | chars("中国 国人 中国人 上海 上海市".split()), "中国人上海市", {}, ["中国人", "上海市"]),
        (chars("中文分词测试") | chars("中文 分词 测试".split()), "中文分词测试", {}, ["中文", "分词", "测试"]),
        (SEG3, "甲乙丙", {}, ["甲", "乙丙"]),
        (SEG3, "甲乙丙", {"inclusive": True}, ["甲乙", "丙"]),
        ({}, "甲乙丙", {}, ["甲", "乙", "丙"]),
        # [1,2] and [2,1] tie rules 1 to 3; the first word is credited with the longest one's count, so [1,2] wins rule 4
        ({"ab": 70000, "bc": 5}, "abcd", {"compat": True}, ["a", "bc", "d"]),
    ],
)
def test_hand_traced(terms, text, how, want):
    assert cut(terms, text, **how) == want


@pytest.mark.parametrize(
    "how, want",
    [
        ({}, [["abc", "123"], ["a", "-", "b"], ["a", "-", "12"], ["x", ",", "y"]]),
        ({"merge": True}, [["abc123"], ["a", "-", "b"], ["a", "-", "12"], ["x", ",", "y"]]),
        ({"joint": "-"}, [["abc", "123"], ["a-b"], ["a-1", "2"], ["x", ",", "y"]]),
        ({"separate": True}, [["abc", "1", "2", "3"], ["a", "-", "b"], ["a", "-", "1", "2"], ["x", ",", "y"]]),
    ],
)
def test_letter_and_digit_runs(spark, how, want):
    texts = ["abc123", "a-b", "a-12", "x,y"]
    config = SegmentConfig(**how)
    assert [Segmenter(Lexicon({}), config).tokens(t) for t in texts] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(4)}
    for r in runs.pieces(rows, config).orderBy("doc_id", "pos").collect():
        got[r.doc_id].append(r.piece)
    assert list(got.values()) == want


@pytest.mark.parametrize("how", [{"merge": True, "joint": "-."}, {"joint": "-'@"}, {"merge": True}])
def test_long_letter_and_digit_runs(spark, how):
    """Long runs take no stack: a plain group's star in Java overflows it."""
    config = SegmentConfig(**how)
    texts = ["ab-1." * 40_000, "a-b" * 40_000, "-.x" + "aé" * 40_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [re.findall(piece_pattern(config.classes, config.merge, config.separate, config.joint), t) for t in texts]
    assert [[r.piece for r in runs.pieces(rows.where(f"doc_id = {i}"), config).orderBy("pos").collect()] for i in range(3)] == want
    got = {r.token: r.n for r in runs.letter_digit_runs(rows, config).collect()}
    assert got == Counter(m for t in texts for m in re.findall(me_pattern(config.classes, config.merge, config.separate, config.joint), t))


def walked(text, config):
    """Letter and digit runs by walking the characters one by one."""
    c = config.classes
    import re

    kind = lambda ch: next((k for k in ("m", "e", "w") if getattr(c, k) and re.match(f"[{getattr(c, k)}]", ch)), "s")
    out, i = [], 0
    while i < len(text):
        k = kind(text[i])
        j = i + 1
        if text[i] in "\r\n" or k == "w":
            pass
        elif k in "me":
            while j < len(text) and text[j] not in "\r\n":
                n = kind(text[j])
                if config.separate and n == "m":
                    break
                if n == k or config.merge and n in "me" or text[j] in config.joint or text[j - 1] in config.joint:
                    j += 1
                    continue
                break
        else:
            while j < len(text) and kind(text[j]) == "s" and text[j] not in "\r\n":
                j += 1
        out.append(text[i:j])
        i = j
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab1-. ,x中９\n\r", max_size=14), st.booleans(), st.booleans(), st.sampled_from(["", "-", "-.", "1"]))
def test_runs_equal_a_walk(text, merge, separate, joint):
    config = SegmentConfig(merge=merge, separate=separate, joint=joint)
    assert Segmenter(Lexicon({}), config).pieces(text) == walked(text, config)


@settings(max_examples=200, deadline=None)
@given(st.text("abcé中", min_size=1, max_size=12), st.dictionaries(st.text("abcé中", min_size=1, max_size=4), st.integers(0, 100_000), max_size=12), st.booleans())
def test_words_tile_the_run(text, terms, inclusive):
    words = cut(terms, text, inclusive=inclusive)
    assert "".join(words) == text
    assert all(len(w) == 1 or w in terms for w in words)


@settings(max_examples=50, deadline=None)
@given(st.text("abc", min_size=1, max_size=10))
def test_single_characters_without_longer_terms(text):
    assert cut(chars("abc", 7), text) == list(text)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcdé中国", min_size=1, max_size=9), min_size=1, max_size=12), st.dictionaries(st.text("abcdé中国", min_size=1, max_size=4), st.integers(0, 70_000), min_size=1, max_size=20), st.booleans())
def test_both_forms_agree(spark, texts, terms, inclusive):
    every = spark.createDataFrame([(t,) for t in sorted(set(texts))], "run string")
    d = spark.createDataFrame(list(terms.items()), "term string, freq int")
    got = {}
    for r in relational.segment_runs(every, d, 36, inclusive).collect():
        got.setdefault(r.run, {})[r.nth] = r.surface
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {t: cut(terms, t, inclusive=inclusive) for t in set(texts)}


def test_arrow_form_keeps_columns_and_repartitions(spark):
    rows = spark.createDataFrame([(1, "中国人上海市, ab12\n", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, note string")
    lexicon = Lexicon(chars("中国人上海市") | {"中国人": 1, "上海市": 1})
    want = [(1, "x", i, t) for i, t in enumerate(["中国人", "上海市", ",", " ", "ab", "12", "\n"])]
    for n in (1, 3):
        got = matcher.segment(rows.repartition(n), lexicon)
        assert sorted((r.doc_id, r.note, r.pos, r.surface) for r in got.collect()) == want
    detailed = matcher.segment(rows, lexicon, details=True).orderBy("pos").collect()
    assert [(r.surface, r.start_byte, r.byte_len, r.kind, r.chunk) for r in detailed] == [("中国人", 0, 9, "word", 0), ("上海市", 9, 9, "word", 0), (",", 18, 1, "separator", 0), (" ", 19, 1, "word", 1), ("ab", 20, 2, "letter", 1), ("12", 22, 2, "number", 2), ("\n", 24, 1, "newline", 3)]
    offsets = matcher.with_offsets(matcher.segment(rows, lexicon), ["doc_id"]).orderBy("pos").collect()
    assert [(r.start_byte, r.end_byte) for r in offsets][:3] == [(0, 9), (9, 18), (18, 19)]


def test_dictionary_size_is_checked(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "term string, freq int")
    with pytest.raises(ValueError, match="relational"):
        matcher.collect_lexicon(d, most=1)


def test_omni_and_keywords(spark):
    every = spark.createDataFrame([("abcd",)], "run string")
    d = spark.createDataFrame([("ab", 5), ("abc", 9), ("cd", 3), ("d", 4)], "term string, freq int")
    tokens = relational.segment_runs(every, d, 36)
    assert [r.surface for r in tokens.orderBy("nth").collect()] == ["ab", "cd"]
    lexicon = Lexicon({"ab": 5, "abc": 9, "cd": 3, "d": 4})
    want = set(matcher.omni_words("abcd", [0, 2], lexicon, 2)) - {(0, 2), (2, 2)}
    assert {(r.start, r.len) for r in relational.omni(every, d, 36).collect()} == want
    kw = spark.createDataFrame([("bc", 1), ("cd", 1)], "term string, freq int")
    assert [(r.start, r.surface) for r in relational.keyword_hits(every, kw, 36, tokens).collect()] == [(1, "bc")]


def test_profiles():
    assert Segmenter(Lexicon({}), SegmentConfig(classes=letters_as_words())).tokens("ab c") == ["a", "b", " ", "c"]
    assert Segmenter(Lexicon({}), SegmentConfig(classes=default_classes(cjk_numerals=False))).tokens("三z9") == ["三", "z", "9"]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé中", min_size=1, max_size=10), st.dictionaries(st.text("abcé中", min_size=1, max_size=4), st.integers(0, 70_000), max_size=14), st.booleans(), st.booleans())
def test_best_word_is_the_best_of_all_paths(text, terms, inclusive, compat):
    lexicon = Lexicon(terms)
    hits = lambda at: lexicon.hits(text, at)
    offsets = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for base in range(len(text)):
        keyed = []
        for n, path in enumerate(matcher.paths(text, base, hits, inclusive)):
            at, sizes = base, []
            for w, _ in path:
                sizes.append(offsets[at + w] - offsets[at])
                at += w
            keyed.append((sum(sizes), -len(path), -sum(x * x for x in sizes), matcher._score(tuple(f for _, f in path), compat), -n, path[0][0]))
        assert matcher.best_word(text, base, offsets, hits, inclusive, compat) == max(keyed)[-1]


def plain_details(seg, text):
    """(surface, start byte, bytes, kind, chunk) token by token."""
    out, at, chunk, before = [], 3 * text.startswith("\ufeff"), 0, None
    for piece in seg.pieces(text):
        kind = seg.kind(piece)
        if before is not None and before != matcher.RUN and not (kind == matcher.SEPARATOR and before in (matcher.NUMBER, matcher.LETTER)):
            chunk += 1
        before = kind
        for t in seg.words(piece) if kind == matcher.RUN else [piece]:
            out.append((t, at, len(t.encode()), kind, chunk))
            at += len(t.encode())
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab1-. ,中國9\n\r\ufeff\0é", max_size=14), max_size=5), st.integers(0, 3))
def test_cut_equals_a_walk_over_tokens(texts, kept):
    seg = Segmenter(Lexicon({"中國": 5, "é中": 2}), SegmentConfig())
    seg.KEPT = kept
    for _ in range(2):
        got = seg.cut(texts)
        rows = list(zip(got.vocabulary.take(matcher.pa.array(got.which)).to_pylist(), got.start.tolist(), got.size.tolist(), got.kind.tolist(), got.chunk.tolist()))
        want = [plain_details(seg, t) for t in texts]
        assert got.counts.tolist() == [len(w) for w in want] and rows == [x for w in want for x in w]
        assert [[x[0] for x in w] for w in want] == [seg.tokens(t) for t in texts]


def test_joins_equal_the_arrow_form_over_texts(spark):
    texts = ["中国人上海市, ab12\n中国", None, "", "中国人中国人", "ab-1", "中国人上海市"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, note string")
    terms = chars("中国人上海市") | {"中国人": 1, "上海市": 1, "中国": 9}
    d = spark.createDataFrame(list(terms.items()), "term string, freq int")
    for config in (SegmentConfig(), SegmentConfig(joint="-", merge=True, lookahead_inclusive=True)):
        got = relational.segment_rows(rows, d, config, keep=lambda df, _: df.cache())
        want = matcher.segment(rows, Lexicon(terms), config)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counts = {(r.surface, r.kind): r.n for r in matcher.count_tokens(rows, Lexicon(terms)).collect()}
    assert counts[("中国人", "word")] == 5 and counts[("\n", "newline")] == 2 and counts[("ab", "letter")] == 3
    spark.catalog.clearCache()


def test_paths_reach_as_far_as_terms_do(spark):
    a, b, c = "x" * 50, "y" * 50, "z" * 10
    every = spark.createDataFrame([(a + b + c + "w",)], "run string")
    d = spark.createDataFrame([(a, 5), (b, 5), (c, 5)], "term string, freq int")
    found = relational.paths(relational.hits(every, d, 60, 100), most=60).where("at = 0 AND w1 = 50 AND w2 = 50").collect()
    assert [r.w3 for r in found] == [10]
    words = relational.segment_runs(every, d, 60, max_bytes=100).orderBy("nth").collect()
    assert [r.surface for r in words] == [a, b, c, "w"]


@pytest.mark.parametrize("terms", [{}, {"ab": 7, "abc": 0, "b": 3, "bcd": 2, "cd": 9, "海上": 4, "海上生明月": 1, "明": 8}])
def test_hits_of_pruned_lengths_are_all_hits(spark, terms):
    texts = ["a", "abcd", "ababcdx", "海上生明月", "上海", "x海上ab"]
    runs = spark.createDataFrame([(t,) for t in texts], "run string")
    dictionary = spark.createDataFrame(list(terms.items()), "term string, freq int")
    for most, max_bytes in ((36, 36), (2, 36), (36, 6)):
        want = set()
        for t in texts:
            for at in range(len(t)):
                found = {n: terms[t[at : at + n]] for n in range(1, min(most, len(t) - at) + 1) if t[at : at + n] in terms and len(t[at : at + n].encode()) <= max_bytes}
                want.add((t, at, tuple(sorted({1, *found})), found[max(found)] if found else 1))
        got = relational.hits(runs, dictionary, most, max_bytes).collect()
        assert len(got) == len(want) and {(r.run, r["at"], tuple(r.lens), r.f) for r in got} == want
