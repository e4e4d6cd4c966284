"""Sources, dictionaries, lookups, settings, sinks, the facade and the command line."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as settings_
from hypothesis import strategies as st

from lexmill import cli, sinks
from lexmill.engine import Engine
from lexmill.functions import classes, text as tx
from lexmill.operators import dictionary, enrich, lookup
from lexmill.config import SegmentConfig
from lexmill.sources import readers, settings
from pyspark.sql import functions as F


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_unigram_records(spark, tmp_path):
    assert rows(readers.unigrams_from(lines(spark, "abc\t3", "n:2", "d", "n:1", "e\tx", "n"))) == [("abc", 3), ("d", 0), ("e", 0)]
    (tmp_path / "u.txt").write_bytes("﻿中\t7\r\nx:7\r\nb\t2\r\nx:2\r\n".encode())
    assert rows(readers.read_unigrams(spark, str(tmp_path / "u.txt"))) == [("b", 2), ("中", 7)]
    assert rows(readers.read_unigrams(spark, str(tmp_path / "u.txt"), plain=True)) == [("b\t2", 1), ("x:2", 1), ("x:7", 1), ("中\t7", 1)]


def test_synonym_rules(spark):
    got = readers.synonyms_from(lines(spark, "// note", "c# =>", ".net => dotnet", "c#\t=> csharp", "c++ => cplusplus", ".net => other", "a=>", "no rule here", " => x"))
    assert rows(got) == [(".net", "dotnet"), ("c#", "csharp"), ("c++", "cplusplus")]
    assert rows(readers.synonyms_from(lines(spark, "﻿ a => b "))) == [("a", "b")]


def test_thesaurus_rules(spark):
    assert [(r.term, r.related) for r in readers.thesaurus_from(lines(spark, "k", "-x,y,", "l", "-z")).orderBy("term").collect()] == [("k", ["x", "y"]), ("l", ["z"])]
    terms = spark.createDataFrame([("ab",), ("bc",), ("abc",), ("a",)], "term string")
    assert [(r.term, r.related) for r in dictionary.build_thesaurus(terms).collect()] == [("abc", ["ab", "bc"])]


def test_building(spark):
    records = spark.createDataFrame([("x", 5), ("x", 7), ("y", 1), (None, 3)], "term string, freq int")
    built = dictionary.build_unigrams(records)
    assert rows(built) == [("x", 7), ("y", 1)]
    assert dictionary.verify(built, records).count() == 0
    assert rows(dictionary.statistics(built)) == [(2, 2, 2, 1)]
    with pytest.raises(Exception, match="empty or its count negative"):
        dictionary.build_unigrams(spark.createDataFrame([("a", -1)], "term string, freq int")).collect()
    first = spark.createDataFrame([(1, "x", 5), (2, "x", 7)], "line_no long, term string, freq int")
    assert rows(dictionary.merge_priority(first, spark.createDataFrame([("x",), ("y",)], "term string"))) == [("x", 5), ("y", 1)]
    assert [r.term for r in dictionary.in_order(spark.createDataFrame([("é", 1), ("z", 1), ("a", 1)], "term string, freq int")).collect()] == ["a", "z", "é"]


def test_lookups(spark):
    d = spark.createDataFrame([("ab", 3), ("abc", 150), ("z", 0)], "term string, freq int")
    w = spark.createDataFrame([("ab",), ("abc",), ("a",), ("q",), ("z",)], "term string")
    assert rows(lookup.exact(w, d)) == [("a", -1), ("ab", 3), ("abc", 150), ("q", -1), ("z", 0)]
    assert rows(lookup.is_keyword(w, d)) == [("a", False), ("ab", True), ("abc", True), ("q", False), ("z", False)]
    assert rows(lookup.is_keyword(w, None))[0] == ("a", False)
    assert rows(lookup.word_weight(w, d)) == [("a", 100), ("ab", 3), ("abc", 100), ("q", 100), ("z", 100)]
    assert rows(lookup.word_weight(w, None)) == [("a", 1), ("ab", 2), ("abc", 3), ("q", 1), ("z", 1)]
    assert rows(lookup.is_prefix(w, d)) == [("a", -1), ("ab", 3), ("abc", 150), ("q", -2), ("z", 0)]
    t = spark.createDataFrame([("abcd",)], "word string")
    assert rows(lookup.prefix_hits(t, d, "word", 36).select("term", "len", "freq")) == [("ab", 2, 3), ("abc", 3, 150)]
    syn = spark.createDataFrame([("ab", "S"), ("abc", "L")], "term string, canonical string")
    assert rows(lookup.longest_prefix(spark.createDataFrame([(1, "abcd"), (2, "x")], "id long, text string"), syn, "id", "text", 64)) == [(1, "abc", "L")]
    assert rows(lookup.canonical(w, syn))[:2] == [("a", None), ("ab", "S")]
    th = spark.createDataFrame([("ab", ["x", "y", "", "z"])], "term string, related array<string>")
    assert rows(lookup.related(w, th)) == [("ab", 0, "x"), ("ab", 1, "y")]


def test_prefixes_are_not_broadcast(spark):
    """Spark takes exploded rows for as small as their source; 1.2 million rows' prefixes are too many for a driver."""
    texts = [(i, "abcdefgh"[: i % 9] + "x" * (i % 70)) for i in range(300)]
    syn = [("a", "1"), ("abc", "2"), ("abcd", "3"), ("x" * 64, "4"), ("x" * 65, "5"), ("", "6")]
    got = lookup.longest_prefix(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(syn, "term string, canonical string"), "id", "text", 64)
    want = [(i, *max((s for s in syn if t.startswith(s[0]) and 0 < len(s[0]) <= 64), key=lambda s: len(s[0]), default=(None, None))) for i, t in texts]
    assert rows(got) == [w for w in want if w[1]]
    hits = lookup.prefix_hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([("ab", 3)], "term string, freq int"), "text", 36)
    for df in (got, hits):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_settings(spark):
    got = readers.ini_from(lines(spark, "# c", "[Main]", "merge_number_and_ascii=1;", "number_and_ascii_joint = -;", "seperate_number_ascii='no' ", "omni_segmentation=0x1F ; hex", "omni_segmentation = 5", 'Quoted = "a;b"', "[other]", "k = 010"))
    assert settings.get(got, "main", "quoted") == "a;b"
    assert settings.get_int(got, "other", "k") == 8
    assert settings.get_double(got, "other", "k") == 10.0
    assert settings.segment_config(got) == SegmentConfig(merge=True, joint="-", separate=False, omni=5)
    assert settings.segment_config(None) == SegmentConfig()
    assert rows(settings.sections(got)) == [("main",), ("other",)]
    more = settings.put(got, spark.createDataFrame([("other", "k", "1")], "section string, key string, value string"))
    assert settings.get(more, "other", "k") == "1" and settings.get_bool(more, "other", "k")
    assert settings.unset(more, spark.createDataFrame([("other", "k")], "section string, key string")).where("section = 'other'").count() == 0
    assert readers.ini_from(lines(spark, *sinks.ini_text(more).first().text.split("\n"))).count() == more.count()


def test_fold(spark):
    t = spark.createDataFrame([("ＡＢｃ９《x》〈〉、",)], "t string")
    assert t.select(classes.fold(F.col("t"))).first()[0] == "abc9<x><>,"
    rules = lines(spark, "A->a, U+0042->U+0062 # note", "C..E->c..e", "A->z")
    assert rows(classes.fold_rules(rules)) == [(65, 122), (66, 98), (67, 99), (68, 100), (69, 101)]
    assert (48, 57, "m") in classes.class_ranges(classes.default_classes())


def test_text_functions(spark):
    df = spark.createDataFrame([(",a,,b,", "中é😀", 20013, "12x")], "s string, u string, c int, n string")
    s, u = F.col("s"), F.col("u")
    got = df.select(tx.tokens(s, ","), tx.count_tokens(s, ","), tx.nth_token(s, ",", 2), tx.nth_token(s, ",", 3), tx.remaining(s, ",", 1), tx.utf8_encode(F.col("c")), tx.utf8_decode(u), tx.utf8_decode_length(u), tx.utf8_length(u), tx.utf16_units(u), tx.to_int(F.col("n")), tx.to_float(F.col("n")), tx.trimmed(F.lit("\t x ")), tx.bit_count(F.lit(65535)), tx.clean(F.lit("﻿a\x00b"))).first()
    assert list(got) == [["a", "b"], 2, "b", None, "b", "中", 20013, 3, 3, 4, 12, 12.0, "x", 16, "a"]
    assert df.select(tx.substrings(F.lit("abc"))).first()[0] == ["ab", "abc", "bc"]
    assert df.select(tx.substrings(F.lit("a"))).first()[0] == []


def test_texts_in_utf16(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿中文".encode("utf-16-le"))
    (tmp_path / "b.txt").write_bytes("﻿中文".encode())
    assert {r.text for r in readers.read_texts(spark, str(tmp_path / "*.txt")).collect()} == {"中文"}
    assert readers.in_memory(spark, ["x"]).first().text == "x"


@pytest.fixture
def folder(spark, tmp_path):
    terms = "".join(f"{t}\t1\nx:1\n" for t in [*"中国人上海市", "中国", "国人", "中国人", "上海", "上海市"])
    (tmp_path / "u.txt").write_text(terms)
    (tmp_path / "s.txt").write_text("// s\n上海市 => 沪\n")
    (tmp_path / "t.txt").write_text("中国人\n-中国,国人,\n")
    for kind, f in (("unigram", "u.txt"), ("synonyms", "s.txt"), ("thesaurus", "t.txt"), ("kw", "u.txt")):
        assert dictionary.build_dict(spark, kind, str(tmp_path / f), str(tmp_path / "d")) is not None
    assert dictionary.build_dict(spark, "nothing", "x", "y") is None
    return tmp_path


def test_records_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("中国", 3), ("b", 1)], "term string, freq int")
    sinks.write_records(sinks.unigram_records(d), str(tmp_path / "u"))
    assert rows(readers.read_unigrams(spark, str(tmp_path / "u"))) == [("b", 1), ("中国", 3)]
    t = spark.createDataFrame([("k", ["x", "y"]), ("a", ["z"])], "term string, related array<string>")
    sinks.write_records(sinks.thesaurus_records(t), str(tmp_path / "t"))
    assert sorted((r.term, r.related) for r in readers.read_thesaurus(spark, str(tmp_path / "t")).collect()) == [("a", ["z"]), ("k", ["x", "y"])]
    sinks.write_text(sinks.marked_text(spark.createDataFrame([(1, 0, "x")], "doc_id long, pos int, surface string"), ["doc_id"]), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().value == "x/x "
    wide = spark.createDataFrame([("中",)], "s string").select(sinks.encoded(F.col("s")), sinks.encoded(F.col("s"), "UTF-8")).first()
    assert bytes(wide[0]).decode("utf-16") == "中" and bytes(wide[1]) == "\ufeff中".encode()


def test_engine(spark, folder):
    e = Engine.load(spark, str(folder / "d"))
    assert e.segment("中国人上海市x1") == ["中国人", "沪", "x", "1"]
    assert e.thesaurus("中国人") == ["中国", "国人"] and e.thesaurus("没有") == []
    assert e.is_keyword("中国") and not e.is_keyword("x")
    assert e.word_weight("中国") == 6
    assert list(e.cursor("中国人a")) == [("中国人", 0, 9), ("a", 9, 10)]
    got = e.everything(readers.in_memory(spark, ["中国人上海市"]), ["doc_id"])
    kinds = {(r.start_byte, r.byte_len, r.surface, r.kind, r.is_synonym) for r in got.collect()}
    assert {(0, 9, "中国人", "word", False), (9, 9, "沪", "word", True), (0, 9, "中国", "thesaurus", False), (0, 6, "中国", "keyword", False)} <= kinds
    e.register_sql("segment_zh")
    assert [r.surface for r in spark.sql("SELECT surface FROM VALUES ('中国人上海市') AS t(x), LATERAL segment_zh(x) ORDER BY pos").collect()] == ["中国人", "上海市"]
    with pytest.raises(readers.DictionaryError) as missing:
        Engine.load(spark, str(folder / "none"))
    assert missing.value.code == -1
    spark.range(1).write.parquet(str(folder / "bad" / "unigram"))
    with pytest.raises(readers.DictionaryError) as bad:
        Engine.load(spark, str(folder / "bad"))
    assert bad.value.code == -3


def test_command_line(spark, folder, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["-u", str(folder / "u.txt"), "-o", str(folder / "o")]) == 0
    (folder / "x.txt").write_text("中国人\n上海市")
    assert cli.main(["-d", str(folder / "o"), str(folder / "x.txt")]) == 0
    out = capsys.readouterr().out
    assert "中国人/x \n上海市/x " in out and "ms." in out
    assert cli.main([]) == 2


def test_synonyms_span_tokens(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "c", "a", "b"])], "doc_id long, pos int, surface string")
    syn = spark.createDataFrame([("ab", "AB"), ("bc", "BC"), ("b", "B")], "term string, canonical string")
    got = enrich.rewrite_synonyms(tokens, syn, ["doc_id"]).orderBy("pos").collect()
    assert [(r.pos, r.surface, r.source, r.is_synonym) for r in got] == [(0, "AB", "ab", True), (2, "c", "c", False), (3, "AB", "ab", True)]
    long = spark.createDataFrame([("abcab", "WHOLE"), ("cab", "CAB"), ("bc", "BC")], "term string, canonical string")
    got = enrich.rewrite_synonyms(tokens, long, ["doc_id"]).collect()
    assert [(r.pos, r.surface, r.source, r.is_synonym, r.n_tokens) for r in got] == [(0, "WHOLE", "abcab", True, 5)]
    assert enrich.rewrite_synonyms(tokens, syn.limit(0), ["doc_id"]).count() == 5
    th = spark.createDataFrame([("a", ["p"])], "term string, related array<string>")
    assert enrich.with_thesaurus(tokens, th, ["doc_id"]).where("kind = 'thesaurus'").count() == 2
    assert sinks.token_lists(tokens, ["doc_id"]).first().tokens == ["a", "b", "c", "a", "b"]


@settings_(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab", min_size=1, max_size=2), max_size=12), min_size=1, max_size=6), st.dictionaries(st.text("ab", min_size=1, max_size=6), st.text("XYZ", min_size=1, max_size=2), max_size=8))
def test_synonyms_equal_a_walk(spark, docs, syn):
    tokens = spark.createDataFrame([(d, i, t) for d, words in enumerate(docs) for i, t in enumerate(words)], "doc_id long, pos int, surface string")
    want = []
    for d, words in enumerate(docs):
        i = 0
        while i < len(words):
            n = next((n for n in range(len(words) - i, 0, -1) if "".join(words[i : i + n]) in syn), 0)
            source = "".join(words[i : i + max(n, 1)])
            want.append((d, i, syn[source] if n else source, source, n > 0, max(n, 1)))
            i += max(n, 1)
    got = enrich.rewrite_synonyms(tokens, spark.createDataFrame(list(syn.items()), "term string, canonical string"), ["doc_id"])
    assert rows(got) == sorted(want)


def test_versions_and_optional_dictionaries(spark, tmp_path):
    d = spark.createDataFrame([("b", 1), ("a", 2)], "term string, freq int")
    dictionary.save(d, str(tmp_path), "unigram")
    assert [r.term for r in readers.load_dictionary(spark, str(tmp_path), "unigram").collect()] == ["a", "b"]
    dictionary.save(d, str(tmp_path), "kw", version=readers.VERSION + 1)
    with pytest.raises(readers.DictionaryError) as newer:
        readers.load_dictionary(spark, str(tmp_path), "kw")
    assert newer.value.code == -2
    spark.range(1).write.parquet(str(tmp_path / "synonyms"))
    with pytest.warns(UserWarning, match="left out"):
        e = Engine.load(spark, str(tmp_path))
    assert e.kw is None and e.synonyms is None and e.segment("ab") == ["ab"]


def test_large_dictionaries_are_joined(spark, monkeypatch):
    from lexmill.operators import matcher

    d = spark.createDataFrame([("中国", 1), ("国人", 2)], "term string, freq int")
    e, docs = Engine(spark, d), readers.in_memory(spark, ["中国人", "x"])
    small = rows(e.segment_frame(docs))
    monkeypatch.setattr(matcher, "too_large", lambda *_: True)
    assert rows(e.segment_frame(docs)) == small


def test_ini_lines_go_on(spark):
    got = readers.ini_from(lines(spark, "[a]", "k = one \\", "two\\  ", " three ; note", "j = 1"))
    assert rows(got) == [("a", "j", "1"), ("a", "k", "one two three")]


def test_no_machine_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from lexmill.plans import scratch

    def session(master, folder=None):
        get = lambda name, default=None: folder
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)))

    before = list(scratch._LEFT)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_folder(session(master), "x")
        assert scratch.shared_folder(session(master, "s3a://bucket/"), "x").startswith("s3a://bucket/lexmill-x-")
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert scratch.shared_folder(session(master), "x").startswith("file:///")
    scratch._LEFT[:] = before
