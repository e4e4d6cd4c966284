"""Queries of sources, sinks, settings, dictionary files, the default profile over Han text and the engine object."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill import sinks
from lexmill.config import SegmentConfig
from lexmill.engine import Engine
from lexmill.functions import text as tx
from lexmill.functions.classes import fold_rules, piece_pattern
from lexmill.operators import dictionary, enrich, matcher, relational, runs
from lexmill.plans.queries import BENCH_WORDS, COMMON, HITS, LEX, NEXT, PATHS, PLAIN, SYNONYMS, THESAURUS, WALK, WORDS, _bench_words, _synonyms, common, docs, lex, lowered, query, quoted, table, with_
from lexmill.plans.scratch import shared_folder, written
from lexmill.sources import readers, settings

BENCH_COUNTS = r"SELECT term, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS term FROM benchmark) x GROUP BY term"


def _bench_counts(spark, sf_dir):
    return dictionary.count_words(table(spark, sf_dir, "benchmark"))


# --- dictionary files


def _saved(spark, built, kind, **how):
    folder = shared_folder(spark, kind)
    dictionary.save(built, folder, kind, **how)
    return readers.load_dictionary(spark, folder, kind, True)


@query(with_(LEX) + "SELECT term, freq FROM lex")
def unigram_save_load(spark, sf_dir):
    return _saved(spark, dictionary.build_unigrams(lex(spark, sf_dir)), "unigram")


@query(BENCH_COUNTS)
def keyword_save_load_gzip(spark, sf_dir):
    return _saved(spark, _bench_counts(spark, sf_dir), "kw", compression="gzip")


@query(with_(SYNONYMS) + "SELECT term, canonical FROM sy")
def synonym_save_load(spark, sf_dir):
    return _saved(spark, _synonyms(spark, sf_dir), "synonyms")


@query(with_(LEX, THESAURUS) + "SELECT term, array_to_string(related, ',') AS related FROM th")
def thesaurus_save_load(spark, sf_dir):
    return _saved(spark, dictionary.build_thesaurus(lex(spark, sf_dir)), "thesaurus").select("term", F.array_join("related", ",").alias("related"))


@query(with_(LEX) + "SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS nth, term, freq FROM lex")
def dictionary_places(spark, sf_dir):
    """Each term with its place in order of terms, by which it can be had."""
    return dictionary.numbered(lex(spark, sf_dir), written).select("nth", "term", "freq")


@query("SELECT * FROM (SELECT CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS term, CAST(p_size - 25 AS BIGINT) AS freq FROM part) x WHERE term = '' OR freq < 0")
def unigram_rejects(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return dictionary.rejects(part.select(F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_name")).alias("term"), (F.col("p_size") - 25).alias("freq")))


def _from_file(spark, records, kind, plain=False):
    folder = shared_folder(spark, "source")
    sinks.write_records(records, f"{folder}/source")
    return dictionary.build_dict(spark, kind, f"{folder}/source", folder, plain)


@query(BENCH_COUNTS)
def unigram_from_file(spark, sf_dir):
    return _from_file(spark, sinks.unigram_records(_bench_counts(spark, sf_dir)), "unigram")


@query(with_(BENCH_WORDS) + "SELECT term, CAST(1 AS BIGINT) AS freq FROM w")
def plain_terms_from_file(spark, sf_dir):
    return _from_file(spark, _bench_words(spark, sf_dir).select(F.col("term").alias("value")), "unigram", plain=True)


@query(with_(SYNONYMS) + "SELECT term, canonical FROM sy")
def synonyms_from_file(spark, sf_dir):
    return _from_file(spark, _synonyms(spark, sf_dir).select(F.concat("term", F.lit(" => "), "canonical").alias("value")), "synonyms")


@query(with_(LEX, THESAURUS)[:-1] + ", b AS (" + BENCH_COUNTS + ") SELECT term, array_to_string(related, ',') AS related FROM th WHERE term IN (SELECT term FROM b)")
def thesaurus_from_file(spark, sf_dir):
    """The thesaurus of the benchmark's words, by way of its text form."""
    built = dictionary.build_thesaurus(lex(spark, sf_dir)).join(_bench_words(spark, sf_dir), "term", "left_semi")
    return _from_file(spark, sinks.thesaurus_records(built), "thesaurus").select("term", F.array_join("related", ",").alias("related"))


# --- texts in files

LINES = "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) x WHERE line <> '' GROUP BY line"


def _lines(texts):
    return texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.col("line") != "").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(LINES)
def utf16_files(spark, sf_dir):
    """Texts written to files in UTF-16 and read back by their byte order marks."""
    folder = shared_folder(spark, "utf16")
    sinks.write_utf16(table(spark, sf_dir, "benchmark"), folder)
    return _lines(readers.read_texts(spark, f"{folder}/part-*"))


@query(LINES)
def utf8_files(spark, sf_dir):
    folder = shared_folder(spark, "utf8")
    sinks.write_text(table(spark, sf_dir, "benchmark"), folder)
    return _lines(readers.read_texts(spark, f"{folder}/part-*"))


@query("SELECT item_id, md5(text || chr(65533) || 'z' || chr(65533)) AS cleaned FROM benchmark")
def invalid_bytes(spark, sf_dir):
    """An invalid byte within a text and a truncated character at its end become replacement characters."""
    broken = F.expr("CAST(concat(CAST(text AS BINARY), X'FF', CAST('z' AS BINARY), X'E4B8') AS STRING)")
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(tx.clean(broken).cast("binary")).alias("cleaned"))


# --- settings


def _settings(spark, sf_dir):
    """A section for each region, its nations' numbers as settings."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    head = region.select((F.col("r_regionkey") * 1000).alias("line_no"), F.concat(F.lit("["), "r_name", F.lit("]")).alias("value"))
    body = nation.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("line_no"), F.concat("n_name", F.lit(" = "), F.col("n_nationkey").cast("string"), F.lit(".5")).alias("value"))
    return readers.ini_from(head.unionByName(body))


SETTINGS = "st AS (SELECT lower(r_name) AS section, lower(n_name) AS key, n_nationkey || '.5' AS value, n_nationkey AS n FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(with_(SETTINGS) + "SELECT section, key, CAST(n AS BIGINT) AS whole, n + 0.5::DOUBLE AS number, left(value, 1) = '1' AS flag FROM st")
def settings_values(spark, sf_dir):
    value = F.col("value")
    return _settings(spark, sf_dir).select("section", "key", settings.as_int(value).alias("whole"), tx.to_float(value).alias("number"), settings.as_bool(value).alias("flag"))


@query(with_(SETTINGS) + "SELECT section, key, CASE WHEN section = 'asia' THEN 'new' ELSE value END AS value FROM st WHERE section <> 'europe'")
def settings_edits(spark, sf_dir):
    old = _settings(spark, sf_dir)
    edited = settings.put(old, old.where(F.col("section") == "asia").select("section", "key", F.lit("new").alias("value")))
    return settings.unset(edited, old.where(F.col("section") == "europe").select("section", "key"))


@query("SELECT DISTINCT lower(r_name) AS section FROM region JOIN nation ON n_regionkey = r_regionkey")
def settings_sections(spark, sf_dir):
    return settings.sections(_settings(spark, sf_dir))


@query(with_(SETTINGS) + "SELECT string_agg(part, chr(10) ORDER BY part) AS text FROM (SELECT '[' || section || ']' || chr(10) || string_agg(key || ' = ' || value, chr(10) ORDER BY key || ' = ' || value) AS part FROM st GROUP BY section) x")
def settings_dump(spark, sf_dir):
    return sinks.ini_text(_settings(spark, sf_dir))


@query("SELECT lower(n_name) AS key, n_name || n_nationkey AS value FROM nation")
def settings_long_lines(spark, sf_dir):
    """Settings whose lines go on after a backslash."""
    line = F.posexplode(F.array(F.concat("n_name", F.lit(" = "), "n_name", F.lit("\\")), F.col("n_nationkey").cast("string"))).alias("k", "value")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", line).select((F.col("n_nationkey") * 2 + F.col("k")).alias("line_no"), "value")
    return readers.ini_from(rows).select("key", "value")


@query("SELECT TRUE AS merge, FALSE AS separate, '-.' AS joint, TRUE AS compress, CAST(31 AS BIGINT) AS omni")
def settings_config(spark, sf_dir):
    lines = ["[segment]", "merge_number_and_ascii = yes;", "number_and_ascii_joint = -.", "compress_space = 1", "seperate_number_ascii = no", "omni_segmentation = 0x1F"]
    got = settings.segment_config(readers.ini_from(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")))
    return spark.createDataFrame([(got.merge, got.separate, got.joint, got.compress_space, got.omni)], "merge boolean, separate boolean, joint string, compress boolean, omni long")


# --- scalar functions


@query("SELECT p_partkey, chr(CAST(19968 + p_partkey % 20000 AS INTEGER)) AS letter, CAST(strlen(chr(CAST(19968 + p_partkey % 20000 AS INTEGER))) AS BIGINT) AS bytes, left(p_name, 1) IN ('a', 'e', '-') AS joint FROM part")
def code_points(spark, sf_dir):
    letter = tx.utf8_encode(F.lit(19968) + F.col("p_partkey") % 20000)
    return table(spark, sf_dir, "part").select("p_partkey", letter.alias("letter"), F.octet_length(letter).alias("bytes"), tx.in_set(F.substring("p_name", 1, 1), "ae-").alias("joint"))


@query(r"SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS BIGINT) AS units FROM documents")
def utf16_lengths(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.utf16_units(F.col("text")).alias("units"))


@query("SELECT event_id, array_to_string(list_filter(string_split(props, ','), lambda t: t <> '')[2:], ',') AS rest, TRUE AS recent FROM events")
def tokenizer_rest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.remaining(F.col("props"), ",", 1).alias("rest"), (tx.now_millis() > 1_600_000_000_000).alias("recent"))


@query("""WITH r AS (SELECT unnest(range(65, 91)) AS src, 32 AS shift, 0 AS nth UNION ALL SELECT unnest(range(1040, 1072)), 32, 1 UNION ALL SELECT 65, -5, 2)
SELECT CAST(src AS BIGINT) AS src, CAST(arg_max(src + shift, nth) AS BIGINT) AS dst FROM r GROUP BY src""")
def fold_rule_table(spark, sf_dir):
    lines = ["# capital letters", "A..Z->a..z, U+0410..U+042F->U+0430..U+044F", "U+0041->U+003C # the last rule wins"]
    return fold_rules(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))


@query(f"""WITH p AS (SELECT unnest(regexp_extract_all(text, {quoted(piece_pattern(PLAIN.classes))})) AS piece FROM benchmark) SELECT piece, count(*) AS n FROM p GROUP BY piece""")
def spaces_stay(spark, sf_dir):
    """The setting for compressing blanks is accepted and changes nothing."""
    got = runs.pieces(table(spark, sf_dir, "benchmark").select("text"), SegmentConfig(compress_space=True))
    return got.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


# --- tokens


def tokens_sql(source: str, key: str, text: str, config: SegmentConfig, *before: str) -> str:
    """CTEs up to ``tk``: the tokens (key, k, nth, surface) of a table's texts, after ``before``, which ends with lex."""
    run = "[^\\r\\n" + config.classes.any_of("m", "e", "w") + "]+"
    piece = f"regexp_extract_all({text}, {quoted(piece_pattern(config.classes))})"
    every = f"runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all({text}, {quoted(run)})) AS run FROM {source}) x GROUP BY run)"
    pc = f"pc AS (SELECT {key}, unnest({piece}) AS piece, generate_subscripts({piece}, 1) AS k FROM {source})"
    tk = f"tk AS (SELECT {key}, k, coalesce(w.nth, 0) AS nth, piece, coalesce(w.pt, 0) AS pt, CASE WHEN w.run IS NULL THEN piece ELSE substring(piece, w.pt + 1, w.word) END AS surface FROM pc LEFT JOIN walk w ON w.run = pc.piece)"
    return with_(*before, every, HITS, PATHS, NEXT, WALK, pc, tk, recursive=True)


BENCH_TOKENS = tokens_sql("benchmark", "item_id", "lower(text)", WORDS, COMMON)


def _bench(spark, sf_dir):
    return lowered(spark, sf_dir, "benchmark").select("item_id", "text")


@query(BENCH_TOKENS + "SELECT item_id, md5(string_agg(CASE surface WHEN chr(10) THEN chr(10) WHEN chr(13) THEN '' ELSE surface || '/x ' END, '' ORDER BY k, nth)) AS shown FROM tk GROUP BY item_id")
def marked_texts(spark, sf_dir):
    tokens = matcher.segment(_bench(spark, sf_dir), matcher.collect_lexicon(common(spark, sf_dir)), WORDS)
    return sinks.marked_text(tokens, ["item_id"]).select("item_id", F.md5(F.col("text").cast("binary")).alias("shown"))


@query(BENCH_TOKENS + "SELECT item_id, CAST(row_number() OVER o - 1 AS BIGINT) AS pos, surface, CAST(3 + sum(strlen(surface)) OVER (o ROWS UNBOUNDED PRECEDING) - strlen(surface) AS BIGINT) AS start_byte FROM tk WINDOW o AS (PARTITION BY item_id ORDER BY k, nth)")
def offsets_after_mark(spark, sf_dir):
    """Offsets count the bytes of a leading byte order mark."""
    marked = _bench(spark, sf_dir).withColumn("text", F.concat(F.lit(tx.BOM), "text"))
    got = matcher.segment(marked, matcher.collect_lexicon(common(spark, sf_dir)), WORDS, details=True)
    return got.select("item_id", "pos", "surface", "start_byte")


KIND = f"CASE WHEN left(piece, 1) IN (chr(13), chr(10)) THEN 'newline' WHEN regexp_matches(left(piece, 1), {quoted('[' + WORDS.classes.w + ']')}) THEN 'separator' WHEN regexp_matches(left(piece, 1), {quoted('[' + WORDS.classes.m + ']')}) THEN 'number' ELSE 'word' END"


@query(BENCH_TOKENS[:-1] + f""", kd AS (SELECT item_id, k, {KIND} AS kind FROM pc), bf AS (SELECT *, lag(kind) OVER (PARTITION BY item_id ORDER BY k) AS before FROM kd),
ck AS (SELECT *, sum(CASE WHEN before IS NULL OR before = 'word' OR kind = 'separator' AND before = 'number' THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY k) AS chunk FROM bf)
SELECT tk.item_id, CAST(row_number() OVER (PARTITION BY tk.item_id ORDER BY tk.k, nth) - 1 AS BIGINT) AS pos, kind, CAST(chunk AS BIGINT) AS chunk FROM tk JOIN ck ON ck.item_id = tk.item_id AND ck.k = tk.k""")
def token_chunks(spark, sf_dir):
    got = matcher.segment(_bench(spark, sf_dir), matcher.collect_lexicon(common(spark, sf_dir)), WORDS, details=True)
    return got.select("item_id", "pos", "kind", "chunk")


PLACED = "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY k, nth) - 1 AS BIGINT) AS pos, surface FROM tk"


@query(BENCH_TOKENS + PLACED)
def segment_by_joins(spark, sf_dir):
    """The tokens of texts by the form for dictionaries of any size."""
    return relational.segment_rows(_bench(spark, sf_dir), written(common(spark, sf_dir), "common"), WORDS, keep=written)


@query(BENCH_TOKENS + PLACED)
def segment_in_sql(spark, sf_dir):
    """The tokens by the engine's table function, its dictionary saved and loaded."""
    folder = shared_folder(spark, "engine")
    dictionary.save(common(spark, sf_dir), folder, "unigram")
    Engine.load(spark, folder, WORDS).register_sql("segment_words_of")
    return spark.sql("SELECT item_id, pos, surface FROM {rows}, LATERAL segment_words_of(text)", rows=_bench(spark, sf_dir))


@query("SELECT p_partkey, (SELECT arg_min(x.p_type, x.p_partkey) FROM part x WHERE x.p_name = part.p_name) || '|' || array_to_string(string_split(p_brand, ''), '|') AS tokens FROM part")
def synonym_rewrite_long(spark, sf_dir):
    """Keys over as many tokens as they have characters."""
    part = table(spark, sf_dir, "part")
    tokens = part.select("p_partkey", F.posexplode(F.filter(F.split(F.concat("p_name", "p_brand"), ""), lambda c: c != "")).alias("pos", "surface"))
    got = enrich.rewrite_synonyms(tokens, _synonyms(spark, sf_dir), ["p_partkey"])
    return sinks.token_lists(got, ["p_partkey"]).select("p_partkey", F.array_join("tokens", "|").alias("tokens"))


# --- the default profile over Han text

HAN_TEXTS = [
    "北京大学生活动中心在海淀区", "研究生命起源的科学家来到南京市长江大桥,拍了120张照片。", "他说的确实在理abc123\n第二行:三十五个人", "结婚的和尚未结婚的都来了!", "数据库系统概论 第5版", "", "美国会通过对台售武法案？", "乒乓球拍卖完了",
]
HAN_TERMS = {
    "北京": 900, "大学": 800, "北京大学": 500, "大学生": 300, "学生": 700, "生活": 650, "活动": 620, "动中": 1, "中心": 400, "海淀": 60, "海淀区": 50, "研究": 700, "研究生": 300, "生命": 450, "命起": 1, "起源": 120, "科学": 600, "科学家": 200, "学家": 20,
    "来到": 300, "南京": 350, "南京市": 200, "市长": 260, "长江": 240, "江大桥": 1, "大桥": 180, "长江大桥": 70, "照片": 150, "的确": 210, "确实": 230, "实在": 220, "在理": 15, "结婚": 130, "和尚": 90, "尚未": 110, "都来": 5, "数据": 500, "数据库": 260, "据库": 1, "系统": 480, "概论": 40,
    "美国": 800, "国会": 330, "会通": 2, "通过": 560, "对台": 30, "售武": 8, "法案": 75, "乒乓": 66, "乒乓球": 64, "球拍": 33, "拍卖": 44, "卖完": 6, "第二": 310, "二行": 1, "的": 9000, "了": 8000, "在": 7000, "和": 6000, "都": 2000, "人": 3000, "来": 2500, "说": 2600, "他": 4000,
}
HAN_SYNONYMS = {"北京大学": "北大", "长江大桥": "大桥", "研究": "探究", "乒乓球拍卖完": "售罄", "数据库系统": "资料库", "结婚的和": "婚"}
HAN_THESAURUS = {"科学家": ["科学", "学家"], "探究": ["钻研"], "南京市": ["南京", "金陵"]}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


HAN = [
    "docs AS (SELECT CAST(c0 AS BIGINT) AS doc_id, replace(c1, '<br>', chr(10)) AS text FROM (VALUES " + _values((i, t.replace("\n", "<br>")) for i, t in enumerate(HAN_TEXTS)) + ") v(c0, c1))",
    "lex AS (SELECT c0 AS term, CAST(c1 AS BIGINT) AS freq FROM (VALUES " + _values(HAN_TERMS.items()) + ") v(c0, c1))",
]
HAN_TOKENS = tokens_sql("docs", "doc_id", "text", PLAIN, *HAN)


def _han(spark) -> tuple[Engine, object]:
    unigram = spark.createDataFrame(list(HAN_TERMS.items()), "term string, freq int")
    synonyms = spark.createDataFrame(list(HAN_SYNONYMS.items()), "term string, canonical string")
    thesaurus = spark.createDataFrame(list(HAN_THESAURUS.items()), "term string, related array<string>")
    return Engine(spark, unigram, unigram.where(F.col("freq") >= 300), None, synonyms, thesaurus), readers.in_memory(spark, HAN_TEXTS)


@query(HAN_TOKENS + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, nth) - 1 AS BIGINT) AS pos, surface FROM tk")
def han_segment(spark, sf_dir):
    """Han text, numbers, letters and marks by the default profile."""
    engine, texts = _han(spark)
    return engine.segment_frame(texts)


HAN_MORE = """,
at_ AS (SELECT *, CAST(row_number() OVER o - 1 AS BIGINT) AS pos, sum(length(surface)) OVER (o ROWS UNBOUNDED PRECEDING) - length(surface) AS c0, sum(strlen(surface)) OVER (o ROWS UNBOUNDED PRECEDING) - strlen(surface) AS start_byte FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY k, nth)),
sy AS (SELECT c0 AS term, c1 AS canonical FROM (VALUES """ + _values(HAN_SYNONYMS.items()) + """) v(c0, c1)),
sp AS (SELECT a.doc_id, a.pos, b.pos - a.pos + 1 AS n, sy.canonical, sy.term FROM at_ a JOIN at_ b ON b.doc_id = a.doc_id AND b.pos >= a.pos JOIN docs d ON d.doc_id = a.doc_id JOIN sy ON sy.term = substring(d.text, CAST(a.c0 AS BIGINT) + 1, CAST(b.c0 + length(b.surface) - a.c0 AS BIGINT))),
bs AS (SELECT doc_id, pos, max(n) AS n, arg_max(canonical, n) AS canonical, arg_max(term, n) AS term FROM sp GROUP BY doc_id, pos),
go_ AS (SELECT a.doc_id, a.pos, coalesce(bs.n, 1) AS n FROM at_ a LEFT JOIN bs ON bs.doc_id = a.doc_id AND bs.pos = a.pos WHERE a.pos = 0
  UNION ALL SELECT a.doc_id, a.pos, coalesce(bs.n, 1) FROM go_ g JOIN at_ a ON a.doc_id = g.doc_id AND a.pos = g.pos + g.n LEFT JOIN bs ON bs.doc_id = a.doc_id AND bs.pos = a.pos),
wd AS (SELECT a.doc_id, a.start_byte, strlen(coalesce(bs.term, a.surface)) AS byte_len, coalesce(bs.canonical, a.surface) AS surface, 'word' AS kind, bs.term IS NOT NULL AS is_synonym
  FROM go_ g JOIN at_ a ON a.doc_id = g.doc_id AND a.pos = g.pos LEFT JOIN bs ON bs.doc_id = a.doc_id AND bs.pos = a.pos)"""


@query(HAN_TOKENS[:-1] + HAN_MORE + " SELECT doc_id, CAST(start_byte AS BIGINT) AS start_byte, CAST(byte_len AS BIGINT) AS byte_len, surface, is_synonym FROM wd")
def han_synonyms(spark, sf_dir):
    """The engine's words with synonyms in place of all the tokens that they stand for."""
    engine, texts = _han(spark)
    return engine.everything(texts, ["doc_id"]).where(F.col("kind") == "word").drop("kind")


@query(HAN_TOKENS[:-1] + HAN_MORE + """,
pb AS (SELECT doc_id, k, piece, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY k) - strlen(piece) AS b0 FROM pc),
rp AS (SELECT s.* FROM s JOIN walk w ON w.run = s.run AND w.pt = s.pt),
laid AS (SELECT run, pt AS start, w1 AS len, f1 AS f FROM rp UNION ALL SELECT run, pt + w1, w2, f2 FROM rp WHERE w2 IS NOT NULL UNION ALL SELECT run, pt + w1 + w2, w3, f3 FROM rp WHERE w3 IS NOT NULL),
om AS (SELECT DISTINCT l.run, l.start, l.len, 'omni' AS kind FROM laid l LEFT JOIN walk w ON w.run = l.run AND w.pt = l.start AND w.word = l.len WHERE l.f >= 2 AND w.run IS NULL
  UNION ALL SELECT c.run, c.pt, c.len, 'keyword' FROM cut c JOIN lex k ON k.term = substring(c.run, c.pt + 1, c.len) AND k.freq >= 300 LEFT JOIN walk w ON w.run = c.run AND w.pt = c.pt AND w.word = c.len WHERE w.run IS NULL),
th AS (SELECT c0 AS term, string_split(c1, ',') AS related FROM (VALUES """ + _values((k, ",".join(v)) for k, v in HAN_THESAURUS.items()) + """) v(c0, c1)),
al AS (SELECT * FROM wd
  UNION ALL SELECT pb.doc_id, b0 + strlen(substring(piece, 1, start)), strlen(substring(piece, start + 1, len)), substring(piece, start + 1, len), kind, FALSE FROM pb JOIN om ON om.run = pb.piece
  UNION ALL SELECT doc_id, start_byte, byte_len, unnest(related), 'thesaurus', FALSE FROM wd JOIN th ON th.term = wd.surface)
SELECT doc_id, CAST(start_byte AS BIGINT) AS start_byte, CAST(byte_len AS BIGINT) AS byte_len, surface, kind, is_synonym FROM al""")
def han_everything(spark, sf_dir):
    """All that the engine gives: words, sub-words, keywords and related terms with byte offsets."""
    engine, texts = _han(spark)
    return engine.everything(texts, ["doc_id"])
