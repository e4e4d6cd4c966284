"""Queries over the driver's tables, each an operator of the engine, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import sinks
from lexmill.config import SegmentConfig
from lexmill.functions import text as tx
from lexmill.functions.classes import FOLD_FROM, FOLD_TO, fold, letters_as_words, me_pattern, piece_pattern
from lexmill.operators import dictionary, enrich, kernel, lookup, matcher, relational, runs
from lexmill.plans.scratch import shared_folder, written
from lexmill.session import spread
from lexmill.sources import readers
from lexmill.streaming.segment import segment_folder

WORDS = SegmentConfig(classes=letters_as_words())
PLAIN = SegmentConfig()
MOST = 36

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, as the SQL forms have them."""
    return df.select(*[F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lowered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select("*").withColumn("text", F.lower("text"))


def lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents."""
    return dictionary.lexicon(docs(spark, sf_dir))


def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher's dictionary: words seen five times, so that rarer ones have to be cut."""
    return dictionary.lexicon(docs(spark, sf_dir), min_count=5)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LEX = r"""lex AS (SELECT term, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS term FROM documents) x
  WHERE strlen(term) <= 36 GROUP BY term)"""
COMMON = LEX[:-1] + " HAVING count(*) >= 5)"
RUN = "[^\\r\\n" + WORDS.classes.any_of("m", "e", "w") + "]+"


def runs_sql(name: str) -> str:
    return f"runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {quoted(RUN)})) AS run FROM {name}) x GROUP BY run)"


HITS = """pos AS (SELECT run, unnest(range(0, length(run))) AS pt FROM runs),
cut AS (SELECT run, pt, unnest(range(1, least(length(run) - pt, 36) + 1)) AS len FROM pos),
found AS (SELECT c.run, c.pt, c.len, lex.freq FROM cut c JOIN lex ON lex.term = substring(c.run, c.pt + 1, c.len)),
every AS (SELECT run, pt, len, freq FROM found UNION ALL SELECT run, pt, 1, NULL FROM pos),
h AS (SELECT run, pt, list_sort(list(DISTINCT len)) AS lens, coalesce(arg_max(freq, len) FILTER (WHERE freq IS NOT NULL), 1) AS f FROM every GROUP BY run, pt)"""
PATHS = """p1 AS (SELECT run, pt, f, unnest(lens) AS w1, generate_subscripts(lens, 1) - 1 AS i FROM h),
p1b AS (SELECT p1.*, h2.lens AS l2, h2.f AS g2 FROM p1 LEFT JOIN h h2 ON h2.run = p1.run AND h2.pt = p1.pt + p1.w1 AND p1.pt + p1.w1 < length(p1.run) - 1),
p2 AS (SELECT run, pt, i, w1, CASE WHEN i = 0 THEN f ELSE 0 END AS f1, l2, g2, unnest(coalesce(l2, [NULL::BIGINT])) AS w2, generate_subscripts(coalesce(l2, [NULL::BIGINT]), 1) - 1 AS j FROM p1b),
p2b AS (SELECT p2.*, CASE WHEN w2 IS NULL THEN NULL WHEN j = 0 THEN g2 ELSE 1 END AS f2, h3.lens AS l3, h3.f AS g3
        FROM p2 LEFT JOIN h h3 ON h3.run = p2.run AND h3.pt = p2.pt + p2.w1 + p2.w2 AND p2.pt + p2.w1 + p2.w2 < length(p2.run) - 1),
p3 AS (SELECT run, pt, i, j, w1, w2, list_max(l3) AS w3, f1, f2, CASE WHEN l3 IS NULL THEN NULL WHEN len(l3) = 1 THEN g3 ELSE 1 END AS f3 FROM p2b),
b AS (SELECT *, strlen(substring(run, pt + 1, w1)) AS b1, strlen(substring(run, pt + 1 + w1, coalesce(w2, 0))) AS b2, strlen(substring(run, pt + 1 + w1 + coalesce(w2, 0), coalesce(w3, 0))) AS b3 FROM p3),
s AS (SELECT *, b1 + b2 + b3 AS total, 1 + (w2 IS NOT NULL)::INT + (w3 IS NOT NULL)::INT AS words, b1 * b1 + b2 * b2 + b3 * b3 AS squares,
             round(ln(f1 + 1.0::DOUBLE) + coalesce(ln(f2 + 1.0::DOUBLE), 0) + coalesce(ln(f3 + 1.0::DOUBLE), 0), 9) AS score FROM b)"""
NEXT = """nx AS (SELECT run, pt, w1 AS word FROM (SELECT *, row_number() OVER (PARTITION BY run, pt ORDER BY total DESC, words, squares, score DESC, i, j) AS rn FROM s) x WHERE rn = 1)"""
WALK = """walk AS (SELECT run, pt, word, 0 AS nth FROM nx WHERE pt = 0 UNION ALL SELECT w.run, n.pt, n.word, w.nth + 1 FROM walk w JOIN nx n ON n.run = w.run AND n.pt = w.pt + w.word)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n"


# --- pieces and classes


def _class_sql(body: str) -> str:
    return f"CAST(coalesce(sum(len(regexp_extract_all(text, {quoted('[' + body + ']')}))), 0) AS BIGINT)"


@query(f"SELECT lang, {_class_sql(PLAIN.classes.m)} AS numbers, {_class_sql(PLAIN.classes.e)} AS letters, {_class_sql(PLAIN.classes.w)} AS separators, {_class_sql(chr(92) + 'r' + chr(92) + 'n')} AS line_ends, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY lang")
def class_counts(spark, sf_dir):
    return runs.class_counts(docs(spark, sf_dir), PLAIN, "lang")


@query(f"""WITH p AS (SELECT lang, unnest(regexp_extract_all(text, {quoted(piece_pattern(PLAIN.classes))})) AS piece FROM documents),
k AS (SELECT lang, piece, CASE WHEN left(piece, 1) IN (chr(13), chr(10)) THEN 'newline' WHEN regexp_matches(left(piece, 1), {quoted('[' + PLAIN.classes.w + ']')}) THEN 'separator'
  WHEN regexp_matches(left(piece, 1), {quoted('[' + PLAIN.classes.m + ']')}) THEN 'number' WHEN regexp_matches(left(piece, 1), {quoted('[' + PLAIN.classes.e + ']')}) THEN 'letter' ELSE 'run' END AS kind FROM p)
SELECT lang, kind, count(*) AS n, CAST(sum(strlen(piece)) AS BIGINT) AS bytes FROM k GROUP BY lang, kind""")
def run_split(spark, sf_dir):
    got = runs.pieces(docs(spark, sf_dir).select("lang", "text"), PLAIN)
    return got.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("piece")).alias("bytes"))


@query(f"SELECT sep, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {quoted('[' + PLAIN.classes.w + ']')})) AS sep FROM documents) x GROUP BY sep")
def sep_tokens(spark, sf_dir):
    got = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(tx.clean(F.col("text")), F.lit(f"[{PLAIN.classes.w}]"), F.lit(0))).alias("sep"))
    return got.groupBy("sep").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT source, CAST(sum(len(regexp_extract_all(text, '[\r\n]'))) AS BIGINT) AS n FROM documents GROUP BY source")
def newline_tokens(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.sum(F.regexp_count(tx.clean(F.col("text")), F.lit(r"[\r\n]"))).alias("n"))


def _me(name: str, **how) -> None:
    config = SegmentConfig(**how)
    pattern = me_pattern(config.classes, config.merge, config.separate, config.joint)

    def me(spark, sf_dir):
        return runs.letter_digit_runs(docs(spark, sf_dir), config)

    me.__name__ = name
    query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {quoted(pattern)})) AS token FROM documents) x GROUP BY token")(me)


_me("me_default")
_me("me_merge", merge=True)
_me("me_separate", separate=True)
_me("me_joint", joint="-'@")
_me("me_merge_joint", merge=True, joint="-.")


# --- dictionaries


@query(r"SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS term FROM documents) x GROUP BY term")
def unigram_build(spark, sf_dir):
    return dictionary.build_unigrams(dictionary.count_words(docs(spark, sf_dir)))


def _record_lines(spark, sf_dir):
    """Two-line records of the part names with their sizes, as lines of a file."""
    part = table(spark, sf_dir, "part")
    line = F.posexplode(F.array(F.concat("p_name", F.lit("\t"), F.col("p_size").cast("string")), F.lit("x:1"))).alias("k", "value")
    return part.select("p_partkey", line).select((F.col("p_partkey") * 2 + F.col("k")).alias("line_no"), "value")


@query("SELECT p_name AS term, CAST(max(p_size) AS BIGINT) AS freq FROM part GROUP BY p_name")
def unigram_import(spark, sf_dir):
    return dictionary.build_unigrams(readers.unigrams_from(_record_lines(spark, sf_dir)))


@query("SELECT DISTINCT p_name AS term, CAST(1 AS BIGINT) AS freq FROM part")
def unigram_plain(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("value"))
    return dictionary.build_unigrams(readers.plain_terms_from(lines))


@query(with_(LEX)[:-1] + """, w AS (SELECT term, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS term FROM conversations) x GROUP BY term)
SELECT w.term, w.freq FROM w WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.term = w.term AND lex.freq = w.freq)""")
def dict_verify(spark, sf_dir):
    return dictionary.verify(lex(spark, sf_dir), dictionary.count_words(table(spark, sf_dir, "conversations")))


@query(with_(LEX) + "SELECT count(*) AS terms, count(*) FILTER (WHERE freq > 0) AS nonzero, CAST(sum(strlen(term)) AS BIGINT) AS bytes, CAST(max(length(term)) AS BIGINT) AS longest FROM lex")
def dict_statistics(spark, sf_dir):
    return dictionary.statistics(lex(spark, sf_dir))


@query("""WITH c AS (SELECT p_name AS term, arg_min(p_size, p_partkey) AS freq FROM part GROUP BY p_name),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS term FROM benchmark)
SELECT term, CAST(freq AS BIGINT) AS freq FROM c UNION ALL SELECT term, CAST(1 AS BIGINT) FROM w WHERE term NOT IN (SELECT term FROM c)""")
def dict_merge_priority(spark, sf_dir):
    chars = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("term"), F.col("p_size").alias("freq"))
    return dictionary.merge_priority(chars, dictionary.count_words(table(spark, sf_dir, "benchmark")))


THESAURUS = """t AS (SELECT term FROM lex WHERE length(term) >= 2),
sub AS (SELECT term, i, unnest(range(2, length(term) - i + 1)) AS k FROM (SELECT term, unnest(range(0, length(term) - 1)) AS i FROM t) x),
inner_ AS (SELECT DISTINCT sub.term, substring(sub.term, i + 1, k) AS part FROM sub),
th AS (SELECT i.term, list_sort(list(i.part)) AS related FROM inner_ i WHERE i.part <> i.term AND i.part IN (SELECT term FROM lex) GROUP BY i.term)"""


@query(with_(LEX, THESAURUS) + "SELECT term, array_to_string(related, ',') AS related FROM th")
def thesaurus_build(spark, sf_dir):
    return dictionary.build_thesaurus(lex(spark, sf_dir)).select("term", F.array_join("related", ",").alias("related"))


@query(with_(LEX, THESAURUS)[:-1] + """, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS term FROM benchmark),
x AS (SELECT w.term, unnest(th.related) AS related_term, generate_subscripts(th.related, 1) - 1 AS nth FROM w JOIN th ON th.term = w.term)
SELECT term, CAST(nth AS BIGINT) AS nth, related_term FROM x""")
def thesaurus_lookup(spark, sf_dir):
    words = dictionary.count_words(table(spark, sf_dir, "benchmark")).select("term")
    return lookup.related(words, dictionary.build_thesaurus(lex(spark, sf_dir)))


@query("SELECT p_name AS term, arg_min(p_type || ',' || p_brand, p_partkey) AS related FROM part GROUP BY p_name")
def thesaurus_import(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    line = F.posexplode(F.array(F.col("p_name"), F.concat(F.lit("-"), "p_type", F.lit(","), "p_brand", F.lit(",")))).alias("k", "value")
    rows = part.select("p_partkey", line).select((F.col("p_partkey") * 2 + F.col("k")).alias("line_no"), "value")
    return readers.thesaurus_from(rows).select("term", F.array_join("related", ",").alias("related"))


SYNONYMS = """sy AS (SELECT p_name AS term, arg_min(p_type, p_partkey) AS canonical FROM part GROUP BY p_name)"""


def _synonyms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return readers.synonyms_from(part.select(F.col("p_partkey").alias("line_no"), F.concat(F.lit(" "), "p_name", F.lit("\t=> "), "p_type").alias("value")))


@query(with_(SYNONYMS) + "SELECT term, canonical FROM sy")
def synonym_import_first_wins(spark, sf_dir):
    return _synonyms(spark, sf_dir)


@query(with_(SYNONYMS) + "SELECT p_partkey, sy.canonical FROM part LEFT JOIN sy ON sy.term = p_name")
def synonym_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"))
    return lookup.canonical(rows, _synonyms(spark, sf_dir)).select("p_partkey", "canonical")


@query(with_(SYNONYMS)[:-1] + """, two AS (SELECT term, canonical FROM sy UNION ALL SELECT DISTINCT string_split(p_name, ' ')[1], 'head' FROM part),
x AS (SELECT p_partkey, two.term, two.canonical, row_number() OVER (PARTITION BY p_partkey ORDER BY length(two.term) DESC) AS rn FROM part JOIN two ON starts_with(p_name || ' ' || p_brand, two.term))
SELECT p_partkey, term, canonical FROM x WHERE rn = 1""")
def synonym_longest(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    heads = part.select(F.substring_index("p_name", " ", 1).alias("term"), F.lit("head").alias("canonical")).distinct()
    rows = part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("text"))
    return lookup.longest_prefix(rows, _synonyms(spark, sf_dir).unionByName(heads), "p_partkey", "text", 64)


# --- lookups

BENCH_WORDS = """w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS term FROM benchmark)"""


def _bench_words(spark, sf_dir):
    return dictionary.count_words(table(spark, sf_dir, "benchmark")).select("term")


@query(with_(LEX, BENCH_WORDS) + "SELECT w.term, coalesce(lex.freq, -1) AS freq FROM w LEFT JOIN lex ON lex.term = w.term")
def exact_match(spark, sf_dir):
    return lookup.exact(_bench_words(spark, sf_dir), lex(spark, sf_dir))


@query(with_(LEX, BENCH_WORDS) + "SELECT w.term, (lex.term IS NOT NULL) AS is_keyword FROM w LEFT JOIN lex ON lex.term = w.term AND lex.freq >= 50")
def keyword_flag(spark, sf_dir):
    return lookup.is_keyword(_bench_words(spark, sf_dir), lex(spark, sf_dir).where(F.col("freq") >= 50))


@query(with_(LEX, BENCH_WORDS) + "SELECT w.term, CAST(CASE WHEN lex.freq BETWEEN 1 AND 100 THEN lex.freq ELSE 100 END AS BIGINT) AS weight FROM w LEFT JOIN lex ON lex.term = w.term")
def word_weight(spark, sf_dir):
    return lookup.word_weight(_bench_words(spark, sf_dir), lex(spark, sf_dir))


@query(with_(BENCH_WORDS) + "SELECT term, CAST(strlen(term) AS BIGINT) AS weight FROM w")
def word_weight_without_dictionary(spark, sf_dir):
    return lookup.word_weight(_bench_words(spark, sf_dir), None)


@query(with_(LEX, BENCH_WORDS)[:-1] + ", x AS (SELECT term AS word, unnest(range(1, length(term) + 1)) AS len FROM w) SELECT word, lex.term, CAST(len AS BIGINT) AS len, freq FROM x JOIN lex ON lex.term = substring(word, 1, len) WHERE len <= 36")
def prefix_hits(spark, sf_dir):
    return lookup.prefix_hits(_bench_words(spark, sf_dir).select(F.col("term").alias("word")), lex(spark, sf_dir), "word", MOST).select("word", "term", "len", "freq")


@query(with_(LEX, BENCH_WORDS)[:-1] + """, p AS (SELECT term, freq, unnest(range(1, length(term) + 1)) AS k FROM lex), b AS (SELECT substring(term, 1, k) AS pre, max(CASE WHEN k = length(term) THEN freq END) AS f FROM p GROUP BY 1)
SELECT w.term, CAST(CASE WHEN b.pre IS NULL THEN -2 ELSE coalesce(b.f, -1) END AS BIGINT) AS state FROM w LEFT JOIN b ON b.pre = w.term""")
def prefix_state(spark, sf_dir):
    return lookup.is_prefix(_bench_words(spark, sf_dir), lex(spark, sf_dir)).select("term", "state")


# --- the matcher


def _doc_runs(spark, sf_dir):
    return runs.ordinary_runs(lowered(spark, sf_dir, "documents"), WORDS)


def _doc_hits(spark, sf_dir):
    """Distinct runs, dictionary and hits, for dictionaries larger than a worker may hold."""
    every, words = written(_doc_runs(spark, sf_dir), "runs"), written(common(spark, sf_dir), "common")
    return every, words, written(relational.hits(every.select("run"), words, MOST), "hits")


def _matched(spark, sf_dir, where_runs_are, by_joins):
    """What the matcher finds in the documents' distinct runs: where they are, unless the dictionary is too large for that."""
    packed = kernel.collect(common(spark, sf_dir))
    return by_joins(*_doc_hits(spark, sf_dir)) if packed is None else where_runs_are(_doc_runs(spark, sf_dir), packed)


@query(with_(COMMON, runs_sql("benchmark"), HITS, PATHS) + "SELECT run, CAST(pt AS BIGINT) AS \"at\", CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(w1 AS BIGINT) AS w1, CAST(w2 AS BIGINT) AS w2, CAST(w3 AS BIGINT) AS w3, CAST(f1 AS BIGINT) AS f1, CAST(f2 AS BIGINT) AS f2, CAST(f3 AS BIGINT) AS f3 FROM p3")
def chunk_candidates(spark, sf_dir):
    """Every path of every position: of the benchmark's passages, as they are many."""
    every = written(runs.ordinary_runs(lowered(spark, sf_dir, "benchmark"), WORDS), "runs")
    return relational.paths(written(relational.hits(every, written(common(spark, sf_dir), "common"), MOST), "hits"))


@query(with_(COMMON, runs_sql("documents"), HITS, PATHS) + """, m1 AS (SELECT *, max(total) OVER (PARTITION BY run, pt) AS bt FROM s), r1 AS (SELECT *, (total = bt) AS k1 FROM m1),
m2 AS (SELECT *, min(words) FILTER (WHERE k1) OVER (PARTITION BY run, pt) AS bw FROM r1), r2 AS (SELECT *, (k1 AND words = bw) AS k2 FROM m2),
m3 AS (SELECT *, min(squares) FILTER (WHERE k2) OVER (PARTITION BY run, pt) AS bs FROM r2), r3 AS (SELECT *, (k2 AND squares = bs) AS k3 FROM m3),
m4 AS (SELECT *, max(score) FILTER (WHERE k3) OVER (PARTITION BY run, pt) AS bf FROM r3)
SELECT run, CAST(pt AS BIGINT) AS \"at\", count(*) AS n_paths, count(*) FILTER (WHERE k1) AS rule1, count(*) FILTER (WHERE k2) AS rule2, count(*) FILTER (WHERE k3) AS rule3, count(*) FILTER (WHERE k3 AND score = bf) AS rule4 FROM m4 GROUP BY run, pt""")
def rule_survivors(spark, sf_dir):
    joins = lambda every, words, hits: relational.survivors(written(relational.scored(relational.paths(hits)), "paths"))
    return _matched(spark, sf_dir, kernel.survivors, joins)


@query(with_(COMMON, runs_sql("documents"), HITS, PATHS, NEXT) + "SELECT run, CAST(pt AS BIGINT) AS \"at\", CAST(word AS BIGINT) AS word FROM nx")
def next_step(spark, sf_dir):
    joins = lambda every, words, hits: relational.next_words(relational.scored(relational.paths(hits)))
    return _matched(spark, sf_dir, kernel.next_words, joins)


SEGMENTED = with_(COMMON, runs_sql("documents"), HITS, PATHS, NEXT, WALK, recursive=True) + "SELECT substring(w.run, w.pt + 1, w.word) AS surface, CAST(sum(r.n) AS BIGINT) AS n FROM walk w JOIN runs r ON r.run = w.run GROUP BY 1"


@query(SEGMENTED)
def segment_words(spark, sf_dir):
    """Surfaces of all words of all documents with their counts, from distinct runs."""

    def joins(every, words, hits):
        return relational.words_of(hits).join(every, "run").groupBy("surface").agg(F.sum("n").alias("n"))

    return _matched(spark, sf_dir, kernel.word_counts, joins)


@query(SEGMENTED)
def segment_arrow(spark, sf_dir):
    """The same by the Arrow matcher over the texts."""
    counts = matcher.count_tokens(lowered(spark, sf_dir, "documents"), matcher.pack_lexicon(common(spark, sf_dir)), WORDS)
    return counts.where(F.col("kind") == "word").select("surface", "n")


@query(with_(COMMON, runs_sql("documents"), HITS, PATHS, NEXT, WALK, f"pc AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {quoted(piece_pattern(WORDS.classes))})) AS piece, generate_subscripts(regexp_extract_all(lower(text), {quoted(piece_pattern(WORDS.classes))}), 1) AS k FROM documents)", """tk AS (SELECT doc_id, k, coalesce(w.nth, 0) AS nth, CASE WHEN w.run IS NULL THEN piece ELSE substring(piece, w.pt + 1, w.word) END AS surface FROM pc LEFT JOIN walk w ON w.run = pc.piece)""", recursive=True) + """SELECT doc_id, CAST(row_number() OVER o - 1 AS BIGINT) AS pos, surface, CAST(strlen(surface) AS BIGINT) AS byte_len, CAST(sum(strlen(surface)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_byte,
CAST(sum(strlen(surface)) OVER (o ROWS UNBOUNDED PRECEDING) - strlen(surface) AS BIGINT) AS start_byte FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY k, nth)""")
def token_offsets(spark, sf_dir):
    tokens = matcher.segment(lowered(spark, sf_dir, "documents").select("doc_id", "text"), matcher.pack_lexicon(common(spark, sf_dir)), WORDS, details=True)
    return tokens.select("doc_id", "pos", "surface", "byte_len", (F.col("start_byte") + F.col("byte_len")).alias("end_byte"), "start_byte")


@query(with_(COMMON, runs_sql("documents"), HITS, PATHS, NEXT, WALK, "rp AS (SELECT s.* FROM s JOIN walk w ON w.run = s.run AND w.pt = s.pt)", """laid AS (SELECT run, pt AS start, w1 AS len, f1 AS f FROM rp UNION ALL SELECT run, pt + w1, w2, f2 FROM rp WHERE w2 IS NOT NULL UNION ALL SELECT run, pt + w1 + w2, w3, f3 FROM rp WHERE w3 IS NOT NULL)""", recursive=True) + """SELECT DISTINCT l.run, CAST(l.start AS BIGINT) AS start, CAST(l.len AS BIGINT) AS len, substring(l.run, l.start + 1, l.len) AS surface FROM laid l LEFT JOIN walk w ON w.run = l.run AND w.pt = l.start AND w.word = l.len WHERE l.f >= 2 AND w.run IS NULL""")
def omni_tokens(spark, sf_dir):
    joins = lambda every, words, hits: relational.omni_of(written(relational.paths(hits), "paths"))
    return _matched(spark, sf_dir, kernel.omni, joins)


@query(with_(COMMON, runs_sql("documents"), HITS, PATHS, NEXT, WALK, recursive=True) + """SELECT c.run, CAST(c.pt AS BIGINT) AS start, CAST(c.len AS BIGINT) AS len, substring(c.run, c.pt + 1, c.len) AS surface
FROM cut c JOIN lex k ON k.term = substring(c.run, c.pt + 1, c.len) AND k.freq >= 50 LEFT JOIN walk w ON w.run = c.run AND w.pt = c.pt AND w.word = c.len WHERE w.run IS NULL""")
def keyword_minus_tokens(spark, sf_dir):
    joins = lambda every, words, hits: relational.keyword_hits(every, words.where(F.col("freq") >= 50), MOST, relational.words_of(hits))
    return _matched(spark, sf_dir, lambda every, packed: kernel.keyword_hits(every, packed, 50), joins)


@query()
def stream_segment(spark, sf_dir):
    """Counts of the tokens that a stream over the documents' files yields."""
    folder = shared_folder(spark, "stream")
    segment_folder(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/tokens", f"{folder}/state", matcher.pack_lexicon(common(spark, sf_dir)), WORDS, ("doc_id", "text"), lower=True)
    return spark.read.parquet(f"{folder}/tokens").groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


ORACLES["stream_segment"] = "SELECT surface, count(*) AS n FROM (" + ORACLES["token_offsets"] + ") x GROUP BY surface"


@query("SELECT p_partkey, string_agg(surface, '|' ORDER BY k) AS tokens FROM (SELECT p_partkey, 1 AS k, (SELECT arg_min(x.p_type, x.p_partkey) FROM part x WHERE x.p_name = part.p_name) AS surface FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part) y GROUP BY p_partkey")
def synonym_rewrite(spark, sf_dir):
    """Part names, cut at the blank, with the synonym of the whole name in their place."""
    part = table(spark, sf_dir, "part")
    first, blank, last = F.substring_index("p_name", " ", 1), F.lit(" "), F.substring_index("p_name", " ", -1)
    tokens = part.select("p_partkey", F.posexplode(F.array(first, blank, last, F.col("p_brand"))).alias("pos", "surface"))
    got = enrich.rewrite_synonyms(tokens, _synonyms(spark, sf_dir), ["p_partkey"])
    return got.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surface"))), lambda t: t["surface"]), "|").alias("tokens"))


# --- scalar functions, settings and sinks


@query(f"SELECT doc_id, md5(translate(lower(text), {quoted(''.join(chr(c) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r)) + FOLD_FROM)}, {quoted('0123456789' + 'abcdefghijklmnopqrstuvwxyz' * 2 + FOLD_TO)})) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("folded"))


@query("SELECT doc_id, length(text) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, CAST(CASE WHEN text = '' THEN 0 ELSE unicode(text) END AS BIGINT) AS first_code, CAST(strlen(left(text, 1)) AS BIGINT) AS first_bytes FROM documents")
def utf8_lengths(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", tx.utf8_length(t).alias("chars"), F.octet_length(t).alias("bytes"), tx.utf8_decode(t).alias("first_code"), tx.utf8_decode_length(t).alias("first_bytes"))


@query("WITH x AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, i, unnest(range(2, length(p_name) - i + 1)) AS k FROM (SELECT p_name, unnest(range(0, length(p_name) - 1)) AS i FROM x) y) SELECT p_name, substring(p_name, i + 1, k) AS part, count(*) AS n FROM s GROUP BY 1, 2")
def substrings(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", F.explode(tx.substrings(F.col("p_name"))).alias("part")).groupBy("p_name", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT event_id, list_filter(string_split_regex(props, '[{}": ,]'), lambda t: t <> '') AS t FROM events)
SELECT event_id, CAST(len(t) AS BIGINT) AS n, t[1] AS first, coalesce(TRY_CAST(t[2] AS BIGINT), 0) AS second, replace(t[1], 'k', '') AS bare FROM x""")
def tokenizer_collapse(spark, sf_dir):
    p, cut = F.col("props"), '{}": ,'
    first = tx.nth_token(p, cut, 1)
    return table(spark, sf_dir, "events").select("event_id", tx.count_tokens(p, cut).alias("n"), first.alias("first"), tx.to_int(tx.nth_token(p, cut, 2)).alias("second"), tx.without(first, "k").alias("bare"))


@query("SELECT p_partkey, CAST(bit_count(CAST(p_partkey AS BIGINT)) AS BIGINT) AS bits, CAST(bit_count(p_size) AS BIGINT) AS size_bits FROM part")
def bit_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.bit_count(F.col("p_partkey")).alias("bits"), tx.bit_count(F.col("p_size")).alias("size_bits"))


@query("SELECT lower(r_name) AS section, lower(n_name) AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def ini_parse(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    head = region.select((F.col("r_regionkey") * 1000).alias("line_no"), F.concat(F.lit("[ "), "r_name", F.lit(" ]")).alias("value"))
    body = nation.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("line_no"), F.concat("n_name", F.lit(" = \""), F.col("n_nationkey").cast("string"), F.lit("\" ; note")).alias("value"))
    return readers.ini_from(head.unionByName(body))


@query(with_(COMMON, runs_sql("documents"), HITS, PATHS, NEXT, WALK, recursive=True) + "SELECT run, string_agg(substring(run, pt + 1, word), ' ' ORDER BY pt) AS words FROM walk GROUP BY run")
def token_lists(spark, sf_dir):
    joins = lambda every, words, hits: sinks.token_lists(relational.words_of(hits).select("run", F.col("nth").alias("pos"), "surface"), ["run"])
    lists = _matched(spark, sf_dir, kernel.word_lists, joins)
    return lists.select("run", F.array_join("tokens", " ").alias("words"))
