"""The opN queries: each applies its operator to the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, chat, fingerprint, hnsw, lang_id, line_dedup, mixing, near_dedup, quality, token_files
from lexmill.llm.sampling import held_out
from lexmill.llm.store import Scratch
from lexmill.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), percent=85)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').root}/files"
    token_files.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.read_shards(spark, path, with_ids=False)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = lang_id.fit_languages(docs)
    return lang_id.predict_languages(docs.drop("lang"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_mix_sources, op3_bpe, op4_line_dedup, op5_near_dedup, op6_chat, op7_fingerprints, op8_token_files, op9_nearest, op10_lang_id)}


ORACLES = {
    "op6_chat": r"""
WITH b AS (SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), chr(13) || chr(10), '  ') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM b WHERE speaker <> 'system'),
r AS (SELECT b.conv_id, p.perspective, b.turn, b.speaker, b.body,
             CASE WHEN b.speaker = 'system' THEN 'system' WHEN b.speaker IS NOT DISTINCT FROM p.perspective THEN 'assistant' ELSE 'user' END AS role_as
      FROM b LEFT JOIN p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role_as = 'user' THEN speaker END AS name,
             '<|im_start|>' || role_as || CASE WHEN role_as = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
t AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, length(rendered) AS size, row_number() OVER w - 1 AS seq, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
      FROM t WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, rendered))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role_as, name, rendered, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + size AS BIGINT) AS char_end,
       CAST(CASE WHEN role_as = 'assistant' THEN char_start + length(head) END AS BIGINT) AS mask_start, CAST(CASE WHEN role_as = 'assistant' THEN char_start + size - 1 END AS BIGINT) AS mask_end FROM s""",
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (d.key IS NOT NULL AND k.doc_id <> d.keep_doc) AS dropped FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1::BIGINT] ELSE []::BIGINT[] END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:CASE WHEN len(ws) >= 5 THEN i + 4 ELSE len(ws) END], ' ') AS sh FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, d.doc_id = coalesce(c.comp, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op2_mix_sources": r"""
WITH b AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(t) - length(translate(t, '!"#$%&''()*+/:;<=>?@[\]^_`{|}~', ''))) / (length(t) + 1.0::DOUBLE)) AS weight,
             (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM b),
e AS (SELECT *, -ln(u) / weight AS key FROM z),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM e GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
x AS (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER () AS water FROM v),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM x),
y AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT e.doc_id, e.size, y.source_size, y.target, y.epochs, CAST(floor(y.target) AS BIGINT) - y.epochs * y.source_size AS rest,
             coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM e JOIN y ON e.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
