"""Enrichment of token tables: synonyms, thesaurus, keywords, sub-words and weights, each row with its kind."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.config import SegmentConfig
from lexmill.operators import lookup, relational, runs


def synonym_hits(tokens: DataFrame, synonyms: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, n, term, canonical): the longest synonym key that the tokens from each position on spell out.

    How far it looks ahead follows from the longest key: no token is empty, so a key spans no more tokens than it has
    characters. Only lengths that keys have are looked up, so most spans never reach the join.
    """
    lengths = sorted(r[0] for r in synonyms.select(F.char_length("term").alias("n")).where(F.col("n") > 0).distinct().collect())
    if not lengths:
        return tokens.select(*by, "pos", F.lit(1).alias("n"), F.col("surface").alias("term"), F.col("surface").alias("canonical")).limit(0)
    some = tokens.where(F.col("surface") != "")
    ahead = F.collect_list("surface").over(W.partitionBy(*by).orderBy("pos").rowsBetween(0, lengths[-1] - 1))
    spans = some.select(*by, "pos", ahead.alias("ahead")).select(*by, "pos", "ahead", F.posexplode(_ends("ahead")).alias("n", "chars"))
    spans = spans.where(F.col("chars").isin(lengths)).select(*by, "pos", (F.col("n") + 1).alias("n"), F.array_join(F.slice("ahead", F.lit(1), F.col("n") + 1), "").alias("term"))
    best = spans.join(synonyms.select("term", "canonical"), "term").groupBy(*by, "pos").agg(F.max_by(F.struct("n", "term", "canonical"), "n").alias("hit"))
    return best.select(*by, "pos", "hit.*")


def _ends(words: str):
    """Characters of the first 1, 2, ... words of an array."""
    sizes = F.transform(words, lambda w: F.char_length(w))
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))


def _first_free(key: tuple, table: pa.Table) -> pa.Table:
    """Of overlapping spans those that are taken from left to right."""
    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    pos, n = table.column("pos").to_numpy()[order], table.column("n").to_numpy()[order]
    taken, until = [], None
    for at, p, k in zip(order.tolist(), pos.tolist(), n.tolist()):
        if until is None or p >= until:
            taken.append(at)
            until = p + k
    return table.take(pa.array(taken, pa.int64()))


def rewrite_synonyms(tokens: DataFrame, synonyms: DataFrame, by: list[str]) -> DataFrame:
    """Tokens (by, pos, surface) with synonyms replaced: surface, source (the text it stands for), is_synonym and n_tokens.

    A synonym's key replaces the tokens that it spans when it ends on a token boundary; of several the longest is taken,
    from left to right. Keys may be of any length. Positions count up from any start without gaps. Hits that overlap no
    other stand as they are; only stretches of overlapping ones are resolved one after another.
    """
    tokens = tokens.select(*by, F.col("pos").cast("int").alias("pos"), "surface")
    hits = synonym_hits(tokens, synonyms, by)
    in_order = W.partitionBy(*by).orderBy("pos")
    reach = F.max(F.col("pos") + F.col("n")).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    hits = hits.withColumn("opens", F.coalesce(F.col("pos") >= reach, F.lit(True))).withColumn("stretch", F.sum(F.col("opens").cast("long")).over(in_order))
    hits = hits.withColumn("alone", F.count(F.lit(1)).over(W.partitionBy(*by, "stretch")) == 1)
    columns = [*by, "pos", "n", "term", "canonical"]
    some = hits.where(~F.col("alone"))
    schema = some.select(*columns, "stretch").schema
    taken = hits.where("alone").select(columns).unionByName(some.select(*columns, "stretch").groupBy(*by, "stretch").applyInArrow(_first_free, schema).select(columns))
    marked = tokens.join(taken, [*by, "pos"], "left")
    until = F.max(F.col("pos") + F.col("n")).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    kept = marked.withColumn("until", until).where(F.col("until").isNull() | (F.col("pos") >= F.col("until")))
    return kept.select(*by, "pos", F.coalesce("canonical", "surface").alias("surface"), F.coalesce("term", "surface").alias("source"), F.col("term").isNotNull().alias("is_synonym"), F.coalesce("n", F.lit(1)).cast("int").alias("n_tokens"))


def with_thesaurus(tokens: DataFrame, thesaurus: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, pos, surface, kind): the tokens as words, and for each the related terms of its surface."""
    words = tokens.select(*by, "pos", "surface", F.lit("word").alias("kind"))
    more = lookup.related(tokens.select(*by, "pos", F.col("surface").alias("term")), thesaurus).select(*by, "pos", F.col("related_term").alias("surface"), F.lit("thesaurus").alias("kind"))
    return words.unionByName(more)


def all_kinds(rows: DataFrame, by: list[str], unigram: DataFrame, config: SegmentConfig, keywords: DataFrame | None = None, synonyms: DataFrame | None = None, thesaurus: DataFrame | None = None, text: str = "text", most: int = 36, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Rows (by, start_byte, byte_len, surface, kind, is_synonym): words, sub-words (omni), keywords and related terms.

    What depends on a run alone is found once for each distinct run; occurrences get it by a join on the run. Synonyms
    replace the words that they span; sub-words and keywords stay. ``keep`` may write tables that are read several times. A sub-word equal to a word at the same place is left out, and so is such a keyword.
    """
    occ = runs.pieces(rows.select(*by, text), config, text)
    size = F.octet_length("piece")
    occ = occ.withColumn("at", F.coalesce(F.sum(size).over(W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    distinct = keep(occ.where(F.col("kind") == "run").select(F.col("piece").alias("run")).distinct(), "runs")
    hits = keep(relational.hits(distinct, unigram, most, config.max_term_bytes), "hits")
    words = keep(relational.words_of(hits, config.lookahead_inclusive, config.compat, most).select("run", "start", "len", "surface"), "words")
    parts = words.withColumn("kind", F.lit("word")).unionByName(relational.omni_of(keep(relational.paths(hits, config.lookahead_inclusive, most), "paths"), config.omni).withColumn("kind", F.lit("omni")))
    if keywords is not None:
        parts = parts.unionByName(relational.keyword_hits(distinct, keywords.where(F.col("freq") > 0), most, words).withColumn("kind", F.lit("keyword")))
    parts = parts.withColumn("skip", F.octet_length(F.substring(F.col("run"), F.lit(1), F.col("start")))).drop("len", "start")
    inside = occ.where(F.col("kind") == "run").join(parts.withColumnRenamed("kind", "part_kind"), F.col("piece") == F.col("run"))
    out = inside.select(*by, (F.col("at") + F.col("skip")).alias("start_byte"), F.octet_length("surface").alias("byte_len"), "surface", F.col("part_kind").alias("kind"))
    out = out.unionByName(occ.where(F.col("kind") != "run").select(*by, F.col("at").alias("start_byte"), size.alias("byte_len"), F.col("piece").alias("surface"), F.lit("word").alias("kind")))
    out = out.withColumn("is_synonym", F.lit(False))
    if synonyms is not None:
        words = keep(out.where(F.col("kind") == "word").withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("start_byte"))), "in_order")
        new = rewrite_synonyms(words.select(*by, "pos", "surface"), synonyms, by).join(words.select(*by, "pos", "start_byte"), [*by, "pos"])
        new = new.select(*by, "start_byte", F.octet_length("source").alias("byte_len"), "surface", F.lit("word").alias("kind"), "is_synonym")
        out = out.where(F.col("kind") != "word").unionByName(new)
    if thesaurus is not None:
        of = out.where(F.col("kind") == "word").select(*by, "start_byte", "byte_len", F.col("surface").alias("term"))
        more = lookup.related(of, thesaurus).select(*by, "start_byte", "byte_len", F.col("related_term").alias("surface"), F.lit("thesaurus").alias("kind"), F.lit(False).alias("is_synonym"))
        out = out.unionByName(more)
    return out
