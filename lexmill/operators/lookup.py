"""Lookups of terms: the joins of the engine. All are equi-joins, so a dictionary of any size works; Catalyst broadcasts small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx


def exact(rows: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` with freq, -1 where the dictionary lacks the term."""
    d = dictionary.select(F.col("term").alias(term), F.col("freq").alias("__freq"))
    return rows.drop("freq").join(d, term, "left").withColumn("freq", F.coalesce("__freq", F.lit(-1))).drop("__freq")


def prefix_hits(rows: DataFrame, dictionary: DataFrame, text: str, most: int, max_bytes: int = 36) -> DataFrame:
    """Each row with each dictionary term that is a prefix of its text: columns term, len (characters) and freq."""
    every = rows.withColumn("term", F.explode(tx.prefixes(F.col(text), most))).where(F.octet_length("term") <= max_bytes)
    return every.hint("merge").join(dictionary.select("term", F.col("freq").cast("int").alias("freq")), "term").withColumn("len", F.char_length("term"))


def longest_prefix(rows: DataFrame, synonyms: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, term, canonical) of the longest synonym that is a prefix of each row's text; rows without any are left out.

    A row gives prefixes only of lengths that synonyms have. Spark takes exploded rows for as small as their source and
    would broadcast them; the hint has them sorted and merged, whatever their number.
    """
    sizes = synonyms.where(F.char_length("term").between(1, most)).agg(F.collect_set(F.char_length("term")).alias("__sizes"))
    fit = F.transform(F.filter("__sizes", lambda n: n <= F.char_length(text)), lambda n: F.substring(F.col(text), F.lit(1), n))
    every = rows.select(key, text).crossJoin(F.broadcast(sizes)).select(key, F.explode(fit).alias("term")).hint("merge").join(synonyms, "term")
    return every.groupBy(key).agg(F.max_by(F.struct("term", "canonical"), F.char_length("term")).alias("hit")).select(key, "hit.term", "hit.canonical")


def canonical(rows: DataFrame, synonyms: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` with canonical, null where the term has none."""
    return rows.drop("canonical").join(synonyms.select(F.col("term").alias(term), "canonical"), term, "left")


def related(rows: DataFrame, thesaurus: DataFrame, term: str = "term") -> DataFrame:
    """Each row with each related term in stored order, up to the first empty one."""
    cut = F.when(F.array_contains("related", ""), F.slice("related", F.lit(1), F.greatest(F.lit(0), F.array_position("related", "").cast("int") - 1))).otherwise(F.col("related"))
    return rows.join(thesaurus.select(F.col("term").alias(term), cut.alias("related")), term).select("*", F.posexplode("related").alias("nth", "related_term")).drop("related")


def is_keyword(rows: DataFrame, keywords: DataFrame | None, term: str = "term") -> DataFrame:
    """``rows`` with is_keyword: whether the keyword dictionary has the term with a count above 0."""
    if keywords is None:
        return rows.withColumn("is_keyword", F.lit(False))
    d = keywords.where(F.col("freq") > 0).select(F.col("term").alias(term), F.lit(True).alias("__kw"))
    return rows.drop("is_keyword").join(d, term, "left").withColumn("is_keyword", F.coalesce("__kw", F.lit(False))).drop("__kw")


def word_weight(rows: DataFrame, weights: DataFrame | None, term: str = "term") -> DataFrame:
    """``rows`` with weight: 100 unless the weight dictionary has 1 to 100; the term's bytes where there is no dictionary."""
    if weights is None:
        return rows.withColumn("weight", F.octet_length(term))
    d = weights.select(F.col("term").alias(term), F.col("freq").alias("__w"))
    fine = F.col("__w").between(1, 100)
    return rows.drop("weight").join(d, term, "left").withColumn("weight", F.when(fine, F.col("__w")).otherwise(100)).drop("__w")


def is_prefix(rows: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` with state: the count of a term, -1 of what only begins terms, -2 of anything else."""
    d = dictionary.select(F.col("term").alias("__t"), "freq")
    begins = d.select(F.explode(tx.prefixes(F.col("__t"), 1 << 20)).alias("__p"), "__t", "freq").groupBy(F.col("__p").alias(term)).agg(F.max(F.when(F.col("__p") == F.col("__t"), F.col("freq"))).alias("__f"))
    return rows.join(begins.withColumn("__known", F.lit(True)), term, "left").withColumn("state", F.coalesce("__f", F.when(F.col("__known"), -1).otherwise(-2))).drop("__f", "__known")


def minus(hits: DataFrame, tokens: DataFrame, on: list[str]) -> DataFrame:
    """Hits that are not tokens of the same start and length."""
    return hits.join(tokens.select(*on).distinct(), on, "left_anti")
