"""Building, merging, checking and writing dictionaries.

Dictionaries are DataFrames: (term, freq), (term, canonical) and (term, related). On disk they are Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.functions import text as tx
from lexmill.sources import readers


def rejected() -> Column:
    """Whether a record is no dictionary entry: its term is empty or its count negative."""
    return (F.col("term") == "") | (F.col("freq") < 0)


def rejects(records: DataFrame) -> DataFrame:
    """The records that ``build_unigrams`` refuses."""
    return records.where(F.col("term").isNotNull() & rejected())


def build_unigrams(records: DataFrame) -> DataFrame:
    """One row a term; of several counts the largest holds. Terms may not be empty nor counts negative."""
    checked = records.where(F.col("term").isNotNull()).withColumn("freq", F.when(rejected(), F.raise_error(F.lit("a term is empty or its count negative"))).otherwise(F.col("freq")).cast("int"))
    return checked.groupBy("term").agg(F.max("freq").alias("freq"))


def count_words(docs: DataFrame, pattern: str = r"\p{L}+", text: str = "text") -> DataFrame:
    """(term, freq) of the lower-cased words of a text column."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("freq"))


def lexicon(docs: DataFrame, min_count: int = 1, max_bytes: int = 36) -> DataFrame:
    """The dictionary of all words of a text column that are seen ``min_count`` times and no longer than dictionary terms may be."""
    return count_words(docs).where((F.col("freq") >= min_count) & (F.octet_length("term") <= max_bytes))


def merge_priority(chars: DataFrame, words: DataFrame) -> DataFrame:
    """Character counts (columns line_no, term, freq; the first line of a term wins), then the words not among them with count 1."""
    first = chars.groupBy("term").agg(F.min_by("freq", "line_no").alias("freq"))
    rest = words.select("term").distinct().join(first, "term", "left_anti")
    return first.select("term", F.col("freq").cast("int")).unionByName(rest.select("term", F.lit(1).alias("freq")))


def build_thesaurus(terms: DataFrame) -> DataFrame:
    """(term, related): the other terms of at least two characters inside each term; terms without any are left out."""
    long = terms.select("term").distinct().where(F.char_length("term") >= 2)
    inner = long.select("term", F.explode(F.array_distinct(tx.substrings(F.col("term")))).alias("part")).where(F.col("part") != F.col("term"))
    found = inner.join(terms.select(F.col("term").alias("part")).distinct(), "part", "left_semi")
    return found.groupBy("term").agg(F.array_sort(F.collect_set("part")).alias("related"))


def verify(built: DataFrame, records: DataFrame) -> DataFrame:
    """Records that the built dictionary lacks or holds with a smaller count: none if it is right."""
    want = records.where(F.col("term").isNotNull()).groupBy("term").agg(F.max("freq").cast("int").alias("freq"))
    return want.join(built.select("term", F.col("freq").cast("int")), ["term", "freq"], "left_anti")


def in_order(dictionary: DataFrame) -> DataFrame:
    """By term in byte order."""
    return dictionary.orderBy("term")


def numbered(dictionary: DataFrame, keep: Callable[[DataFrame, str], DataFrame], partitions: int | None = None) -> DataFrame:
    """The rows of a dictionary with nth, their place from 0 in order of the terms: access by index is a filter on it.

    Rows are sorted in ranges; only a row a range is summed up to number them. ``keep`` writes the ranges, so that both
    readers see the same ones.
    """
    n = partitions or int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(dictionary.repartitionByRange(n, "term").withColumn("block", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("block").count()
    before = F.sum("count").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("block").orderBy("term")) - 1
    return ranged.withColumn("inside", inside).join(sizes, "block").withColumn("nth", F.col("before") + F.col("inside")).drop("block", "inside", "before")


def statistics(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("freq") > 0).alias("nonzero"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.char_length("term")), F.lit(0)).alias("longest"))


def save(dictionary: DataFrame, directory: str, kind: str, compression: str = "zstd", version: int = readers.VERSION) -> None:
    """Write a dictionary in order of its terms."""
    term = F.col("term").alias("term", metadata={readers.VERSION_KEY: version})
    columns = [term if c == "term" else F.col(c) for c in readers.SCHEMAS[kind]]
    in_order(dictionary).select(columns).write.mode("overwrite").option("compression", compression).parquet(f"{directory}/{kind}")


def build_dict(spark: SparkSession, kind: str, source: str, directory: str, plain: bool = False) -> DataFrame | None:
    """Read a source file, build the dictionary ``kind`` (unigram, kw, weight, synonyms, thesaurus) and write it; None for another kind."""
    if kind in ("unigram", "kw", "weight"):
        built = build_unigrams(readers.read_unigrams(spark, source, plain))
    elif kind == "synonyms":
        built = readers.read_synonyms(spark, source)
    elif kind == "thesaurus":
        built = readers.read_thesaurus(spark, source)
    else:
        return None
    save(built, directory, kind)
    return readers.load_dictionary(spark, directory, kind)
