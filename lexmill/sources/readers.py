"""Text sources and dictionary files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.functions import text as tx


class DictionaryError(Exception):
    """A dictionary is missing or malformed; ``code`` is -1 missing, -2 version, -3 format, -4 truncated."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, value) of a text file, trailing CR stripped. Dictionary files are small; each is one task."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^" + tx.BOM, "").alias("t"))
    whole = whole.select(F.regexp_replace("t", "\n$", "").alias("t")).where(F.col("t") != "")
    return whole.select(F.posexplode(F.split("t", "\n", -1)).alias("line_no", "value")).select("line_no", F.regexp_replace("value", "\r$", "").alias("value"))


def unigrams_from(rows: DataFrame) -> DataFrame:
    """Two-line records: even lines ``term<TAB>count`` of (line_no, value); a line without TAB is term and count text alike."""
    part = F.split("value", "\t")
    even = rows.where(F.col("line_no") % 2 == 0).where(F.col("value") != "")
    return even.select(part[0].alias("term"), tx.to_int(F.coalesce(F.get(part, F.lit(1)), F.col("value"))).alias("freq"))


def plain_terms_from(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value") != "").select(F.col("value").alias("term"), F.lit(1).alias("freq"))


def synonyms_from(rows: DataFrame) -> DataFrame:
    """``left => right`` lines of (line_no, value) to (term, canonical): comments and empty sides go, the first left wins."""
    at = F.instr("value", "=>")
    sides = rows.withColumn("value", F.regexp_replace("value", "^" + tx.BOM, "")).where((F.octet_length("value") >= 4) & ~F.col("value").startswith("//") & (at > 0))
    sides = sides.select("line_no", tx.trimmed(F.substring_index("value", "=>", 1)).alias("term"), tx.trimmed(F.expr("substring(value, instr(value, '=>') + 2)")).alias("canonical"))
    sides = sides.where((F.col("term") != "") & (F.col("canonical") != ""))
    return sides.groupBy("term").agg(F.min_by("canonical", "line_no").alias("canonical"))


def thesaurus_from(rows: DataFrame) -> DataFrame:
    """Two-line records, a term and ``-a,b,``, of (line_no, value) to (term, related); the first record of a term wins."""
    pair = rows.withColumn("pair", F.floor(F.col("line_no") / 2)).groupBy("pair").agg(F.max(F.when(F.col("line_no") % 2 == 0, F.col("value"))).alias("term"), F.max(F.when(F.col("line_no") % 2 == 1, F.col("value"))).alias("v"))
    related = F.filter(F.split(F.expr("substring(v, 2)"), ","), lambda x: x != "")
    return pair.where(F.col("term").isNotNull() & F.col("v").isNotNull()).groupBy("term").agg(F.min_by(related, "pair").alias("related"))


def ini_from(rows: DataFrame) -> DataFrame:
    """(section, key, value) of INI lines (line_no, value): last setting wins; sections and keys are lower-cased.

    A line that ends with a backslash goes on in the next one.
    """
    joined = rows.withColumn("more", F.rlike("value", F.lit(r"\\\s*$")))
    begins = F.coalesce(~F.lag("more").over(W.orderBy("line_no")), F.lit(True))
    joined = joined.withColumn("first", F.max(F.when(begins, F.col("line_no"))).over(W.orderBy("line_no")))
    part = F.struct("line_no", F.when(F.col("more"), F.regexp_replace("value", r"\\\s*$", "")).otherwise(F.col("value")).alias("v"))
    rows = joined.groupBy(F.col("first").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["v"]), "").alias("value"))
    t = rows.withColumn("t", F.trim("value")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    t = t.withColumn("named", F.when(F.rlike("t", F.lit(r"^\[[^\]]+\]")), F.lower(F.trim(F.regexp_extract("t", r"^\[([^\]]+)\]", 1)))))
    # settings files are small, and a section reaches from its head to the next one
    t = t.withColumn("section", F.last("named", ignorenulls=True).over(W.orderBy("line_no"))).where(F.col("named").isNull() & F.col("t").contains("="))
    raw = F.trim(F.expr("substring(t, instr(t, '=') + 1)"))
    value = F.when(F.rlike(raw, F.lit("^\"")), F.regexp_extract(raw, "^\"([^\"]*)\"?", 1)).when(F.rlike(raw, F.lit("^'")), F.regexp_extract(raw, "^'([^']*)'?", 1)).otherwise(F.trim(F.regexp_extract(raw, "^([^;#]*)", 1)))
    out = t.select("line_no", F.coalesce("section", F.lit("")).alias("section"), F.lower(F.trim(F.substring_index("t", "=", 1))).alias("key"), value.alias("value"))
    return out.groupBy("section", "key").agg(F.max_by("value", "line_no").alias("value"))


def read_unigrams(spark: SparkSession, path: str, plain: bool = False) -> DataFrame:
    return (plain_terms_from if plain else unigrams_from)(lines(spark, path))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    return synonyms_from(lines(spark, path))


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    return thesaurus_from(lines(spark, path))


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    return ini_from(lines(spark, path))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files in UTF-8 or, by their byte order mark, UTF-16."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    mark = F.hex(F.substring("content", 1, 2))
    wide = F.when(mark == "FEFF", F.decode("content", "UTF-16")).when(mark == "FFFE", F.decode("content", "UTF-16"))
    return raw.select("path", tx.clean(F.coalesce(wide, F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))).alias("text"))


def in_memory(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


#: The version of dictionary files, which their term column's metadata holds, and its name there.
VERSION, VERSION_KEY = 1, "lexmill_version"
SCHEMAS = {"unigram": ["term", "freq"], "kw": ["term", "freq"], "weight": ["term", "freq"], "synonyms": ["term", "canonical"], "thesaurus": ["term", "related"]}


def load_dictionary(spark: SparkSession, directory: str, kind: str, required: bool = False) -> DataFrame | None:
    """The Parquet dictionary ``kind`` of a folder; null where an optional one is missing."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(f"{directory}/{kind}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            if required:
                raise DictionaryError(-1, f"{directory}/{kind} is missing") from e
            return None
        raise DictionaryError(-4, f"{directory}/{kind} cannot be read") from e
    if not set(SCHEMAS[kind]) <= set(df.columns):
        raise DictionaryError(-3, f"{directory}/{kind} lacks {SCHEMAS[kind]}")
    version = df.schema["term"].metadata.get(VERSION_KEY, VERSION)
    if version > VERSION:
        raise DictionaryError(-2, f"{directory}/{kind} is of version {version}, which is newer than {VERSION}")
    return df.select(*SCHEMAS[kind])
