"""The engine as an object: dictionaries of a folder, configuration, and what can be done with them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from lexmill.config import SegmentConfig
from lexmill.operators import dictionary, enrich, lookup, matcher, relational
from lexmill.operators.matcher import Lexicon, Segmenter
from lexmill.plans.scratch import written
from lexmill.sources import readers, settings


@dataclass
class Engine:
    """``unigram`` is needed; keywords, weights, synonyms and thesaurus may be None."""

    spark: SparkSession
    unigram: DataFrame
    kw: DataFrame | None = None
    weight: DataFrame | None = None
    synonyms: DataFrame | None = None
    thesaurus_: DataFrame | None = None
    config: SegmentConfig = SegmentConfig()

    @classmethod
    def load(cls, spark: SparkSession, directory: str, config: SegmentConfig | None = None) -> Engine:
        """Load the Parquet dictionaries of a folder. Only the unigrams are required: what is wrong with others is a warning."""

        def get(kind: str) -> DataFrame | None:
            try:
                return readers.load_dictionary(spark, directory, kind)
            except readers.DictionaryError as e:
                warnings.warn(f"{kind} is left out: {e}", stacklevel=3)
                return None

        return cls(spark, readers.load_dictionary(spark, directory, "unigram", True), get("kw"), get("weight"), get("synonyms"), get("thesaurus"), config or SegmentConfig())

    def with_settings(self, ini_path: str) -> Engine:
        return Engine(self.spark, self.unigram, self.kw, self.weight, self.synonyms, self.thesaurus_, settings.read_config(self.spark, ini_path))

    @cached_property
    def lexicon(self) -> Lexicon:
        return matcher.collect_lexicon(self.unigram, self.config.max_term_bytes)

    def segment(self, text: str) -> list[str]:
        """The tokens of one text, here on the driver, with synonyms in place of the tokens that they stand for."""
        tokens = Segmenter(self.lexicon, self.config).tokens(text)
        if self.synonyms is None:
            return tokens
        rows = self.spark.createDataFrame([(0, i, t) for i, t in enumerate(tokens)], "doc_id long, pos int, surface string")
        return [r.surface for r in enrich.rewrite_synonyms(rows, self.synonyms, ["doc_id"]).orderBy("pos").collect()]

    def segment_frame(self, rows: DataFrame, text: str = "text", details: bool = False) -> DataFrame:
        """The tokens of a DataFrame's texts, batch or stream; with details their offsets, kinds and chunks.

        A dictionary too large for every worker is met by joins (for batches, without details).
        """
        if not rows.isStreaming and not details and matcher.too_large(self.unigram, self.config.max_term_bytes):
            return relational.segment_rows(rows, self.unigram, self.config, text, self.config.max_term_bytes, written)
        return matcher.segment(rows, self.lexicon, self.config, text, details)

    def everything(self, rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
        """Words, sub-words, keywords and related terms with byte offsets: see enrich.all_kinds."""
        return enrich.all_kinds(rows, by, self.unigram, self.config, self.kw, self.synonyms, self.thesaurus_, text, keep=written)

    def thesaurus(self, term: str) -> list[str]:
        if self.thesaurus_ is None:
            return []
        rows = self.spark.createDataFrame([(term,)], "term string")
        return [r.related_term for r in lookup.related(rows, self.thesaurus_).orderBy("nth").collect()]

    def is_keyword(self, term: str) -> bool:
        return bool(lookup.is_keyword(self.spark.createDataFrame([(term,)], "term string"), self.kw).first().is_keyword)

    def word_weight(self, term: str) -> int:
        return lookup.word_weight(self.spark.createDataFrame([(term,)], "term string"), self.weight).first().weight

    def cursor(self, text: str):
        """(surface, start byte, end byte) one token after another."""
        at = 0
        for t in Segmenter(self.lexicon, self.config).tokens(text):
            yield t, at, (at := at + len(t.encode()))

    def build_dict(self, kind: str, source: str, directory: str) -> DataFrame | None:
        return dictionary.build_dict(self.spark, kind, source, directory)

    def register_sql(self, name: str = "segment") -> None:
        """A table function for SQL: ``SELECT * FROM docs, LATERAL segment(text)`` gives pos and surface."""
        lexicon, config = self.lexicon, self.config

        @udtf(returnType="pos int, surface string")
        class Segment:
            def __init__(self):
                self.segmenter = Segmenter(lexicon, config)

            def eval(self, text: str):
                for i, t in enumerate(self.segmenter.tokens(text or "")):
                    yield i, t

        self.spark.udtf.register(name, Segment)


