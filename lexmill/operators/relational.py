"""The matcher as joins and windows over distinct runs: explainable, and for dictionaries of any size.

Every position's hits come from an equi-join of the run's substrings with the dictionary, of those lengths only that terms
with the same first two characters have; paths are joins of positions; the rules are one ordered maximum a position; and
the walk over the chosen words is a fold over each run's positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.config import SegmentConfig
from lexmill.operators import runs as cutting


def spans(runs: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """(run, at, len, term): of each position of each run the single character, and as many characters as terms with the same first two have."""
    sizes = terms.where(F.char_length("term") > 1).groupBy(F.substring("term", 1, 2).alias("head")).agg(F.collect_set(F.char_length("term")).alias("sizes"))
    at = runs.select("run", F.explode(F.sequence(F.lit(0), F.char_length("run") - 1)).alias("at"))
    at = at.withColumn("head", F.substring(F.col("run"), F.col("at") + 1, F.lit(2))).join(sizes, "head", "left")
    left = F.least(F.char_length("run") - F.col("at"), F.lit(most))
    lens = F.concat(F.array(F.lit(1)), F.coalesce(F.filter("sizes", lambda n: n <= left), F.array().cast("array<int>")))
    return at.select("run", "at", F.explode(lens).alias("len")).withColumn("term", F.substring(F.col("run"), F.col("at") + 1, F.col("len")))


def hits(runs: DataFrame, dictionary: DataFrame, most: int, max_bytes: int = 36) -> DataFrame:
    """(run, at, lens, f) of each position of each run: ascending word lengths, 1 among them, and the longest hit's frequency."""
    terms = dictionary.where(F.octet_length("term") <= max_bytes).select("term", "freq", F.lit(True).alias("known"))
    found = spans(runs, terms, most).join(terms, "term", "left").where((F.col("len") == 1) | F.col("known"))
    return found.groupBy("run", "at").agg(F.array_sort(F.collect_set("len")).alias("lens"), F.coalesce(F.max_by("freq", F.when(F.col("freq").isNotNull(), F.col("len"))), F.lit(1)).alias("f"))


def paths(at_hits: DataFrame, inclusive: bool = False, most: int = 36) -> DataFrame:
    """(run, at, i, j, w1, w2, w3, f1, f2, f3): every path of up to three words of up to ``most`` characters from every position.

    A run's hits are gathered once, and each position gets the stretch of them that its paths can reach: two words and
    the place after them; so one shuffle by run serves the paths, the rules and the walk. Runs are pieces between
    separators; ones of tens of thousands of characters are for the Arrow form.
    """
    end = F.char_length("run") - (0 if inclusive else 1)
    in_order = F.array_sort(F.collect_list(F.struct("at", "lens", "f")))
    runs = at_hits.groupBy("run").agg(F.transform(in_order, lambda h: F.struct(h["lens"].alias("lens"), h["f"].alias("f"))).alias("h"))
    ahead = F.transform(F.sequence(F.lit(1), F.size("h")), lambda i: F.slice("h", i, F.lit(2 * most + 1)))
    one = runs.select("run", F.posexplode(ahead).alias("at", "near")).withColumn("h1", F.get("near", F.lit(0)))
    one = one.select("run", "at", "near", "h1", F.posexplode("h1.lens").alias("i", "w1")).withColumn("f1", F.when(F.col("i") == 0, F.col("h1.f")).otherwise(0))
    one = one.withColumn("h2", F.when(F.col("at") + F.col("w1") < end, F.get("near", F.col("w1"))))
    two = one.select("run", "at", "near", "i", "w1", "f1", "h2", F.posexplode_outer("h2.lens").alias("j", "w2"))
    two = two.withColumn("f2", F.when(F.col("j") == 0, F.col("h2.f")).when(F.col("j") > 0, F.lit(1)))
    two = two.withColumn("h3", F.when(F.col("at") + F.col("w1") + F.col("w2") < end, F.get("near", F.col("w1") + F.col("w2"))))
    three = two.withColumn("w3", F.array_max("h3.lens")).withColumn("f3", F.when(F.size("h3.lens") == 1, F.col("h3.f")).when(F.size("h3.lens") > 1, F.lit(1)))
    return three.select("run", "at", "i", F.coalesce("j", F.lit(0)).alias("j"), "w1", "w2", "w3", "f1", "f2", "f3")


def scored(every: DataFrame, compat: bool = False) -> DataFrame:
    """Paths with the keys of the rules: total bytes, words, sum of squared bytes and score."""
    freq = lambda c: F.log((F.col(c).bitwiseAND(65535) if compat else F.col(c)) + 1.0)
    w2, w3 = F.coalesce("w2", F.lit(0)), F.coalesce("w3", F.lit(0))
    size = lambda skip, n: F.octet_length(F.substring(F.col("run"), F.col("at") + 1 + skip, n))
    b = every.withColumn("b1", size(F.lit(0), F.col("w1"))).withColumn("b2", size(F.col("w1"), w2)).withColumn("b3", size(F.col("w1") + w2, w3))
    b = b.withColumn("total", F.col("b1") + F.col("b2") + F.col("b3")).withColumn("words", F.lit(1) + F.when(w2 > 0, 1).otherwise(0) + F.when(w3 > 0, 1).otherwise(0))
    b = b.withColumn("squares", F.col("b1") * F.col("b1") + F.col("b2") * F.col("b2") + F.col("b3") * F.col("b3"))
    return b.withColumn("score", F.round(freq("f1") + F.coalesce(freq("f2"), F.lit(0.0)) + F.coalesce(freq("f3"), F.lit(0.0)), 9)).drop("b1", "b2", "b3")


def next_words(every: DataFrame) -> DataFrame:
    """(run, at, word): the first word of each position's winning path."""
    order = F.struct("total", -F.col("words"), -F.col("squares"), "score", -F.col("i"), -F.col("j"))
    return every.groupBy("run", "at").agg(F.max_by("w1", order).alias("word"))


def survivors(every: DataFrame) -> DataFrame:
    """(run, at, n_paths, rule1, rule2, rule3, rule4): how many paths are left after each rule."""
    best = every.groupBy("run", "at").agg(F.count(F.lit(1)).alias("n_paths"), F.max(F.struct("total", -F.col("words"), -F.col("squares"), "score")).alias("b"))
    all_ = every.join(best, ["run", "at"])
    one = F.col("total") == F.col("b.total")
    two = one & (-F.col("words") == F.col("b.col2"))
    three = two & (-F.col("squares") == F.col("b.col3"))
    four = three & (F.col("score") == F.col("b.score"))
    return all_.groupBy("run", "at", "n_paths").agg(*[F.count_if(c).alias(f"rule{i}") for i, c in enumerate((one, two, three, four), 1)])


def walk(following: DataFrame) -> DataFrame:
    """(run, nth, start, len): each run's words from its start on."""
    steps = following.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]).alias("steps"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,len:int>>").alias("words"))

    def step(state, i):
        w = F.get(F.col("steps"), i)
        taken = F.struct((i + w).cast("int").alias("next"), F.concat(state["words"], F.array(F.struct(i.cast("int").alias("start"), w.cast("int").alias("len")))).alias("words"))
        return F.when(i == state["next"], taken).otherwise(state)

    words = F.aggregate(F.sequence(F.lit(0), F.size("steps") - 1), start, step, lambda s: s["words"])
    return steps.select("run", F.posexplode(words).alias("nth", "w")).select("run", "nth", F.col("w.start").alias("start"), F.col("w.len").alias("len"))


def words_of(at_hits: DataFrame, inclusive: bool = False, compat: bool = False, most: int = 36) -> DataFrame:
    """(run, nth, start, len, surface) of each word of each run, from hits. They are read three times: best a written table."""
    words = walk(next_words(scored(paths(at_hits, inclusive, most), compat)))
    return words.withColumn("surface", F.substring(F.col("run"), F.col("start") + 1, F.col("len")))


def segment_runs(runs: DataFrame, dictionary: DataFrame, most: int, inclusive: bool = False, compat: bool = False, max_bytes: int = 36) -> DataFrame:
    """(run, nth, start, len, surface) of each word of each run."""
    return words_of(hits(runs, dictionary, most, max_bytes), inclusive, compat, most)


def omni_of(every: DataFrame, least: int = 2, minus_tokens: bool = True) -> DataFrame:
    """(run, start, len, surface): words laid out from any reached position with a score frequency of at least ``least``.

    ``every`` holds the paths; it is read twice.
    """
    tokens = walk(next_words(scored(every)))
    reached = every.join(tokens.select("run", F.col("start").alias("at")), ["run", "at"], "left_semi")
    w1, w2 = F.col("w1"), F.coalesce("w2", F.lit(0))
    laid = F.array(F.struct(F.col("at").alias("start"), w1.alias("len"), F.col("f1").alias("f")), F.struct((F.col("at") + w1).alias("start"), F.col("w2").alias("len"), F.col("f2").alias("f")), F.struct((F.col("at") + w1 + w2).alias("start"), F.col("w3").alias("len"), F.col("f3").alias("f")))
    found = reached.select("run", F.inline(laid)).where(F.col("f") >= least).select("run", "start", "len").distinct()
    if minus_tokens:
        found = found.join(tokens.select("run", "start", "len"), ["run", "start", "len"], "left_anti")
    return found.withColumn("surface", F.substring(F.col("run"), F.col("start") + 1, F.col("len")))


def omni(runs: DataFrame, dictionary: DataFrame, most: int, least: int = 2, minus_tokens: bool = True, inclusive: bool = False) -> DataFrame:
    """The sub-words of runs: see omni_of."""
    return omni_of(paths(hits(runs, dictionary, most), inclusive, most), least, minus_tokens)


def keyword_hits(runs: DataFrame, keywords: DataFrame, most: int, tokens: DataFrame | None = None) -> DataFrame:
    """(run, start, len, surface) of keywords at every position, without those that are tokens."""
    terms = keywords.where(F.octet_length("term") <= 36).select("term").distinct()
    found = spans(runs, terms, most).join(terms, "term", "left_semi").select("run", F.col("at").alias("start"), "len", F.col("term").alias("surface"))
    if tokens is not None:
        found = found.join(tokens.select("run", "start", "len"), ["run", "start", "len"], "left_anti")
    return found.select("run", "start", "len", "surface")


def segment_rows(rows: DataFrame, dictionary: DataFrame, config: SegmentConfig = SegmentConfig(), text: str = "text", most: int = 36, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """The other columns of ``rows`` with pos and surface of each token of its text: ``matcher.segment`` for dictionaries of any size.

    ``keep`` writes tables that are read several times; rows are told apart by a number that the first of them holds.
    """
    base = keep(rows.drop("pos", "surface").withColumn("__row", F.monotonically_increasing_id()), "rows")
    occ = keep(cutting.pieces(base.select("__row", text), config, text), "pieces")
    distinct = keep(occ.where(F.col("kind") == "run").select(F.col("piece").alias("run")).distinct(), "runs")
    found = keep(hits(distinct, dictionary, most, config.max_term_bytes), "hits")
    words = words_of(found, config.lookahead_inclusive, config.compat, most).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("nth", "surface"))).alias("w"))
    words = words.select("run", F.lit("run").alias("kind"), F.transform("w", lambda x: x["surface"]).alias("words"))
    cut = occ.join(words, (F.col("piece") == F.col("run")) & (occ["kind"] == words["kind"]), "left").select("__row", "pos", F.coalesce("words", F.array("piece")).alias("words"))
    before = F.sum(F.size("words")).over(W.partitionBy("__row").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    tokens = cut.withColumn("first", F.coalesce(before, F.lit(0))).select("__row", "first", F.posexplode("words").alias("nth", "surface"))
    tokens = tokens.select("__row", (F.col("first") + F.col("nth")).cast("int").alias("pos"), "surface")
    return base.drop(text).join(tokens, "__row").drop("__row")
