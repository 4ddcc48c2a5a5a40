"""Operator 6, quality rules by host: rule failures per domain, shrunk by an empirical beta prior.

Main path: DataFrame functions only.

Defined results: a null or empty text has no words and fails the base rule; a null host
is a host of its own; repeated rows count each; an empty table gives an empty result;
extra columns of the input are ignored (``quality``) or carried along (``reject``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import SPACES, WORD, cut_lineage, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of characters that are symbols, of lines that repeat, and bounds of the mean word length.
MAX_SYMBOL_SHARE = 0.10
MAX_DUP_LINE_SHARE = 0.30
MEAN_WORD_CHARS = (2.0, 20.0)
#: A host goes when its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5
#: More hosts than this and their verdicts are joined by a shuffle instead of a broadcast.
BROADCAST_HOSTS = 100_000
SYMBOLS = r"[#*$%&|<>]"


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more (the first one included).

    Windows are hashed (64 bits). Where all differ there is nothing to count; else they
    are sorted with their place, and a window counts when a neighbour in that order has
    the same hash. Places p1 < p2 < ... then cover 3 + sum(min(3, gap)) words.
    """
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                         lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))

    def let(value: Column, body) -> Column:  # binds value, so that it is computed once
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def covered(places: Column) -> Column:
        gaps = F.transform(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda q, k: F.least(q - F.get(places, k), F.lit(3)))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda a, g: a + g))

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, lambda s: let(places(s), covered)))

    return let(hashes, count).cast("long")


def base_rules(text: Column) -> dict[str, Column]:
    """The digest columns of one text (null text: no words)."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    solid = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), SPACES, t)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return {
        "words": words,
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "word_chars": F.length(solid).cast("long"),
        "lines": lines,
        "n_chars_all": F.length(t).cast("long"),
    }


def _features(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Base rule columns beside ``keep``; every array lives in one projection only."""
    r = base_rules(F.col("_text"))
    d = docs.select(*keep, r["words"].alias("_words"), r["lines"].alias("_lines"),
                    r["n_symbols"].alias("_n_symbols"), r["word_chars"].alias("_word_chars"), r["n_chars_all"].alias("_n_chars"))
    names = [k for k in d.columns if k not in ("_words", "_lines")]
    return d.select(*names, F.size("_words").cast("long").alias("_n_words"),
                    F.size("_lines").cast("long").alias("_n_lines"),
                    (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
                    _repeated_words(F.col("_words")).alias("_n_repeat"))


def _failed_base() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (F.col("_n_repeat") * 100 > F.col("_n_words") * MAX_REPEAT_PERCENT)


def _failed_any() -> Column:
    """A document fails when the base rule or one of the soft rules does."""
    mean = F.col("_word_chars") / F.greatest(F.col("_n_words"), F.lit(1))
    return (_failed_base() | (F.col("_n_symbols") > F.col("_n_chars") * MAX_SYMBOL_SHARE)
            | (F.col("_n_dup_lines") > F.col("_n_lines") * MAX_DUP_LINE_SHARE)
            | (mean < MEAN_WORD_CHARS[0]) | (mean > MEAN_WORD_CHARS[1]))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``rules(_host, _fail)`` -> per host documents, failures, shrunk rate and verdict.

    The beta prior is fitted to the hosts' rates by moments: mean m and variance v over
    hosts, of which the part that binomial noise explains is taken off; strength
    a + b = m (1 - m) / v - 1. With no spread left the strength is the mean host size.
    """
    hosts = cut_lineage(rules.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_fail").cast("long")).alias("fails")))
    rate = F.col("fails") / F.col("n")
    m = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("fails").alias("f"), F.sum("n").alias("n"), F.var_pop(rate).alias("v"),
                  F.avg(1 / F.col("n")).alias("inv")).first()  # one row
    if not m["h"]:
        return hosts.select("_host", "n", "fails", F.lit(0.0).alias("rate"), F.lit(True).alias("good"))
    mean = min(max(m["f"] / m["n"], 1e-6), 1 - 1e-6)
    spread = m["v"] - mean * (1 - mean) * m["inv"]
    strength = max(mean * (1 - mean) / spread - 1, 1.0) if spread > 1e-12 else m["n"] / m["h"]
    shrunk = (F.col("fails") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("_host", "n", "fails", shrunk.alias("rate"), (shrunk <= max_rate).alias("good"))


def _with_verdicts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    h = hosts.select(F.col("_host").alias("_h"), F.col("rate").alias("_rate"), F.col("good").alias("_good"))
    h = F.broadcast(h) if h.count() <= BROADCAST_HOSTS else h  # beyond the bound: shuffle join, skew split by AQE
    return rows.join(h, rows["_host"].eqNullSafe(h["_h"]), "left").withColumn("_kept", ~_failed_base() & F.col("_good"))


def quality(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: rule counts, ``base_failed``, the host's shrunk rate, ``kept``."""
    rows = cut_lineage(_features(docs.select("doc_id", F.col(host).alias("_host"), F.col("text").alias("_text")),
                                 [F.col("doc_id"), F.col("_host")]))
    hosts = host_verdicts(rows.select("_host", _failed_any().alias("_fail")), max_rate)
    return _with_verdicts(rows, hosts).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"), F.col("_n_repeat").alias("n_repeat_words"), _failed_base().alias("base_failed"),
        F.col("_kept").alias("kept"), F.col("_rate").alias("host_rate"))


def reject(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` without the documents that the rules or their host's verdict reject.

    Rules are computed once for the hosts' rates and once more for the rows that stay, which
    moves no text. The verdict is built as an array element: a plain filter would be pushed
    below the word split and split the words again for every window.
    """
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_all"), F.col(host).alias("_host"), F.col("text").alias("_text"))
    rules = _features(d, [F.col("_host")])
    hosts = host_verdicts(rules.select("_host", _failed_any().alias("_fail")), max_rate)
    kept = _with_verdicts(_features(d, [F.col("_all"), F.col("_host")]), hosts)
    none = F.array().cast(f"array<{d.schema['_all'].dataType.simpleString()}>")
    return kept.select(F.inline(F.when(F.col("_kept"), F.array("_all")).otherwise(none)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
