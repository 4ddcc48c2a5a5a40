"""Operator 9, chat formatting: cumulative snapshots collapse to maximal conversations, then render.

Logs often store a conversation again after every turn. A rolling hash of each turn prefix
finds those snapshots: a conversation whose whole hash equals a proper prefix hash of a
longer one goes (an anti-join on distinct prefix hashes), as do copies of the same turns
(the least conv_id stays). The prefix hash is a sum of hashes of (place, role, text), twice with
different seeds, so that whole hashes are plain sums and prefix sums can be taken chunk by
chunk of ``CHUNK_TURNS`` turns. Turns are numbered over range partitions, so no conversation, however long and
however many turns share a number, is one task's group.

Defined results: rows repeated in all of (conv_id, turn, role, text) are one turn; turns with
the same number follow by role, then text, nulls first; null conv_ids are one conversation, named null;
null roles render as ``user`` and null texts as nothing; an empty table gives an empty
result; other columns are ignored. A turn is a row: there are no conversations without turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.llm.common import cut_lineage, numbered_within, table

#: Turns of a chunk; a task sums one chunk of a conversation at a time.
CHUNK_TURNS = 256
DEFAULT_ROLE = "user"
PREFIX_SEEDS = (101, 202)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def turns(chats: DataFrame) -> DataFrame:
    """Distinct turns with their place in the conversation (from 1) and both hash terms."""
    t = chats.select(F.col("conv_id").alias("_c"), F.col("turn").cast("long").alias("_t"), F.col("role").alias("_role"), F.col("text").alias("_text")).distinct()
    t = t.withColumn("_k", F.when(F.col("_c").isNull(), F.lit("")).otherwise(F.concat(F.lit("c"), F.col("_c").cast("string"))))
    placed = numbered_within(t, "_k", ["_t", "_role", "_text"], "_n").withColumn("_place", F.col("_n") + 1)
    term = [F.xxhash64(F.lit(s), "_place", F.coalesce("_role", F.lit("")), F.col("_role").isNull(), F.coalesce("_text", F.lit("")), F.col("_text").isNull())
            .cast("decimal(38,0)") for s in PREFIX_SEEDS]
    return placed.select("_c", F.floor(F.col("_n") / CHUNK_TURNS).alias("_chunk"), "_place", "_role", "_text", term[0].alias("_h1"), term[1].alias("_h2"))


def prefixes(placed: DataFrame) -> DataFrame:
    """Hashes of every turn prefix: ``(_c, _place, _p1, _p2)``."""
    w = Window.partitionBy("_c", "_chunk").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("_c", "_chunk").agg(F.sum("_h1").cast("decimal(38,0)").alias("s1"), F.sum("_h2").cast("decimal(38,0)").alias("s2"))
    cw = Window.partitionBy("_c").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select(F.col("_c").alias("_sc"), F.col("_chunk").alias("_sk"),
                       *[F.coalesce(F.sum(f"s{i}").over(cw), zero).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)])
    d = placed.select("_c", "_chunk", "_place", *[F.sum(f"_h{i}").over(w).cast("decimal(38,0)").alias(f"_o{i}") for i in (1, 2)])
    d = d.join(sums, _same(d["_c"], F.col("_sc")) & (F.col("_chunk") == F.col("_sk")))
    return d.select("_c", "_place", *[(F.col(f"_o{i}") + F.col(f"b{i}")).cast("decimal(38,0)").alias(f"_p{i}") for i in (1, 2)])


def maximal(placed: DataFrame) -> DataFrame:
    """The conversations that stay: ``(_c, n_turns, n_copies)``.

    Every conversation is a prefix of itself, so a hash that is the prefix of more rows than whole conversations
    have it is a proper prefix of some longer one.
    """
    whole = placed.groupBy("_c").agg(F.max("_place").alias("n_turns"), *[F.sum(f"_h{i}").cast("decimal(38,0)").alias(f"_p{i}") for i in (1, 2)])
    alone = whole.groupBy("n_turns", "_p1", "_p2").agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("n_copies"))
    met = prefixes(placed).groupBy(F.col("_place").alias("n_turns"), "_p1", "_p2").agg(F.count(F.lit(1)).alias("_met"))  # aggregated before the shuffle
    proper = met.join(alone.select("n_turns", "_p1", "_p2", "n_copies"), ["n_turns", "_p1", "_p2"]).where("_met > n_copies")
    return alone.join(proper.select("n_turns", "_p1", "_p2"), ["n_turns", "_p1", "_p2"], "left_anti").select("_c", "n_turns", "n_copies")


def _line() -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce("_role", F.lit(DEFAULT_ROLE)), F.lit("\n"), F.coalesce("_text", F.lit("")), F.lit("<|im_end|>\n"))


def rendered_turns(chats: DataFrame) -> DataFrame:
    """Turns of the maximal conversations with their rendered text, ``(conv_id, place, rendered, n_turns, n_copies)``."""
    placed = cut_lineage(turns(chats))
    # a row per chunk of a conversation, so a long one is joined chunk by chunk
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / CHUNK_TURNS)))
    kept = maximal(placed).select(F.col("_c").alias("_kc"), "n_turns", "n_copies", chunks.alias("_kk"))
    return (placed.join(kept, _same(F.col("_c"), F.col("_kc")) & (F.col("_chunk") == F.col("_kk")))
            .select(F.col("_c").alias("conv_id"), F.col("_place").alias("place"), _line().alias("rendered"), "n_turns", "n_copies"))


def rendered(chats: DataFrame, segment: int = CHUNK_TURNS) -> DataFrame:
    """The conversations' texts, in segments of at most ``segment`` turns: ``(conv_id, segment, text)``."""
    t = rendered_turns(chats).withColumn("segment", F.floor((F.col("place") - 1) / segment))
    return (t.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("place", "rendered"))).alias("x"))
            .select("conv_id", "segment", F.array_join("x.rendered", "").alias("text")))


def collapse(chats: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id, n_turns, n_copies, n_chars, text_sum``.

    ``n_chars`` is the length of the rendered text and ``text_sum`` the sum over its turns
    of the first 8 hex digits of md5(place : rendered turn), so the rendering can be compared
    without carrying it.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("place").cast("string"), F.col("rendered"))), 1, 8), 16, 10).cast("long")
    return (rendered_turns(chats).groupBy("conv_id").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
        F.sum(F.length("rendered").cast("long")).alias("n_chars"), F.sum(digest).alias("text_sum")))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t),
r AS (SELECT conv_id, place, '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
             coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS item FROM p),
c AS (SELECT conv_id, place, line, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM r),
w AS (SELECT conv_id, max(place) AS n_turns, arg_max(prefix, place) AS whole FROM c GROUP BY conv_id),
proper AS (SELECT DISTINCT c.prefix FROM c JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE c.place < w.n_turns),
kept AS (SELECT whole, min(conv_id) AS conv_id, max(n_turns) AS n_turns, count(*) AS n_copies FROM w
         WHERE whole NOT IN (SELECT prefix FROM proper) GROUP BY whole)
SELECT k.conv_id, k.n_turns, k.n_copies, CAST(sum(length(c.line)) AS BIGINT) AS n_chars,
       CAST(sum(('0x' || substr(md5(CAST(c.place AS VARCHAR) || ':' || c.line), 1, 8))::BIGINT) AS BIGINT) AS text_sum
FROM kept k JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
