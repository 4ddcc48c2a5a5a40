"""Operator 2, mixing sources to target weights.

Main path: DataFrame functions only. Each source's documents are laid end to end in words and
cut into blocks of ``BLOCK`` words, of a source below ``BLOCK * FINE`` words of 1 / ``FINE`` of its words. Output shards of ``SHARD`` slots draw multinomial source
counts; a source's slots are numbered over the shards and every pass over the source maps
its slots through a pseudorandom permutation of the block numbers (a Feistel network that is
walked until it lands inside). Blocks are joined by number, and a document gets what its
blocks were drawn.

A shard holds what it has drawn: its slots, at places that a hash of the slot gives, are the order of the mix
(``shards``). A document stands where the slot of its first words in a pass does (``mixed_documents``), and the
digest names the first shard that takes words of it (``first_shard``).

The draws alone would leave each total with binomial noise. So a source's slots are counted
only up to its quota, the slots whose blocks hold the target's words (the partial last block of a
source counts at its real length), and what the draws left open is handed out by the
settlement shards at the end. Of the last slot's block only the words that remain of the target are
taken: every total is its target, rounded to a word.

Defined results: a null or empty text has size 0 and nothing is taken of it; a null source is
the last source; repeated rows are documents of their own; without any word all targets are
0; an empty table gives an empty result; other columns are ignored (``mix``) or carried along
(``mixed_documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.llm.common import WORD, cut_lineage, ranked, row_keyed, table, word_count

#: Weights of the sources in code-point order (null last), repeating; share of all words wanted.
WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2
MAX_REPEATS = 2
BLOCK = 128
#: A source has at least this many blocks, or blocks of one word.
FINE = 64
SHARD = 4096
#: Documents of a source that one task lays end to end (about).
CHUNK_DOCS = 2_000
#: Shards whose counts one task sums.
SHARD_GROUP = 20_000
SEED = 20240607
#: Draws of the multinomial shards, as a share of all slots; the rest settles.
DRAWN = 0.97


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(_src, _size)`` -> one row per source: words, weight, target.

    The cap of a source is ``MAX_REPEATS`` times its words. Sources whose share by weight
    reaches the cap get the cap; the rest share what is left by weight, until none is above.
    """
    per = sizes.groupBy("_src").agg(F.sum("_size").cast("long").alias("words"))
    per = cut_lineage(ranked(per, [F.col("_src").asc_nulls_last()], "_rank"))
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS)).cast("int"))
    per = per.select("_src", "words", weight.alias("weight"), (F.col("words") * MAX_REPEATS).alias("cap"))
    total = (per.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()["w"] * SHARE_NUM) / SHARE_DEN
    rate = 0.0  # target of weight 1
    while True:  # the capped set only grows, so this ends
        capped = F.col("cap") <= F.col("weight") * rate
        s = per.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("cap"),
                    F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weight")).first()  # one row
        new = (total - s["cap"]) / s["weight"] if s["weight"] else rate
        if new <= rate * (1 + 1e-15):
            break
        rate = new
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(rate)))
    size = F.greatest(F.least(F.ceil(F.col("words") / FINE), F.lit(BLOCK)), F.lit(1)).cast("long")
    per = per.select("_src", "words", target.alias("target"), size.alias("_bs"))
    per = per.withColumn("blocks", F.ceil(F.col("words") / F.col("_bs")).cast("long"))
    some = F.greatest("words", F.lit(1))
    want = F.round("target").cast("long")
    # whole passes take all words; of the last pass as many slots as hold the rest of the target
    per = per.withColumn("_full", F.floor(want / some).cast("long")).withColumn("_rest", want - F.col("_full") * F.col("words"))
    short = F.col("blocks") * F.col("_bs") - F.col("words")  # words that the last block lacks
    tail = _tail_at(F.col("_src"), F.col("_full"), F.col("blocks"))
    n = F.ceil(F.col("_rest") / F.col("_bs")).cast("long")
    n = F.when(n <= tail, n).otherwise(F.ceil((F.col("_rest") + short) / F.col("_bs")).cast("long"))
    n = F.when(F.col("_rest") > 0, n).otherwise(F.lit(0).cast("long"))
    over = n * F.col("_bs") - F.when(n > tail, short).otherwise(F.lit(0)) - F.col("_rest")  # words of the last slot beyond the target
    quota = F.col("_full") * F.col("blocks") + n
    return cut_lineage(per.select("_src", "words", "target", "blocks", quota.alias("quota"),
                                  F.struct(F.col("_bs").alias("size"), short.alias("short"), over.alias("over"), quota.alias("quota")).alias("cut")))


def _tail_at(src: Column, pass_: Column, blocks: Column) -> Column:
    """Slot of a pass that holds the source's last block, which may be a partial one."""
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit("tail"), src, pass_), F.greatest(blocks, F.lit(1).cast("long")))


def _place(k: Column, n: Column, salt: Column) -> Column:
    """Pseudorandom permutation of 0 .. n-1 at ``k``: four Feistel rounds on a grid of
    ceil(sqrt(n)) by ceil(n / that), repeated while the value lies outside (under 1 of sqrt(n) do)."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def round_(x: Column, r: Column) -> Column:
        high, low = F.floor(x / b).cast("long"), x % b
        even = r % 2 == 0
        draw = F.xxhash64(F.lit(SEED), salt, r, F.when(even, low).otherwise(high))
        return F.when(even, (high + F.pmod(draw, a)) % a * b + low).otherwise(high * b + (low + F.pmod(draw, b)) % b)

    once = lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(3)), x, round_)
    # 32 repeats reach every value for n up to 1,024; beyond, the chance of more is under 1e-48
    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(32)), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    return F.get(F.transform(F.array(once(k)), lambda x: F.when(x < n, x).otherwise(walk(x))), F.lit(0))


def quota_ranges(per: DataFrame) -> tuple[DataFrame, int]:
    """Each source's range ``_from .. _from + quota - 1`` of 0 .. n-1, and n, the sum of all quotas."""
    quotas = per.where("quota > 0")
    n_slots = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    edges = cut_lineage(ranked(quotas.select("_src", "quota", "blocks", "cut"), [F.col("_src").asc_nulls_last()], "_rank"))
    # cumulated quotas; sources are few against slots, chunks of the ranks keep the window local
    chunk = F.floor(F.col("_rank") / SHARD_GROUP)
    own = F.sum("quota").over(Window.partitionBy(chunk).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1))
    sums = edges.groupBy(chunk.alias("_c")).agg(F.sum("quota").alias("q"))
    before = F.coalesce(F.sum("q").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = (edges.withColumn("_c", chunk).withColumn("_own", F.coalesce(own, F.lit(0)))
             .join(sums.select("_c", before.alias("_before")), "_c").withColumn("_from", F.col("_own") + F.col("_before")))
    return edges, n_slots


def slot_counts(per: DataFrame) -> DataFrame:
    """Per shard and source: the first of its slot numbers and how many, ``(shard, _src, blocks, cut, first, n)``.

    Every slot of a shard draws its source (inverse distribution function at a hash of the
    slot), which makes the shard's source counts multinomial. The counts are summed over
    the shards to number a source's slots.
    """
    spark = per.sparkSession
    edges, n_slots = quota_ranges(per)
    n_drawn = int(n_slots * DRAWN)
    slots = (spark.range(n_drawn).select((F.col("id") / SHARD).cast("long").alias("shard"),
                                         F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(n_slots, 1))).alias("u")))
    # a slot's value falls into the range of exactly one source; ranges are found by equal cells of values
    width = max(1, n_slots // 65_536)
    near = edges.select("_src", "blocks", "cut", "quota", "_from", F.explode(F.sequence(
        F.floor(F.col("_from") / width), F.floor((F.col("_from") + F.col("quota") - 1) / width))).alias("_cell"))
    hit = (slots.withColumn("_cell", F.floor(F.col("u") / width)).join(near, "_cell")
           .where((F.col("u") >= F.col("_from")) & (F.col("u") < F.col("_from") + F.col("quota"))))
    drawn = cut_lineage(hit.groupBy("shard", "_src", "blocks", "cut", "quota").agg(F.count(F.lit(1)).alias("n")))
    group = F.floor(F.col("shard") / SHARD_GROUP)
    w = Window.partitionBy("_src", group).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn.groupBy("_src", group.alias("_g")).agg(F.sum("n").alias("gn"))
    gw = Window.partitionBy("_src").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_src").alias("_s"), F.col("_g").alias("_gg"), F.coalesce(F.sum("gn").over(gw), F.lit(0)).alias("_gb"))
    numbered = drawn.withColumn("_own", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("_g", group)
    numbered = numbered.join(sums, numbered["_src"].eqNullSafe(sums["_s"]) & (numbered["_g"] == sums["_gg"]))
    first = F.col("_own") + F.col("_gb")
    taken = numbered.select("shard", "_src", "blocks", "cut", first.alias("first"), F.least(F.col("n"), F.col("quota") - first).alias("n")).where("n > 0")
    # settlement shards: what the draws left of each quota, in shards of SHARD slots, after the drawn ones
    got = taken.groupBy("_src").agg(F.sum("n").alias("got")).withColumnRenamed("_src", "_s")
    q = per.where("quota > 0").join(got, F.col("_src").eqNullSafe(F.col("_s")), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    rest = (q.where("got < quota")
            .select("_src", "blocks", "cut", "quota", F.explode(F.sequence(F.col("got"), F.col("quota") - 1, F.lit(SHARD).cast("long"))).alias("first"))
            .select("_src", "blocks", "cut", "first", F.least(F.lit(SHARD).cast("long"), F.col("quota") - F.col("first")).alias("n")))
    rest = ranked(rest, [F.col("_src").asc_nulls_last(), F.col("first")], "shard").withColumn("shard", F.col("shard") + F.lit(-(-n_drawn // SHARD)))
    return taken.unionByName(rest)


def drawn_blocks(counts: DataFrame) -> DataFrame:
    """``(shard, _at_shard, _src, _block, _pass, _words)``: a row for every slot, with its shard, a hash that is its
    place there, the block that it maps to and how many words of it are taken."""
    # few rows become many here: dealt out first, or they would stay in the few tasks that hold them
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = (counts.repartition(parts, "_src", "first")
             .select("shard", "_src", "blocks", "cut", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
             .withColumn("_pass", F.floor(F.col("k") / F.col("blocks")).cast("long")).withColumn("_j", F.col("k") % F.col("blocks")))
    slots = slots.withColumn("_tail", _tail_at(F.col("_src"), F.col("_pass"), F.col("blocks")))
    # the last block has a slot of its own; the others are permuted over the slots around it
    salt, others = F.xxhash64(F.col("_src"), F.col("_pass")), F.col("blocks") - 1
    place = _place(F.col("_j") - (F.col("_j") > F.col("_tail")).cast("long"), F.greatest(others, F.lit(1).cast("long")), salt)
    is_tail = F.col("_j") == F.col("_tail")
    words = F.col("cut.size") - F.when(is_tail, F.col("cut.short")).otherwise(F.lit(0))
    words = words - F.when(F.col("k") == F.col("cut.quota") - 1, F.col("cut.over")).otherwise(F.lit(0))
    at = F.xxhash64(F.lit(SEED), F.lit("at"), "shard", "_src", "k")
    return slots.select("shard", at.alias("_at_shard"), "_src", "_pass", F.when(is_tail, others).otherwise(place).alias("_block"), words.alias("_words"))


def laid_out(sizes: DataFrame, order: list[str]) -> DataFrame:
    """Documents of each source end to end: adds ``_start``, the words of its source before it.

    A source is cut into hash chunks of about ``CHUNK_DOCS`` documents, summed inside each
    chunk, and the chunks' totals are summed over the chunks, so a source with a third
    of all rows is no single task.
    """
    n_chunks = max(1, -(-sizes.count() // CHUNK_DOCS))
    d = sizes.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(n_chunks)))
    w = Window.partitionBy("_src", "_chunk").orderBy(*order, "_size").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_src", "_chunk").agg(F.sum("_size").alias("_t"))
    tw = Window.partitionBy("_src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_src").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_t").over(tw), F.lit(0)).alias("_before"))
    d = d.withColumn("_own", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    return (d.join(totals, d["_src"].eqNullSafe(totals["_s"]) & (d["_chunk"] == totals["_c"]))
            .withColumn("_start", (F.col("_own") + F.col("_before")).cast("long")).drop("_s", "_c", "_own", "_before", "_chunk"))


def overlaps(laid: DataFrame, key: list[str]) -> DataFrame:
    """A row per document and block (of ``_bs`` words) that it reaches into: ``_lo`` and ``_hi`` are the
    document's words there, ``_at`` is where the block starts, counted from the document's start."""
    first, last = F.floor(F.col("_start") / F.col("_bs")), F.floor((F.col("_start") + F.col("_size") - 1) / F.col("_bs"))
    at = F.col("_block") * F.col("_bs") - F.col("_start")
    return (laid.where("_size > 0").select(*key, "_src", "_start", "_size", "_bs", F.explode(F.sequence(first, last)).alias("_block"))
            .select(*key, "_src", "_block", at.alias("_at"), F.greatest(at, F.lit(0)).alias("_lo"), F.least(at + F.col("_bs"), F.col("_size")).alias("_hi")))


def _drawn_overlaps(laid: DataFrame, per: DataFrame, counts: DataFrame, key: list[str], by_pass: bool) -> DataFrame:
    """Words of documents that the mix takes: per slot, or (not ``by_pass``) per block with the number of its slots."""
    cells = drawn_blocks(counts).select(F.xxhash64(F.coalesce("_src", F.lit("")), F.col("_src").isNull()).alias("_sh"), "_block", "_pass", "_words", "shard", "_at_shard")
    cells = cells if by_pass else cells.groupBy("_sh", "_block", "_words").agg(F.count(F.lit(1)).alias("_times"), F.min("shard").alias("shard"))
    sized = per.select(F.col("_src").alias("_s"), F.col("cut.size").alias("_bs"))
    laid = laid.join(sized, laid["_src"].eqNullSafe(sized["_s"])).drop("_s")
    parts = overlaps(laid, key).withColumn("_sh", F.xxhash64(F.coalesce("_src", F.lit("")), F.col("_src").isNull()))
    # slots grow with the corpus, but the planner sizes them by the few counts they are unrolled from: no broadcast
    cells = cells.hint("merge")
    # of a block that is taken in part, only its first words
    return (parts.join(cells, ["_sh", "_block"]).withColumn("_hi", F.least("_hi", F.col("_at") + F.col("_words"))).where("_hi > _lo"))


def _sized(docs: DataFrame, source: str) -> DataFrame:
    return cut_lineage(docs.select("doc_id", F.col(source).cast("string").alias("_src"), word_count(F.col("text")).alias("_size"))
                       .withColumn("_uid", F.monotonically_increasing_id()))


def mix(docs: DataFrame, source: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and ``first_shard`` (null: nothing is taken)."""
    sizes = _sized(docs, source)
    per = targets(sizes)
    laid = cut_lineage(laid_out(sizes, ["doc_id", "_uid"]))
    took = (_drawn_overlaps(laid, per, slot_counts(per), ["_uid"], False).groupBy("_uid")
            .agg(F.sum((F.col("_hi") - F.col("_lo")) * F.col("_times")).cast("long").alias("_taken"), F.min("shard").alias("first_shard")))
    p = per.select(F.col("_src").alias("_s"), "words", "target")
    out = laid.join(took, "_uid", "left").join(p, laid["_src"].eqNullSafe(p["_s"]))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("words").alias("source_size"), "target",
                      F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def shards(docs: DataFrame, source: str = "source") -> DataFrame:
    """The mix in its order: a row per slot and document in it, ``shard, place, source, doc_id, first_word, n_words``.

    ``place`` numbers a shard's slots, which its sources share as drawn.
    """
    sizes = _sized(docs, source)
    per = targets(sizes)
    laid = cut_lineage(laid_out(sizes, ["doc_id", "_uid"]))
    taken = _drawn_overlaps(laid, per, slot_counts(per), ["_uid", "doc_id"], True)
    slot = Window.partitionBy("shard").orderBy("_at_shard", "_src", "_pass", "_block")  # at most SHARD slots and their documents
    return taken.select("shard", (F.dense_rank().over(slot) - 1).alias("place"), F.col("_src").alias("source"), "doc_id",
                        F.col("_lo").alias("first_word"), (F.col("_hi") - F.col("_lo")).alias("n_words"))


def mixed_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """The mix as documents with the columns of ``docs``, in its order: a row per document and pass that took
    of it, where the slot of its first words stands (the first of all its slots would crowd long documents into the first shards).

    A document that a pass took whole keeps its text; of others the row holds the words of
    the drawn blocks, in order and one blank apart. ``n_chars``, if there, follows the text.
    """
    columns = docs.columns
    keyed = row_keyed(docs)
    key = ["__file", "__place"]
    sizes = cut_lineage(keyed.select(*key, F.col("_row")[source].cast("string").alias("_src"), word_count(F.col("_row")["text"]).alias("_size")))
    per = targets(sizes)
    laid = cut_lineage(laid_out(sizes, key))
    counts = cut_lineage(slot_counts(per))
    n_shards = (counts.agg(F.max("shard").alias("n")).first()["n"] or 0) + 1  # one row
    spans = (_drawn_overlaps(laid, per, counts, key, True).groupBy(*key, "_pass")
             .agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi"))).alias("_spans"),  # a document's own blocks
                  F.min_by(F.struct("shard", "_at_shard"), F.struct("_lo", "shard")).alias("_stands")))
    got = spans.select(F.col("__file").alias("_gf"), F.col("__place").alias("_gr"), "_pass", "_spans", "_stands").hint("merge")  # grows with the corpus: no broadcast
    rows = keyed.select(*key, F.col("_row")["text"].alias("_t"), F.col("_row").alias("_all"))
    rows = rows.join(got, (rows["__file"] == got["_gf"]) & (rows["__place"] == got["_gr"]))
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["_hi"] - s["_lo"]) == word_count(F.col("_t"))
    cut = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "_spans", lambda s: F.slice(w, (s["_lo"] + 1).cast("int"), (s["_hi"] - s["_lo"]).cast("int")))), " ")), F.lit(0))
    rows = rows.withColumn("_text", F.when(whole, F.col("_t")).otherwise(cut))
    # consecutive shards to each partition; shards are equally large, so nothing has to be sampled
    parts = min(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionById(parts, (F.col("_stands.shard") * parts / n_shards).cast("int"))
    rows = rows.sortWithinPartitions("_stands", "__file", "__place", "_pass")
    new = {"text": F.col("_text")}
    if "n_chars" in columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[(new[c] if c in new else F.col("_all")[c]).alias(c) for c in columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
