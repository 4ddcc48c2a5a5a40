"""Operator 8, near-duplicate join on word n-grams: MinHash LSH forest, then exact Jaccard.

1. Each document gets a MinHash signature of its 5-word shingles (one of its whole word
   sequence if shorter), cut into ``TREES`` labels of ``DEPTH`` values.
   Documents of the same word sequence are one class; only its first row goes on.
2. A tree is the prefix trie of its labels. Rows are compared by signature with those that share a prefix with them in
   some tree. The longest prefix that may be asked for is the greatest depth at which a pair of the similarity asked for is
   missed by all trees with a probability ``(1 - s^d)^TREES`` of at most ``MISSED`` (at 0.8 six values, 6e-5). From there a
   prefix is shortened value by value, up to ``SHORTEN`` times, as long as the node that it leads to holds at most ``CROWD`` rows:
   where a shorter prefix costs little, recall rises (at two values less, 5e-8), and frequent prefixes
   stay long. Nodes are counted from the short end: those with more rows than ``CROWD`` give them to their children.
   Nodes that are crowded at full length are cut into blocks and every pair of blocks is a piece of work of bounded size.
   Rows that are connected already are not compared again.
3. Signature matches connect the candidates; each connected set is compared exactly,
   all members with all, on their shingle sets, again in pairs of blocks of bounded size.
   Pairs are counted where they are compared; only counts and a spanning forest leave a task.

Defined results: a null text, or one without words, has no shingles: it links to nothing and
is its own class; repeated rows are copies; a document without links has its own doc_id as
class; an empty table gives an empty result; other columns are ignored (``join``) or carried
along (``keep_one``). A class is named by its least doc_id, null if it has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import connected_components, cut_lineage, row_keyed, table
from wearline.llm.runs import in_runs

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 32, 6
#: Greatest probability with which the trees may miss a pair at the similarity asked for.
MISSED = 1e-4
#: Values by which a matched prefix may be shortened, and rows of a node that it may then lead to.
SHORTEN = 2
CROWD = 256
#: A pair is a candidate if its signatures agree up to this many standard errors below the similarity (0.68 at 0.8).
ERRORS = 4.25
#: Rows of a block when signatures, and when shingle sets are compared; shingles of a block.
BLOCK_ROWS = 2048
BLOCK_SETS = 512
BLOCK_SHINGLES = 1_000_000
#: Up to this many texts are looked up by a broadcast of their keys (16 bytes each).
BROADCAST_KEYS = 2_000_000
#: Bytes of a text that are hashed at once.
PIECE_BYTES = 1 << 20


# --- shingles and signatures ----------------------------------------------------------------------


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]:
    """Random value of each byte, which bytes are white space, a factor and its inverse mod 2^64."""
    rng = np.random.default_rng(5)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    factor = 0x9E3779B97F4A7C15  # odd, so it has an inverse
    return rng.integers(0, 2**64, 256, dtype=np.uint64), space, np.uint64(factor), np.uint64(pow(factor, -1, 2**64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 of the factor and of its inverse."""
    _, _, factor, inverse = _byte_tables()
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, f, np.uint64)])) for f in (factor, inverse))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes that are no ASCII white space), in order.

    A word's hash is the sum of its bytes' values times powers of a factor, taken from
    running sums over the text, which goes piece by piece, cut at white space.
    """
    values, space, _, _ = _byte_tables()
    raw, found, start = np.frombuffer(data, np.uint8), [], 0
    while start < len(raw):
        end = start + PIECE_BYTES
        while end < len(raw) and not space[raw[end]]:
            end += 1
        part = raw[start:end]
        start = end
        inside = ~space[part]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, after = edge[::2], edge[1::2]
        if len(first):
            up, down = _powers(max(1 << 16, 1 << (len(part) - 1).bit_length()))
            with np.errstate(over="ignore"):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(values[part] * up[: len(part)])])
                found.append(_mix((sums[after] - sums[first]) * down[first] + (after - first).astype(np.uint64)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish, so that sums of products spread over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the n-word shingles of word hashes, sorted; a shorter text is one shingle."""
    if not len(h):
        return h
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = _mix(acc + h[i : i + len(acc)])
    return np.unique(acc)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = TREES * DEPTH
    return (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]


def signature(sh: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` MinHash values of 32 bits."""
    a, b = _permutations()
    low, out = (sh >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(low), 2048):
        part = (low[None, i : i + 2048] * a + b).min(1)
        out = part if out is None else np.minimum(out, part)
    return _scramble(out)


def _scramble(x: np.ndarray) -> np.ndarray:
    """Minima are small numbers; spread them so that their low byte is a good sketch."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key columns..., text) -> (key columns..., k1, k2, n_shingles, labels, sketch)."""
    for batch in batches:
        k1, k2, n, labels, sketches = [], [], [], [], []
        for text in batch.column(batch.num_columns - 1):
            words = word_hashes(text.as_buffer() if text.is_valid else b"")
            sh = shingles(words)
            d = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
            k1.append(int.from_bytes(d[:8], "little", signed=True)), k2.append(int.from_bytes(d[8:], "little", signed=True))
            n.append(len(sh))
            if len(sh):
                sig = signature(sh)
                labels.append(sig.tobytes()), sketches.append(sig.astype(np.uint8).tobytes())
            else:
                labels.append(None), sketches.append(None)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        cols = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(kept + cols, [*batch.schema.names[:-1], "k1", "k2", "n_sh", "labels", "sketch"])


def prefix_depth(similarity: float = SIMILARITY, missed: float = MISSED) -> int:
    """The longest prefix with which pairs of this similarity are hardly missed, whatever the nodes hold."""
    for depth in range(DEPTH, 0, -1):
        if (1 - similarity**depth) ** TREES <= missed:
            return depth
    raise ValueError(f"similarity {similarity} is too low: {TREES} trees would lose links even at depth 1")


def candidate_cut(similarity: float = SIMILARITY) -> float:
    """Signature agreement from which a pair is compared exactly."""
    return similarity - ERRORS * (similarity * (1 - similarity) / (TREES * DEPTH)) ** 0.5


# --- comparing sorted runs in blocks --------------------------------------------------------------


def least_members(n: int, linked) -> np.ndarray:
    """For rows 0 .. n-1 the least row of their connected set; ``linked(i, part)`` gives the rows that row i is linked to,
    of which those of its own set (``part``) may be left out."""
    part = np.arange(n)
    for i in range(n):
        met = np.unique(part[linked(i, part)])
        met = met[met != part[i]]
        if len(met):
            whole = np.append(met, part[i])
            part[np.isin(part, whole)] = whole.min()
    return part


def _stars(uid: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest: (least member, member)."""
    return [(int(uid[r]), int(uid[k])) for k, r in enumerate(part.tolist()) if r != k]


def _across(tab: pa.Table) -> bool:
    """Whether a run is a pair of two blocks, of which only pairs across count. The key tells: one of the blocks may be empty."""
    return tab.column("b1")[0].as_py() != tab.column("b2")[0].as_py()


def _alike(similarity: float):
    """Candidate edges of one pair of blocks: rows whose signatures agree enough."""
    cut = candidate_cut(similarity)

    def work(tab: pa.Table) -> list[tuple[int, int]]:
        uid = tab.column("uid").to_numpy()
        sketch = np.frombuffer(b"".join(tab.column("sketch").to_pylist()), np.uint8).reshape(len(uid), -1)
        least = (cut * (1 - 1 / 256) + 1 / 256) * sketch.shape[1]  # agreement by chance taken in
        if len(uid) == 2:
            return [(int(uid[0]), int(uid[1]))] if (sketch[0] == sketch[1]).sum() >= least else []
        side = tab.column("side").to_numpy()
        cross = _across(tab)

        def alike(i: int, part: np.ndarray) -> np.ndarray:
            others = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1  # only what is not connected yet
            if cross:
                others = others[side[others] != side[i]]
            return others[(sketch[others] == sketch[i]).sum(1) >= least]

        return _stars(uid, least_members(len(uid), alike))

    return work


LINKS = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("texts", pa.int64()), ("docs", pa.int64())])


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of all pairs: shared shingles by products of 0/1 columns."""
    sizes = np.array([len(s) for s in sets], np.float64)
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    count = np.bincount(inverse)
    common = np.zeros((len(sets), len(sets)), np.float32)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(every), -1)
    number[shared] = np.arange(len(shared))
    col = number[inverse]
    keep = col >= 0
    col, row = col[keep], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    width = max(256, 8_000_000 // len(sets))  # columns of a product, so that it stays small
    for c in range(0, len(shared), width):
        lo, hi = np.searchsorted(col, (c, c + width))
        m = np.zeros((len(sets), min(width, len(shared) - c)), np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    return common / union


def _verify(similarity: float):
    """Exact links of one pair of blocks: counts per row and a spanning forest of the links."""

    def work(tab: pa.Table) -> list[tuple[int, int, int, int]]:
        seen: dict[int, int] = {}
        for i, u in enumerate(tab.column("uid").to_pylist()):
            seen.setdefault(u, i)  # repeated rows of the first copy come more than once
        rows = list(seen.values())
        uid = np.array(list(seen))
        texts, side = tab.column("text"), tab.column("side").to_numpy()[rows]
        if len(rows) < 2 or (_across(tab) and len(np.unique(side)) < 2):
            return []
        copies = tab.column("copies").to_numpy()[rows]
        sets = [shingles(word_hashes(texts[i].as_buffer())) for i in rows]
        if len(rows) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            linked = np.zeros((2, 2), bool)
            linked[0, 1] = linked[1, 0] = both >= similarity * (len(sets[0]) + len(sets[1]) - both) - 1e-9
        else:
            linked = _similar(sets) >= similarity - 1e-12
            np.fill_diagonal(linked, False)
        if _across(tab):
            linked &= side[:, None] != side[None, :]
        out = [(int(uid[i]), None, int(linked[i].sum()), int(copies[linked[i]].sum())) for i in np.flatnonzero(linked.any(1))]
        tree = _stars(uid, least_members(len(uid), lambda i, _: np.flatnonzero(linked[i])))
        return out + [(a, b, 0, 0) for a, b in tree]

    return work


def _in_blocks(rows: DataFrame, key: str, n_blocks: Column) -> DataFrame:
    """Deal the rows of a key to blocks and copy each to all pairs of blocks that hold its own.

    ``side`` tells the two blocks of a pair apart; a pair of a block with itself compares
    all inside, a pair of two blocks only across.
    """
    d = rows.withColumn("nb", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("nb")).cast("int"))
    d = d.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return (d.withColumn("b1", F.least("block", "mate")).withColumn("b2", F.greatest("block", "mate"))
            .withColumn("side", F.col("block")).drop("nb", "block", "mate"))


def _dealt(d: DataFrame, key: str) -> DataFrame:
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(n, key, "b1", "b2").sortWithinPartitions(key, "b1", "b2", "uid")


# --- the join -------------------------------------------------------------------------------------


def signatures(keyed: DataFrame, key: list[str]) -> DataFrame:
    """Signature rows of all documents, with a number ``uid`` that is fixed by the checkpoint."""
    d = keyed.select(*key, F.xxhash64("text").alias("th"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    schema = f"{fields}, k1 long, k2 long, n_sh long, labels binary, sketch binary"
    return cut_lineage(d.mapInArrow(_sign, schema).withColumn("uid", F.monotonically_increasing_id()))


def _nodes(rows: DataFrame) -> DataFrame:
    """``rows(uid, node, rest)`` that share their node, with the number ``n`` of those that do."""
    # written out, so that the join reads two plain shuffles and the rows of a hot node can be split
    shared = cut_lineage(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut_lineage(rows.join(shared, "node"))


def matched_prefixes(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, uid, n)``: the node in which each row is compared in each tree, where it has company.

    A row carries the values of its label that its node leaves out, so a child's name follows from its parent's.
    """
    full = prefix_depth(similarity)
    depth = max(1, full - SHORTEN)
    label = lambda t, first, n: F.substring(F.col("labels"), t * (DEPTH * 4) + (first * 4 + 1), F.lit(n * 4))
    every = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)),
                        lambda t: F.struct(F.xxhash64(t, label(t, 0, depth)).alias("node"), label(t, depth, full - depth).alias("rest")))
    met = _nodes(reps.select("uid", F.explode(every).alias("x")).select("uid", "x.node", "x.rest"))
    found = None
    while True:
        here = (met if depth == full else met.where(F.col("n") <= CROWD)).select("node", "uid", "n")
        found = here if found is None else found.unionByName(here)
        crowded = met.where(F.col("n") > CROWD)
        if depth == full or crowded.isEmpty():
            return found
        depth += 1
        child = F.xxhash64("node", F.substring(F.col("rest"), F.lit(1), F.lit(4)))
        met = _nodes(crowded.select("uid", child.alias("node"), F.substring(F.col("rest"), F.lit(5), F.lit(DEPTH * 4)).alias("rest")))


def candidates(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges between rows whose signatures agree, found through the trees' shared prefixes."""
    rows = matched_prefixes(reps, similarity).join(reps.select("uid", "sketch"), "uid")
    dealt = _dealt(_in_blocks(rows, "node", F.ceil(F.col("n") / BLOCK_ROWS)), "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return dealt.select("node", "b1", "b2", "side", "uid", "sketch").mapInArrow(in_runs(["node", "b1", "b2"], _alike(similarity), schema), "a long, b long")


def links(keyed: DataFrame, key: list[str], reps: DataFrame, similarity: float) -> DataFrame:
    """Exact links between different word sequences: ``(uid, other, texts, docs)`` rows, see ``_verify``."""
    sets = connected_components(candidates(reps, similarity))  # node, root
    members = cut_lineage(reps.join(sets, reps["uid"] == sets["node"]).select(*key, "th", "uid", "n_sh", "copies", F.col("root").alias("comp")))
    size = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_sh") / BLOCK_SHINGLES)).alias("nb"))
    work = members.join(size, "comp")
    texts = keyed.select(*[F.col(k).alias("_" + k) for k in key], F.xxhash64("text").alias("_th"), "text")
    if members.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(members.select(F.col("th").alias("_th")).distinct()), "_th", "left_semi")
    same = (F.col("_th") == F.col("th"))
    for k in key:
        same &= F.col("_" + k).eqNullSafe(F.col(k))
    found = work.join(texts, same).select("comp", "nb", "uid", "copies", "text")
    dealt = _dealt(_in_blocks(found, "comp", F.col("nb")), "comp")
    return cut_lineage(dealt.select("comp", "b1", "b2", "side", "uid", "copies", "text")
                       .mapInArrow(in_runs(["comp", "b1", "b2"], _verify(similarity), LINKS), "uid long, other long, texts long, docs long"))


def classes(keyed: DataFrame, key: list[str], similarity: float = SIMILARITY) -> DataFrame:
    """Every row with ``copy`` (uid of its word sequence's first row), ``root`` (some uid of its
    class) and its links: ``text_links`` to different word sequences, ``n_links`` to other documents."""
    sig = signatures(keyed, key)
    same = cut_lineage(sig.groupBy("k1", "k2").agg(F.min("uid").alias("copy"), F.count(F.lit(1)).alias("copies")))
    reps = sig.join(same.select(F.col("copy").alias("uid"), "copies"), "uid").where("n_sh > 0")
    found = links(keyed, key, reps, similarity)
    counts = found.groupBy("uid").agg(F.sum("texts").alias("text_links"), F.sum("docs").alias("doc_links")).withColumnRenamed("uid", "copy")
    roots = connected_components(found.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    of_copy = (same.join(roots.withColumnRenamed("node", "copy"), "copy", "left").join(counts, "copy", "left")
               .select("k1", "k2", "copy", "copies", F.coalesce("root", "copy").alias("root"),
                       F.coalesce("text_links", F.lit(0)).alias("text_links"), F.coalesce("doc_links", F.lit(0)).alias("doc_links")))
    out = sig.select(*key, "uid", "k1", "k2", "n_sh").join(of_copy, ["k1", "k2"])
    alone = F.col("n_sh") == 0
    return out.select(*key, "uid", F.when(alone, F.col("uid")).otherwise(F.col("copy")).alias("copy"),
                      F.when(alone, F.col("uid")).otherwise(F.col("root")).alias("root"),
                      F.when(alone, F.lit(0)).otherwise(F.col("text_links")).cast("long").alias("text_links"),
                      F.when(alone, F.lit(0)).otherwise(F.col("doc_links") + F.col("copies") - 1).cast("long").alias("n_links"))


def join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, text_links`` (see ``classes``)."""
    rows = cut_lineage(classes(docs.select("doc_id", "text"), ["doc_id"], similarity))
    names = cut_lineage(rows.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    return rows.join(names, "root").select("doc_id", "class_id", "n_links", "text_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: its least doc_id (nulls last), then its first row."""
    key = ["__file", "__place"]
    keyed = row_keyed(docs)
    rows = cut_lineage(classes(keyed.select(*key, F.col("_row.text").alias("text")), key, similarity).select(*key, "root"))
    here = (F.col("__file") == F.col("__f")) & (F.col("__place") == F.col("__r"))
    ids = keyed.select(F.col("__file").alias("__f"), F.col("__place").alias("__r"), F.col("_row.doc_id").alias("doc_id"))
    rows = rows.join(ids, here)
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "__file", "__place")
    best = rows.groupBy("root").agg(F.min(first).alias("m")).select(F.col("m.__file").alias("__f"), F.col("m.__place").alias("__r"))
    gone = rows.select("__file", "__place").join(best, here, "left_anti")
    gone = cut_lineage(gone.select(F.col("__file").alias("__f"), F.col("__place").alias("__r")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return keyed.join(gone, here, "left_anti").select("_row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
