"""Operator 3, approximate nearest neighbours: a forest of random-projection trees, then exact reranking.

The trees are grown on a sample of the rows (``SAMPLE``) by random hyperplanes between two rows; every row is put
into its leaf of each tree. A query walks all trees with one priority queue (nearest hyperplane margin first) and
takes leaves until they hold a share of all rows. That share is calibrated on the sample: ``CALIBRATE`` of its rows are
asked for their nearest rows of the sample, and the share is what ``RECALL`` of these neighbours need. Neighbours in the
whole table lie nearer than in the sample, so they need no larger share of the leaves.

A leaf's rows are cut into chunks of ``CHUNK`` and the queries that took it into blocks of ``BLOCK``; a chunk and a block
meet in one piece of work. A row that a query meets in several trees is ranked in the first of them only. Distances are
exact, in double precision, on the original vectors.

Defined results: vectors that are null, zero, hold null or non-finite components or are not of the most frequent
length take no part, nor do null vec_ids; repeated rows are rows of their own (ties by vec_id); a table
without queries or rows gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.llm.common import cut_lineage, table
from wearline.llm.runs import in_runs

NEAREST = 10
QUERY_EVERY = 100
SAMPLE = 16_384
TREES = 4
LEAF = 256
#: Rows of the sample that are asked, neighbours each, and the share of these that has to be met.
CALIBRATE, CALIBRATE_NEAREST, RECALL = 256, 10, 0.95
CHUNK, BLOCK = 4096, 512
SEED = 3


# --- the forest -----------------------------------------------------------------------------------


class Tree:
    """Inner nodes as arrays; a negative child -1-k is leaf k."""

    def __init__(self, rows: np.ndarray, rng: np.random.Generator):
        self.normals, self.cuts, self.children, self.leaves = [], [], [], 0
        self.top = self._grow(rows, np.arange(len(rows)), rng)
        self.normals = np.array(self.normals).reshape(len(self.normals), rows.shape[1])

    def _grow(self, rows: np.ndarray, idx: np.ndarray, rng: np.random.Generator) -> int:
        for _ in range(3 if len(idx) > LEAF else 0):
            a, b = rng.choice(idx, 2, replace=False)
            normal = rows[a] - rows[b]
            length = np.linalg.norm(normal)
            if not length:
                continue
            p = rows[idx] @ (normal / length)
            cut = np.median(p)
            right = p >= cut
            if right.all():
                right = p > cut
                cut = p[right].min() if right.any() else cut
            if right.any() and not right.all():
                k = len(self.cuts)
                self.normals.append(normal / length), self.cuts.append(cut), self.children.append(None)
                self.children[k] = (self._grow(rows, idx[~right], rng), self._grow(rows, idx[right], rng))
                return k
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(self.top, np.arange(len(x)))]
        while todo:
            k, idx = todo.pop()
            if k < 0:
                out[idx] = -1 - k
            elif len(idx):
                right = x[idx] @ self.normals[k] >= self.cuts[k]
                todo += [(self.children[k][0], idx[~right]), (self.children[k][1], idx[right])]
        return out


def search(forest: list[Tree], counts: list[np.ndarray], query: np.ndarray, rows: float) -> list[tuple[int, int]]:
    """Leaves ``(tree, leaf)`` in the order of one queue over all trees, until they hold ``rows`` rows."""
    sides = [t.normals @ query - np.array(t.cuts) if len(t.cuts) else np.empty(0) for t in forest]
    queue = [(0.0, t, tree.top) for t, tree in enumerate(forest)]
    found, held = [], 0
    while queue and held < rows:
        far, t, k = heapq.heappop(queue)
        if k < 0:
            found.append((t, -1 - k))
            held += counts[t][-1 - k]
            continue
        side = sides[t][k]
        left, right = forest[t].children[k]
        near, other = (right, left) if side >= 0 else (left, right)
        heapq.heappush(queue, (far, t, near))
        heapq.heappush(queue, (max(far, abs(side)), t, other))
    return found


def calibrated(forest: list[Tree], x: np.ndarray) -> float:
    """Share of the rows (summed over the trees) that the leaves must hold to meet ``RECALL`` of the sample's nearest neighbours."""
    if len(x) <= CALIBRATE_NEAREST:
        return float(TREES)
    leaf = [t.leaf_of(x) for t in forest]
    counts = [np.bincount(f, minlength=max(t.leaves, 1)) for t, f in zip(forest, leaf, strict=True)]
    rng, need = np.random.default_rng(SEED + 1), []
    norms = (x * x).sum(1)
    for i in rng.choice(len(x), min(CALIBRATE, len(x)), replace=False):
        d = norms - 2 * (x @ x[i])
        d[i] = np.inf
        near = np.argpartition(d, CALIBRATE_NEAREST - 1)[:CALIBRATE_NEAREST]
        held, met = 0, np.full(len(near), np.inf)
        for t, f in search(forest, counts, x[i], np.inf):
            inside = leaf[t][near] == f
            met[inside] = np.minimum(met[inside], held)  # the search goes on while it holds fewer
            held += counts[t][f]
        need += (met / len(x)).tolist()
    return float(np.quantile(need, RECALL)) + LEAF / len(x)


# --- the search -----------------------------------------------------------------------------------


def valid_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """``(uid, vec_id, v)`` of the rows that take part; v as doubles, uid fixed by the checkpoint."""
    d = rows.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    d = d.where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    d = cut_lineage(d.withColumn("uid", F.monotonically_increasing_id()))
    most = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.where(F.size("v") == (most[0]["n"] if most else 0))


def fit(rows: DataFrame, n: int) -> tuple[list[Tree], float]:
    """The forest on at most ``SAMPLE`` rows, those with the least hashes, and the share of rows that a query visits."""
    share = min(1.0, 2.0 * SAMPLE / max(n, 1))
    key = F.xxhash64("uid", F.lit(SEED))
    near = rows.where(F.pmod(key, F.lit(1_000_003)) / 1_000_003 < share)  # some more than needed
    x = np.array([r["v"] for r in near.orderBy(key, "uid").limit(SAMPLE).select("v").collect()], np.float64)
    if not len(x):
        return [], 0.0
    rng = np.random.default_rng(SEED)
    forest = [Tree(x, rng) for _ in range(TREES)]
    return forest, calibrated(forest, x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _leaves(forest: list[Tree]):
    """Rows (uid, vec_id, v) -> rows with ``leaves``, the row's leaf in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2)) if b.num_rows else None
            found = np.stack([t.leaf_of(x) for t in forest], 1) if b.num_rows else np.empty((0, len(forest)), np.int32)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * len(forest)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], [*b.schema.names, "leaves"])

    return run


def _visits(forest: list[Tree], counts: list[np.ndarray], rows: float):
    """Queries -> one row per leaf that they take, with ``taken``: which leaves of the trees before it the query takes, a bit each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(2))
            for i in range(b.num_rows):
                at = sorted(search(forest, counts, x[i], rows))
                taken = [np.zeros(max(t.leaves, 1), bool) for t in forest]
                for t, f in at:
                    taken[t][f] = True
                before = [b"".join(np.packbits(taken[u]).tobytes() for u in range(t)) for t in range(len(forest))]
                one = b.slice(i, 1).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in at], pa.int32()), pa.array([f for _, f in at], pa.int32()), *one.columns,
                                                  pa.array([before[t] for t, _ in at], pa.binary())], ["tree", "leaf", *b.schema.names, "taken"])

    return run


def _nearest(k: int, sizes: list[int]):
    """One chunk of a leaf with a block of the queries that took it: each query's nearest rows of the chunk."""
    widths = [-(-s // 8) for s in sizes]

    def work(tab: pa.Table) -> list[tuple]:
        asks = tab.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        tree = tab.column("tree")[0].as_py()
        uid, vec = tab.column("uid").to_numpy(), tab.column("vec_id").to_numpy()
        x = _matrix(tab.column("v").combine_chunks())
        r, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(r) or not len(q):
            return []
        rows, out = x[r], []
        norms = (rows * rows).sum(1)
        leaves = _matrix(tab.column("leaves").combine_chunks().take(pa.array(r)))
        taken = tab.column("taken")
        for i in q:
            bits, at = np.frombuffer(taken[int(i)].as_py(), np.uint8), 0
            met = uid[r] == uid[i]
            for t in range(tree):  # ranked in an earlier tree
                met |= np.unpackbits(bits[at : at + widths[t]])[leaves[:, t]] > 0
                at += widths[t]
            rough = norms - 2 * (rows @ x[i])
            rough[met] = np.inf
            m = min(k, len(r))
            limit = np.partition(rough, m - 1)[m - 1]
            near = np.flatnonzero(rough <= limit + 1e-9 * (1 + abs(limit))) if np.isfinite(limit) else np.flatnonzero(np.isfinite(rough))
            exact = np.sqrt(((rows[near] - x[i]) ** 2).sum(1))
            for j in np.lexsort((uid[r[near]], vec[r[near]], exact))[:k]:
                out.append((int(uid[i]), int(vec[i]), int(uid[r[near[j]]]), int(vec[r[near[j]]]), float(exact[j])))
        return out

    return work


FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(rows: DataFrame, vector: str = "embedding", k: int = NEAREST, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose vec_id is divisible by ``every``."""
    d = valid_vectors(rows, vector).select("uid", "vec_id", "v")
    n = d.count()
    forest, visit = fit(d, n)
    placed = cut_lineage(d.mapInArrow(_leaves(forest), "uid long, vec_id long, v array<double>, leaves array<int>")
                         .select("*", F.posexplode("leaves").alias("tree", "leaf")))
    counts = [np.zeros(max(t.leaves, 1), np.int64) for t in forest]
    for r in placed.groupBy("tree", "leaf").count().collect():  # a row per leaf of the fitted forest
        counts[r["tree"]][r["leaf"]] = r["count"]
    visits = _visits(forest, counts, max(visit * n, 1.0))
    asks = cut_lineage(d.where(F.col("vec_id") % every == 0).mapInArrow(visits, "tree int, leaf int, uid long, vec_id long, v array<double>, taken binary"))
    leaf = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    leaf = leaf.join(asks.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), ["tree", "leaf"])
    leaf = F.broadcast(cut_lineage(leaf))  # a row per leaf of the fitted forest
    key = ["tree", "leaf", "chunk", "block"]
    here = lambda by: F.pmod(F.xxhash64("uid"), F.col(by)).cast("int")
    every_of = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    no_leaves, no_taken = F.lit(None).cast("array<int>"), F.lit(None).cast("binary")
    members = (placed.join(leaf, ["tree", "leaf"]).withColumn("chunk", here("chunks")).withColumn("block", every_of("blocks"))
               .select(*key, F.lit(False).alias("ask"), "uid", "vec_id", "v", "leaves", no_taken.alias("taken")))
    asked = (asks.join(leaf, ["tree", "leaf"]).withColumn("block", here("blocks")).withColumn("chunk", every_of("chunks"))
             .select(*key, F.lit(True).alias("ask"), "uid", "vec_id", "v", no_leaves.alias("leaves"), "taken"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = members.union(asked).repartition(parts, *key).sortWithinPartitions(*key)
    work = _nearest(k, [max(t.leaves, 1) for t in forest])
    found = met.mapInArrow(in_runs(key, work, FOUND), "q long, query_id long, uid long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id", "uid"))  # the first k of a task go on
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
