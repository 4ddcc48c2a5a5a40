"""Operator 12, hard-negative mining with segment summary filtering.

A vector of integers is cut into 1, 4 and 16 segments; of every segment its mean and the length of its
deviations from the mean are stored. For two vectors the sum of (segment width x product of the means), plus
or minus the sum of the products of the deviations, bounds their inner product. A row whose bounds cannot
reach what an anchor still looks for goes at once; the others are bounded by shorter segments, and only what
remains is scored exactly.

Rows are numbered by (label, vec_id) and stored in chunks of ``CHUNK`` vectors with their summaries; anchors in blocks
of ``BLOCK``. A chunk and a block are one piece of work of bounded size: first chunks and blocks whose labels overlap, for
each anchor's ``POSITIVES`` best rows of its label, then all but those of a single label, for the ``NEGATIVES`` best rows
of other labels between ``SHARE`` percent of a positive's score and that score. Only the best of a chunk leave a
task; they are merged per anchor (and positive). A task keeps the score that an anchor's last place has reached,
so later chunks are filtered by it.

Defined results: rows take no part whose vec_id, label or vector is null or whose vector holds a null or non-finite
component; shorter vectors are filled up with zeros; components are limited to +-``LIMIT`` after scaling, so that
scores fit a long; a repeated row is a row of its own: each copy of an anchor has its own results, and the other
copies may be its positives; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.llm.common import cut_lineage, ranked, scratch_table, table
from wearline.llm.runs import release_memory

POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least so many percent of the positive.
SHARE = 80
SCALE = 256
LIMIT = 2**27
#: Rows of a chunk, anchors of a block, segments of a vector level by level.
CHUNK = 2048
BLOCK = 512
SEGMENTS = (1, 4, 16)
#: Blocks up to this size together are broadcast; beyond, they are joined by block and part of the chunks.
BROADCAST_BYTES = 32 << 20
PARTS = 16
#: Blocks of whose anchors a task keeps the scores reached, 512 x 5 numbers each.
KNOWN_BLOCKS = 512

STORED = "part long, low int, high int, places array<long>, ids array<long>, labels array<int>, vectors binary, summaries binary"


# --- rows, chunks and summaries -------------------------------------------------------------------


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(vec_id, label, vector)`` with whole-numbered components of the rows that take part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return d.select("vec_id", "label", whole.alias("vector"))


def summarise(x: np.ndarray) -> np.ndarray:
    """Means and deviation lengths of all segments of all levels: columns m1, d1, m4, d4, m16, d16."""
    found = []
    for s in SEGMENTS:
        parts = x.reshape(len(x), s, -1).astype(np.float64)
        mean = parts.mean(2)
        found += [mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))]
    return np.concatenate(found, 1)


def _store(width: int) -> Callable:
    """Rows (part, items) -> stored parts with their vectors, filled up to ``width``, and summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in STORED.split(", ")]
        for batch in batches:
            out = []
            for part, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = pa.RecordBatch.from_struct_array(items.values)
                places, ids, labels = (rows.column(i).to_numpy() for i in range(3))
                lists = rows.column(3)
                offsets = lists.offsets.to_numpy()
                size = np.diff(offsets)
                x = np.zeros((len(ids), width), np.int32)
                x[np.arange(width) < size[:, None]] = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                out.append((part, int(labels.min()), int(labels.max()), places, ids, labels, x.tobytes(), summarise(x).tobytes()))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        release_memory()

    return run


def stored(rows: DataFrame, at: str, size: int, width: int) -> DataFrame:
    """Rows ``(place, vec_id, label, vector)``, numbered by ``at``, in parts of ``size`` neighbouring rows, written with their summaries."""
    parts = rows.groupBy(F.floor(F.col(at) / size).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "label", "vector"))).alias("items"))  # at most ``size`` rows
    return scratch_table(parts.mapInArrow(_store(width), STORED))


# --- scoring a chunk for a block ------------------------------------------------------------------


class Side:
    """The vectors of a stored part, taken from the columns ``first`` .. of a batch's row."""

    def __init__(self, batch: pa.RecordBatch, row: int, prefix: str, width: int):
        get = lambda c: batch.column(batch.schema.get_field_index(prefix + c))[row]
        self.part = get("part").as_py()
        self.places, self.ids, self.labels = (get(c).values.to_numpy() for c in ("places", "ids", "labels"))
        self.whole = np.frombuffer(get("vectors").as_buffer(), np.int32).reshape(-1, width)
        summary = np.frombuffer(get("summaries").as_buffer(), np.float64).reshape(len(self.whole), -1)
        self.levels, at = [], 0
        for s in SEGMENTS:
            self.levels.append((s, summary[:, at : at + s], summary[:, at + s : at + 2 * s]))
            at += 2 * s
        self.greatest = int(np.abs(self.whole).max(initial=0))
        self.exact: np.ndarray | None = None

    def numbers(self, wide: bool) -> np.ndarray:
        """The vectors as doubles, or as longs where a double could not hold a score."""
        kind = np.int64 if wide else np.float64
        if self.exact is None or self.exact.dtype != kind:
            self.exact = self.whole.astype(kind)
        return self.exact


def survivors(a: Side, i: int, r: Side, rows: np.ndarray, low: float, high: float) -> np.ndarray:
    """Those of ``rows`` whose score with anchor ``i`` may lie in [low, high], by shorter and shorter segments."""
    width = a.whole.shape[1]
    for (s, mean_a, dev_a), (_, mean_r, dev_r) in zip(a.levels, r.levels, strict=True):
        if not len(rows):
            break
        every = len(rows) == len(r.ids)
        centre = (mean_r if every else mean_r[rows]) @ (mean_a[i] * (width // s))
        radius = (dev_r if every else dev_r[rows]) @ dev_a[i]
        slack = 1e-6 + 1e-9 * (np.abs(centre) + radius)  # rounding of the bounds
        ok = (centre + radius + slack >= low) & (centre - radius - slack <= high)
        if not ok.all():
            rows = rows[ok]
    return rows


def scores(a: Side, i: int, r: Side, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of anchor ``i`` with ``rows``."""
    wide = a.greatest * r.greatest * a.whole.shape[1] >= 2**53
    x = r.numbers(wide)
    return ((x if len(rows) == len(x) else x[rows]) @ a.numbers(wide)[i]).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id."""
    pick = np.arange(len(score))
    if len(score) > 4 * n:
        pick = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    return pick[np.lexsort((places[pick], ids[pick], -score[pick]))][:n]


class Reached:
    """Best scores that anchors of the last blocks have seen in this task, ``n`` for each of ``slots`` places to fill."""

    def __init__(self, slots: int, n: int):
        self.slots, self.n, self.blocks = slots, n, OrderedDict()

    def of(self, block: int, size: int) -> np.ndarray:
        if block not in self.blocks:
            self.blocks[block] = np.full((size, self.slots, self.n), -np.inf)
            if len(self.blocks) > KNOWN_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(block)
        return self.blocks[block]


def _noted(seen: np.ndarray, score: np.ndarray) -> None:
    """``seen`` (ascending) takes in new scores."""
    seen[:] = np.sort(np.concatenate([seen, score]))[-len(seen):]


POSITIVE = "a_place long, a_id long, p_place long, positive_id long, positive_score long"


def _positives(width: int, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = Reached(1, n)
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                a, r = Side(batch, row, "a_", width), Side(batch, row, "r_", width)
                seen = reached.of(a.part, len(a.ids))
                for i in range(len(a.ids)):
                    rows = np.flatnonzero((r.labels == a.labels[i]) & (r.places != a.places[i]))
                    rows = survivors(a, i, r, rows, seen[i, 0, 0], np.inf)
                    score = scores(a, i, r, rows)
                    top = best(score, r.ids[rows], r.places[rows], n)
                    _noted(seen[i, 0], score[top])
                    out += [(int(a.places[i]), int(a.ids[i]), int(r.places[k]), int(r.ids[k]), int(s)) for k, s in zip(rows[top], score[top], strict=True)]
            yield _table(out, POSITIVE)
        release_memory()

    return run


NEGATIVE = "a_place long, p_place long, n_place long, negative_id long, negative_score long"


def _negatives(width: int, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = Reached(POSITIVES, n)
        for batch in batches:
            out = []
            targets = batch.column(batch.schema.get_field_index("targets"))
            for row in range(batch.num_rows):
                a, r = Side(batch, row, "a_", width), Side(batch, row, "r_", width)
                seen = reached.of(a.part, len(a.ids))
                wanted: dict[int, list] = {}
                for t in targets[row].as_py():
                    wanted.setdefault(t["a_place"], []).append((t["positive_score"], t["p_place"]))
                for i in range(len(a.ids)):
                    goals = sorted(wanted.get(int(a.places[i]), []), reverse=True)
                    goals = [(p, at, -(-SHARE * p // 100)) for p, at in goals if p >= 0]  # below zero no score fits
                    if not goals:
                        continue
                    low = min(max(least, seen[i, j, 0]) for j, (_, _, least) in enumerate(goals))
                    rows = survivors(a, i, r, np.flatnonzero(r.labels != a.labels[i]), low, goals[0][0])
                    score = scores(a, i, r, rows)
                    near = np.flatnonzero((score >= low) & (score <= goals[0][0]))
                    rows, score = rows[near], score[near]
                    for j, (p, at, least) in enumerate(goals):
                        fit = np.flatnonzero((score >= least) & (score <= p))
                        if len(fit):
                            top = fit[best(score[fit], r.ids[rows[fit]], r.places[rows[fit]], n)]
                            _noted(seen[i, j], score[top])
                            out += [(int(a.places[i]), at, int(r.places[k]), int(r.ids[k]), int(s)) for k, s in zip(rows[top], score[top], strict=True)]
            yield _table(out, NEGATIVE)
        release_memory()

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names)


# --- the operator ---------------------------------------------------------------------------------


def _work(chunks: DataFrame, blocks: DataFrame, n_blocks: int, small: bool) -> DataFrame:
    """Every chunk with every block, as columns ``r_...`` and ``a_...``."""
    r = chunks.select(*[F.col(c).alias("r_" + c) for c in chunks.columns])
    a = blocks.select(*[F.col(c).alias("a_" + c if c != "targets" else c) for c in blocks.columns])
    r = r.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    if small:
        return r.join(F.broadcast(a), F.col("_block") == F.col("a_part")).drop("_block")
    r = r.withColumn("_deal", F.pmod("r_part", F.lit(PARTS)))
    a = a.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return r.join(a, (F.col("_block") == F.col("a_part")) & (F.col("_deal") == F.col("_dealt"))).drop("_block", "_deal", "_dealt")


def _first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank`` (cut before the shuffle as well)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows(vec_id, label, vector of ints)``.

    ``is_anchor`` is a condition on the rows.
    """
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    whole = cut_lineage(rows.select("vec_id", "label", "vector"))
    longest = whole.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0  # one row
    width = max(1, -(-longest // SEGMENTS[-1])) * SEGMENTS[-1]
    placed = cut_lineage(ranked(whole.withColumn("_uid", F.monotonically_increasing_id()), [F.col("label"), F.col("vec_id"), F.col("_uid")], "place").drop("_uid"))
    chunks = stored(placed, "place", CHUNK, width)
    blocks = stored(ranked(placed.where(is_anchor), [F.col("place")], "at"), "at", BLOCK, width)
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("vectors") + F.octet_length("summaries")).alias("bytes")).first()  # one row
    if not size["n"]:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], schema)
    small = size["bytes"] <= BROADCAST_BYTES
    pairs = _work(chunks, blocks, size["n"], small)
    same = pairs.where((F.col("r_low") <= F.col("a_high")) & (F.col("a_low") <= F.col("r_high")))
    found = same.mapInArrow(_positives(width, positives), POSITIVE)
    top = _first(found, ["a_place"], [F.desc("positive_score"), F.asc("positive_id"), F.asc("p_place")], positives).drop("rank")
    top = cut_lineage(top)
    of_block = blocks.select("part", F.explode("places").alias("a_place"))
    targets = top.join(of_block, "a_place").groupBy("part").agg(
        F.collect_list(F.struct("a_place", "p_place", "positive_score")).alias("targets"))  # at most BLOCK x positives
    pairs = _work(chunks, blocks.join(targets, "part"), size["n"], small)
    other = pairs.where((F.col("r_low") != F.col("r_high")) | (F.col("a_low") != F.col("a_high")) | (F.col("r_low") != F.col("a_low")))
    found = other.mapInArrow(_negatives(width, negatives), NEGATIVE)
    last = _first(found, ["a_place", "p_place"], [F.desc("negative_score"), F.asc("negative_id"), F.asc("n_place")], negatives)
    return last.join(top, ["a_place", "p_place"]).select(F.col("a_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e AS a, e AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p.b AS pos, s.b AS neg, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND {SHARE} * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, pos AS positive_id, CAST(rank AS INT) AS rank, neg AS negative_id, positive_score, negative_score
FROM n WHERE rank <= {NEGATIVES}
"""
