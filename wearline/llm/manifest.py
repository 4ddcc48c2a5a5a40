"""Operator 13, a Merkle manifest of the dataset that keeps every few levels and recomputes the rest.

A document's leaf is the hash of its fields. Per source the leaves, by doc_id, are hashed in runs of
``FAN`` up to the source's subroot, and the subroots, by source, likewise up to the root.

* **Checkpoint.** Only every ``EVERY``-th level is written: a stored row is a block of ``FAN ** EVERY``
  neighbouring nodes of that level, the leaves of one aligned subtree whose top is a node of the next
  stored level.
* **Recompute.** ``proofs`` walks down the stored levels. A block regenerates the interior nodes of its
  subtree, gives each of its nodes the siblings met on the way up, before those of the subtree's
  top, and throws the interior nodes away. Work and memory of a block are bounded by its width.

Places in a tree come from range partitions and one carried count per partition, so a source with a
third of all rows, or a doc_id that many rows share, is spread over tasks like any other.

Defined results: a null field is hashed as ``-``; a null source is a source of its own, first of all, and
differs from the empty one; rows with a null doc_id come first in their source; rows that share a doc_id
go by their leaves, and full copies have equal leaves, so their order changes nothing; a table of one row
has an empty proof, of which the hash of no text is reported; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import cut_lineage, numbered_within, scratch_table, table
from wearline.llm.runs import release_memory

FAN = 16
#: Levels from one stored level to the next.
EVERY = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before: binary, after: binary>>"
PATH_TYPE = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))


# --- leaves ---------------------------------------------------------------------------------------


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(text: Column) -> Column:
    """The leaf of a row of ``documents`` that holds ``text``, as 32 bytes."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text]
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]), 256))


def source_key(source: Column) -> Column:
    """Orders sources by their bytes, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source.cast("string")))


# --- the stored levels ----------------------------------------------------------------------------


def subtree(nodes: list[bytes], alone: bool, fan: int, every: int) -> list[list[bytes]]:
    """Levels of hashes over a block, its nodes first. A block that is all of its tree climbs to the tree's root, any other ``every`` levels."""
    levels = [nodes]
    while (len(levels[-1]) > 1) if alone else (len(levels) <= every):
        h = [x.hex() for x in levels[-1]]
        levels.append([hashlib.sha256("".join(h[i : i + fan]).encode()).digest() for i in range(0, len(h), fan)])
    return levels


def _blocks(nodes: DataFrame, width: int) -> DataFrame:
    """Stored rows of a level: ``tree, block, alone, items`` (at most ``width`` nodes by place)."""
    item = F.struct("place", *[c for c in nodes.columns if c not in ("tree", "place")])
    d = nodes.groupBy("tree", F.floor(F.col("place") / width).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return d.select("tree", "block", ((F.col("block") == 0) & (F.size("items") < width)).alias("alone"), "items")


def _tops(fan: int, every: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [subtree(h, a, fan, every)[-1][0] for a, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.binary())], ["tree", "place", "alone", "hash"])

    return run


def build(leaves: DataFrame, fan: int = FAN, every: int = EVERY) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels of all trees of ``leaves(tree, place, hash, ...)`` and, level by level, the roots ``(tree, root)`` of the trees that end there."""
    levels, roots, nodes = [], [], leaves
    while True:
        levels.append(scratch_table(_blocks(nodes, fan**every)))
        up = cut_lineage(levels[-1].select("tree", "block", "alone", F.col("items.hash")).mapInArrow(
            _tops(fan, every), "tree string, place long, alone boolean, hash binary"))
        roots.append(up.where("alone").select("tree", F.col("hash").alias("root")))
        nodes = up.where("not alone").select("tree", "place", "hash")
        if nodes.isEmpty():
            return levels, roots


# --- proofs ---------------------------------------------------------------------------------------


def _siblings(fan: int, every: int, schema: pa.Schema) -> Callable:
    """Blocks with the path of their subtree's top -> their nodes, each with its own path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
                r = dict(zip(names, row, strict=True))
                above = [(p["before"], p["after"]) for p in r["path"].as_py()]
                items = pa.RecordBatch.from_struct_array(r["items"].values)
                nodes = items.column(items.schema.get_field_index("hash")).to_pylist()
                levels = subtree(nodes, r["alone"].as_py(), fan, every)
                paths = []
                for at in range(len(nodes)):
                    path = []
                    for level in levels[:-1]:
                        start = at - at % fan
                        path.append((b"".join(level[start:at]), b"".join(level[at + 1 : start + fan])))
                        at //= fan
                    paths.append(path + above)
                n = len(nodes)
                cols = {"tree": pa.array([r["tree"].as_py()] * n), "path": pa.array(paths, PATH_TYPE),
                        "subroot": pa.array([r["subroot"].as_py()] * n, pa.binary())}
                cols |= {c: items.column(i) for i, c in enumerate(items.schema.names)}
                yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in schema], schema=schema)
        release_memory()

    return run


def proofs(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame | None = None, fan: int = FAN, every: int = EVERY) -> DataFrame:
    """One row per leaf: its columns, ``subroot`` (its tree's root) and ``path`` from its siblings up, those of ``above(tree, path)`` last."""
    from pyspark.sql.pandas.types import to_arrow_schema

    none = F.array().cast(PATH)
    found = None
    for k in range(len(levels) - 1, -1, -1):
        top = roots[k].join(above, "tree") if above is not None else roots[k].withColumn("path", none)
        tops = top.select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("root").alias("subroot"))
        if found is not None:
            tops = tops.unionByName(found.select("tree", F.col("place").alias("block"), "path", "subroot"))
        blocks = levels[k].join(tops, ["tree", "block"])
        out = blocks.select("tree", F.explode("items").alias("i"), "path", "subroot").select("tree", "i.*", "path", "subroot").schema
        found = blocks.mapInArrow(_siblings(fan, every, to_arrow_schema(out)), out)
        if k:
            found = cut_lineage(found)
    return found


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (32 bytes) gives with the siblings of ``path``, as hex text."""
    return F.aggregate(path, hex_text(leaf), lambda h, p: F.sha2(F.concat(hex_text(p["before"]), h, hex_text(p["after"])), 256))


def manifest(leaves: DataFrame, fan: int = FAN, every: int = EVERY) -> tuple[DataFrame, str | None]:
    """``leaves(source, doc_id, hash, ...)`` -> a row per leaf with ``path`` and ``subroot``, and the root as hex text (None for no leaves)."""
    keyed = leaves.withColumn("tree", source_key(F.col("source"))).drop("source")
    keyed = keyed.select("tree", *[c for c in keyed.columns if c != "tree"])
    levels, roots = build(numbered_within(keyed, "tree", ["doc_id", "hash"], "place"), fan, every)
    every_root = roots[0]
    for r in roots[1:]:
        every_root = every_root.unionByName(r)
    sources = every_root.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("hash"))
    top_levels, top_roots = build(numbered_within(sources, "tree", ["of"], "place"), fan, every)
    above = cut_lineage(proofs(top_levels, top_roots, None, fan, every).select(F.col("of").alias("tree"), "path"))
    top = top_roots[-1].first()  # one row
    return proofs(levels, roots, above, fan, every), top["root"].hex() if top else None


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, checked for a replica in which some texts were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", UPPER, LOWER)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(F.col("text")).alias("hash"),
                         F.when(hit, leaf_hash(lowered)).alias("found"))
    rows, root = manifest(leaves)
    whole = F.array_join(F.transform("path", lambda p: F.concat(hex_text(p["before"]), hex_text(p["after"]))), "")
    out = rows.select("doc_id", hex_text(F.col("hash")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"),
                      F.sha2(whole, 256).alias("proof_sha256"), folded(F.coalesce("found", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 5, top_levels: int = 4) -> str:
    """Both trees written out level by level; ``levels`` runs of 16 hold 16 ** levels documents of a source."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    # crc32 bit by bit: a byte goes in, then eight shifts (marked by -1)
    steps = "flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_concat([CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT)], list_transform(range(8), lambda j: CAST(-1 AS BIGINT)))))"
    crc = (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
           "WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END))")
    sql = [f"""d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS s, sha256({head} || {field('text')}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(lower)}) END AS other FROM documents)""",
           "a0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
           "n0 AS (SELECT s, p, leaf AS h, count(*) OVER (PARTITION BY s) AS c FROM a0)",
           "f0 AS (SELECT doc_id, s, leaf, p, coalesce(other, leaf) AS f, '' AS sib FROM a0)"]

    def climb(n: str, f: str, level: int) -> None:
        """Runs r, the next nodes and the leaves' folds; a tree of one node stays as it is."""
        sql.append(f"r{n}{level} AS (SELECT s, p // 16 AS g, any_value(c) AS c, list(h ORDER BY p) AS x FROM {n}{level} GROUP BY s, p // 16)")
        sql.append(f"{n}{level + 1} AS (SELECT s, g AS p, CASE WHEN c > 1 THEN sha256(array_to_string(x, '')) ELSE x[1] END AS h, count(*) OVER (PARTITION BY s) AS c FROM r{n}{level})")
        before, after = "array_to_string(x[1:CAST(p % 16 AS INT)], '')", "array_to_string(x[CAST(p % 16 AS INT) + 2:], '')"
        sql.append(f"{f}{level + 1} AS (SELECT {f}{level}.* EXCLUDE (p, f, sib), p // 16 AS p, sib || {before} || {after} AS sib, "
                   f"CASE WHEN c > 1 THEN sha256({before} || f || {after}) ELSE f END AS f FROM {f}{level} JOIN r{n}{level} ON r{n}{level}.s = {f}{level}.s AND g = p // 16)")

    for k in range(levels):
        climb("n", "f", k)
    sql.append(f"u AS (SELECT s AS src, h, row_number() OVER (ORDER BY s) - 1 AS p FROM n{levels})")
    sql.append("m0 AS (SELECT '' AS s, p, h, count(*) OVER () AS c FROM u)")
    sql.append(f"t0 AS (SELECT doc_id, leaf, u.h AS subroot, '' AS s, u.p AS p, f, sib FROM f{levels} v JOIN u ON u.src = v.s)")
    for k in range(top_levels):
        climb("m", "t", k)
    return ("WITH " + ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, m{top_levels}.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = m{top_levels}.h AS verified
FROM t{top_levels} CROSS JOIN m{top_levels}""")


ORACLE = _oracle()
