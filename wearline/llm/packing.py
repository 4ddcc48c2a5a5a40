"""Operator 5, best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut)
and pieces are packed whole. Pieces are dealt by hash to cells of bounded size; each cell
is evolved on several islands, one task each: crossover injects whole well-filled bins of
one parent into another, drops the duplicates and best-fits the displaced pieces. After
every epoch each island's elite moves on to the next island of its cell (a join on
(cell, island)). Bins that stay badly filled give their pieces back, and these are dealt to new
cells until one cell holds them all.

Defined results: a null text counts as empty; an empty document is the end token alone;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import cut_lineage, table
from wearline.llm.runs import release_memory

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of a cell, islands of a cell, members of an island, epochs and crossovers per epoch.
CELL_PIECES = 2048
ISLANDS = 2
POPULATION = 4
EPOCHS = 2
CROSSOVERS = 4
#: Bins filled less than this give their pieces to the next round.
GOOD_FILL = 0.985
MAX_ROUNDS = 12
#: Bits of a bin's number in its cell, which has fewer bins than pieces; those of the cell are the next ones up to 56.
BIN_BITS = 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- tokens ---------------------------------------------------------------------------------------

#: The vocabulary's split rule (fixed value: it has to equal the vocabulary file's own).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: (A part's ids must be little-endian, as array("I") is on every machine that Spark supports.)
#: Texts with any other character go to the tokenizer whole. These characters are composed already,
#: are lower-cased one by one, and are white space or not for every engine.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u0131\u0134-\u024f]")
#: Bytes of known parts that a Python worker keeps while it works on a partition; a full cache is emptied.
CACHE_BYTES = 64 << 20
#: Bytes of a known part beside its characters and ids: two objects and a place in the table.
WORD_BYTES = 150
#: Characters of the texts whose words are looked up together (a longer text is a block of its own).
BLOCK_CHARS = 4 << 20
#: ASCII punctuation that ends a word as one part of it (an apostrophe may begin one of the rule's own endings).
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}


class TokenIds:
    """Text -> little-endian unsigned 32-bit token ids.

    White space never is inside a token, so a text's ids are those of its words, one after
    the other. Every distinct word of a block of texts is looked up once, and its parts (runs of letters,
    of punctuation) are encoded once while they stay in the bounded cache.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.find = regex.compile(SPLIT).findall
        self.bytes = _byte_characters()
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.room = CACHE_BYTES

    def _part(self, part: str) -> bytes:
        ids = self.cache.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
            if len(part) <= 64:
                self.room -= WORD_BYTES + len(part) + len(ids)
                if self.room < 0:
                    self.cache.clear()
                    self.room = CACHE_BYTES
                self.cache[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._part(word)
        start = word.rstrip(TAIL)
        if start.isalpha():
            return self._part(start) + self._part(word[len(start):])
        return b"".join(map(self._part, self.find(word)))

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        whole = {k: np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                 for k, t in enumerate(texts) if "<|" in t or UNUSUAL.search(t)}
        lists = pc.ascii_split_whitespace(pa.array(["" if k in whole else t.lower() for k, t in enumerate(texts)], pa.large_string()))
        words = lists.flatten().dictionary_encode()  # no word: none or an empty one, which has no ids
        known = list(map(self._word, words.dictionary.to_pylist()))
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, pool, at = np.cumsum(n) - n, np.frombuffer(b"".join(known), "<u4"), words.indices.to_numpy()
        n = n[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        for k in range(len(texts)):
            yield whole[k] if k in whole else ids[cuts[k] : cuts[k + 1]].tobytes()

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each of ``texts``, in their order."""
        block, room = [], BLOCK_CHARS
        for t in texts:
            if block and len(t) > room:
                yield from self._block(block)
                block, room = [], BLOCK_CHARS
            block.append(t)
            room -= len(t)
        if block:
            yield from self._block(block)

    def __call__(self, text: str) -> bytes:
        return next(self._block([text]))


@lru_cache(maxsize=1)
def token_ids(vocabulary: str) -> TokenIds:
    """One per Python worker; its known parts go when a partition ends."""
    return TokenIds(vocabulary)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: its place, length and CRC of its ids."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of.many(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for col, v in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
        ids_of.forget()
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


# --- the grouping genetic algorithm ---------------------------------------------------------------


class Bins:
    """A solution: bins (lists of item numbers) with their loads."""

    __slots__ = ("items", "loads")

    def __init__(self, items: list[list[int]], loads: list[int]):
        self.items, self.loads = items, loads

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then uneven fill: squares reward full bins."""
        return -len(self.items), sum((x / capacity) ** 2 for x in self.loads)


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: Bins) -> Bins:
    """Put the items of ``order`` each into the fullest bin that still holds it."""
    gaps = sorted((capacity - load, b) for b, load in enumerate(bins.loads) if load < capacity)
    for i in order:
        s = sizes[i]
        at = bisect.bisect_left(gaps, (s, -1))
        if at == len(gaps):
            b = len(bins.items)
            bins.items.append([i])
            bins.loads.append(s)
            left = capacity - s
        else:
            left, b = gaps.pop(at)
            bins.items[b].append(i)
            bins.loads[b] += s
            left -= s
        if left:
            bisect.insort(gaps, (left, b))
    return bins


def descending(sizes: list[int], items: list[int], rng: random.Random, jitter: float) -> list[int]:
    return sorted(items, key=lambda i: (-sizes[i] * (1 + jitter * rng.random()), i))


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``b`` into ``a``; displaced items go back by best fit."""
    ranked = sorted(range(len(b.items)), key=lambda k: -b.loads[k])
    take = ranked[: max(1, rng.randint(len(ranked) // 4, max(1, len(ranked) // 2)))]
    items, loads = [list(b.items[k]) for k in take], [b.loads[k] for k in take]
    there = {i for x in items for i in x}
    loose: list[int] = []
    for x, load in zip(a.items, a.loads, strict=True):
        rest = [i for i in x if i not in there]
        if len(rest) == len(x) and load >= GOOD_FILL * capacity:  # an untouched good bin stays
            items.append(list(x))
            loads.append(load)
        else:
            loose += rest
    return best_fit(sizes, descending(sizes, loose, rng, 0.05), capacity, Bins(items, loads))


def evolve(sizes: list[int], seeds: list[Bins], rng: random.Random, capacity: int) -> Bins:
    """One epoch of one island: fill the population up, cross, replace the worst; the elite."""
    every = list(range(len(sizes)))
    people = seeds + [best_fit(sizes, descending(sizes, every, rng, 0.0 if not k and not seeds else 0.3), capacity, Bins([], []))
                      for k in range(POPULATION - len(seeds))]
    least = -(-sum(sizes) // capacity)
    for _ in range(CROSSOVERS):
        people.sort(key=lambda p: p.fitness(capacity), reverse=True)
        if len(people[0].items) == least:
            break
        a, b = people[0], people[rng.randrange(1, len(people))]
        people[-1] = crossover(*((a, b) if rng.random() < 0.5 else (b, a)), sizes, capacity, rng)
    return max(people, key=lambda p: p.fitness(capacity))


def _packed(bins: Bins, n: int) -> tuple[np.ndarray, np.ndarray]:
    where, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, x in enumerate(bins.items):
        where[x], place[x] = b, range(len(x))
    return where, place


def _unpacked(where: np.ndarray, sizes: list[int]) -> Bins:
    items: dict[int, list[int]] = {}
    for i, b in enumerate(where.tolist()):
        items.setdefault(b, []).append(i)
    return Bins(list(items.values()), [sum(sizes[i] for i in x) for x in items.values()])


ISLAND = "cell long, island int, n_bins long, fill double, uids array<long>, sizes array<long>, bins array<long>, guest array<long>"


def _epoch(capacity: int, epoch: int):
    """Rows of (cell, island) with the cell's pieces, the island's and its guest's elite -> new elites."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                seeds = [_unpacked(np.asarray(x), sizes) for x in (r.bins, r.guest) if x is not None and len(x)]
                best = evolve(sizes, seeds, random.Random(f"{r.cell}/{r.island}/{epoch}"), capacity)
                rows.append((r.cell, r.island, len(best.items), best.fitness(capacity)[1], r.uids, r.sizes, _packed(best, len(sizes))[0], None))
            yield pd.DataFrame(rows, columns=f.columns)

    return run


def _evolved(todo: DataFrame, n_cells: int, capacity: int, slots: int) -> DataFrame:
    """Pieces ``(uid, length)`` -> ``(uid, cell, bin, load)``, packed cell by cell."""
    cells = (todo.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(n_cells)), F.lit(n_cells)).alias("cell"))
             .groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x")))  # about CELL_PIECES rows
    none = F.lit(None).cast("array<long>")
    state = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).cast("long").alias("n_bins"),
                         F.lit(0.0).alias("fill"), F.col("x.uid").alias("uids"), F.col("x.length").alias("sizes"),
                         none.alias("bins"), none.alias("guest"))
    for e in range(EPOCHS):
        if e:  # the elite of the island before comes as a guest
            elite = state.select("cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("elite"))
            state = state.join(elite, ["cell", "island"]).withColumn("guest", F.col("elite")).drop("elite")
        state = state.repartition(slots, "cell", "island").mapInPandas(_epoch(capacity, e), ISLAND)
        state = cut_lineage(state)
    best = state.groupBy("cell").agg(F.max_by(F.struct("uids", "sizes", "bins"), F.struct(-F.col("n_bins"), "fill", -F.col("island"))).alias("s"))
    put = best.select("cell", F.explode(F.arrays_zip(F.col("s.uids").alias("uid"), F.col("s.sizes").alias("length"), F.col("s.bins").alias("bin"))).alias("p"))
    from pyspark.sql import Window

    return put.select("p.uid", "p.length", "cell", "p.bin", F.sum("p.length").over(Window.partitionBy("cell", "p.bin")).alias("load"))


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces -> pieces with ``sequence_id`` and ``offset``, packed whole and gapless."""
    from pyspark.sql import Window

    spark = found.sparkSession
    rows = cut_lineage(found.withColumn("uid", F.monotonically_increasing_id()))  # numbers are fixed from here on
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    full = rows.where(F.col("length") == capacity).select("uid", F.lit(-1).alias("round"), F.col("uid").alias("cell"), F.lit(0).cast("long").alias("bin"))
    done, todo = full, rows.where(F.col("length") < capacity).select("uid", "length")
    for k in range(MAX_ROUNDS):
        left = todo.count()
        if not left:
            break
        n_cells = -(-left // CELL_PIECES)
        last = n_cells == 1 or k == MAX_ROUNDS - 1
        put = cut_lineage(_evolved(todo, n_cells, capacity, min(slots, n_cells * ISLANDS)))
        good = F.lit(True) if last else F.col("load") >= GOOD_FILL * capacity
        done = done.unionByName(put.where(good).select("uid", F.lit(k).alias("round"), "cell", "bin"))
        if last:
            break
        todo = put.where(~good).select("uid", "length")
    # exact numbers, no hashes: a full piece by its own number, below 0; a bin by round, cell and its number in the cell
    number = F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft(F.col("cell").cast("long"), BIN_BITS) + F.col("bin")
    seq = done.select("uid", F.when(F.col("round") < 0, -1 - F.col("uid")).otherwise(number).alias("sequence_id"))
    w = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` rows
    return (rows.join(seq, "uid").withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).drop("uid"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary_path()))
