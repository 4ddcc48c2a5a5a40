"""Operator 11, benchmark decontamination by an FM-index over each shard of the training texts.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item, or all words of a shorter item.
Documents are read where they lie, shard by shard (a shard is what one Arrow batch brings, at most
``SHARD_WORDS`` words of it at once):

1. A shard's words become symbols; a word that no phrase holds is a separator. An occurrence lies within a
   run of phrase words that is at least as long as the shortest phrase, so only such runs are indexed, each ended by a
   separator. A run that is too long for a shard goes on in the next one, which repeats its last words.
2. The index is the Burrows-Wheeler transform of the symbols in a wavelet tree, whose levels are bit vectors with counts.
   All phrases are searched backwards at once, a symbol of each a step, by two ranks.
3. Occurrences are located by stepping back to the next sampled suffix position (one in ``SAMPLE``).
4. Occurrences of a document are merged into removal spans of word places.

Phrases are numbered and go to the tasks in blocks of ``BLOCK_PHRASES``, so what is shipped is bounded; more phrases
take more passes over the documents, whose spans are merged per row. Which items hold a phrase is joined afterwards.

Defined results: a null text or one without words has no words and no hits; an item without words has no
phrase; a null item_id marks words but is not listed; items that share an item_id are one item; repeated rows are
searched each; an empty benchmark hits nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import cut_lineage, row_keyed, table
from wearline.llm.runs import release_memory

WINDOW = 10
#: A word: letters a-z, digits and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases of a pass, indexed words of a shard, bytes of a text that are split at once.
BLOCK_PHRASES = 200_000
SHARD_WORDS = 1 << 20
PIECE_BYTES = 1 << 22
#: One suffix position in so many is kept.
SAMPLE = 8
#: Symbols: the end of the shard, a separator, then the words.
END, SEPARATOR, FIRST_WORD = 0, 1, 2
#: Bits of a word's place beside the document's number in the batch.
PLACE_BITS = 40

#: Bytes of words stay, in lower case; all others are blanks.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: Column) -> Column:
    """The words of a short text, natively."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


# --- the index ------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` (symbols from 0; a suffix that ends is smaller), by prefix doubling.

    The first key packs as many symbols as 62 bits hold; then only suffixes that still tie are sorted again.
    """
    n = len(s)
    bits = int(s.max() + 1).bit_length()
    packed = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key <<= bits
        if k < n:
            key[: n - k] += s[k:] + 1
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        after = np.minimum(at + packed, n)
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        first[tied] = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(first[tied], tied, 0))
        packed *= 2


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class WaveletTree:
    """Ranks of symbols; a level holds a bit of every symbol, ordered by the bits above it."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        self.shifts = range((n_symbols - 1).bit_length() - 1, -1, -1)
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bit = (s >> shift) & 1 > 0
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])
        symbols = np.arange(n_symbols)
        self.starts = self._walk(symbols, np.zeros(n_symbols, np.int64))  # where a symbol's run begins below the last level

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.rank(i)
            i = np.where((c >> shift) & 1 > 0, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` stands before place ``i``."""
        return self._walk(c, i) - self.starts[c]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place ``i`` and how often it stands before."""
        c = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level[i], level.rank(i)
            c = 2 * c + bit
            i = np.where(bit, zeros + ones, i - ones)
        return c, i - self.starts[c]


class FMIndex:
    """Full-text index of the symbols ``s``, which end with the one ``END``."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        order = suffix_array(s)
        self.tree = WaveletTree(s[order - 1], n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
        kept = order % SAMPLE == 0
        self.kept, self.samples = Bits(kept), order[kept]
        self.size = len(s)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with the phrases (rows of symbols, filled up with -1 on the left)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((phrases[:, k] >= 0) & (low < high))
            c = phrases[on, k]
            ends = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[on], high[on]])) + np.tile(self.smaller[c], 2)
            low[on], high[on] = ends[: len(on)], ends[len(on):]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows."""
        found, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.kept[rows]
            found[open_[here]] = self.samples[self.kept.rank(rows[here])] + steps
            open_, rows, steps = open_[~here], rows[~here], steps + 1
            c, before = self.tree.symbol_and_rank(rows)
            rows = self.smaller[c] + before
        return found


# --- searching shards -----------------------------------------------------------------------------


class Phrases:
    """A block of phrases: their numbers, the words that they hold, and their symbols, filled up on the left."""

    def __init__(self, rows: list[tuple[int, str]], window: int = WINDOW):
        split = [p.encode().split(b" ") for _, p in rows]
        self.numbers = np.array([k for k, _ in rows], np.int64)
        self.symbols = {w: k for k, w in enumerate(sorted({w for p in split for w in p}), FIRST_WORD)}
        self.lengths = np.array([len(p) for p in split], np.int64)
        self.matrix = np.full((len(split), window), -1, np.int64)
        for k, p in enumerate(split):
            self.matrix[k, window - len(p):] = [self.symbols[w] for w in p]

    @property
    def n_symbols(self) -> int:
        return FIRST_WORD + len(self.symbols)


def text_symbols(data: bytes, symbols: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Symbols of a text's words, piece by piece; a piece ends between words."""
    start = 0
    while start < len(data):
        end = min(len(data), start + PIECE_BYTES)
        if end < len(data):
            part = data[start:end].translate(TO_WORDS)
            cut = part.rfind(b" ")
            while cut < 0 and end < len(data):  # one word longer than a piece
                end = min(len(data), end + PIECE_BYTES)
                part = data[start:end].translate(TO_WORDS)
                cut = part.rfind(b" ")
            end = end if cut < 0 or end == len(data) else start + cut
        words = data[start:end].translate(TO_WORDS).split()
        start = end
        yield np.fromiter(map(symbols.get, words, repeat(SEPARATOR)), np.int64, len(words))


class Shard:
    """Runs of phrase words of several documents, indexed and searched when enough have come together."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.shortest = phrases, int(phrases.lengths.min(initial=1 << 30))
        self.overlap = int(phrases.lengths.max(initial=1)) - 1
        self.starts, self.stops, self.pairs = [], [], []
        self._empty()

    def _empty(self) -> None:
        self.parts, self.size, self.runs = [], 0, []

    def add(self, doc: int, place: int, run: np.ndarray) -> None:
        """A run of phrase words of document ``doc`` from word ``place`` on."""
        while len(run) >= self.shortest:
            part = run[: max(SHARD_WORDS - self.size, self.overlap + 1)]
            self.runs.append((self.size, (doc << PLACE_BITS) + place))
            self.parts += [part, [SEPARATOR]]
            self.size += len(part) + 1
            if self.size >= SHARD_WORDS:
                self.search()
            if len(part) == len(run):
                break
            run, place = run[len(part) - self.overlap:], place + len(part) - self.overlap

    def search(self) -> None:
        if self.runs:
            p = self.phrases
            index = FMIndex(np.concatenate([*self.parts, [END]]).astype(np.int64), p.n_symbols)
            low, high = index.search(p.matrix)
            n = high - low
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            at = index.locate(rows)
            begin, place = np.array(self.runs, np.int64).T
            run = np.searchsorted(begin, at, "right") - 1
            start = place[run] + at - begin[run]
            self.starts.append(start)
            self.stops.append(start + p.lengths[which])
            self.pairs.append(np.unique(np.stack([start >> PLACE_BITS, p.numbers[which]], 1), axis=0))
        self._empty()

    def result(self, n_docs: int) -> tuple[pa.Array, pa.Array]:
        """Per document the merged spans and the phrases that occur."""
        self.search()
        none = np.empty(0, np.int64)
        start, stop = np.concatenate([none, *self.starts]), np.concatenate([none, *self.stops])
        order = np.argsort(start, kind="stable")
        start, stop = start[order], np.maximum.accumulate(stop[order])
        new = np.append(True, start[1:] > stop[:-1])[: len(start)]
        last = np.append(new[1:], True)[: len(start)]
        start, stop = start[new], stop[last]
        low = (1 << PLACE_BITS) - 1
        docs = np.arange(n_docs + 1)
        spans = pa.StructArray.from_arrays([pa.array(start & low), pa.array(stop & low)], ["start", "stop"])
        pairs = np.unique(np.concatenate([none.reshape(0, 2), *self.pairs]), axis=0)
        return (pa.ListArray.from_arrays(pa.array(np.searchsorted(start >> PLACE_BITS, docs), pa.int32()), spans),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], docs), pa.int32()), pa.array(pairs[:, 1])))


def _find(phrases: Phrases) -> Callable:
    """(key columns..., text) -> (key columns..., n_words, spans, phrases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, counts = Shard(phrases), []
            for doc, text in enumerate(batch.column(batch.num_columns - 1)):
                n = 0
                left = np.empty(0, np.int64)  # a run that reached the end of a piece
                for ids in text_symbols(text.as_buffer().to_pybytes(), phrases.symbols) if text.is_valid else ():
                    n += len(ids)
                    ids = np.concatenate([left, ids])
                    inside = np.zeros(len(ids) + 2, bool)
                    inside[1:-1] = ids != SEPARATOR
                    edge = np.flatnonzero(inside[1:] != inside[:-1])
                    first, after = edge[::2], edge[1::2]
                    left = ids[first[-1]:] if len(after) and after[-1] == len(ids) else ids[:0]
                    long = after - first >= shard.shortest
                    if len(left):
                        long[-1] = False
                    for a, b in zip(first[long].tolist(), after[long].tolist(), strict=True):
                        shard.add(doc, n - len(ids) + a, ids[a:b])
                    if len(left) > SHARD_WORDS:  # a run without end goes on with its last words
                        shard.add(doc, n - len(left), left)
                        left = left[len(left) - shard.overlap:]
                shard.add(doc, n - len(left), left)
                counts.append(n)
            spans, found = shard.result(batch.num_rows)
            names = [*batch.schema.names[:-1], "n_words", "spans", "phrases"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), spans, found], names)
        release_memory()

    return run


# --- the operator ---------------------------------------------------------------------------------


def phrase_items(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(phrase, item)``: the windows of ``items(item_id, text)``, each once an item."""
    w = F.col("_w")
    n = F.size(w)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(window)), " "))
    d = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("_w")).where(n > 0)
    return d.select("item", F.explode(F.array_distinct(cut)).alias("phrase")).distinct()


def find(keyed: DataFrame, key: list[str], phrases: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key..., n_words, spans, phrases`` for the rows of ``keyed(key..., text)`` and ``phrases(number, phrase)``."""
    n_blocks = max(1, -(-phrases.count() // BLOCK_PHRASES))
    d = keyed.select(*key, "text")
    fields = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in key)
    schema = f"{fields}, n_words long, spans array<struct<start: long, stop: long>>, phrases array<long>"
    passes = []
    for b in range(n_blocks):  # about BLOCK_PHRASES phrases at a time come to the driver and go to the tasks
        block = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(n_blocks)) == b).orderBy("number").collect()
        passes.append(d.mapInArrow(_find(Phrases([(r["number"], r["phrase"]) for r in block], window)), schema))
    if n_blocks == 1:
        return passes[0]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    together = every.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("_s"),
                                       F.flatten(F.collect_list("phrases")).alias("phrases"))  # a row a pass
    touches = lambda acc, s: s["start"] <= F.element_at(acc, -1)["stop"]
    wider = lambda acc, s: F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))
    merged = F.aggregate("_s", F.array().cast("array<struct<start: long, stop: long>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & touches(acc, s), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider(acc, s)))).otherwise(F.concat(acc, F.array(s))))
    return together.select(*key, "n_words", merged.alias("spans"), "phrases")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans`` (word places to remove) and ``items`` (sorted ids of the items found)."""
    held = cut_lineage(phrase_items(items.select("item_id", "text"), window))
    numbered = cut_lineage(held.select("phrase").distinct().withColumn("number", F.monotonically_increasing_id()))
    key = ["__file", "__place"]
    keyed = row_keyed(docs).select(*key, F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    rows = cut_lineage(find(keyed, [*key, "doc_id"], numbered, window))
    hit = rows.select(*key, F.explode("phrases").alias("number")).join(numbered, "number").join(held, "phrase")
    found = hit.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))  # the items that the row lists
    out = rows.join(found, key, "left")
    return out.select("doc_id", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS phrase
    FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS u(i) WHERE len(w) > 0),
o AS (SELECT r, i, x.k, array_to_string(w[i : i + x.k - 1], ' ') AS phrase
    FROM d, unnest(range(1, len(w) + 1)) AS u(i), (SELECT DISTINCT k FROM p) AS x WHERE i + x.k - 1 <= len(w)),
h AS (SELECT o.r, o.i, o.k, p.item FROM o JOIN p ON o.phrase = p.phrase AND o.k = p.k),
s AS (SELECT r, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) AS u(j) GROUP BY r),
l AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN s ON s.r = d.r LEFT JOIN l ON l.r = d.r
"""
