"""Operator 7, language identification by a byte convolutional network trained in numpy.

Filters of several widths run over the UTF-8 bytes of fixed-length windows, each filter is
max-pooled over its window, and a softmax over the pooled values names the language. A
document's probabilities are the mean over the windows that tile its whole text, by bytes.

The model learns from a bounded sample of labelled documents (``TRAIN_DOCS`` different texts of each of the
``MAX_LANGS`` most frequent languages, ``TRAIN_WINDOWS`` windows each) whose crc32 of the doc_id as text leaves no
remainder 1 mod 3 (a null doc_id is never held out). Only the text is an input of a prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text when there is nothing to learn from; a single learned language gets score 1; repeated
rows give repeated rows; an empty table an empty result; extra columns are ignored
(``identify``) or carried along (``reject``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.llm.common import table
from wearline.llm.runs import release_memory

UNKNOWN = "und"
WINDOW = 256
#: Widths of the filters in bytes (even: two bytes are looked up at once), filters of each width.
WIDTHS = (2, 4, 6)
FILTERS = 12
#: Bound of the training sample: languages, different texts of a language and windows of a text.
MAX_LANGS = 200
TRAIN_DOCS = 400
TRAIN_WINDOWS = 3
EPOCHS = 12
LEARNING_RATE = 0.02
BATCH = 64
SEED = 7
#: ``reject`` drops documents with a lower score.
MIN_SCORE = 0.35
HELD_OUT_FOLD = (3, 1)
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_FOLD[0] == HELD_OUT_FOLD[1], F.lit(False))


def windows_of(data: bytes) -> np.ndarray:
    """The text's bytes as rows of ``WINDOW``; the last row is filled up with blanks.

    ASCII letters are lower-cased and runs of digits carry no language: digits become 0."""
    raw = np.frombuffer(data, np.uint8)
    pad = -len(raw) % WINDOW
    if pad or not len(raw):
        raw = np.concatenate([raw, np.full(pad or WINDOW, 32, np.uint8)])
    return FOLD[raw].reshape(-1, WINDOW)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[[9, 10, 11, 12, 13]] = 32


class ByteNetwork:
    """Filters as one table per byte place (256 x filters), biases, and the softmax layer."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.taps = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    # --- training ---------------------------------------------------------------------------------

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled filter values of the windows ``x`` and, per width, the places of the maxima."""
        values, places = [], []
        for taps in self.taps:
            w, n = len(taps), x.shape[1] - len(taps) + 1
            conv = taps[0][x[:, :n]]
            for k in range(1, w):
                conv = conv + taps[k][x[:, k : k + n]]
            at = conv.argmax(1)
            places.append(at)
            values.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        return np.concatenate(values, 1), places

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByteNetwork:
        """Adam on the cross-entropy; only the place of each maximum gets a gradient."""
        rng = np.random.default_rng(SEED)
        params = [*self.taps, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                rows = order[i : i + BATCH]
                xb, yb, n = x[rows], y[rows], len(rows)
                pooled, places = self._pooled(xb)
                h = np.maximum(pooled + self.bias, 0)
                logits = h @ self.out + self.out_bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), yb] -= 1
                p /= n
                dh = (p @ self.out.T) * (h > 0)
                grads = []
                for g, at in enumerate(places):
                    gt = np.zeros_like(self.taps[g])
                    part = dh[:, g * FILTERS : (g + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for k in range(len(gt)):
                        np.add.at(gt[k], (np.take_along_axis(xb, at + k, 1), f), part)
                    grads.append(gt)
                grads += [dh.sum(0), h.T @ p, p.sum(0)]
                step += 1
                rate = LEARNING_RATE * (1 - 0.8 * epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
        return self

    # --- prediction -------------------------------------------------------------------------------

    def tables(self) -> list[np.ndarray]:
        """Per offset 0, 2, 4, ...: the sum of two neighbouring bytes' taps, for all filters that reach there."""
        found = []
        for j in range(0, max(WIDTHS), 2):
            reach = [t[j][None, :, :] + t[j + 1][:, None, :] for t in self.taps if len(t) > j]  # [second, first] = little-endian pair
            found.append(np.ascontiguousarray(np.concatenate([r.reshape(65536, FILTERS) for r in reach], 1)))
        return found

    def window_probabilities(self, x: np.ndarray, tables: list[np.ndarray], block: int = 16) -> np.ndarray:
        """Probabilities of each window, in blocks that stay in the processor's cache."""
        n_filters = FILTERS * len(WIDTHS)
        pooled = np.empty((len(x), n_filters), np.float32)
        for i in range(0, len(x), block):
            b = x[i : i + block]
            pairs = b[:, :-1].astype(np.uint16) | (b[:, 1:].astype(np.uint16) << 8)
            n = pairs.shape[1]
            conv = np.take(tables[0], pairs, axis=0)
            for k, t in enumerate(tables[1:], 1):  # wider filters only, and only where they fit
                conv[:, : n - 2 * k, -t.shape[1] :] += np.take(t, pairs[:, 2 * k :], axis=0)
            for g, w in enumerate(WIDTHS):
                cols = slice(g * FILTERS, (g + 1) * FILTERS)
                conv[:, : WINDOW - w + 1, cols].max(1, out=pooled[i : i + block, cols])
        logits = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounded sample: windows, class numbers and languages, the same in every run.

    Of each language the ``TRAIN_DOCS`` different texts with the least hashes are taken, whatever the table's size and
    however often a text is repeated: copies are one text. Rows above a share that some more texts than needed
    are expected to pass are left out before anything is moved.
    """
    known = docs.select(F.col("text"), F.col("lang"), F.xxhash64("text", "lang").alias("h")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    texts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts"))
    most = texts.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not most:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, int), []
    share = F.create_map(*[F.lit(z) for r in most for z in (r["lang"], min(1.0, 2.0 * TRAIN_DOCS / max(r["texts"], 1)))])
    unit = F.pmod(F.xxhash64("h"), F.lit(1_000_003)) / 1_000_003
    data, size = F.col("text").cast("binary"), F.octet_length("text")
    start = lambda k: F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(size - WINDOW, F.lit(1))).cast("int") + 1
    near = (known.where(unit < share[F.col("lang")])  # null, so left out, for any other language
            .select("lang", "h", F.array(*[F.substring(data, start(k), F.lit(WINDOW)) for k in range(TRAIN_WINDOWS)]).alias("w")))
    once = near.groupBy("lang", "h").agg(F.min("w").alias("w"))  # copies meet before the shuffle
    order = Window.partitionBy("lang").orderBy("h")  # about 2 * TRAIN_DOCS texts
    sample = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TRAIN_DOCS)
    rows = sorted((r["lang"], [bytes(w) for w in r["w"]]) for r in sample.select("lang", "w").collect())
    langs = sorted({lang for lang, _ in rows})
    cut = [(windows_of(w)[:1], langs.index(lang)) for lang, ws in rows for w in ws if w]
    if not cut:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, int), []
    return np.concatenate([w for w, _ in cut]), np.array([c for _, c in cut]), langs


def train(docs: DataFrame) -> ByteNetwork | None:
    """A network fitted to the labelled rows of ``docs(doc_id, text, lang)``; None without any."""
    x, y, langs = training_windows(docs)
    if not len(x):
        return None
    return ByteNetwork(langs).fit(x, y)


def _predict(model: ByteNetwork | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else []
        for batch in batches:
            n = batch.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            texts = batch.column(batch.schema.get_field_index("_text"))
            rows, sizes, weights, stack = [], [], [], []

            def flush() -> None:
                if rows:
                    p = model.window_probabilities(np.concatenate(stack), tables)
                    ends = np.cumsum(sizes)
                    share = np.concatenate(weights)[:, None]  # bytes of the text in each window
                    firsts = np.concatenate([[0], ends[:-1]])
                    sums = np.add.reduceat(p * share, firsts, axis=0) / np.add.reduceat(share, firsts, axis=0)
                    for r, c, s in zip(rows, sums.argmax(1), sums.max(1), strict=True):
                        pred[r], score[r] = model.langs[c], min(1.0, float(s))
                    rows.clear(), sizes.clear(), weights.clear(), stack.clear()

            for r in range(n) if model else ():
                text = texts[r].as_py()
                if text and LETTER.search(text):
                    data = text.encode()
                    w = windows_of(data)
                    share = np.full(len(w), WINDOW, np.float32)
                    share[-1] = len(data) - WINDOW * (len(w) - 1)
                    rows.append(r), sizes.append(len(w)), weights.append(share), stack.append(w)
                    if sum(sizes[-64:]) > 4096 or len(rows) >= 512:
                        flush()
            flush()
            kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_text"]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred), pa.array(score)], [*names, "lang_pred", "score"])
        tables.clear()
        release_memory()

    return run


def identify(docs: DataFrame, model: ByteNetwork | None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    d = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("_text"))
    return d.mapInArrow(_predict(model), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def _accept(model: ByteNetwork | None, min_score: float):
    """A batch filter: whole rows pass through untouched."""
    predict = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["_text"])
            p = next(predict(iter([only])))
            good = [lang != UNKNOWN and s >= min_score for lang, s in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def reject(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the documents of no known language (``und``) or of a score below ``min_score``."""
    return docs.mapInArrow(_accept(train(docs), min_score), docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
