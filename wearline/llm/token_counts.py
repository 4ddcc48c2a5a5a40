"""Operator 1, token counts: trie-shared dynamic programming of a unigram vocabulary.

A text's pre-tokens are its words (runs that are no ASCII white space), each with the
vocabulary's word mark before it. The number of tokens of a pre-token is that of its best
segmentation into vocabulary pieces (the highest sum of scores; ties to fewer tokens, then
to the shorter last piece). The best score of a prefix does not depend on what follows, so the
distinct pre-tokens of a batch go into a trie and every prefix is scored once, when its node
is made; a node where a pre-token ends holds its count. The trie lives in the Python worker
and is emptied at ``MAX_NODES``, so memory is bounded whatever the corpus, and no shuffle is
needed: each document is counted where it is read.

The vocabulary is that of a public piece file. Its own numbers are merge ranks, so a piece's
score is the log-probability of Zipf's law at its rank. A character outside the vocabulary
counts its UTF-8 bytes (byte fallback), at the score of the last rank each.

Defined results: a null or empty text has 0 pre-tokens and 0 tokens; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Nodes of a worker's trie, about 200 bytes each.
MAX_NODES = 1_000_000
#: Counts of whole pre-tokens that a worker keeps beside it, about 100 bytes each.
MAX_WORDS = 800_000
COUNTS = "doc_id long, n_pretokens long, n_tokens long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def scores_of(vocabulary: str) -> tuple[dict[str, float], float]:
    """Piece -> score by Zipf's law over the file's order, and the score of a fallback byte."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=vocabulary)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    harmonic = math.fsum(1 / r for r in range(1, len(pieces) + 1))
    scores = {p: -math.log(r * harmonic) for r, p in enumerate(pieces, 1)}
    return scores, -math.log((len(pieces) + 1) * harmonic)


class Node:
    """A prefix: its best score, the tokens of that segmentation, the way to longer prefixes."""

    __slots__ = ("children", "score", "tokens", "terminal")

    def __init__(self, score: float, tokens: int):
        self.children: dict[str, Node] | None = None
        self.score, self.tokens = score, tokens
        self.terminal: int | None = None


class UnigramTrie:
    """Counts tokens of pre-tokens; prefixes are scored once while they stay in the trie."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        self.endings = {p[i:] for p in scores for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = Node(0.0, 0), 1

    def _extended(self, path: list[Node], text: str, end: int) -> Node:
        """The node of text[:end], scored from the nodes of its shorter prefixes."""
        last, get, endings = text[end - 1], self.scores.get, self.endings
        n_bytes = 1 if last < "\x80" else len(last.encode("utf-8", "surrogatepass"))
        before = path[end - 1]
        best, tokens = before.score + n_bytes * self.byte_score, before.tokens + n_bytes
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            piece = text[start:end]
            if piece not in endings:  # no piece ends like this, so no longer one does
                break
            s = get(piece)
            if s is not None:
                p = path[start]
                total = p.score + s
                if total > best or (total == best and p.tokens + 1 < tokens):
                    best, tokens = total, p.tokens + 1
        return Node(best, tokens)

    def count(self, pretoken: str) -> int:
        if self.nodes + len(pretoken) > MAX_NODES:
            self.clear()
        if len(pretoken) > MAX_NODES // 4:
            return self._long(pretoken)
        node, path = self.root, [self.root]
        for end, c in enumerate(pretoken, 1):
            child = node.children.get(c) if node.children else None
            if child is None:
                child = self._extended(path, pretoken, end)
                if node.children is None:
                    node.children = {}
                node.children[c] = child
                self.nodes += 1
            path.append(child)
            node = child
        node.terminal = node.tokens
        return node.terminal

    def _long(self, text: str) -> int:
        """The same scores for a very long pre-token, keeping only as many prefixes as a piece is long."""
        window = [Node(0.0, 0)]
        for end in range(1, len(text) + 1):
            low = max(0, end - self.longest)
            part = text[low:end]
            window = window[-(end - low):]
            window.append(self._extended(window, part, len(part)))
        return window[-1].tokens


@lru_cache(maxsize=1)
def worker_trie(vocabulary: str) -> tuple[UnigramTrie, dict[str, int]]:
    """One per Python worker, with the counts of the pre-tokens that it has seen."""
    return UnigramTrie(*scores_of(vocabulary)), {}


def _tally(words: list[bytes], trie: UnigramTrie, known: dict[bytes, int]) -> int:
    found = list(map(known.get, words))
    if None in found:
        new = Counter(w for w, n in zip(words, found, strict=True) if n is None)
        extra = 0
        for w in sorted(new):  # sorted: neighbours share prefixes
            n = trie.count(MARK + w.decode("utf-8", "surrogatepass"))
            extra += n * new[w]
            if len(w) <= 64:
                if len(known) >= MAX_WORDS:
                    known.clear()
                known[w] = n
        return extra + sum(n for n in found if n is not None)
    return sum(found)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: ``doc_id, n_pretokens, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = worker_trie(vocabulary)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                w = text.as_buffer().to_pybytes().split() if text.is_valid else []  # ASCII white space only
                words.append(len(w))
                tokens.append(_tally(w, trie, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, COUNTS)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
