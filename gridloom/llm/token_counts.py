"""Token counts of a unigram vocabulary, by dynamic programming along a trie of pre-tokens.

A pre-token's segmentation is that of the largest total score of its pieces (of equal totals the fewest pieces). The
forward step for a byte prefix, its best score and number of pieces, depends on that prefix alone. So distinct
pre-tokens are put in a trie, a node's forward step is computed once when the node is made, and the node where a
pre-token ends holds its count of tokens. What lies beyond the first LONG bytes of a pre-token is not put in the trie:
its forward steps need only as many of the steps before as the longest piece has bytes.

Scores: a vocabulary file of ranks has none, so a piece of rank r scores -ln(r + 1 + OFFSET), the logarithm of a
Zipf-Mandelbrot frequency but for a constant; only differences between segmentations matter."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.byte_bpe import ByteBPE, Memory, read_ranks, text_groups
from gridloom.llm.workers import prepare, tidy

OFFSET = 2.7
#: Nodes that a worker's trie may have before it is begun anew.
NODES = 300_000
#: Bytes of a pre-token that the trie holds.
LONG = 1024


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    return {piece: -math.log(r + 1 + OFFSET) for piece, r in ranks.items()}


class PrefixTrie:
    """Forward steps of all prefixes of the pre-tokens met so far."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int] | None] = [None]
        self.score, self.tokens = [0.0], [0]

    def count(self, word: bytes) -> int:
        """Tokens of the best segmentation; every single byte is a piece, so there is one."""
        if len(self.score) > NODES:
            self.clear()
        node, children, path = 0, self.children, [(0.0, 0)]
        for end, byte in enumerate(word[:LONG], 1):
            if (kids := children[node]) is None:
                kids = children[node] = {}
            if (nxt := kids.get(byte)) is None:
                nxt = kids[byte] = len(self.score)
                best, fewest = self._forward(word, end, path)
                children.append(None)
                self.score.append(best)
                self.tokens.append(fewest)
            node = nxt
            path.append((self.score[node], self.tokens[node]))
        for end in range(LONG + 1, len(word) + 1):
            path.append(self._forward(word, end, path))
            if len(path) > 4 * self.longest:
                del path[: -self.longest]
        return path[-1][1]

    def _forward(self, word: bytes, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of word[:end]; path ends with those of shorter prefixes."""
        best, fewest, get = -math.inf, 0, self.scores.get
        for back in range(1, min(self.longest, len(path)) + 1):
            if (s := get(word[end - back : end])) is not None:
                total, n = path[-back][0] + s, path[-back][1] + 1
                if total > best or total == best and n < fewest:
                    best, fewest = total, n
        return best, fewest


class Counter:
    """Tokens of texts; spaced as for ByteBPE."""

    def __init__(self, scores: dict[bytes, float], pattern: str, spaced: bool):
        self.trie, self.pattern, self.spaced = PrefixTrie(scores), regex.compile(pattern), spaced
        self.stretches = Memory()

    def _count(self, text: str) -> int:
        return sum(self.trie.count(m.encode()) for m in self.pattern.findall(text))

    def count_all(self, texts: list[str]) -> list[int]:
        plans, stretches = [], set()
        for t in texts:
            first, rest = t, ()
            if self.spaced and not ByteBPE.SPACES.search(t):
                first, *rest = t.split(" ")
                stretches.update(rest)
            plans.append((first, rest))
        new = self.stretches.lacking(stretches)
        for x in sorted(new):
            self.stretches.add(x, self._count(" " + x))
        known = self.stretches.now.__getitem__
        out = [self._count(first) + sum(map(known, rest)) for first, rest in plans]
        self.stretches.forget(new)
        return out


_counters: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, ranks: bytes, pattern: str, spaced: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens. ranks and pattern as for byte_bpe.encode, spaced for patterns
    as in ByteBPE. Null and empty texts have 0 tokens; texts and pre-tokens of any length are counted whole; repeated rows
    and null doc_ids are kept; other columns are ignored. Memory of a task is bounded by NODES and byte_bpe.MEMORY."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hashlib.sha256(shared.value).digest(), pattern, spaced)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(zipf_scores(read_ranks(shared.value)), pattern, spaced)
        counter = _counters[key]
        for b in batches:
            n = [x for _, texts in text_groups(b.column("text")) for x in counter.count_all(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
        _counters.clear()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id long, n_tokens long")
