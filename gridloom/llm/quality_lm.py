"""Document quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are of ORDER bytes of whole texts, with line feeds before the start and after the end. All are
counted, so the tables grow with the trusted text.

*Training.* Tasks count the n-grams of their share of the trusted texts; counts are summed in shards by n-gram. For each
order, joins of the sharded counts give what Kneser-Ney smoothing needs: continuation counts (in how many bytes' company
an n-gram occurs), each context's total and its numbers of n-grams counted once, twice and more. Discounts come from
the counts of counts. A seen n-gram's probability is its discounted share plus its context's weight times the
probability of the n-gram without its first byte. One sharded table has, for each byte string, its probability if it was
seen, and its weight if it is a context.

*Scoring.* Documents are dealt to blocks of about BLOCK bytes. The distinct n-grams of a block, of all orders, are joined
with the model's shards, and what is found goes back to the block, where the logarithms are added up for each of its
documents: an n-gram moves once for all documents of the block. A model of up to SHARED rows is sent to all workers
instead; the figures are the same.

*Threshold.* A document is kept if its perplexity is at most MARGIN times the QUANTILE of the trusted documents of its
language, times a slack of 1 + SPREAD / sqrt(bytes), as the perplexity of a short text strays further; the quantile is
of perplexities over their own slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.scratch import Scratch, small
from gridloom.llm.workers import tidy

ORDER = 5
QUANTILE = 0.99
MARGIN = 1.1
SPREAD = 5.0
#: Rows of a model that workers get whole (20 bytes each), and bytes of text in a block where they do not.
SHARED, BLOCK = 2_000_000, 16 << 20
#: n-grams that a task holds before it hands on their counts.
_HELD = 2_000_000
_GROUP = 1 << 21


def gram_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of rows: the first one's number, the n-grams of ORDER bytes that end at each byte and after the last,
    as numbers, and where each row's begin, with one more. An empty text has no n-grams."""
    data, offs = W.text_buffers(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + _GROUP, side="right")) - 1)
        size = np.diff(offs[first : last + 1])
        full = size > 0
        # each text has ORDER - 1 line feeds before it and one after it
        begin = np.cumsum(np.where(full, size + ORDER, 0)) - np.where(full, size + ORDER, 0)
        buf = np.full(int(np.where(full, size + ORDER, 0).sum()) + ORDER, 10, dtype=np.uint8)
        at = np.arange(int(size.sum())) + np.repeat(begin + ORDER - 1 - (np.cumsum(size) - size), size)
        buf[at] = data[offs[first] : offs[last]]
        code = np.zeros(len(buf) - ORDER + 1, dtype=np.int64)
        for k in range(ORDER):
            code = (code << 8) | buf[k : len(code) + k]
        count = np.where(full, size + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        yield first, code[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], count)], bounds
        first = last


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, counts, fresh, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> None:
        nonlocal grams, counts, fresh, size
        all_grams = np.concatenate([grams, *(g for g, _ in fresh)])
        grams, which = np.unique(all_grams, return_inverse=True)
        counts = np.bincount(which, np.concatenate([counts, *(c for _, c in fresh)]), len(grams)).astype(np.int64)
        fresh, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[lo : lo + 100_000]), pa.array(counts[lo : lo + 100_000])], ["g", "c"])

    for b in batches:
        for _, codes, _ in gram_runs(b.column("text")):
            fresh.append(np.unique(codes, return_counts=True))
            size += len(fresh[-1][0])
            if size > _HELD:
                merged()
                if len(grams) > _HELD:
                    yield from out()
                    grams, counts = grams[:0], counts[:0]
    merged()
    yield from out()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of n-grams counted once, twice and more, from the numbers of n-grams of each count; where those are too few for
    the estimate, halves."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def train(trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (k, g, p, w): for byte strings g of k bytes, as numbers, the probability of the last byte after the others
    (null if it was not seen so) and the weight of shorter n-grams after g (null if g is not a context)."""
    counts = scratch.keep(trusted.select("text").mapInArrow(tidy(_count), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")))
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = tables[k + 1].select(F.col("g").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("g"))
        tables[k] = scratch.keep(shorter.groupBy("g").agg(F.count("*").alias("c")))
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("h", F.shiftright("g", 8))
        of = {r.c: r.n for r in t.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts(*(of.get(i, 0) for i in (1, 2, 3, 4)))
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = scratch.keep(t.groupBy("h").agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("w")))
        seen = t.join(contexts, "h").select("g", ((F.col("c") - cut) / F.col("total")).alias("a"), "w")
        if lower is None:
            seen = seen.withColumn("q", F.lit(1.0 / 256))
        else:
            seen = seen.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(lower, F.col("s") == F.col("lg"))
        seen = scratch.keep(seen.select("g", (F.col("a") + F.col("w") * F.col("q")).alias("p")))
        lower = seen.select(F.col("g").alias("lg"), F.col("p").alias("q"))
        parts.append(seen.select(F.lit(k).alias("k"), "g", "p", F.lit(None).cast("double").alias("w")))
        parts.append(contexts.select(F.lit(k - 1).alias("k"), F.col("h").alias("g"), F.lit(None).cast("double").alias("p"), "w"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    model = scratch.keep(both.groupBy("k", "g").agg(F.max("p").alias("p"), F.max("w").alias("w")))
    scratch.drop(*tables.values())
    return model


class Model:
    """Rows (k, g, p, w) that have all that some texts need."""

    def __init__(self, k: np.ndarray, g: np.ndarray, p: np.ndarray, w: np.ndarray):
        self.tables = []
        for order in range(ORDER + 1):
            at = np.flatnonzero(k == order)
            at = at[np.argsort(g[at])]
            self.tables.append((g[at], p[at], w[at]))

    def _look(self, order: int, codes: np.ndarray, which: int) -> np.ndarray:
        """NaN where there is none."""
        g, *values = self.tables[order]
        if not len(g):
            return np.full(len(codes), np.nan)
        at = np.minimum(np.searchsorted(g, codes), len(g) - 1)
        return np.where(g[at] == codes, values[which][at], np.nan)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of n-grams of ORDER bytes after the others."""
        p = np.full(len(codes), 1.0 / 256)
        for k in range(1, ORDER + 1):
            suffix = codes & ((1 << (8 * k)) - 1)
            seen, weight = self._look(k, suffix, 0), self._look(k - 1, suffix >> 8, 1)
            p = np.where(np.isnan(seen), np.where(np.isnan(weight), 1.0, weight) * p, seen)
        return np.log(p)

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of bytes, with the end, and perplexities of texts; 0 of both for a text without bytes."""
        n, value = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        for first, codes, begin in gram_runs(column):
            grams, which = np.unique(codes, return_inverse=True)
            sums = np.concatenate([[0.0], np.cumsum(self.log_probabilities(grams)[which])])
            rows = slice(first, first + len(begin) - 1)
            n[rows] = np.diff(begin)
            value[rows] = sums[begin[1:]] - sums[begin[:-1]]
        return n, np.where(n > 0, np.exp(-value / np.maximum(n, 1)), 0.0)


_loaded: dict[str, Model] = {}


def _needed(table: pa.Table) -> pa.Table:
    """The distinct byte strings of all lengths that a block's n-grams are made of."""
    chunks = table.column("text").chunks
    grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(c) for chunk in chunks for _, c, _ in gram_runs(chunk))]))
    ks, gs = [], []
    for k in range(ORDER + 1):
        suffix = grams & ((1 << (8 * k)) - 1)
        gs.append(np.unique(np.concatenate([suffix, grams >> 8 & ((1 << (8 * k)) - 1)])))
        ks.append(np.full(len(gs[-1]), k, dtype=np.int32))
    g = np.concatenate(gs)
    block = pa.array(np.full(len(g), table.column("block")[0].as_py() if table.num_rows else 0), pa.int64())
    return pa.table({"block": block, "k": pa.array(np.concatenate(ks)), "g": pa.array(g)})


def perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The rows of docs without text, with n_symbols (bytes and the end) and perplexity (null for a text without bytes).
    model: see train()."""
    rest = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["n_symbols long", "perplexity double"])

    def scored(rows: pa.RecordBatch | pa.Table, known: Model) -> list[pa.Array]:
        column = rows.column("text")
        n, ppl = known.scores(pa.concat_arrays([pa.array([], pa.large_string()), *(c.cast(pa.large_string()) for c in getattr(column, "chunks", [column]))]))
        return [*(rows.column(f.name) for f in rest), pa.array(n), pa.array(ppl, mask=n == 0)]

    names = [*(f.name for f in rest), "n_symbols", "perplexity"]
    numbers = lambda t: [t.column("k").to_numpy(), t.column("g").to_numpy(), *(t.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("p", "w"))]
    if model.count() <= SHARED:
        k, g, p, w = numbers(model.toArrow())
        shared = docs.sparkSession.sparkContext.broadcast((k.astype(np.int8), g, p.astype(np.float32), w.astype(np.float32)))
        name = f"{docs.sparkSession.sparkContext.applicationId}/{shared._jbroadcast.id()}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _loaded:
                _loaded.clear()
                _loaded[name] = Model(*shared.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays(scored(b, _loaded[name]), names)

        return docs.mapInArrow(tidy(run), schema)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64(*docs.columns), F.lit(total // BLOCK + 1)).alias("block")
    dealt = docs.select("*", block)
    needed = dealt.select("block", "text").groupBy("block").applyInArrow(_needed, "block long, k int, g long")
    found = needed.join(model, ["k", "g"]).select(F.col("block").alias("home"), "k", "g", F.col("p").cast("float").alias("p"), F.col("w").cast("float").alias("w"))

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        return pa.table(scored(rows, Model(*numbers(known))), names)

    return dealt.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(score, schema)


def quality(docs: DataFrame, trusted_ids: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, lang, n_symbols, perplexity, threshold and keep. trusted_ids has the
    doc_ids of trusted documents; the model and the quantiles come from all their texts.

    A language without a trusted document, as a null one, gets the threshold of all trusted documents; without any
    trusted text the threshold is null and all documents with bytes are kept. A text that is null or empty, so without
    bytes, has a null perplexity and is not kept. Texts of any length are read whole. Repeated rows and null doc_ids are kept as rows."""
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    ids = scratch.keep(trusted_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct())
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(lang as string) lang", "cast(text as string) text")
    model = train(docs.join(small(ids), F.col("doc_id") == F.col("__id"), "left_semi"), scratch)
    scored = scratch.keep(perplexities(docs, model))
    slack = 1 + F.lit(SPREAD) / F.sqrt("n_symbols")
    steady = scored.join(small(ids), F.col("doc_id") == F.col("__id"), "left_semi").where("perplexity is not null").withColumn("x", F.col("perplexity") / slack)
    at = F.percentile_approx("x", QUANTILE, 100_000)
    per = steady.where("lang is not null").groupBy(F.col("lang").alias("l")).agg(at.alias("q"))
    overall = steady.agg(at.alias("all")).first()["all"]
    out = scored.join(F.broadcast(per), F.col("lang") == F.col("l"), "left")
    limit = F.coalesce("q", F.lit(overall).cast("double")) * MARGIN * F.when(F.col("n_symbols") > 0, slack)
    out = out.select("doc_id", "lang", "n_symbols", "perplexity", limit.alias("threshold"))
    return out.withColumn("keep", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
