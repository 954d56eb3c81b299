"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 with DIM places, drawn from its code point. A run of three characters of a
text (lower-cased letters; anything else is one boundary) is bound to the product of its letters' vectors, permuted by
their place in the run. A text's vector is the bundle, i.e. the sum, of its runs' vectors, and a language's prototype is
the bundle of its training texts. A text gets the language of the largest cosine.

A text is bundled whole, from the vectors of its distinct runs and their counts. Each worker makes the vector of a run
once and remembers up to REMEMBERED of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.workers import prepare, tidy

DIM = 1024
NONE = "und"
#: Runs whose vectors, of DIM bytes each, a worker remembers.
REMEMBERED = 32_000
_BOUNDARY = 0x1FFFFF
_MASK = (1 << 21) - 1

_letters: dict[int, np.ndarray] = {}
_folded: np.ndarray | None = None


def _fold() -> np.ndarray:
    """For each code point, that of its lower-case letter, or the boundary if it is no letter."""
    global _folded
    if _folded is None:
        table = np.full(0x110000, _BOUNDARY, dtype=np.int64)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded = table
    return _folded


def runs(text: str) -> np.ndarray:
    """Codes of the three-character runs of a text that hold a letter, with a boundary before and after it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.concatenate([[_BOUNDARY], _fold()[points], [_BOUNDARY]])
    edge = c == _BOUNDARY
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    c = c[keep]
    if len(c) < 3:
        return c[:0]
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _letter(point: int) -> np.ndarray:
    if point not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[point] = np.random.default_rng([7, point]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
    return _letters[point]


def run_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code."""
    out = np.ones((len(codes), DIM), dtype=np.int8)
    for place, shift in ((2, 42), (1, 21), (0, 0)):
        points, which = np.unique((codes >> shift) & _MASK, return_inverse=True)
        out *= np.stack([np.roll(_letter(int(p)), place) for p in points])[which]
    return out


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(DIM, dtype=np.int64)
    for lo in range(0, len(codes), 2048):
        total += np.rint(counts[lo : lo + 2048].astype(np.float64) @ run_vectors(codes[lo : lo + 2048])).astype(np.int64)
    return total


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def add(lang: str, parts: list[np.ndarray]) -> None:
        codes, counts = np.unique(np.concatenate(parts), return_counts=True)
        totals[lang] = totals.get(lang, 0) + bundle(codes, counts)

    held, size = defaultdict(list), 0
    for b in batches:
        for t, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
            held[lang].append(runs(t.as_py()))
            size += len(held[lang][-1])
            if size > 4_000_000:
                for k, parts in held.items():
                    add(k, parts)
                held, size = defaultdict(list), 0
    for k, parts in held.items():
        add(k, parts)
    for lang, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "profile"])


def _add_profiles(table: pa.Table) -> pa.Table:
    total = np.zeros(DIM, dtype=np.int64)
    for x in table.column("profile"):
        total += x.values.to_numpy()
    return pa.table({"lang": table.column("lang").slice(0, 1), "profile": pa.array([total.tolist()], pa.list_(pa.int64()))})


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """A vector for each lang of the rows (text, lang) that have both: DIM numbers a language on the driver, summed
    from one partial vector a task and language."""
    prepare(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").selectExpr("cast(text as string) text", "cast(lang as string) lang")
    schema = "lang string, profile array<bigint>"
    lanes = rows.mapInArrow(tidy(_learn), schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))
    summed = lanes.groupBy("lang", "lane").applyInArrow(_add_profiles, schema).groupBy("lang").applyInArrow(_add_profiles, schema)
    found = {r.lang: np.array(r.profile, dtype=np.float64) for r in summed.toLocalIterator()}
    return {k: v for k, v in sorted(found.items()) if v.any()}


class Comparer:
    """Cosines of texts with prototypes."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = list(profiles)
        unit = [v / np.linalg.norm(v) for v in profiles.values()]
        self.unit = np.stack(unit, axis=1) if unit else np.zeros((DIM, 0))
        self.codes, self.vectors = np.zeros(0, dtype=np.int64), np.zeros((0, DIM), dtype=np.int8)

    def _learn(self, codes: np.ndarray) -> None:
        """Makes sure that the vectors of these codes, ascending, are at hand."""
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if not len(new):
            return
        if len(self.codes) + len(new) > REMEMBERED:
            self.codes, self.vectors, new = self.codes[:0], self.vectors[:0], codes
        made = np.concatenate([run_vectors(new[lo : lo + 2048]) for lo in range(0, len(new), 2048)])
        both = np.concatenate([self.codes, new])
        order = np.argsort(both)
        self.codes, self.vectors = both[order], np.concatenate([self.vectors, made])[order]

    def bundled(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIM)
        for lo in range(0, len(codes), 4096):
            rows = self.vectors[np.searchsorted(self.codes, codes[lo : lo + 4096])]
            total += counts[lo : lo + 4096].astype(np.float32) @ rows.astype(np.float32)
        return total

    def compare(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(NONE, 0.0)] * len(texts)
        if not self.langs:
            return out
        held, size = [], 0
        for i, t in enumerate(texts):
            if t and len(r := runs(t)):
                held.append((i, *np.unique(r, return_counts=True)))
                size += len(held[-1][1])
            if held and (size > REMEMBERED or i == len(texts) - 1):
                # of a text with more runs than may be held, a part at a time
                if len(held) == 1 and size > REMEMBERED:
                    self._decide(out, held[0][0], bundle(*held[0][1:]).astype(np.float64))
                else:
                    self._learn(np.unique(np.concatenate([c for _, c, _ in held])))
                    for k, codes, counts in held:
                        self._decide(out, k, self.bundled(codes, counts))
                held, size = [], 0
        return out

    def _decide(self, out: list[tuple[str, float]], k: int, vector: np.ndarray) -> None:
        length = np.linalg.norm(vector)
        cosines = vector @ self.unit / length if length else np.zeros(len(self.langs))
        best = int(np.argmax(cosines))
        out[k] = self.langs[best], float(min(1.0, max(0.0, cosines[best])))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """The rows of docs with lang_pred and score (the cosine, cut to 0..1). A text that is null or has no letter gets
    `und` and 0, as all do if there is no prototype; of equal cosines the language first in order wins. Columns of docs
    of these two names are replaced; others, and repeated rows, are kept. Texts of any length are bundled whole."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(profiles)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                got = comparer.compare(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*b.schema.names, "lang_pred", "score"]
                )

    return docs.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
