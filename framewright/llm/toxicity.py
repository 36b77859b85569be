"""Toxicity scores by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text and the first 4, 5, 6 and 8 bytes of longer ones, hashed to ``2**BITS``
slots. The machine gives each slot that stays a weight and a vector; each pair of terms in a text adds the product of their
vectors, so that two terms that are harmless alone can count together.

It is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` rows of each class, by a hash of doc_id, each text
once. All slots stay whose classes differ beyond chance (likelihood ratio of ``TELLING`` or more), and besides both slots of
each pair that together tell more than their sum (``TELLING_PAIR`` standard errors), neutral alone or not. Pairs are counted
among the ``PAIRED`` most frequent slots of the sample, which bounds that test; nothing else is cut. Fitting is
deterministic. All documents are scored in tasks, whole texts.

Edge cases: null and empty texts have no terms and get the bias alone; without labelled rows, or with one class only, every
score is that class's share (0 without rows); rows without doc_id are scored and not learnt from; repeated rows are scored
alike; an empty table stays empty; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import ALNUM, slices, split

BITS = 24
PREFIXES = (4, 5, 6, 8)
SAMPLE = 10_000
TELLING, TELLING_PAIR = 18.0, 6.0
PAIRED = 2048
FACTORS = 8
EPOCHS = 30
BATCH = 256


def term_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets): each text's distinct slots, sorted."""
    words = split(data, offsets, ALNUM, lower=True)
    found = [(words.hashes, words.text_of_word())] + [words.prefixes(k) for k in PREFIXES]
    hashes, text = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique((text.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)))
    first = np.searchsorted(both >> np.uint64(BITS), np.arange(len(offsets)))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int64), first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each text's rows."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class FactorizationMachine:
    """Logistic, second order; ``slots`` are those that stay, in order. Texts are lists of places in ``slots``."""

    def __init__(self, slots: np.ndarray, bias: float = 0.0):
        random = np.random.default_rng(7)
        self.slots, self.bias = slots, bias
        self.weights = np.zeros(len(slots))
        self.vectors = random.normal(0, 0.02, (len(slots), FACTORS))

    def places(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, offsets): the slots of each text that stay."""
        if not len(self.slots):
            return np.empty(0, np.int64), np.zeros_like(first)
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        known = self.slots[at] == slots
        return at[known], np.concatenate([[0], np.cumsum(known)])[first]

    def _parts(self, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vectors = self.vectors[at]
        sums = _sums(vectors, first)
        pairs = 0.5 * ((sums**2).sum(axis=1) - _sums((vectors**2).sum(axis=1), first))
        z = self.bias + _sums(self.weights[at], first) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), sums

    def score(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._parts(at, first)[0]

    def fit(self, at: np.ndarray, first: np.ndarray, y: np.ndarray, rate: float = 0.05, decay: float = 1e-3) -> None:
        """Adagrad over shuffled batches."""
        random = np.random.default_rng(11)
        squares = [np.full_like(self.weights, 1e-8), np.full_like(self.vectors, 1e-8), 1e-8]
        sizes = np.diff(first)
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for start in range(0, len(y), BATCH):
                part = order[start : start + BATCH]
                ends = np.concatenate([[0], np.cumsum(sizes[part])])
                own = at[np.repeat(first[part] - ends[:-1], sizes[part]) + np.arange(ends[-1])]
                score, sums = self._parts(own, ends)
                error = (score - y[part]) / len(part)
                of = np.repeat(error, sizes[part])
                kinds, place = np.unique(own, return_inverse=True)
                slope = np.bincount(place, of, len(kinds))
                turn = of[:, None] * np.repeat(sums, sizes[part], axis=0)
                turn = np.stack([np.bincount(place, turn[:, k], len(kinds)) for k in range(FACTORS)], axis=1)
                steps = [
                    slope + decay * self.weights[kinds],
                    turn - slope[:, None] * self.vectors[kinds] + decay * self.vectors[kinds],
                ]
                for values, square, step in zip((self.weights, self.vectors), squares, steps, strict=False):
                    square[kinds] += step**2
                    values[kinds] -= rate * step / np.sqrt(square[kinds])
                squares[2] += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(squares[2])


def telling_pairs(slots: np.ndarray, at: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots of pairs whose texts' classes differ from what both slots add up to. ``at``: places of each text in ``slots``."""
    both, toxic = np.zeros((2, len(slots), len(slots)), np.float32)
    for start in range(0, len(y), 1024):
        stop = min(start + 1024, len(y))
        dense = np.zeros((stop - start, len(slots)), np.float32)
        dense[np.repeat(np.arange(stop - start), np.diff(first[start : stop + 1])), at[first[start] : first[stop]]] = 1
        both += dense.T @ dense
        toxic += (dense * y[start:stop, None].astype(np.float32)).T @ dense
    alone = np.maximum(np.diag(both), 1)
    share = np.diag(toxic) / alone
    expected = np.clip(share[:, None] + share[None, :] - y.mean(), 0.01, 0.99)
    apart = both < 0.95 * np.minimum(alone[:, None], alone[None, :])  # not a word and its own prefix
    z = np.abs(toxic - both * expected) / np.sqrt(np.maximum(both, 1) * expected * (1 - expected))
    return slots[np.any(apart & (z >= TELLING_PAIR), axis=1)]


def _slot_counts(sample: DataFrame) -> DataFrame:
    """(slot, n, toxic): texts and toxic texts of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text"), 8 << 20):
                slots, first = term_slots(data, offsets)
                y = np.repeat(batch.column("toxic").slice(row, len(offsets) - 1).to_numpy(), np.diff(first))
                kinds, place = np.unique(slots, return_inverse=True)
                n, toxic = np.bincount(place, minlength=len(kinds)), np.bincount(place, y, len(kinds))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (kinds, n, toxic)], ["slot", "n", "toxic"])

    counts = sample.mapInArrow(run, "slot long, n long, toxic long").groupBy("slot")
    return counts.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def likelihood_ratio(n: Column, toxic: Column, share: float) -> Column:
    """Twice the log of how much likelier the toxic share of a slot's texts is than that of all."""
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return 2 * (part(toxic, share) + part(n - toxic, 1 - share))


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> FactorizationMachine:
    """``labels``: doc_id and toxic (0 or 1) of the rows to learn from."""
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    chosen = [labels.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    plain = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # at most 2 * sample rows of two numbers; equal texts of the sample count once
    rows = plain.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = stored(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "toxic", "text")).alias("r")).select("r.*"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    if toxic in (0, n):
        return FactorizationMachine(np.empty(0, np.int64), 40.0 if n and toxic == n else -40.0)
    share = toxic / n
    counts = stored(_slot_counts(rows))
    telling = counts.filter(likelihood_ratio(F.col("n"), F.col("toxic"), share) >= TELLING)
    frequent = counts.orderBy(F.desc("n"), "slot").limit(PAIRED)
    telling, frequent = (np.sort(x.select("slot").toPandas()["slot"].to_numpy(np.int64)) for x in (telling, frequent))
    shared = docs.sparkSession.sparkContext.broadcast(np.union1d(telling, frequent))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                slots, first = term_slots(data, offsets)
                known = np.isin(slots, shared.value)
                first = np.concatenate([[0], np.cumsum(known)])[first]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(slots[known].astype(np.int32)))
                part = [batch.column(c).slice(row, len(offsets) - 1) for c in ("doc_id", "toxic")]
                yield pa.RecordBatch.from_arrays([*part, lists], ["doc_id", "toxic", "slots"])

    found = rows.mapInArrow(terms, "doc_id long, toxic double, slots array<int>").orderBy("doc_id").toArrow()
    lists = found.column("slots").combine_chunks()
    flat, first = lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    y = found.column("toxic").to_numpy()
    bias = float(np.log(y.mean() / (1 - y.mean())))
    pairs = telling_pairs(frequent, *FactorizationMachine(frequent).places(flat, first), y)
    machine = FactorizationMachine(np.union1d(telling, pairs), bias)
    machine.fit(*machine.places(flat, first), y)
    return machine


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, text: str = "text") -> DataFrame:
    """Per row: doc_id and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                scores = machine.score(*machine.places(*term_slots(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(scores)), pa.array(scores, pa.float64())], ["doc_id", "score"])

    plain = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    schema = plain.select("doc_id").schema.add("score", "double")
    return plain.mapInArrow(run, schema)
