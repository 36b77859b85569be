"""Cross-entropy difference scoring with matched word bigram models of a target and a background corpus.

Both models share one vocabulary (all words of the whole corpus, unless ``vocabulary`` asks for its most frequent ones
only; the others are one unknown word) and one smoothing: a bigram's probability is its count plus ``prior`` times the
word's unigram probability, over the count of the word before plus ``prior``. A document's score is the mean over its words
of target loss less background loss (nats): the lower, the more it is like the target.

Words and bigrams are counted under 64-bit hashes, so that the tables grow with the corpus; they are dealt to shards by hash,
a shard for every ``SHARD`` bytes of text, never gathered. The documents are stored, compressed, in slices of about ``SLICE``
bytes; their ids alone are joined with the target's, which gives each slice a bit for each of its documents. Each slice sends a
shard its distinct hashes with their counts, one row for each shard; the shard adds them up and answers each slice with the
totals in the slice's own order; the slice is scored from the answers. A hot word is one entry of a slice, however often it stands there, so no key is dealt unevenly. Only totals (words, documents, distinct words) reach the driver.

Edge cases: null and empty texts have 0 tokens, null losses and score 0; a target without documents gives the unsmoothed
prior for the target; repeated rows count and are scored each time; texts of any length are whole; an empty table gives an
empty table; only doc_id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import ALNUM, mix, slices, split

SLICE = 10 << 20
SHARD, LEAST_BITS = 32 << 20, 8
PRIOR = 50.0
ALPHA = 0.1
COUNTED = 1 << 21
#: Stand for the start of a text and, with a limited vocabulary, for unknown words.
START, UNKNOWN = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_WORD = np.uint64(0xA0761D6478BD642F)
_REQUEST = "shard int, slice long, target boolean, n int, keys binary, counts binary"


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").alias("text"))


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte of all of them, so that the upper zero bytes cost nothing."""
    return _packed(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unpacked_keys(blob: bytes, n: int) -> np.ndarray:
    steps = np.ascontiguousarray(_unpacked(blob, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64)
    return np.cumsum(steps.reshape(n), dtype=np.uint64)


def vocabulary_of(docs: DataFrame, size: int, text: str = "text") -> np.ndarray:
    """Sorted hashes of the ``size`` most frequent words, ties by hash."""

    def pairs(held: list[np.ndarray]) -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                held.append(split(data, offsets, ALNUM, lower=True).hashes)
                n += len(held[-1])
                if n >= COUNTED:
                    yield pairs(held)
                    held, n = [], 0
        if n:
            yield pairs(held)

    counts = _texts(docs, text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow().column("word")
    return np.sort(top.to_numpy().astype(np.int64).astype(np.uint64))


def _keys(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None, bits: int) -> tuple[np.ndarray, ...]:
    """(words of each text, first word of each text, key of each word, of each word before (0 at a start), of each bigram)."""
    found = split(data, offsets, ALNUM, lower=True)
    word = found.hashes
    if known is not None:
        word = np.where(np.isin(word, known), word, UNKNOWN)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = found.first[:-1][found.counts > 0]
    before[starts] = START
    bigram = mix(mix(before) * np.uint64(0x100000001B3) + word)
    if bits < 64:
        bigram = mix(bigram >> np.uint64(64 - bits))
    return found.counts, found.first, mix(word ^ _WORD), np.where(before == START, np.uint64(0), mix(before ^ _WORD)), bigram


def _counts(n: np.ndarray, word: np.ndarray, before: np.ndarray, bigram: np.ndarray, parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, counts): of words as words, as words before, and of bigrams, in the texts of each of ``parts``."""
    keys, place = np.unique(np.concatenate([word, bigram]), return_inverse=True)
    counts = np.zeros((6, len(keys)), np.uint32)
    at, m = np.searchsorted(keys, before), len(word)
    for k, texts in enumerate(parts):
        if texts is not None:
            own = np.repeat(texts, n)
            counts[3 * k] = np.bincount(place[:m][own], minlength=len(keys))
            counts[3 * k + 1] = np.bincount(at[own & (before != 0)], minlength=len(keys))
            counts[3 * k + 2] = np.bincount(place[m:][own], minlength=len(keys))
    return keys, counts


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's keys begin among sorted ones, and the end."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1))


def _requests(keys: np.ndarray, counts: np.ndarray, piece: int, target: bool, bits: int) -> pa.RecordBatch:
    edges = _edges(keys, bits)
    full = np.flatnonzero(np.diff(edges))
    columns = [pa.array(full, pa.int32()), pa.array(np.full(len(full), piece)), pa.array(np.full(len(full), target))]
    columns.append(pa.array(np.diff(edges)[full], pa.int32()))
    # a shard's first key counts from the shard's own start
    base = full.astype(np.uint64) << np.uint64(64 - bits)
    columns.append(pa.array([_packed_keys(keys[edges[s] : edges[s + 1]] - b) for s, b in zip(full, base, strict=True)], pa.binary()))
    columns.append(pa.array([_packed(counts[:, edges[s] : edges[s + 1]]) for s in full], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["shard", "slice", "target", "n", "keys", "counts"])


def _answer(totals: np.ndarray) -> bytes:
    """Byte by byte of all totals, so that the upper zero bytes cost nothing."""
    return _packed(np.ascontiguousarray(totals).view(np.uint8).reshape(-1, 8).T)


def _answered(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(blob, np.uint8, 48 * n).reshape(8, 6 * n).T).view(np.int64).reshape(6, n)


def _sliced(docs: DataFrame, text: str) -> DataFrame:
    """(slice, ids, offsets, size, data): the documents in stored slices, cut where they are read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        texts: list[bytes] = []

        def sliced() -> pa.RecordBatch:
            held = pa.concat_arrays(ids)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            columns = [pa.array([piece]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)]
            columns += [pa.array([_packed(offsets)], pa.binary()), pa.array([int(offsets[-1])], pa.int64())]
            columns.append(pa.array([_packed(np.frombuffer(b"".join(texts), np.uint8))], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["slice", "ids", "offsets", "size", "data"])

        size = 0
        for batch in batches:
            for row, data, offsets in slices(batch.column("text"), max(1, SLICE // 8)):
                ids.append(batch.column("doc_id").slice(row, len(offsets) - 1))
                sizes.append(np.diff(offsets))
                texts.append(data.tobytes())
                size += len(data)
                if size >= SLICE:
                    yield sliced()
                    ids, sizes, texts, size, piece = [], [], [], 0, piece + 1
        if ids:
            yield sliced()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(cut, "slice long, ids array<long>, offsets binary, size long, data binary"))


def _marks(pieces: DataFrame, target: DataFrame) -> DataFrame:
    """(slice, marks): a bit for each document of a slice, 1 in the target; none after the last 1, no row without a 1."""

    def bits(table: pa.Table) -> pa.Table:
        places = table.column("place").to_numpy()
        marks = np.zeros(places.max() + 1, bool)
        marks[places] = True
        return pa.table({"slice": table.column("slice").slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    ids = pieces.select("slice", F.posexplode("ids").alias("place", "doc_id"))
    met = ids.join(target.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    return stored(met.select("slice", "place").groupBy("slice").applyInArrow(bits, "slice long, marks binary"))


def _marked(marks: bytes | None, n: int) -> np.ndarray:
    found = np.zeros(n, bool)
    if marks is not None:
        ones = np.unpackbits(np.frombuffer(marks, np.uint8))[:n]
        found[: len(ones)] = ones == 1
    return found


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, vocabulary: int | None = None, bits: int = 64, text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_tokens, target_loss, background_loss, score. ``target``: the documents of the target, by
    doc_id alone if it has no text column (then they are those of ``docs``), or with texts of their own."""
    known = None if vocabulary is None else vocabulary_of(docs, vocabulary, text)
    by_id = text not in target.columns
    pieces = _sliced(docs, text)
    size = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(LEAST_BITS, (size // SHARD).bit_length())

    def text_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return _unpacked(row["data"], np.uint8, row["size"]), _unpacked(row["offsets"], np.int64, len(row["ids"]) + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                row = batch.slice(row, 1).to_pylist()[0]
                n, _, *keys = _keys(*text_of(row), known, bits)
                marks = _marked(row["marks"], len(n)) if by_id else np.zeros(len(n), bool)
                yield _requests(*_counts(n, *keys, (marks, np.ones(len(n), bool))), row["slice"], False, shards)

    def ask_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch.column("text"), SLICE):
                n, _, *keys = _keys(data, offsets, known, bits)
                yield _requests(*_counts(n, *keys, (np.ones(len(n), bool), None)), -1, True, shards)

    def add(table: pa.Table) -> pa.Table:
        """A shard's answers, and in the row of slice -1 its totals: target words, target starts, words, starts, kinds."""
        rows = table.to_pylist()
        keys = [_unpacked_keys(r["keys"], r["n"]) for r in rows]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        # of the target and of all documents: words, words before, bigrams
        totals = np.zeros((6, len(every)), np.int64)
        at, places = 0, []
        for r, own in zip(rows, keys, strict=True):
            places.append(place[at : at + len(own)])
            at += len(own)
            totals[:, places[-1]] += _unpacked(r["counts"], np.uint32, 6 * len(own)).reshape(6, -1)
        answers = [(r["slice"], _answer(totals[:, mine])) for r, mine in zip(rows, places, strict=True) if not r["target"]]
        sums = [*totals[[0, 1, 3, 4]].sum(axis=1), np.count_nonzero(totals[3])]
        shard = rows[0]["shard"]
        columns = [pa.array([shard] * (len(answers) + 1), pa.int32()), pa.array([s for s, _ in answers] + [-1], pa.int64())]
        columns += [pa.array([b for _, b in answers] + [np.array(sums, np.int64).tobytes()], pa.binary())]
        return pa.Table.from_arrays(columns, ["shard", "slice", "answer"])

    # the marks are a small row for each slice, not the target's ids, so that the slices stay where they are as long as those fit
    marked = pieces.join(_marks(pieces, target), "slice", "left") if by_id else pieces
    asked = marked.mapInArrow(ask, _REQUEST)
    if not by_id:
        asked = asked.unionByName(_texts(target, text).mapInArrow(ask_target, _REQUEST))
    answers = stored(asked.groupBy("shard").applyInArrow(add, "shard int, slice long, answer binary"))
    sums = answers.filter("slice = -1").select("answer").toLocalIterator()  # a row a shard
    sums = sum((np.frombuffer(r["answer"], np.int64) for r in sums), np.zeros(5, np.int64))
    n_kinds = int(sums[4]) + 2 if vocabulary is None else len(known) + 2
    # words, and texts that have words: each has one word more than it has words with a word before
    all_words, last = (int(sums[0]), int(sums[2])), (int(sums[0] - sums[1]), int(sums[2] - sums[3]))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        n, first, word, before, bigram = _keys(*text_of(row), known, bits)
        keys = np.unique(np.concatenate([word, bigram]))
        totals = np.zeros((6, len(keys)), np.int64)
        edges = _edges(keys, shards)
        for r in right.to_pylist():
            a, b = edges[r["shard"]], edges[r["shard"] + 1]
            totals[:, a:b] = _answered(r["answer"], b - a)
        w, g = np.searchsorted(keys, word), np.searchsorted(keys, bigram)
        start = before == 0
        p = np.where(start, 0, np.searchsorted(keys, before))
        full = n > 0
        means = []
        for k in range(2):
            unigram = (totals[3 * k][w] + ALPHA) / (all_words[k] + ALPHA * n_kinds)
            befores = np.where(start, last[k], totals[3 * k + 1][p])
            losses = -np.log((totals[3 * k + 2][g] + PRIOR * unigram) / (befores + PRIOR))
            mean = np.full(len(n), np.nan)
            if full.any():
                mean[full] = np.add.reduceat(losses, first[:-1][full]) / n[full]
            means.append(mean)
        columns = [left.column("ids").combine_chunks().flatten(), pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=~full) for x in means)]
        columns.append(pa.array(np.where(full, means[0] - means[1], 0.0)))
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    replies = answers.filter("slice >= 0").groupBy("slice")
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return pieces.groupBy("slice").cogroup(replies).applyInArrow(score, schema)
