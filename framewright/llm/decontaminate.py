"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The strings searched for are the windows of ``window`` consecutive words of each benchmark item (a shorter item is one
window). A shift table over blocks of up to three words tells how far the window's end may jump at least; where the
shift is 0, the hash of the suffix block selects the bucket of strings that end so; the strings' word hashes and then
their very bytes are compared with the text's. All documents of a batch are searched at once: their words are cut into
lanes that overlap by a window less one word, and each step moves every lane by its own shift.

Items are the stated query set. Their tables are broadcast in blocks of ``shard_windows`` windows (and at most one item
more; some 100 bytes a window). One block is searched in a single pass. With more, every block has a pass of its own over
the documents, and what the passes found in a row is put together, so that a worker never holds more than one block.

Edge cases: null and empty texts have no words and no hits; items without words match nothing; equal items and repeated
item ids each count once by id; the words of items without an id are hit, but nothing is counted for them; repeated
documents each get their row; empty tables on either side give no hits or no rows; other columns of the documents are
dropped by ``benchmark_hits`` and kept by ``decontaminate``. Texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from .store import stored
from .words import ALNUM, Words, covered, slices, split

RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SHARD_WINDOWS = 200_000
LANE = 512


class ShiftTables:
    """Wu-Manber tables for strings of one length: rows of ``strings`` are the word hashes."""

    def __init__(self, strings: np.ndarray, texts: list[bytes]):
        self.m, self.texts = strings.shape[1], texts
        self.block = min(3, self.m)
        self.bits = max(12, int(len(strings) * self.m).bit_length() + 3)
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.uint16)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self._slot(self._blocks(strings, end)), np.uint16(self.m - end))
        suffix = self._blocks(strings, self.m)
        order = np.argsort(suffix, kind="stable")
        self.strings, self.order = strings[order], order
        self.suffixes, self.bucket = np.unique(suffix[order], return_index=True)
        self.bucket = np.append(self.bucket, len(strings))

    def _blocks(self, rows: np.ndarray, end: int) -> np.ndarray:
        h = rows[:, end - self.block].copy()
        for j in range(end - self.block + 1, end):
            h = h * np.uint64(0x9FB21C651E98DF25) + rows[:, j]
        return h

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, string) of every occurrence in the words, text ends not regarded."""
        start, string = self._candidates(words.hashes)
        size = self.m - 1
        same = [
            b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[i : i + size + 1], words.ends[i : i + size + 1], strict=True)) == self.texts[s]
            for i, s in zip(start.tolist(), string.tolist(), strict=True)
        ]
        same = np.array(same, bool)
        return start[same], string[same]

    def _candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, b, n = self.m, self.block, len(h)
        if n < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        end = np.arange(m - 1, n, LANE)
        stop = np.minimum(end + LANE, n)
        starts, strings = [], []
        while len(end):
            block = h[end - b + 1].copy()
            for j in range(b - 2, -1, -1):
                block = block * np.uint64(0x9FB21C651E98DF25) + h[end - j]
            shift = self.shift[self._slot(block)].astype(np.int64)
            if len(here := np.flatnonzero(shift == 0)):
                found = self._confirm(h, end[here] - m + 1, block[here])
                starts.append(found[0])
                strings.append(found[1])
            end = end + np.maximum(shift, 1)
            live = end < stop
            end, stop = end[live], stop[live]
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), self.order[np.concatenate(strings)]

    def _confirm(self, h: np.ndarray, start: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.suffixes, block)
        known = np.flatnonzero((at < len(self.suffixes)) & (self.suffixes[np.minimum(at, len(self.suffixes) - 1)] == block))
        at, start = at[known], start[known]
        sizes = self.bucket[at + 1] - self.bucket[at]
        place = np.repeat(start, sizes)
        string = np.repeat(self.bucket[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(place))
        for j in range(self.m):
            same = h[place + j] == self.strings[string, j]
            place, string = place[same], string[same]
        return place, string


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(batch.column("text")):
            words = split(data, offsets, ALNUM, lower=True)
            texts = pa.array([words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), texts)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(row, len(offsets) - 1), lists], ["item_id", "words"])


def _blocks(items: DataFrame, window: int, limit: int) -> Iterator[dict[int, dict[bytes, set[str]]]]:
    """For each block: by length, the distinct strings and the item ids of each."""
    rows = (
        items.select("item_id", F.col("text").cast("string").alias("text"))
        .mapInArrow(_item_words, items.select("item_id").schema.add("words", ArrayType(BinaryType())))
        .filter(F.size("words") > 0)
    )
    block: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    n = 0
    for row in rows.toLocalIterator():
        words = [bytes(w) for w in row["words"]]
        m = min(window, len(words))
        for i in range(len(words) - m + 1):
            ids = block[m][b" ".join(words[i : i + m])]
            if row["item_id"] is not None:
                ids.add(str(row["item_id"]))
        n += len(words) - m + 1
        if n >= limit:
            yield block
            block, n = defaultdict(lambda: defaultdict(set)), 0
    if n:
        yield block


def _tables(block: dict[int, dict[bytes, set[str]]]) -> dict[int, tuple[ShiftTables, list[list[str]]]]:
    out = {}
    for m, found in block.items():
        texts = list(found)
        data = np.frombuffer(b" ".join(texts), np.uint8)
        hashes = split(data, np.array([0, len(data)]), ALNUM, lower=False).hashes
        out[m] = ShiftTables(hashes.reshape(-1, m), texts), [sorted(ids) for ids in found.values()]
    return out


def _search(tables: dict[int, tuple[ShiftTables, list[list[str]]]], words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Whether each word is hit, and each text's items."""
    hit = np.zeros(len(words.hashes), bool)
    items: dict[int, set[str]] = defaultdict(set)
    text = words.text_of_word()
    for m, (table, ids) in tables.items():
        start, string = table.search(words)
        if len(start):
            inside = text[start] == text[start + m - 1]  # lanes run over the texts' ends
            start, string = start[inside], string[inside]
            hit |= covered(start, m, len(hit))
            pairs = np.unique(np.stack([text[start], string]), axis=1)
            for t, s in zip(*pairs.tolist(), strict=True):
                items[t].update(ids[s])
    return hit, items


def _results(counts: np.ndarray, n_hit: np.ndarray, items: list) -> dict[str, pa.Array]:
    digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return {
        "n_words": pa.array(counts, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array(digests, pa.string()),
        "contaminated": pa.array(n_hit > 0),
    }


def _hits_by_text(hit: np.ndarray, words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[words.first[1:]] - total[words.first[:-1]]


def benchmark_hits(
    docs: DataFrame, items: DataFrame, window: int = 10, shard_windows: int = SHARD_WINDOWS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per document: doc_id, the columns of ``keep``, n_words, n_hit, n_items, items_sha256, contaminated."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(_tables(x)) for x in _blocks(items, window, shard_windows)]
    kept = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "text", "_text", *RESULTS)]
    frame = docs.select("doc_id", *kept, F.col("text").cast("string").alias("_text"))
    schema = frame.drop("_text").schema
    for name, kind in (("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")):
        schema = schema.add(name, kind)
    if len(blocks) > 1:
        return _in_passes(frame, blocks, schema)
    block = blocks[0] if blocks else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("_text")):
                words = split(data, offsets, ALNUM, lower=True)
                hit, items_of = _search(block.value if block else {}, words)
                n = len(offsets) - 1
                found = _results(words.counts, _hits_by_text(hit, words), [items_of.get(i, ()) for i in range(n)])
                names = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, n) for c in names] + list(found.values()), names + list(found))

    return frame.mapInArrow(search, schema)


def _in_passes(frame: DataFrame, blocks: list[Broadcast], schema: StructType) -> DataFrame:
    """A pass for each block; rows are stored with a number, under which what the passes found is put together."""
    rows = stored(frame.withColumn("_row", F.monotonically_increasing_id()))

    def one_pass(block: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, data, offsets in slices(batch.column("_text")):
                    words = split(data, offsets, ALNUM, lower=True)
                    hit, items = _search(block.value, words)
                    texts = sorted(items)
                    places = [np.flatnonzero(hit[words.first[t] : words.first[t + 1]]) for t in texts]
                    ids = batch.column("_row").slice(row, len(offsets) - 1).take(pa.array(texts, pa.int64()))
                    columns = [ids, pa.array(places, pa.list_(pa.int64())), pa.array([sorted(items[t]) for t in texts], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["_row", "places", "items"])

        return rows.select("_row", "_text").mapInArrow(search, "_row long, places array<long>, items array<string>")

    found = reduce(DataFrame.union, map(one_pass, blocks))
    found = found.groupBy("_row").agg(F.flatten(F.collect_list("places")).alias("_places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))
    found = found.withColumn("_hit", F.size(F.array_distinct("_places")))
    both = rows.join(found.select("_row", "_hit", "_items"), "_row", "left").drop("_row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("_text")):
                n = len(offsets) - 1
                items = [x or [] for x in batch.column("_items").slice(row, n).to_pylist()]
                n_hit = batch.column("_hit").slice(row, n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                out = _results(split(data, offsets, ALNUM, lower=True).counts, n_hit, items)
                names = [c for c in batch.schema.names if c not in ("_text", "_hit", "_items")]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, n) for c in names] + list(out.values()), names + list(out))

    return both.mapInArrow(finish, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_hit: float = 0.0) -> DataFrame:
    """``docs`` without the documents of which more than the share ``max_hit`` of the words lies inside item windows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_{i}" for i, c in enumerate(["text", *others])}
    plain = docs.select("doc_id", "text", *(F.col(c).alias(names[c]) for c in names))
    hits = benchmark_hits(plain, items, window, keep=tuple(names.values()))
    clean = hits.filter(F.col("n_hit") <= max_hit * F.col("n_words"))
    return clean.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))
