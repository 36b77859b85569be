"""Removal of passages that repeat across documents, located by sharded Aho-Corasick automata.

A passage is a window of ``window`` consecutive words (not blank, unchanged). A word goes if it is covered by a window that
also starts in a document with a smaller doc_id. Of equal texts the one with the smallest doc_id stands for all: its copies go
whole, and take no part in what follows. Three steps for the others:

1. Anchors. Each window has one anchor: of its runs of ``anchor`` words the one with the least hash. Equal windows have
   equal anchors, and neighbouring windows mostly share one, so only about a fifth as many anchors as words are
   shuffled. Anchors that a single document has are dropped, and with them nearly all windows.
2. Confirmation. The windows of the anchors left are shuffled; those of two documents or more are recurring passages, each
   with the smallest document that has it.
3. Location. Documents go through in shards of about ``SHARD_WORDS`` words. The confirmed passages that a join by document
   says may occur in a shard are compiled, word by word, into automata of at most ``PATTERNS``
   passages; every document of the shard is streamed through each. The places that an automaton reports, and nothing else,
   decide: a reported passage of a smaller document is removed.

One key may be in a third of all documents: each task first gathers a key's documents of about ``CHUNK_WORDS`` words into
one row, so a key has at most a row for each such chunk, of bounded size. Candidates are known by 64-bit hashes, and an
automaton's words by theirs.

Edge cases: null and empty texts have no words and stay empty; texts shorter than a window lose nothing; documents without
doc_id are not smaller or greater than any other, lose nothing and take nothing; rows with the same doc_id do not take
words from each other and are each returned; texts of any length are whole; an empty table stays empty; other columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks, shared_keys
from .store import stored
from .texts import packed, unpacked
from .words import NON_SPACE, Words, covered, mix, slices, split

CHUNK_WORDS = 1 << 20
SHARD_WORDS = 300_000
PATTERNS = 20_000


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place, text ends not regarded."""
    total = hashes[: max(len(hashes) - k + 1, 0)].copy()
    for j in range(1, k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[j : len(hashes) - k + 1 + j]
    return mix(total + np.uint64(k))


def _windows(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, anchor hash) of each window inside one text."""
    n = len(words.hashes)
    text = words.text_of_word()
    at = np.flatnonzero(np.arange(window, n + window) <= words.first[text + 1])
    if not len(at):
        return at, text[at], np.empty(0, np.uint64)
    runs = _runs(words.hashes, anchor)
    least = runs[at]
    for j in range(1, window - anchor + 1):
        np.minimum(least, runs[at + j], out=least)
    return at, text[at], least


def _ids(batch: pa.RecordBatch, row: int, n: int) -> np.ndarray:
    return batch.column("doc_id").slice(row, n).to_numpy(zero_copy_only=False).astype(np.int64)


def _plain(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _unpacked(batch: pa.RecordBatch, rows: int = 64) -> Iterator[tuple[int, pa.Array]]:
    for row in range(0, len(batch), rows):
        yield row, unpacked(batch.column("packed").slice(row, rows).to_pylist())


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; null: empty."""
    lists = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _whole(words: Words) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    total = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(mix(words.hashes + mix((np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64))), out=total[1:])
    return mix(total[words.first[1:]] - total[words.first[:-1]] + words.counts.astype(np.uint64)).astype(np.int64)


def whole_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, wholes): hashes of a document's texts that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks("whole", CHUNK_WORDS)
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                words = split(data, offsets, NON_SPACE, lower=False)
                yield from chunks.add(_whole(words).astype(np.uint64), _ids(batch, row, len(offsets) - 1), len(words.hashes))
        yield from chunks.flush()

    rows = _plain(docs, text).filter("doc_id IS NOT NULL").mapInArrow(run, "whole long, doc long, docs array<long>")
    return shared_keys(rows, "whole").filter("lo < doc_id").groupBy("doc_id").agg(F.collect_set("whole").alias("wholes"))


def recurring_windows(docs: DataFrame, copies: DataFrame, window: int = 13, anchor: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, win, lo): windows of a document, by hash, that the smaller document ``lo`` has too; none of whole copies."""
    plain = _plain(docs, text).filter("doc_id IS NOT NULL")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks("anchor", CHUNK_WORDS)
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                words = split(data, offsets, NON_SPACE, lower=False)
                _, of, least = _windows(words, window, anchor)
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
                yield from chunks.add(least[new], _ids(batch, row, len(offsets) - 1)[of[new]], len(words.hashes))
        yield from chunks.flush()

    found = shared_keys(plain.mapInArrow(anchors, "anchor long, doc long, docs array<long>"), "anchor")
    found = found.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")).join(copies, "doc_id", "left")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks("win", CHUNK_WORDS)
        for batch in batches:
            values, ends = _lists(batch.column("anchors"))
            values = values.to_numpy(zero_copy_only=False).astype(np.uint64)
            wholes = batch.column("wholes").to_pylist()
            for start, texts in _unpacked(batch):
                for row, data, offsets in slices(texts):
                    words = split(data, offsets, NON_SPACE, lower=False)
                    at, of, least = _windows(words, window, anchor)
                    keep = np.zeros(len(at), bool)
                    bounds = np.searchsorted(of, np.arange(len(offsets)))
                    whole = _whole(words).tolist()
                    for k in range(len(offsets) - 1):
                        if whole[k] in (wholes[start + row + k] or ()):
                            continue
                        own = values[ends[start + row + k] : ends[start + row + k + 1]]
                        keep[bounds[k] : bounds[k + 1]] = np.isin(least[bounds[k] : bounds[k + 1]], own)
                    hashes = _runs(words.hashes, window)[at[keep]] if keep.any() else np.empty(0, np.uint64)
                    yield from chunks.add(hashes, _ids(batch, start + row, len(offsets) - 1)[of[keep]], len(words.hashes))
        yield from chunks.flush()

    joined = packed(plain).join(found, "doc_id")
    return shared_keys(joined.mapInArrow(candidates, "win long, doc long, docs array<long>"), "win").filter("lo < doc_id")


def _line(known: np.ndarray, codes: np.ndarray, text: np.ndarray) -> tuple[str, np.ndarray]:
    """The words of passages (at the places ``known``) as one line, and where each begins in it. A word is three characters
    of three alphabets of 64, as an automaton looks through a node's characters one by one; a gap or a text's end is a bar."""
    broken = np.ones(len(known), np.int64)
    broken[1:] = (known[1:] != known[:-1] + 1) | (text[known[1:]] != text[known[:-1]])
    begins = np.cumsum(broken + 3) - 3
    line = np.full(begins[-1] + 3 if len(begins) else 0, ord("|"), "<u4")
    for k in range(3):
        line[begins + k] = 256 * (k + 1) + ((codes >> (6 * k)) & 63)
    return line.tobytes().decode("utf-32-le"), begins


def located(words: Words, passages: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first words, passages) of every occurrence inside one text. ``passages``: first words of one occurrence of each."""
    text = words.text_of_word()
    most = (64**3 - 1) // window
    for start in range(0, len(passages), min(PATTERNS, most)):
        some = passages[start : start + min(PATTERNS, most)]
        # a code for each word of these passages; no other word can be part of one
        kinds = np.unique(words.hashes[some[:, None] + np.arange(window)])
        at = np.minimum(np.searchsorted(kinds, words.hashes), len(kinds) - 1)
        known = np.flatnonzero(kinds[at] == words.hashes)
        line, begins = _line(known, at[known], text)
        automaton = ahocorasick.Automaton()
        for k, begin in enumerate(begins[np.searchsorted(known, some)].tolist(), start):
            automaton.add_word(line[begin : begin + 3 * window], k)
        automaton.make_automaton()
        found = np.fromiter(automaton.iter(line), np.dtype([("end", np.int64), ("passage", np.int64)]))
        word_at = np.zeros(len(line), np.int64)
        word_at[begins] = known
        yield word_at[found["end"] - 3 * window + 1], found["passage"]


def _removed(words: Words, ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], window: int) -> np.ndarray:
    """Whether each word goes. ``found``: for each text the recurring passages' hashes and smallest documents."""
    if not any(len(x) for x, _ in found):
        return np.zeros(len(words.hashes), bool)
    wins, one = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    lows = np.concatenate([x for _, x in found])[one]
    # the words of each passage, where one of the shard's texts has it
    at = _windows(words, window, window)[0]
    hashes, first = np.unique(_runs(words.hashes, window)[at].astype(np.int64), return_index=True)
    place = np.minimum(np.searchsorted(hashes, wins), len(hashes) - 1)
    here = hashes[place] == wins
    lows, text = lows[here], words.text_of_word()
    starts = []
    for begin, passage in located(words, at[first[place[here]]], window):
        starts.append(begin[lows[passage] < ids[text[begin]]])
    return covered(np.concatenate(starts), window, len(words.hashes)) if starts else np.zeros(len(words.hashes), bool)


def remove_repeats(docs: DataFrame, window: int = 13, anchor: int = 5, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (the words left, joined by one space)."""
    copies = stored(whole_copies(docs, text))
    recurring = recurring_windows(docs, copies, window, anchor, text)
    lists = recurring.groupBy("doc_id").agg(F.collect_list(F.struct("win", "lo")).alias("found"))
    lists = lists.join(copies, "doc_id", "full")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _lists(batch.column("found"))
            win = values.field("win").to_numpy(zero_copy_only=False)
            low = values.field("lo").to_numpy(zero_copy_only=False)
            wholes = batch.column("wholes").to_pylist()
            for start, texts in _unpacked(batch, 1024):
                for row, data, offsets in slices(texts, SHARD_WORDS * 6):
                    words = split(data, offsets, NON_SPACE, lower=False)
                    rows = range(start + row, start + row + len(offsets) - 1)
                    ids = batch.column("doc_id").slice(rows[0], len(rows))
                    lists = [(win[ends[i] : ends[i + 1]], low[ends[i] : ends[i + 1]]) for i in rows]
                    # a document without id has no passages, and none is of a smaller one
                    gone = _removed(words, pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False), lists, window)
                    copy = [n >= window and own in (wholes[i] or ()) for n, own, i in zip(words.counts, _whole(words).tolist(), rows, strict=True)]
                    gone |= np.repeat(copy, words.counts)
                    removed = np.concatenate([[0], np.cumsum(gone)])
                    removed = removed[words.first[1:]] - removed[words.first[:-1]]
                    columns = [ids, pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), _joined(words, ~gone)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    texts = packed(_plain(docs, text)).join(lists, "doc_id", "left")
    return texts.mapInArrow(locate, "doc_id long, n_words long, n_removed long, kept_text string")


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space, built on the bytes."""
    starts, ends = words.starts[keep], words.ends[keep]
    sizes = ends - starts + 1
    total = int(sizes.sum())
    out = np.full(total, 0x20, np.uint8)
    to = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(total) - np.repeat(to[:-1] - starts, sizes)
    inside = np.ones(total, bool)
    inside[to[1:] - 1] = False
    out[inside] = words.data[places[inside]]
    kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
    lists = to[kept]
    texts = pa.Array.from_buffers(pa.large_binary(), len(kept) - 1, [None, pa.py_buffer(lists.astype(np.int64)), pa.py_buffer(out)])
    # each text ends in the space after its last word
    return pc.binary_slice(texts.cast(pa.binary()), 0, -1).cast(pa.string()) if total else pa.array([""] * (len(kept) - 1))
