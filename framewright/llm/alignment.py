"""Cross-tokenizer alignment: which tokens of one tokenizer (A) end where those of another (B) end, and how often.

Both tokenizers cut the bytes of a space and the text. Where a token of each ends, a group ends, and the two tokens are
linked. What links which over the whole corpus stands in an index of inverted bitmaps: for each pair of ids (A, B) the
documents that link it, as compressed bitmaps over the documents of a block, a plane for each bit of how often a document
links it. A block's bitmaps are its slices' merged by OR; bits counted over the merged planes give documents and links of
each pair, and those numbers, summed over blocks by Spark, are the pairs' scores. Every block then gets the scores of its
own pairs back, and its postings return them to the documents.

A block holds a bounded number of links, or one longer document, so no task sees more of a pair than one block's documents,
however common the pair is; sums over blocks are ordinary partial aggregates. The numbers of documents, links and blocks
grow in proportion to the input.

Null and empty texts have no tokens, nor do texts whose tokens don't give the bytes back (A's or B's normalisation changed
them): zeros and an empty digest. Repeated rows count as documents of their own, rows without doc_id too. Other columns
aren't carried.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: A block's links and documents; documents have two bytes in a bitmap.
BLOCK_LINKS, BLOCK_DOCS = 3_000_000, 1 << 16
#: Bytes of text that are tokenized at once.
SLICE_BYTES = 1 << 20
#: Bits of an id in a pair's number, A's above B's.
ID_BITS = 20

INDEX = "block long, docs binary, pairs array<long>, pair_docs array<int>, pair_links array<int>, planes binary"
RESULTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Vocabulary:
    """The bytes of every token one after another: token i's start at ``starts[i]`` and are ``sizes[i]`` many."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        if len(tokens) > 1 << ID_BITS:
            raise ValueError(f"more than {1 << ID_BITS} ids")
        sizes = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_runs(self.starts[ids], self.sizes[ids])]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` many."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def _visible_bytes() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a visible character: those of Latin-1 that print as themselves, the others in
    order from U+0100 on."""
    printed = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    hidden = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(encoder of many texts to lists of ids, vocabulary) of a byte-level tokenizer's JSON file. The strings of special tokens
    are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        special = {t["id"] for t in json.load(f).get("added_tokens", [])}
    byte_of = _visible_bytes()
    tokens = [b""] * model.get_vocab_size(with_added_tokens=True)
    for token, k in model.get_vocab(with_added_tokens=True).items():
        tokens[k] = b"" if k in special else bytes(byte_of[c] for c in token)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    return encode, Vocabulary.of(tokens)


@lru_cache(maxsize=2)
def piece_level(path: str):
    """The same of a sentencepiece model: U+2581 stands for a space, <0xHH> for a byte; control and unknown pieces have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def piece(k: int) -> bytes:
        if model.is_control(k) or model.is_unknown(k):
            return b""
        if model.is_byte(k):
            return bytes([int(model.id_to_piece(k)[3:5], 16)])
        return model.id_to_piece(k).replace("▁", " ").encode()

    return lambda texts: model.encode(texts, num_threads=1), Vocabulary.of([piece(k) for k in range(model.vocab_size())])


@dataclass
class Cut:
    """Tokens of many texts in a row: ids, the byte after each, and each text's first token and the end."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def only(self, texts: np.ndarray) -> Cut:
        counts = self.counts[texts]
        at = _runs(self.first[:-1][texts], counts)
        return Cut(self.ids[at], self.ends[at], np.concatenate([[0], np.cumsum(counts)]))


def _cut(ids: list[list[int]], vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[Cut, np.ndarray]:
    """The tokens with their places in the texts' bytes, and the texts whose bytes they give back."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((k for row in ids for k in row), np.int64, int(counts.sum()))
    first = np.concatenate([[0], np.cumsum(counts)])
    joined = vocabulary.joined(flat)
    upto = np.concatenate([[0], np.cumsum(vocabulary.sizes[flat])])
    sizes, held = np.diff(offsets), np.diff(upto[first])
    same = sizes == held
    if same.all() and len(joined) == len(data):
        wrong = np.flatnonzero(joined != data)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
    else:
        for k in np.flatnonzero(same):
            same[k] = np.array_equal(joined[upto[first[k]] : upto[first[k + 1]]], data[offsets[k] : offsets[k + 1]])
    shift = np.repeat(offsets[:-1] - upto[first[:-1]], counts)
    return Cut(flat, upto[1:] + shift, first), same


def _numbers(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each) of decimal ids, each with its mark after it."""
    sizes = np.ones(len(ids), np.int64)
    for power in (10, 100, 1000, 10_000, 100_000, 1_000_000, 10_000_000):
        sizes += ids >= power
    ends = np.cumsum(sizes + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    left = ids.copy()
    at = ends - 2
    live = np.arange(len(ids))
    while len(live):
        out[at[live]] = 48 + left[live] % 10
        left[live] //= 10
        at[live] -= 1
        live = live[left[live] > 0]
    out[ends - 1] = marks
    return out, ends


def groups_of(a: Cut, b: Cut) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(last token of A of each group, last of B, each text's groups written as ``a1,a2|b1;a3|b2,b3``)."""
    in_both = np.isin(a.ends, b.ends, assume_unique=True)
    last_a = np.flatnonzero(in_both)
    last_b = np.searchsorted(b.ends, a.ends[last_a])
    # tokens in the order in which they are written: those of A of a group, then those of B
    group_a = np.searchsorted(last_a, np.arange(len(a.ids)))
    group_b = np.searchsorted(last_b, np.arange(len(b.ids)))
    before_b = np.concatenate([[0], last_b + 1])
    place_a = np.arange(len(a.ids)) + before_b[group_a]
    place_b = np.arange(len(b.ids)) + (last_a + 1)[group_b]
    ids, marks = np.empty(len(a.ids) + len(b.ids), np.int64), np.full(len(a.ids) + len(b.ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    marks[place_a[last_a]], marks[place_b[last_b]] = ord("|"), ord(";")
    text, ends = _numbers(ids, marks)
    stops = np.concatenate([[0], ends])[a.first + b.first]
    data = text.tobytes()
    return last_a, last_b, [data[i : j - 1] if j > i else b"" for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]


def _bitmaps(key: np.ndarray, slot: np.ndarray, n_keys: int, n_slots: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(sizes, kinds, bytes): a compressed bitmap over the slots for each key, from pairs sorted by (key, slot). A bitmap is
    the list of its slots in two bytes each, or its bits where those take less."""
    counts = np.bincount(key, minlength=n_keys)
    dense = counts * 16 > n_slots
    first = np.cumsum(counts) - counts
    lists = slot[~dense[key]].astype("<u2").tobytes()
    bits = []
    for k in np.flatnonzero(dense):
        plane = np.zeros(n_slots, bool)
        plane[slot[first[k] : first[k] + counts[k]]] = True
        bits.append(np.packbits(plane).tobytes())
    return counts, dense, lists + b"".join(bits)


def _unpacked_bitmaps(counts: np.ndarray, dense: np.ndarray, data: bytes, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, slot) of every bit."""
    few = np.where(dense, 0, counts)
    lists = np.frombuffer(data, "<u2", int(few.sum())).astype(np.int64)
    keys, slots = [np.repeat(np.arange(len(counts)), few)], [lists]
    width, at = (n_slots + 7) // 8, 2 * len(lists)
    for k in np.flatnonzero(dense):
        found = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=n_slots))
        keys.append(np.full(len(found), k))
        slots.append(found)
        at += width
    return np.concatenate(keys), np.concatenate(slots)


@dataclass
class Postings:
    """The bitmaps of a block: plane p of pair k has a document if bit p of how often it links the pair is set."""

    pairs: np.ndarray
    docs: np.ndarray
    links: np.ndarray
    planes: bytes

    @classmethod
    def of(cls, occurrences: list[np.ndarray], n_slots: int) -> Postings:
        """From the slices' (pair, slot) occurrences, as pair times ``BLOCK_DOCS`` plus slot; their numbers sorted."""
        pair_slots, times = np.unique(np.concatenate(occurrences), return_counts=True)
        pair, slot = pair_slots // BLOCK_DOCS, pair_slots % BLOCK_DOCS
        pairs, key = np.unique(pair, return_inverse=True)
        parts, links, p = [], np.zeros(len(pairs), np.int64), 0
        docs = np.bincount(key, minlength=len(pairs))
        while (left := times >> p).any():
            on = (left & 1).astype(bool)
            counts, dense, data = _bitmaps(key[on], slot[on], len(pairs), n_slots)
            links += counts << p  # bits counted, each worth its plane's power of two
            parts.append((counts.astype("<u4").tobytes(), np.packbits(dense).tobytes(), data))
            p += 1
        sizes = np.array([len(x) for part in parts for x in part], "<u8").tobytes()
        blob = bytes([p]) + sizes + b"".join(x for part in parts for x in part)
        return cls(pairs, docs, links, zstandard.ZstdCompressor(level=3).compress(blob))

    @staticmethod
    def entries(planes: bytes, n_pairs: int, n_slots: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(pair's place, slot, worth) of every bit, a plane at a time."""
        blob = zstandard.ZstdDecompressor().decompress(planes)
        n = blob[0]
        sizes = np.frombuffer(blob, "<u8", 3 * n, 1).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)]) + 1 + 24 * n
        for p in range(n):
            counts, dense, data = (blob[at[3 * p + j] : at[3 * p + j + 1]] for j in range(3))
            flags = np.unpackbits(np.frombuffer(dense, np.uint8), count=n_pairs).astype(bool)
            yield *_unpacked_bitmaps(np.frombuffer(counts, "<u4").astype(np.int64), flags, data, n_slots), 1 << p


_DOC_FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]


def _doc_table(rows: list[pa.Table]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.concat_tables(rows).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _Block:
    """Documents and occurrences gathered until a block is full."""

    def __init__(self, number: int):
        self.number, self.rows, self.occurrences, self.n_docs, self.n_links = number, [], [], 0, 0

    def add(self, rows: pa.Table, pairs: np.ndarray, text: np.ndarray) -> None:
        self.occurrences.append(pairs * BLOCK_DOCS + text + self.n_docs)
        self.rows.append(rows)
        self.n_docs += len(rows)
        self.n_links += len(pairs)

    def batch(self) -> pa.RecordBatch:
        found = Postings.of(self.occurrences, self.n_docs)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        columns = [
            pa.array([self.number]),
            pa.array([_doc_table(self.rows)], pa.binary()),
            one(found.pairs.astype(np.int64), pa.int64()),
            one(found.docs.astype(np.int32), pa.int32()),
            one(found.links.astype(np.int32), pa.int32()),
            pa.array([found.planes], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in INDEX.split(", ")])


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of rows of at most ``SLICE_BYTES``, or one longer row, and no more than half a block's documents."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    row = 0
    while row < len(texts):
        start = ends[row - 1] if row else 0
        stop = min(max(row + 1, int(np.searchsorted(ends, start + SLICE_BYTES, "right"))), row + BLOCK_DOCS // 2)
        yield ids.slice(row, stop - row), texts.slice(row, stop - row)
        row = stop


def _aligned(ids: pa.Array, texts: pa.Array, a_path: str, b_path: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(a row for each document, the pairs that its links join, the document of each)."""
    encode_a, words_a = byte_level(a_path)
    encode_b, words_b = piece_level(b_path)
    plain = [t or "" for t in texts.to_pylist()]
    used = [k for k, t in enumerate(plain) if t]
    spaced = [" " + plain[k] for k in used]
    raw = [t.encode() for t in spaced]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    data = np.frombuffer(b"".join(raw), np.uint8)
    a, same_a = _cut(encode_a(spaced), words_a, data, offsets)
    b, same_b = _cut(encode_b([plain[k] for k in used]), words_b, data, offsets)
    good = np.flatnonzero(same_a & same_b)
    a, b = a.only(good), b.only(good)
    last_a, last_b, written = groups_of(a, b)
    doc = np.array(used, np.int64)[good]
    n = len(plain)
    n_a, n_b, n_groups = (np.zeros(n, np.int64) for _ in range(3))
    n_a[doc], n_b[doc] = a.counts, b.counts
    text_of_link = doc[np.searchsorted(a.first, last_a, "right") - 1]
    np.add.at(n_groups, text_of_link, 1)
    digests = [""] * n
    for k, groups in zip(doc.tolist(), written):
        digests[k] = hashlib.sha256(groups).hexdigest()
    table = pa.table([ids, n_a, n_b, n_groups, pa.array(digests, pa.string())], _DOC_FIELDS)
    return table, a.ids[last_a] << ID_BITS | b.ids[last_b], text_of_link


def inverted_index(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The stored index: a row for each block of documents, with the documents' own numbers and the pairs' bitmaps."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block = _Block(first)
        for batch in batches:
            for ids, texts in _slices(batch.column("doc_id"), batch.column("text")):
                table, pairs, text = _aligned(ids, texts, a_path, b_path)
                if block.n_docs and (block.n_links + len(pairs) > BLOCK_LINKS or block.n_docs + len(table) > BLOCK_DOCS):
                    yield block.batch()
                    block = _Block(block.number + 1)
                block.add(table, pairs, text)
        if block.n_docs:
            yield block.batch()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(plain.mapInArrow(build, INDEX))


def pair_scores(index: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, n_links, best): each pair over the whole corpus; ``best``: no pair has more links of those
    with its B id. A B id has as many pairs as A has tokens at most."""
    each = index.select(F.explode(F.arrays_zip("pairs", "pair_docs", "pair_links")).alias("p"))
    sums = each.groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum(F.col("p.pair_docs").cast("long")).alias("n_docs"), F.sum(F.col("p.pair_links").cast("long")).alias("n_links")
    )
    ids = sums.withColumns({"a_id": F.shiftright("pair", ID_BITS).cast("int"), "b_id": F.col("pair").bitwiseAND((1 << ID_BITS) - 1).cast("int")})
    most = F.max("n_links").over(Window.partitionBy("b_id"))
    return ids.withColumn("best", F.col("n_links") == most)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``RESULTS`` for each document; a and b paths: a byte-level tokenizer's JSON file and a sentencepiece model, whose
    vocabularies have at most 2 ** ``ID_BITS`` ids each."""
    index = inverted_index(docs, a_path, b_path)
    scores = pair_scores(index).select("pair", "n_links", "best")
    wanted = index.select(F.col("block").alias("owner"), F.explode("pairs").alias("pair"))
    back = wanted.join(scores, "pair").select("owner", "pair", "n_links", "best")

    def returned(index_rows: pa.Table, found: pa.Table) -> pa.Table:
        row = {name: index_rows[name][0] for name in ("docs", "pairs", "planes")}
        with pa.ipc.open_stream(row["docs"].as_buffer()) as source:
            documents = source.read_all()
        pairs, n = row["pairs"].values.to_numpy(), len(documents)
        worth, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.searchsorted(pairs, found["pair"].to_numpy())
        worth[at], best[at] = found["n_links"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
        count_sum, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for key, slot, times in Postings.entries(row["planes"].as_py(), len(pairs), n):
            np.add.at(count_sum, slot, times * worth[key])
            np.add.at(n_best, slot, times * best[key])
        columns = {name: documents[name] for name in _DOC_FIELDS}
        columns |= {"n_links": documents["n_groups"], "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table([columns[f.split()[0]] for f in RESULTS.split(", ")], [f.split()[0] for f in RESULTS.split(", ")])

    groups = index.select("block", "docs", "pairs", "planes").groupBy("block").cogroup(back.groupBy("owner"))
    return groups.applyInArrow(returned, RESULTS)
