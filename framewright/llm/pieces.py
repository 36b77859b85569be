"""SentencePiece BPE encoding by a prefix table, and decoding.

For merge-type (BPE) vocabularies each prefix of a text has one encoding, and that of a longer prefix ends in the one
token that is compatible with the token before it. So a table of each prefix's last token is enough: an Aho-Corasick
automaton lists the tokens that end at a place, a pair test picks the compatible one, and the ids are read backwards.

Two tokens are compatible if merging the text of both gives just these two. The test goes back through the merges of
both tokens: at each step two parts touch at the border, and a merge of these two must not come before the next merge of
either (on the left side an equal rank comes first, as ties go to the left).

No piece has a word mark after another character, and some characters are in no piece, so a text is cut there without
changing its ids; short stretches are remembered up to ``REMEMBERED`` entries a task.

Models: BPE with byte fallback, identity normalisation, dummy prefix, escaped spaces. Others are refused.

Edge cases: null and empty texts encode to the end id alone; repeated rows are encoded alike; empty tables stay empty;
a text of any length is one row; other columns stay as they are, and those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .store import free_name, schema_with

MARK = "▁"
REMEMBERED = 120_000
LONGEST_REMEMBERED = 48
ROWS = 64


@dataclass
class Vocabulary:
    """``pieces`` by id; ``normal``: ids that merges may give; ``rank``: merge order, lower first; ``byte``: value by id."""

    pieces: list[str]
    normal: dict[str, int]
    rank: list[float]
    byte: dict[int, int]
    silent: set[int]
    end: int
    split: dict[int, tuple[int, int]]
    reachable: list[int]


def read_vocabulary(model_file: str) -> Vocabulary:
    """Reads the model on the driver; its size is that of the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    ids = range(n)
    pieces = [model.id_to_piece(i) for i in ids]
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte = {i: int(pieces[i][3:5], 16) for i in ids if model.is_byte(i)}
    if len(byte) != 256 or any(MARK in pieces[i].lstrip(MARK) for i in plain) or model.normalize("  x") != MARK * 3 + "x":
        raise ValueError("only BPE models with byte fallback, dummy prefix and identity normalisation are supported")
    rank = [-model.get_score(i) for i in ids]
    silent = {i for i in ids if model.is_control(i)}
    found = Vocabulary(pieces, {pieces[i]: i for i in plain}, rank, byte, silent, model.eos_id(), {}, [])
    for i in plain:
        merged, last = _merge(found, pieces[i])
        if merged == [i]:
            found.reachable.append(i)
            if last:
                found.split[i] = last
    return found


def _merge(v: Vocabulary, text: str) -> tuple[list[int], tuple[int, int] | None]:
    """Plain merging of a short text: the ids (-1: none), and the pair that was merged last."""
    ids = [v.normal.get(c, -1) for c in text]
    last = None
    while True:
        best = None
        for k in range(len(ids) - 1):
            if ids[k] >= 0 and ids[k + 1] >= 0:
                to = v.normal.get(v.pieces[ids[k]] + v.pieces[ids[k + 1]])
                if to is not None and (best is None or v.rank[to] < v.rank[best[1]]):
                    best = k, to
        if best is None:
            return ids, last
        k, to = best
        last = ids[k], ids[k + 1]
        ids[k : k + 2] = [to]


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.automaton = ahocorasick.Automaton()
        for i in v.reachable:
            self.automaton.add_word(v.pieces[i], (i, len(v.pieces[i])))
        self.automaton.make_automaton()
        used = {c for i in v.reachable for c in v.pieces[i]}
        self.borders = "".join(c for c in "\n\t\r" if c not in used)
        border = re.escape(self.borders)
        self.cut = re.compile(f"{MARK}*[^{MARK}{border}]+|{MARK}+" + (f"|[{border}]" if border else "")).findall
        self.byte_ids = {value: i for i, value in v.byte.items()}
        # texts by id; bytes of longer characters have none of their own
        self.texts = [p.replace(MARK, " ") for p in v.pieces]
        for i, value in v.byte.items():
            self.texts[i] = chr(value) if value < 0x80 else ""
        for i in v.silent:
            self.texts[i] = ""
        self.parts = frozenset(i for i, value in v.byte.items() if value >= 0x80)
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _compatible(self, left: int, right: int) -> bool:
        pieces, rank, split, normal = self.v.pieces, self.v.rank, self.v.split, self.v.normal
        up_left = up_right = float("inf")  # the ranks at which the two parts are merged into larger ones
        while True:
            across = normal.get(pieces[left] + pieces[right])
            if across is not None and rank[across] < up_left and rank[across] <= up_right:
                return False
            l, r = split.get(left), split.get(right)
            if l is None and r is None:
                return True
            # undo the merge that came last
            if r is None or (l is not None and rank[left] > rank[right]):
                up_left, left = rank[left], l[1]
            else:
                up_right, right = rank[right], r[0]

    def _stretch(self, text: str) -> tuple[int, ...]:
        last = [-1] * (len(text) + 1)  # the last token of each prefix; -1: a character of no piece
        sizes = [1] * (len(text) + 1)
        fits, base = self.fits, len(self.v.pieces)
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - size]
            if size < end and before >= 0:
                pair = before * base + token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= 4 * REMEMBERED:
                        fits.clear()
                    fit = fits[pair] = self._compatible(before, token)
                if not fit:
                    continue
            last[end] = token
            sizes[end] = size
        ids, end = [], len(text)
        while end:
            token = last[end]
            if token < 0:
                ids.extend([self.byte_ids[b] for b in reversed(text[end - 1].encode())])
            else:
                ids.append(token)
            end -= sizes[end]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids without the end id."""
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        for part in self.cut(MARK + text.replace(" ", MARK)):
            got = known.get(part)
            if got is None:
                got = self._stretch(part)
                if len(part) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces' texts without the dummy space; runs of byte pieces are read as UTF-8."""
        texts = self.texts
        if self.parts.isdisjoint(ids):
            return "".join(map(texts.__getitem__, ids)).removeprefix(" ")
        byte, out, raw = self.v.byte, [], bytearray()
        for i in ids:
            if i in byte:
                raw.append(byte[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(texts[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out).removeprefix(" ")


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """``docs`` with the column ``ids``: array of the model's ids of the whole text, with the end id if ``end``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_file))
    others = [c for c in docs.columns if c != ids]
    plain = free_name(docs, "plain")
    frame = docs.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        last = [encoder.v.end] if end else []
        for batch in batches:
            for row in range(0, len(batch), ROWS):
                part = batch.slice(row, ROWS)
                flat, ends = [], [0]
                for x in part.columns[-1].to_pylist():
                    flat += encoder.encode(x) + last
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                columns = part.columns[:-1] + [lists]
                yield pa.RecordBatch.from_arrays(columns, [*others, ids])

    return frame.mapInArrow(run, schema_with(frame.drop(plain), ids, ArrayType(IntegerType())))


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``text``: the text of its ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model_file))
    others = [c for c in encoded.columns if c != text]
    frame = encoded.select(*others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for row in range(0, len(batch), ROWS):
                part = batch.slice(row, ROWS)
                lists = pc.fill_null(part.column(ids), pa.scalar([], pa.list_(pa.int32())))
                ends, flat = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
                texts = [encoder.decode(flat[a:b].tolist()) for a, b in pairwise(ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*others, text])

    return frame.mapInArrow(run, schema_with(frame, text, StringType()))


_encoders: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The encoder of this Python worker: tasks that it runs later use it again."""
    vocabulary = shared.value
    if id(vocabulary) not in _encoders:
        _encoders.clear()
        _encoders[id(vocabulary)] = Encoder(vocabulary)
    return _encoders[id(vocabulary)]
