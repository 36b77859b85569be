"""N-gram Jaccard join of documents by a token-group matrix, and its connected groups.

A document is the set of its distinct ``k``-word shingles (lower-case A-Z; a shorter text is one shingle), by 64-bit hashes.
Two documents link if |A & B| * 100 >= percent * |A | B|. Every link is found, but links inside a group that is already
known to be connected are not spelled out, so no quadratic list of pairs of copies is made:

1. One document stands for all with the same set. Sets are told apart by their size and two sums of hashes. A set is known by
   that document's doc_id from here on, or by the first of its sums where the doc_id has other texts, too, so that these are
   judged apart.
2. All documents use one order of shingles: rare ones first by hash, then the ``FREQUENT`` most frequent by count. With
   t = percent / 100, a link's smallest common shingle lies in the first n - ceil(t n) + 1 shingles of both (their
   prefixes). More: if a's prefix ends first, then all but ceil(t n_a) - 1 shingles of the overlap lie in both prefixes, so
   a link has at least ``least_shared`` prefix shingles in common. Shingles in one document's prefix only are dropped.
3. Groups: each document is compared with the one document that leads most of its prefix shingles (the lead of a shingle
   is, of the documents that have it, the one with the largest share of shared shingles; for a family of copies the one
   nearest to the original). Linked ones are connected to groups.
4. Token-group matrix: for each group the union of its members' prefix shingles, with their least and greatest sizes. Each
   document is a query against the groups it isn't in: the shingles of its prefix that lie in the union are counted, which
   bounds what it shares with any member, and only groups that reach the least count of a link are opened.
5. An opened group's members are held in blocks of ``BLOCK`` members. In a block the query's overlap with the union of
   the members' whole sets is counted, and only if that could be a link, the members are compared one by one, up to the
   first link: the group is connected, so one is enough.

A task gathers the documents of a shingle of about ``CHUNK`` shingles into one row before the shuffle, so that one shingle
that is in a third of all documents has no more than a row for each such chunk. Blocks are dealt out by group, block of
members and block of queries, so that neither side of a large group meets in one task, and a text goes once to each block.

Edge cases: null and empty texts have the empty set and link with nothing; documents without doc_id link with nothing and
have no component; each row has its own result, by its own text, whether its doc_id is repeated or not; texts of any length
are whole; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .chunks import Chunks, shared_keys
from .store import free_name, schema_with, stored
from .texts import unpacked
from .words import NON_SPACE, mix, slices, split, windows

CHUNK = 1 << 20
#: Members and queries that meet in a block.
BLOCK, QUERIES = 64, 4096
#: Shingles in at least LEAST documents, at most FREQUENT of them, stand last in the order.
LEAST, FREQUENT = 24, 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets): each text's distinct shingles, sorted."""
    words = split(data, offsets, NON_SPACE, lower=True)
    hashes, _, text = windows(words, k)
    found = [(hashes, text)]
    for short in range(1, k):
        hashes, _, text = windows(words, short)
        whole = words.counts[text] == short
        found.append((hashes[whole], text[whole]))
    hashes, text = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(offsets)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _set_sums(tokens: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    return _sums(mix(tokens + np.uint64(salt)), first).astype(np.int64)


def _plain(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _nodes(batch: pa.RecordBatch, row: int, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the sets of a slice are known by: their doc_id, or their first sum where that doc_id has several sets."""
    ids, several = (batch.column(c).slice(row, len(first) - 1) for c in ("doc_id", "several"))
    return np.where(several.to_numpy(zero_copy_only=False), _set_sums(tokens, first, 1), ids.to_numpy(zero_copy_only=False))


def set_sizes(docs: DataFrame, k: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, n, a, b): size of the set and two sums of hashes that tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                tokens, first = shingle_sets(data, offsets, k)
                a, b = (_set_sums(tokens, first, salt) for salt in (1, 2))
                columns = [batch.column("doc_id").slice(row, len(a)), pa.array(np.diff(first), pa.int64()), pa.array(a), pa.array(b)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "a", "b"])

    return _plain(docs, text).mapInArrow(run, "doc_id long, n long, a long, b long")


def frequent_shingles(docs: DataFrame, k: int = 4, text: str = "text") -> np.ndarray:
    """The most frequent shingles, at most ``FREQUENT``, by rising count. Those once in a chunk don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(keys[more].astype(np.int64)), pa.array(counts[more].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                held.append(shingle_sets(data, offsets, k)[0])
                n += len(held[-1])
                if n >= 2 * CHUNK:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    counts = _plain(docs, text).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    return top["token"].to_numpy(np.int64).astype(np.uint64)[::-1]


def prefix_shingles(docs: DataFrame, frequent: np.ndarray, k: int = 4, percent: int = 85) -> DataFrame:
    """(token, doc, docs): prefix shingles and a node, or the least of several and an array of all, chunk by chunk.
    ``docs``: doc_id, text and ``several``."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        chunks = Chunks("token", CHUNK)
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                tokens, first = shingle_sets(data, offsets, k)
                sizes = np.diff(first)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                key = tokens & np.uint64((1 << 63) - 1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    key = np.where(known[at] == tokens, rank[at] | np.uint64(1 << 63), key)
                by = np.lexsort((key, text_of))
                place = np.arange(len(tokens)) - np.repeat(first[:-1], sizes)
                take = place < np.repeat(sizes - -(-sizes * percent // 100) + 1, sizes)
                yield from chunks.add(tokens[by][take], _nodes(batch, row, tokens, first)[text_of[take]], len(tokens))
        yield from chunks.flush()

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "token long, doc long, docs array<long>")


def _part(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100 - 1e-9)


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """The least number of prefix shingles that two linked sets of sizes n and m have in common."""
    overlap = F.ceil((n + m) * percent / (100 + percent) - 1e-9)
    return F.greatest(overlap - F.greatest(_part(n, percent), _part(m, percent)) + 1, F.lit(1))


def may_link(n: Column, least: Column, most: Column, shared: Column, percent: int) -> Column:
    """Whether a set of size n that has ``shared`` prefix shingles of a group's union can link with a member whose size is in
    least to most. But for its two round-ups the least count of a link rises up to n and falls from there on, so it is smallest
    at an end of the sizes that can link; as each round-up adds less than one, no size asks for more than one less."""
    small, large = F.greatest(least, _part(n, percent)), F.least(most, F.floor(n * 100 / percent + 1e-9))
    need = F.least(least_shared(n, small, percent), least_shared(n, large, percent)) - 1
    return (small <= large) & (shared >= F.greatest(need, F.lit(1)))


def packed_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, node, packed): each text compressed, with what its set is known by. ``docs``: doc_id, text and ``several``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                nodes = _nodes(batch, row, *shingle_sets(data, offsets, k))
                blobs = [packer.compress(data[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(nodes)), pa.array(nodes), pa.array(blobs, pa.binary())], ["doc_id", "node", "packed"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, node long, packed binary")


def compared(members: DataFrame, queries: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, every: bool) -> DataFrame:
    """Links (a, b) of queries a with members b of their groups: all, or the first in each block. ``members``/``queries``:
    grp and node; ``reps``: the document of each node; ``texts``: doc_id, node and packed text."""
    sides = [x.groupBy("grp").agg(F.count("*").alias(n)) for x, n in ((members, "m"), (queries, "q"))]
    sizes = sides[0].join(sides[1], "grp").select("grp", F.ceil(F.col("m") / BLOCK).alias("mp"), F.ceil(F.col("q") / QUERIES).alias("qp"))
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = members.join(sizes, "grp").select("grp", own(F.col("mp")).alias("block"), each("qp").alias("turn"), F.lit(0).alias("side"), "node")
    right = queries.join(sizes, "grp").select("grp", each("mp").alias("block"), own(F.col("qp")).alias("turn"), F.lit(1).alias("side"), "node")
    rows = left.union(right).join(reps.select("node", "doc_id"), "node").join(texts, ["doc_id", "node"]).drop("doc_id")
    rows = rows.repartition("grp", "block", "turn").sortWithinPartitions("grp", "block", "turn", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, Block(percent)
        for batch in batches:
            for row in range(0, len(batch), 256):
                part = batch.slice(row, 256)
                keys = list(zip(*(part.column(c).to_pylist() for c in ("grp", "block", "turn")), strict=True))
                sides, ids = part.column("side").to_pylist(), part.column("node").to_pylist()
                links: tuple[list[int], list[int]] = ([], [])
                for at, data, offsets in slices(unpacked(part.column("packed").to_pylist())):
                    tokens, first = shingle_sets(data, offsets, k)
                    for i in range(len(offsets) - 1):
                        if keys[at + i] != key:
                            key, block = keys[at + i], Block(percent)
                        own = tokens[first[i] : first[i + 1]]
                        if sides[at + i] == 0:
                            block.add(ids[at + i], own)
                            continue
                        for other in block.links(ids[at + i], own, every):
                            links[0].append(ids[at + i])
                            links[1].append(other)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class Block:
    """Members of a group: their sets, and the union of these."""

    def __init__(self, percent: int):
        self.percent, self.ids, self.held, self.sets, self.union = percent, [], set(), [], None

    def add(self, doc: int, tokens: np.ndarray) -> None:
        if doc in self.held:  # a repeated row
            return
        self.held.add(doc)
        # a copy: the slice would hold its whole batch
        self.ids.append(doc)
        self.sets.append(tokens.copy())

    def links(self, doc: int, tokens: np.ndarray, every: bool) -> Iterator[int]:
        if not self.sets:
            return
        if self.union is None:
            self.union, self.least = np.unique(np.concatenate(self.sets)), min(map(len, self.sets))
            self.place = np.concatenate([np.searchsorted(self.union, x) for x in self.sets])
            self.member = np.repeat(np.arange(len(self.sets)), list(map(len, self.sets)))
            self.sizes = np.array(list(map(len, self.sets)))
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        known = at[self.union[at] == tokens]
        # no member can hold more of the query than the union does
        if len(known) * (100 + self.percent) < self.percent * (len(tokens) + max(self.least, -(-len(tokens) * self.percent // 100))):
            return
        inside = np.zeros(len(self.union), bool)
        inside[known] = True
        shared = np.bincount(self.member[inside[self.place]], minlength=len(self.sets))
        linked = np.flatnonzero(100 * shared >= self.percent * (self.sizes + len(tokens) - shared))
        for i in linked.tolist():
            if self.ids[i] != doc:
                yield self.ids[i]
                if not every:
                    return


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each end of an edge (a, b) the smallest node that it is connected with."""
    edges = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("to"))
        jump = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        least = stored(least.join(jump, "to", "left").select("node", F.col("component").alias("was"), F.least("to", "further").alias("component")))
        labels = least.select("node", "component")
        if least.filter("was <> component").isEmpty():
            return labels


def near_copy_groups(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and set_id (the same
    for equal sets, null for the empty one)."""
    docs = _plain(docs, text)
    sizes = stored(set_sizes(docs, k))
    # stored, so that Spark can split a hot set's rows in the join
    known = sizes.filter("n > 0 AND doc_id IS NOT NULL")
    # Spark broadcasts it, or not, by its size
    several = stored(known.groupBy("doc_id").agg((F.min("a") != F.max("a")).alias("several")).filter("several"))
    reps = known.groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc_id")).join(several, "doc_id", "left")
    reps = stored(reps.select("doc_id", "n", "a", "b", F.when(F.col("several"), F.col("a")).otherwise(F.col("doc_id")).alias("node")))
    marked = docs.join(several, "doc_id", "left").select("doc_id", "text", F.coalesce("several", F.lit(False)).alias("several"))
    groups = components(near_copy_links(marked, reps, k, percent))
    placed = reps.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = stored(placed.join(first, "component").select("n", "a", "b", "component_id"))
    rows = sizes.join(found, ["n", "a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(F.col("n") > 0, F.col("a")).alias("set_id"))


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Of each group the rows of the smallest doc_id; rows without doc_id and texts without words stay. All columns stay."""
    name, words = free_name(docs, "_set"), free_name(docs, "_words")
    schema = schema_with(docs, name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(words)
            nodes = [_set_sums(*shingle_sets(data, offsets, k), 1) for _, data, offsets in slices(texts)]
            nodes = np.concatenate([np.empty(0, np.int64), *nodes])
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([words]).columns, pa.array(nodes)], schema.names)

    rows = docs.withColumn(words, F.col(text).cast("string")).mapInArrow(run, schema)
    groups = near_copy_groups(docs, k, percent, text).filter("component_id < doc_id")
    gone = groups.select(F.col("doc_id").alias("gone_id"), F.col("set_id").alias("gone_set")).distinct()
    same = (rows["doc_id"] == gone["gone_id"]) & (rows[name] == gone["gone_set"])
    return rows.join(gone, same, "left_anti").drop(name)


def near_copy_links(docs: DataFrame, reps: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Links (a, b) of nodes that connect all that are connected. ``docs``: doc_id, text and ``several``; ``reps``: node, n and a
    document of each different set."""
    rows = shared_keys(prefix_shingles(docs, frequent_shingles(docs, k), k, percent), "token")
    # a set that several chunks hold; no shuffle, as the rows of a shingle are together
    rows = rows.select("token", F.col("doc_id").alias("node")).distinct()
    share = F.count("*").over(Window.partitionBy("node")) / (F.col("n") - _part(F.col("n"), percent) + 1)
    rows = stored(rows.join(reps.select("node", "n"), "node").select("token", "node", F.col("n").cast("int").alias("n"), F.floor(1000 * share).cast("int").alias("share")))
    texts = packed_sets(docs, k)

    leads = rows.groupBy("token").agg(F.max(F.struct("share", F.bitwise_not("node").alias("lead"))).alias("lead"), F.count("*").alias("many")).filter("many > 1")
    led = rows.join(leads.select("token", F.bitwise_not("lead.lead").alias("grp")), "token").filter("grp <> node")
    led = led.groupBy("node", "n", "grp").agg(F.count("*").alias("shared"))
    best = led.groupBy("node", "n").agg(F.max(F.struct("shared", F.bitwise_not("grp").alias("grp"))).alias("best"))
    # a lead with too few shingles in common can't be linked but to a set of another size; step 4 finds those
    near = F.col("best.shared") >= least_shared(F.col("n"), F.col("n"), percent)
    stars = stored(best.filter(near).select(F.bitwise_not("best.grp").alias("grp"), "node"))
    linked = stored(compared(stars, stars.select("grp", F.col("grp").alias("node")).distinct(), reps, texts, k, percent, True))
    groups = components(linked)

    members = rows.join(groups, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("grp"))
    members = stored(members)
    of_group = members.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    matrix = members.select("token", "grp").distinct()
    query = members.select("token", "node", "n", F.col("grp").alias("own"))
    # a pair of groups is opened from its later one
    counted = query.join(matrix, "token").filter(F.col("grp") < F.col("own")).groupBy("node", "n", "grp").agg(F.count("*").alias("shared"))
    opened = counted.join(of_group, "grp").filter(may_link(F.col("n"), F.col("least"), F.col("most"), F.col("shared"), percent))
    opened = stored(opened.select("grp", "node"))
    inside = members.select("grp", "node").distinct().join(opened.select("grp").distinct(), "grp", "left_semi")
    return linked.union(compared(inside, opened, reps, texts, k, percent, False))
