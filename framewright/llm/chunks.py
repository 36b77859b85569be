"""Keys gathered by chunk before a shuffle: a hot key has one row for each chunk of a task, not one for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gathered(keys: np.ndarray, docs: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """A row for each key: its only document, or the least one and an array of all. Rows of one document stand together."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new].astype(np.int64), docs[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    one = first[sizes == 1]
    one = one[np.argsort(docs[one], kind="stable")]
    none = pa.nulls(len(one), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(keys[one]), pa.array(docs[one]), none], [name, "doc", "docs"])
    more = np.repeat(sizes > 1, sizes)
    ends = np.concatenate([[0], np.cumsum(sizes[sizes > 1])]).astype(np.int32)
    many = first[sizes > 1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(docs[more]))
    yield pa.RecordBatch.from_arrays([pa.array(keys[many]), pa.array(docs[many]), lists], [name, "doc", "docs"])


class Chunks:
    """Rows of (key, document) held until there are ``limit`` words for a gathered batch."""

    def __init__(self, name: str, limit: int):
        self.name, self.limit, self.keys, self.docs, self.words = name, limit, [], [], 0

    def add(self, keys: np.ndarray, docs: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.docs.append(docs)
        self.words += words
        if self.words >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.keys and sum(map(len, self.keys)):
            yield from _gathered(np.concatenate(self.keys), np.concatenate(self.docs), self.name)
        self.keys, self.docs, self.words = [], [], 0


def shared_keys(rows: DataFrame, key: str) -> DataFrame:
    """(doc_id, key, lo) of the keys that two documents or more have; ``lo``: the smallest of them."""
    of_key = Window.partitionBy(key)
    last = F.coalesce(F.element_at("docs", -1), "doc")
    both = rows.select(key, "doc", "docs", F.min("doc").over(of_key).alias("lo"), F.max(last).over(of_key).alias("hi"))
    return both.filter("lo < hi").select(F.explode(F.coalesce("docs", F.array("doc"))).alias("doc_id"), key, "lo")
