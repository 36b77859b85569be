"""Texts compressed for shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 256


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, packed): the text compressed; null counts as empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            for row in range(0, len(batch), ROWS):
                part = batch.slice(row, ROWS)
                texts = [packer.compress(x) for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "packed"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(pack, "doc_id long, packed binary")


def unpacked_bytes(blobs: list[bytes]) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in blobs]


def unpacked(blobs: list[bytes]) -> pa.Array:
    return pa.array(unpacked_bytes(blobs), pa.large_binary()).cast(pa.large_string())
