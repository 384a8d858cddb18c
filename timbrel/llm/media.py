"""Media columns: texts stored losslessly as baseline JPEG, read back, and described by DC-only thumbnails.

A text's bytes, with zeros up to a positive multiple of 64, are the quantised coefficients of a grey image, one 8 x 8
block for each 64 bytes: a byte's place in a fixed order of bytes is a small whole number, negative or positive, which the
format keeps exactly. The image's blocks form a rectangle near a square; a comment marker has the number of bytes and of
blocks. Reading parses markers, Huffman-decodes the scan and gives dimensions, the payload and a luminance thumbnail made
of DC coefficients, whose hash is stored with the dimensions as the feature.

Media are written by Spark as a binary column into the shared folder and read from there.

Cases: null and empty text is one block of zeros; equal texts have equal files; null ids and repeated rows are stored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm import jpeg
from timbrel.llm.common import byte_texts, documents, materialize, small_batches, steps

#: Bytes in the order of their values 0, 1, -1, 2, -2, ...: common ones of prose first, then all others ascending.
COMMON = b" etaonirshdlucmgfpbvyw\xc3.,kqxjz\n\xa9TASIEHOCRDLWMN\xa8\xa1\xb3\xbc\xb6\xa4'-\"!?0123456789"
_ORDER = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)])
_RANK = np.argsort(_ORDER)
_VALUE = np.where(_RANK % 2 == 1, (_RANK + 1) // 2, -(_RANK // 2)).astype(np.int32)
_BYTE = np.zeros(512, np.uint8)
_BYTE[_VALUE + 256] = np.arange(256)

_NOTE = struct.Struct(">4sQQ")


def encode_texts(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """One file for each text."""
    size = np.diff(ends)
    blocks = np.maximum(1, -(-size // 64))
    at = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * 64, np.uint8)
    for a, b, to in zip(ends[:-1].tolist(), ends[1:].tolist(), (at * 64).tolist(), strict=True):
        padded[to : to + b - a] = data[a:b]
    notes = [_NOTE.pack(b"TEXT", n, k) for n, k in zip(size.tolist(), blocks.tolist(), strict=True)]
    return jpeg.write(_VALUE[padded].reshape(-1, 64), blocks, notes)


def payload(image: jpeg.Image) -> tuple[int, bytes]:
    """(number of bytes, padded bytes) that a file of ``encode_texts`` stores."""
    kind, size, blocks = _NOTE.unpack(image.comments[0])
    if kind != b"TEXT":
        raise ValueError("the image stores no text")
    return size, _BYTE[image.coefficients[0].reshape(-1, 64)[:blocks].reshape(-1) + 256].tobytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text", 1 << 19):
            yield pa.record_batch([part.column("doc_id"), pa.array(encode_texts(*byte_texts(part.column("text"))), pa.binary())], names=["doc_id", "media"])


def store(docs: DataFrame) -> DataFrame:
    """The table (doc_id, media) of ``docs`` (doc_id, text), in the shared folder."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(texts.mapInArrow(_store, "doc_id bigint, media binary"), "media")


def _describe(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "media", 1 << 19):
                files = part.column("media").to_pylist()
                rows = []
                for blob, image in zip(files, jpeg.read(files), strict=True):
                    size, data = payload(image)
                    feature = f"{image.width}x{image.height}:{jpeg.thumbnail_hash(image.thumbnail()):016x}"
                    rows.append((size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, data))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())[: 7 + with_text])]
                yield pa.record_batch([part.column("doc_id"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload"][: 8 + with_text])

    return run


def describe(media: DataFrame, with_payload: bool = False) -> DataFrame:
    """Dimensions, hashes and thumbnails of the stored media (doc_id, media), and the payload if wanted."""
    kind = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "media").mapInArrow(_describe(with_payload), kind + ", payload binary" * with_payload)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(documents(spark, sf_dir)))
