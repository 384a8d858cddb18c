"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds consecutive documents, in ascending order of id, of about SHARD_TOKENS ids together. For each bit of an id,
from the highest, the file has a bit plane over the ids in the order that the bits above have put them in (zeros before
ones, otherwise kept), with the number of ones before every RANK_BITS bits. With rank and select on the planes a reader
gets the id at any place, counts an id in any range and finds its occurrences, without decoding the rest; a whole shard is
decoded plane by plane. Planes are compressed one by one.

Writing: documents are range-partitioned by id and sorted, encoded, and cut into shards within a partition; a worker holds
one shard at a time. Spark writes the files into the shared folder, one binary row each, so any file system that Spark can
write will do and a lost task writes its rows again.

Cases: null and empty text is the end id alone; a null id sorts first; rows with one id are kept each, in an order fixed
by their text; a document longer than a shard has a shard of its own; an empty table has no shards; other columns are
ignored. Ids are below 2**32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrel.llm.common import documents, materialize, small_batches
from timbrel.llm.tokens import encoded, vocabulary

SHARD_TOKENS = 1 << 20
RANK_BITS = 2048
VOCABULARY = "byte_bpe_50k.json"

_HEAD = struct.Struct("<4sIQQB")
_MAGIC = b"TWM1"


def _zip(data: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor(level=1).compress(data)
    return struct.pack("<QQ", len(data), len(packed)) + packed if len(packed) < len(data) else struct.pack("<QQ", len(data), 0) + data


def _unzip(blob: bytes, at: int) -> tuple[bytes, int]:
    import zstandard

    size, packed = struct.unpack_from("<QQ", blob, at)
    at += 16
    if not packed:
        return blob[at : at + size], at + size
    return zstandard.ZstdDecompressor().decompress(blob[at : at + packed], max_output_size=size), at + packed


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of documents with these ids, in order."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    out = [_HEAD.pack(_MAGIC, len(doc_ids), len(ids), RANK_BITS, width)]
    out.append(_zip(np.array([d is not None for d in doc_ids], np.uint8).tobytes()))
    out.append(_zip(np.array([d or 0 for d in doc_ids], "<i8").tobytes()))
    out.append(_zip(np.array(lengths, "<i8").tobytes()))
    now = ids.astype(np.uint16 if width <= 16 else np.uint32)
    for bit in range(width - 1, -1, -1):
        ones = (now & now.dtype.type(1 << bit)) != 0
        plane = np.packbits(ones, bitorder="little")
        padded = np.zeros(-(-len(plane) * 8 // RANK_BITS) * RANK_BITS // 8, np.uint8)
        padded[: len(plane)] = plane
        before = np.zeros(len(padded) * 8 // RANK_BITS + 1, "<u8")
        np.cumsum(np.bitwise_count(padded.view("<u8")).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint64), out=before[1:])
        out += [_zip(padded.tobytes()), _zip(before.tobytes())]
        now = np.concatenate([now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))])
    return b"".join(out)


class Shard:
    """A reader of one file."""

    def __init__(self, blob: bytes):
        magic, docs, self.size, self.rank_bits, self.width = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        known, at = _unzip(blob, at)
        ids, at = _unzip(blob, at)
        lengths, at = _unzip(blob, at)
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(ids, "<i8").tolist(), known, strict=True)]
        self.lengths = np.frombuffer(lengths, "<i8")
        self.planes: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(self.width):
            plane, at = _unzip(blob, at)
            before, at = _unzip(blob, at)
            self.planes.append((np.frombuffer(plane, np.uint8), np.frombuffer(before, "<u8").astype(np.int64)))

    def _ones(self, level: int, at: int) -> int:
        """rank: ones before place ``at`` of a plane."""
        plane, before = self.planes[level]
        block = at // self.rank_bits
        low = block * self.rank_bits // 8
        count = int(before[block]) + int(np.bitwise_count(plane[low : at // 8]).sum())
        return count + (int(plane[at // 8] & ((1 << at % 8) - 1)).bit_count() if at % 8 else 0)

    def _zeros(self, level: int) -> int:
        return self.size - int(self.planes[level][1][-1])

    def _select(self, level: int, one: int, nth: int) -> int:
        """select: the place of the nth one (or zero) of a plane, from 0."""
        plane, before = self.planes[level]
        count = before if one else np.arange(len(before)) * self.rank_bits - before
        block = int(np.searchsorted(count, nth, "right")) - 1
        low = block * self.rank_bits
        bits = np.unpackbits(plane[low // 8 : (low + self.rank_bits) // 8], bitorder="little")
        return low + int(np.flatnonzero(bits == one)[nth - int(count[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for level in range(self.width):
            one = int(self.planes[level][0][at // 8]) >> at % 8 & 1
            ones = self._ones(level, at)
            at = self._zeros(level) + ones if one else at - ones
            value = value << 1 | one
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self._zeros(level) + a, self._zeros(level) + b) if token >> (self.width - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs from place ``low`` up to ``high``."""
        if token < 0 or token >> self.width:
            return 0
        a, b = self._range(token, low, self.size if high is None else high)
        return b - a

    def occurrences(self, token: int, first: int = 0, most: int | None = None) -> list[int]:
        """The places of an id, ascending, from its occurrence ``first`` on."""
        if token < 0 or token >> self.width:
            return []
        low, high = self._range(token, 0, self.size)
        out = []
        for place in range(low + first, high if most is None else min(high, low + first + most)):
            for level in range(self.width - 1, -1, -1):
                one = token >> (self.width - 1 - level) & 1
                place = self._select(level, one, place - self._zeros(level) if one else place)
            out.append(place)
        return out

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        now = np.zeros(self.size, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.planes[level][0], bitorder="little", count=self.size).view(bool)
            zeros = self._zeros(level)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)] = now[:zeros]
            above[np.flatnonzero(ones)] = now[zeros:] | now.dtype.type(1 << (self.width - 1 - level))
            now = above
        return now


def _write(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal number, size
            blob = write_shard(docs, lengths, np.concatenate(held))
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "tokens", "file"])
            number, size = number + 1, 0
            docs.clear(), lengths.clear(), held.clear()
            return out

        for step, ids, ends in encoded(batches, path, space=True):
            names = step.column("doc_id").to_pylist()
            at = 0
            while at < len(names):
                # As many documents as the shard has room for, one at least.
                to = max(at + (not docs), int(np.searchsorted(ends, ends[at] + most - size, "right")) - 1)
                if to > at:
                    docs += names[at:to]
                    lengths += np.diff(ends[at : to + 1]).tolist()
                    held.append(ids[ends[at] : ends[to]].astype(np.uint32))
                    size += int(ends[to] - ends[at])
                if to < len(names):
                    yield shard()
                at = to
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of files (part, shard, tokens, file) of ``docs`` (doc_id, text), in the shared folder."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return materialize(ordered.mapInArrow(_write(path or vocabulary(VOCABULARY), shard_tokens), "part int, shard int, tokens bigint, file binary"), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.column("file")[i].as_py())
            ids = shard.decode().astype("<u4")
            ends = np.concatenate([[0], np.cumsum(shard.lengths)])
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = len(crc)
            yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array([batch.column("part")[i].as_py()] * n, pa.int32()), pa.array([batch.column("shard")[i].as_py()] * n, pa.int32()), pa.array(ends[:-1]), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=["doc_id", "part", "shard", "inside", "n_tokens", "ids_crc32"])


def read_shards(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the table of files. The files' sizes are added up
    within a partition's files, and then over partitions."""
    before = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = files.select(F.col("part").alias("_part"), F.col("shard").alias("_shard"), F.coalesce(before, F.lit(0)).alias("_in_part"))
    parts = files.groupBy(F.col("part").alias("p")).agg(F.sum("tokens").alias("n"))
    starts = parts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    small_batches(files.sparkSession)
    docs = files.select("part", "shard", "file").mapInArrow(_read, "doc_id bigint, part int, shard int, inside bigint, n_tokens bigint, ids_crc32 bigint")
    placed = docs.join(shards, (F.col("part") == F.col("_part")) & (F.col("shard") == F.col("_shard"))).join(starts, F.col("part") == F.col("p"))
    return placed.select("doc_id", (F.col("_from") + F.col("_in_part") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir)))
