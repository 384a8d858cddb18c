"""Best-fit packing in bulk-synchronous steps.

Documents become token ids with an end id, and pieces of at most ``capacity`` ids. Pieces are range-sorted by length, and
so are the gaps of open sequences. Step after step, all pieces of the longest length left look for their successor among
the gaps (the smallest that holds them) at once; conflicts are resolved by rank (the r-th piece takes the r-th place), the
gaps are updated, and pieces without a gap open new sequences. That is best-fit decreasing, so few sequences are used.

Pieces of one length are exchangeable, so a sweep works on runs (length, count) and (gap, range of sequences): at most
``capacity`` lengths, whatever the number of documents. Runs are the only thing the driver holds; it returns, for each
length, ranges of ranks with a formula for their places. Ranks within a length and the places of all pieces are computed
by the executors, and a length that a third of all pieces have is ranked in many buckets.

``in_order``: the documents' row order counts (of a written table: its files' order, and rows within a file). Pieces of one
length take their places in it, and sequences are numbered by the place of their first, longest, piece's document. How
many sequences there are and how full they are stays as it is. The driver holds the names of the table's files.

Cases: null and empty text is one piece of the end id; a null id is packed like any other; repeated rows are packed each;
a document longer than ``capacity`` is cut into full pieces and a rest; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm.common import bucket_bits, documents, hash_bucket, materialize, ranked, small_batches, trimmed
from timbrel.llm.tokens import encoded, vocabulary

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: The column of a document's place in the row order: the number of its file or partition above ROW_BITS bits, then the row.
_ROW = "_row"
ROW_BITS = 33


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, all_ids, ends in encoded(batches, path, space=False):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i in range(part.num_rows):
                x = all_ids[ends[i] : ends[i + 1]]
                for n, at in enumerate(range(0, len(x), capacity)):
                    own = x[at : at + capacity]
                    doc.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int32))
            columns = [part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            more = [part.column(c).take(pa.array(doc, pa.int64())) for c in part.schema.names if c == _ROW]
            yield pa.record_batch(columns + more + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + [_ROW] * len(more) + ["ids"] * with_ids)

    return trimmed(run)


def _with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the column _ROW, which ascends in the row order."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:  # not the rows of files
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias(_ROW))
    names = sorted((r["_file"] for r in rows.select("_file").distinct().collect()), key=lambda f: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", f)])
    files = docs.sparkSession.createDataFrame(list(enumerate(names)), "_number long, _name string")
    return rows.join(F.broadcast(files), F.col("_file") == F.col("_name")).select("doc_id", "text", (F.shiftleft("_number", ROW_BITS) + F.col("_index")).alias(_ROW))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, in_order: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), with their ids and their document's place in the row order if wanted."""
    small_batches(docs.sparkSession)
    texts = _with_rows(docs) if in_order else docs
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[_ROW] * in_order)
    return texts.mapInArrow(_pieces(path, capacity, with_ids), _PIECES + f", {_ROW} bigint" * in_order + ", ids array<int>" * with_ids)


def places(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a sequence, first sequence, offset in it) from the number of pieces of
    each length: piece ``first + j`` goes to sequence ``first sequence + j div pieces``, behind ``j mod pieces`` others."""
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number), ascending
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, (length, 0, 0))
            if at == len(gaps):  # no successor: open what the rest needs
                more = -(-left // (capacity // length))
                insort(gaps, (capacity, opened, more))
                opened += more
                continue
            gap, first, number = gaps.pop(at)
            each = gap // length
            full = min(number, left // each)
            if full:
                out.append((length, rank, rank + full * each, each, first, capacity - gap))
                rank, left = rank + full * each, left - full * each
                if gap - each * length:
                    insort(gaps, (gap - each * length, first, full))
                first, number = first + full, number - full
            if number and left and left < each:
                out.append((length, rank, rank + left, left, first, capacity - gap))
                insort(gaps, (gap - left * length, first, 1)) if gap > left * length else None
                first, number, left = first + 1, number - 1, 0
            if number:
                insort(gaps, (gap, first, number))
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with doc_id, piece, length of 1 to ``capacity``) with sequence_id and offset. It is read more than
    once, so it should be a table."""
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = parts.sparkSession
    found = spark.createDataFrame(places(counts, capacity), "_length long, _low long, _high long, _each long, _first long, _offset long")
    if _ROW in parts.columns:
        order, bucket = [F.col(_ROW), F.col("piece")], _row_bucket(_ROW)
    else:
        order, bucket = [F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece")], hash_bucket(F.xxhash64("doc_id", "piece"), bucket_bits(sum(counts.values())))
    numbered = ranked(parts, ["length"], order, bucket, "_rank")
    # The places are at most a few for each of ``capacity`` lengths.
    put = numbered.join(F.broadcast(found), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    turn = F.col("_rank") - F.col("_low")
    return put.select(*parts.columns, (F.col("_first") + F.floor(turn / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + turn % F.col("_each") * F.col("length")).cast("long").alias("offset"))


def _row_bucket(row: str):
    return F.shiftright(row, 11)


def _by_first_piece(packed: DataFrame) -> DataFrame:
    """``packed`` (a table, with _ROW) with its sequences numbered by their first piece, in the row order."""
    first = packed.filter("offset = 0").select(F.col("sequence_id").alias("_sequence"), _ROW, "piece")
    numbers = ranked(first, [], [F.col(_ROW), F.col("piece")], _row_bucket(_ROW), "_number").select("_sequence", "_number")
    joined = packed.join(numbers, F.col("sequence_id") == F.col("_sequence"))
    return joined.select(*[F.col("_number").alias(c) if c == "sequence_id" else c for c in packed.columns if c != _ROW])


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of ``docs`` (doc_id, text)."""
    packed = pack(materialize(pieces(docs, path or vocabulary(VOCABULARY), capacity, in_order=in_order), "pieces"), capacity)
    return _by_first_piece(materialize(packed, "packed")) if in_order else packed


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
