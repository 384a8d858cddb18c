"""Exact dedup by deterministic block naming.

Every text is cut into fixed-size blocks. Equal blocks meet by key, each partition sorts its blocks, and a block's name
is its rank among the distinct blocks of the partition, with the partition's number above it. Adjacent names of a
document are then paired and the pairs named in the same way, until one name is left. Blocks and pairs are compared as
whole keys, never by a digest, so (number of blocks, last name) is one collision-free identity of a text.

Block bytes are shuffled once; after that only names travel, half as many at each level. Blocks that repeat within an
Arrow batch collapse to one row with a list of members before the shuffle, so a text that a third of all rows share
crosses it about once a batch.

Cases: null text is empty; empty texts are equal to each other; a null id sorts below all others; of rows with the same
text and the same largest id exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrel.llm.common import byte_texts, documents, drop_shuffles, join_groups, materialize, small, small_batches, trimmed

BLOCK_BYTES = 4096

_MEMBER = "struct<rid:bigint,pos:int,blocks:int,doc_id:bigint,sha:binary>"


def _gather(keys: pa.Array, members: dict[str, pa.Array], kinds: pa.Schema) -> pa.RecordBatch:
    """One row for each distinct key of a batch, with the list of its members."""
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = pa.array(np.argsort(codes, kind="stable"))
    ends = np.zeros(len(coded.dictionary) + 1, np.int32)
    np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)), out=ends[1:])
    field = kinds.field("members").type.value_field
    rows = pa.StructArray.from_arrays([pc.take(members[f.name], order).cast(f.type) for f in field.type], fields=list(field.type))
    lists = pa.ListArray.from_arrays(pa.array(ends), rows).cast(kinds.field("members").type)
    return pa.record_batch([coded.dictionary.cast(pa.binary()), lists], schema=kinds)


_KINDS = pa.schema([("key", pa.binary()), ("members", pa.list_(pa.struct([("rid", pa.int64()), ("pos", pa.int32()), ("blocks", pa.int32()), ("doc_id", pa.int64()), ("sha", pa.binary())])))])


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = byte_texts(batch.column("text"))
            lengths = np.diff(ends)
            blocks = np.maximum(1, -(-lengths // size))
            doc = np.repeat(np.arange(len(blocks)), blocks)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = np.append(ends[:-1][doc] + pos * size, ends[-1])
            keys = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            take = pa.array(doc)
            first = pa.array(np.where(pos == 0, doc, -1), mask=pos != 0)
            members = {"rid": pc.take(batch.column("rid"), take), "doc_id": pc.take(batch.column("doc_id"), take), "pos": pa.array(pos), "blocks": pa.array(blocks[doc]), "sha": pc.take(batch.column("sha"), first)}
            yield _gather(keys, members, _KINDS)

    return trimmed(run)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of names as 16-byte keys."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pair = np.stack([batch.column(c).fill_null(-1).to_numpy() for c in ("left", "right")], axis=1).astype(">i8")
        keys = pa.Array.from_buffers(pa.large_binary(), len(pair), [None, pa.py_buffer(np.arange(0, 16 * len(pair) + 1, 16, dtype=np.int64)), pa.py_buffer(pair.tobytes())])
        yield _gather(keys, {c: batch.column(c) for c in ("rid", "pos", "blocks", "doc_id", "sha")}, _KINDS)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of sorted keys: the partition's number, then the rank of the key among the partition's distinct keys."""
    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        new = np.ones(len(keys), np.int64)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or keys[0].as_py() != last
        names = name + np.cumsum(new)
        name, last = int(names[-1]), keys[len(keys) - 1].as_py()
        yield pa.record_batch([pa.array(names), batch.column("members")], names=["name", "members"])


def _named(keyed: DataFrame) -> DataFrame:
    """Rows (rid, pos, blocks, doc_id, sha, name); equal keys have equal names, different keys different ones."""
    sorted_keys = keyed.repartition("key").sortWithinPartitions("key")
    names = sorted_keys.mapInArrow(trimmed(_rank), f"name bigint, members array<{_MEMBER}>")
    return names.select("name", F.inline("members"))


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, sha, blocks, name) for each row of ``docs`` (doc_id, text); equal (blocks, name) means equal text."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    level = materialize(_named(rows.mapInArrow(_cut(block_bytes), f"key binary, members array<{_MEMBER}>")), "names")
    kept = ["rid", "doc_id", "sha", "blocks", "name"]
    drop_shuffles(spark)
    done, width = level.filter("blocks = 1").select(kept), 1
    most = level.agg(F.max("blocks")).first()[0] or 1
    while width < most:
        # Of documents with more than ``width`` blocks; the others have their identity.
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = level.filter(F.col("blocks") > width).groupBy("rid", (F.col("pos") / 2).cast("int").alias("pos")).agg(left.alias("left"), right.alias("right"), F.max("blocks").alias("blocks"), F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"))
        level = materialize(_named(pairs.mapInArrow(_pack, f"key binary, members array<{_MEMBER}>")), "names")
        width *= 2
        done = done.unionByName(level.filter((F.col("blocks") > width // 2) & (F.col("blocks") <= width)).select(kept))
    return done


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    names = block_names(docs, block_bytes)
    groups = names.groupBy("blocks", "name").agg(F.max(F.struct("doc_id", (-F.col("rid")).alias("rid"))).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    out = join_groups(names, groups, ["blocks", "name"], "group_size")
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("rid") == -F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts one row, also where ids are null or repeated. A
    decision names a row by its id and its text's SHA-256; of rows that agree in both the first by their columns stays."""
    found = materialize(exact_dedup(docs.select("doc_id", "text"), block_bytes), "found")
    gone = found.filter("NOT doc_id <=> keep_id").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    gone = small(materialize(gone, "gone"))
    twins = found.filter("doc_id <=> keep_id").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("n"))
    twins = small(materialize(twins.filter("n > 1").select("_id", "_sha"), "twins"))
    mark = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), mark.alias("_mark"))
    named = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_sha"))
    kept = rows.join(gone, named, "left_anti")
    if twins.isEmpty():
        return kept.select("_row.*")
    first = F.row_number().over(Window.partitionBy("_doc", "_mark").orderBy(F.to_json("_row")))
    twice = kept.join(twins, named, "left_semi").withColumn("_nth", first).filter("_nth = 1")
    return kept.join(twins, named, "left_anti").select("_row").unionByName(twice.select("_row")).select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
