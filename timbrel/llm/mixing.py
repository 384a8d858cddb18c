"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, form blocks of ``block_docs`` documents. With weight w, a share of the sum of
all weights, the i-th block of a source has the release time floor((i - 1) / w) and the deadline ceil(i / w); among released
blocks the one with the earliest deadline takes the next slot. Shares add up to one, so every block meets its window, and
as long as all sources last, each has had its share after any number of slots but for less than one block.

Windows are computed from the exact weights in whole numbers over the whole length of the mix: nothing is rounded, so no
error adds up. The driver goes once over the blocks (not the documents) and holds a number of 8 bytes for each; documents
meet their block's slot in a join. A source with a third of all rows is ranked in many hash buckets.

Given weights hold until the first source has no further block; documents scheduled up to there are ``selected``, later
ones are returned as not selected. Without given weights a source's weight is its number of documents to the power TEMPER,
which lets small sources come earlier; the schedule goes on over the sources that still have blocks, and all documents
are selected.

Cases: a null source is a source of its own; null ids and repeated rows are scheduled each; a source without a positive
weight has a null slot and is not selected; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrel.llm.common import BROADCAST_IDS, bucket_bits, documents, hash_bucket, materialize, ranked, small

#: Slots of the schedule that are handed to Spark at a time.
PERIOD = 4096
BLOCK_DOCS = 8
TEMPER = 0.7


def whole_weights(weights: dict) -> dict:
    """The weights in whole numbers of the same proportions, taken as the decimals that they are written as."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * unit) for s, x in exact.items()}
    common = gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def schedule(weights: dict, blocks: dict | None = None) -> dict:
    """For each source, the slots of its blocks (``blocks`` of each, else as many as its weight: one period), by earliest
    deadline among released blocks. ``weights`` are whole numbers. When no block is released, as sources have run out, the
    time goes on to the next release; slots are numbered without gaps."""
    names = sorted(weights, key=lambda s: (str(s), s is None))
    own = [weights[s] for s in names]
    left = [(blocks or weights)[s] for s in names]
    total, clock = sum(own), 0
    done = [array("q") for _ in names]
    waiting = [(0, i) for i, n in enumerate(left) if n]
    ready: list[tuple[int, int]] = []
    for slot in range(sum(left)):
        if not ready:
            clock = max(clock, waiting[0][0])
        while waiting and waiting[0][0] <= clock:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(done[i]) + 1) * total // own[i]), i))
        i = heapq.heappop(ready)[1]
        done[i].append(slot)
        clock += 1
        if len(done[i]) < left[i]:
            heapq.heappush(waiting, (len(done[i]) * total // own[i], i))
    return dict(zip(names, done, strict=True))


def _slots(spark: SparkSession, times: list[array], period: int) -> DataFrame:
    """The schedule as rows (_source, _turn, _time): a source's number, its block and the block's slot."""
    kinds = pa.schema([("_source", pa.int64()), ("_turn", pa.int64()), ("_time", pa.int64())])
    batches = []
    for i, found in enumerate(times):
        for at in range(0, len(found), period):
            part = np.array(found[at : at + period], np.int64)
            batches.append(pa.record_batch([np.full(len(part), i), np.arange(at, at + len(part)), part], schema=kinds))
    return spark.createDataFrame(pa.Table.from_batches(batches, kinds))


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """(doc_id, source, block, slot, place, selected) for each row of ``docs`` (doc_id, source). In order of slot and place
    within the block, the selected documents are the mix. The schedule is handed to Spark ``period`` slots at a time."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = {s: n**TEMPER for s, n in counts.items()} if weights is None else {s: w for s, w in weights.items() if w > 0 and s in counts}
    # With given weights, one block more than there is shows where the mix ends.
    blocks = {s: -(-counts[s] // block_docs) + (weights is not None) for s in given}
    times = schedule(whole_weights(given), blocks) if given else {}
    end = None if weights is None else min((found[-1] for found in times.values()), default=0)
    sizes = spark.createDataFrame([(s, i) for i, s in enumerate(times)], "_named string, _number long")
    table = _slots(spark, list(times.values()), period)
    if sum(blocks.values()) <= BROADCAST_IDS:
        table = F.broadcast(table)
    if len(times) <= BROADCAST_IDS:
        sizes = F.broadcast(sizes)
    code = F.xxhash64("doc_id")
    numbered = ranked(rows, ["source"], [code, F.col("doc_id")], hash_bucket(code, bucket_bits(sum(counts.values()))), "_rank")
    numbered = numbered.join(sizes, F.col("source").eqNullSafe(F.col("_named")), "left").withColumn("block", F.floor(F.col("_rank") / block_docs).cast("long"))
    timed = numbered.join(table, (F.col("_number") == F.col("_source")) & (F.col("block") == F.col("_turn")), "left")
    slot = F.col("_time")
    return timed.select("doc_id", "source", "block", slot.alias("slot"), (F.col("_rank") % block_docs).cast("int").alias("place"), (F.lit(True) if end is None else F.coalesce(slot < end, F.lit(False))).alias("selected"))


def take_mix(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix selects, with their columns, in its order: partitions are ranges of slots, each in
    order of slot and place. Rows with one id and source take their slots in order of their other columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_from"))
    found = materialize(mix(docs, weights), "mix")
    often = found.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "source")
    often = small(materialize(often, "often"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_from").eqNullSafe(F.col("source"))
    both = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & F.col("x.source").eqNullSafe(F.col("y.source"))
    once = found.alias("x").join(often.alias("y"), both, "left_anti")
    out = rows.join(F.broadcast(once) if found.count() <= BROADCAST_IDS else once, same).filter("selected").select("_row", "slot", "place")
    if not often.isEmpty():
        nth = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        mine = rows.join(often, same, "left_semi").withColumn("_nth", nth(("_id", "_from"), F.to_json("_row")))
        slots = found.alias("x").join(often.alias("y"), both, "left_semi").withColumn("nth", nth(("doc_id", "source"), F.col("slot"), F.col("place")))
        out = out.unionByName(mine.join(slots, same & (F.col("_nth") == F.col("nth"))).filter("selected").select("_row", "slot", "place"))
    return out.repartitionByRange("slot").sortWithinPartitions("slot", "place").select("_row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
