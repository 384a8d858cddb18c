"""Bounded samples of labelled documents for fitting; everything else reads all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.llm.common import materialize, release


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model is fitted on: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, budget: int) -> tuple[list[tuple[bytes, int]], float]:
    """At most ``rows`` labelled documents of each class, in a hashed order, whole texts of any length as far as ``budget``
    bytes last; and the share of class 1 among all labelled documents outside the held-out fold. A document that is
    labelled more than once, or whose id occurs more than once, has its greatest label and text."""
    known = labels.filter(F.col(label).cast("int").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    found = materialize(found.groupBy("doc_id", "y").agg(F.max("text").alias("text")), "sample")
    before = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = found.withColumn("_sum", F.sum(F.octet_length("text")).over(before)).filter(F.col("_sum") <= budget)
    out = [(r["text"].encode(), r["y"]) for r in fits.orderBy("y", F.xxhash64("doc_id"), "doc_id").select("y", "text").collect()]
    release(found)
    return out, share
