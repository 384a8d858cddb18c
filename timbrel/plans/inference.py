"""Choosing messages for a model, a lexical scorer that needs no weights, and leader clusters of vectors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.constants import EVIDENCE


def messages(found: Column, each: int = 8, most: int = 30, width: int = 256) -> Column:
    """Distinct cut messages of the first samples of each signal; ``found``: the arrays of samples of a log's signals, in
    final order."""
    heads = F.transform(found, lambda samples: F.transform(F.slice(samples, 1, each), lambda s: F.trim(F.substring(s["message"], 1, width))))
    return F.slice(F.array_distinct(F.filter(F.flatten(heads), lambda m: m != "")), 1, most)


def lexical(chosen: Column, threshold: float = 0.35) -> Column:
    """Struct (category, confidence) of an array of messages: shares of evidence words, averaged over messages; below the
    threshold unknown."""
    names = list(EVIDENCE)

    def shares(message: Column) -> Column:
        hits = F.array(*[F.when(message.rlike(r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b"), 1.0).otherwise(0.0) for words in EVIDENCE.values()])
        return F.transform(F.array(hits), lambda h: F.transform(h, lambda x: x / F.greatest(F.lit(1.0), F.aggregate(h, F.lit(0.0), lambda s, y: s + y))))[0]

    none = F.array(*[F.lit(0.0) for _ in names])
    total = F.aggregate(F.transform(chosen, shares), none, lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    mean = F.transform(total, lambda x: x / F.greatest(F.lit(1), F.size(chosen)))
    best = F.array_max(F.zip_with(mean, F.array(*map(F.lit, names)), lambda c, n: F.struct(c.alias("confidence"), n.alias("category"))))
    return F.transform(F.array(best), lambda b: F.struct(F.when(b["confidence"] >= threshold, b["category"]).otherwise("unknown").alias("category"), F.when(b["confidence"] >= threshold, b["confidence"]).otherwise(0.0).alias("confidence")))[0]


def follow(vectors: np.ndarray, least: float) -> list[int]:
    """For each vector the first earlier leader that is similar enough, or itself, a leader then."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    heads: list[int] = []
    out = []
    for i in range(len(unit)):
        near = unit[heads] @ unit[i] >= least if heads else np.zeros(0, bool)
        if not near.any():
            heads.append(i)
        out.append(heads[int(near.argmax())] if near.any() else i)
    return out


def leaders(vectors: DataFrame, least: float = 0.75) -> DataFrame:
    """(log_path, n, leader): each vector joins the first leader that is similar enough, in order of ``n``; a log's
    distinct messages are few. Input: (log_path, n, vector)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", kind="stable")
        n = group["n"].to_numpy()
        return pd.DataFrame({"log_path": group["log_path"], "n": n, "leader": n[follow(np.stack(group["vector"].to_numpy()).astype(float), least)]})

    return vectors.groupBy("log_path").applyInPandas(run, "log_path string, n bigint, leader bigint")


def similar_pairs(vectors: DataFrame, least: float = 0.75) -> DataFrame:
    """(log_path, a, b, cosine) of similar vectors within a log. Input: (log_path, n, vector)."""
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    a = vectors.select("log_path", F.col("n").alias("a"), F.col("vector").alias("va"))
    b = vectors.select("log_path", F.col("n").alias("b"), F.col("vector").alias("vb"))
    joined = a.join(b, "log_path").filter("a < b").select("log_path", "a", "b", (dot / (norm("va") * norm("vb"))).alias("cosine"))
    return joined.filter(F.col("cosine") >= least)
