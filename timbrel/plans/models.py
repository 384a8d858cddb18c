"""Models behind a summary's category: a classifier of messages and an embedding that groups them.

A model is given as a function that loads it, so that each Python worker loads it once, when it first needs it. A model that
can't be loaded leaves all categories unknown and all messages ungrouped; the analysis goes on without it.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.plans.inference import follow

#: From texts to a row of numbers for each: logits of the labels, or a vector.
Model = Callable[[list[str]], np.ndarray]

# How much of a message is read, in characters and tokens, and how many at a time.
CLASSIFIED, EMBEDDED, TOGETHER = (2000, 256), (1000, 128), 64


@lru_cache(maxsize=8)
def _loaded(load: Callable[[], Model]) -> Model | None:
    try:
        return load()
    except Exception as e:  # noqa: BLE001  whatever a model's files lack
        logging.getLogger("timbrel").warning("model not available: %s", e)
        return None


def classifier(load: Callable[[], Model], labels: list[str], threshold: float = 0.35) -> Callable[[Column], Column]:
    """A ``score`` for summaries: the softmax of each message's logits, averaged over a log's messages; the best label, or
    unknown below the threshold."""

    @F.pandas_udf("category string, confidence double")
    def score(chosen: pd.Series) -> pd.DataFrame:
        model, out = _loaded(load), []
        for texts in chosen:
            category, sure = "unknown", 0.0
            if model is not None and texts is not None and len(texts):
                logits = np.asarray(model(list(texts)), np.float64)
                shares = np.exp(logits - logits.max(axis=1, keepdims=True))
                mean = (shares / shares.sum(axis=1, keepdims=True)).mean(axis=0)
                if mean.max() >= threshold:
                    category, sure = labels[int(mean.argmax())], float(mean.max())
            out.append((category, sure))
        return pd.DataFrame(out, columns=["category", "confidence"])

    return score


def grouper(load: Callable[[], Model], least: float = 0.75) -> Callable[[Column], Column]:
    """From an array of messages to the place of each one's leader: the first earlier leader whose vector is similar."""

    @F.pandas_udf("array<int>")
    def group(chosen: pd.Series) -> pd.Series:
        model = _loaded(load)
        return pd.Series([list(range(len(texts))) if model is None or not len(texts) else follow(np.asarray(model(list(texts)), float), least) for texts in chosen])

    return group


def _session(folder: str, tokenizer: str, tokens: int):
    from onnxruntime import InferenceSession, SessionOptions
    from tokenizers import Tokenizer

    options = SessionOptions()
    options.inter_op_num_threads, options.intra_op_num_threads = 1, 1
    session = InferenceSession(str(Path(folder, "model.onnx")), sess_options=options, providers=["CPUExecutionProvider"])
    words = Tokenizer.from_file(tokenizer)
    words.enable_truncation(max_length=tokens)
    words.enable_padding(pad_id=0, pad_token="[PAD]")

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = words.encode_batch(texts)
        ids, mask = np.array([x.ids for x in found], np.int64), np.array([x.attention_mask for x in found], np.int64)
        return session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0], mask

    return run


def onnx_classifier(folder: str, tokenizer: str) -> Model:
    """The logits of ``model.onnx`` in a folder."""
    run = _session(folder, tokenizer, CLASSIFIED[1])
    return lambda texts: run([t[: CLASSIFIED[0]] for t in texts])[0]


def onnx_labels(folder: str) -> list[str]:
    """The labels of a classifier's ``config.json``, in order of its outputs."""
    named = json.loads(Path(folder, "config.json").read_text())["id2label"]
    return [named[k] for k in sorted(named, key=int)]


def onnx_embedding(folder: str, tokenizer: str) -> Model:
    """The mean of ``model.onnx``'s token vectors."""
    run = _session(folder, tokenizer, EMBEDDED[1])

    def vectors(texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), TOGETHER):
            hidden, mask = run([t[: EMBEDDED[0]] for t in texts[at : at + TOGETHER]])
            out.append((hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9))
        return np.concatenate(out)

    return vectors
