"""Token ids of texts by a public tokenizer of the tokenizers library.

Both vocabularies split a text into pieces before any merge. Where a piece is sure to end, a text is cut into chunks: at
ASCII white space (of a run before a word byte BPE has all but the last character as one piece, and a last space goes with
the word; word BPE drops white space), and between an ASCII letter or digit and the ASCII signs that end a word. So a
text's ids are those of its chunks in order. Chunks repeat, so each distinct one of a step is looked up once, and ones
seen again are remembered. Word BPE lowers letters: ASCII ones that nothing outside ASCII follows are lowered before.

New chunks that are one piece, letters and digits with a space before them, go through the vocabulary's merges many in one
text, with a sign that no chunk has between them; all other new chunks through the whole tokenizer. Texts with white space
outside ASCII are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, pairwise, repeat

import numpy as np
import pyarrow as pa

from timbrel.llm.common import byte_texts, steps

END = 0
#: Chunks that a worker remembers; of byte BPE, whose chunks have more forms, BYTE_FORMS times as many.
REMEMBERED = 600_000
BYTE_FORMS = 1.6
#: Bytes of text whose chunks are looked up together.
STEP = 2 << 20
#: Chunks in one text; the library takes less time for each in a short text.
JOINED = 128

#: Chunks that are one piece, in byte BPE and in word BPE; none of the letters is composed anew.
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_PIECE = {True: re.compile(rb" ?(?:" + _LETTERS + rb"|[0-9]+)"), False: re.compile(_LETTERS)}
_BETWEEN = "."
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that byte-level vocabularies write bytes as: printable ones as themselves, the others from U+0100 on.
_WRITTEN = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN_BYTES)))}

_SIGN, _WORD = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII (U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000) begins."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    dash = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return lead[two | dash | three]


def _cuts(data: np.ndarray, ends: np.ndarray, space: bool) -> tuple[np.ndarray, np.ndarray]:
    """The chunks' first bytes and ends; all bytes belong to one, white space only with ``space``."""
    inside = ~_SPACE[data]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] |= inside[edge]
    last[:-1] &= ~inside[1:]
    last[edge - 1] |= inside[edge - 1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    # Signs that end a word, behind a letter or digit.
    at = stop.copy()
    more = np.flatnonzero(_SIGN[data[at - 1]]) if len(at) else at
    while len(more):
        at[more] -= 1
        more = more[at[more] > begin[more]]
        more = more[_SIGN[data[at[more] - 1]]]
    tail = at[(at < stop) & (at > begin)]
    tail = tail[_WORD[data[tail - 1]]]
    cut = np.zeros(len(data) + 1, bool)
    cut[begin], cut[stop], cut[tail] = True, True, True
    if not space:
        cuts = np.flatnonzero(cut)
        word = inside[cuts[:-1]] if len(cuts) else cuts
        return cuts[:-1][word], cuts[1:][word]
    behind = begin[begin > 0]
    behind = behind[~inside[behind - 1]]
    start = np.zeros(len(data) + 1, bool)
    start[ends] = True
    behind = behind[~start[behind]]
    cut[behind - 1] = True
    cut[behind] = data[behind - 1] != 32
    cut |= start
    cuts = np.flatnonzero(cut)
    return cuts[:-1], cuts[1:]


class Encoder:
    """``space``: white space counts; else it is no part of any chunk, and letters are lowered."""

    def __init__(self, path: str, space: bool):
        from tokenizers import normalizers, pre_tokenizers

        self.tokenizer, self.space = load(path), space
        self.most = int(REMEMBERED * (BYTE_FORMS if space else 1))
        self.merges = load(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Split(_BETWEEN, "isolated")
        (self.between,) = self.merges.encode(_BETWEEN, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        """Keeps the chunks that were seen again, the most frequent half at most."""
        often = self.seen if hasattr(self, "seen") else np.zeros(0, np.int64)
        half = self.most // 2
        least = int(np.partition(often, -half)[-half]) if len(often) > half else 1
        again = often > max(1, least)
        if not again.any():
            self.number: dict[bytes, int] = {}
            self.at, self.ids, self.seen = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
            return
        place = np.cumsum(again) - 1
        self.number = {c: int(place[i]) for c, i in self.number.items() if again[i]}
        size = np.diff(self.at)
        self.ids = self.ids[np.repeat(again, size)]
        self.at = np.concatenate([[0], np.cumsum(size[again])])
        self.seen = np.ones(len(self.at) - 1, np.int64)

    def _direct(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([c.decode(errors="replace") for c in chunks], add_special_tokens=False)]
        at = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=at[1:])
        return np.fromiter(chain.from_iterable(found), np.uint32, int(at[-1])), at

    def _merged(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _direct, of chunks that are one piece."""
        texts = []
        for i in range(0, len(chunks), JOINED):
            text = _BETWEEN.encode().join([*chunks[i : i + JOINED], b""])
            written = (text if self.space else text.decode().lower().encode()).decode("latin-1").replace(" ", _WRITTEN[32])
            if not text.isascii():
                for byte in (*range(128, 161), 173):
                    written = written.replace(chr(byte), _WRITTEN[byte])
            texts.append(written)
        found = [x.ids for x in self.merges.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        ends = np.flatnonzero(ids == self.between)
        if len(ends) != len(chunks):
            raise ValueError("the vocabulary joins pieces")
        return ids[ids != self.between], np.append(0, ends - np.arange(len(ends)))

    def _numbers(self, chunks: list[bytes]) -> np.ndarray:
        """The place of each distinct chunk among the remembered ones."""
        if len(self.number) + len(chunks) > self.most:
            self._forget()
        numbers = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            new = [chunks[i] for i in unknown.tolist()]
            one = _PIECE[self.space].fullmatch
            fits = [one(c) is not None for c in new]
            plain, other = list(compress(new, fits)), [c for c, fit in zip(new, fits, strict=True) if not fit]
            for some, encode in ((plain, self._merged), (other, self._direct)):
                if some:
                    ids, at = encode(some)
                    self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
                    self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
                    self.ids = np.concatenate([self.ids, ids])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
            numbers[unknown] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        self.seen[numbers] += 1
        return numbers

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by the end id, and the n + 1 offsets."""
        n = len(ends) - 1
        texts = data.tobytes()
        whole = np.unique(np.searchsorted(ends, _wide_space(data), "right") - 1)
        low, high = _cuts(data, ends, self.space)
        at, held = np.append(low, len(data)), data
        if not self.space:
            # Without the white space the chunks are one buffer again.
            at = np.zeros(len(low) + 1, np.int64)
            np.cumsum(high - low, out=at[1:])
            held = _LOWER[data]
            before = np.flatnonzero(data[1:] >= 128)
            held[before] = data[before]
            held = held[~_SPACE[data]]
        keys = pa.Array.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(held))])
        chunk_at = np.searchsorted(low, ends)
        chunk_at[-1] = len(low)
        doc = np.repeat(np.arange(n), np.diff(chunk_at))
        if len(low):
            coded = keys.dictionary_encode()
            _, offsets, known = coded.dictionary.buffers()
            known = known.to_pybytes()
            at = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1].tolist()
            number = self._numbers([known[a:b] for a, b in pairwise(at)])[coded.indices.to_numpy()]
        else:
            number = np.zeros(0, np.int64)
        from_id = self.at[number]
        size = self.at[number + 1] - from_id
        direct, direct_at = (self._direct([texts[ends[d] : ends[d + 1]] for d in whole]) if len(whole) else (None, np.zeros(1, np.int64)))
        if len(whole):
            size[np.isin(doc, whole)] = 0
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        count = np.diff(total[chunk_at])
        count[whole] = np.diff(direct_at)
        out_at = np.zeros(n + 1, np.int64)
        np.cumsum(count + 1, out=out_at[1:])
        out = np.full(int(out_at[-1]), END, np.uint32)
        # Ids follow each other but for the end ids and the texts encoded whole.
        own = np.ones(len(out), bool)
        own[out_at[1:] - 1] = False
        for i, d in enumerate(whole.tolist()):
            own[out_at[d] : out_at[d + 1]] = False
            out[out_at[d] : out_at[d + 1] - 1] = direct[direct_at[i] : direct_at[i + 1]]
        out[own] = self.ids[np.arange(int(total[-1])) + np.repeat(from_id - total[:-1], size)]
        return out, out_at


#: One for each vocabulary in a worker process, so that its next tasks know the chunks of the earlier ones.
_encoder = lru_cache(maxsize=2)(Encoder)


def encoded(batches: Iterator[pa.RecordBatch], path: str, space: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the texts' ids and their offsets; null text is empty."""
    encoder = _encoder(path, space)
    for batch in batches:
        for part in steps(batch, "text", STEP):
            yield part, *encoder.encode(*byte_texts(part.column("text")))
