"""Toxicity: Levenshtein automata over a lexicon trie, with context windows that tell quotation from abuse.

The lexicon is a base list and what the labelled sample adds to it: words, and stems with many endings, that occur in
toxic documents too often for chance and hardly in others. All terms form one trie; the positions (trie node, edits so
far) that the Levenshtein automata allow are determinised into one table, so that every word of every text is run
through all automata at once, a byte at a time, in numpy. A hit's window of words is then read: quotation marks around it
and words of reporting speak for quotation, direct address, shouting and further hits for abuse. A document's score is
one minus the product of its terms' doubts; a term's probability comes from the sample, apart for exact and misspelt.

Only the lexicon is fitted on a bounded sample (SAMPLE documents of each class, whole texts of SAMPLE_BYTES together at
most, none from the held-out fold); every byte of every text is read.

Cases: null and empty texts, and texts without a hit, have the share of toxic documents among those without a hit;
without labels the base list and fixed probabilities hold; an empty table gives an empty result; other columns are
ignored. Case is folded for A-Z; edits count bytes of UTF-8.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm.common import byte_texts, documents, small_batches, steps
from timbrel.llm.labelled import held_out, sample
from timbrel.llm.shingles import mix

SAMPLE = 2000
#: Bytes of the sample's texts of one class together; the sample ends where they are used up.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.5
WINDOW = 6
#: Terms of so many letters are found misspelt only where that is no word of the sample's documents that aren't toxic.
SHORT = 4

BASE = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass loser losers trash garbage scum scumbag "
    "clown worthless pathetic disgusting vermin filth filthy subhuman degenerate bastard bastards jerk retard retarded cretin lowlife "
    "arschloch dummkopf abschaum vollidiot schwachkopf connard abruti salaud imbécile ordure estúpido imbécil basura escoria"
).split()

REPORTING = set("said says say saying called calls wrote writes written quoted quotes quote word words term terms phrase according sagte nannte schrieb wort dit disait écrit mot dijo llamó escribió palabra".split())
ADDRESS = set("you your yours you're u ur du dein deine ihr tu toi ton vous votre tú tu usted eres".split())
_OPEN, _CLOSE = "\"“«„‘'", "\"”»“’'"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Format characters that stand between words: zero width space, direction marks, word joiner, byte order mark.
_BETWEEN = {0x200B, 0x200E, 0x200F, 0x2060, 0xFEFF}


def _inside(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: letters and digits, but no signs or spaces, outside ASCII too."""
    inside = _LETTER[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return inside
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[lead + i] for i in range(4))
    size = 2 + (a >= 0xE0) + (a >= 0xF0)
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    code = np.choose(size - 2, [two, three, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63])
    known, at = np.unique(np.minimum(code, 0x10FFFF), return_inverse=True)
    sign = np.array([x in _BETWEEN or (kind := unicodedata.category(chr(x)))[0] in "PSZ" or kind == "Cc" for x in known.tolist()])[at]
    for i in range(4):
        out = lead[sign & (size > i)] + i
        inside[out[out < len(data)]] = False
    return inside


def edits(term: str) -> int:
    """Edits that a word may be away from a term; short words have too many neighbours."""
    return 0 if len(term) < SHORT else 1 if len(term) < 9 else 2


def stem_edits(stem: str) -> int:
    return 0 if len(stem) < 8 else 1


@dataclass
class Automaton:
    """The determinised automata: state 0 is dead, state 1 the start."""

    table: np.ndarray
    kinds: np.ndarray  # of bytes
    accept: np.ndarray  # 1 + 2 * term + (1 if misspelt), or 0
    terms: list[str] = field(default_factory=list)


def build(terms: list[str], stems: list[str]) -> Automaton:
    """The automaton of ``terms`` (whole words) and ``stems`` (words that begin so)."""
    names = [*terms, *stems]
    limit = [*map(edits, terms), *map(stem_edits, stems)]
    child: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    room = [0]  # the most edits that a term below the node allows
    for i, name in enumerate(names):
        node = 0
        room[0] = max(room[0], limit[i])
        for byte in name.encode():
            if byte not in child[node]:
                child[node][byte] = len(child)
                child.append({})
                ends.append([])
                room.append(0)
            node = child[node][byte]
            room[node] = max(room[node], limit[i])
        ends[node].append(i)
    stem = set(range(len(terms), len(names)))
    letters = sorted({b for c in child for b in c})
    kinds = np.zeros(256, np.int16)
    kinds[letters] = np.arange(1, len(letters) + 1)

    def close(found: dict) -> frozenset:
        """Adds what a left-out letter reaches, and drops a position that another has with fewer edits."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if node >= 0 and found.get(node, 99) == e and e < room[node]:
                for to in child[node].values():
                    if e + 1 <= room[to] and found.get(to, 99) > e + 1:
                        found[to] = e + 1
                        todo.append((to, e + 1))
        for node, e in list(found.items()):
            for i in ends[node] if node >= 0 else ():
                if i in stem and e <= limit[i]:
                    found[-1 - i] = min(e, found.get(-1 - i, 99))
        return frozenset(found.items())

    def after(state: frozenset, byte: int) -> frozenset:
        found: dict[int, int] = {}
        for node, e in state:
            if node < 0:
                found[node] = min(e, found.get(node, 99))
                continue
            if (to := child[node].get(byte)) is not None:
                found[to] = min(e, found.get(to, 99))
            if e < room[node]:
                found[node] = min(e + 1, found.get(node, 99))
                for to in child[node].values():
                    if e + 1 <= room[to]:
                        found[to] = min(e + 1, found.get(to, 99))
        return close(found)

    start = close({0: 0})
    number = {frozenset(): 0, start: 1}
    rows, todo = {0: [0] * (len(letters) + 1)}, [start]
    while todo:
        state = todo.pop()
        row = []
        for byte in (-1, *letters):
            to = after(state, byte)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows[number[state]] = row
    accept = np.zeros(len(number), np.int32)
    for state, n in number.items():
        hits = [(e, i) for node, e in state for i in (ends[node] if node >= 0 else [-1 - node]) if e <= limit[i] and (node < 0 or i not in stem)]
        if hits:
            e, i = min(hits)
            accept[n] = 1 + 2 * i + (e > 0)
    return Automaton(np.array([rows[i] for i in range(len(number))], np.int32), kinds, accept, names)


def hits(auto: Automaton, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, accept code) of each word that the automaton accepts, in order."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    inside = _inside(data)
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] |= inside[edge]
    stop[edge - 1] |= inside[edge - 1]
    at, to = np.flatnonzero(start), np.flatnonzero(stop) + 1
    kinds = auto.kinds[_LOWER][data]
    state = np.ones(len(at), np.int32)
    code = np.zeros(len(at), np.int32)
    live, where = np.arange(len(at)), at.copy()
    while len(live):
        state = auto.table[state, kinds[where]]
        where += 1
        over = where == to[live]
        code[live[over]] = auto.accept[state[over]]
        go = (state > 0) & ~over
        live, where, state = live[go], where[go], state[go]
    found = np.flatnonzero(code)
    return np.searchsorted(ends, at[found], "right") - 1, at[found], to[found], code[found]


def _short(auto: Automaton, code: int) -> bool:
    """A term of few letters, misspelt."""
    return code % 2 == 0 and len(auto.terms[(code - 1) // 2]) == SHORT


def counted(auto: Automaton, common: set[bytes] | None, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The hits but for misspelt short terms that are ``common`` words; without a sample (None), but for all of those."""
    found = zip(*(x.tolist() for x in hits(auto, data, ends)), strict=True)
    return [h for h in found if not _short(auto, h[3]) or (common is not None and data[h[1] : h[2]].tobytes().lower() not in common)]


def quotation(before: str, term: str, after: str, near: int) -> float:
    """How much of a hit counts as abuse, from its window; ``near``: further hits in it."""
    behind, ahead = before.split()[-WINDOW:], after.split()[:WINDOW]
    left, right = " ".join(behind), " ".join(ahead)
    opened = max((left.count(o) - left.count(c) if o != c else left.count(o) % 2 for o, c in zip(_OPEN, _CLOSE, strict=True) if o != "'"), default=0) > 0
    quoted = (before[-1:] != "" and before[-1:] in _OPEN) or (opened and any(c in right for c in _CLOSE if c != "'"))
    words = [w.strip(".,;:!?()\"'“”«»").lower() for w in (*behind, *ahead)]
    calm = 1.0 * quoted + 0.5 * sum(w in REPORTING for w in words)
    hot = 0.5 * any(w in ADDRESS for w in words) + 0.5 * (right[:1] == "!") + 0.5 * (len(term) > 3 and term.isupper()) + 0.25 * min(near, 2)
    return 0.25 if calm >= 1 and calm > hot else 1.0


@dataclass
class Model:
    auto: Automaton
    chance: dict[int, float]
    rest: float
    common: set[bytes] | None = None


def _apart(rows: list[tuple[bytes, int]]) -> list[tuple[set[str], int]]:
    """The words of each text, without texts that share half of eight least word hashes with an earlier one: what near
    copies repeat is no evidence."""
    met: dict[tuple[int, int], list[int]] = defaultdict(list)
    out: list[tuple[set[str], int]] = []
    for text, y in rows:
        found = set(re.findall(r"[^\W\d_]{4,24}", text.decode(errors="replace").lower()))
        if not found:
            continue
        codes = np.array([zlib.crc32(w.encode()) for w in found], np.uint64)
        least = [int(mix(codes + np.uint64(i << 40)).min()) for i in range(8)]
        shared = Counter(d for key in enumerate(least) for d in met[key])
        if max(shared.values(), default=0) >= 4:
            continue
        for key in enumerate(least):
            met[key].append(len(out))
        out.append((found, y))
    return out


def _learn(rows: list[tuple[bytes, int]]) -> tuple[list[str], list[str]]:
    """Words and stems that toxic documents have too often for chance."""
    docs = _apart(rows)
    word, stem, ending = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(set)
    for found, y in docs:
        for w in found:
            word[w][y] += 1
        for s in {w[:n] for w in found for n in range(4, min(10, len(w)) + 1)}:
            stem[s][y] += 1
    sizes = Counter(y for _, y in docs)
    odds = sizes[1] / max(1, sum(sizes.values()))
    least = np.log(max(1, sum(v[1] > 1 for v in stem.values())) / 0.01) / -np.log(odds) if 0 < odds < 1 else 1e9
    strong = lambda v: v[1] >= least + 6 * v[0] and v[0] <= 0.02 * v[1]
    likely = {s for s in stem if strong(stem[s])}
    for found, y in docs:
        for w in found if y else ():
            for n in range(4, min(10, len(w)) + 1):
                if w[:n] in likely:
                    ending[w[:n]].add(w[n:])
    stems: list[str] = []
    for s in sorted(likely, key=lambda s: (len(s), s)):
        longer = [t for t in likely if len(t) == len(s) + 1 and t.startswith(s)]
        # A longer stem that has nearly all its documents says the same more exactly.
        if max((stem[t][1] for t in longer), default=0) < 0.9 * stem[s][1] and len(ending[s] - {""}) >= 5 and not any(s.startswith(x) for x in stems):
            stems.append(s)
    return [w for w in sorted(word) if strong(word[w]) and not any(w.startswith(s) for s in stems)], stems


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def fit(rows: list[tuple[bytes, int]], share: float, base: list[str] | None = None) -> Model:
    """The lexicon and its terms' probabilities, from labelled texts."""
    terms, stems = _learn(rows)
    auto = build(sorted({*(BASE if base is None else base), *terms}), stems)
    sizes = Counter(y for _, y in rows)
    weight = (1.0, 1.0) if min(sizes[0], sizes[1]) == 0 else ((1 - share) / sizes[0], share / sizes[1])
    count: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    bare = [0.0, 0.0]
    docs: dict[int, set[int]] = defaultdict(set)
    data, ends = _join([t for t, _ in rows])
    plain = [h for h in zip(*(x.tolist() for x in hits(auto, data, ends)), strict=True) if _short(auto, h[3]) and not rows[h[0]][1]]
    common = {data[at:to].tobytes().lower() for _, at, to, _ in plain} if rows else None
    for doc, _, _, code in counted(auto, common, data, ends):
        docs[doc].add(code)
    for i, (_, y) in enumerate(rows):
        if i not in docs:
            bare[y] += 1
        plain = any(c % 2 for c in docs[i])  # exact hits explain a document, misspelt ones beside them don't count
        for code in docs[i]:
            if code % 2 or not plain:
                count[code][y] += 1
    chance = {}
    for code in range(1, 2 * len(auto.terms) + 1):
        name = auto.terms[(code - 1) // 2]
        prior = 0.9 if code % 2 else 0.7 if len(name) >= 7 else 0.6
        # A term's shares are those of the labelled rows, not of the balanced sample.
        no, yes = count[code][0] * weight[0], count[code][1] * weight[1]
        seen = count[code][0] + count[code][1]
        chance[code] = (2 * prior + seen * (yes / (no + yes) if yes + no else 0)) / (2 + seen)
    no, yes = (bare[0] + 1) * weight[0], bare[1] * weight[1]
    return Model(auto, chance, min(0.4, yes / (no + yes)) if sizes else 0.05, common)


def score(model: Model, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts, with their numbers of hits and of hits that are quoted."""
    n = len(ends) - 1
    doubt = np.full(n, 1 - model.rest)
    found, quoted = np.zeros(n, np.int64), np.zeros(n, np.int64)
    kept = counted(model.auto, model.common, data, ends)
    doc, at, to, code = ([h[j] for h in kept] for j in range(4))
    raw = data.tobytes() if doc else b""
    for i, d in enumerate(doc):
        low, high = max(int(ends[d]), at[i] - 90), min(int(ends[d + 1]), to[i] + 90)
        near = sum(0 <= k < len(doc) and k != i and doc[k] == d and abs(at[k] - at[i]) < 60 for k in range(i - 2, i + 3))
        part = quotation(raw[low : at[i]].decode(errors="replace"), raw[at[i] : to[i]].decode(errors="replace"), raw[to[i] : high].decode(errors="replace"), near)
        found[d] += 1
        quoted[d] += part < 1
        doubt[d] *= 1 - part * min(model.chance[code[i]], 0.995)
    return 1 - doubt, found, quoted


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                value, found, quoted = score(model, *byte_texts(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), pa.array(value), pa.array(found), pa.array(quoted)], names=["doc_id", "score", "hits", "quoted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits, quoted) for each row of ``docs``, fitted on ``labels`` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    model = fit(*sample(docs, labels, "toxic", SAMPLE, SAMPLE_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_score(model), "doc_id bigint, score double, hits bigint, quoted bigint")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits", "quoted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
