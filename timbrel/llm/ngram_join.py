"""N-gram Jaccard join with PartEnum signatures, and the classes its links form.

Sets of word shingles are put into bands of similar size. An instance j serves all pairs whose larger set is in band j: it
bounds their Hamming distance by k, deals the feature domain by hash into n1 first-level parts of n2 subparts, and names
each part's subsets of n2 - k2 subparts by what the set has there. At least slack + 1 parts differ in at most k2
subparts, so similar sets share a signature. A signature without any element would meet every other such set, so none is
given out; a set with more than ``slack`` parts that have one also takes part in a further deal with another seed, until a
deal suits it. Two similar sets that both need the further deal meet there; otherwise the earlier deal shows a shared
signature with elements. So no link is lost and no signature is common by emptiness.

However many documents share a signature, a task sends it once for each load of documents, with its holder or the number of
the set of its holders. Where a signature's loads meet, the least holder of all is the centre of a star; its members are
all other holders, and a set's members are looked up in its load's table. A star of bounded size is compared in one task,
all members with each other, and components are formed.

In a larger star all members are compared with the centre first. What is still apart needs proof: for sets x and y that
were compared with the same first set a, the Hamming distance of x and y is that of their differences from a (first stars
are dealt again around a central set), so with |Dx| + |Dy| above what similarity allows, x and y must share a certain
number of elements of Dx and Dy. At least one of them was not similar to a, hence that number is never less than one, and
about half of D where the other is not similar to a. Differences are put in order of their frequency beside a, rarest
first, and only pairs that meet in the prefixes which that number leaves are compared. Thousands of near-copies thus cost
one comparison each, and thousands of variants that are nearly similar cost their own edits, not all pairs. Sets are those
of 64-bit hashes of shingles; sets that are equal by a 128-bit digest of those count as one.

Then links are counted. Each is inside a class, so all pairs of a class's distinct sets are compared, a slice of them with
another in one task, and count with the copies on either side.

Cases: null and empty text and texts of white space have no shingles and no links; a text of fewer than ``k`` words has
one shingle; rows with one doc_id count as one document; a null doc_id has a null component and links nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrel.llm.common import BROADCAST_IDS, FEW, byte_texts, documents, drop_ids, drop_shuffles, gathered, local, materialize, release, rows_of, small, small_batches, steps, trimmed
from timbrel.llm.components import components, components_of_few
from timbrel.llm.shingles import mix, shingle_sets

#: Comparisons of one set that stay in one task.
FAN = 64
#: Distinct sets of a class that are compared with another slice's in one task.
SLICE = 256
#: Cells of a matrix of sets and elements.
CELLS = 1 << 21
#: Bits of a signature that are kept; more documents than those tell apart cost comparisons, no links.
NAME_BITS = 48
#: Signatures in one bucket, about; and in one load of a task, of less than 2**PLACE_BITS documents.
NAMES = 1 << 19
LOAD = 1 << 20
PLACE_BITS = 16
#: Members and shingles of a star whose pairs are all compared in one task.
STAR = 512
STAR_SHINGLES = 1 << 21
#: Bytes of text of one step.
STEP = 1 << 19
#: Digests that a task remembers, to give out the signatures of equal sets once.
SEEN = 200_000

K2, N2 = 1, 3
_SUBSETS = list(combinations(range(N2), N2 - K2))
_ODD = np.random.default_rng(7).integers(1, 2**62, N2, dtype=np.uint64) * 2 + 1
_DEALS = 64


def _bands(largest: int) -> np.ndarray:
    """Lower ends of the size bands."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * 13 // 10))
    return np.array(out)


def signatures(hashes: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets; hashes[at[i]:at[i+1]] are the distinct elements of set i. Sets that can be similar to
    equal sets only have none."""
    size = np.diff(at)
    bands = _bands(int(size.max(initial=1)) * den // num + 1)
    own = np.searchsorted(bands, size, "right") - 1
    last = np.searchsorted(bands, size * den // num, "right") - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for ahead in range(int((last - own).max(initial=0)) + 1):
        band = own + ahead
        k = 2 * (den - num) * (bands[np.minimum(band + 1, len(bands) - 1)] - 1) // (den + num)
        todo = np.flatnonzero((size > 0) & (band <= last) & (k > 0))
        for deal in range(_DEALS):
            if not len(todo):
                break
            todo = _deal(hashes, at, todo, band[todo], k[todo], deal, found)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _deal(hashes, at, rows, band, k, deal, found) -> np.ndarray:
    """Adds the signatures of ``rows`` in one deal; returns the rows that need a further one."""
    base = k // (K2 + 1) + 1
    slack = base // 8
    n1 = base + slack
    size = at[rows + 1] - at[rows]
    part_at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n1, out=part_at[1:])
    row = np.repeat(np.arange(len(rows)), size)
    first = np.cumsum(size) - size
    h = hashes[at[rows][row] + np.arange(len(row)) - first[row]]
    seed = mix((band.astype(np.uint64) << np.uint64(8)) + np.uint64(deal + 1))
    where = ((mix(h ^ seed[row]) >> np.uint64(32)) * (n1 * N2).astype(np.uint64)[row]) >> np.uint64(32)
    cell = part_at[:-1][row] * N2 + where.astype(np.int64)
    cells = int(part_at[-1]) * N2
    content = np.zeros(cells, np.uint64)
    np.add.at(content, cell, mix(h + np.uint64(0x9E3779B97F4A7C15)))
    filled = np.bincount(cell, minlength=cells).reshape(-1, N2) > 0
    content = content.reshape(-1, N2) * _ODD
    part_row = np.repeat(np.arange(len(rows)), n1)
    salt = seed[part_row] + (np.arange(len(part_row)) - part_at[:-1][part_row]).astype(np.uint64) * np.uint64(64)
    bare = np.zeros(len(part_row), bool)
    for i, subset in enumerate(_SUBSETS):
        some = filled[:, subset].any(axis=1)
        bare |= ~some
        some |= deal == _DEALS - 1
        names = mix(content[:, subset].sum(axis=1, dtype=np.uint64) + mix(salt + np.uint64(i)))
        found.append((names[some], rows[part_row[some]]))
    return rows[np.bincount(part_row, bare, minlength=len(rows)) > slack]


def _digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for add in (0x2545F4914F6CDD1D, 0xD1B54A32D192ED03):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes * np.uint64(add) + np.uint64(add >> 7)), out=total[1:])
        out.append(total[at[1:]] - total[at[:-1]])
    return out[0], out[1]


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for part in steps(batch, "text", STEP):
            yield part, *shingle_sets(*byte_texts(part.column("text")), k)


def _digest(k: int):
    def run(batches):
        for part, h, at in _sets(batches, k):
            one, two = _digests(h, at)
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(at)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "n_shingles", "one", "two"])

    return trimmed(run)


def _planes(*arrays: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed."""
    import zstandard

    raw = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays]
    return struct.pack(f"<{len(arrays)}I", *map(len, arrays)) + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    sizes = struct.unpack_from(f"<{len(kinds)}I", blob)
    width = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 * len(kinds) :], max_output_size=max(1, sum(n * w for n, w in zip(sizes, width, strict=True)))), np.uint8)
    out, at = [], 0
    for n, w, kind in zip(sizes, width, kinds, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(kind).reshape(n))
        at += n * w
    return out


_BLOBS = "bucket int, load bigint, kind int, blob binary"


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array([x[j] for x in rows], kind) for j, kind in enumerate(kinds)], names=["bucket", "load", "kind", "blob"])


def _sign(k: int, num: int, den: int, buckets: int):
    """Rows (bucket, load, kind, blob). A load is some documents of a task. Kind 1, by ranges of signatures: each signature of
    the load once, with its only holder, or the number of the set of its holders and the least of them. Kind 0: the sets
    of holders of the load."""
    cut = np.array([(i << NAME_BITS) // buckets for i in range(1, buckets)], np.uint64)

    def load(number: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, place = np.unique(np.concatenate([x for _, x in held]), return_inverse=True)
        # A signature and its holder's place, in one number.
        both = np.sort(np.concatenate([x for x, _ in held]) << np.uint64(PLACE_BITS) | place.astype(np.uint64))
        both = both[np.append(True, both[1:] != both[:-1])]
        names, place = both >> np.uint64(PLACE_BITS), (both & np.uint64((1 << PLACE_BITS) - 1)).astype("<u2")
        start = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        end = np.append(start[1:], len(names))
        known: dict[bytes, int] = {}
        holder = place[start].astype("<u4")
        for i in np.flatnonzero(end - start > 1).tolist():
            holder[i] = len(ids) + known.setdefault(place[start[i] : end[i]].tobytes(), len(known))
        sets = [np.frombuffer(x, "<u2") for x in known]
        least = np.concatenate([ids, ids[np.array([x[0] for x in sets], np.int64)]])
        number_of = np.concatenate([np.full(len(ids), -1), np.arange(len(sets))]).astype("<i4")
        names = names[start]
        cuts = [0, *np.searchsorted(names, cut).tolist(), len(names)]
        rows = []
        for i, (a, b) in enumerate(pairwise(cuts)):
            if b > a:
                used, short = np.unique(holder[a:b], return_inverse=True)
                rows.append((i, number, 1, _planes(np.diff(names[a:b], prepend=np.uint64(0)).astype("<u8"), short.astype("<u4"), least[used].astype("<i8"), number_of[used])))
        if sets:
            rows.append((number % buckets, number, 0, _planes(np.array([len(x) for x in sets], "<u4"), np.concatenate(sets), ids.astype("<i8"))))
        return _sent(rows)

    def run(batches):
        seen: set[bytes] = set()
        held, size, count, number = [], 0, 0, TaskContext.get().partitionId() << 24
        for part, h, at in _sets(batches, k):
            new = np.zeros(part.num_rows, bool)
            digests = np.stack(_digests(h, at), axis=1)
            for i, key in enumerate(digests.view("S16")[:, 0].tolist()):
                if key not in seen:
                    new[i] = True
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
            sizes = np.where(new, np.diff(at), 0)
            kept = np.repeat(new, np.diff(at))
            ends = np.zeros(len(at), np.int64)
            np.cumsum(sizes, out=ends[1:])
            names, rows = signatures(h[kept], ends, num, den)
            if not len(names):
                continue
            if held and (size >= LOAD or count + part.num_rows >= 1 << PLACE_BITS):
                yield load(number, held)
                held, size, count, number = [], 0, 0, number + 1
            held.append((names >> np.uint64(64 - NAME_BITS), part.column("doc_id").to_numpy()[rows]))
            size, count = size + len(names), count + part.num_rows
        if held:
            yield load(number, held)

    return trimmed(run)


_MET = "load bigint, kind int, blob binary"


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The distinct rows of the columns, ascending."""
    order = np.lexsort(columns[::-1])
    rows = np.stack([c[order] for c in columns], axis=1)
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[: len(rows)]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of a bucket, for each load: the pairs of a signature's least holder and a set of holders (kind 1), or
    another only holder (kind 2). Sets of holders go on as they are (kind 0)."""
    now, held = None, []

    def out(loads, kind, blobs):
        return pa.record_batch([pa.array(loads, pa.int64()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["load", "kind", "blob"])

    def met():
        names, least, sets, loads = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(names, kind="stable")  # merges the sorted runs
        names, least, sets, loads = names[order], least[order], sets[order], loads[order]
        start = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        first = np.repeat(np.minimum.reduceat(least, start), np.diff(np.append(start, len(names))))
        for kind, some, other in ((1, sets >= 0, sets), (2, (sets < 0) & (least != first), least)):
            if some.any():
                found = _distinct(loads[some], first[some], other[some])
                cut = np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0]))
                yield out(found[cut, 0], kind, [x[:, 1:].astype("<i8").tobytes() for x in np.split(found, cut[1:])])

    for batch in batches:
        for bucket, load, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "load", "kind", "blob")), strict=True):
            if kind == 0:
                yield out([load], 0, [blob])
                continue
            if bucket != now and held:
                yield from met()
                held.clear()
            now = bucket
            names, place, least, sets = _arrays(blob, "<u8", "<u4", "<i8", "<i4")
            held.append((np.cumsum(names, dtype=np.uint64), least[place], sets[place].astype(np.int64), np.full(len(names), load)))
    if held:
        yield from met()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs (a, b) of each load: a least holder and another holder, or all members of its sets of holders."""
    now, sets, held, alone = None, None, [], []

    def pairs():
        near = list(alone)
        if held:
            many, place, ids = sets
            at = np.append(0, np.cumsum(many, dtype=np.int64))
            found = np.concatenate(held)
            found = _distinct(found[:, 0], found[:, 1])
            size = many[found[:, 1]].astype(np.int64)
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            near.append(np.stack([np.repeat(found[:, 0], size), ids[place[np.repeat(at[found[:, 1]], size) + inside]]], axis=1))
        near = np.concatenate(near)
        near = _distinct(near[:, 0], near[:, 1])
        near = near[near[:, 0] != near[:, 1]]
        return pa.record_batch([pa.array(near[:, 0]), pa.array(near[:, 1])], names=["a", "b"])

    for batch in batches:
        for load, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("load", "kind", "blob")), strict=True):
            if load != now:
                if held or alone:
                    yield pairs()
                now, held, alone = load, [], []
            if kind == 0:
                sets = _arrays(blob, "<u4", "<u2", "<i8")
            else:
                (held if kind == 1 else alone).append(np.frombuffer(blob, "<i8").reshape(-1, 2))
    if held or alone:
        yield pairs()


def _compare(k: int, num: int, den: int):
    def run(batches):
        now, first = None, []
        for part, h, at in _sets(batches, k):
            a, salt, role, ids = (part.column(c).to_pylist() for c in ("a", "salt", "role", "doc_id"))
            out: list[tuple[int, int, bool, int]] = []
            for i in range(part.num_rows):
                own = h[at[i] : at[i + 1]]
                if (a[i], salt[i]) != now:
                    now, first = (a[i], salt[i]), []
                if role[i] == 0:
                    first.append(own.copy())
                    continue
                linked, apart = False, 1 << 40
                for other in first:
                    every = len(np.union1d(own, other))
                    both = len(own) + len(other) - every
                    linked |= bool(both) and den * both >= num * every
                    apart = min(apart, every - both)
                out.append((a[i], ids[i], linked, apart))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.record_batch([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["a", "b", "linked", "apart"])

    return trimmed(run)


def _differences(k, num, den):
    """Rows (a, b, n_a, n_b, size, fan, often, d): what partners have apart from a star's first set. Where all partners of a
    star are in this task, elements that one of them has alone are left out and ``often`` is final."""

    def emit(fan: int, own: int, found: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        each = np.concatenate([x[3] for x in found])
        many = np.array([len(x[3]) for x in found], np.int64)
        _, place, often = np.unique(each, return_inverse=True, return_counts=True)
        often = often[place]
        kept = (often > 1) | (fan > 1)
        row = np.repeat(np.arange(len(found)), many)[kept]
        a, b, n_b = (np.array([x[j] for x in found], np.int64)[row] for j in range(3))
        same = np.full(len(row), 1)
        return pa.record_batch([*map(pa.array, (a, b, own * same, n_b, many[row], fan * same, often[kept], each[kept].view(np.int64)))], names=["a", "b", "n_a", "n_b", "size", "fan", "often", "d"])

    def run(batches):
        now, first, found = None, np.zeros(0, np.uint64), []
        for part, h, at in _sets(batches, k):
            keys = zip(*(part.column(c).to_pylist() for c in ("a", "salt", "fan")), strict=True)
            role, ids = (part.column(c).to_pylist() for c in ("role", "doc_id"))
            for i, key in enumerate(keys):
                own = h[at[i] : at[i + 1]]
                if key != now:
                    if found:
                        yield emit(now[2], len(first), found)
                    now, first, found = key, np.zeros(0, np.uint64), []
                if role[i] == 0:
                    first = np.union1d(first, own)
                    continue
                found.append((key[0], ids[i], len(own), np.setxor1d(first, own, assume_unique=True)))
        if found:
            yield emit(now[2], len(first), found)

    return trimmed(run)


def _beside(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (a, fan, salt, role, doc_id, text), sorted, for tasks that read each pair's texts side by side: a's text (role 0),
    then those of its partners. Each pair ships one text; a document with many partners is dealt to many tasks. Few pairs
    are dealt on the driver."""
    if pairs.count() <= FEW:
        return _side_by_side(docs, *_dealt(pairs)), []
    fans = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fan")), "fans")
    dealt = pairs.join(small(fans), "a").select("a", "fan", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("salt"), "b")
    dealt = materialize(dealt, "dealt")
    firsts = small(fans).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
    return _side_by_side(docs, firsts, small(dealt)), [fans, dealt]


def _side_by_side(docs: DataFrame, firsts: DataFrame, dealt: DataFrame) -> DataFrame:
    one = docs.join(firsts, F.col("doc_id") == F.col("a")).select("a", "fan", "salt", F.lit(0).alias("role"), "doc_id", "text")
    two = docs.join(dealt, F.col("doc_id") == F.col("b")).select("a", "fan", "salt", F.lit(1).alias("role"), "doc_id", "text")
    return one.unionByName(two).repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "doc_id")


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, fan, salt) for each task of a first set, and (a, fan, salt, b) for each pair, to be broadcast."""
    found = pairs.select("a", "b").toArrow()
    a, b = (found.column(c).to_numpy() for c in ("a", "b"))
    first, place, many = np.unique(a, return_inverse=True, return_counts=True)
    fan = -(-many // FAN)
    salt = (mix(b.view(np.uint64)) % fan[place].astype(np.uint64)).astype(np.int32)
    each = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
    firsts = pa.table({"a": np.repeat(first, fan), "fan": np.repeat(fan, fan).astype(np.int32), "salt": each.astype(np.int32)})
    dealt = pa.table({"a": a, "fan": fan[place].astype(np.int32), "salt": salt, "b": b})
    return local(pairs.sparkSession, firsts), local(pairs.sparkSession, dealt)


def compared(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of document ids with ``linked``, are the texts similar, and ``apart``, their Hamming distance."""
    rows, tables = _beside(docs, pairs)
    out = materialize(rows.mapInArrow(_compare(k, num, den), "a bigint, b bigint, linked boolean, apart bigint"), "links")
    release(*tables)
    return out


def _components(edges: DataFrame) -> DataFrame:
    """(node, component), to be broadcast if the edges are few."""
    return components_of_few(edges) if edges.count() <= FEW else components(edges)


def _with_class(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the class of a representative, by the components found so far; one without links is its own class."""
    found = found.select(F.col("node").alias("_node"), F.col("component").alias("_class"))
    return rows.join(found, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_class", column)).drop("_node", "_class")


def _torn(stars: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, class_b) of first sets whose partners are of more than one class. Classes are looked up for
    partners; a star is then one row with its least and greatest class."""
    classed = materialize(_with_class(stars.select("a", "b"), found, "b", "class_b"), "classed")
    ends = classed.groupBy("a").agg(F.min("class_b").alias("low"), F.max("class_b").alias("high"))
    torn = _with_class(ends, found, "a", "class").filter("low != high OR low != class").select("a")
    out = materialize(classed.join(small(gathered(torn, "ids", classed.count())), "a", "left_semi"), "torn")
    release(classed)
    return out


def _centred(stars: DataFrame, compared: DataFrame) -> DataFrame:
    """Stars around a more central set: of the partners of a first set, the one that is nearest to it has the fewest
    elements of its own, so what is left of the others are their own differences."""
    best = gathered(compared.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("centre")), "best", compared.count())
    members = stars.select("a", "b").unionByName(best.select("a", F.col("a").alias("b")))
    moved = members.join(best, "a").filter("b != centre").select(F.col("centre").alias("a"), "b").distinct()
    return materialize(moved, "centred")


def _meeting(docs: DataFrame, torn: DataFrame, found: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), a < b, that may be similar though in different classes, among partners of one first set."""
    rows, tables = _beside(docs, torn.select("a", "b"))
    parts = materialize(rows.mapInArrow(_differences(k, num, den), "a bigint, b bigint, n_a bigint, n_b bigint, size bigint, fan bigint, often bigint, d bigint"), "differences")
    release(*tables)
    # What one partner alone has comes first in its order and meets nothing: its number is enough.
    wide = parts.filter("fan > 1").withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("a", "d"))).filter("often > 1")
    often = parts.filter("fan = 1").unionByName(wide).drop("fan")
    mine = Window.partitionBy("a", "b")
    placed = often.withColumn("place", F.row_number().over(mine.orderBy("often", "d")) + F.col("size") - F.count(F.lit(1)).over(mine))
    c = (den - num) / (den + num)
    least = lambda x: F.greatest(F.lit(1), F.ceil(x / 2 - 1e-6))
    half = F.col("size") + 1 - least(F.col("size") + c * (F.col("n_a") - F.col("n_b")))
    full = F.col("size") + 1 - least(F.col("size") - c * (F.col("n_a") + F.col("n_b")))
    near = (den + num) * F.col("size") <= (den - num) * (F.col("n_a") + F.col("n_b"))
    kept = placed.withColumn("near", near).withColumn("half", F.col("place") <= half).filter(F.col("half") | (~F.col("near") & (F.col("place") <= full)))
    kept = materialize(_with_class(kept.select("a", "d", "b", "n_b", "size", "place", "near", "half"), found, "b", "class_b"), "prefixes")
    release(parts)
    x = kept.filter("half").select("a", "d", F.col("b").alias("x"), F.col("n_b").alias("n_x"), F.col("size").alias("s_x"), F.col("place").alias("p_x"), F.col("near").alias("near_x"), F.col("class_b").alias("class_x"))
    y = kept.filter("NOT near").select("a", "d", F.col("b").alias("y"), F.col("n_b").alias("n_y"), F.col("size").alias("s_y"), F.col("place").alias("p_y"), F.col("half").alias("half_y"), F.col("class_b").alias("class_y"))
    close = (F.col("class_x") != F.col("class_y")) & (den * F.least("n_x", "n_y") >= num * F.greatest("n_x", "n_y"))
    # Of the first shared element, what is behind it on either side must suffice.
    enough = 1 + F.least(F.col("s_x") - F.col("p_x"), F.col("s_y") - F.col("p_y")) >= least(F.col("s_x") + F.col("s_y") - c * (F.col("n_x") + F.col("n_y")))
    met = x.join(y, ["a", "d"]).filter(close & enough & (F.col("near_x") | (F.col("half_y") & (F.col("x") < F.col("y")))))
    rest = materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "rest")
    release(kept)
    return rest


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements the sets ``left`` and ``right`` share: a product of 0/1 matrices, some columns at a time; elements
    of one set alone are left out."""
    size = np.array([len(x) for x in sets], np.int64)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    row = np.repeat(np.arange(len(sets)), size)[shared[column]]
    column = (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.int64)
    width = max(64, min(CELLS // len(sets), int(shared.sum())))
    for low in range(0, int(shared.sum()), width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        table = np.zeros((len(sets), width), np.float32)
        table[row[part], column[part] - low] = 1
        both += (table[left] @ table[right].T).astype(np.int64)
    return both


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    size = np.array([len(x) for x in sets], np.int64)
    both = _shared(sets, left, right)
    return (both > 0) & (den * both >= num * (size[left][:, None] + size[right] - both))


def _similar(held: list[tuple[int, int, int, np.ndarray]], cross: bool, num: int, den: int) -> list[tuple[int, int]]:
    """(doc_id, documents with a similar other set) from rows (slice, doc_id, copies, set): all pairs of two slices, or of
    one."""
    side, ids, copies = (np.array([x[j] for x in held], np.int64) for j in range(3))
    left = np.flatnonzero(side == side[0]) if len(held) else side
    right = np.flatnonzero(side != side[0]) if cross and len(held) else left
    if not len(right) or len(held) < 2:
        return []
    linked = _linked([x[3] for x in held], left, right, num, den)
    if not cross:
        np.fill_diagonal(linked, False)
        return list(zip(ids.tolist(), (linked @ copies).tolist(), strict=True))
    return [*zip(ids[left].tolist(), (linked @ copies[right]).tolist(), strict=True), *zip(ids[right].tolist(), (linked.T @ copies[left]).tolist(), strict=True)]


def _inside(k: int, num: int, den: int):
    """Rows (a, b): for each star the components that the links among all its members form, as edges to their least."""

    def edges(held: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        all_of = np.arange(len(held))
        linked = _linked([x for _, x in held], all_of, all_of, num, den)
        out, left = [], np.ones(len(held), bool)
        for i in range(len(held)):
            if not left[i]:
                continue
            reach, more = np.zeros(len(held), bool), linked[i] & left
            more[i] = True
            while (more & ~reach).any():
                reach |= more
                more = linked[reach].any(axis=0) & left
            left &= ~reach
            out += [(held[i][0], held[j][0]) for j in np.flatnonzero(reach).tolist() if j != i]
        return out

    def run(batches):
        now, held = None, []
        for part, h, at in _sets(batches, k):
            out: list[tuple[int, int]] = []
            for i, (star, doc) in enumerate(zip(part.column("a").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                if star != now:
                    out += edges(held) if len(held) > 1 else []
                    now, held = star, []
                if not held or held[-1][0] != doc:
                    held.append((doc, h[at[i] : at[i + 1]].copy()))
            yield pa.record_batch([pa.array([x[j] for x in out], pa.int64()) for j in range(2)], names=["a", "b"])
        out = edges(held) if len(held) > 1 else []
        yield pa.record_batch([pa.array([x[j] for x in out], pa.int64()) for j in range(2)], names=["a", "b"])

    return trimmed(run)


def _texts(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``docs`` with these ids (doc_id, repeated ones too)."""
    if ids.count() <= BROADCAST_IDS:
        texts = materialize(docs.join(F.broadcast(ids), "doc_id", "left_semi"), "texts")
        return texts, [texts]
    ids = materialize(ids.distinct(), "ids")
    texts = materialize(docs.join(small(ids), "doc_id", "left_semi"), "texts")
    return texts, [ids, texts]


def _within(docs: DataFrame, stars: DataFrame, centres: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) inside stars of bounded size, with their ``centres`` (a); each star's texts meet in one task."""
    members = materialize(stars.unionByName(centres.select("a", F.col("a").alias("b"))), "members")
    few = members.count() <= BROADCAST_IDS
    texts, tables = (docs, []) if few else _texts(docs, members.select(F.col("b").alias("doc_id")))
    rows = texts.join(F.broadcast(members) if few else members, F.col("doc_id") == F.col("b")).select("a", "doc_id", "text")
    out = materialize(rows.repartition("a").sortWithinPartitions("a", "doc_id").mapInArrow(_inside(k, num, den), "a bigint, b bigint"), "links")
    release(members, *tables)
    return out


def _count(k: int, num: int, den: int):
    def run(batches):
        now, held = None, []
        for part, h, at in _sets(batches, k):
            out: list[tuple[int, int]] = []
            keys = zip(*(part.column(c).to_pylist() for c in ("class", "one", "two")), strict=True)
            own, ids, copies = (part.column(c).to_pylist() for c in ("slice", "doc_id", "copies"))
            for i, key in enumerate(keys):
                if key != now:
                    out += _similar(held, bool(now) and now[1] != now[2], num, den)
                    now, held = key, []
                if not held or held[-1][1] != ids[i]:
                    held.append((own[i], ids[i], copies[i], h[at[i] : at[i + 1]].copy()))
            yield pa.record_batch([pa.array([x[j] for x in out], pa.int64()) for j in range(2)], names=["rep", "more"])
        out = _similar(held, bool(now) and now[1] != now[2], num, den)
        yield pa.record_batch([pa.array([x[j] for x in out], pa.int64()) for j in range(2)], names=["rep", "more"])

    return trimmed(run)


def _links(docs: DataFrame, member: DataFrame, final: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, links): the number of other documents that each document is similar to, copies included. All links are
    inside a class; its distinct sets are dealt to slices, and each pair of slices is compared in one task."""
    # Of few components a set that is in none has no links.
    most = rows_of(final)
    sets = member.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).join(final, F.col("rep") == F.col("node"), "inner" if most <= FEW else "left")
    sets = gathered(sets.select("rep", "copies", F.coalesce("component", "rep").alias("class")), "sets", most)
    sizes = sets.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    inside = gathered(sets.join(sizes, "class").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")), "inside", most)
    rows = docs.join(small(inside), F.col("doc_id") == F.col("rep")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("class", F.least("slice", "other").alias("one"), F.greatest("slice", "other").alias("two"), "slice", "doc_id", "copies", "text")
    rows = rows.repartition("class", "one", "two").sortWithinPartitions("class", "one", "two", "slice", "doc_id")
    more = rows.mapInArrow(_count(k, num, den), "rep bigint, more bigint").unionByName(sets.select("rep", (F.col("copies") - 1).alias("more")))
    total = gathered(more.groupBy("rep").agg(F.sum("more").alias("links")).filter("links > 0"), "total", most)
    release(sets, inside)
    many = member.join(small(total), "rep").groupBy("doc_id").agg(F.max("links").alias("links"))
    return gathered(many, "many", most) if most <= FEW else many


def _between(docs: DataFrame, stars: DataFrame, linked: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of large stars that together with ``linked`` form their classes."""
    docs, tables = _texts(docs, stars.select(F.explode(F.array("a", "b")).alias("doc_id")))
    first = compared(docs, stars, k, num, den)
    centred = _centred(stars, first)
    second = compared(docs, centred, k, num, den)
    found = _components(reduce(DataFrame.unionByName, [linked, *(x.filter("linked").select("a", "b") for x in (first, second))]))
    torn = _torn(centred, found)
    rest = _meeting(docs, torn, found, k, num, den)
    late = compared(docs, rest, k, num, den)
    release(torn, centred, rest, *tables)
    return reduce(DataFrame.unionByName, [x.filter("linked").select("a", "b") for x in (first, second, late)])


def _represented(full: DataFrame) -> DataFrame:
    """(doc_id, n, rep) of ``full`` (doc_id, n, one, two): the smallest id of those with the same digest. Only sets with
    copies are looked up; of those, few are broadcast, and else the ones with many copies."""
    keys = ["one", "two", "n"]
    same = full.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    same = gathered(same, "groups", full.count() // 2)
    many, members = same.agg(F.count(F.lit(1)), F.sum("members")).first()
    most = 0 if many <= BROADCAST_IDS else max(256, -(-members // BROADCAST_IDS))
    rows = full.join(F.broadcast(same.filter(F.col("members") > most)), keys, "left")
    if most:
        rest = rows.filter("rep IS NULL").select(full.columns).join(same.filter(F.col("members") <= most), keys, "left")
        rows = rows.filter("rep IS NOT NULL").unionByName(rest)
    rows = rows.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    once = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty()
    return materialize(rows if once else rows.distinct(), "member")


def _classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digests of all rows, each document's representative, and the components of all links."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.filter(F.col("doc_id").isNotNull())
    drop_shuffles(spark)
    digests = materialize(docs.mapInArrow(_digest(k), "doc_id bigint, n_shingles bigint, one bigint, two bigint"), "digests")
    full = digests.filter("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "one", "two")
    member = _represented(full)

    # A document of n shingles has about 1.5 * (den - num) / den * n * 3 signatures; a bucket has some half a million.
    shingles = member.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + shingles * 9 * (den - num) // (2 * den * NAMES)
    signed = known.mapInArrow(_sign(k, num, den, buckets), _BLOBS).repartition("bucket").sortWithinPartitions("bucket", "load")
    met = materialize(signed.mapInArrow(trimmed(_meet), _MET), "met")
    drop_shuffles(spark)
    named = met.repartition("load").sortWithinPartitions("load", "kind").mapInArrow(trimmed(_spread), "a bigint, b bigint")
    rep = small(member.filter("doc_id != rep").select(F.col("doc_id").alias("_doc"), "rep"))
    for side in ("a", "b"):
        named = named.join(rep.withColumnsRenamed({"_doc": f"_{side}", "rep": f"r{side}"}), F.col(side) == F.col(f"_{side}"), "left").withColumn(side, F.coalesce(f"r{side}", side)).select("a", "b")
    stars = materialize(named.filter("a != b").distinct(), "stars")
    release(met)
    equal = member.filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = small(member.filter("doc_id = rep").select(F.col("rep").alias("_rep"), "n"))
    sizes = stars.join(reps, F.col("b") == F.col("_rep")).groupBy("a").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    sizes = gathered(sizes.select("a", ((F.col("members") >= STAR) | (F.col("shingles") > STAR_SHINGLES)).alias("large")), "sizes", stars.count())
    wide = small(sizes.filter("large").select("a"))
    linked = _within(known, stars.join(wide, "a", "left_anti"), sizes.filter("NOT large").select("a"), k, num, den)
    large = materialize(stars.join(wide, "a", "left_semi"), "large")
    release(stars, sizes)
    drop_shuffles(spark)
    if not large.isEmpty():
        linked = linked.unionByName(_between(known, large, linked, k, num, den))
        drop_shuffles(spark)
    final = _components(linked.unionByName(equal))
    return digests, member, final


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _placed(digests: DataFrame, final: DataFrame) -> DataFrame:
    return digests.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def similar_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, links) for each row of ``docs`` (doc_id, text). Documents link when
    den * intersection >= num * union of their k-word shingle sets; component_id is the smallest doc_id reachable, links the
    number of other documents that the document itself links to."""
    docs = _typed(docs)
    digests, member, final = _classes(docs, k, num, den)
    many = _links(docs.filter(F.col("doc_id").isNotNull()), member, final, k, num, den).select(F.col("doc_id").alias("node"), "links")
    return _placed(digests, final).join(many, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", "component_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_one_of_similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their class, with their columns. Rows with one doc_id count as one
    document; those without are in no class and stay."""
    digests, _, final = _classes(_typed(docs), k, num, den)
    return drop_ids(docs, _placed(digests, final).filter("doc_id != component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir).select("doc_id", "text"), k=4, num=85)
