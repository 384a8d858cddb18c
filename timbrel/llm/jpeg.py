"""Baseline JPEG in numpy: a writer of grey images and a reader whose Huffman decoding runs many intervals at once.

The reader parses the markers, takes out stuffing and restart markers, and decodes all restart intervals of many files in
lockstep: each numpy step reads one symbol of every interval. Luminance thumbnails are made of DC coefficients only.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

RESTART = 4  # blocks of an interval that the writer makes
_DC_STEP = 8  # quantiser of the DC coefficient: a thumbnail's pixel is 128 + DC


def _lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits, with the longest code's last value left free."""
    while True:
        heap = [(w, n, [s]) for n, (s, w) in enumerate(sorted(weights.items()))]
        heap.append((0.0, -1, [-1]))
        heapq.heapify(heap)
        size = dict.fromkeys([*weights, -1], 0)
        n = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                size[s] += 1
            n += 1
            heapq.heappush(heap, (a + b, n, x + y))
        size.pop(-1)
        if max(size.values()) <= 16:
            return size
        weights = {s: w**0.9 for s, w in weights.items()}


def _table(size: dict[int, int]) -> tuple[bytes, bytes]:
    """DHT content: the number of codes of each length, and the symbols."""
    order = sorted(size, key=lambda s: (size[s], s))
    return bytes(sum(v == n for v in size.values()) for n in range(1, 17)), bytes(order)


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol."""
    code, at = 0, 0
    out, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n, many in enumerate(counts, 1):
        for s in symbols[at : at + many]:
            out[s], size[s] = code, n
            code += 1
        at += many
        code <<= 1
    return out, size


#: Shares of the sizes 1 to 10 of AC values in the writer's tables, for bytes of text by rank. Zero runs fall off.
_SIZES = (0.2, 0.27, 0.3, 0.16, 0.05, 0.015, 0.01, 0.005, 0.0001, 0.0001)
DC_TABLE = _table(_lengths({0: 0.06, **{n: 1.0 / (1 + abs(n - 3)) ** 2 for n in range(1, 12)}}))
AC_TABLE = _table(_lengths({0: 0.015, 0xF0: 0.0005, **{run << 4 | n: max(3e-5, share * 0.85 * 0.15**run) for run in range(16) for n, share in enumerate(_SIZES, 1)}}))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_QUANT = _segment(0xDB, bytes([0, _DC_STEP, *[1] * 63]))
_TABLES = _segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]) + _segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1]) + _segment(0xDD, struct.pack(">H", RESTART))
_SCAN = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


_LIMIT = 2048
_VALUES = np.arange(-_LIMIT, _LIMIT)
#: Bits of a value's magnitude, and what follows its code, at value + _LIMIT.
_SIZE = np.frexp(np.abs(_VALUES).astype(np.float64))[1].astype(np.uint64)
_EXTRA = np.where(_VALUES < 0, _VALUES + (1 << _SIZE.astype(np.int64)) - 1, _VALUES).astype(np.uint64)


def _ready(table: tuple[bytes, bytes], runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each (run, value); a zero has none in the AC table."""
    code, length = _codes(*table)
    bits, size = [], []
    for run in range(runs):
        symbol = (run << 4 | _SIZE.astype(np.int64)) & 255
        fits = length[symbol] > 0 if runs == 1 else (length[symbol] > 0) & (_VALUES != 0)
        bits.append(np.where(fits, code[symbol] << _SIZE | _EXTRA, 0))
        size.append(np.where(fits, length[symbol] + _SIZE.astype(np.int64), 0))
    return np.concatenate(bits).astype(np.uint32), np.concatenate(size).astype(np.uint8)


_DC_BITS, _DC_USED = _ready(DC_TABLE, 1)
_AC_BITS, _AC_USED = _ready(AC_TABLE, 16)


def write(blocks: np.ndarray, counts: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Grey images of coefficients in zigzag order; image i has the next ``counts[i]`` (one at least) rows of ``blocks``,
    filled up with zero blocks to a rectangle. Values are between -1023 and 1023, differences of DC within 2047."""
    wide = np.maximum(1, np.ceil(np.sqrt(counts)).astype(np.int64))
    high = -(-counts // wide)
    total = wide * high
    at = np.cumsum(total) - total
    v = np.zeros((int(total.sum()), 64), np.int32)
    image = np.repeat(np.arange(len(counts)), counts)
    v[np.arange(len(blocks)) + (at - (np.cumsum(counts) - counts))[image]] = blocks
    n = len(v)
    of = np.repeat(np.arange(len(counts)), total)
    inside = np.arange(n) - at[of]
    opens = inside % RESTART == 0
    closes = np.append(opens[1:], True)
    diff = v[:, 0].copy()
    diff[1:] -= np.where(opens[1:], 0, v[:-1, 0])

    bits, size = np.zeros((n, 66), np.uint32), np.zeros((n, 66), np.uint8)
    bits[:, 0], size[:, 0] = _DC_BITS[diff + _LIMIT], _DC_USED[diff + _LIMIT]
    column = np.arange(64, dtype=np.int32)
    some = v != 0
    some[:, 0] = False
    seen = np.maximum.accumulate(some * column, axis=1)
    gap = column[1:] - seen[:, :-1]
    last = seen[:, -1]
    at_value = (gap - 1) % 16 * (2 * _LIMIT) + (v[:, 1:] + _LIMIT)
    bits[:, 1:64], size[:, 1:64] = _AC_BITS[at_value], _AC_USED[at_value]
    code, length = _codes(*AC_TABLE)
    long = gap >= 16
    if long.any():  # sixteen zeros with more behind
        row, col = np.nonzero(long & ~some[:, 1:] & (gap % 16 == 0) & (column[1:] < last[:, None]))
        bits[row, col + 1], size[row, col + 1] = code[0xF0], length[0xF0]
    short = last < 63
    bits[short, 64], size[short, 64] = code[0], length[0]

    used = size.sum(axis=1, dtype=np.int64)
    first = np.flatnonzero(opens)
    in_interval = np.add.reduceat(used, first)
    pad = -in_interval % 8
    bits[closes, 65], size[closes, 65] = (1 << pad) - 1, pad
    size_flat, bits_flat = size.reshape(-1), bits.reshape(-1)
    ends = np.cumsum(size_flat, dtype=np.int64)
    live = np.flatnonzero(size_flat)
    length = size_flat[live].astype(np.int64)
    start = ends[live] - length
    word = start >> 5
    x = bits_flat[live].astype(np.uint64) << (64 - (start & 31) - length).astype(np.uint64)
    words = int(ends[-1] >> 5) + 2
    packed = np.bincount(word, (x >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    data = packed.astype(">u4").view(np.uint8)[: int(ends[-1] >> 3)]

    # Stuffing behind 0xFF, and a restart marker between the intervals of an image.
    full = data == 0xFF
    interval_end = np.cumsum(in_interval + pad) >> 3
    nth = inside[first] // RESTART
    marked = np.append(nth[1:] > 0, False)
    room = np.ones(len(data), np.int64) + full
    np.add.at(room, interval_end - 1, 2 * marked)
    where = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[where] = data
    after = where[interval_end - 1][marked] + 1 + full[interval_end - 1][marked]
    out[after] = 0xFF
    out[after + 1] = 0xD0 + (nth[:-1][marked[:-1]] % 8 if len(nth) > 1 else np.zeros(0, np.int64))
    image_last = np.append(np.flatnonzero(inside[first] == 0)[1:], len(first)) - 1
    stop = interval_end[image_last]
    stops = np.append(where, len(out))[stop]
    raw, files, a = out.tobytes(), [], 0
    for i, b in enumerate(stops.tolist()):
        frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, int(high[i]) * 8, int(wide[i]) * 8, 1, 1, 0x11, 0))
        files.append(b"".join((b"\xff\xd8", _segment(0xFE, comments[i]), _QUANT, frame, _TABLES, _SCAN, raw[a:b], b"\xff\xd9")))
        a = b
    return files


@dataclass
class Image:
    """What a file's markers say, and its coefficients: component -> (rows, columns, 64) in zigzag order."""

    width: int = 0
    height: int = 0
    comments: list[bytes] = field(default_factory=list)
    quant: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    scan: list[tuple[int, int]] = field(default_factory=list)  # DC and AC table of each component
    restart: int = 0
    data: bytes = b""
    coefficients: list[np.ndarray] = field(default_factory=list)

    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def layout(self) -> tuple[int, ...]:
        """The component of each block of an MCU."""
        return (0,) if len(self.parts) == 1 else tuple(i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2]))

    def thumbnail(self) -> np.ndarray:
        """Luminance at an eighth of the size, from DC coefficients only."""
        first = self.coefficients[0]
        step = self.quant[self.parts[0][3]][0]
        return np.clip(np.rint(first[:, :, 0] * (step / 8)) + 128, 0, 255).astype(np.uint8)


def parse(blob: bytes) -> Image:
    """The markers up to the scan's data; ValueError if it isn't a baseline JPEG of one scan."""
    if blob[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out, at = Image(), 2
    while True:
        if at + 4 > len(blob) or blob[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = blob[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", blob, at + 2)[0]
        body = blob[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                values = struct.unpack_from(">64H", body, i + 1) if wide else body[i + 1 : i + 65]
                out.quant[body[i] & 15] = values
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                out.tables[body[i]] = (counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif marker == 0xC0:
            depth, out.height, out.width, many = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples are not 8 bits")
            out.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            named = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])}
            if len(named) != len(out.parts):
                raise ValueError("more than one scan")
            out.scan = [named[p[0]] for p in out.parts]
            out.data = blob[at:]
            return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits that begin with a code; 0 for no code."""
    code, length = _codes(counts, symbols)
    out = np.zeros(1 << 16, np.int32)
    for s in symbols:
        low = int(code[s]) << (16 - int(length[s]))
        out[low : low + (1 << (16 - int(length[s])))] = int(length[s]) << 8 | s
    return out


_LOOKUPS: dict[tuple, np.ndarray] = {}


def read(blobs: list[bytes]) -> list[Image]:
    """All files, decoded."""
    images = [parse(b) for b in blobs]
    groups: dict[tuple, list[Image]] = {}
    for x in images:
        key = (x.layout(), tuple((x.tables[d], x.tables[a]) for d, a in x.scan))
        groups.setdefault(key, []).append(x)
    for (layout, tables), group in groups.items():
        _decode(layout, tables, group)
    return images


def _decode(layout: tuple[int, ...], tables: tuple, group: list[Image]) -> None:
    if tables not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[tables] = np.concatenate([_lookup(*t) for pair in tables for t in pair])
    lookup = _LOOKUPS[tables]
    raw = np.frombuffer(b"".join(x.data for x in group) + b"\xff\xd9", np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    drop = np.zeros(len(raw), bool)
    drop[full[after == 0] + 1] = True
    restart = full[(after >= 0xD0) & (after <= 0xD7)]
    drop[restart] = drop[restart + 1] = True
    kept = np.cumsum(~drop)
    data = np.concatenate([raw[~drop], np.zeros(16, np.uint8)])
    many = np.array([x.grid()[0] * x.grid()[1] for x in group], np.int64)
    each = np.array([x.restart or n for x, n in zip(group, many.tolist(), strict=True)], np.int64)
    lanes = -(-many // each)
    file_at = np.cumsum([0] + [len(x.data) for x in group])
    of = np.repeat(np.arange(len(group)), lanes)
    nth = np.arange(len(of)) - (np.cumsum(lanes) - lanes)[of]
    marks = np.searchsorted(restart, file_at[:-1])
    has = np.searchsorted(restart, file_at[1:]) - marks
    if (has != lanes - 1).any():
        raise ValueError("restart markers don't fit the image")
    opened = np.where(nth == 0, file_at[:-1][of], restart[np.minimum(marks[of] + nth - 1, max(0, len(restart) - 1))] + 2 if len(restart) else file_at[:-1][of])
    bit = np.where(opened == 0, 0, kept[opened - 1]) * 8
    inner = len(layout)
    left = np.minimum(each[of], many[of] - nth * each[of]) * inner
    file_block = np.cumsum(many) - many
    block = (file_block[of] + nth * each[of]) * inner
    out = np.zeros(int(many.sum()) * inner * 64, np.int16)
    view = np.ndarray((len(data) - 8,), ">u8", data.tobytes(), 0, (1,))
    part = np.array(layout)
    components = len(tables)
    lane = np.arange(len(of))
    before = np.zeros((len(of), components), np.int64)
    k, phase = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    top = len(view) - 1
    while len(lane):
        window = view[np.minimum(bit >> 3, top)].astype(np.uint64) << (bit & 7).astype(np.uint64)
        own = part[phase] if inner > 1 else 0
        dc = k == 0
        found = lookup[(2 * own + ~dc) * 65536 + (window >> np.uint64(48)).astype(np.int64)]
        length, symbol = found >> 8, found & 255
        if not length.all():
            raise ValueError("a code is not in the table")
        size = symbol & 15
        value = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0)
        bit += length + size
        if dc.any():
            row = np.flatnonzero(dc)
            col = own[row] if inner > 1 else 0
            before[row, col] += value[row]
            value[row] = before[row, col]
        k += np.where(dc, 0, symbol >> 4)
        put = dc | (size > 0)
        out[(block * 64 + k)[put]] = value[put]
        k += 1
        k[~dc & (symbol == 0)] = 64
        if (k > 64).any():
            raise ValueError("a run is too long")
        over = k == 64
        if over.any():
            k[over] = 0
            block[over] += 1
            left[over] -= 1
            if inner > 1:
                phase[over] = (phase[over] + 1) % inner
                # A restart lane begins with an MCU, so the phase follows the blocks.
            go = left > 0
            if not go.all():
                lane, bit, k, block, left, phase, before = lane[go], bit[go], k[go], block[go], left[go], phase[go], before[go]
    blocks = out.reshape(-1, inner, 64)
    for i, x in enumerate(group):
        across, down = x.grid()
        mine = blocks[file_block[i] : file_block[i] + many[i]].reshape(down, across, inner, 64)
        at = 0
        for p in x.parts:
            h, v = (1, 1) if len(x.parts) == 1 else p[1:3]
            x.coefficients.append(mine[:, :, at : at + h * v].reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64))
            at += h * v


def thumbnail_hash(pixels: np.ndarray) -> int:
    """64 bits: is each of 8 x 9 sampled pixels darker than the one to its right."""
    rows = np.arange(8) * pixels.shape[0] // 8
    cols = np.arange(9) * pixels.shape[1] // 9
    small = pixels[rows][:, cols].astype(np.int16)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")
