"""Media columns: texts as baseline JPEG images, and what a marker parse and a Huffman decode read back.

The payload is text in UTF-8 plus zero bytes up to a positive multiple of 64. Each 64 bytes, read as signed numbers, are
the 64 quantised coefficients of one 8 x 8 luminance block in zigzag order (all quantisers are 1), so storing is
lossless: DC differences, runs of zeros, end-of-block codes and sizes are coded as in any baseline image, with
Huffman tables that suit text.

A scan is decoded symbol by symbol in slices: numpy looks up the symbol and the length at every bit position of a slice, or
those of two symbols, a loop steps from symbol to symbol by these lengths, and numpy reads the values at the positions met. That takes time in
proportion to the scan and memory in proportion to a slice; the same decoder reads other baseline scans, with several
components, subsampling and restart markers.

Thumbnails hold the DC luminance of each block only. Defined cases: a null text is empty and has 64 zero
bytes; equal texts give equal values; images over 8191 blocks have rows of 8191 blocks and fill the
last row with zero blocks that the length in the comment marker cuts off again.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from factorlake.llm.shared import map_rows

BLOCK, ROW_BLOCKS = 64, 8191
#: Blocks that are encoded, and bytes of a scan that are decoded at once.
SLICE_BLOCKS, SLICE_BYTES = 1 << 12, 1 << 17
_ZRL, _END = 0xF0, 0x00


def _table(weights: dict[int, float]) -> tuple[list[int], list[int]]:
    """DHT counts and values of a Huffman code for the weights; no code is all ones, as the format asks."""
    heap = [(w, i, [s]) for i, (s, w) in enumerate(weights.items())] + [(0.0, len(weights), [-1])]
    lengths = dict.fromkeys([*weights, -1], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (u, i, a), (v, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (u + v, i, a + b))
    # The reserved symbol has the longest code and comes last, which is the code of all ones.
    values = sorted(weights, key=lambda s: (lengths[s], s))
    counts = [sum(lengths[s] == n for s in values) for n in range(1, 17)]
    if sum(counts) != len(values):
        raise ValueError("codes over 16 bits")
    return counts, values


# Letters have 7 bits, blanks and digits 6, bytes of other scripts 6 or 7; zeros only pad, or stand for themselves.
_OF_SIZE = {1: 1e-4, 2: 1e-4, 3: 1e-4, 4: 2e-3, 5: 5e-3, 6: 0.2, 7: 0.8, 8: 1e-3, 9: 1e-4, 10: 1e-4}
_DC_TABLE = _table({s: {0: 0.1, 9: 1e-3, 10: 1e-3, 11: 1e-3}.get(s, 2.0**s / 300) for s in range(12)})
_AC_TABLE = _table({_END: 0.01, _ZRL: 1e-3} | {run << 4 | s: max(w / 200**run if run else w, 1e-4) for run in range(16) for s, w in _OF_SIZE.items()})


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\0")


def _dht(table: tuple[list[int], list[int]]) -> bytes:
    return bytes(table[0]) + bytes(table[1])


def _codes(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes in canonical order."""
    counts, values = table
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        code <<= 1
        for v in values[at : at + n]:
            out[v] = code, length
            code += 1
        at += n
    return out


def _cells(table: tuple[list[int], list[int]], symbols: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each (run, value) the code with the value's own bits after it, and their number; both are 0 where there is no such symbol."""
    codes, word, length = _codes(table), np.zeros(len(symbols), np.uint64), np.zeros(len(symbols), np.int64)
    for i, (run, value) in enumerate(symbols):
        size = abs(value).bit_length()
        if found := codes.get(run << 4 | size):
            word[i], length[i] = found[0] << size | (value if value >= 0 else value + (1 << size) - 1), found[1] + size
    return word, length


_DC_WORD, _DC_LENGTH = _cells(_DC_TABLE, [(0, d) for d in range(-255, 256)])
#: By run and byte. The byte 0 ends a block after a run of 0, stands for 16 zeros after one of 15, and is no symbol after others.
_AC_WORD, _AC_LENGTH = _cells(_AC_TABLE, [(run, (v + 128) % 256 - 128) for run in range(16) for v in range(256)])
_SIXTEEN, _NONE = 15 << 8, 1 << 8
_PLACES = np.arange(1, BLOCK)


def _bits(payload: np.ndarray, before: int, rest: int, n_rest: int) -> tuple[bytes, int, int]:
    """The whole bytes of a slice of blocks (blocks, 64) behind n_rest bits `rest`, and the bits that remain.

    before: the last DC value of the slice before. Each coefficient has a cell for its word, and so has the end of a block.
    """
    n = len(payload)
    word, length = np.empty((n, BLOCK + 1), np.uint64), np.empty((n, BLOCK + 1), np.int64)
    dc = payload[:, 0].view(np.int8).astype(np.int64)
    difference = dc + 255
    difference[0] -= before
    difference[1:] -= dc[:-1]
    word[:, 0], length[:, 0] = _DC_WORD[difference], _DC_LENGTH[difference]
    key = np.full((n, BLOCK), _NONE)
    key[:, :-1] = payload[:, 1:]
    thin = np.flatnonzero((payload[:, 1:] == 0).any(axis=1))
    if len(thin):
        value = payload[thin, 1:].astype(np.int64)
        last = np.maximum.accumulate(np.where(value != 0, _PLACES, 0), axis=1)
        run = np.broadcast_to(_PLACES - 1, last.shape).copy()
        run[:, 1:] -= last[:, :-1]
        run &= 15
        key[thin, :-1] = np.where(value != 0, run << 8 | value, np.where((run == 15) & (_PLACES < last[:, -1:]), _SIXTEEN, _NONE))
        key[thin, -1] = np.where(last[:, -1] < BLOCK - 1, _END, _NONE)
    word[:, 1:], length[:, 1:] = _AC_WORD[key], _AC_LENGTH[key]
    word, length = word.ravel(), length.ravel()
    end = np.cumsum(length) + n_rest
    start = end - length
    # A word has 27 bits at most, so it lies in one unit of 32 bits or in two; words don't overlap, so their sums are their bits.
    unit, word = start >> 5, word << (64 - (start & 31) - length).astype(np.uint64)
    total = int(end[-1])
    units = np.bincount(unit, word >> np.uint64(32), (total >> 5) + 2)
    units[1:] += np.bincount(unit, word & np.uint64(0xFFFFFFFF), (total >> 5) + 1)[: len(units) - 1]
    units[0] += rest << (32 - n_rest)
    data = units.astype(">u4").tobytes()
    return data[: total >> 3], data[total >> 3] >> (8 - (total & 7)), total & 7


def encode(payload: bytes) -> bytes:
    """A baseline JPEG whose quantised coefficients are the payload."""
    n = len(payload) // BLOCK
    wide, high = min(n, ROW_BLOCKS), -(-n // ROW_BLOCKS)
    frame = struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)
    parts = [
        b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, frame),
        _segment(0xC4, b"\0" + _dht(_DC_TABLE)), _segment(0xC4, b"\x10" + _dht(_AC_TABLE)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
    rest, n_rest, before = 0, 0, 0
    for a in range(0, wide * high, SLICE_BLOCKS):
        count = min(SLICE_BLOCKS, wide * high - a)
        values = np.frombuffer(payload[a * BLOCK : (a + count) * BLOCK].ljust(count * BLOCK, b"\0"), np.uint8).reshape(count, BLOCK)
        data, rest, n_rest = _bits(values, before, rest, n_rest)
        before = int(values.view(np.int8)[-1, 0])
        parts.append(data.replace(b"\xff", b"\xff\0"))
    if n_rest:
        parts.append(bytes([(rest + 1 << 8 - n_rest) - 1]).replace(b"\xff", b"\xff\0"))
    return b"".join([*parts, b"\xff\xd9"])


def parse(jpeg: bytes) -> dict:
    """The markers of a baseline JPEG: width, height, components, quant, huffman, restart, comment, scan (bytes as stored, to the end marker)."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no start-of-image marker")
    out: dict = {"quant": {}, "huffman": {}, "restart": 0, "comment": b""}
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = jpeg[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        (size,) = struct.unpack_from(">H", jpeg, at + 2)
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 64 * (1 + (body[0] >> 4))
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if body[0] >> 4 else np.uint8).astype(int)
                body = body[1 + wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huffman"][body[0]] = (list(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            _, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            out["components"] = [dict(zip(("id", "h", "v", "q"), (body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]), strict=True)) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            tables = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            for c in out["components"]:
                c["dc"], c["ac"] = tables[c["id"]] >> 4, tables[c["id"]] & 15
            end = jpeg.rfind(b"\xff\xd9")
            out["scan"] = jpeg[at : end if end >= at else len(jpeg)]
            return out
    raise ValueError("no scan")


#: Bits that a decoder looks at: those of the longest code, and enough for two ordinary symbols with their extra bits.
_CODE_BITS, _WINDOW_BITS = 16, 20
_BEYOND = _WINDOW_BITS - _CODE_BITS


class _Lookup:
    """By the next _CODE_BITS bits: `step`, length of the code with its extra bits and 256 times how far the place moves; `read`, length of
    the code alone, 256 times the size of the extra bits and 65536 times how far the place moves. `steps` is step by _WINDOW_BITS bits,
    for two symbols at once where these have both and the first doesn't end the block."""

    def __init__(self, table: tuple[list[int], list[int]], dc: bool) -> None:
        self.step, self.read = np.full(1 << _CODE_BITS, 128 << 8, np.uint16), np.full(1 << _CODE_BITS, 128 << 16, np.int32)  # no such code
        for s, (code, length) in _codes(table).items():
            own = slice(code << (_CODE_BITS - length), (code + 1) << (_CODE_BITS - length))
            size = s if dc else s & 15
            move = 1 if dc else BLOCK if s == _END else (s >> 4) + 1
            self.step[own], self.read[own] = move << 8 | length + size, move << 16 | size << 8 | length
        if not dc:
            bits = np.arange(1 << _WINDOW_BITS)
            one = self.step[bits >> _BEYOND]
            other = self.step[((bits << (one & 255)) & ((1 << _WINDOW_BITS) - 1)) >> _BEYOND]
            both = (one >> 8 < BLOCK) & (other >> 8 < BLOCK) & ((one & 255) + (other & 255) <= _WINDOW_BITS)
            self.steps = np.where(both, one + other, one)


@lru_cache(64)
def _lookup(counts: bytes, values: bytes, dc: bool) -> _Lookup:
    return _Lookup((list(counts), list(values)), dc)


def _restarts(scan: bytes) -> list[bytes]:
    parts, at, i = [], 0, scan.find(b"\xff")
    while 0 <= i < len(scan) - 1:
        if 0xD0 <= scan[i + 1] <= 0xD7:
            parts.append(scan[at:i])
            at = i + 2
        i = scan.find(b"\xff", i + 2)
    return [*parts, scan[at:]]


def _windows(data: np.ndarray) -> np.ndarray:
    """The _WINDOW_BITS bits from each bit position on."""
    wide = data.astype(np.intp)
    wide = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    return (wide[:, None] >> np.arange(32 - _WINDOW_BITS, 24 - _WINDOW_BITS, -1) & ((1 << _WINDOW_BITS) - 1)).ravel()


def decode_slices(image: dict) -> Iterator[list[np.ndarray]]:
    """Per slice of the scan and component: (blocks, 64) quantised coefficients in zigzag order, blocks in scan order."""
    parts = image["components"]
    single = len(parts) == 1
    wide, high = (8, 8) if single else (8 * max(c["h"] for c in parts), 8 * max(c["v"] for c in parts))
    mcus = -(-image["width"] // wide) * -(-image["height"] // high)
    lookups = {k: _lookup(bytes(t[0]), bytes(t[1]), k < 16) for k, t in image["huffman"].items()}
    # Of each block of an MCU: its component and tables.
    turn = [(k, c["dc"], 16 | c["ac"]) for k, c in enumerate(parts) for _ in range(1 if single else c["h"] * c["v"])]
    # No MCU needs more bytes than this.
    most = len(turn) * BLOCK * 27 // 8 + 8
    left = mcus
    for piece in _restarts(image["scan"]):
        data = np.frombuffer(piece.replace(b"\xff\0", b"\xff"), np.uint8)
        n, at, before = min(image["restart"] or mcus, left), 0, np.zeros(len(parts), np.int64)
        left -= n
        while n:
            window = _windows(np.concatenate([data[at >> 3 : (at >> 3) + SLICE_BYTES + most], np.zeros(most + 8, np.uint8)]))
            steps = {}
            for k in {ac for _, _, ac in turn}:
                step = lookups[k].steps[window]
                steps[k] = lookups[k].step, (step & 255).astype(np.uint8).tobytes(), (step >> 8).astype(np.uint8).tobytes()
            p, end, met, counts = at & 7, 8 * SLICE_BYTES, [], []
            meet = met.append
            while n and p < end:
                n -= 1
                for _, dc, ac in turn:
                    begun, (place, length) = len(met), divmod(int(lookups[dc].step[window[p] >> _BEYOND]), 256)
                    meet(p)
                    p += length
                    single, total, move = steps[ac]
                    while place < BLOCK:
                        meet(p)
                        after = place + move[p]
                        if after <= BLOCK:
                            place = after
                            p += total[p]
                        else:
                            moved, length = divmod(int(single[window[p] >> _BEYOND]), 256)
                            place += moved
                            p += length
                    if place >= 128:
                        raise ValueError("no such code")
                    counts.append(len(met) - begun)
            at = (at >> 3 << 3) + p
            if at > 8 * len(data):
                raise ValueError("the scan ends early")
            yield _coefficients(window, np.array([*met, p]), np.array(counts), turn, lookups, before)


def _reads(window: np.ndarray, met: np.ndarray, counts: np.ndarray, turn: list, lookups: dict) -> np.ndarray:
    """What `read` says of the symbols at met, counts of them in each block."""
    of_turn, first, bits = np.arange(len(counts)) % len(turn), np.cumsum(counts) - counts, window[met] >> _BEYOND
    if len(turn) == 1:
        read = lookups[turn[0][2]].read[bits]
    else:
        read, of_symbol = np.empty(len(met), np.int32), np.repeat(of_turn, counts)
        for t, (_, _, ac) in enumerate(turn):
            read[of_symbol == t] = lookups[ac].read[bits[of_symbol == t]]
    for t, (_, dc, _) in enumerate(turn):
        read[first[of_turn == t]] = lookups[dc].read[bits[first[of_turn == t]]]
    return read


def _coefficients(window: np.ndarray, met: np.ndarray, counts: np.ndarray, turn: list, lookups: dict, before: np.ndarray) -> list[np.ndarray]:
    """The blocks of a slice. At met, and where it ends, begins a symbol or two; counts of them are in each block. before: the last DC values, which are moved on."""
    read = _reads(window, met[:-1], counts, turn, lookups)
    follows = met[:-1] + (read & 255) + (read >> 8 & 255)
    two = follows < met[1:]
    own = np.cumsum(1 + two)
    every = np.empty(own[-1], np.intp)
    every[own - 1] = np.where(two, follows, met[:-1])
    every[own[two] - 2] = met[:-1][two]
    met, counts = every, counts + np.add.reduceat(two, np.cumsum(counts) - counts, dtype=np.intp)
    read = _reads(window, met, counts, turn, lookups)
    n, last = len(counts), np.cumsum(counts) - 1
    first, of_turn = last - counts + 1, np.arange(n) % len(turn)
    size, moved = read >> 8 & 255, np.cumsum(read >> 16)
    raw = window[met + (read & 255)] >> _BEYOND
    # Without a leading 1 the value is negative.
    value = (raw >> (16 - size)) - (raw < 1 << 15) * ((1 << size) - 1)
    cell = moved + np.repeat(np.arange(n) * BLOCK - moved[first], counts)
    real = size > 0
    real[last] &= cell[last] < np.arange(1, n + 1) * BLOCK
    out = np.zeros(n * BLOCK, np.int32)
    out[cell[real]] = value[real]
    out, found = out.reshape(n, BLOCK), []
    for k in range(len(before)):
        own = out if len(before) == 1 else out[np.isin(of_turn, [t for t, x in enumerate(turn) if x[0] == k])]
        own[:, 0] = np.cumsum(own[:, 0]) + before[k]
        before[k] = own[-1, 0] if len(own) else before[k]
        found.append(own)
    return found


def decode_scan(image: dict) -> list[np.ndarray]:
    """Per component (blocks, 64) quantised coefficients in zigzag order, blocks in scan order."""
    return [np.concatenate(x) for x in zip(*decode_slices(image), strict=True)]


def dc_thumbnail(image: dict, dc: np.ndarray) -> np.ndarray:
    """Luminance of each block's mean, one pixel a block, from the DC coefficients of the first component, in scan order."""
    c = image["components"][0]
    single = len(image["components"]) == 1
    h, v = (1, 1) if single else (c["h"], c["v"])
    wide = 8 if single else 8 * max(x["h"] for x in image["components"])
    across = -(-image["width"] // wide)
    grid = (dc * image["quant"][c["q"]][0] / 8 + 128).reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
    return np.clip(np.rint(grid), 0, 255).astype(np.uint8)


def payload_slices(image: dict, slices: Iterator[list[np.ndarray]]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Of each slice the payload bytes and the DC coefficients."""
    left = int(image["comment"].partition(b"=")[2])
    for found in slices:
        data = found[0].astype(np.int8).tobytes()[:left]
        left -= len(data)
        yield data, found[0][:, 0]


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """64 bits in hex: the thumbnail's pixels, in reading order, in 64 equal shares; a bit is 1 where a share's mean exceeds the overall mean."""
    flat = thumb.ravel().astype(np.float64)
    edges = np.arange(side * side + 1) * len(flat) / (side * side)
    sums = np.concatenate([[0.0], np.cumsum(flat)])
    through = np.interp(edges, np.arange(len(sums)), sums)
    bits = np.diff(through) > through[-1] / (side * side) + 1e-9
    return np.packbits(bits).tobytes().hex()


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, media binary"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per row of docs: dimensions and digests read back from the stored image; `media` only if kept."""

    def described(doc_id: int | None, text: str | None) -> list[tuple]:
        n, payload = payload_of(text)
        stored = encode(payload)
        image = parse(stored)
        digest, n_back, tail, means = hashlib.sha256(), 0, b"", []
        for data, dc in payload_slices(image, decode_slices(image)):
            digest.update(data)
            n_back, tail = n_back + len(data), (tail + data)[-BLOCK:]
            means.append(dc)
        thumb = dc_thumbnail(image, np.concatenate(means))
        feature = f"{image['width']}x{image['height']}:{thumbnail_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"
        row = doc_id, n, n_back, digest.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(), feature, image["width"], image["height"]
        return [(*row, stored) if keep_media else row]

    schema = SCHEMA if keep_media else SCHEMA.removesuffix(", media binary")
    return map_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), lambda: described, schema)
