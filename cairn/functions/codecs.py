"""Codecs of byte strings: an LZ4-style block, binary delta scripts, dictionary objects, rANS, and the block
codec of archives (LZ77 symbols under canonical Huffman codes or rANS), with a decoder for each.

The formats are fixed. How an encoder finds matches and code lengths is its own affair: lengths come from
package-merge, matches from a table of last places, so streams differ from other encoders' but decode alike.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa

from .kernels import FNV32, FNV64, delta, undelta


class Damaged(ValueError):
    """The input is not a valid stream."""


# ---- LZ4-style blocks

def lz4_bound(n: int) -> int:
    return n + n // 255 + 16


def lz4_compress(data: bytes) -> bytes:
    """Tokens lit:4 | match:4, literals, offset (2 bytes), matches of 4 or more within 65,535 bytes, by Arrow's encoder. The
    decoder below also takes blocks that end in a match, which Arrow's refuses."""
    return pa.compress(data, codec="lz4_raw", asbytes=True) if data else b""


def lz4_decompress(data: bytes) -> bytes:
    out, i = bytearray(), 0

    def length(n):
        nonlocal i
        while n >= 15:
            if i >= len(data):
                raise Damaged("length")
            n += data[i]
            i += 1
            if data[i - 1] < 255:
                break
        return n

    while i < len(data):
        token = data[i]
        i += 1
        lit = length(token >> 4)
        if i + lit > len(data):
            raise Damaged("literals")
        out += data[i : i + lit]
        i += lit
        if i == len(data):
            break
        if i + 2 > len(data):
            raise Damaged("offset")
        back = int.from_bytes(data[i : i + 2], "little")
        i += 2
        size = length(token & 15) + 4
        if not 0 < back <= len(out):
            raise Damaged("offset")
        while size > 0:  # the source may run into what is being written
            piece = out[len(out) - back : len(out) - back + size]
            out += piece
            size -= len(piece)
    return bytes(out)


# ---- delta scripts

#: Fixed value: the first four bytes of scripts and dictionary objects, as a little-endian number.
MAGIC = 0x44324355
COPY, INSERT, END = 1, 2, 0


def agreeing(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """How many bytes, at most `most`, agree from a[i] and b[j] on."""
    n, step = 0, 16
    while n < most and a[i + n : i + min(n + step, most)] == b[j + n : j + min(n + step, most)]:
        n, step = min(n + step, most), 2 * step
    while n < most and step > 1:
        step //= 2
        if a[i + n : i + min(n + step, most)] == b[j + n : j + min(n + step, most)]:
            n = min(n + step, most)
    return n


def delta_encode(source: bytes, target: bytes, least: int = 8) -> bytes:
    """Copies of the common head and tail; between them copies where `least` bytes or more agree with the source after the
    copy before, or at the first or the last place of the next four bytes, the longest of them; inserts elsewhere."""
    shorter = min(len(source), len(target))
    head = agreeing(source, 0, target, 0, shorter)
    tail = agreeing(source[::-1], 0, target[::-1], 0, shorter - head)
    head, tail = (n if n >= least else 0 for n in (head, tail))
    stop = len(target) - tail
    grams = {target[i : i + 4] for i in range(head, stop - least + 1)}
    if len(grams) <= 64:
        first, last = {g: source.find(g) for g in grams}, {g: source.rfind(g) for g in grams}
    else:
        first, last = {}, {}
        for i in range(len(source) - 3):
            g = source[i : i + 4]
            if g in grams:
                first.setdefault(g, i)
                last[g] = i
    out, start, i, shift = [struct.pack("<II", MAGIC, len(target))], head, head, 0

    def insert(end):
        if end > start:
            out.append(struct.pack("<BI", INSERT, end - start) + target[start:end])

    def copy(p, size):
        if size:
            out.append(struct.pack("<BII", COPY, p, size))

    copy(0, head)
    while i + least <= stop:
        g, size = target[i : i + 4], 0
        for q in (i + shift, first.get(g, -1), last.get(g, -1)):
            if 0 <= q < len(source):
                n = agreeing(source, q, target, i, min(len(source) - q, stop - i))
                if n > size:
                    p, size = q, n
        if size < least:
            i += 1
            continue
        insert(i)
        copy(p, size)
        i += size
        start, shift = i, p + size - i
    insert(stop)
    copy(len(source) - tail, tail)
    return b"".join(out) + bytes([END])


def delta_script(patch: bytes) -> list[tuple[int, int, int, bytes]]:
    """Instructions (op, offset, length, data) of a script."""
    if len(patch) < 9 or struct.unpack_from("<I", patch)[0] != MAGIC:
        raise Damaged("script")
    out, i = [], 8
    try:
        while patch[i] != END:
            if patch[i] == COPY:
                off, n = struct.unpack_from("<II", patch, i + 1)
                out.append((COPY, off, n, b""))
                i += 9
            elif patch[i] == INSERT:
                (n,) = struct.unpack_from("<I", patch, i + 1)
                if i + 5 + n > len(patch):
                    raise Damaged("insert")
                out.append((INSERT, 0, n, patch[i + 5 : i + 5 + n]))
                i += 5 + n
            else:
                raise Damaged("instruction")
    except (IndexError, struct.error):
        raise Damaged("truncated") from None
    return out


def delta_apply(source: bytes, patch: bytes) -> bytes:
    parts = []
    for op, off, n, data in delta_script(patch):
        if op == COPY and off + n > len(source):
            raise Damaged("copy")
        parts.append(source[off : off + n] if op == COPY else data)
    out = b"".join(parts)
    if len(out) != struct.unpack_from("<I", patch, 4)[0]:
        raise Damaged("length")
    return out


# ---- dictionary objects

def _hash(data: bytes, bits: int) -> int:
    h, prime = FNV64 if bits == 64 else FNV32
    mask = (1 << bits) - 1
    for b in data:
        h = (h ^ b) * prime & mask
    return h


def dict_create(data: bytes) -> dict:
    return {"id": _hash(data, 64), "checksum": _hash(data, 32), "size": len(data), "data": data}


def dict_serialize(d: dict) -> bytes:
    return struct.pack("<IQIII", MAGIC, d["id"], d["checksum"], d["size"], 0) + d["data"]


def dict_deserialize(blob: bytes) -> dict:
    if len(blob) < 24:
        raise Damaged("header")
    magic, ident, csum, size, _ = struct.unpack_from("<IQIII", blob)
    if magic != MAGIC or len(blob) < 24 + size:
        raise Damaged("header")
    return {"id": ident, "checksum": csum, "size": size, "data": blob[24 : 24 + size]}


def dict_intact(d: dict) -> bool:
    return _hash(d["data"], 32) == d["checksum"]


# ---- bits: the highest first, in little-endian 16-bit words

class BitWriter:
    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.values.append(value)
        self.sizes.append(bits)

    def put_all(self, values, bits) -> None:
        self.parts += [(np.array(self.values, np.int64), np.array(self.sizes, np.int64)), (np.asarray(values, np.int64), np.asarray(bits, np.int64))]
        self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self.put_all([], [])
        values, sizes = (np.concatenate(x) for x in zip(*self.parts))
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        bits = np.zeros(-(-total // 16) * 16, np.uint8)
        bits[:total] = (np.repeat(values, sizes) >> (np.repeat(ends, sizes) - np.arange(1, total + 1))) & 1
        return np.packbits(bits).view(">u2").astype("<u2").tobytes()


class BitReader:
    """Windows of 48 bits from each 16-bit word on, so that a read is one shift."""

    def __init__(self, data: bytes):
        words = np.concatenate([np.frombuffer(data[: len(data) // 2 * 2], "<u2"), np.zeros(3, "<u2")]).astype(np.int64)
        self.windows = (words[:-2] << 32 | words[1:-1] << 16 | words[2:]).tolist()
        self.at, self.end = 0, len(data) // 2 * 16

    def get(self, n: int) -> int:
        at = self.at
        if at + n > self.end:
            raise Damaged("truncated")
        self.at = at + n
        return self.windows[at >> 4] >> (48 - (at & 15) - n) & ((1 << n) - 1)

    def code(self, table: tuple[list[int], int]) -> int:
        """The next symbol by a table of `reading`."""
        symbols, most = table
        at = self.at
        found = symbols[self.windows[at >> 4] >> (48 - (at & 15) - most) & ((1 << most) - 1)]
        if found < 0 or at + (found & 15) > self.end:
            raise Damaged("code")
        self.at = at + (found & 15)
        return found >> 4


# ---- Huffman lengths and codes

def code_lengths(freq, most: int) -> list[int]:
    """Best prefix code lengths of at most `most` bits, by package-merge. One symbol gets a partner; none: the first two get one bit."""
    used = sorted((f, s) for s, f in enumerate(freq) if f)
    lengths = [0] * len(freq)
    if len(used) < 2:
        s = used[0][1] if used else 0
        lengths[s] = lengths[(s + 1) % len(freq)] = 1
        return lengths
    own = np.array([f for f, _ in used])
    row, leaves = own, [np.ones(len(own), bool)]
    for _ in range(most - 1):
        both = np.concatenate([own, row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)])
        order = np.argsort(both, kind="stable")
        row = both[order]
        leaves.append(order < len(own))
    take, n = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(leaves):  # of a list's first items the symbols count, and the pairs are two items of the list below
        k = int(np.count_nonzero(leaf[:take]))
        n[:k] += 1
        take = 2 * (take - k)
    for (_, s), k in zip(used, n.tolist()):
        lengths[s] = k
    return lengths


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """(code, length) of each used symbol, counting up by length, then symbol."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[s] = (code, n)
        code += 1
    return out


def reading(lengths) -> tuple[list[int], int]:
    """Of each value of the next `most` bits its symbol and that symbol's length, as 16 * symbol + length (-1: no code); and `most`."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if not used:
        return [-1, -1], 1
    most = used[-1][0]
    table = np.repeat([16 * s + n for n, s in used], [1 << (most - n) for n, _ in used])  # canonical codes count up
    if len(table) > 1 << most:
        raise Damaged("code lengths")
    return table.tolist() + [-1] * ((1 << most) - len(table)), most


# ---- rANS

RANS_LOW, RANS_BITS = 1 << 23, 12


def rans_table(freq) -> tuple[list[int], list[int]]:
    """Frequencies scaled to 4096 (each used one at least 1, the difference to the first largest) and their prefix sums."""
    f = np.asarray(freq, np.int64)
    total = int(f.sum())
    if not total:
        return [0] * len(f), [0] * len(f)
    scaled = np.where(f > 0, np.maximum(f * (1 << RANS_BITS) // total, 1), 0)
    scaled[int(np.argmax(scaled))] += (1 << RANS_BITS) - int(scaled.sum())
    return scaled.tolist(), np.concatenate([[0], np.cumsum(scaled)[:-1]]).tolist()


def rans_encode(symbols: list[int], freq: list[int], cum: list[int]) -> bytes:
    x, out = RANS_LOW, bytearray()
    full = [((RANS_LOW >> RANS_BITS) << 8) * f for f in freq]
    for s in reversed(symbols):
        f = freq[s]
        most = full[s]
        while x >= most:
            out.append(x & 255)
            x >>= 8
        x = (x // f << RANS_BITS) + x % f + cum[s]
    out += x.to_bytes(4, "little")
    return bytes(out[::-1])


def rans_decode(data: bytes, n: int, freq: list[int], cum: list[int]) -> list[int]:
    slots = [s for s, f in enumerate(freq) for _ in range(f)]
    if len(data) < 4 or len(slots) != 1 << RANS_BITS:
        raise Damaged("rans")
    x, i, out, mask = int.from_bytes(data[:4], "big"), 4, [], (1 << RANS_BITS) - 1
    for _ in range(n):
        slot = x & mask
        s = slots[slot]
        out.append(s)
        x = freq[s] * (x >> RANS_BITS) + slot - cum[s]
        while x < RANS_LOW:
            if i >= len(data):
                raise Damaged("rans")
            x = x << 8 | data[i]
            i += 1
    return out


# ---- archive blocks

NBYTE, NDIST, NLEN = 256, 60, 28
ALL = NBYTE + NDIST + NLEN
MOST_BITS, MOST_DIST, LEAST, MOST_LEN = 13, 64_000, 3, 200
END_DIST, FLUSH, SMALL = 64_001, 27_000, 256
#: Distances come in tiers of (extra bits, symbols); a tier's step is 2 ** extra bits.
DISTANCES = [b for extra, n in ((0, 15), (4, 15), (8, 15), (12, 15)) for b in [(1 << extra) * k for k in range(1, n + 1)]]
DIST_EXTRA = [extra for extra in (0, 4, 8, 12) for _ in range(15)]
#: lengths' runs of (symbols, extra bits), from 3 on.
LENGTH_RUNS = ((8, 0), (8, 1), (8, 3), (1, 6), (1, 9), (1, 11), (1, 15))
LEN_EXTRA = [e for n, e in LENGTH_RUNS for _ in range(n)]
LENGTHS = [3 + sum(1 << e for e in LEN_EXTRA[:i]) for i in range(NLEN)]
#: The default tree as (symbols, code length) in a row.
DEFAULT_RUNS = (
    (10, 9), (1, 7), (1, 9), (1, 7), (19, 9), (1, 7), (13, 8), (1, 7), (11, 8), (1, 7), (33, 8), (1, 7), (35, 8), (128, 10), (16, 6), (12, 7), (6, 8), (10, 9), (16, 10), (9, 4), (9, 5), (10, 6),
)
DEFAULT = [v for n, v in DEFAULT_RUNS for _ in range(n)]
REPEAT, RUN = 14, 6
METHOD_RANS = 10
TURBO = 80


@cache
def steps(before: int) -> tuple[int, ...]:
    """New code lengths in order of their number, after the length `before`: it, then in turn the next below and above, where 0 stands above 13."""
    below = list(range(before - 1, 0, -1)) if before else list(range(13, 0, -1))
    above = [*range(before + 1, 14), 0] if before else []
    turn = [x for pair in zip(below, above) for x in pair]
    k = min(len(below), len(above))
    return (before, *turn, *below[k:], *above[k:])


@cache
def numbers(before: int) -> tuple[int, ...]:
    """The number of each new code length after the length `before`."""
    return tuple(steps(before).index(n) for n in range(14))


@cache
def present(kind: int) -> list[int]:
    """Symbols whose lengths a tree lists: bit 0, control characters too; bit 1, high bytes too."""
    low = range(128) if kind & 1 else [9, 10, 12, 13, *range(32, 128)]
    return [*low, *(range(128, 256) if kind & 2 else ()), *range(256, ALL)]


def tree_stream(lengths: list[int], before: list[int], kind: int) -> list[int]:
    """Numbers of the new lengths, where a run of more than RUN becomes its number, REPEAT and how many more."""
    out = []
    for value, group in groupby(numbers(before[s])[lengths[s]] for s in present(kind)):
        n = len(list(group))
        while n:
            k = min(n, REPEAT + RUN) if n > RUN else 1
            out += [value, REPEAT, k - RUN] if n > RUN else [value]
            n -= k
    return out


def put_tree(out: BitWriter, lengths: list[int], before: list[int]) -> None:
    if lengths == DEFAULT:
        out.put(0, 1)
        return
    out.put(1, 1)
    listed = set(present(0))
    kind = int(any(lengths[s] for s in range(128) if s not in listed)) | 2 * int(any(lengths[128:256]))
    out.put(kind, 2)
    stream = tree_stream(lengths, before, kind)
    own = code_lengths(np.bincount(stream, minlength=15).tolist(), 7)
    for n in own:
        out.put(n, 3)
    codes = canonical(own)
    out.put_all(*zip(*[codes[v] for v in stream]))


def get_tree(bits: BitReader, before: list[int]) -> list[int]:
    if not bits.get(1):
        return list(DEFAULT)
    kind = bits.get(2)
    table = reading([bits.get(3) for _ in range(15)])
    wanted, values = present(kind), []
    while len(values) < len(wanted):
        v = bits.code(table)
        if v == REPEAT:
            if not values:
                raise Damaged("tree")
            values += [values[-1]] * (bits.code(table) + RUN - 1)
        else:
            values.append(v)
    lengths = [0] * ALL
    for s, v in zip(wanted, values):
        lengths[s] = steps(before[s])[v]
    return lengths


#: Places whose matches are searched at once, and texts among them; what surrounds them is in their windows.
PLACES, TEXTS = 1 << 19, 256


def longest(parts: list[tuple[bytes, int, int]], tries: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of tries (ascending) the lengths and distances of the best match of each place from..to of all parts
    (bytes, from, to): the longest of the last `tries` places of the same three bytes, the nearest of equals; 0 for none."""
    size = np.array([len(x) for x, _, _ in parts])
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(x for x, _, _ in parts) + bytes(8), np.uint8)
    n = len(data) - 8
    low = data[1 : n + 1].astype(np.uint16) << 8 | data[2 : n + 2]
    high = np.repeat(np.arange(len(parts), dtype=np.uint16), size) << 8 | data[:n]
    order = np.argsort(low, kind="stable")
    order = order[np.argsort(high[order], kind="stable")]
    before = np.full(n, -1, np.int32)
    same = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
    before[order[1:][same]] = order[:-1][same]
    for k in range(1, LEAST):  # three bytes that run over a text's end
        before[np.maximum(ends - k, 0)[size >= k]] = -1
    words = np.ascontiguousarray(np.ndarray(n + 1, "<u8", data.tobytes(), strides=(1,)))
    del low, high, order, same
    starts = ends - size
    place = np.concatenate([np.arange(s + i, s + j, dtype=np.int32) for s, (_, i, j) in zip(starts.tolist(), parts)])
    most = np.minimum(MOST_LEN, np.repeat(ends, [j - i for _, i, j in parts]) - place).astype(np.int32)
    best, back = np.zeros(len(place), np.int32), np.zeros(len(place), np.int32)
    found, row, at = [], np.arange(len(place), dtype=np.int32), before[place]
    for t in range(1, tries[-1] + 1):
        here = place[row]
        live = (at >= 0) & (here - at <= MOST_DIST) & (best[row] < most[row])
        row, at, here = row[live], at[live], here[live]
        if not len(row):
            break
        longer = data[at + best[row]] == data[here + best[row]]
        r, a, h, m = row[longer], at[longer], here[longer], most[row[longer]]
        length, open_ = np.zeros(len(r), np.int32), np.arange(len(r), dtype=np.int32)
        while len(open_):
            k = length[open_]
            x = words[a[open_] + k] ^ words[h[open_] + k]
            k += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int32)
            length[open_] = k
            open_ = open_[(x == 0) & (k < m[open_])]
        np.minimum(length, m, out=length)
        better = length > best[r]
        best[r[better]], back[r[better]] = length[better], (h - a)[better]
        if t in tries and t != tries[-1]:
            found.append((best.copy(), back.copy()))
        at = before[at]
    return found + [(best, back)] * (len(tries) - len(found))


def matched(texts: list[tuple[bytes, bytes]], tries: list[int], matches: bool = True) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each (prefix, data) and each number of tries the tokens of data, the longest match taken at each place: literals
    as (byte, 0), matches as (distance, length)."""
    if not matches:
        return [[(np.frombuffer(x, np.uint8).astype(np.int64), np.zeros(len(x), np.int64))] * len(tries) for _, x in texts]
    pieces = []  # of text, from, to
    for number, (prefix, x) in enumerate(texts):
        whole = prefix + x
        for i in range(len(prefix), len(whole), PLACES):
            first, stop = max(0, i - MOST_DIST), min(i + PLACES, len(whole))
            pieces.append((number, (whole[first : stop + MOST_LEN], i - first, stop - first)))
    lengths, distances = ([[[np.zeros(0, np.int32)] for _ in tries] for _ in texts] for _ in range(2))
    i = 0
    while i < len(pieces):
        j, n = i + 1, len(pieces[i][1][0])
        while j < len(pieces) and j - i < TEXTS and n + len(pieces[j][1][0]) <= PLACES:
            n += len(pieces[j][1][0])
            j += 1
        for level, (best, back) in enumerate(longest([x for _, x in pieces[i:j]], tries)):
            cuts = np.cumsum([stop - first for _, (_, first, stop) in pieces[i:j]])[:-1]
            for (number, _), l, d in zip(pieces[i:j], np.split(best, cuts), np.split(back, cuts)):
                lengths[number][level].append(l)
                distances[number][level].append(d)
        i = j
    out = []
    for (_, x), l, d in zip(texts, lengths, distances):
        row = []
        for level in range(len(tries)):
            size, back = np.concatenate(l[level]), np.concatenate(d[level])
            if level and np.array_equal(size, before[0]) and np.array_equal(back, before[1]):
                row.append(row[-1])  # more tries have found nothing
                continue
            before = size, back
            step, places, k = np.maximum(size, 1).tolist(), [], 0
            while k < len(step):
                places.append(k)
                k += step[k]
            at = np.array(places, np.int64)
            row.append((np.where(size[at] > 0, back[at], np.frombuffer(x, np.uint8)[at]).astype(np.int64), size[at].astype(np.int64)))
        out.append(row)
    return out


def as_symbols(value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra values and extra bits of tokens and of the block's end."""
    value, size = np.append(value, END_DIST), np.append(size, LEAST)
    pair = size > 0
    d, k = np.searchsorted(DISTANCES, value[pair], "right") - 1, np.searchsorted(LENGTHS, size[pair], "right") - 1
    place = np.cumsum(1 + pair) - 1 - pair
    symbol, extra, bits = (np.zeros(len(value) + int(pair.sum()), np.int64) for _ in range(3))
    symbol[place] = value
    first, second = place[pair], place[pair] + 1
    symbol[first], extra[first], bits[first] = NBYTE + d, value[pair] - np.take(DISTANCES, d), np.take(DIST_EXTRA, d)
    symbol[second], extra[second], bits[second] = NBYTE + NDIST + k, size[pair] - np.take(LENGTHS, k), np.take(LEN_EXTRA, k)
    return symbol, extra, bits


def encoded(value: np.ndarray, size: np.ndarray, rans: bool) -> bytes:
    """The stream of a text's tokens, in blocks."""
    out, before = BitWriter(), list(DEFAULT)
    weight = np.cumsum(np.where(size > 0, 3, 1))
    start, split = 0, NBYTE + NDIST
    while True:
        so_far = int(weight[start - 1]) if start else 0
        stop = min(int(np.searchsorted(weight, so_far + FLUSH, "right")) + 1, len(value))
        symbols, extra, bits = as_symbols(value[start:stop], size[start:stop])
        out.put(1, 1)
        counts = np.bincount(symbols, minlength=ALL)
        if rans:
            freq, cum = rans_table(counts)
            body = rans_encode(symbols.tolist(), freq, cum)
            out.put(len(symbols), 16)
            out.put(len(body), 16)
            out.put_all(freq, [12] * len(freq))
            out.put_all(np.frombuffer(body, np.uint8), [8] * len(body))
            out.put_all(extra, bits)
        else:
            small = not start and (int(weight[stop - 1]) if stop else 0) < SMALL
            lengths = list(DEFAULT) if small else code_lengths(counts[:split].tolist(), MOST_BITS) + code_lengths(counts[split:].tolist(), MOST_BITS)
            put_tree(out, lengths, before)
            before = lengths
            codes = np.zeros((2, ALL), np.int64)
            for s, c in canonical(lengths[:split]).items():
                codes[:, s] = c
            for s, c in canonical(lengths[split:]).items():
                codes[:, split + s] = c
            code, n = codes[:, symbols]
            out.put_all(code << bits | extra, n + bits)
        start = stop
        if start >= len(value):
            break
    out.put(0, 1)
    return out.bytes()


def compress_all(texts: list[bytes], levels: list[int], prefix: bytes | list[bytes] = b"", matches: bool = True) -> Iterator[list[bytes]]:
    """The streams of each text at each level. Matches of neighbouring texts are searched together, and streams of equal tokens made once."""
    levels = [n if n in range(2, 10) else 4 for n in levels]
    tried = [(4, 16, 64, 256)[(n - 2) % 4] for n in levels]
    tries = sorted(set(tried))
    known = prefix if isinstance(prefix, list) else [prefix] * len(texts)
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and j - i < TEXTS and n + len(texts[j]) <= PLACES:
            n += len(texts[j])
            j += 1
        for row in matched([(p[-MOST_DIST:], x) for p, x in zip(known[i:j], texts[i:j])], tries, matches):
            made: dict[tuple[int, bool], bytes] = {}
            for n, t in zip(levels, tried):
                found = row[tries.index(t)]
                if (id(found), n >= 6) not in made:
                    made[id(found), n >= 6] = encoded(*found, n >= 6)
            yield [made[id(row[tries.index(t)]), n >= 6] for n, t in zip(levels, tried)]
        i = j


def compress(data: bytes, level: int = 4, prefix: bytes = b"", matches: bool = True) -> bytes:
    """Levels 2 to 5: Huffman codes, 6 to 9: rANS. prefix: what the decoder knows. matches=False: literals only."""
    return next(compress_all([data], [level], prefix, matches))[0]


def stride_of(method: int) -> int:
    """The delta stride of a method, 0 for none; 39 and 49 would need more than the eight bytes that are kept."""
    stride = 1 if method in range(21, 30) else (method - 30) % 10 + 1 if method in range(30, 50) else 0
    if stride > 8:
        raise Damaged(f"method {method}")
    return stride


def compress_delta(data: bytes, stride: int, level: int = 4, prefix: bytes = b"") -> tuple[int, bytes, bytes]:
    """The method's number, the stream, and the filtered bytes in it, which its checksum covers. The dictionary is filtered too."""
    filtered = delta(data, stride)
    return 29 + stride, compress(filtered, level, delta(prefix, stride)), filtered


def decompress(data: bytes, size: int | None, method: int = 4, prefix: bytes = b"", filtered: bool = False) -> bytes:
    """The first `size` bytes (None: all) of a stream of method 1 to 9 (Huffman) or 10 (rANS), or of 21 to 49 (Huffman of
    bytes less those a stride before; filtered: these differences themselves)."""
    if stride := stride_of(method):
        got = decompress(data, size, 4, delta(prefix, stride))
        return got if filtered else undelta(got, stride)
    if method == TURBO:
        raise Damaged("Turbo streams are not read")
    if method != METHOD_RANS and method not in range(1, 10):
        raise Damaged(f"method {method}")
    bits, out, before, split = BitReader(data), bytearray(prefix), list(DEFAULT), NBYTE + NDIST

    def copy(back, n):
        if not 0 < back <= len(out):
            raise Damaged("distance")
        while n > 0:  # the source may run into what is being written
            piece = out[len(out) - back : len(out) - back + n]
            out.extend(piece)
            n -= len(piece)

    while bits.get(1):
        if method == METHOD_RANS:
            n, length = bits.get(16), bits.get(16)
            freq = [bits.get(12) for _ in range(ALL)]
            cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).tolist()
            symbols = rans_decode(bytes(bits.get(8) for _ in range(length)), n, freq, cum)
            i = 0
            while i < n:  # the extra bits stand behind all symbols; the last pair is the end
                s = symbols[i]
                i += 1
                if s < NBYTE:
                    out.append(s)
                    continue
                if s >= split or i >= n or symbols[i] < split:
                    raise Damaged("symbol")
                d, k = s - NBYTE, symbols[i] - split
                i += 1
                back, size_ = DISTANCES[d] + bits.get(DIST_EXTRA[d]), LENGTHS[k] + bits.get(LEN_EXTRA[k])
                if back != END_DIST:
                    copy(back, size_)
            continue
        before = get_tree(bits, before)
        main, lens = reading(before[:split]), reading(before[split:])
        (symbols, most), windows, at, end = main, bits.windows, bits.at, bits.end
        mask = (1 << most) - 1
        while True:
            found = symbols[windows[at >> 4] >> (48 - (at & 15) - most) & mask]
            at += found & 15
            if found < 0 or at > end:
                raise Damaged("code")
            s = found >> 4
            if s < NBYTE:
                out.append(s)
                continue
            d, bits.at = s - NBYTE, at
            back = DISTANCES[d] + bits.get(DIST_EXTRA[d])
            k = bits.code(lens)
            n = LENGTHS[k] + bits.get(LEN_EXTRA[k])
            at = bits.at
            if back == END_DIST:
                break
            if n <= back <= len(out):
                from_ = len(out) - back
                out += out[from_ : from_ + n]
            else:
                copy(back, n)
    got = bytes(out[len(prefix) :])
    if size is None:
        return got
    if len(got) < size:
        raise Damaged("truncated")
    return got[:size]


def literal_size(data: bytes) -> int:
    """Compressed size of fewer than 256 bytes as literals of the default tree."""
    return 2 * -(-(sum(DEFAULT[b] for b in data) + 29) // 16)


# ---- 256-bit tree digest (its own format: not BLAKE3 beyond 64 bytes)

#: Initial words, word order of a round, and flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


def mixed(cv: np.ndarray, block: np.ndarray, counter, length, flags) -> np.ndarray:
    """One compression for many rows: cv (n, 8), block (n, 16) words; the next chaining values."""
    n = len(cv)
    s = [cv[:, i].copy() for i in range(8)] + [np.full(n, IV[i]) for i in range(4)]
    s += [np.broadcast_to(np.asarray(x), n).astype(np.uint32) for x in (counter, 0, length, flags)]
    m, order = [block[:, i] for i in range(16)], list(range(16))

    def quarter(a, b, c, d, x, y):
        for w, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            s[a] = s[a] + s[b] + w
            s[d] = s[d] ^ s[a]
            s[d] = (s[d] >> np.uint32(r1)) | (s[d] << np.uint32(32 - r1))
            s[c] = s[c] + s[d]
            s[b] = s[b] ^ s[c]
            s[b] = (s[b] >> np.uint32(r2)) | (s[b] << np.uint32(32 - r2))

    for _ in range(7):
        w = [m[i] for i in order]
        for k in range(4):
            quarter(k, 4 + k, 8 + k, 12 + k, w[2 * k], w[2 * k + 1])
        for k in range(4):
            quarter(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, w[8 + 2 * k], w[9 + 2 * k])
        order = [order[i] for i in ORDER]
    return np.stack([s[i] ^ s[8 + i] for i in range(8)], axis=1)


def digests(values: list[bytes]) -> list[bytes]:
    """Digests of many values: all their chunks of 1024 bytes go through the same steps at once, then their trees."""
    parts = [(r, k, v[k * 1024 : k * 1024 + 1024], k == max(0, (len(v) - 1) // 1024), len(v) <= 1024) for r, v in enumerate(values) for k in range(max(1, -(-len(v) // 1024)))]
    size = np.array([len(p[2]) for p in parts])
    words = np.zeros((len(parts), 272), np.uint32)
    for i, p in enumerate(parts):
        words[i, :256] = np.frombuffer(p[2].ljust(1024, b"\0"), "<u4")
    number, final, alone = (np.array([p[i] for p in parts]) for i in (1, 3, 4))
    cv = np.tile(IV, (len(parts), 1))
    # a chunk that others follow takes 16 whole blocks and then an empty last one; the final chunk ends in its last block
    last = np.where(final, np.maximum(0, -(-size // 64) - 1), 16)
    for b in range(17):
        live = np.flatnonzero(last >= b)
        if not len(live):
            break
        ends = last[live] == b
        length = np.clip(size[live] - 64 * b, 0, 64)
        flags = np.where(ends, CHUNK_END, 0) | (CHUNK_START if b == 0 else 0)
        root = ends & alone[live]
        flags = np.where(root, CHUNK_START | CHUNK_END | ROOT, flags)
        cv[live] = mixed(cv[live], words[live, 16 * b : 16 * b + 16], number[live], length, flags)
    # the trees' shapes depend on the numbers of chunks alone: nodes of one height, of all values, are made at once
    nodes, heights, heads, at = list(cv), [0] * len(cv), [], 0
    todo: dict[int, list[tuple[int, int, int]]] = {}

    def parent(left: int, right: int) -> int:
        nodes.append(None)
        heights.append(1 + max(heights[left], heights[right]))
        todo.setdefault(heights[-1], []).append((len(nodes) - 1, left, right))
        return len(nodes) - 1

    for v in values:
        n = max(1, -(-len(v) // 1024))
        stack: list[int] = []
        for k in range(n - 1):
            node, left = at + k, k
            while left & 1:
                node = parent(stack.pop(), node)
                left >>= 1
            stack.append(node)
        node = at + n - 1
        while stack:
            node = parent(stack.pop(), node)
        heads.append((node, n > 1))
        at += n
    for height in sorted(todo):
        made, left, right = zip(*todo[height])
        both = np.concatenate([np.stack([nodes[i] for i in left]), np.stack([nodes[i] for i in right])], axis=1)
        for i, row in zip(made, mixed(np.tile(IV, (len(made), 1)), both, 0, 64, PARENT)):
            nodes[i] = row
    tops = np.stack([nodes[i] for i, _ in heads]) if heads else np.zeros((0, 8), np.uint32)
    many = np.array([m for _, m in heads], bool)
    if many.any():
        tops[many] = mixed(np.tile(IV, (int(many.sum()), 1)), np.concatenate([tops[many], np.zeros_like(tops[many])], axis=1), 0, 32, PARENT | ROOT)
    return [row.astype("<u4").tobytes() for row in tops]
