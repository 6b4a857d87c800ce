"""Byte kernels on numpy arrays. Each takes one flat buffer with the offsets of many values, as Arrow has them."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np

# FNV-1a.
FNV32 = (2166136261, 16777619)
FNV64 = (14695981039346656037, 1099511628211)
#: Fixed value: what an empty input's checksum is.
CHECKSUM = 0xA55A


@cache
def gear_table(seed: str = "gear") -> np.ndarray:
    """256 32-bit numbers by a rule: the head of the MD5 of the seed and the byte. Another table may be passed instead."""
    return np.array([int.from_bytes(hashlib.md5(f"{seed}-{b}".encode()).digest()[:4], "big") for b in range(256)], np.uint32)


#: Fewer values than this are hashed one by one.
FEW = 24


def fnv_on(h: int, data: bytes, bits: int = 64) -> int:
    """FNV-1a from a state on."""
    prime, mask = (FNV64 if bits == 64 else FNV32)[1], (1 << bits) - 1
    for b in data:
        h = (h ^ b) * prime & mask
    return h


def fnv(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int = 64) -> np.ndarray:
    """FNV-1a of data[start:start+length] for all values at once: step j takes byte j of every value that long.

    When few values are left their bytes are taken one value after the other, in whole numbers of Python: a step over an
    array costs as much as some FEW single ones, and a long value alone would need a step for each of its bytes."""
    kind = np.uint64 if bits == 64 else np.uint32
    basis, prime = (kind(x) for x in (FNV64 if bits == 64 else FNV32))
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    h = np.full(len(order), basis, kind)
    live = len(order)
    with np.errstate(over="ignore"):
        for j in range(int(size[0]) if live else 0):
            while live and size[live - 1] <= j:
                live -= 1
            if live < FEW:
                for i in range(live):
                    h[i] = fnv_on(int(h[i]), data[at[i] + j : at[i] + size[i]].tobytes(), bits)
                break
            h[:live] = (h[:live] ^ data[at[:live] + j].astype(kind)) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def checksum(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """0xA55A XOR all bytes, those at odd places shifted by 8; the order of the places' parts does not matter."""
    out = np.full(len(starts), CHECKSUM, np.int64)
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        v = data[s : s + n]
        if n:
            out[i] ^= int(np.bitwise_xor.reduce(v[0::2])) ^ (int(np.bitwise_xor.reduce(v[1::2])) << 8 if n > 1 else 0)
    return out


class Delta:
    """Each byte less the one a stride before it, over pieces of a stream: the last bytes are kept between calls, at first zeros."""

    def __init__(self, stride: int):
        self.stride, self.tail = stride, np.zeros(stride, np.uint8)

    def apply(self, piece: bytes) -> bytes:
        v = np.concatenate([self.tail, np.frombuffer(piece, np.uint8)])
        self.tail = v[len(v) - self.stride :]
        return (v[self.stride :] - v[: len(v) - self.stride]).tobytes()

    def revert(self, piece: bytes) -> bytes:
        v = np.concatenate([self.tail, np.frombuffer(piece, np.uint8)])
        for phase in range(self.stride):
            v[phase :: self.stride] = np.cumsum(v[phase :: self.stride], dtype=np.uint8)
        self.tail = v[len(v) - self.stride :]
        return v[self.stride :].tobytes()


def delta(data: bytes, stride: int) -> bytes:
    """Each byte less the one a stride before it; the first ones as they are."""
    return Delta(stride).apply(data)


def undelta(data: bytes, stride: int) -> bytes:
    return Delta(stride).revert(data)


def read_gear(text: str) -> np.ndarray:
    """A gear table from any text with 256 numbers, decimal or as 0x..., to make the cuts of another system's stores."""
    found = [int(x, 0) for x in re.findall(r"0[xX][0-9A-Fa-f]+|[0-9]+", text)]
    if len(found) != 256 or max(found) >= 1 << 32:
        raise ValueError("a gear table has 256 numbers of 32 bits")
    return np.array(found, np.uint32)


def candidates(data: np.ndarray, bits: int, gear: np.ndarray) -> np.ndarray:
    """Places where the gear hash's low `bits` bits are zero; they depend on the last `bits` bytes alone."""
    g = gear[data].astype(np.uint64)
    h = np.zeros(len(g), np.uint64)
    for k in range(min(bits, len(g))):
        h[k:] += g[: len(g) - k] << np.uint64(k)
    return np.flatnonzero(h & np.uint64((1 << bits) - 1) == 0)


def limits(bits: int, least: int | None, most: int | None) -> tuple[int, int, int]:
    bits = min(max(bits, 8), 20)
    return bits, least or 1 << (bits - 2), most or 1 << (bits + 2)


def cuts(size: int, places: np.ndarray, least: int, most: int, compat: bool = False) -> list[tuple[int, int]]:
    """Chunks (offset, length) of a value of `size` bytes with boundary candidates at `places`.

    A chunk ends after the first candidate at or beyond its least length, at its most length, or at the end.
    compat: a boundary that falls on the very end makes the last chunk count twice.
    """
    out, start = [], 0
    while start < size:
        i = int(np.searchsorted(places, start + least))
        hit = i < len(places) and places[i] < min(start + most, size)
        end = int(places[i]) + 1 if hit else min(start + most, size)
        out.append((start, end - start))
        if compat and hit and end == size:
            out.append((start, end - start))
        start = end
    return out


def chunks(data: np.ndarray, offsets: np.ndarray, bits: int, least: int | None = None, most: int | None = None, gear: np.ndarray | None = None, compat: bool = False):
    """Row number, offset and length of the chunks of all values."""
    bits, least, most = limits(bits, least, most)
    rows, at, size = [], [], []
    places = candidates(data, bits, gear_table() if gear is None else gear)
    for r, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        lo, hi = np.searchsorted(places, (s, e))
        own = cuts(e - s, places[lo:hi] - s, least, most, compat)
        rows += [r] * len(own)
        at += [o for o, _ in own]
        size += [n for _, n in own]
    return np.array(rows, np.int64), np.array(at, np.int64), np.array(size, np.int64)


def simhash(value: np.ndarray) -> int:
    """64 votes of the FNV-64 of each 4-byte shingle; a bit is set on more votes for than against."""
    if len(value) < 4:
        return int(fnv(value, np.zeros(1, np.int64), np.array([len(value)]))[0])
    at = np.arange(len(value) - 3)
    h = fnv(value, at, np.full(len(at), 4))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")
