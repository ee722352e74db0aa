"""MD5 and SHA-1 of many short strings at once, a column of numpy operations a step; the digests are those of ``hashlib``."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHORT = 55  # bytes of a message that fits one block
CHUNK = 8192  # messages hashed together, so that a step's columns stay near the processor

BYTES = np.arange(64)
OWN = np.where(BYTES < np.arange(SHORT + 1)[:, None], 255, 0).astype(np.uint8)  # of a block, by length: the message's bytes
END = np.where(BYTES == np.arange(SHORT + 1)[:, None], 128, 0).astype(np.uint8)  # and the mark after it
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
ROOTS = (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)


def turn(v: np.ndarray, by: int, spare: np.ndarray) -> None:
    """Turns 32-bit numbers left in place."""
    np.left_shift(v, np.uint32(by), out=spare)
    np.right_shift(v, np.uint32(32 - by), out=v)
    np.bitwise_or(v, spare, out=v)


def choice(x: np.ndarray, y: np.ndarray, z: np.ndarray, out: np.ndarray) -> None:
    """The bits of ``y`` where those of ``x`` are set, of ``z`` elsewhere."""
    np.bitwise_xor(y, z, out=out)
    np.bitwise_and(out, x, out=out)
    np.bitwise_xor(out, z, out=out)


def md5_blocks(m: np.ndarray) -> list[np.ndarray]:
    """The four words of the MD5 of messages of one block: 16 rows of little-endian words."""
    a, b, c, d = (np.full(m.shape[1], s, np.uint32) for s in START[:4])
    f, spare = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind, at = divmod(i, 16)
        if kind == 0:
            choice(b, c, d, f)
        elif kind == 1:
            choice(d, b, c, f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        for term in (a, np.uint32(SINES[i]), m[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]):
            np.add(f, term, out=f)
        turn(f, TURNS[kind][at % 4], spare)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [v + np.uint32(s) for v, s in zip((a, b, c, d), START, strict=False)]


def sha1_blocks(m: np.ndarray) -> list[np.ndarray]:
    """The five words of the SHA-1 of messages of one block: 16 rows of big-endian words, as numbers."""
    w = list(m)
    a, b, c, d, e = (np.full(m.shape[1], s, np.uint32) for s in START)
    f, spare = np.empty_like(a), np.empty_like(a)
    for i in range(80):
        kind = i // 20
        if i >= 16:
            new = w[i - 3] ^ w[i - 8]
            np.bitwise_xor(new, w[i - 14], out=new)
            np.bitwise_xor(new, w[i - 16], out=new)
            turn(new, 1, spare)
            w.append(new)
            w[i - 16] = None
        if kind == 0:
            choice(b, c, d, f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_and(b, c, out=spare)
            np.bitwise_xor(f, spare, out=f)
        else:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        for term in (e, np.uint32(ROOTS[kind]), w[i]):
            np.add(f, term, out=f)
        np.left_shift(a, np.uint32(5), out=spare)
        np.add(f, spare, out=f)
        np.right_shift(a, np.uint32(27), out=spare)
        np.add(f, spare, out=f)
        turn(b, 30, spare)
        a, b, c, d, e, f = f, a, b, c, d, e
    return [v + np.uint32(s) for v, s in zip((a, b, c, d, e), START, strict=True)]


def signed_places(data: np.ndarray, start: np.ndarray, length: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece of ``data`` (bytes): its MD5 modulo ``dim``, and 1 where its SHA-1 is even, -1 where it is odd."""
    places, signs = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(64, np.uint8)]), 64)
    short = np.flatnonzero(length <= SHORT)
    for at in range(0, len(short), CHUNK):
        own = short[at : at + CHUNK]
        size = length[own]
        block = windows[start[own]]
        block &= OWN[size]
        block |= END[size]
        m = np.ascontiguousarray(block.view("<u4").T)
        m[14] = size * 8
        rest = np.zeros(len(own), np.uint64)
        for word in md5_blocks(m):
            rest = (rest * np.uint64(2**32 % dim) + word.byteswap()) % np.uint64(dim)
        places[own] = rest
        m = np.ascontiguousarray(block.view(">u4").astype(np.uint32).T)
        m[15] = size * 8
        signs[own] = 1 - 2 * (sha1_blocks(m)[4] & np.uint32(1)).astype(np.int64)
    for i in np.flatnonzero(length > SHORT).tolist():
        raw = data[start[i] : start[i] + length[i]].tobytes()
        places[i] = int.from_bytes(hashlib.md5(raw).digest()) % dim
        signs[i] = 1 - 2 * (hashlib.sha1(raw).digest()[-1] % 2)
    return places, signs
