"""A hash that any SQL engine can compute."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants and rotations of MD5's 64 steps.
SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def portable_hash(col: Column, seed: int | Column = 0) -> Column:
    """60 bits of the MD5 of `value#seed`, as a long; null for null."""
    text = F.concat(col.cast("string"), F.lit("#"), (F.lit(seed) if isinstance(seed, int) else seed).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def unit_hash(col: Column, seed: int | Column = 0) -> Column:
    """portable_hash as a double in [0, 1)."""
    return portable_hash(col, seed) / float(1 << 60)


def sql_hash(expr: str, seed: int | str = 0) -> str:
    """portable_hash in DuckDB's SQL."""
    return f"CAST('0x' || substr(md5(CAST({expr} AS VARCHAR) || '#' || CAST({seed} AS VARCHAR)), 1, 15) AS BIGINT)"


def md5_head(words: list[np.ndarray | int], rows: int) -> np.ndarray:
    """The first 8 bytes of the MD5 of one block each, as big-endian numbers; the block's 16 words are columns, or one number for all rows."""
    low = 0xFFFFFFFF
    a, b, c, d = (np.full(rows, x, np.uint32) for x in START)
    f, turned = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        f += a
        if isinstance(word, int):
            f += np.uint32((SINES[i] + word) & low)
        else:
            f += word
            f += np.uint32(SINES[i])
        turn = TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=turned)
        f <<= np.uint32(turn)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b = a + np.uint32(START[0]), b + np.uint32(START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def unit_hashes(keys: list[str], seeds: range) -> Callable[[int], np.ndarray]:
    """unit_hash of all keys (as text, not null) by seed, in numpy: MD5 of many rows at once."""
    raw = [k.encode() for k in keys]
    size = np.array([len(k) for k in raw])
    room = 54 - max(len(str(s)) for s in (seeds[0], seeds[-1])) if len(seeds) else 54
    groups = []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n <= room:
            block = np.zeros((len(at), 64), np.uint8)
            block[:, :n] = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)
            words = np.ascontiguousarray(block.view("<u4").T)
            groups.append((at, int(n), list(words[: -(-int(n) // 4)])))
        else:
            groups.append((at, -1, [raw[i] for i in at]))

    def of(seed: int) -> np.ndarray:
        out, tail = np.empty(len(raw), np.uint64), b"#" + str(seed).encode()
        for at, n, held in groups:
            if n < 0:
                out[at] = [int.from_bytes(hashlib.md5(k + tail).digest()[:8], "big") for k in held]
                continue
            rest = bytes(n) + tail + b"\x80"
            rest = rest.ljust(56, b"\0") + (8 * (n + len(tail))).to_bytes(8, "little")
            words: list[np.ndarray | int] = [int.from_bytes(rest[i : i + 4], "little") for i in range(0, 64, 4)]
            for i, column in enumerate(held):
                words[i] = column | np.uint32(words[i])
            out[at] = md5_head(words, len(at))
        return (out >> np.uint64(4)) / float(1 << 60)

    return of
