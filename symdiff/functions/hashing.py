"""Hash functions as Column expressions, and as Arrow functions where an expression can't read a string's bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symdiff.functions.unsigned import modulo, signed

# The seeds of the hash family; the first one is the checksum's, the others choose cells.
SEEDS = (
    0xC3DA4A8C, 0xA5112C8C, 0x5271F491, 0x9A948DAB, 0xCEE59A8D, 0xB5F525AB, 0x59D13217, 0x24E7C331,
    0x697C2103, 0x84B0A460, 0x86156DA9, 0xAEF2AC68, 0x23243DA5, 0x3F649643, 0x5FA495A8, 0x67710DF8,
)
# The 64-bit Murmur multiplier and shift.
M64, R64 = 0xC6A4A7935BD1E995, 47
# The 32-bit Murmur multiplier and shift.
M32, R32 = 0x5BD1E995, 24
MASK32 = 0xFFFFFFFF


def _scrambled(k: Column) -> Column:
    k = k * F.lit(signed(M64))
    return k.bitwiseXOR(F.shiftrightunsigned(k, R64)) * F.lit(signed(M64))


def _closed(h: Column) -> Column:
    h = h.bitwiseXOR(F.shiftrightunsigned(h, R64)) * F.lit(signed(M64))
    return h.bitwiseXOR(F.shiftrightunsigned(h, R64))


def murmur64a(key: Column, seed: int = 0, key_bytes: int = 8) -> Column:
    """MurmurHash64A of a key's 8 or 4 little-endian bytes, as BIGINT bits. Build it inside `wrapping`."""
    start = F.lit(signed(seed ^ (key_bytes * M64)))
    if key_bytes == 8:
        return _closed(start.bitwiseXOR(_scrambled(key)) * F.lit(signed(M64)))
    if key_bytes == 4:
        return _closed(start.bitwiseXOR(key.bitwiseAND(F.lit(MASK32))) * F.lit(signed(M64)))
    raise ValueError("keys have 4 or 8 bytes")


def murmur64a_numpy(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """The same for 8-byte keys in numpy, as unsigned values."""
    m, r = np.uint64(M64), np.uint64(R64)
    k = keys.astype(np.uint64) * m
    h = np.uint64((seed ^ (8 * M64)) & ((1 << 64) - 1)) ^ ((k ^ (k >> r)) * m)
    h = h * m
    h = (h ^ (h >> r)) * m
    return h ^ (h >> r)


def portable(key: Column, seed: int) -> Column:
    """A 60-bit hash that any SQL engine can compute: the first 15 hex digits of md5('seed:key')."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def family(name: str):
    """hash(key, index) of a named family: 'murmur' (build inside `wrapping`) or 'portable'."""
    if name == "murmur":
        return lambda key, i: murmur64a(key, SEEDS[i])
    if name == "portable":
        return portable
    raise ValueError(f"no hash family {name!r}")


def family_modulo(name: str, value: Column, m: int) -> Column:
    return modulo(value, m) if name == "murmur" else value % m


def murmur32(key: Column, seed: int = 0) -> Column:
    """MurmurHash2 (32 bits) of a key's 8 little-endian bytes."""

    def times(x: Column) -> Column:  # in 16-bit halves, so that nothing overflows
        low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
        return (low * M32 + F.shiftleft((high * M32).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))

    h = F.lit((seed ^ 8) & MASK32).cast("long")
    for word in (key.bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(key, 32)):
        k = times(word)
        h = times(h).bitwiseXOR(times(k.bitwiseXOR(F.shiftright(k, R32))))
    h = times(h.bitwiseXOR(F.shiftright(h, 13)))
    return h.bitwiseXOR(F.shiftright(h, 15))


def null_hash(data: Column, shift: int = 0) -> Column:
    """The four bytes that end `shift` before the end, as signed bytes of a big-endian number, modulo 2^32."""
    n = F.octet_length(data)
    byte = lambda k: F.conv(F.hex(F.substring(data, n - shift - 3 + k, F.lit(1))), 16, 10).cast("long")
    total = sum((byte(k) - F.when(byte(k) > 127, 256).otherwise(0)) * (1 << 8 * (3 - k)) for k in range(4))
    return F.when(n < 4 + shift, F.lit(0).cast("long")).otherwise(F.pmod(total, F.lit(1 << 32)))


def low_bits(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1))


def trailing_zeroes(k: Column, strata: int) -> Column:
    """The index of the lowest set bit; `strata` for 0."""
    low = k.bitwiseAND(F.when(k == signed(1 << 63), k).otherwise(-k))
    below = F.when(low == signed(1 << 63), F.lit((1 << 63) - 1)).otherwise(low - 1)
    return F.when(k == 0, F.lit(strata)).otherwise(F.bit_count(below)).cast("int")


# Hashes of byte strings: values of one length are a matrix of bytes, hashed a column at a time.


def by_length(values: pd.Series, one) -> pd.Series:
    """one(matrix of uint8) for the values of each length; null for null."""
    out = pd.Series([None] * len(values), dtype="object")
    data = [None if v is None else bytes(v) for v in values]
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(data):
        if v is not None:
            groups.setdefault(len(v), []).append(i)
    for n, rows in groups.items():
        matrix = np.frombuffer(b"".join(data[i] for i in rows), dtype=np.uint8).reshape(len(rows), n)
        for i, h in zip(rows, one(matrix), strict=True):
            out[i] = h
    return out


def words(matrix: np.ndarray, at: int, size: int = 4) -> np.ndarray:
    """The little-endian number in up to `size` bytes from `at`."""
    out = np.zeros(len(matrix), dtype=np.uint64)
    for k in range(min(size, matrix.shape[1] - at)):
        out |= matrix[:, at + k].astype(np.uint64) << np.uint64(8 * k)
    return out.astype(np.uint32) if size == 4 else out


def rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint32(k)) | (x >> np.uint32(32 - k))


def lookup3(matrix: np.ndarray, seed_c: int = 0, seed_b: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Jenkins' lookup3 (little-endian) with two seeds; its two results."""
    rows, n = matrix.shape
    a = np.full(rows, (0xDEADBEEF + n + seed_c) & MASK32, dtype=np.uint32)
    b, c = a.copy(), a + np.uint32(seed_b & MASK32)
    at = 0
    while n - at > 12:
        a, b, c = a + words(matrix, at), b + words(matrix, at + 4), c + words(matrix, at + 8)
        for k1, k2, k3 in ((4, 6, 8), (16, 19, 4)):
            a = (a - c) ^ rotated(c, k1)
            c = c + b
            b = (b - a) ^ rotated(a, k2)
            a = a + c
            c = (c - b) ^ rotated(b, k3)
            b = b + a
        at += 12
    if n > at:
        a = a + words(matrix, at)
        b = b + words(matrix, at + 4) if n > at + 4 else b
        c = c + words(matrix, at + 8) if n > at + 8 else c
        c = (c ^ b) - rotated(b, 14)
        a = (a ^ c) - rotated(c, 11)
        b = (b ^ a) - rotated(a, 25)
        c = (c ^ b) - rotated(b, 16)
        a = (a ^ c) - rotated(c, 4)
        b = (b ^ a) - rotated(a, 14)
        c = (c ^ b) - rotated(b, 24)
    return c, b


def superfast(matrix: np.ndarray) -> np.ndarray:
    """Hsieh's hash, from its published description; tail bytes count as signed."""
    rows, n = matrix.shape
    u = np.uint32
    h = np.full(rows, n, dtype=u)
    if not n:
        return h
    two = lambda at: words(matrix[:, at : at + 2], 0)
    signed_byte = lambda at: matrix[:, at].astype(np.int8).astype(np.int32).astype(u)
    for at in range(0, n - n % 4, 4):
        h = h + two(at)
        h = (h << u(16)) ^ ((two(at + 2) << u(11)) ^ h)
        h = h + (h >> u(11))
    at = n - n % 4
    if n % 4 == 3:
        h = h + two(at)
        h = h ^ (h << u(16)) ^ (signed_byte(at + 2) << u(18))
        h = h + (h >> u(11))
    elif n % 4 == 2:
        h = h + two(at)
        h = h ^ (h << u(11))
        h = h + (h >> u(17))
    elif n % 4 == 1:
        h = h + signed_byte(at)
        h = h ^ (h << u(10))
        h = h + (h >> u(1))
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h = h ^ (h << u(left))
        h = h + (h >> u(right))
    return h


def murmur64a_bytes(matrix: np.ndarray, seed: int = 0) -> np.ndarray:
    rows, n = matrix.shape
    m, r = np.uint64(M64), np.uint64(R64)
    h = np.full(rows, (seed ^ (n * M64)) & ((1 << 64) - 1), dtype=np.uint64)
    for at in range(0, n - n % 8, 8):
        k = words(matrix, at, 8) * m
        h = (h ^ ((k ^ (k >> r)) * m)) * m
    if n % 8:
        h = (h ^ words(matrix, n - n % 8, 8)) * m
    h = (h ^ (h >> r)) * m
    return h ^ (h >> r)


def murmur32_bytes(matrix: np.ndarray, seed: int = 0) -> np.ndarray:
    rows, n = matrix.shape
    m, u = np.uint32(M32), np.uint32
    h = np.full(rows, (seed ^ n) & MASK32, dtype=u)
    for at in range(0, n - n % 4, 4):
        k = words(matrix, at) * m
        h = (h * m) ^ ((k ^ (k >> u(R32))) * m)
    if n % 4:
        h = (h ^ words(matrix, n - n % 4)) * m
    h = (h ^ (h >> u(13))) * m
    return h ^ (h >> u(15))


@lru_cache(maxsize=4)
def mersenne_tables(seed: int, chunks: int) -> np.ndarray:
    """chunks x 65536 outputs of the 64-bit Mersenne twister."""
    n, half = 312, 156
    state = [seed & ((1 << 64) - 1)]
    for i in range(1, n):
        state.append((6364136223846793005 * (state[-1] ^ (state[-1] >> 62)) + i) & ((1 << 64) - 1))
    out: list[np.ndarray] = []
    for _ in range(-(-chunks * 65536 // n)):
        for i in range(n):
            x = (state[i] & 0xFFFFFFFF80000000) | (state[(i + 1) % n] & 0x7FFFFFFF)
            state[i] = state[(i + half) % n] ^ (x >> 1) ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        y = np.array(state, dtype=np.uint64)
        y ^= (y >> np.uint64(29)) & np.uint64(0x5555555555555555)
        y ^= (y << np.uint64(17)) & np.uint64(0x71D67FFFEDA60000)
        y ^= (y << np.uint64(37)) & np.uint64(0xFFF7EEE000000000)
        out.append(y ^ (y >> np.uint64(43)))
    return np.concatenate(out)[: chunks * 65536].reshape(chunks, 65536)


def tabulation(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of unsigned 64-bit keys, in 16-bit chunks from the low end."""
    tables, out = mersenne_tables(seed, 4), np.zeros(len(keys), dtype=np.uint64)
    for i in range(4):
        out ^= tables[i][(keys >> np.uint64(16 * i)) & np.uint64(0xFFFF)]
    return out


def tabulation_bytes(matrix: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of byte strings of an even length, in 16-bit chunks from the first bytes on."""
    rows, n = matrix.shape
    if n % 2:
        raise ValueError("tabulation takes an even number of bytes")
    tables, out = mersenne_tables(seed, max(4, n // 2)), np.zeros(rows, dtype=np.uint64)
    for i in range(n // 2):
        out ^= tables[i][words(matrix, 2 * i, 2)]
    return out


@F.pandas_udf(T.LongType())
def bob_hash(data: pd.Series) -> pd.Series:
    return by_length(data, lambda x: lookup3(x)[0].astype(np.int64))


@F.pandas_udf(T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))
def bob_hash_pair(data: pd.Series) -> pd.DataFrame:
    both = by_length(data, lambda x: list(zip(*(h.astype(np.int64) for h in lookup3(x)), strict=True)))
    return pd.DataFrame({"h1": [None if v is None else v[0] for v in both], "h2": [None if v is None else v[1] for v in both]})


@F.pandas_udf(T.LongType())
def superfast_hash(data: pd.Series) -> pd.Series:
    return by_length(data, lambda x: superfast(x).astype(np.int64))


@F.pandas_udf(T.LongType())
def murmur64a_binary(data: pd.Series) -> pd.Series:
    return by_length(data, lambda x: murmur64a_bytes(x).view(np.int64))


@F.pandas_udf(T.LongType())
def murmur32_binary(data: pd.Series) -> pd.Series:
    return by_length(data, lambda x: murmur32_bytes(x).astype(np.int64))


@F.pandas_udf(T.LongType())
def tabulation_binary(data: pd.Series) -> pd.Series:
    return by_length(data, lambda x: tabulation_bytes(x).view(np.int64))


@F.pandas_udf(T.LongType())
def tabulation_hash(keys: pd.Series) -> pd.Series:
    return pd.Series(tabulation(keys.to_numpy(np.int64).view(np.uint64)).view(np.int64))
