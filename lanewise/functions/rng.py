"""Reproducible streams: the combined multiple recursive generator MRG32k3a (L'Ecuyer), element i at the i-th jump of 2^127."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators.errors import EngineError
from lanewise.session import ship

#: Fixed values of MRG32k3a.
M1, M2 = 4294967087, 4294944443
A1 = [[0, 1, 0], [0, 0, 1], [-810728, 1403580, 0]]
A2 = [[0, 1, 0], [0, 0, 1], [-1370589, 0, 527612]]
SCALE = 2.328306549295727688e-10
#: Steps of a normal's first draw.
FINE = 1 << 27
_NORMAL = NormalDist()


def _mul(a, b, m):
    return [[sum(x * y for x, y in zip(r, c, strict=True)) % m for c in zip(*b, strict=True)] for r in a]


def _power(a, n, m):
    out = [[int(i == j) for j in range(3)] for i in range(3)]
    while n:
        if n & 1:
            out = _mul(out, a, m)
        a, n = _mul(a, a, m), n >> 1
    return out


J1, J2 = _power(A1, 1 << 127, M1), _power(A2, 1 << 127, M2)
#: Jumps by powers of two of streams, as far as an offset and an element reach.
_JUMPS = [(J1, J2)]


def jump(bit: int) -> tuple[list, list]:
    while len(_JUMPS) <= bit:
        a, b = _JUMPS[-1]
        _JUMPS.append((_mul(a, a, M1), _mul(b, b, M2)))
    return _JUMPS[bit]


def check_seed(seed) -> tuple[int, int]:
    """(seed, offset) of an integer or a pair."""
    parts = seed if isinstance(seed, (tuple, list)) else (seed,)
    if not 1 <= len(parts) <= 2 or any(isinstance(x, str) or x is None or x != x or x in (float("inf"), float("-inf")) or int(x) != x for x in parts):
        raise EngineError("a seed is one whole number, or that and an offset")
    s, k = int(parts[0]), int(parts[1]) if len(parts) == 2 else 0
    if abs(s) > 2**31 - 1 or not 0 <= k <= 2**53:
        raise EngineError("the seed or its offset is out of range")
    return s, k


def _signed(x: int) -> int:
    return x - (1 << 32) if x >= 1 << 31 else x


def base(seed: int) -> list[int]:
    s = seed % (1 << 32)
    step = lambda s: (69069 * s + 1) % (1 << 32)
    for _ in range(50):
        s = step(s)
    out = []
    for _ in range(6):
        s = step(s)
        while s >= M2:
            s = step(s)
        out.append(s)
    for k in (0, 3):
        if not any(out[k : k + 3]):
            out[k] = 1
    return [_signed(x) for x in out]


def seek(state: list[int], k: int) -> list[int]:
    """The state k streams further; seeking adds up."""
    s = [x % (1 << 32) for x in state]
    p, q = _power(J1, k, M1), _power(J2, k, M2)
    return [_signed(sum(a * b for a, b in zip(r, s[:3], strict=True)) % M1) for r in p] + [_signed(sum(a * b for a, b in zip(r, s[3:], strict=True)) % M2) for r in q]


def _apply(states: np.ndarray, jumps: tuple[list, list]) -> np.ndarray:
    """Columns of six words, each moved by the same jumps. A product of two words fits 64 bits, so each is reduced by itself."""
    out = np.empty_like(states)
    for half, (matrix, m) in enumerate(zip(jumps, (M1, M2), strict=True)):
        m = np.uint64(m)
        s = states[3 * half : 3 * half + 3]
        for i, row in enumerate(matrix):
            total = sum((s[j] * np.uint64(x) % m for j, x in enumerate(row) if x), np.zeros(s.shape[1], np.uint64))
            out[3 * half + i] = total % m
    return out


def many(state: list[int], ks: np.ndarray) -> np.ndarray:
    """The states ks streams further, as six columns. Numbers that follow one another take one step each from those before them: a run
    doubles until it is long enough; others are moved bit by bit, all at once."""
    words = np.array([[x % (1 << 32)] for x in state], np.uint64)
    n = len(ks)
    if n and (np.diff(ks) == 1).all():
        out = np.empty((6, n), np.uint64)
        out[:, :1] = np.array([[x % (1 << 32)] for x in seek(state, int(ks[0]))], np.uint64)
        have, bit = 1, 0
        while have < n:
            more = min(have, n - have)
            out[:, have : have + more] = _apply(out[:, :more], jump(bit))
            have, bit = have + more, bit + 1
    else:
        out = np.repeat(words, n, axis=1)
        for bit in range(int(ks.max()).bit_length() if n else 0):
            if (own := np.flatnonzero(ks >> bit & 1)).size:
                out[:, own] = _apply(out[:, own], jump(bit))
    return out


def signed_words(states: np.ndarray) -> np.ndarray:
    x = states.astype(np.int64)
    return np.where(x >= 1 << 31, x - (1 << 32), x)


def uniforms(states: np.ndarray) -> np.ndarray:
    """The first number of each stream, between 0 and 1."""
    s = states.astype(np.int64)
    p = (A1[2][0] * s[0] + A1[2][1] * s[1]) % M1
    q = (A2[2][0] * s[3] + A2[2][2] * s[5]) % M2
    return (p - q) % M1 * SCALE


def uniform(state: list[int]) -> float:
    return float(uniforms(np.array([[x % (1 << 32)] for x in state], np.uint64))[0])


class Stream:
    """The numbers of one element's stream, one after the other."""

    def __init__(self, state: list[int]):
        self.words = [x % (1 << 32) for x in state]

    def uniform(self) -> float:
        """Above 0 and below 1."""
        a, b, c, d, e, f = self.words
        p, q = (A1[2][0] * a + A1[2][1] * b) % M1, (A2[2][0] * d + A2[2][2] * f) % M2
        self.words = [b, c, p, e, f, q]
        return ((p - q) % M1 or M1) * SCALE

    def normal(self) -> float:
        """By inversion of the normal distribution function at a number of 27 bits and then as many as one draw has."""
        high = int(FINE * self.uniform())
        return _NORMAL.inv_cdf((high + self.uniform()) / FINE)

    def bits(self, n: int) -> int:
        """A whole number of n bits, 16 from each draw."""
        value = 0
        for _ in range(0, n + 1, 16):
            value = value << 16 | int(self.uniform() * 65536)
        return value & (1 << n) - 1

    def below(self, n: int) -> int:
        """A whole number from 0 to n - 1, each equally likely: numbers of as many bits as n takes are drawn until one is below it."""
        if n < 1:
            raise EngineError("there is no whole number from 0 to below 1")
        size = (n - 1).bit_length()
        while (value := self.bits(size)) >= n:
            pass
        return value


#: Bits of an element's number that one table of jumps stands for.
DIGIT = 8


def jumps(digit: int) -> list[tuple[int, ...]]:
    """(value, 18 entries of the two matrices) of the jumps by each value of a digit of an element's number."""
    one = jump(digit * DIGIT)
    at, rows = ([[int(i == j) for j in range(3)] for i in range(3)],) * 2, []
    for value in range(1 << DIGIT):
        rows.append((value, *(x for m in at for r in m for x in r)))
        at = _mul(at[0], one[0], M1), _mul(at[1], one[1], M2)
    return rows


_tables: dict[int, list] = {}


def _product(a, b, m: int):
    """a * b modulo m of two columns below 2^32: halves of 16 bits keep every product within 64 bits with a sign."""
    high, low = F.shiftright(a, 16), a.bitwiseAND(F.lit(65535).cast("long"))
    return (high * b % m * 65536 + low * b) % m


def native_streams(table: DataFrame, seed, bits: int = 53) -> DataFrame:
    """ix, state and u as streams() gives them, by column expressions alone: the element's number is taken digit by digit, and each digit's jump
    comes from a broadcast table of 2^DIGIT matrices. bits bounds the numbers, offset included; a greater one is an error."""
    s, offset = check_seed(seed)
    spark, first = table.sparkSession, [x % (1 << 32) for x in base(s)]
    k = F.col("ix") + F.lit(offset).cast("long")
    fits = F.when((k >= 0) & (k < F.lit(1 << bits).cast("long")), k).otherwise(F.raise_error(F.lit(f"an element's number is beyond {bits} bits")))
    out = table.select(F.col("ix").cast("long").alias("ix")).select("ix", fits.alias("_k"), *[F.lit(x).cast("long").alias(f"_s{j}") for j, x in enumerate(first)])
    entries = [f"_m{j}" for j in range(18)]
    for digit in range(-(-bits // DIGIT)):
        rows = _tables.setdefault(digit, jumps(digit))
        by = F.broadcast(spark.createDataFrame(rows, "_digit long, " + ", ".join(f"{e} long" for e in entries)))
        own = F.shiftrightunsigned("_k", digit * DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
        moved = []
        for half, m in enumerate((M1, M2)):
            for i in range(3):
                terms = [_product(F.col(f"_m{9 * half + 3 * i + j}"), F.col(f"_s{3 * half + j}"), m) for j in range(3)]
                moved.append(((terms[0] + terms[1] + terms[2]) % m).alias(f"_s{3 * half + i}"))
        out = out.withColumn("_own", own).join(by, F.col("_own") == F.col("_digit")).select("ix", "_k", *moved)
    a, b, d, f = (F.col(f"_s{j}") for j in (0, 1, 3, 5))
    # Of the two factors of a recurrence one is negative: it is added to its modulus first.
    p = (_product(F.lit(A1[2][0] % M1).cast("long"), a, M1) + _product(F.lit(A1[2][1]).cast("long"), b, M1)) % M1
    q = (_product(F.lit(A2[2][0] % M2).cast("long"), d, M2) + _product(F.lit(A2[2][2]).cast("long"), f, M2)) % M2
    signed = lambda c: F.when(c >= F.lit(1 << 31), c - F.lit(1 << 32)).otherwise(c)
    return out.select("ix", F.array(*[signed(F.col(f"_s{j}")) for j in range(6)]).alias("state"), (F.pmod(p - q, F.lit(M1).cast("long")).cast("double") * SCALE).alias("u"))


def streams(table: DataFrame, seed) -> DataFrame:
    """ix, state (six words) and the stream's first uniform number: a function of ix alone, whatever the partitions."""
    s, offset = check_seed(seed)
    first = base(s)
    ship(table.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                states = many(first, b.column(0).to_numpy() + offset)
                flat = pa.array(np.ascontiguousarray(signed_words(states).T).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * b.num_rows + 1, 6, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(uniforms(states))], names=["ix", "state", "u"])

    return table.select(F.col("ix").cast("long")).mapInArrow(run, "ix long, state array<long>, u double")
