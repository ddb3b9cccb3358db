"""32-bit integer functions as column expressions: random numbers, mixers, bloom positions, buckets, packed row ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Constants of the generator, the mixers and the bucket hash, and the packing factor of row ids.
RNG_STEP = 0x6D2B79F5
GOLDEN = 0x9E3779B9
MIX = (0x27D4EB2D, 0x165667B1, 0x2545F491)
BUCKET = (0x85EBCA6B, 0xC2B2AE35)
SLOTS = 4096


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def s32(x: Column) -> Column:
    """The signed value of an unsigned 32-bit number."""
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def mul32(a: Column, b: Column | int) -> Column:
    """Low 32 bits of a product; two 16-bit halves, so that no step leaves 64 bits."""
    b = F.lit(b) if isinstance(b, int) else b
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return u32(low + high)


def xor_shift(h: Column, bits: int) -> Column:
    return h.bitwiseXOR(F.shiftright(h, bits))


def random_unit(seed: int, ordinal: Column) -> Column:
    """The (ordinal + 1)-th number in [0, 1) of the generator; a function of the ordinal, so any row can be drawn alone."""
    state = u32(F.lit(seed & MASK) + mul32(u32(ordinal + 1), RNG_STEP))
    t = mul32(xor_shift(state, 15), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR(u32(t + mul32(xor_shift(t, 7), t.bitwiseOR(F.lit(61)))))
    return xor_shift(t, 14) / float(1 << 32)


def random_int(seed: int, ordinal: Column, low: int, high: int) -> Column:
    return F.lit(low) + F.floor(random_unit(seed, ordinal) * (high - low + 1))


def random_pick(seed: int, ordinal: Column, words: tuple[str, ...]) -> Column:
    """One of the words for each draw."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (random_int(seed, ordinal, 0, len(words) - 1) + 1).cast("int"))


def shuffled(seed: int, items: list) -> list:
    """A permutation by the generator, from the end; each step depends on the one before, so it is for short lists on the driver."""
    out, state = list(items), seed & MASK
    for i in range(len(out) - 1, 0, -1):
        state = (state + RNG_STEP) & MASK
        t = ((state ^ state >> 15) * (state | 1)) & MASK
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & MASK)) & MASK
        j = ((t ^ t >> 14) & MASK) * (i + 1) >> 32
        out[i], out[j] = out[j], out[i]
    return out


def mix32(x: Column) -> Column:
    h = mul32(u32(x).bitwiseXOR(F.lit(MIX[0])), MIX[1])
    return xor_shift(mul32(xor_shift(h, 15), MIX[2]), 13)


def bucket_of(key: Column, buckets: int) -> Column:
    h = mul32(u32(key).bitwiseXOR(F.lit(GOLDEN)), BUCKET[0])
    h = xor_shift(mul32(xor_shift(h, 13), BUCKET[1]), 16)
    return F.abs(s32(h)) % buckets


def bloom_shape(expected: int, bits_per_key: float) -> tuple[int, int]:
    """(bits, hash functions)."""
    import math

    return max(8, math.ceil(max(1, expected) * max(1, bits_per_key))), min(8, max(1, math.floor(bits_per_key * 0.6931 + 0.5)))


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """Array of bit positions; the second hash is signed, as its lowest bit is set by a signed operation."""
    both = F.struct(mix32(key).alias("a"), s32(mix32(u32(key).bitwiseXOR(F.lit(GOLDEN))).bitwiseOR(F.lit(1))).alias("b"))
    return F.flatten(F.transform(F.array(both), lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.abs((h["a"] + i * h["b"]) % bits))))


def bloom_false_positive_rate(bits_per_key: Column) -> Column:
    k = F.greatest(F.lit(1.0), F.floor(bits_per_key * 0.6931 + 0.5))
    return F.pow(1 - F.exp(-k / bits_per_key), k)


def pack_tid(block: Column, slot: Column) -> Column:
    return block * SLOTS + slot


def unpack_tid(tid: Column) -> Column:
    return F.struct(F.floor(tid / SLOTS).alias("block"), (tid % SLOTS).cast("int").alias("slot"))


def random_keys(spark: SparkSession, count: int, seed: int, most: int | None = None) -> DataFrame:
    """(ordinal, key): `count` keys in 1..most, most defaulting to max(10 * count, 1000)."""
    top = most or max(count * 10, 1000)
    return spark.range(count).select(F.col("id").alias("ordinal"), random_int(seed, F.col("id"), 1, top).alias("key"))
