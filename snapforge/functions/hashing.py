"""Stable 64-bit hashes: XXH3, seed 0, over canonical bytes.

Integers are 8 bytes, signed, little-endian; strings are UTF-8; bytes are as they are. Digests are
unsigned, so shards are taken by unsigned remainder. Spark's own xxhash64 is another function, and
ANSI arithmetic forbids wrapping products in Columns, so these are Arrow functions: closed form in
numpy for integers, the library for the distinct values of a batch otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from snapforge.errors import ConfigError

#: Fixed values of the 8-byte case of XXH3 with seed 0.
XXH3_SECRET_MIX = 0xC73AB174C5ECD5A2
XXH3_PRIME = 0x9FB21C651E98DF25


def hash_integers(keys: np.ndarray) -> np.ndarray:
    """XXH3 of 64-bit integers as unsigned digests. Products wrap."""
    u = np.uint64
    k = keys.astype(np.int64).view(u)
    x = ((k >> u(32)) + (k << u(32))) ^ u(XXH3_SECRET_MIX)
    turn = lambda v, n: (v << u(n)) | (v >> u(64 - n))
    x = x ^ turn(x, 49) ^ turn(x, 24)
    x = x * u(XXH3_PRIME)
    x = x ^ ((x >> u(35)) + u(8))
    x = x * u(XXH3_PRIME)
    return x ^ (x >> u(28))


def canonical_bytes(key: int | str | bytes) -> bytes:
    if isinstance(key, int):
        if not -(1 << 63) <= key < 1 << 63:
            raise ConfigError(f"the key {key} is not a 64-bit integer")
        return key.to_bytes(8, "little", signed=True)
    if isinstance(key, str):
        return key.encode("utf-8")
    if isinstance(key, (bytes, bytearray)):
        return bytes(key)
    raise TypeError(f"keys are integers, strings or bytes, not {type(key).__name__}")


def digest(key: int | str | bytes) -> int:
    """The digest of one key, unsigned."""
    return xxhash.xxh3_64_intdigest(canonical_bytes(key))


def shard_of(key: int | str | bytes, n: int) -> int:
    return digest(key) % n


def digests(column: pa.Array) -> np.ndarray:
    """Unsigned digests of a batch; 0 where it is null."""
    if pa.types.is_integer(column.type) or pa.types.is_boolean(column.type):
        return hash_integers(pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(column)
    own = np.fromiter((xxhash.xxh3_64_intdigest(canonical_bytes(v)) for v in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    at = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)
    return own[at] if len(own) else np.zeros(len(column), np.uint64)


def _nulls(column: pa.Array) -> np.ndarray:
    return pc.is_null(column).to_numpy(zero_copy_only=False)


def hash_shard(key: Column, n: int) -> Column:
    """The shard from 0 to n - 1 of a key; null for a null key."""

    @F.arrow_udf("int")
    def shard(column: pa.Array) -> pa.Array:
        return pa.array((digests(column) % np.uint64(n)).astype(np.int32), mask=_nulls(column))

    return shard(key)


def hash_digest(key: Column) -> Column:
    """The digest as decimal(20, 0), which holds all unsigned 64-bit values; null for a null key."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array(digests(column).astype(str), pa.string(), mask=_nulls(column))

    return text(key).cast("decimal(20,0)")
