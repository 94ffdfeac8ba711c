"""Feature hashing with a sign: the low 64 bits of murmur3 x64 128 of the name's UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import sendable

_MASK = (1 << 64) - 1
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _rotate(x: int, r: int) -> int:
    return (x << r | x >> 64 - r) & _MASK


def _finish(k: int) -> int:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ k >> 33) * m & _MASK
    return k ^ k >> 33


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """Both 64-bit halves."""
    h1 = h2 = seed
    whole = len(data) - len(data) % 16
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 ^= _rotate(k1 * _C1 & _MASK, 31) * _C2 & _MASK
        h1 = (_rotate(h1, 27) + h2) * 5 + 0x52DCE729 & _MASK
        h2 ^= _rotate(k2 * _C2 & _MASK, 33) * _C1 & _MASK
        h2 = (_rotate(h2, 31) + h1) * 5 + 0x38495AB5 & _MASK
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= _rotate(int.from_bytes(tail[8:], "little") * _C2 & _MASK, 33) * _C1 & _MASK
    if tail:
        h1 ^= _rotate(int.from_bytes(tail[:8], "little") * _C1 & _MASK, 31) * _C2 & _MASK
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = h1 + h2 & _MASK
    h2 = h2 + h1 & _MASK
    h1, h2 = _finish(h1), _finish(h2)
    h1 = h1 + h2 & _MASK
    return h1, h2 + h1 & _MASK


@lru_cache(1 << 18)
def bucket_and_sign(name: str, seed: int, buckets: int) -> tuple[int, float]:
    h = murmur3_128(name.encode(), seed)[0]
    return (h & 0x7FFFFFFF) % buckets, 1.0 if h >> 40 & 1 else -1.0


def hash_features(exploded: DataFrame, buckets: int, seed: int = 0, prefix: str = "hash_", keys: tuple = ("sample_id",)) -> DataFrame:
    """keys, feature, value: names hashed to prefix + bucket; values that meet, signed, are summed.

    Only distinct names go through Python; the sum is a partial aggregate on the JVM.
    """

    @F.pandas_udf("bucket long, sign double")
    def split(names: pd.Series) -> pd.DataFrame:
        got = [bucket_and_sign(n, seed, buckets) for n in names]
        return pd.DataFrame({"bucket": [b for b, _ in got], "sign": [s for _, s in got]})

    names = exploded.select("feature").distinct().withColumn("h", split("feature"))
    got = exploded.join(sendable(names, "names"), "feature").select(*keys, F.concat(F.lit(prefix), F.col("h.bucket").cast("string")).alias("feature"), (F.col("value") * F.col("h.sign")).alias("value"))
    return got.groupBy(*keys, "feature").agg(F.sum("value").alias("value"))
