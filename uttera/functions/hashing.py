"""Hash expressions: split hash, feature keys, deterministic order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from uttera.config import FrontendConfig

TWO_64 = 18446744073709551616.0


def unit_hash(c: Column, seed: int) -> Column:
    """First 64 bits of sha256("seed:value") as a double in [0, 1)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), c), 256)
    bits = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return bits / F.lit(TWO_64)


def order_hash(c: Column, seed: int | str) -> Column:
    """Seeded pseudo-random order that any engine can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c), 256)


def frontend_hash(config: FrontendConfig) -> str:
    return hashlib.sha256(config.describe().encode()).hexdigest()[:12]


def cache_key(utterance_id: Column, config: FrontendConfig) -> Column:
    return F.sha2(F.concat(utterance_id, F.lit(f":{frontend_hash(config)}")), 256)


def shard_index(key: Column, shards: int = 64) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
