"""Hashes of visitors, and a seeded generator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(text: str) -> str:
    """Over the low byte of each UTF-16 unit, as a decimal string (64 bits unsigned)."""
    h = FNV_OFFSET
    for low in text.encode("utf-16-le")[::2]:
        h = (h ^ low) * FNV_PRIME % (1 << 64)
    return str(h)


@F.pandas_udf(T.StringType())
def fnv1a64_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fnv1a64(x))


def visitor_hash(ip: Column, agent: Column, ts: Column) -> Column:
    """Stable within one UTC day, different on the next."""
    return fnv1a64_udf(F.concat_ws("|", ip, F.substring(agent, 1, 32), F.date_format(ts, "yyyy-MM-dd")))


def lcg(seed: int):
    """Linear congruential generator of numbers in [0, 1)."""
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) % (1 << 32)
        yield state / (1 << 32)
