"""Word differences by longest common subsequence, as Arrow UDFs (texts are short)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("changed", T.BooleanType())]))
STATS = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("shared", "substitutions", "extras")), T.StructField("shared_ratio", T.DoubleType())])


def normal(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F).lower()
    return re.sub(" +", " ", re.sub(r"[^a-z0-9' ]+", " ", plain.replace("‘", "'").replace("’", "'"))).strip()


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of non-empty words."""
    length = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, word in enumerate(reversed(a), 1):
        same = np.array([word == w and word != "" for w in reversed(b)], bool)
        for j in range(1, len(b) + 1):
            length[i, j] = length[i - 1, j - 1] + 1 if same[j - 1] else max(length[i - 1, j], length[i, j - 1])
    length = length[::-1, ::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b) and length[i, j]:
        if a[i] == b[j] and a[i]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length[i + 1, j] >= length[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(source: str, target: str) -> list[dict]:
    words = target.split()
    norms = [normal(w) for w in words]
    kept = {j for _, j in matches([normal(w) for w in source.split()], norms)}
    return [{"word": w, "changed": k not in kept and norms[k] != ""} for k, w in enumerate(words)]


def stats(a: str, b: str) -> dict:
    x, y = ([n for n in map(normal, t.split()) if n] for t in (a, b))
    shared = len(matches(x, y))
    longest = max(len(x), len(y))
    return {
        "shared": shared,
        "substitutions": min(len(x), len(y)) - shared,
        "extras": abs(len(x) - len(y)),
        "shared_ratio": shared / longest if longest else 1.0,
    }


@F.pandas_udf(WORDS)
def align_words(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([align(a or "", b or "") for a, b in zip(source, target)])


@F.pandas_udf(STATS)
def diff_stats(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stats(x or "", y or "") for x, y in zip(a, b)], columns=["shared", "substitutions", "extras", "shared_ratio"])


def near_miss(d) -> F.Column:
    """Whether a difference looks like a line half remembered."""
    return d["substitutions"].between(1, 3) & (d["extras"] <= 2) & (d["shared_ratio"] >= 0.6)
