"""Callers' columns by place, so that no name of theirs can clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_place(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 and so on; operators use no such names."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def place(docs: DataFrame, name: str) -> str:
    """The name by place of a column of docs; cases of letters don't count, unless they tell two columns apart."""
    if name in docs.columns:
        return f"c{docs.columns.index(name)}"
    return f"c{[c.lower() for c in docs.columns].index(name.lower())}"


def restored(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by their own names again."""
    return placed.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)
