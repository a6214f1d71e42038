"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import by_place, place, restored
from .scratch import Scratch

MIN_CHARS = 20
MIN_DOCS = 3
SPACE = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _halves(key: bytes) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(key)
    return (n >> 64) - (1 << 63), (n & ((1 << 64) - 1)) - (1 << 63)


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _explode(min_chars: int):
    """(doc_id, text) -> the 128-bit key hash, document and position of each line long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, ids, at = [], [], [], []
            for doc, text in zip(batch.column(0), _binary(batch.column(1))):
                body = text.as_py()
                if not body or not doc.is_valid:
                    continue
                doc = doc.as_py()
                for k, line in enumerate(body.split(b"\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars and code_points(key) >= min_chars:
                        a, b = _halves(key)
                        h1.append(a), h2.append(b), ids.append(doc), at.append(k)
                if len(h1) >= 1 << 18:
                    yield _rows(h1, h2, ids, at)
                    h1, h2, ids, at = [], [], [], []
            yield _rows(h1, h2, ids, at)

    return run


def _rows(h1, h2, ids, at) -> pa.RecordBatch:
    arrays = [pa.array(np.array(x, np.int64)) for x in (h1, h2, ids)] + [pa.array(np.array(at, np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "doc", "pos"])


def _rebuild(text_at: int, drops_at: int, names: list[str]):
    """Put each text together again, by position, without the lines to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(_binary(batch.column(text_at)), batch.column(drops_at)):
                lines = (text.as_py() or b"").split(b"\n")
                out = set()
                for d in drops.as_py() or ():
                    if d["pos"] < len(lines) and _halves(line_key(lines[d["pos"]])) == (d["h1"], d["h2"]):
                        out.add(d["pos"])
                n_lines.append(len(lines)), n_dropped.append(len(out))
                texts.append(b"\n".join(x for k, x in enumerate(lines) if k not in out) if out else b"\n".join(lines))
            carried = [c for k, c in enumerate(batch.columns) if k not in (text_at, drops_at)]
            new = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(carried + new, names)

    return run


def _deduped(placed: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """placed (columns by place) with the kept text, and n_lines and n_dropped."""
    scratch = Scratch(placed.sparkSession, "lines")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "doc")] + [T.StructField("pos", T.IntegerType())])
    lines = placed.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(_explode(min_chars), schema)
    # the one-row-a-key sides are written, so that a key with very many lines can be split in the joins
    often = scratch.keep(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "often")
    hits = scratch.keep(lines.join(often, ["h1", "h2"]), "hits")  # far fewer rows: lines met once are gone
    shared = hits.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("holder"))
    shared = scratch.keep(shared.where(F.col("n_docs") >= min_docs).select("h1", "h2", "holder"), "shared")
    drops = hits.join(shared, ["h1", "h2"]).where("doc <> holder").groupBy("doc").agg(F.collect_set(F.struct("pos", "h1", "h2")).alias("drops"))
    joined = placed.withColumn(text, F.col(text).cast("string")).join(drops, F.col(doc_id).cast("long") == F.col("doc"), "left").drop("doc")
    fields = [f for f in placed.schema.fields if f.name != text]
    fields += [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return joined.mapInArrow(_rebuild(placed.columns.index(text), len(placed.columns), [f.name for f in fields]), T.StructType(fields))


def dedup_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Per row of docs: doc_id, the kept text, n_lines and n_dropped.

    A key of min_chars code points or more in min_docs documents or more loses
    its lines everywhere but in the largest doc_id that holds it. A null text
    counts as one empty line and comes back empty. Rows with a null doc_id are
    no document: they count for nothing and lose nothing. Rows that repeat a
    doc_id are one document in the counts; each is rebuilt from its own lines.
    An empty table gives an empty result; other columns are not read.
    """
    plain = docs.select(doc_id, text).toDF("c0", "c1")
    return _deduped(plain, "c0", "c1", min_chars, min_docs).select(F.col("c0").alias("doc_id"), F.col("c1").alias("text"), "n_lines", "n_dropped")


def drop_shared_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs, which may have any names, with the kept texts."""
    return restored(_deduped(by_place(docs), place(docs, doc_id), place(docs, text)), docs)
