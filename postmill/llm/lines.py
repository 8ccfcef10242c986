"""Line dedup: lines that many documents share stay in one of them.

Two Bloom filters (see ``bloom``) tell which line keys may occur twice.  Only
those are shuffled; there they are counted exactly and the document that keeps
the line is chosen.  The texts are joined once with the keys they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import bloom
from postmill.session import written

BLANKS = " \t\n\v\f\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit key of a stripped line with A-Z lower-cased; None if it is too short."""
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


def _document_keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or "").split("\n") if (k := line_key(line, min_chars))}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop repeated lines: ``id, n_lines, n_dropped, text``.

    A key (line stripped of ASCII white space, A-Z lower-cased) of at least
    ``min_chars`` code points found in at least ``min_docs`` documents loses all
    its lines but those of the largest id holding it.  Other lines stay, joined
    by newlines.

    Null or empty text: one empty line, nothing dropped, empty text.  Rows that
    share an id are one document for the counts and each gets its own result
    row.  Rows without an id keep all lines and are not counted.  An empty
    table gives an empty result; further columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = docs.where("id IS NOT NULL")
    n_lines = known.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = bloom.filter_bits(n_lines)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return bloom.partial_blocks((_hashes(list(_document_keys(t, min_chars))) for b in batches for t in b["text"]), bits)

    twice = docs.sparkSession.sparkContext.broadcast(bloom.twice_filter(known.select("text").mapInPandas(blocks, bloom.SCHEMA), bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [list(_document_keys(t, min_chars)) for t in b.column("text").to_pylist()]
            keys = [k for s in sets for k in s]
            rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            hit = np.flatnonzero(bloom.suspects(_hashes(keys), twice.value)) if keys else []
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows[hit])), pa.array([keys[i] for i in hit], pa.binary())], ["id", "key"])

    id_type = docs.schema["id"].dataType.simpleString()
    found = written(known.mapInArrow(suspected, f"id {id_type}, key binary"), "line-suspects")
    repeats = found.groupBy("key").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    repeats = written(repeats.select("key", "keeper"), "line-repeats")  # as a table of its own, so that the join below can split a frequent key
    lost = found.join(repeats, "key").where("id <> keeper").groupBy("id").agg(F.collect_set("key").alias("lost"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, dropped, texts = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("lost").to_pylist()):
                lines = (text or "").split("\n")
                stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone and (gone := set(gone)) else lines
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
                texts.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["id", "n_lines", "n_dropped", "text"])

    out = docs.join(lost, "id", "left").mapInArrow(kept, f"id {id_type}, n_lines long, n_dropped long, text string")
    return out.withColumnRenamed("id", id_col)
