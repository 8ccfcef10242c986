"""A JSON array of objects in one file, read by many tasks.

Spark cuts the file into splits and each split into pieces at closing braces.  A
split may begin anywhere, so what it begins in (a string, an object) is not
known to the task that reads it.  A first pass sums up, for either case, what a
split does to it; the sums of all splits in order, a row each, give every
split's true beginning.  The second pass puts pieces together to objects;
objects that cross the edges of splits leave a part in each of them and are
joined by a window over these few parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ESCAPED = re.compile(r"\\.", re.S)
_PLACE = "file string, block long"


def _walk(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and the objects that it opens less the one that its closing brace ends."""
    parts = _ESCAPED.sub("", piece).split('"')
    opened = sum(p.count("{") for p in parts[inside::2])
    inside ^= (len(parts) - 1) % 2 == 1
    return inside, opened - (not inside)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files in order within each split, without the closing brace."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and either beginning: whether it ends inside a string, and the change of depth."""
    known: dict[tuple, list] = {}
    for b in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in b.columns)):
            state = known.setdefault((file, block), [False, 0, True, 0])
            for k in (0, 2):
                state[k], step = _walk(piece, state[k])
                state[k + 1] += step
    rows = [(*at, *state) for at, state in known.items()]
    names = ["file", "block", "out_end", "out_depth", "in_end", "in_depth"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _beginnings(pieces: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """State at the beginning of every split: inside a string, depth.  One row per split reaches the driver."""
    effects = pieces.mapInArrow(_effects, f"{_PLACE}, out_end boolean, out_depth long, in_end boolean, in_depth long")
    out, file, inside, depth = {}, None, False, 0
    for r in sorted(effects.collect(), key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        out[file, r["block"]] = (inside, depth)
        inside, depth = (r["in_end"], depth + r["in_depth"]) if inside else (r["out_end"], depth + r["out_depth"])
    return out


def _objects(beginnings) -> callable:
    """Function from pieces to ``file, block, number, part, value``: whole objects, and the parts at a split's edges.

    ``part`` is null for a whole object, "tail" for one that the split begins and
    does not end, "head" for what belongs to an object begun before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, depth, held, begun, number = None, False, 0, [], False, 0

        def rest() -> list[tuple]:
            return [(*at, number, "tail" if begun else "head", "}".join(held) + "}")] if held else []

        for b in batches:
            rows: list[tuple] = []
            for file, block, piece in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != at:
                    rows += rest() if at else []
                    at, (inside, depth), held, number = (file, block), beginnings.value[file, block], [], 0
                    begun = not inside and depth == 0
                if not held and begun:
                    start = piece.find("{")
                    if start < 0:  # what follows the last object
                        continue
                    piece = piece[start:]
                held.append(piece)
                inside, step = _walk(piece, inside)
                depth += step
                if not inside and depth == 0:
                    rows.append((*at, number, None if begun else "head", "}".join(held) + "}"))
                    held, begun, number = [], True, number + 1
            yield _batch(rows)
        if at:
            yield _batch(rest())

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "number", "part", "value"])


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The objects of JSON arrays with the columns of ``schema``, and where they stood: ``file, block, number``.

    Ordered by these three the objects come in the order of the file.  The split
    size is Spark's (``spark.sql.files.maxPartitionBytes``).  Objects one after
    the other, without an array, are read as well.  An object that does not fit
    the schema has nulls where it does not.
    """
    pieces = _pieces(spark, path)
    beginnings = spark.sparkContext.broadcast(_beginnings(pieces))  # one row per split
    found = pieces.mapInArrow(_objects(beginnings), f"{_PLACE}, number long, part string, value string")
    whole, parts = found.where("part IS NULL"), found.where("part IS NOT NULL")
    in_order = W.partitionBy("file").orderBy("block", "number")  # two rows per split at most
    begun = F.last(F.when(F.col("part") == "tail", F.struct("block", "number")), ignorenulls=True).over(in_order)
    parts = parts.withColumn("of", begun).groupBy("file", "of.block", "of.number").agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), F.col("number").alias("n"), "value"))).alias("parts"))
    # every part but the last one has lost no brace: each piece ended with one
    joined = parts.select("file", "block", "number", F.array_join("parts.value", "").alias("value"))
    rows = whole.select("file", "block", "number", "value").unionByName(joined)
    return rows.select("file", "block", "number", F.from_json("value", schema).alias("row")).select("file", "block", "number", "row.*")
