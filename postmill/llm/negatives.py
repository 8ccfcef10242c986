"""Hard negatives of anchors: exact integer scores by Strassen's multiplication.

Rows are packed into tiles of int64 components.  Spark pairs every tile of
anchors with every tile of candidates on a grid of cells (a stated query set
against all rows): an anchor tile is copied once per column of the grid, a
candidate tile once per row.  A task multiplies the pairs of tiles that it gets
and keeps the best rows of each anchor, emitting them when it holds many; what
tasks kept merges by rank.  A first round finds positives, a second one the
negatives in the window below each positive's score.

All sums are modulo 2^64 or proven below 2^53, so scores are exact; vectors
whose scores could reach 2^55 are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.session import written

#: Rows of a tile of anchors and of candidates, and the side below which Strassen's recursion ends.
ANCHORS, CANDIDATES, LEAF = 512, 2048, 32
#: Anchor tiles in a row of the grid, candidate tiles in a column, rows that one task packs into tiles.
GRID_ROW, GRID_COLUMN, PACKED = 16, 8, 1 << 15
#: Best rows that a task holds before it hands them on.
HELD = 1 << 18
#: Float sums below this are exact; scores from here on are refused (a hundred times as much fits into 64 bits).
EXACT, LARGEST = 2.0**53, 2.0**55


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer product of leaves: by floats where no sum can leave their exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def _padded(x: np.ndarray) -> np.ndarray:
    """Rows and columns filled with zeros up to even numbers."""
    return np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) if x.shape[0] % 2 or x.shape[1] % 2 else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices with seven multiplications of their quarters, recursively."""
    if min(a.shape[0], a.shape[1], b.shape[1]) <= leaf:
        return _product(a, b)
    rows, columns = a.shape[0], b.shape[1]
    a, b = _padded(a), _padded(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j], out[:i, j:] = m1 + m4 - m5 + m7, m3 + m5
    out[i:, :j], out[i:, j:] = m2 + m4, m1 - m2 + m3 + m6
    return out[:rows, :columns]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both tiles; the shorter rows are filled with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    longest = [float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0))) for x in (a, b)]
    if longest[0] * longest[1] >= LARGEST:
        raise OverflowError("inner products of 2^55 or more; scale the vectors down")
    return strassen(a, b.T)


def quantized(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, label, q`` of the rows that take part."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    out = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
    return out.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(scale * x.cast("double"))).alias("q"))


_TILE = "ids binary, labels binary, q binary"


def _tiles(rows: DataFrame, size: int, part: int, least: int = 1) -> tuple[DataFrame, int]:
    """Rows packed into tiles, ids rising within each; ``group`` deals the tiles into groups of about ``part``, ``least`` groups if there are as many tiles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, size):
                slice_ = b.slice(lo, size)
                ids, q = slice_.column("id").to_numpy(), slice_.column("q")
                n = q.value_lengths().to_numpy()
                matrix = np.zeros((n.size, int(n.max(initial=0))), np.int64)
                matrix[np.arange(matrix.shape[1]) < n[:, None]] = q.flatten().to_numpy()
                order = np.argsort(ids, kind="stable")
                columns = ids[order], slice_.column("label").to_numpy()[order], matrix[order]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["ids", "labels", "q"])

    tiles = written(rows.repartition(max(1, -(-rows.count() // PACKED))).mapInArrow(pack, _TILE), "tiles")
    n = tiles.count()
    groups = max(1, -(-n // part), min(n, least))
    return tiles.withColumn("group", F.pmod(F.xxhash64("ids", "q"), F.lit(groups)).cast("int")), groups


class _Tile:
    def __init__(self, row: dict, prefix: str):
        self.ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
        self.labels = np.frombuffer(row[f"{prefix}labels"], np.int64)
        self.q = np.frombuffer(row[f"{prefix}q"], np.int64).reshape(self.ids.size, -1)


class _Heaps:
    """The best ``k`` (score, id) of each key of a tile so far: larger scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(key.size) - np.repeat(first, np.diff(np.append(first, key.size)))
        self.key, self.score, self.id = (x[place < self.k] for x in (key, score, ids))


def _leading(allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first ``k`` allowed entries of each row."""
    return np.nonzero(allowed & (np.cumsum(allowed, axis=1, dtype=np.int32) <= k))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and id of every row of a tile."""
    for b in batches:
        for raw in b.column("ids").to_pylist():
            ids = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([raw] * ids.size, pa.binary()), pa.array(np.arange(ids.size, dtype=np.int32)), pa.array(ids)], ["ids", "number", "anchor"])


def _grid(anchors: DataFrame, rows: int, candidates: DataFrame, columns: int) -> DataFrame:
    """Every tile of anchors with every tile of candidates, met in their cell of the grid."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "group"), F.col("group").alias("row"), each(columns).alias("column"))
    c = candidates.select(*(F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "q")), F.col("group").alias("column"), each(rows).alias("row"))
    # little data, much work: as many tasks as cells, not as bytes suggest
    return c.repartition(rows * columns, "row", "column").join(a.repartition(rows * columns, "row", "column").hint("merge"), ["row", "column"])


def _kept(pairs: DataFrame, k: int, choose: Callable) -> DataFrame:
    """What ``choose`` puts into the heaps of the anchor tiles for all pairs of tiles, as ``anchor, place, score, id``.

    A key of a heap is an anchor's number in its tile times 256 plus the place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[bytes, _Heaps] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for h in heaps.values():
                place = pa.array((h.key % 256).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(h.ids[h.key // 256]), place, pa.array(h.score), pa.array(h.id)], ["anchor", "place", "score", "id"])
            heaps.clear()

        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].as_py() for name in b.schema.names}
                a = _Tile(row, "a_")
                choose(row, a, _Tile(row, "c_"), heaps.setdefault(row["a_ids"], _Heaps(a.ids, k)))
                if sum(h.key.size for h in heaps.values()) > HELD:
                    yield from out()
        yield from out()

    found = pairs.mapInArrow(run, "anchor long, place int, score long, id long")
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of floor(``scale`` x) of all components.  An
    anchor's positives (255 at most) are its best ``positives`` other rows of
    its label; the negatives of a positive its best ``negatives`` rows of other
    labels with ``low`` to ``high`` percent of the positive's score (none where
    that is negative).  Ties go to the smaller id.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part.  Shorter vectors are filled with zeros; scores that
    could reach 2^55 raise ``OverflowError``.  Repeated rows each count as
    candidates, but no row of an anchor's id is its positive; rows that repeat an
    anchor's id are one anchor (of unequal ones the smallest label, then vector).
    An empty table gives no rows; further columns are ignored.
    """
    rows = written(quantized(vectors, id_col, label_col, vector_col, scale), "rows")
    asked = quantized(vectors.where(is_anchor), id_col, label_col, vector_col, scale).groupBy("id").agg(F.min(F.struct("label", "q")).alias("row"))
    anchors, grid_rows = _tiles(written(asked.select("id", "row.label", "row.q"), "rows"), ANCHORS, GRID_ROW)
    candidates, grid_columns = _tiles(rows, CANDIDATES, GRID_COLUMN, vectors.sparkSession.sparkContext.defaultParallelism)

    def positive(row: dict, a: _Tile, c: _Tile, heaps: _Heaps) -> None:
        score = scores(a.q, c.q)
        order = np.argsort(-score, axis=1, kind="stable")  # ids rise within a tile
        same = (a.labels[:, None] == c.labels) & (a.ids[:, None] != c.ids)
        i, j = _leading(np.take_along_axis(same, order, 1), positives)
        j = order[i, j]
        heaps.add(i * 256, score[i, j], c.ids[j])

    best = _kept(_grid(anchors, grid_rows, candidates, grid_columns), positives, positive)
    best = written(best.select("anchor", F.col("rank").alias("place"), "score", "id"), "positives")
    # the windows of an anchor tile come as one row: at most ANCHORS times positives
    windows = anchors.select("ids").mapInArrow(_places, "ids binary, number int, anchor long").join(best, "anchor").groupBy("ids").agg(*(F.collect_list(x).alias(f"w_{x}") for x in ("number", "place", "score")))

    def negative(row: dict, a: _Tile, c: _Tile, heaps: _Heaps) -> None:
        number, place, most = (np.array(row[f"a_w_{x}"], np.int64) for x in ("number", "place", "score"))
        score = scores(a.q, c.q)
        order = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, order, 1)
        other = np.take_along_axis(a.labels[:, None] != c.labels, order, 1)
        for p in range(1, positives + 1):
            n, bound = number[place == p], most[place == p, None]
            # the window in whole numbers: low * bound <= 100 * score <= high * bound
            allowed = other[n] & (score[n] >= -(-low * bound // 100)) & (score[n] <= high * bound // 100)
            i, j = _leading(allowed, negatives)
            heaps.add(n[i] * 256 + p, score[n[i], j], c.ids[order[n[i], j]])

    found = _kept(_grid(anchors.join(windows, "ids"), grid_rows, candidates, grid_columns), negatives, negative)
    found = found.withColumnsRenamed({"score": "negative_score", "id": "negative_id"})
    best = best.withColumnsRenamed({"score": "positive_score", "id": "positive_id"})
    return found.join(best, ["anchor", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
