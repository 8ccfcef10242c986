"""N-gram Jaccard join: size-aware heavy-light join of shingle sets.

Equal sets are one class.  Of every class only a prefix of its set is indexed:
the shingles that come first in one order shared by all sets, rare ones first
by a count sketch of the whole corpus.  Sets that link have one shingle in
common within prefixes of ``n - t + 1`` and two within ``n - t + 2``, where
``t = ceil(threshold * n)``.  Light (small) sets are keyed by all pairs of their
prefix, heavy (large) sets by inverted lists of its single shingles; the size
where one becomes dearer than the other is the boundary.

Large lists are not expanded into pairs.  First each set is compared only with
a leader of its lists, links join sets to components, and lists that lie in one
component are done.  Only pairs across the remaining components are compared.
Every comparison is an exact one of the whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.session import written

SKETCH_CELLS, SKETCH_BLOCK = 1 << 22, 1 << 16
#: Rounds of comparing with leaders before what is left is compared pair by pair.
ROUNDS = 3
#: Lists of pair keys longer than this are not joined; their sets are compared by single keys.
LONG = 64
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


_ODD = [(m << np.uint64(1)) | np.uint64(1) for m in _MIX]


class _Hashes(dict):
    """Word to 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[3]
    h = (h ^ (h >> np.uint64(27))) * _MIX[4]
    return h ^ (h >> np.uint64(31))


def shingles(raw: bytes | None, known: _Hashes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text.

    Words are separated by ASCII white space, A-Z lower-cased.  Fewer words than
    ``width`` make one shingle; no words make none.
    """
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        total += h[i : len(words) - size + 1 + i] * _ODD[i % len(_ODD)]
    return np.unique(_mixed(total))


def _heads(docs: DataFrame, width: int) -> DataFrame:
    """One pass: id, size and 128-bit signature of each set, and blocks of the count sketch (null id)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells = _Hashes(), np.zeros(SKETCH_CELLS, np.int64)
        names = ["id", "n", "s1", "s2", "block", "cells"]
        id_type = None
        for b in batches:
            id_type = b.column("id").type
            n, s1, s2 = [], [], []
            for x in b.column("raw").to_pylist():
                s = shingles(x, known, width)
                np.add.at(cells, (s >> np.uint64(42)).astype(np.int64), 1)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                s1.append(int.from_bytes(d[:8], "little", signed=True))
                s2.append(int.from_bytes(d[8:], "little", signed=True))
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32()), pa.array(s1), pa.array(s2), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if id_type is not None:
            full = [(i, c) for i in range(SKETCH_CELLS // SKETCH_BLOCK) if (c := cells[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK]).any()]
            none = pa.nulls(len(full))
            yield pa.RecordBatch.from_arrays(
                [none.cast(id_type), *(none.cast(t) for t in (pa.int32(), pa.int64(), pa.int64())), pa.array([i for i, _ in full], pa.int32()),
                 pa.array([zlib.compress(np.minimum(c, 65535).astype(np.uint16).tobytes(), 1) for _, c in full], pa.binary())], names)

    return docs.mapInArrow(make, f"id {docs.schema['id'].dataType.simpleString()}, n int, s1 long, s2 long, block int, cells binary")


def _counts(heads: DataFrame) -> np.ndarray:
    """The sketch of the whole corpus: SKETCH_CELLS counts."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, None
        for b in batches:
            done = []
            for block, raw in zip(b["block"], b["cells"]):
                c = np.frombuffer(zlib.decompress(raw), np.uint16).astype(np.int64)
                if block == last:
                    total += c
                else:
                    if last is not None:
                        done.append((last, zlib.compress(total.tobytes(), 1)))
                    last, total = block, c
            yield pd.DataFrame(done, columns=["block", "cells"])
        if last is not None:
            yield pd.DataFrame([(last, zlib.compress(total.tobytes(), 1))], columns=["block", "cells"])

    out = np.zeros(SKETCH_CELLS, np.int64)
    parts = heads.where("block IS NOT NULL").select("block", "cells").repartition("block").sortWithinPartitions("block")
    for row in parts.mapInPandas(add, "block int, cells binary").toLocalIterator():
        out[row["block"] * SKETCH_BLOCK : (row["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(row["cells"]), np.int64)
    return out


def boundary(sizes: list[tuple[int, int]], counts: np.ndarray, threshold: int) -> int:
    """Largest size of a light set: pairs of its prefix cost no more than scanning its lists.

    Cost counts rows: a light set writes all pairs of its prefix; a heavy set
    writes its prefix and meets as many rows again as its lists are long.  A list
    of the rare half of the shingles has the length that the sketch shows above
    its own noise, the mean count of a cell.
    """
    noise = counts.mean()
    lower = np.sort(counts[counts > 0])[: max(1, int((counts > 0).sum()) // 2)] if counts.any() else np.ones(1)
    length = max(1.0, float((lower * np.maximum(lower - noise, 1)).sum() / lower.sum()))
    best = 0
    for n, _ in sorted(sizes):
        p = n - _least(n, threshold)
        if (p + 2) * (p + 1) // 2 <= (p + 1) * (1 + length):
            best = n
    return best


def _least(n, threshold: int):
    return -(-threshold * n // 100)


def _keys(docs: DataFrame, levels, light: int, threshold: int, width: int) -> DataFrame:
    """Index rows ``key, node, n`` of the classes' first documents; ``light`` below 0: single keys of all."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = _Hashes(), levels.value
        for b in batches:
            keys, of = [], []
            want = list(zip(b.column("s1").to_pylist(), b.column("s2").to_pylist()))
            for r, x in enumerate(b.column("raw").to_pylist()):
                s = shingles(x, known, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                if (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) != want[r]:
                    continue  # another text with the same id
                n = len(s)
                p = n - _least(n, threshold)
                if p == 0 and _least(n + 1, threshold) > n:
                    continue  # no other set can be near enough
                first = s[np.argsort(level[(s >> np.uint64(42)).astype(np.int64)], kind="stable")[: p + 2]]
                made = []
                if n <= light:
                    i, j = np.triu_indices(len(first), 1)
                    made.append(_mixed(first[i] * _MIX[0] ^ _mixed(first[j] + _MIX[1])) | np.uint64(1))
                if 100 * n >= threshold * (light + 1):
                    made.append(first[: p + 1] & ~np.uint64(1))
                made = np.concatenate(made)
                keys.append(made.view(np.int64))
                of.append(np.full(len(made), r))
            at = pa.array(np.concatenate(of) if of else [], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), b.column("id").take(at), b.column("n").take(at)], ["key", "node", "n"])

    return docs.mapInArrow(make, f"key long, node {docs.schema['id'].dataType.simpleString()}, n int")


def _verified(pairs: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are near enough."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "compared")
    texts = docs.select("id", "raw").join(ids, "id", "left_semi")
    left, right = texts.toDF("a", "raw_a"), texts.toDF("b", "raw_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, seen = _Hashes(), None, None
        for b in batches:
            keep = []
            left, right = b.column("raw_a"), b.column("raw_b")
            for r in range(b.num_rows):
                x, y = shingles(left[r].as_py(), known, width), right[r].as_py()
                if y != last:
                    last, seen = y, shingles(y, known, width)
                both = len(np.intersect1d(x, seen, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(seen) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = docs.schema["id"].dataType.simpleString()
    near = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "raw_a", "raw_b").mapInArrow(check, f"a {kind}, b {kind}")
    return written(near, "links")


def _needed(threshold: int) -> str:
    """Single keys that two near sets share at least: what their prefixes leave is shorter than the overlap by as many."""
    return f"(ceil({threshold} * (n_a + n_b) / {100 + threshold}) - greatest(ceil({threshold} * n_a / 100), ceil({threshold} * n_b / 100)) + 1)"


def _pairs_across(here: DataFrame, single_of, threshold: int) -> DataFrame:
    """Pairs ``a, b`` of different components that share enough keys of ``here`` (``key, node, n, own``).

    Short lists of pair keys are joined.  Sets in long ones (many pages of one
    template) are compared by their single keys, ``single_of`` the sets, like
    heavy sets: a near pair shares a needed number of these.  Let every set order
    its keys by the length of their lists: the first key that the pair shares
    then has that many keys of either set at or behind it.  So a list is joined
    only for the sets in which it comes early enough for some size of partner
    that the list holds; which sets those are is found without pairing sets.
    """
    double = here.where("key & 1 = 1")
    lengths = written(double.groupBy("key").agg(F.count(F.lit(1)).alias("length")), "lengths")
    double = double.join(lengths, "key")
    crowded = written(double.where(F.col("length") > LONG).select("node", "own").distinct(), "crowded")
    single = here.where("key & 1 = 0").select("key", "node", "n", "own")
    if not crowded.isEmpty():
        single = single.unionByName(single_of(crowded).join(crowded, "node").select("key", "node", "n", "own")).distinct()
        across = single.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("key")
        single = written(single, "singles")
        single = single.join(written(across, "open"), "key", "left_semi")
    length = single.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    own_order = W.partitionBy("node").orderBy("length", "key")
    single = single.join(written(length, "lengths"), "key").withColumns(
        {"behind": F.count(F.lit(1)).over(W.partitionBy("node")) - F.row_number().over(own_order) + 1})
    single = written(single, "single-keys")

    def side(df: DataFrame, x: str, *more: str) -> DataFrame:
        return df.select("key", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "own", *more)))

    alike = f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)"
    apart = f"a < b AND own_a <> own_b AND {alike}"
    early = f"least(behind_a, behind_b) >= {_needed(threshold)}"
    # per list and size of set: how early it comes at best, and in which components
    partners = single.groupBy("key", F.col("n").alias("n_b")).agg(F.max("behind").alias("behind_b"), F.min("own").alias("low_b"), F.max("own").alias("high_b"))
    able = single.withColumnsRenamed({"n": "n_a", "behind": "behind_a"}).join(
        written(partners, "partners").withColumnRenamed("key", "_key"), F.expr(f"key = _key AND (own <> low_b OR own <> high_b) AND {alike} AND {early}"), "left_semi")
    able = written(able.withColumnsRenamed({"n_a": "n", "behind_a": "behind"}), "able")
    found = side(able, "a", "behind").join(side(able, "b", "behind"), "key").where(f"{apart} AND {early}").select("a", "b", "n_a", "n_b").distinct()
    keys = single.groupBy("node").agg(F.collect_set("key").alias("keys"))
    for x in "ab":
        found = found.join(keys.select(F.col("node").alias(x), F.col("keys").alias(f"keys_{x}")), x)
    found = found.where(f"size(array_intersect(keys_a, keys_b)) >= {_needed(threshold)}").select("a", "b")
    short = double.where(F.col("length") <= LONG)
    light = side(short, "a").join(side(short, "b"), "key").where(apart).select("a", "b")
    return found.unionByName(light).distinct()


def _enough(threshold: int):
    """Whether a pair shares enough single keys; pair keys are always worth a comparison."""
    return F.expr(f"light OR common >= {_needed(threshold)}")


def near_sets(docs: DataFrame, width: int = 3, threshold: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id``: documents linked by near shingle sets.

    Two documents link when ``100 * intersection >= threshold * union`` of their
    sets of ``width``-word shingles.  ``component_id`` is the smallest id
    reachable by links.  Sets hold 64-bit hashes of shingles.

    Null, empty and blank texts have an empty set and link with nothing.  Rows
    that share an id are one document with several texts: all are compared and
    get one component.  Rows without an id have no component.  An empty table
    gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    heads = written(_heads(docs, width), "sets")
    sets = heads.where("block IS NULL").select("id", "n", "s1", "s2")
    classes = sets.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("node"))
    classes = written(classes, "classes")
    sizes = classes.groupBy("n").count().where("n < 10000").collect()
    counts = _counts(heads)
    light = boundary([(r["n"], r["count"]) for r in sizes], counts, threshold)
    levels = spark.sparkContext.broadcast(np.minimum(np.log2(counts + 1) * 8, 255).astype(np.uint8))
    firsts = docs.join(classes.select(F.col("node").alias("id"), "n", "s1", "s2"), "id")
    keys = written(_keys(firsts, levels, light, threshold, width), "keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    lists = written(keys.join(written(shared, "shared"), "key").select("key", "node", "n", "lo", "hi"), "lists")

    links, found = None, None
    for turn in range(ROUNDS + 1):
        here = lists if found is None else lists.join(found, "node", "left")
        here = here.withColumn("own", F.coalesce("component", "node") if found is not None else F.col("node"))
        if turn:
            open_ = here.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("key")
            here = written(here.join(written(open_, "open"), "key", "left_semi"), "open-lists")
            if here.isEmpty():
                break
        if turn < ROUNDS:
            # leaders: the smallest and largest id, then the member that a hash of the round names
            if turn < 2:
                leader = here.select("key", "node", "n", "own", F.col("lo" if turn == 0 else "hi").alias("b"))
            else:
                pick = here.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("b"))
                leader = here.join(written(pick, "leaders"), "key").select("key", "node", "n", "own", "b")
            pairs = leader.where("node <> b").groupBy(F.col("node").alias("a"), "b", F.col("n").alias("n_a"), F.col("own").alias("own_a")).agg(
                F.count(F.lit(1)).alias("common"), F.max(F.expr("key & 1")).alias("bit"))
            sizes_b = classes.groupBy("node").agg(F.min("n").alias("least_b"), F.max("n").alias("n_b")).withColumnRenamed("node", "b")
            pairs = pairs.join(sizes_b, "b")
            if found is not None:
                pairs = pairs.join(found.select(F.col("node").alias("b"), F.col("component").alias("own_b")), "b", "left").where("own_a <> coalesce(own_b, b)")
            pairs = pairs.withColumn("light", F.col("bit") == 1).where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, least_b)").where(_enough(threshold))
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("common", F.xxhash64("b"))).alias("b"))
        else:
            pairs = _pairs_across(here, lambda nodes: _keys(firsts.join(nodes.select(F.col("node").alias("id")), "id", "left_semi"), levels, -1, threshold, width), threshold)
        new = _verified(written(pairs.select("a", "b"), "pairs"), docs, threshold, width)
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        found = written(components(links, rounds=1), "components")

    # documents of one class link, and so do texts of one id: both join the class's first document
    same = sets.where("n > 0 AND id IS NOT NULL").join(classes, ["s1", "s2", "n"]).select("id", "n", "node")
    several = same.groupBy("id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("id")
    bridges = several.join(same, "id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    if links is not None or not bridges.isEmpty():
        found = written(components(bridges if links is None else links.unionByName(bridges)), "components")
    out = sets.join(classes.select("s1", "s2", F.col("n").alias("n_class"), "node"), ["s1", "s2"], "left")
    if found is not None:
        out = out.join(found, "node", "left")
    else:
        out = out.withColumn("component", F.col("node"))
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "node")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
