"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The target words of each source are a quota.  The quotas are cut into equal
output shards by a binary tree: at each node the left half draws its words of
every source without replacement, so that every shard gets an exact share of
every source and the shares add up to the quotas.  Each source's documents are
permuted by a hash and laid end to end, as often as the quota needs; every shard
owns the next words of that stream.  Rows move once, to be numbered in a group
of (source, hash slice), never all rows of a source together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.session import written

#: The table of sources is planned on the driver and broadcast; more sources than this are refused.
MAX_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> list[float]:
    """Words wanted of each source, in the order of the sources.

    The weights repeat.  They share ``share`` of all words; no target is above
    ``limit`` times its source, and what is cut off is shared again by weight.
    """
    size, weight = np.array(sizes, float), np.resize(np.array(weights, float), len(sizes))
    most, out, free = limit * size, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    rest = share * size.sum()
    while free.any():
        out[free] = rest * weight[free] / weight[free].sum()
        above = free & (out > most)
        if not above.any():
            break
        out[above] = most[above]
        rest -= most[above].sum()
        free &= ~above
    return out.tolist()


def split_quotas(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Exact words of each source for each shard: rows are shards, columns sources."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        want = int(left.sum()) * (mid - lo) // (hi - lo)
        drawn, rest = np.zeros_like(left), int(left.sum())
        for i, n in enumerate(left.tolist()):  # one colour after the other of a multivariate hypergeometric draw
            rest -= n
            drawn[i] = _hypergeometric(rng, n, rest, want)
            want -= int(drawn[i])
        split(drawn, lo, mid)
        split(left - drawn, mid, hi)

    split(np.array(quotas, np.int64), 0, shards)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw; above numpy's range of 10^9 the normal law with the same mean and variance, kept in bounds."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if good + bad else 0
    total = good + bad
    p = good / total
    deviation = np.sqrt(n * p * (1 - p) * max(total - n, 0) / max(total - 1, 1))
    return int(min(good, n, max(0, n - bad, round(rng.normal(n * p, deviation)))))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, shards: int = 8, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slice_rows: int = 2_000,
) -> DataFrame:
    """All columns of ``docs`` with ``size, source_size, target, taken, pieces``.

    ``size`` counts the words of the text, ``target`` is the source's, ``taken``
    the words drawn of the document with repeats.  ``pieces`` lists what each
    output shard draws: ``shard, epoch, first_word, words, place`` (``place``
    orders the pieces within a shard).  The words taken of a source add up to its
    rounded target, so one document per source and shard may be cut.

    Null text has no words; nothing is taken of it.  The null source is a source
    and comes last.  Repeated rows are ordinary rows.  An empty table gives an
    empty result.  Input columns with the new names are replaced.
    """
    new = ("size", "source_size", "target", "taken", "pieces")
    docs = docs.drop(*new)
    spark = docs.sparkSession
    # the caller's columns are renamed, so that no name of theirs meets one of these
    names = [f"user_{i}" for i in range(len(docs.columns))]
    user = dict(zip((c.lower() for c in docs.columns), names))
    text, source, doc_id = (F.col(user[c.lower()]) for c in (text_col, source_col, id_col))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    place = F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))
    sized = docs.toDF(*names).select(*names, source.alias("source"), size.alias("size"), place.alias("place"))
    narrow = written(sized.drop(*names), "mix-sizes")
    found = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    words = [r["words"] for r in found]
    wanted = targets(words, weights, share, limit)
    quotas = [min(round(t), int(limit * w)) for t, w in zip(wanted, words)]
    ends = split_quotas(quotas, shards, seed).cumsum(axis=0).T if found else np.zeros((0, shards), np.int64)
    plan = [(r["source"], r["words"], t, -(-r["n"] // slice_rows), e.tolist()) for r, t, e in zip(found, wanted, ends)]
    table = F.broadcast(spark.createDataFrame(plan, "_source string, source_size long, target double, _slices long, _ends array<long>"))

    def sliced(df: DataFrame) -> DataFrame:
        out = df.join(table, F.col("source").eqNullSafe(F.col("_source")))
        return out.withColumn("_slice", F.pmod(F.shiftrightunsigned("place", 1), F.col("_slices")))

    before = W.partitionBy("_source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sliced(narrow).groupBy("_source", "_slice").agg(F.sum("size").alias("_words"))
        .select(F.col("_source").alias("_of"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    )
    within = W.partitionBy("_source", "_slice").orderBy("place", doc_id).rowsBetween(W.unboundedPreceding, -1)
    laid = (
        sliced(sized).withColumn("_first", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_at")))
        .withColumn("_first", F.col("_first") + F.col("_start"))
    )
    epochs = range(int(np.ceil(limit)))
    pieces = F.expr(f"""filter(flatten(transform(sequence(0, {len(epochs) - 1}), e -> transform(_ends, (end, s) -> named_struct(
        'shard', int(s), 'epoch', e,
        'first_word', greatest(if(s = 0, 0L, _ends[s - 1]) - _first - e * source_size, 0L),
        'words', least(end - _first - e * source_size, size) - greatest(if(s = 0, 0L, _ends[s - 1]) - _first - e * source_size, 0L),
        'place', xxhash64(place, s, e))))), p -> p.words > 0)""")
    laid = laid.withColumn("pieces", pieces).withColumn("taken", F.expr("aggregate(pieces, 0L, (n, p) -> n + p.words)"))
    return laid.select(*names, *new).toDF(*docs.columns, *new)


def drawn(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as whole documents: a row for each time at least half of a document was taken."""
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    return mixed.where((F.col("taken") > 0) & (times > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*columns)
