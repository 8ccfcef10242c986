"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a hash of their text.  Splitters between shards are found by
counting: each round sums the exact bytes below a few candidate keys per
splitter over all partitions and narrows the interval around the wanted share.
When every splitter is within tolerance, rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.session import written

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
PROBES = 8


def _refine(narrow: DataFrame, key: str, wanted: list[int], tolerance: int) -> list[tuple[int, int, int]]:
    """For each wanted byte count: (splitter, bytes below it, bytes below splitter + 1).

    Rows with a key below the splitter come before it.  The search ends when the
    bytes are within tolerance, or when splitter and splitter + 1 enclose the
    wanted count, i.e. one key holds more bytes than the tolerance allows.
    """
    total = narrow.agg(F.sum("size")).first()[0] or 0
    low, high = [(LOWEST, 0)] * len(wanted), [(HIGHEST + 1, total)] * len(wanted)
    found: list[tuple[int, int, int] | None] = [None] * len(wanted)
    while None in found:
        open_ = [i for i, x in enumerate(found) if x is None]
        points = sorted({low[i][0] + (high[i][0] - low[i][0]) * j // PROBES for i in open_ for j in range(1, PROBES)} - {LOWEST, HIGHEST + 1})
        sums = [F.sum(F.when(F.col(key) < F.lit(p), F.col("size")).otherwise(0)) for p in points]
        inside = [F.col(key).between(F.lit(low[i][0]), F.lit(high[i][0] - 1)) for i in open_]
        ends = [f(F.when(x, F.col(key))) for x in inside for f in (F.min, F.max)]
        row = narrow.agg(*(c.alias(f"c{n}") for n, c in enumerate(sums + ends))).first()
        below = list(zip(points, (x or 0 for x in row)))
        for at, i in enumerate(open_):
            first, last = row[len(points) + 2 * at], row[len(points) + 2 * at + 1]
            if first is not None:  # no key lies outside of these
                low[i], high[i] = (first, low[i][1]), (last + 1, high[i][1])
            for p, n in below:
                if n <= wanted[i] and low[i][0] < p < high[i][0]:
                    low[i] = (p, n)
                if n > wanted[i] and low[i][0] < p < high[i][0]:
                    high[i] = (p, n)
            nearest = min(low[i], high[i], key=lambda x: abs(x[1] - wanted[i]))
            if abs(nearest[1] - wanted[i]) <= tolerance:
                found[i] = (nearest[0], nearest[1], nearest[1])
            elif first is None or high[i][0] - low[i][0] <= 1:
                found[i] = (low[i][0], low[i][1], high[i][1])
    return found


def _after(key: str, splitter: int) -> Column:
    """Whether a row comes at or after the splitter."""
    return F.lit(False) if splitter > HIGHEST else F.col(key) >= F.lit(splitter)


def shard(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 2_000) -> DataFrame:
    """All columns of ``docs`` with ``shard_size``, ``shard`` and ``slot``.

    A row weighs the UTF-8 bytes of its text and one more (null text: one).
    Shards differ from an equal share by ``tolerance`` of it on each side, or by
    one row where that is more.  Equal texts stay in one shard unless no cut
    between groups is within tolerance; then the group at the cut is divided by
    a hash of the id (rows that repeat the id too stay together).  Slots count
    from 0 without gaps in each shard, in an order that is the same in each run.

    Null ids and texts are ordinary values.  An empty table gives an empty
    result.  Input columns of the three new names are replaced.
    """
    docs = docs.drop("shard_size", "shard", "slot")
    taken = {c.lower() for c in docs.columns}
    key, tie, row, part, before = (_free(n, taken) for n in ("_key", "_tie", "_row", "_part", "_before"))
    narrow = docs.select(
        F.xxhash64(F.col(text_col)).alias("key"), F.xxhash64(F.col(id_col), F.lit(1)).alias("tie"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
    )
    narrow = written(narrow, "shard-keys")
    total, n = narrow.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    wanted = [total * i // n_shards for i in range(1, n_shards)]
    allowed = int(tolerance * total / n_shards)
    splitters = []
    primary = _refine(narrow, "key", wanted, allowed)
    for at in dict.fromkeys(x[0] for x in primary if x[1] != x[2]):  # one text is too large for the tolerance: cut within it
        inside = [(i, x) for i, x in enumerate(primary) if x[0] == at and x[1] != x[2]]
        within = _refine(narrow.where(F.col("key") == F.lit(at)), "tie", [wanted[i] - x[1] for i, x in inside], allowed)
        for (i, x), y in zip(inside, within):
            near = y[0] if y[1] == y[2] or wanted[i] - x[1] - y[1] <= y[2] - wanted[i] + x[1] else y[0] + 1
            splitters.append((wanted[i], at, near))
    splitters += [(wanted[i], x[0], None) for i, x in enumerate(primary) if x[1] == x[2]]
    shard_no = F.lit(0)
    for _, at, within in sorted(splitters, key=lambda s: s[0]):
        after = _after(key, at)
        if within is not None:
            after = (_after(key, at + 1)) | ((F.col(key) == F.lit(at)) & _after(tie, within))
        shard_no = shard_no + after.cast("int")
    parts = max(1, -(-n // (slot_rows * n_shards)))
    placed = docs.select(
        "*", F.xxhash64(F.col(text_col)).alias(key), F.xxhash64(F.col(id_col), F.lit(1)).alias(tie),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("shard_size"),
    ).withColumns({"shard": shard_no, part: F.pmod(F.xxhash64(tie, key, F.lit(2)), F.lit(parts)).cast("int")})
    placed = placed.withColumn(row, F.row_number().over(W.partitionBy("shard", part).orderBy(key, tie, id_col)))
    counts = (
        narrow.withColumnsRenamed({"key": key, "tie": tie}).withColumns({"shard": shard_no, part: F.pmod(F.xxhash64(tie, key, F.lit(2)), F.lit(parts)).cast("int")})
        .groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", part, F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    )
    return placed.join(counts, ["shard", part]).withColumn("slot", F.col(before) + F.col(row) - 1).select(*docs.columns, "shard_size", "shard", "slot")


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name = "_" + name
    return name
