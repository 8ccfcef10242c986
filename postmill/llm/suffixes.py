"""Suffix-array dedup: remove bytes covered by long strings that start earlier.

Only a sparse set of suffixes is sorted.  Of the 32-byte grams in every string
of 100 bytes the one with the smallest hash is its anchor; equal strings have
equal anchors at equal places.  Anchors that occur once (by two Bloom filters)
cannot belong to a repeated string and stay where they are.  The others are sent
with the stretch of text whose strings they stand for to buckets bounded by
sampled splitters of their leading bytes.  Each bucket sorts its suffixes by
multikey quicksort, eight bytes a step, and finds equal stretches; where
stretches of one anchor differ, their single strings are sorted the same way.
A lead that fills a bucket is cut over several; strings of such leads are
compared across the cut by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import bloom
from postmill.session import written

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
#: Bytes handled at once in a task; longer texts are handled in overlapping pieces.
PIECE = 150_000
#: Suffixes sorted at once in a bucket.
SORTED_AT_ONCE = 20_000
SAMPLE, BUCKETS_PER_TASK = 50_000, 4
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACE = np.uint64((1 << 26) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[3]
    h = (h ^ (h >> np.uint64(27))) * _M[4]
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on as one number."""
    data = np.ascontiguousarray(data)
    n = data.size - 7
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        out[r::8] = np.frombuffer(data, kind, (n - r + 7) // 8, r)
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on."""
    h = _words(data)
    h *= _M[0]
    h ^= h >> np.uint64(29)
    h = h[:-8] * _M[1] + h[8:]
    h ^= h >> np.uint64(31)
    h = h[:-16] * _M[2] + h[16:]
    h ^= h >> np.uint64(30)
    h *= _M[3]
    h ^= h >> np.uint64(32)
    return h


def anchored(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: (first start, last start, anchor, anchor hash).

    ``data`` holds texts end to end, ``ends`` where each ends.
    """
    h = gram_hashes(data)
    low = (h & ~_PLACE) | np.arange(h.size, dtype=np.uint64)
    width = 1
    while width * 2 <= GRAMS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: low.size - (GRAMS - width)], low[GRAMS - width :])
    at = (low & _PLACE).astype(np.int64)
    whole = np.ones(at.size, bool)
    for e in ends[:-1]:
        whole[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(whole)
    if not starts.size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = at[starts]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-9) != 1))
    last = np.append(new[1:], at.size) - 1
    return starts[new], starts[last], at[new], h[at[new]]


def pieces(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about PIECE bytes: (data, ends, row of each text, its offset in the row)."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text or b"") - LENGTH + 1, 0), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            parts.append((row, at, part))
            size += len(part)
            if size >= PIECE:
                yield _laid(parts)
                parts, size = [], 0
    if parts:
        yield _laid(parts)


def _laid(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    rows, at, texts = zip(*parts)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), np.array(rows), np.array(at)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their words, and the number of the group of equal rows for each place in the order.

    One word is looked at per step, and only in groups that are still tied.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.diff(words[order, 0], prepend=words[order[0], 0]) != 0) if n else np.zeros(0, np.int64)
    for d in range(1, words.shape[1]):
        size = np.bincount(group) if n else np.zeros(0)
        tied = np.flatnonzero(size[group] > 1) if n else np.zeros(0, np.int64)
        if not tied.size:
            break
        rows, of = order[tied], group[tied]
        key = words[rows, d]
        by = np.lexsort((key, of))
        order[tied] = rows[by]
        key = key[by]
        fresh = np.zeros(n, np.int64)
        fresh[tied[1:]] = (np.diff(key) != 0) & (np.diff(of) == 0)
        group = group + np.cumsum(fresh)
    return order, group


def _taken(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many stretches end to end, and their offsets."""
    offsets = np.append(0, lengths.cumsum())
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[index], offsets


def _matrix(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Stretches as rows of big-endian words, padded with zeros to ``width`` bytes; ``words`` are those of every position."""
    at = np.arange(0, width, 8)
    out = words[np.minimum(starts[:, None] + at, words.size - 1)]
    over = (8 * np.clip(at + 8 - lengths[:, None], 0, 8)).astype(np.uint64)
    half = over // np.uint64(2)  # a shift by 64 has no meaning, two by 32 have
    return out >> half >> (over - half) << half << (over - half)


def _sorted(words: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of stretches by their leading words, equal stretches together, and their groups.

    Behind the leading words a fingerprint stands for the others; equality is
    then checked on all words, and should two stretches share a fingerprint
    only, all words are sorted.
    """
    mark = np.zeros(len(words), np.uint64)
    for column in words.T[leading:]:
        mark = (mark ^ column) * _M[4]
        mark ^= mark >> np.uint64(29)
    order, group = multikey_order(np.concatenate([words[:, :leading], mark[:, None]], axis=1))
    if len(order) > 1:
        same = np.flatnonzero(np.diff(group) == 0)
        if (words[order[same]] != words[order[same + 1]]).any():
            return multikey_order(words)
    return order, group


def _first_of(group: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Place of the smallest (id, position) of each row's group; all in group order."""
    by = np.lexsort((pos, ids, group))
    heads = by[np.flatnonzero(np.diff(group[by], prepend=-1))]
    return heads[np.cumsum(np.diff(group, prepend=group[0] if group.size else 0) != 0)] if group.size else heads


def _whole(every: np.ndarray, offsets: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Stretches as rows of words, equal if and only if they have the same bytes and place of the anchor."""
    begin, right = offsets[:-1], np.diff(offsets) - left
    return np.concatenate([
        _matrix(every, begin + left, right, 104), _matrix(every, begin, left, 72), (right * 256 + left).astype(np.uint64)[:, None],
    ], axis=1)


def repeated_starts(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, anchor: np.ndarray, left: np.ndarray, cut: np.ndarray):
    """Starts of strings in a bucket that an earlier stretch of it also holds.

    Stretch ``i`` is ``data[offsets[i]:offsets[i + 1]]``; its anchor stands at
    byte ``left[i]`` of it and at ``anchor[i]`` in the text.  Returns rows of
    stretches with first and last repeated start, and (row, start) of the first
    strings in stretches where ``cut`` is set.
    """
    size = np.diff(offsets)
    begin = offsets[:-1]
    every = _words(np.append(data, np.zeros(8, np.uint8)), ">u8")
    words = _whole(every, offsets, left)
    order, group = _sorted(words, GRAM // 8)
    first = _first_of(group, ids[order], anchor[order])
    same = (ids[order] == ids[order][first]) & (anchor[order] == anchor[order][first])
    later = order[~same]
    at0, n_starts = anchor - left, size - LENGTH + 1
    runs = [np.stack([later, at0[later], at0[later] + n_starts[later] - 1])]

    own = order[np.unique(first)]  # one stretch for each text, in sorted order
    gram = words[own][:, : GRAM // 8]
    new = np.append(True, (gram[1:] != gram[:-1]).any(axis=1))
    number = np.cumsum(new) - 1
    several = own[np.bincount(number)[number] > 1]
    firsts = [np.zeros((2, 0), np.int64)]
    lone = own[(np.bincount(number)[number] == 1) & cut[own]]
    if lone.size:
        rows = np.repeat(lone, n_starts[lone])
        firsts.append(np.stack([rows, at0[rows] + _within(n_starts[lone])]))
    if several.size:
        rows = np.repeat(several, n_starts[several])
        step = _within(n_starts[several])
        where, start = begin[rows] + step, at0[rows] + step
        for lo, hi in _chunks(several, rows, words):
            r, s = rows[lo:hi], start[lo:hi]
            o, g = _sorted(_matrix(every, where[lo:hi], np.full(hi - lo, LENGTH), 104), 1)
            f = _first_of(g, ids[r][o], s[o])
            again = ~((ids[r][o] == ids[r][o][f]) & (s[o] == s[o][f]))
            hit = np.sort(o[again])
            if hit.size:
                edge = np.flatnonzero((np.diff(r[hit], prepend=-1) != 0) | (np.diff(s[hit], prepend=-9) != 1))
                end = np.append(edge[1:], hit.size) - 1
                runs.append(np.stack([r[hit[edge]], s[hit[edge]], s[hit[end]]]))
            kept = o[~again]
            kept = kept[cut[r[kept]]]
            firsts.append(np.stack([r[kept], s[kept]]))
    return np.concatenate(runs, axis=1), np.concatenate(firsts, axis=1)


def _bytes_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a table's stretches end to end, and their offsets; the column may be above 2 GiB."""
    text = pa.concat_arrays(t.column("text").cast(pa.large_binary()).chunks)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _order_of_ids(t: pa.Table) -> np.ndarray:
    return t.column("id").combine_chunks().fill_null(-(1 << 63)).to_numpy()


def without_copies(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(stretches that equal one of smaller id or place, the others once for each text)."""
    data, offsets = _bytes_of(t)
    ids, anchor, mark = _order_of_ids(t), t.column("anchor").to_numpy(), t.column("mark").to_numpy()
    words = _whole(_words(np.append(data, np.zeros(8, np.uint8)), ">u8"), offsets, t.column("left").to_numpy().astype(np.int64))
    order, group = _sorted(words, GRAM // 8)
    first = order[_first_of(group, ids[order], anchor[order])]
    same = (ids[order] == ids[first]) & (anchor[order] == anchor[first])
    kept, of = order[same], group[same]
    by = np.lexsort((kept, mark[kept], of))
    once = by[(np.diff(of[by], prepend=-1) != 0) | np.append(True, np.diff(mark[kept][by]) != 0)[: by.size]]
    lead = t.column("lead").to_numpy()
    stay = np.sort(kept[once])
    stay = stay[np.lexsort((lead[stay], t.column("bucket").to_numpy()[stay]))]
    return t.take(pa.array(order[~same])), t.take(pa.array(stay))


def gathered(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[bool, pa.Table]]:
    """Sorted stretches in tables of whole leads (False), and repeats found before their lead was complete (True).

    Of a lead with many rows only stretches that differ are held.
    """
    held: list[pa.RecordBatch] = []
    size, limit = 0, at_once
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < limit:
            continue
        t = pa.Table.from_batches(held)
        lead, bucket = t.column("lead").to_numpy(), t.column("bucket").to_numpy()
        new = np.flatnonzero((np.diff(lead) != 0) | (np.diff(bucket) != 0))
        if new.size:  # rows of the last lead wait for more
            edge = int(new[-1]) + 1
            yield False, t.slice(0, edge)
            t = t.slice(edge)
        if len(t) >= at_once:
            copies, t = without_copies(t)
            if len(copies):
                yield True, copies
        held, size = t.to_batches(), len(t)
        limit = max(at_once, 2 * size)
    if size:
        yield False, pa.Table.from_batches(held)


def _within(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.append(0, lengths.cumsum()[:-1]), lengths)


def _chunks(stretches: np.ndarray, rows: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of strings to sort at once, cut between grams."""
    gram = words[stretches][:, : GRAM // 8]
    ends = np.append(np.flatnonzero((gram[1:] != gram[:-1]).any(axis=1)) + 1, len(stretches))
    counts = np.searchsorted(np.flatnonzero(np.diff(rows, prepend=-1)), rows.size)  # stretches in rows
    first_row = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), rows.size)
    lo = 0
    for e in ends:
        hi = int(first_row[min(e, counts)])
        if hi - lo >= 4 * SORTED_AT_ONCE or e == len(stretches):
            yield lo, hi
            lo = hi


def _signed(lead: np.ndarray) -> np.ndarray:
    return (lead ^ np.uint64(1 << 63)).view(np.int64)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, spans, kept``: texts without repeated strings.

    A byte is removed if a string of 100 UTF-8 bytes that covers it also starts
    earlier: in a document of smaller id, or earlier in the same document.
    ``spans`` are the maximal removed runs (start, end) and ``kept`` the other
    bytes.  Ids are integers; a null id comes before all others.

    Null text is empty.  Rows that share an id count as one document whose
    strings have the same places; of equal places none is earlier, so repeated
    rows are not removed against each other.  An empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"), F.xxhash64(raw).alias("mark"))
    total = docs.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    anchors = max(1, total * 2 // GRAMS)
    bits, rate = bloom.filter_bits(anchors), max(1, anchors // SAMPLE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample: list[np.ndarray] = []

        def hashes():
            for b in batches:
                for data, ends, _, _ in pieces(b.column("raw").to_pylist()):
                    _, _, at, h = anchored(data, ends)
                    picked = at[_mixed(h) % np.uint64(rate) == 0]
                    sample.append(_words(data, ">u8")[picked])
                    yield h

        for x in bloom.partial_blocks(hashes(), bits):
            yield pa.RecordBatch.from_pandas(x.astype({"block": "int32"}), preserve_index=False)
        leads = np.concatenate(sample) if sample else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([zlib.compress(leads.tobytes(), 1)]), pa.array([b""])], ["block", "once", "twice"])

    partial = written(docs.select("raw").mapInArrow(count, bloom.SCHEMA), "anchors")
    twice = bloom.twice_filter(partial.where("block >= 0"), bits)
    leads = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(zlib.decompress(r["once"]), np.uint64) for r in partial.where("block = -1").select("once").toLocalIterator())]))
    buckets = min(leads.size, BUCKETS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = leads[np.linspace(0, leads.size, buckets + 1)[1:-1].astype(int)] if buckets else leads
    shared = spark.sparkContext.broadcast((twice, splitters))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, splitters = shared.value
        for b in batches:
            ids, marks = b.column("id"), b.column("mark")
            for data, ends, row, offset in pieces(b.column("raw").to_pylist()):
                lo, hi, at, h = anchored(data, ends)
                hit = np.flatnonzero(bloom.suspects(h, twice)) if h.size else np.zeros(0, np.int64)
                if not hit.size:
                    continue
                lo, hi, at = lo[hit], hi[hit], at[hit]
                of = np.searchsorted(ends, at, side="right")
                base = np.append(0, ends[:-1])[of]
                lead = _words(data, ">u8")[at]
                low, high = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
                mark = marks.take(pa.array(row[of]))
                salt = _mixed(mark.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % (high - low + 1).astype(np.uint64)
                cut, ends_at = _taken(data, lo, hi + LENGTH - lo)
                text = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(ends_at.astype(np.int32).tobytes()), pa.py_buffer(cut.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    pa.array((low + salt.astype(np.int64)).astype(np.int32)), pa.array(_signed(lead)), pa.array(high > low), ids.take(pa.array(row[of])), mark,
                    pa.array(at - base + offset[of]), pa.array((at - lo).astype(np.int32)), text,
                ], ["bucket", "lead", "cut", "id", "mark", "anchor", "left", "text"])

    found = docs.mapInArrow(stretches, "bucket int, lead long, cut boolean, id long, mark long, anchor long, left int, text binary")
    found = found.repartition("bucket").sortWithinPartitions("bucket", "lead")

    at_once = SORTED_AT_ONCE

    def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "mark", "first", "last", "print"]

        def done(t: pa.Table) -> pa.RecordBatch:
            data, offsets = _bytes_of(t)
            ids = _order_of_ids(t)
            anchor, left = t.column("anchor").to_numpy(), t.column("left").to_numpy().astype(np.int64)
            runs, firsts = repeated_starts(data, offsets, ids, anchor, left, t.column("cut").to_numpy(zero_copy_only=False).astype(bool))
            rows = np.concatenate([runs[0], firsts[0]])
            prints = np.zeros(0, np.int64)
            if firsts.shape[1]:
                h = gram_hashes(data)
                at = offsets[firsts[0]] + firsts[1] - (anchor - left)[firsts[0]]
                prints = _mixed(_mixed(h[at] * _M[0] + h[at + 32]) * _M[1] + _mixed(h[at + 64] * _M[2] + h[at + LENGTH - GRAM])).view(np.int64)
            none = pa.nulls(runs.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([
                t.column("id").combine_chunks().take(pa.array(rows)), t.column("mark").combine_chunks().take(pa.array(rows)),
                pa.array(np.concatenate([runs[1], firsts[1]])), pa.array(np.concatenate([runs[2], firsts[1]])),
                pa.concat_arrays([none, pa.array(prints, pa.int64())]),
            ], names)

        def copied(t: pa.Table) -> pa.RecordBatch:
            first = t.column("anchor").to_numpy() - t.column("left").to_numpy()
            last = first + np.diff(_bytes_of(t)[1]) - LENGTH
            return pa.RecordBatch.from_arrays([
                t.column("id").combine_chunks(), t.column("mark").combine_chunks(), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.nulls(len(t), pa.int64()),
            ], names)

        for copies, t in gathered(batches, at_once):
            yield copied(t) if copies else done(t)

    out = written(found.mapInArrow(sorted_buckets, "id long, mark long, first long, last long, print long"), "repeats")
    over_cuts = out.where("print IS NOT NULL")
    earliest = over_cuts.groupBy("print").agg(F.min(F.struct("id", "first")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = over_cuts.join(written(earliest.select("print", "low"), "earliest"), "print").where("NOT (id <=> low.id AND first = low.first)")
    runs = out.where("print IS NULL").select("id", "mark", "first", "last").unionByName(again.select("id", "mark", "first", "last"))
    by_text = runs.groupBy(F.col("id").alias("of"), F.col("mark").alias("text_mark")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, spans, texts = [], [], [], []
            for raw, runs in zip(b.column("raw").to_pylist(), b.column("runs").to_pylist()):
                gone: list[list[int]] = []
                for lo, hi in sorted((r["first"], r["last"] + LENGTH) for r in runs or ()):
                    if gone and lo <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], hi)
                    else:
                        gone.append([lo, hi])
                edges = [0, *(x for g in gone for x in g), len(raw)]
                sizes.append(len(raw))
                removed.append(sum(hi - lo for lo, hi in gone))
                spans.append([{"start": lo, "end": hi} for lo, hi in gone])
                texts.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if gone else raw)
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.binary()),
            ], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = docs.join(by_text, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("text_mark")), "left").select("id", "raw", "runs")
    done = joined.mapInArrow(kept, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
    return done.withColumnRenamed("id", id_col)
