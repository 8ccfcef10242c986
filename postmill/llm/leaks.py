"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages.  A randomised SVD of their TF-IDF rows
(document frequencies from the whole corpus, products summed by Spark over the
passages) gives a latent space.  Every window of every document is projected
into it and compared by cosine with all passages, block by block.  Candidates
are then checked on the words themselves: longest common subsequence with the
whole item, and the share of the item's rarest words (its answer) present.

The more passages a benchmark has, the less of each the latent space keeps.
Every leak holds enough words of the answer close together, so an index of the
answers' words gives all stretches that can be one, whatever the space misses.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, RANK, OVERSAMPLE = 1 << 16, 96, 10
#: Words of a step; a window is two steps, a benchmark passage at most three.
STEP = 16
#: Passages compared in one pass over the documents; a larger benchmark takes more passes.
BLOCK = 8192
#: Pairs of a word and an item sorted at once.
ENTRIES = 4_000_000
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Ids(dict):
    """Word to bucket; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word) & (BUCKETS - 1)
        return out


def word_ids(text: str | None, known: _Ids) -> np.ndarray:
    """Buckets of the words, A-Z lower-cased and without ASCII punctuation."""
    words = (text or "").encode().translate(_LOWER, _DROP).split()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold the words of each bucket (summed over its words), and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, total, n = Counter(), np.zeros(BUCKETS, np.int64), 0

        def fold() -> None:
            at = np.fromiter((xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for w in by_word), np.int64, len(by_word))
            np.add.at(total, at, np.fromiter(by_word.values(), np.int64, len(by_word)))
            by_word.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                by_word.update(set((t or "").encode().translate(_LOWER, _DROP).split()))
                n += 1
            if len(by_word) > 500_000:
                fold()
        fold()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    out, n = np.zeros(BUCKETS, np.int64), 0
    for row in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if row["bucket"] < 0:
            n = row["n"]
        else:
            out[row["bucket"]] = row["n"]
    return out, n


def passages_of(ids: np.ndarray) -> list[np.ndarray]:
    """An item's words in nearly equal parts of at most three steps."""
    return [p for p in np.array_split(ids, -(-len(ids) // (3 * STEP))) if len(p)] if len(ids) else []


def _sparse(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(ids, return_counts=True)
    x = n * idf[at]
    return at, x / (np.linalg.norm(x) or 1.0)


def _summed(items: DataFrame, parts, width: int) -> np.ndarray:
    """Sum of the sparse rows of vectors that ``parts`` makes of each task's texts: BUCKETS x width."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        known = _Ids()
        for b in batches:
            for t in b["text"]:
                for p in passages_of(word_ids(t, known)):
                    for at, v in parts(p):
                        total[at] = total[at] + v if at in total else v
        yield pd.DataFrame([(k, v.astype(np.float64).tobytes()) for k, v in total.items()], columns=["bucket", "v"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, None
        for b in batches:
            done = []
            for k, v in zip(b["bucket"], b["v"]):
                v = np.frombuffer(v)
                if k == last:
                    total = total + v
                else:
                    if last is not None:
                        done.append((last, total.tobytes()))
                    last, total = k, v
            yield pd.DataFrame(done, columns=["bucket", "v"])
        if last is not None:
            yield pd.DataFrame([(last, total.tobytes())], columns=["bucket", "v"])

    schema = "bucket int, v binary"
    out = np.zeros((BUCKETS, width), np.float32)
    for row in items.select("text").mapInPandas(make, schema).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(add, schema).toLocalIterator():
        out[row["bucket"]] = np.frombuffer(row["v"])
    return out


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the items' TF-IDF passages: BUCKETS x rank, float32."""
    width = rank + OVERSAMPLE
    test = np.random.default_rng(7).standard_normal((BUCKETS, width), np.float32)
    spark = items.sparkSession.sparkContext
    shared = spark.broadcast((test, idf))

    def range_part(p: np.ndarray):
        test, idf = shared.value
        at, x = _sparse(p, idf)
        y = x @ test[at]
        return [(int(a), v * y) for a, v in zip(at, x)]

    sums = _summed(items, range_part, width)
    held = np.flatnonzero(sums.any(axis=1))
    found = np.linalg.qr(sums[held])[0]
    basis = np.zeros((BUCKETS, width), np.float32)
    basis[held, : found.shape[1]] = found
    wide = spark.broadcast((basis, idf))

    def gram_part(p: np.ndarray):
        basis, idf = wide.value
        at, x = _sparse(p, idf)
        y = x @ basis[at]
        return [(i, y[i] * y) for i in range(width)]

    gram = _summed(items, gram_part, width)[:width]
    values, vectors = np.linalg.eigh(gram)
    return basis @ vectors[:, np.argsort(values)[::-1][:rank]].astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def span_of(words: int) -> int:
    """Words of the stretches that are compared with an item."""
    return int(1.3 * words) + 2


def best_match(item: list[int], region: list[int], answer: set[int] = frozenset(), least: int = 0) -> tuple[int, int, int]:
    """(length, start, words): the stretch of at most 1.3 times the item with the longest common subsequence.

    Only stretches with at least ``least`` words of ``answer`` count.
    """
    span = span_of(len(item))
    known, best = set(item), (0, 0, 0)
    for at in range(0, max(1, len(region) - span + max(1, len(item) // 8)), max(1, len(item) // 8)):
        part = region[at : at + span]
        if sum(x in known for x in part) > best[0] and (not least or len(answer.intersection(part)) >= least):
            best = max(best, (common_subsequence(item, part), at, len(part)), key=lambda x: x[0])
    return best


def postings_of(items: list[tuple], min_common: float, min_answer: float) -> tuple[np.ndarray, ...]:
    """Index of the items' answers: (first posting of each bucket, items of the postings, words needed of each item, span of each item).

    Without a bound on the answer all words of an item are indexed.
    """
    by: list[tuple[int, int]] = []
    need, span = [], []
    for k, (_, words, answer) in enumerate(items):
        by += [(w, k) for w in (answer if min_answer > 0 else set(words))]
        need.append(max(1, math.ceil(min_answer * len(answer) if min_answer > 0 else min_common * len(words))))
        span.append(span_of(len(words)))
    bucket, of = np.array(sorted(by), np.int64).reshape(-1, 2).T
    return np.searchsorted(bucket, np.arange(BUCKETS + 1)), of, np.array(need, np.int64), np.array(span, np.int64)


def held_together(every: np.ndarray, doc: np.ndarray, first: np.ndarray, of: np.ndarray, need: np.ndarray, span: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, last word): all places with as many indexed words of an item as it needs within its span.

    ``doc`` is the document of each word; places closer than a span are one.
    """
    at = np.flatnonzero(first[every + 1] > first[every])
    count = first[every[at] + 1] - first[every[at]]
    total, most = int(count.sum()), int(of.max(initial=0))
    if total > ENTRIES and most > (least := int(of.min())):
        for part in (of <= (least + most) // 2, of > (least + most) // 2):
            yield from held_together(every, doc, np.append(0, part.cumsum())[first], of[part], need, span)
        return
    within = np.arange(total) - np.repeat(np.append(0, count.cumsum()[:-1]), count) if total else np.zeros(0, np.int64)
    key = np.sort(of[np.repeat(first[every[at]], count) + within] * every.size + np.repeat(at, count))
    item, where = key // every.size, key % every.size
    other = np.arange(total) + need[item] - 1
    start = np.flatnonzero(other < total)
    other = other[start]
    start = start[(item[other] == item[start]) & (doc[where[other]] == doc[where[start]]) & (where[other] - where[start] < span[item[start]])]
    item, where = item[start], where[start]
    new = np.ones(start.size, bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(doc[where]) != 0) | (np.diff(where) > span[item[1:]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], start.size)[: heads.size] - 1
    yield from zip(doc[where[heads]].tolist(), item[heads].tolist(), where[heads].tolist(), where[tails].tolist())


def whole_cosine(words: list[int], ids: np.ndarray, start: int, end: int, squares: np.ndarray) -> float:
    """Largest cosine, outside any latent space, of an item's passages with the windows over words ``start`` to ``end``."""
    best = 0.0
    for p in passages_of(np.array(words)):
        at, n = np.unique(p, return_counts=True)
        weight = dict(zip(at.tolist(), (n * squares[at]).tolist()))
        length = math.sqrt(float((n * n * squares[at]).sum()))
        for step in range(max(0, start // STEP - 1), -(-end // STEP)):
            window = ids[step * STEP : (step + 2) * STEP]
            best = max(best, sum(weight.get(x, 0.0) for x in window.tolist()) / (length * math.sqrt(float(squares[window].sum())) or 1.0))
    return best


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    cosine: float = 0.25, min_common: float = 0.75, min_answer: float = 0.6, rank: int = RANK,
) -> DataFrame:
    """Pairs of documents and benchmark items: ``id, item id, first_word, words, cosine, common, answer``.

    ``common`` is the longest common subsequence within a stretch of the
    document (``first_word, words``) as a share of the item's words, ``answer``
    the share of the item's rarest quarter of words found there.  ``cosine`` is
    that of the window by which the pair was found; for pairs that the latent
    space misses it is the cosine outside that space, which has to reach
    ``cosine`` only for items shorter than a step.

    Null and empty texts and items without words match nothing.  Repeated
    documents and repeated items each give rows.  Ties between stretches go to
    the first.  An empty table gives an empty result; further columns are
    ignored.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    schema = f"{id_col} {docs.schema['id'].dataType.simpleString()}, {item_col} {items.schema['item'].dataType.simpleString()}, first_word long, words long, cosine double, common double, answer double"
    df, n = document_frequency(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.01
    space = latent_space(items, idf, rank)
    lookup = sc.broadcast((space * idf[:, None].astype(np.float32), np.abs(space).max(axis=1) > 1e-7, (idf * idf).astype(np.float32)))
    out = None
    known = _Ids()
    block: list[tuple] = []
    rows = items.toLocalIterator()
    more = True
    while more or out is None:
        size = 0
        block = []
        more = False
        for row in rows:
            ids = word_ids(row["text"], known)
            if len(ids):
                block.append((row["item"], ids))
                size += len(passages_of(ids))
            if size >= BLOCK:
                more = True
                break
        found = _against(docs, block, lookup, space, idf, schema, cosine, min_common, min_answer)
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, block: list[tuple], lookup, space: np.ndarray, idf: np.ndarray, schema: str, cosine: float, min_common: float, min_answer: float) -> DataFrame:
    queries, owners = [], []
    for k, (_, ids) in enumerate(block):
        for p in passages_of(ids):
            at, x = _sparse(p, idf)
            z = x @ space[at]
            queries.append(z / (np.linalg.norm(z) or 1.0))
            owners.append(k)
    q = np.array(queries, np.float32).reshape(-1, space.shape[1])
    rare = [ids[np.argsort(-idf[ids], kind="stable")[: max(3, len(ids) // 4)]] for _, ids in block]
    items = [(i, ids.tolist(), set(r.tolist())) for (i, ids), r in zip(block, rare)]
    shared = docs.sparkSession.sparkContext.broadcast((q.T.copy(), np.array(owners, int), items, postings_of(items, min_common, min_answer)))
    names = [f.split()[0] for f in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, owners, items, postings = shared.value
        table, used, squares = lookup.value
        known = _Ids()
        for b in batches:
            out: list[tuple] = []
            from_row: list[int] = []
            group: list[tuple[int, np.ndarray]] = []
            words = 0
            texts = b.column("text")
            for r in range(b.num_rows):
                ids = word_ids(texts[r].as_py(), known)
                if len(ids):
                    group.append((r, ids))
                    words += len(ids)
                if group and (words > 60_000 or r == b.num_rows - 1):
                    for row, found in _compare(group, q, owners, items, postings, table, used, squares, cosine, min_common, min_answer):
                        from_row.append(row)
                        out.append(found)
                    group, words = [], 0
            if group:
                for row, found in _compare(group, q, owners, items, postings, table, used, squares, cosine, min_common, min_answer):
                    from_row.append(row)
                    out.append(found)
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(from_row, pa.int64())), pa.array(cols[0], item_type), *(pa.array(c, pa.int64()) for c in cols[1:3]), *(pa.array(c, pa.float64()) for c in cols[3:])], names)

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[schema.split(", ")[1].split()[1]]
    return docs.mapInArrow(search, schema)


def _compare(group, q, owners, items, postings, table, used, squares, cosine, min_common, min_answer) -> Iterator[tuple[int, tuple]]:
    """Leaks in a group of documents: (row, (item, first_word, words, cosine, common, answer))."""
    if not q.shape[1]:
        return
    lengths = np.array([len(ids) for _, ids in group])
    steps = -(-lengths // STEP)
    starts = np.concatenate([np.arange(0, n, STEP) + at for n, at in zip(lengths, np.append(0, lengths.cumsum()[:-1]))])
    every = np.concatenate([ids for _, ids in group])
    held = used[every]  # other words have no place in the latent space
    at = np.append(0, held.cumsum())[starts]
    rows = np.concatenate([table[every[held]], np.zeros((1, table.shape[1]), np.float32)])
    sums = np.add.reduceat(rows, at, axis=0)
    sums[np.diff(at, append=rows.shape[0] - 1) == 0] = 0
    norms = np.add.reduceat(squares[every], starts)
    owner = np.repeat(np.arange(len(group)), steps)
    joined = np.append(owner[1:] == owner[:-1], False)  # a window is a step and the next of the same document
    sums[:-1][joined[:-1]] += sums[1:][joined[:-1]]
    norms[:-1][joined[:-1]] += norms[1:][joined[:-1]]
    sums /= np.sqrt(np.maximum(norms, 1e-9))[:, None]
    near = sums @ q
    wins, hits = np.nonzero(near >= cosine)
    order = np.lexsort((owners[hits], wins))
    first_step = np.append(0, steps.cumsum())
    best: dict[tuple[int, int], tuple] = {}
    longest = max(len(words) for _, words, _ in items)
    seen_window, seen = -1, set()
    for w, h in zip(wins[order].tolist(), hits[order].tolist()):
        k, doc = int(owners[h]), int(owner[w])
        item, words, answer = items[k]
        row, ids = group[doc]
        at = (w - int(first_step[doc])) * STEP
        if w != seen_window:
            seen_window, seen = w, set(ids[max(0, at - longest) : at + 2 * STEP + longest].tolist())
        if len(answer & seen) < min_answer * len(answer) or (doc, k) in best and best[doc, k][4] == 1:
            continue
        lo = max(0, at - len(words))
        region = ids[lo : at + 2 * STEP + len(words)].tolist()
        n, start, span = best_match(words, region)
        if n < min_common * len(words):
            continue
        share = len(answer.intersection(region[start : start + span])) / len(answer)
        if share >= min_answer and ((doc, k) not in best or n / len(words) > best[doc, k][4]):
            best[doc, k] = (item, lo + start, span, float(near[w, h]), n / len(words), share)
    begin = lengths.cumsum() - lengths
    done = set(best)
    for doc, k, low, high in held_together(every, np.repeat(np.arange(len(group)), lengths), *postings):
        if (doc, k) in done:
            continue
        item, words, answer = items[k]
        ids = group[doc][1]
        lo = max(0, low - int(begin[doc]) - span_of(len(words)))
        region = ids[lo : high - int(begin[doc]) + span_of(len(words))].tolist()
        least = math.ceil(min_answer * len(answer))
        if len(answer.intersection(region)) < least:
            continue
        n, start, span = best_match(words, region, answer, least)
        if n < min_common * len(words) or (doc, k) in best and n / len(words) <= best[doc, k][4]:
            continue
        near_by = whole_cosine(words, ids, lo + start, lo + start + span, squares)
        if len(words) >= STEP or near_by >= cosine:
            best[doc, k] = (item, lo + start, span, near_by, n / len(words), len(answer.intersection(region[start : start + span])) / len(answer))
    for (doc, _), found in best.items():
        yield group[doc][0], found
