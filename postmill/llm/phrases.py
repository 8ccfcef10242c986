"""Phrase collocations: word sequences counted in a HAT-trie, scored by their weakest cut.

A task counts in a trie over word ids.  Its leaves are hash containers of
remaining ids; a full container bursts: into two for the lower and the upper
half of its next ids, or, once all its keys share that id, into a level below.
A trie that has grown too large gives up its largest subtrees as sorted runs.
The runs of all tasks are merged per prefix partition, a hash of the first two
ids.

Three scans of the texts.  The first counts words.  The second adds up how many
sequences of two and of three frequent words fall on each of many counters by
their hash; a counter below the least count rules out all its sequences, and one
bit per counter says so.  The third counts in the trie what neither its words,
nor the counters of its pairs and triples rule out.  Words travel as a Bloom
filter, counters as bits, both of bounded size: fuller ones let more rows be
counted and merged, but the merge is exact, so results do not depend on them.

A word's id is 64 bits of its hash, seeded with the language.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm import bloom
from postmill.session import written

#: Keys that a container holds before it bursts, and ids that a trie holds before it spills.
BURST, HELD = 1 << 16, 1 << 22
#: Words of the corpus per prefix partition.
PART_WORDS = 1 << 21
#: Words counted at once, and distinct words that a task remembers.
CHUNK, WORDS = 1 << 20, 300_000
NO_LANGUAGE = "und"
_END = b"\xff"  # in no UTF-8 text
_STOPS = b".,;:!?\n\v\f\r"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _STOPS else c for c in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """The words of all pieces of a text, each piece ended by ``_END``."""
    return ((text or "").encode().translate(_FOLD).replace(b"\n", b" " + _END + b" ") + b" " + _END).split()


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _STEP) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class _Container:
    """Open-addressing table of id rows and their counts; the rows share the first ``depth`` ids."""

    def __init__(self, width: int, depth: int, slots: int = 256):
        self.depth, self.size = depth, 0
        self.keys, self.counts = np.zeros((slots, width), np.uint64), np.zeros(slots, np.int64)

    def add(self, keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        for lo in range(0, len(keys), BURST):  # so that a table is never sized for repeats
            part = slice(lo, lo + BURST)
            if 2 * (self.size + min(BURST, len(keys) - lo)) > len(self.counts):
                self._grow(2 * (self.size + min(BURST, len(keys) - lo)))
            self._insert(keys[part], hashes[part], counts[part])

    def _grow(self, least: int) -> None:
        keys, counts = self.rows()
        slots = 1 << int(least - 1).bit_length()
        self.keys, self.counts, self.size = np.zeros((slots, keys.shape[1]), np.uint64), np.zeros(slots, np.int64), 0
        self._insert(keys, _hashes(keys), counts)

    def _insert(self, keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.counts) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        while left.size:
            at = slot[left]
            free = self.counts[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several that want a slot, one gets it
            same = (self.keys[at] == keys[left]).all(axis=1)
            self.size += np.unique(at[free & same]).size
            np.add.at(self.counts, at[same], counts[left[same]])
            left = left[~same]
            slot[left] = (slot[left] + 1) & mask

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.counts > 0
        return self.keys[used], self.counts[used]


def _hashes(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0]
    for c in range(1, keys.shape[1]):
        h = pair_hash(h, keys[:, c])
    return h ^ (h >> np.uint64(17))


class _Node:
    """A level of the trie: containers or nodes, each for a range of the ids at ``depth``."""

    def __init__(self, width: int, depth: int):
        self.width, self.depth = width, depth
        self.lows = np.zeros(1, np.uint64)
        self.below: list[_Container | _Node] = [_Container(width, depth)]

    @property
    def size(self) -> int:
        return sum(x.size for x in self.below)

    def add(self, keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        to = np.searchsorted(self.lows, keys[:, self.depth], side="right") - 1
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(len(self.below) + 1))
        for i in reversed(range(len(self.below))):  # bursts move only what comes later
            rows = order[edges[i] : edges[i + 1]]
            if rows.size:
                self.below[i].add(keys[rows], hashes[rows], counts[rows])
                if isinstance(self.below[i], _Container) and self.below[i].size > BURST:
                    self._burst(i)

    def _burst(self, i: int) -> None:
        keys, counts = self.below[i].rows()
        ids = np.sort(keys[:, self.depth])
        if ids[0] == ids[-1]:
            if self.depth + 1 == self.width:
                return
            deeper = _Node(self.width, self.depth + 1)
            # later keys of the range may have other ids, so the level below serves this id alone
            lows, nodes = [ids[0]], [deeper]
            if self.lows[i] < ids[0]:
                lows, nodes = [self.lows[i], *lows], [_Container(self.width, self.depth), *nodes]
            end = self.lows[i + 1] if i + 1 < len(self.lows) else None
            if ids[0] != np.uint64(2**64 - 1) and ids[0] + np.uint64(1) != end:
                lows, nodes = [*lows, ids[0] + np.uint64(1)], [*nodes, _Container(self.width, self.depth)]
            self._replace(i, lows, nodes)
            deeper.add(keys, _hashes(keys), counts)
            return
        middle = ids[ids.size // 2]
        if middle == ids[0]:
            middle = ids[np.searchsorted(ids, middle, side="right")]
        halves = [_Container(self.width, self.depth), _Container(self.width, self.depth)]
        self._replace(i, [self.lows[i], middle], halves)
        upper = keys[:, self.depth] >= middle
        for half, rows in zip(halves, (~upper, upper)):
            half.add(keys[rows], _hashes(keys[rows]), counts[rows])
        for j in (i + 1, i):
            if self.below[j].size > BURST:
                self._burst(j)

    def _replace(self, i: int, lows: list, nodes: list) -> None:
        self.lows = np.concatenate([self.lows[:i], np.array(lows, np.uint64), self.lows[i + 1 :]])
        self.below[i : i + 1] = nodes

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [x.rows() for x in self.below]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class HatTrie:
    """Counts of id sequences of one width, shorter ones padded by zeros."""

    def __init__(self, width: int):
        self.width, self.root = width, _Node(width, 0)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if len(keys):
            self.root.add(keys, _hashes(keys), np.ones(len(keys), np.int64) if counts is None else counts)

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Give up whole subtrees, the largest first, as sorted runs until at most ``keep`` keys are left."""
        held = self.root.size
        for i in sorted(range(len(self.root.below)), key=lambda i: -self.root.below[i].size):
            if held <= keep or not self.root.below[i].size:
                return
            keys, counts = self.root.below[i].rows()
            held -= len(counts)
            self.root.below[i] = _Container(self.width, 0)
            order = np.lexsort(keys.T[::-1])
            yield keys[order], counts[order]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` of a task; a null word has the number of all words."""
    known: dict[str, Counter] = {}

    def batch(lang: str, found: Counter) -> pa.RecordBatch:
        ends = found.pop(_END, 0)
        rows = sorted(found.items())
        total = sum(found.values())
        found[_END] = ends
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(rows) + 1)), pa.array([None, *(r[0].decode() for r in rows)], pa.string()), pa.array([total, *(r[1] for r in rows)], pa.int64())],
            ["lang", "word", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            known.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, known.values())) > WORDS:
                for name, found in known.items():
                    yield batch(name, found)
                known = {}
    for name, found in known.items():
        yield batch(name, found)


class _Ids(dict):
    """Word of one language to its id; zero for the end of a piece and for words outside the filter."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.seed, self.frequent, self.mask = language_seed(lang), frequent, frequent.size * 8 - 1

    def __missing__(self, word: bytes) -> int:
        id_ = 0 if word == _END else word_id(word, self.seed)
        if id_:  # the probes of ``bloom.probes`` for one key
            step = (id_ >> 32) | 1
            at = [(id_ + i * step) & self.mask for i in range(bloom.PROBES)]
            if not all(self.frequent[x >> 3] >> (7 - (x & 7)) & 1 for x in at):
                id_ = 0
        self[word] = id_
        return id_


def language_seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def word_id(word: bytes, seed: int) -> int:
    """Id of a word of the language with this seed; never zero."""
    return xxhash.xxh3_64_intdigest(word, seed) or 1


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add a word's id, null for the row of all words."""
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("word").to_pylist()
        seeds = {x: language_seed(x) for x in set(langs)}
        ids = np.array([0 if w is None else word_id(w.encode(), seeds[x]) for x, w in zip(langs, texts)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, mask=ids == 0)], [*b.schema.names, "id"])


#: Sequences whose counters are added up: the longer ones are ruled out by these.
COUNTED = (2, 3)
#: Words per counter, counters of a block, positions that a task holds before it hands on blocks.
LOAD, BLOCK, FLUSH = 8, 1 << 18, 3_000_000


def _hashed(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 2 to ``longest`` words: their number, the hash of the words from each id on, whether all are frequent words."""
    h, known = ids, ids > 0
    for n in range(2, longest + 1):
        h = pair_hash(h[:-1], ids[n - 1 :])
        known = known[:-1] & (ids[n - 1 :] > 0)
        yield n, h, known


def _sequences(ids: np.ndarray, starts: int, longest: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Id rows (zeros after the last word) that begin at the first ``starts`` ids and may be frequent."""
    run = None
    for n, h, known in _hashed(ids, longest):
        run = known if run is None else run[:-1] & run[1:]  # a sequence of frequent parts
        if n in COUNTED:
            at = np.flatnonzero(run)
            place = (h[at] & np.uint64(bits.size * 8 - 1)).astype(np.int64)
            run = run.copy()
            run[at] = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
        at = np.flatnonzero(run[:starts])
        rows = np.zeros((at.size, longest), np.uint64)
        for c in range(n):
            rows[:, c] = ids[at + c]
        yield rows


def _blocks(places: np.ndarray) -> pa.RecordBatch:
    """How often each counter is hit, in blocks of counters: steps between them and counts."""
    places = np.sort(places)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    counts = np.diff(np.append(first, places.size)).astype(np.uint32)
    places = places[first]
    edges = np.append(np.flatnonzero(np.diff(places // BLOCK, prepend=-1)), places.size)
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        steps = np.diff(places[lo:hi] % BLOCK, prepend=0).astype(np.uint32)
        rows.append((int(places[lo] // BLOCK), zlib.compress(steps.tobytes(), 1), zlib.compress(counts[lo:hi].tobytes(), 1)))
    block, steps, hits = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(steps), pa.array(hits)], ["block", "steps", "hits"])


def _counters(docs: DataFrame, words_filter, longest: int, n_words: int, least: int) -> np.ndarray:
    """One bit per counter: whether ``least`` sequences fall on it.  At most ``bloom.MAX_BITS``."""
    size = min(bloom.MAX_BITS, max(BLOCK, 1 << int(max(n_words // LOAD, 1) - 1).bit_length()))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids in _chunks(batches, words_filter.value):
            for _, h, known in _hashed(ids, min(longest, COUNTED[-1])):
                held.append((h[known] & np.uint64(size - 1)).astype(np.int64))
                n += held[-1].size
            if n > FLUSH:
                yield _blocks(np.concatenate(held))
                held, n = [], 0
        if n:
            yield _blocks(np.concatenate(held))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, np.zeros(BLOCK, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["block", "bits"])

        for b in batches:
            for block, steps, n in zip(*(c.to_pylist() for c in b.columns)):
                if block != number:
                    if number is not None:
                        yield out()
                    number = block
                    total[:] = 0
                at = np.frombuffer(zlib.decompress(steps), np.uint32).cumsum(dtype=np.int64)
                total[at] += np.frombuffer(zlib.decompress(n), np.uint32)
        if number is not None:
            yield out()

    parts = docs.mapInArrow(hits, "block int, steps binary, hits binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros(size // 8, np.uint8)
    for row in parts.mapInArrow(added, "block int, bits binary").collect():  # 32 MiB at most
        bits[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


_RUN = "part int, keys binary, counts binary"


def _counter(longest: int, parts: int, words_filter, bits) -> Callable:
    """Function from a task's ``lang, text`` batches to sorted runs: the keys and counts of a subtree in a prefix partition."""

    def runs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (pair_hash(keys[:, 0], keys[:, 1]) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")  # keys stay in order
        edges = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), order.size)
        pieces = [order[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([part[p[0]] for p in pieces], pa.int32()), *(pa.array([x[p].tobytes() for p in pieces], pa.binary()) for x in (keys, counts))], ["part", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(longest)
        for ids in _chunks(batches, words_filter.value):
            for lo in range(0, ids.size, CHUNK):
                for rows in _sequences(ids[lo : lo + CHUNK + longest - 1], CHUNK, longest, bits.value):
                    trie.add(rows)
                if trie.root.size * longest > HELD:
                    for keys, counts in trie.spill(HELD // longest // 2):
                        yield runs(keys, counts)
        for keys, counts in trie.spill():
            yield runs(keys, counts)

    return count


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of sorted runs with their summed counts, in order."""
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[first], np.add.reduceat(counts, first)


def _merge(longest: int, least: int) -> Callable:
    """Function that merges the runs of each prefix partition and keeps what was found ``least`` times."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, known = None, [], 0, 0

        def add_up() -> None:
            nonlocal held, size, known
            held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
            size = known = len(held[0][1])

        def out() -> pa.RecordBatch:
            add_up()
            keys, counts = held[0]
            found = counts >= least
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(keys[found, c]).view(np.int64)) for c in range(longest)), pa.array(counts[found])], [*_columns(longest), "a"])

        for b in batches:
            for p, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if held:
                        yield out()
                    part, held, size, known = p, [], 0, 0
                held.append((np.frombuffer(keys, np.uint64).reshape(-1, longest), np.frombuffer(counts, np.int64)))
                size += len(held[-1][1])
                if size > 2 * known + HELD // longest:  # memory is that of the distinct keys
                    add_up()
        if held:
            yield out()

    return merge


def _chunks(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of whole texts, about CHUNK at once; a longer text comes alone."""
    known: dict[str, _Ids] = {}
    held, size = [], 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            found = words(text)
            if lang not in known:
                known[lang] = _Ids(lang, frequent)
            held.append(np.fromiter(map(known[lang].__getitem__, found), np.uint64, len(found)))
            size += len(found)
            if size > CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
            if sum(map(len, known.values())) > WORDS:
                known.clear()
    if held:
        yield np.concatenate(held)


def _columns(width: int) -> list[str]:
    return [f"w{c}" for c in range(1, width + 1)]


def _merged(docs: DataFrame, longest: int, least: int, n_words: int, words_filter, bits) -> DataFrame:
    """``ids, a`` of the sequences found ``least`` times: the runs of a prefix partition meet in one task."""
    names = _columns(longest)
    parts = max(1, -(-n_words // PART_WORDS))
    runs = docs.mapInArrow(_counter(longest, parts, words_filter, bits), _RUN).repartition("part").sortWithinPartitions("part")
    found = runs.mapInArrow(_merge(longest, least), ", ".join(f"{c} long" for c in [*names, "a"]))
    return found.select(F.filter(F.array(*names), lambda w: w != 0).alias("ids"), "a")


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bloom filter of the long column ``key``, at most ``bloom.MAX_BITS``."""
    bits = bloom.filter_bits(keys.count())

    def blocks(batches):  # each key twice, so that the filter of repeats holds all of them
        return bloom.partial_blocks((np.repeat(b["key"].to_numpy(np.int64).view(np.uint64), 2) for b in batches), bits)

    return bloom.twice_filter(keys.select("key").mapInPandas(blocks, bloom.SCHEMA), bits)


def _cuts(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``ids, l, r, score`` of the cut of lowest score, the first one on ties.

    ``found`` has ``ids, a, n``.  Products of counts are decimals of 38 digits.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cut = found.select("ids", "a", "n", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.withColumn("left", F.slice("ids", 1, F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cut = cut.join(counts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
    cut = cut.join(counts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    cut = cut.withColumns({"_above": 1000 * wide("a") * wide("n"), "_below": wide("l") * wide("r")})
    lowest = F.min(F.struct(F.expr("_above div _below").alias("score"), "k", "l", "r")).alias("lowest")
    return cut.groupBy("ids").agg(lowest).select("ids", "lowest.l", "lowest.r", "lowest.score")


def _uncovered(found: DataFrame, cover: int) -> DataFrame:
    """``ids, a`` of ``found`` without those inside a longer one that has ``cover`` percent of their count."""
    parts = found.where(F.size("ids") > 2).select("ids", "a", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("size"))
    parts = parts.select("ids", "a", "size", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("size") + 1)).alias("start"))
    longer = parts.groupBy(F.slice("ids", F.col("start"), F.col("size")).alias("ids")).agg(F.max("a").alias("longer"))
    kept = found.join(longer, "ids", "left")
    return kept.where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).select("ids", "a")


def collocations(
    docs: DataFrame, least: int = 100, max_words: int = 5, top: int = 2000, cover: int = 100, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and
    at spaces and tabs into words.  ``n`` counts a language's words, ``a`` the
    occurrences of a phrase of 2 to ``max_words`` words, overlaps included, if
    there are ``least``.  Cut in two it scores floor(1000 a n / (l r)) with the
    occurrences of both parts; the lowest cut counts.  A phrase within a longer
    one that has at least ``cover`` percent of its occurrences is dropped.

    A null language is ``und``, as is one of that name.  Null and empty texts
    have no words; texts of any length are read whole; repeated rows each count.
    Ties in score go to the larger ``a``, then the smaller phrase in byte order.
    A language without phrases, and an empty table, give no rows; further columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    single = docs.mapInArrow(_word_rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    single = written(single.where((F.col("n") >= least) | F.col("word").isNull()).mapInArrow(_with_ids, "lang string, word string, n long, id long"), "words")
    totals, names = single.where("word IS NULL").select("lang", "n"), single.where("word IS NOT NULL")
    words_filter = spark.sparkContext.broadcast(_filter_of(names.select(F.col("id").alias("key"))))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    bits = spark.sparkContext.broadcast(_counters(docs, words_filter, max_words, n_words, least))
    found = written(_merged(docs, max_words, least, n_words, words_filter, bits), "phrases")
    counts = found.unionByName(names.select(F.array("id").alias("ids"), F.col("n").alias("a")))

    place = found.select("ids", F.posexplode("ids").alias("at", "id")).join(names.select("id", "lang", "word"), "id")
    text = place.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    text = text.select("ids", "lang", F.concat_ws(" ", F.col("words.word")).alias("phrase"))
    kept = written(_uncovered(found, cover).join(text, "ids").join(totals, "lang"), "phrases")
    scored = kept.join(_cuts(kept, counts), "ids")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
