"""Two Bloom filters over 64-bit hashes of a whole corpus: seen once, seen twice.

Each task sets bits for its rows and hands on compressed blocks of both filters;
blocks of the same number are merged in a stream, so memory is one block.  A bit
is in the second filter if two keys set it.  A key occurring twice therefore has
all its bits there; a key occurring once rarely has.

The filter has 8 bits a key but never over ``MAX_BITS``, which bounds the
broadcast to 32 MiB.  A fuller filter suspects more keys; callers confirm
suspects exactly, so results do not depend on its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_BITS = 1 << 28
BLOCK_BITS = 1 << 18
PROBES = 3
#: Positions kept in a task before they are turned into blocks.
FLUSH = 6_000_000
SCHEMA = "block int, once binary, twice binary"


def filter_bits(n_keys: int) -> int:
    """Size of a filter for ``n_keys`` keys: a power of two, one block at least."""
    return min(MAX_BITS, max(BLOCK_BITS, 1 << int(8 * max(n_keys, 1) - 1).bit_length()))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, one row per probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def _blocks(positions: np.ndarray) -> Iterator[dict]:
    positions.sort()
    first = np.flatnonzero(np.diff(positions, prepend=-1))
    count = np.diff(np.append(first, positions.size))
    unique, block = positions[first], positions[first] // BLOCK_BITS
    edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), block.size)
    for lo, hi in zip(edges[:-1], edges[1:]):
        at = unique[lo:hi] % BLOCK_BITS
        once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
        once[at], twice[at] = True, count[lo:hi] > 1
        yield {"block": int(block[lo]), **{n: zlib.compress(np.packbits(x).tobytes(), 1) for n, x in (("once", once), ("twice", twice))}}


def partial_blocks(hashes: Iterable[np.ndarray], bits: int) -> Iterator[pd.DataFrame]:
    """Blocks of one task's keys; each array holds a document's or batch's keys."""
    kept: list[np.ndarray] = []
    size = 0
    for h in hashes:
        kept.append(probes(h, bits).ravel())
        size += kept[-1].size
        if size > FLUSH:
            yield pd.DataFrame(list(_blocks(np.concatenate(kept))), columns=["block", "once", "twice"])
            kept, size = [], 0
    if size:
        yield pd.DataFrame(list(_blocks(np.concatenate(kept))), columns=["block", "once", "twice"])


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def bits_of(raw: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(raw), np.uint8)

    number, once, twice = None, None, None
    for batch in batches:
        done = []
        for block, o, t in zip(batch["block"], batch["once"], batch["twice"]):
            if block != number:
                if number is not None:
                    done.append((number, zlib.compress(twice.tobytes(), 1)))
                number, once, twice = block, bits_of(o).copy(), bits_of(t).copy()
            else:
                o = bits_of(o)
                twice |= bits_of(t) | (once & o)
                once |= o
        yield pd.DataFrame(done, columns=["block", "twice"])
    if number is not None:
        yield pd.DataFrame([(number, zlib.compress(twice.tobytes(), 1))], columns=["block", "twice"])


def twice_filter(partial: DataFrame, bits: int) -> np.ndarray:
    """Merge the tasks' blocks; the second filter as bytes, at most ``MAX_BITS / 8``."""
    merged = partial.repartition("block").sortWithinPartitions("block").mapInPandas(_merged, "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    width = BLOCK_BITS // 8
    for row in merged.toLocalIterator():
        out[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def suspects(hashes: np.ndarray, filter_bytes: np.ndarray) -> np.ndarray:
    """Mask of the hashes whose bits are all set."""
    at = probes(hashes, filter_bytes.size * 8)
    return ((filter_bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
