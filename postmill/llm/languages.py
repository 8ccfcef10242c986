"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text's subwords are its sequences of one to four code points in which only the
first and the last may be a blank; everything but letters and their marks is a
blank.  Each subword is hashed to a row of an embedding table; a text is the mean
of its subwords' rows, and a linear softmax over it gives the languages.  Both
are trained by stochastic gradient descent in numpy on a bounded sample of
labelled texts.  A part of the sample is kept from training: there the scores get
their temperature, and the level below which an answer is not accepted.

The softmax is linear in the mean, so with few languages the table of products
(subword by language) is what scores texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

#: Labelled texts that a model is trained on, at most (in expectation), in equal parts for all languages.
TRAIN_ROWS = 4_000
#: Rows and width of the embedding table, longest subword.
BUCKETS, WIDTH, LONGEST = 1 << 16, 16, 4
#: Code points handled at once.
CHUNK = 1 << 20
UNKNOWN = "und"
SEED_SPACE = 1 << 30
_BLANK = 32
_LAST = 0x32400  # no letters above, and only marks that choose between glyphs


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter or mark, or the blank."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(_LAST):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _subwords(codes: np.ndarray, starts: int) -> Iterator[np.ndarray]:
    """For each length the bucket of the subword at each place; ``BUCKETS`` where there is none or it begins later than ``starts``."""
    letter = codes != _BLANK
    h = np.zeros(codes.size, np.uint32)
    inner = np.ones(codes.size, bool)
    for n in range(1, min(LONGEST, codes.size) + 1):
        size = codes.size - n + 1
        h = h[:size] * np.uint32(0x01000193) + codes[n - 1 :]
        if n > 2:
            inner = inner[:size] & letter[n - 2 : n - 2 + size]
        good = inner[:size] & (letter[:size] | letter[n - 1 :])
        bucket = np.full(codes.size, BUCKETS, np.int64)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
        bucket[:size][good] = (mixed[good] ^ (mixed[good] >> np.uint32(13))) & np.uint32(BUCKETS - 1)
        bucket[starts:] = BUCKETS
        yield bucket


def _batches(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Code points of texts, each between blanks: codes, where each text begins, its number, starts that count.

    A text longer than CHUNK comes in pieces, each followed by the beginning of the next.
    """
    held, size, numbers = [], 0, []

    def batch():
        starts = np.append(0, np.cumsum([len(x) for x in held])[:-1])
        return np.concatenate(held), starts, np.array(numbers), size

    for i, text in enumerate(texts):
        raw = np.frombuffer(f" {text or ''} ".encode("utf-32-le"), np.uint32)
        if raw.size > CHUNK:
            for lo in range(0, raw.size, CHUNK):
                yield _letters()[raw[lo : lo + CHUNK + LONGEST - 1]], np.zeros(1, np.int64), np.array([i]), CHUNK
            continue
        held.append(_letters()[raw])
        numbers.append(i)
        size += raw.size
        if size > CHUNK:
            yield batch()
            held, size, numbers = [], 0, []
    if held:
        yield batch()


def means(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` (a row per bucket) over the subwords of each text; zeros without subwords."""
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    columns = [np.append(table[:, c], 0.0) for c in range(table.shape[1])]
    columns.append(np.append(np.ones(len(table)), 0.0))
    for codes, starts, numbers, limit in _batches(texts):
        for bucket in _subwords(codes, limit):
            for c, column in enumerate(columns):
                total = np.add.reduceat(column[bucket], starts)
                if c < table.shape[1]:
                    np.add.at(out[:, c], numbers, total)
                else:
                    np.add.at(n, numbers, total)
    return out / np.maximum(n, 1)[:, None]


def frequencies(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    count = np.zeros(BUCKETS + 1, np.int64)
    for codes, _, _, limit in _batches([text]):
        for bucket in _subwords(codes, limit):
            count += np.bincount(bucket, minlength=BUCKETS + 1)
    at = np.flatnonzero(count[:-1])
    return at.astype(np.int32), (count[at] / max(count[:-1].sum(), 1)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """Languages in order, embedding table, softmax, temperature, and the score from which answers are accepted."""

    languages: list[str]
    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def folded(self) -> tuple[np.ndarray, np.ndarray | None]:
        """The table to average, and what is multiplied to the mean: the smaller work of both orders."""
        if len(self.languages) <= self.embedding.shape[1]:
            return self.embedding @ self.weight, None
        return self.embedding, self.weight

    def probabilities(self, mean: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        return _softmax(((mean if weight is None else mean @ weight) + self.bias) / self.temperature)


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, epochs: int = 4, rate: float = 1.0, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Embeddings, weights and bias after ``epochs`` over rows of (buckets, shares) with classes ``y`` below ``n``.

    A text moves each of its subwords by its small share, so embeddings have ten times the rate.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    w, b = np.zeros((WIDTH, n)), np.zeros(n)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            speed = rate * (1 - step / steps)
            mean = share @ e[at]
            g = _softmax(mean @ w + b)
            g[y[i]] -= 1
            back = w @ g
            w -= speed * np.outer(mean, g)
            b -= 0.01 * speed * g
            e[at] -= 10 * speed * np.outer(share, back)
            step += 1
    return e, w, b


def calibrate(logits: np.ndarray, y: np.ndarray, precision: float = 0.99) -> tuple[float, float]:
    """Temperature of the least log loss, and the least score above which ``precision`` of the answers are right.

    Without rows: 1 and 0.  If no level is that precise, a level above all scores.
    """
    if not len(y):
        return 1.0, 0.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / t)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == y[order]) / np.arange(1, len(y) + 1)
    precise = np.flatnonzero(right >= precision)
    return t, float(p.max(axis=1)[order][precise[-1]]) if precise.size else 1.0 + 1e-9


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learn from ``labelled``: about ``rows`` texts with a language and a letter, the same number of each language.

    Texts are chosen by a hash of the id, so a repeated row is in as often as it
    is repeated; whole texts are read.  Every fifth one calibrates.  Without
    labelled texts the model knows no language.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = sizes.select("lang", F.least(F.lit(1.0), rows / F.col("n") / sizes.agg(F.count(F.lit(1))).scalar()).alias("share"))
    # one row per language: no text moves to meet it
    draw = F.pmod(F.xxhash64("id"), F.lit(SEED_SPACE))
    picked = known.join(F.broadcast(share), "lang").where(draw < SEED_SPACE * F.col("share")).select("lang", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).alias("test"), "text")

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [frequencies(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("test"), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in range(2))], ["lang", "test", "at", "share"])

    found = picked.mapInArrow(batch, "lang string, test boolean, at binary, share binary").toPandas()  # bounded by ``rows`` and BUCKETS
    found = found.sort_values(["lang", "at", "share"], ignore_index=True)  # any order of tasks gives one model
    languages = sorted(set(found["lang"]))
    y = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    x = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for a, s in zip(found["at"], found["share"])]
    test = found["test"].to_numpy(bool)
    learned = np.flatnonzero(~test) if (~test).any() else np.arange(len(x))
    e, w, b = sgd([x[i] for i in learned], y[learned], len(languages))
    model = Model(languages, e, w, b)
    checked = np.flatnonzero(test)
    logits = np.array([s @ e[at] for at, s in (x[i] for i in checked)]).reshape(-1, WIDTH) @ w + b
    model.temperature, model.accept = calibrate(logits, y[checked])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``lang_score``, ``lang_accepted``.

    The likeliest learned language, its calibrated probability, and whether that
    reaches the model's level.  A text that is null or without a letter (empty
    and blank ones too), and every text if no language was learned, is ``und``
    with score 0, not accepted.  Whole texts of any length are read; repeated
    rows each get their answer; equal probabilities go to the first language in
    order.  Input columns of the three names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_accepted", BooleanType())])
    table, weight = model.folded()
    shared = docs.sparkSession.sparkContext.broadcast((table, weight))  # BUCKETS rows of at most WIDTH numbers, and WIDTH per language
    rest = Model(model.languages, np.zeros((0, WIDTH)), model.weight, model.bias, model.temperature, model.accept)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weight = shared.value
        for b in batches:
            texts = b.column(text_col).to_pylist()
            known = [bool(rest.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
            name, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(known)
            if at.size:
                p = rest.probabilities(means([texts[i] for i in at], table), weight)
                score[at] = p.max(axis=1)
                for i, best in zip(at, p.argmax(axis=1)):
                    name[i] = rest.languages[best]
            accepted = pa.array(np.array(known, bool) & (score >= rest.accept))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name, pa.string()), pa.array(score), accepted], [*b.schema.names, "lang_pred", "lang_score", "lang_accepted"])

    return docs.mapInArrow(batch, schema)
