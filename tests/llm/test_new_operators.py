"""Language identification, hard negatives and phrases against plain versions on awkward rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postmill.llm import catalog, languages, negatives, phrases

DOCS = "doc_id long, text string, lang string, words string, ids string, a string, n string, score string, rank string, phrase string"
EXTRA = ("x",) * 7


# ---- phrases ------------------------------------------------------------------

def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "été", "New", "york"]
    out = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += ["New", "York", "city"] if rng.random() < 0.1 else [rng.choice(vocabulary)]
            words[-1] += rng.choice(["", "", "", ".", ",", "\t", "\n", " ", "\x1c", "!?"])
        out.append((i, " ".join(words), rng.choice(["en", "fr", None, "und"])))
    out += [(200, None, "en"), (201, "", "en"), (202, " \t.\n", None), (203, "b " * 30_000, "en"), (5, out[5][1], out[5][2]), (None, "w1 w2 w3", "en")]
    return out


def plain_phrases(rows, least, max_words, top, cover):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = (q for q, b in found.items() if len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))))
            if next(inside, None) is None:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        rows.sort()
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,max_words,top,cover", [(5, 5, 2000, 100), (3, 3, 10, 60), (4, 2, 7, 100)])
def test_phrases(spark, monkeypatch, least, max_words, top, cover):
    rows = texts()
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)
    got = phrases.collocations(docs, least, max_words, top, cover)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, max_words, top, cover)
    assert phrases.collocations(docs.limit(0)).collect() == []


@pytest.mark.parametrize("width", [1, 2, 4])
def test_trie_counts_and_spills_sorted_runs(monkeypatch, width):
    monkeypatch.setattr(phrases, "BURST", 64)
    rng = np.random.default_rng(1)
    trie, total = phrases.HatTrie(width), Counter()
    for n in range(6):
        keys = rng.zipf(1.3, (3000, width)).clip(max=2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys[:1500, 0] = keys[0, 0]  # one prefix holds half of all
        trie.add(keys)
        for k, c in trie.spill(1000) if n % 2 else ():
            assert k.tolist() == sorted(k.tolist())
            for row, x in zip(k.tolist(), c.tolist()):
                total[tuple(row)] -= x
        total.update(map(tuple, keys.tolist()))
    assert trie.root.size > 64 and len(trie.root.below) > 1
    for k, c in trie.spill():
        for row, x in zip(k.tolist(), c.tolist()):
            total[tuple(row)] -= x
    assert trie.root.size == 0 and not any(total.values())


def test_phrases_do_not_depend_on_what_a_trie_holds(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)
    parts = docs.select("lang", "text").fillna("und", "lang")
    full = type("B", (), {"value": np.full(phrases.BLOCK // 8, 255, np.uint8)})  # filters that rule nothing out
    run = list(phrases._merge(5, 1)(phrases._counter(5, 1, full, full)(iter(_record_batches(parts)))))
    total = Counter()
    for b in run:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            total[row[:-1]] += row[-1]
    expected = Counter()
    for _, text, lang in rows:
        seed = phrases.language_seed(lang or "und")
        for piece in b" ".join(phrases.words(text)).split(phrases._END):
            ids = [np.uint64(phrases.word_id(w, seed)).view(np.int64).item() for w in piece.split()]
            for k, i in itertools.product(range(2, 6), range(len(ids))):
                if i + k <= len(ids):
                    expected[tuple(ids[i : i + k] + [0] * (5 - k))] += 1
    assert total == expected


def _record_batches(df):
    return df.toArrow().to_batches(max_chunksize=7)


# ---- hard negatives -----------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, id string, q string, tile string, score string, rank string, place string"


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=7).astype(np.float32)]) for i in range(400)]
    rows[100:160] = [(r[0], r[1], rows[100][2]) for r in rows[100:160]]  # many ties
    for i in (7, 50, 203):
        rows[i] = (i, rows[i][1], [float(x) for x in -3 * np.ones(7)])
    nan, inf = float("nan"), float("inf")
    odd = [(400, None, [1.0] * 7), (401, 1, None), (402, 1, [1.0, None] + [1.0] * 5), (403, 1, [nan] * 7), (404, 1, [inf] * 7), (450, 1, [-inf] + [0.0] * 6),
           (None, 1, [1.0] * 7), (405, 1, []), (406, 2, [1.0, 2.0]), (500, 9, [1.0] * 7), rows[3], rows[150]]
    return rows + odd


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    whole = [(i, k, [math.floor(scale * x) for x in v]) for i, k, v in rows if None not in (i, k, v) and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in {r[0]: r for r in sorted(whole, reverse=True) if r[0] % 50 == 0}.values():
        others = sorted((-score(v, w), i, k) for i, k, w in whole)
        for s, p in [(-s, i) for s, i, k in others if k == label and i != a][:positives]:
            fit = [(-t, i) for t, i, k in others if k != label and low * s <= -100 * t <= high * s][:negatives]
            out += [(a, p, r, i, s, t) for r, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, *("x",) * 6) for r in rows], VECTORS).repartition(3)
    for anchors, candidates, cells in ((512, 2048, 8), (3, 16, 2)):
        for name, value in (("ANCHORS", anchors), ("CANDIDATES", candidates), ("GRID_ROW", cells), ("GRID_COLUMN", cells)):
            monkeypatch.setattr(negatives, name, value)
        got = negatives.hard_negatives(df, "vec_id % 50 = 0")
        assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    got = negatives.hard_negatives(df, "vec_id % 50 = 0", 2, 40, 10, 100, 1)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 2, 40, 10, 100, 1)
    assert negatives.hard_negatives(df.limit(0), "vec_id % 50 = 0").collect() == []
    assert negatives.hard_negatives(df, "vec_id = -1").collect() == []


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (64, 33, 130), (100, 64, 31), (129, 200, 67)])
def test_strassen(shape):
    rng = np.random.default_rng(2)
    for most in (300, 2**29):  # the second leaves the exact range of floats
        a, b = rng.integers(-most, most, shape[:2]), rng.integers(-most, most, shape[1:])
        assert (negatives.strassen(a, b, 4) == a @ b).all() and (negatives.strassen(a, b) == a @ b).all()
    with pytest.raises(OverflowError):
        negatives.scores(np.full((1, 2), 2**30), np.full((1, 2), 2**30))


# ---- languages ----------------------------------------------------------------

def plain_subwords(text):
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    codes = " " + "".join(low(c) if c.isalpha() else " " for c in text) + " "
    for n in range(1, 5):
        for i in range(len(codes) - n + 1):
            part = codes[i : i + n]
            if " " not in part[1:-1] and part.strip():
                yield part


def test_subwords_and_means(monkeypatch):
    all_texts = ["Don't 1 panic", "", None, "ñandú ÉTÉ.\nx", "日本 語", "123", "a" * 50, "word " * 40]
    names = {}
    table = np.random.default_rng(1).normal(size=(languages.BUCKETS, 3))
    for chunk in (1 << 20, 16, 30):
        monkeypatch.setattr(languages, "CHUNK", chunk)
        got = languages.means(all_texts, table)
        for text, mean in zip(all_texts, got):
            parts = list(plain_subwords(text or ""))
            at, share = languages.frequencies(text)
            assert math.isclose(share.sum(), 1 if parts else 0, abs_tol=1e-5) and len(at) <= len(set(parts))
            assert np.allclose(share @ table[at], mean, atol=1e-5)
            if parts:
                for p in set(parts):  # the bucket of a subword alone in a text is found in every text with it
                    if p.strip() == p:
                        names.setdefault(p, set(languages.frequencies(p)[0].tolist()))
                one = Counter(parts)
                assert share.size == 0 or math.isclose(float(share.max()), max(one.values()) / len(parts), rel_tol=1e-4) or len(at) < len(one)


def spoken():
    rng = random.Random(6)
    sounds = {"aa": "ka mo ri tu ne".split(), "bb": "sch ung ver ten ich".split(), "cc": "ção lha os nha em".split()}
    rows = []
    for i in range(900):
        lang = rng.choice(list(sounds))
        words = [" ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 60)))]
        rows.append((i, words[0], None if i % 17 == 0 else lang, lang))
    return rows


def test_languages_learn_and_reject(spark):
    rows = spoken()
    extra = [(1000, None, "aa", "und"), (1001, "", "bb", "und"), (1002, "12 .. 34\n", None, "und"), (1003, "kamo" * 600_000, None, "aa"), rows[4], (None, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, truth string").selectExpr("*", "'x' AS lang_pred", "'y' AS at", "'z' AS share")
    model = languages.train(docs.where(~catalog.held_out()), rows=300)
    assert model.languages == ["aa", "bb", "cc"] and 0 <= model.accept <= 1.1
    out = languages.identify(docs, model).collect()
    assert len(out) == len(rows) + len(extra) and set(docs.columns) <= set(out[0].asDict())
    for r in out:
        assert r["lang_pred"] == r["truth"] or r["lang_score"] < 0.9, r["doc_id"]
        if r["truth"] == "und":
            assert (r["lang_pred"], r["lang_score"], r["lang_accepted"]) == ("und", 0.0, False)
        assert 0 <= r["lang_score"] <= 1 and r["lang_accepted"] == (r["lang_pred"] != "und" and r["lang_score"] >= model.accept)
    held = [r for r in out if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["truth"] != "und"]
    assert sum(r["lang_pred"] == r["truth"] for r in held) >= 0.99 * len(held)
    again = languages.train(docs.repartition(5).where(~catalog.held_out()), rows=300)
    assert (again.embedding == model.embedding).all() and again.accept == model.accept


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = languages.train(docs)
    assert [tuple(r)[-3:] for r in languages.identify(docs, model).collect()] == [("und", 0.0, False)]
    assert languages.identify(docs.limit(0), model).collect() == []


def test_calibration():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3)) + 2 * np.eye(3)[y]
    t, accept = languages.calibrate(logits * 3, y, 0.9)  # twice the logits would be right, so three times are 1.5 too hot
    p = languages._softmax(logits * 3 / t)
    assert 1.3 < t < 1.7 and abs(p.max(axis=1).mean() - (p.argmax(axis=1) == y).mean()) < 0.03
    taken = p.max(axis=1) >= accept
    assert (p.argmax(axis=1) == y)[taken].mean() >= 0.9 > (p.argmax(axis=1) == y).mean()
    assert languages.calibrate(np.zeros((0, 3)), y[:0]) == (1.0, 0.0)


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = catalog.op11_language_id(spark, sf).where("held_out").collect()
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
