"""Each corpus operator against a plain version on small tables with awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import bloom, components, hosts, leaks, lines, mixing, ngrams, quality, search, shards, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu la me ni po ru".split() for b in ["", "l", "st", "rn", "m"]]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Copies, near copies, shared lines, null, empty, blank, very long and repeated rows."""
    rng = random.Random(5)
    shared = [sentence(rng, 14) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
        for s in shared:
            if rng.random() < 0.3:
                parts.insert(rng.randrange(len(parts) + 1), ("  " + s.upper() + "\t") if rng.random() < 0.3 else s)
        rows.append((i, "\n".join(parts)))
    for i in range(60, 75):
        words = rows[i % 7][1].split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(75, None), (76, ""), (77, " \t\n "), (78, "one"), (79, "One"), (80, sentence(rng, 9000)), (3, rows[3][1]), (None, rows[4][1])]
    return [(i, t, "en", None if n % 9 == 0 else "s" + "abé"[n % 3] * (n % 2 + 1), len(t or "")) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that operators use for themselves."""
    for c in ("id", "key", "n", "size", "target", "taken", "pieces", "shard", "slot", "quality_score", "raw", "host", "copy",
              "_source", "_ends", "_of", "_at", "_slice", "_slices", "_first", "_place", "_start", "_before", "_key", "_tie", "_row", "_part", "row", "place"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


def test_bloom_suspects_all_repeats():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = bloom.filter_bits(6000)
    parts = list(bloom.partial_blocks([keys, keys[:500]], bits))
    once = bloom._merged(iter(parts))
    out = np.zeros(bits // 8, np.uint8)
    import zlib

    for frame in once:
        for block, raw in zip(frame["block"], frame["twice"]):
            out[block * bloom.BLOCK_BITS // 8 : (block + 1) * bloom.BLOCK_BITS // 8] = np.frombuffer(zlib.decompress(raw), np.uint8)
    hit = bloom.suspects(keys, out)
    assert hit[:500].all() and hit[500:].mean() < 0.1


def test_lines(docs, none):
    rows = corpus()
    holders = defaultdict(set)

    def key(line):
        k = line.strip(" \t\n\v\f\r")
        return "".join(c.lower() if c < "\x80" else c for c in k) if len(k) >= 40 else None

    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and key(line):
                holders[key(line)].add(i)
    expected = []
    for i, t, *_ in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if i is None or not (h := holders.get(key(x))) or len(h) < 5 or max(h) == i]
        expected.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = [tuple(r) for r in lines.dedup_lines(clashing(docs)).collect()]
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert any(r[2] for r in expected)
    assert lines.dedup_lines(none).collect() == []


def test_targets_share_the_excess():
    got = mixing.targets([100, 1000, 50, 1000])
    assert math.isclose(sum(got), 1.5 * 2150) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [100, 1000, 50, 1000]))
    assert got[0] == 200 and got[2] == 100 and mixing.targets([]) == [] and mixing.targets([0]) == [0]


def test_quotas_split_exactly():
    for quotas in ([5, 0, 17, 1000], [3], [0], [10**10, 7]):
        out = mixing.split_quotas(quotas, 8, seed=3)
        assert out.sum(axis=0).tolist() == quotas and (out >= 0).all()
        assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 8


def test_mixing(docs, none):
    got = mixing.mix(clashing(docs), slice_rows=5).select("doc_id", "source", "size", "source_size", "target", "taken", "pieces", "key").collect()
    again = mixing.mix(docs.repartition(5), slice_rows=5).select("doc_id", "source", "taken").collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in got) == Counter((r.doc_id, r.source, r.taken) for r in again)
    assert len(got) == len(corpus())
    by, words = defaultdict(list), Counter()
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 2 * r["size"] and sum(p.words for p in r.pieces) == r.taken
        for p in r.pieces:
            words[p.shard] += p.words
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    assert math.isclose(sum(r[0].target for r in by.values()), 1.5 * sum(r["size"] for r in got))
    assert max(words.values()) - min(words.values()) <= 8
    assert mixing.mix(none).collect() == []


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_urls(spark):
    urls = {
        0: "http://A.Example.com/en/1?x", 1: "https://www.example.com/en/", 2: "http://m.www.EXAMPLE.com/en/9", 3: "http://example.com/fr", 4: "http://notexample.com/en/1",
        5: "http://x.net/es/1", 6: "http://bad.org/1", 7: "http://bad.org/2#en", 8: None, 9: "no scheme", 10: "http://example.com", 11: "http://a.org?u=http://b.com/", 12: "",
    }
    for n in range(40):
        urls[100 + n] = f"http://bad.org/{n}"
        urls[200 + n] = f"http://good.org/{n}"
    pages = spark.createDataFrame(list(urls.items()) + [(6, urls[6])], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS n")
    outcomes = spark.createDataFrame([(100 + n, 1) for n in range(40)] + [(200 + n, 0) for n in range(40)] + [(0, None)], "p long, b int")
    got = {r.page_id: r for r in hosts.filter_urls(pages, outcomes, RULES).collect()}
    assert [got[i].rule for i in range(7)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "com/", "net/es/", None]
    assert [got[i].verdict for i in range(8)] == ["block", "allow", "allow", "allow", "allow", "block", "block", "block"]
    assert (got[0].host, got[0].path) == ("a.example.com", "/en/1") and (got[11].host, got[11].path) == ("a.org", "")
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in (8, 9, 12))
    assert got[10].rule is None and got[201].verdict == "allow" and got[101].rate > 0.5 > got[201].rate
    assert hosts.filter_urls(pages.limit(0), outcomes, RULES).collect() == []
    assert {r.verdict for r in hosts.filter_urls(pages, outcomes.limit(0), []).collect()} == {"allow"}


def test_names_and_domains(spark):
    rows = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "x.org": ("org", "x.org"), "org": ("org", "org"), "u:p@w.x.org:8080": ("org", "x.org"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"),
        "[2001:db8::1]:443": ("[2001:db8::1]",) * 2, "a.b.c.d.example": ("example", "d.example"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in rows], "host string").withColumn("name", hosts.name_of(hosts.F.col("host")))
    assert {r.host: (r.suffix, r.domain) for r in hosts.with_domains(df).collect()} == rows
    table = spark.createDataFrame([("c.d.example",), ("d.example",), ("org",)], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in hosts.with_domains(df, table).collect()}
    assert got == rows | {"a.b.co.uk": ("uk", "co.uk"), "a.b.c.d.example": ("c.d.example", "b.c.d.example")}


def test_reputation_ignores_port_and_user(spark):
    pages = spark.createDataFrame([(n, f"http://bad.org:{8000 + n}/x") for n in range(40)] + [(99, "http://me@bad.org/")] + [(200 + n, f"http://good.org/{n}") for n in range(40)], "page_id long, url string")
    outcomes = spark.createDataFrame([(n, 1) for n in range(40)] + [(200 + n, 0) for n in range(40)], "p long, b int")
    got = {r.page_id: r for r in hosts.filter_urls(pages, outcomes, [], suffixes=spark.createDataFrame([("org",)], "suffix string")).collect()}
    assert got[99].verdict == "block" and got[99].host == "me@bad.org" and got[0].host == "bad.org:8000" and got[201].verdict == "allow"


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (5, 5), (20, 21), (20, 21), (22, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and {got[i] for i in (20, 21, 22)} == {20} and {got[100 + i] for i in range(41)} == {100}
    some = components.components(spark.createDataFrame(links, "a long, b long"), rounds=1)
    assert some.count() == some.select("node").distinct().count() == len(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


@pytest.mark.parametrize("width,threshold,rounds", [(3, 90, 3), (5, 80, 0), (2, 60, 1)])
def test_near_sets(docs, none, monkeypatch, width, threshold, rounds):
    monkeypatch.setattr(ngrams, "ROUNDS", rounds)
    texts = [(i, sets_of(t, width)) for i, t, *_ in corpus() if i is not None]
    group = {i: i for i, _ in texts}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, (i, a) in enumerate(texts):
        for j, b in texts[:n]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    got = ngrams.near_sets(clashing(docs), width, threshold).collect()
    assert len(got) == len(corpus())
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == Counter((i, len(a), find(i)) for i, a in texts)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngrams.near_sets(none).collect() == []


def test_light_sets_are_keyed_by_pairs(docs, monkeypatch):
    """The same groups with every set light and with every set heavy."""
    out = []
    for limit in (0, 10**6):
        monkeypatch.setattr(ngrams, "boundary", lambda *_: limit)
        out.append(Counter(tuple(r) for r in ngrams.near_sets(docs, 3, 90).collect()))
    assert out[0] == out[1]


def test_boundary_follows_cost():
    few, many = np.full(1000, 2), np.full(1000, 2)
    many[:400] = 300
    sizes = [(n, 1) for n in range(1, 400)]
    assert 0 < ngrams.boundary(sizes, few, 90) < 100 and ngrams.boundary([], few, 90) == 0
    assert ngrams.boundary(sizes, many, 90) >= ngrams.boundary(sizes, few, 90)


def test_quality(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, ("$$ " + sentence(rng, 30).replace(" ", " | ")) if i % 4 == 0 else sentence(rng, 40) + ".", i) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality_score long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(table, labels, rows=1000)
    got = {r.doc_id: r.quality_score for r in quality.score(table, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in range(300, 400)]) > 0.95
    scores = quality.score(clashing(docs), model).collect()
    assert len(scores) == len(corpus()) and all(0 <= r.quality_score <= 1 for r in scores)
    assert quality.score(none, model).collect() == []
    empty = quality.train(none, labels)
    assert all(r.quality_score == pytest.approx(0.5) for r in quality.score(docs, empty).collect())


def test_search(spark, docs, none):
    queries = docs.where("doc_id % 7 = 0").selectExpr("doc_id AS query_id", "text")
    rows = corpus()
    words = [search_words(t) for _, t, *_ in rows]
    df, n = Counter(w for c in words for w in c), len(rows)
    mean = sum(sum(c.values()) for c in words) / n
    expected = []
    for i, t, *_ in rows:
        if i is None or i % 7:
            continue
        found = []
        for (j, *_), c in zip(rows, words):
            length = sum(c.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in set(search_words(t)) if c[w])
            if s > 0:
                found.append((-round(s, 6), j is not None, j or 0))
        expected += [(i, k + 1, j if known else None, -s) for k, (s, known, j) in enumerate(sorted(found)[:4])]
    got = search.top_k(clashing(docs), queries, k=4).collect()
    assert Counter((r.query_id, r["rank"], r.doc_id) for r in got) == Counter(x[:3] for x in expected)
    assert sum(r.score for r in got) == pytest.approx(sum(x[3] for x in expected))
    assert search.top_k(none, queries).collect() == [] and search.top_k(docs, queries.limit(0)).collect() == []


def search_words(text):
    return Counter((text or "").encode().translate(search._LOWER, search._DROP).split())


def test_search_in_several_passes(docs, monkeypatch):
    queries = docs.where("doc_id % 7 = 0 AND doc_id < 70").selectExpr("doc_id AS query_id", "text")
    one = search.top_k(docs, queries).collect()
    monkeypatch.setattr(search, "QUERY_ROWS", 3)
    monkeypatch.setattr(search, "BLOCK_DOCS", 7)
    assert Counter(map(tuple, search.top_k(docs, queries).collect())) == Counter(map(tuple, one))


def prose(n):
    """Documents of frequent and rare words, 3 to 60 each."""
    rng = np.random.default_rng(7)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(3, 60)) % 5000)) for i in range(n)]


def test_search_tasks_start_with_limits(spark, monkeypatch):
    """Most tasks know what a row has to reach, so they hand on far fewer than k rows a query."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 5)
    rows, real = [], search.written

    def counted(df, name, *a, **k):
        out = real(df, name, *a, **k)
        if name == "found":
            rows.append(out.count())
        return out

    monkeypatch.setattr(search, "written", counted)
    docs = spark.createDataFrame(prose(600), "doc_id long, text string").repartition(60, "doc_id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "8k" if "max" in k else "0")
        got = search.top_k(docs, docs.where("doc_id % 30 = 0").withColumnRenamed("doc_id", "query_id"), k=3).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 20 * 3 and sum(rows) < 60 * 20 * 3 / 2
    assert all(r.doc_id == r.query_id for r in got if r["rank"] == 1)


@pytest.mark.parametrize("common, pairs", [(-1, 10), (0.01, 50), (0.004, 200_000), (1, 1)])
def test_search_by_matrix_and_by_postings(spark, monkeypatch, common, pairs):
    """Whichever terms go through the matrix, and whatever is handled at once, rows and scores are those of every pair compared."""
    rows = prose(90) + [(100, "w1 w2"), (101, "w1 w2"), (102, ""), (103, None)]
    words = {i: search_words(t) for i, t in rows}
    asked = [np.unique(search.terms(t, search._Terms())) for _, t in rows]
    vocabulary, df = np.unique(np.concatenate(asked), return_counts=True)
    q = search._Queries(np.concatenate(asked), np.array([a.size for a in asked]), vocabulary, df, len(rows))
    mean = sum(sum(c.values()) for c in words.values()) / len(rows)
    monkeypatch.setattr(search, "BLOCK_DOCS", 16)
    blocks = [r.asDict() for r in search.index(spark.createDataFrame(rows, "id long, text string")).collect()]
    monkeypatch.setattr(search, "COMMON", common)
    monkeypatch.setattr(search, "PAIRS", pairs)
    best = search._Best(np.full(len(rows), -np.inf), 4)
    for lo in range(0, len(blocks), 2):
        search._search([search._Block(b, q, mean, 1.2, 0.75) for b in blocks[lo : lo + 2]], q, best)
    df, expected = Counter(w for c in words.values() for w in c), []
    for n, (i, _) in enumerate(rows):
        found = []
        for j, c in words.items():
            length = sum(c.values())
            s = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in words[i] if c[w])
            if s > 0:
                found.append((-round(s, 6), j))
        expected += [(n, j, -s) for s, j in sorted(found)[:4]]
    assert [(int(a), c) for a, _, c in zip(*best.rows)] == [x[:2] for x in expected]
    assert best.rows[1] == pytest.approx([x[2] for x in expected], abs=2e-6)


@pytest.mark.parametrize("tolerance", [0.01, 0.3])
def test_shards(docs, none, tolerance):
    got = shards.shard(clashing(docs.unionByName(docs.where("doc_id < 20")).where("doc_id IS NULL OR doc_id <> 80")), tolerance=tolerance, slot_rows=3).collect()
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        assert r.shard_size == len((r.text or "").encode()) + 1 and r.key == "x"
        size[r.shard] += r.shard_size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.shard_size for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * tolerance * sum(size.values()) / 8 + 4 * largest
    assert shards.shard(none).collect() == []


def test_one_text_over_many_shards(spark):
    rows = [(i, "the same text", "en", "s", 1) for i in range(400)]
    size = Counter(r.shard for r in shards.shard(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 4


def test_leaks(spark, docs, none):
    rng = random.Random(9)
    items = [(i, sentence(random.Random(1000 + i), 20 + 3 * i)) for i in range(12)] + [(50, None), (51, ""), (52, "!!")]
    rows, truth = [], set()
    for i in range(60):
        text = sentence(rng, rng.randint(5, 300))
        if i % 4 == 0:
            item, passage = items[i % 12]
            words = passage.split()
            if i % 8 == 0:  # a paraphrase: some words left out, some put in
                del words[4]
                words.insert(9, "other")
            at = rng.randint(0, len(text))
            text = text[:at] + "\n" + ".$ ".join(w.upper() if i % 3 else w for w in words) + "\n" + text[at:]
            truth.add((500 + i, item))
        rows.append((500 + i, text, "en", "s", 0))
    table = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find_leaks(clashing(table.unionByName(docs)), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == truth
    assert leaks.find_leaks(none, bench).collect() == [] and leaks.find_leaks(table, bench.limit(0)).collect() == []


def test_leaks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ENTRIES", 3000, raising=False)
    rng = random.Random(11)
    words = [a + b for a in WORDS for b in WORDS]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 60)))) for i in range(3000)]
    rows, truth = [], set()
    for i in range(0, 3000, 5):
        around = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in "ab"]
        rows.append((i, f"{around[0]} {items[i][1]} {around[1]}", "en", "s", 0))
        truth.add((i, i))
    got = leaks.find_leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth and all(r.common == r.answer == 1 for r in got)


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.common_subsequence(a, b) == table[-1][-1]


@pytest.mark.parametrize("partitions", [1, 8])
def test_suffixes(spark, docs, none, monkeypatch, partitions):
    monkeypatch.setattr(suffixes, "BUCKETS_PER_TASK", 9 * partitions)
    monkeypatch.setattr(suffixes, "SORTED_AT_ONCE", 50)
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    rng = random.Random(4)
    passage = sentence(rng, 60)
    extra = [(200 + i, sentence(rng, 5) + passage[i % 5 : 200 + i % 7 * 20] + sentence(rng, 5), "en", "s", 0) for i in range(40)]
    extra += [(300, "ab " * 400, "en", "s", 0), (301, "é" * 120, "en", "s", 0), (302, "x" * 99, "en", "s", 0), (303, "x" * 100, "en", "s", 0), (304, "x" * 101, "en", "s", 0)]
    rows = corpus() + extra
    first, expected = {}, []
    raw = [(-1 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in raw:
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            first[w] = min(first.get(w, (i, s)), (i, s))
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            if first[t[s : s + 100]] != (i, s):
                gone[s : s + 100] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        expected.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = suffixes.drop_repeats(clashing(table)).collect()
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == Counter(expected)
    assert sum(x[2] for x in expected) > 2000
    assert suffixes.drop_repeats(none).collect() == []


def test_copies_of_a_stretch_are_not_held():
    texts = [bytes([97 + k]) * 50 + b"anchor" * 12 for k in range(3)]
    rows = [(1, 7, False, (i * 7919) % 6000 + 1, i % 3, 60, 50, texts[i % 3]) for i in range(6000)] + [(1, 8, False, 1, 0, 200, 50, texts[0])]
    names = ["bucket", "lead", "cut", "id", "mark", "anchor", "left", "text"]
    table = pa.table([pa.array(c) for c in zip(*rows)], names)
    got = list(suffixes.gathered(iter(table.to_batches(max_chunksize=100)), 200))
    assert max(len(t) for copies, t in got if not copies) < 500
    held = [r for copies, t in got if not copies for r in t.to_pylist()]
    gone = [r for copies, t in got if copies for r in t.to_pylist()]
    assert len(held) + len(gone) == len(rows) and {(r["id"], r["mark"]) for r in held} >= {(min(r[3] for r in rows if r[4] == k), k) for k in range(3)}
