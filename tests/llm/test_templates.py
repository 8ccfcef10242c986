"""Documents of one template that do not link: comparisons must grow with their number, not its square."""

import random
from collections import Counter

import pytest

from postmill.llm import ngrams

COMMON = "the offer of this week holds for all members who come to our shop before noon and bring a friend".split()


def template_rows(n, own, seed=2):
    """``n`` documents of 20 + ``own`` words, own ones at the end; every 25th has a near copy."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = COMMON * (1 if own < 6 else 6) + [f"own{rng.randrange(10**8)}" for _ in range(own)]
        rows.append((len(rows), " ".join(words)))
        if i % 25 == 0:
            rows.append((len(rows), " ".join(words + (["more"] if own >= 6 else []))))
    return rows


def plain(rows, threshold=90):
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    group[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("own", [2, 12])
@pytest.mark.parametrize("limit", [0, 10_000])
def test_comparisons_of_template_documents(spark, monkeypatch, own, limit):
    monkeypatch.setattr(ngrams, "boundary", lambda *_: limit)  # all heavy, all light
    compared = Counter()
    verified = ngrams._verified

    def counting(pairs, *rest):
        compared["pairs"] += pairs.count()
        return verified(pairs, *rest)

    monkeypatch.setattr(ngrams, "_verified", counting)
    seen = {}
    for n in (150, 300):
        compared.clear()
        rows = template_rows(n, own)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in ngrams.near_sets(docs).collect()}
        assert got == plain(rows)
        seen[n] = compared["pairs"]
    assert seen[300] <= 2.5 * seen[150] + 20 and seen[300] <= 8 * 300, seen
