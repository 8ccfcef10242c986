"""The registered corpus queries and the stages of the pipeline, at the smallest scale."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from postmill.llm import catalog, mixing
from postmill.session import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name.replace(' ', '-')}")
        if name != "sharding":
            assert docs.columns == corpus_pipeline.COLUMNS
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality_keeps_what_labels_call_good(stages):
    label = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()}
    kept = texts(stages[1])
    right = [(i in kept) == (label[i] == 1) for i in texts(stages[0]) if i in label]
    assert sum(right) / len(right) > 0.95 and set(kept) <= set(texts(stages[0]))


def test_one_document_of_each_group_stays(stages):
    def shingles(text):
        words = text.encode().lower().split()
        n = min(5, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()

    rows = sorted((i, shingles(t)) for i, t in texts(stages[1]).items())
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    assert sorted(texts(stages[2])) == sorted(i for i in group if find(i) == i)
    assert len(stages[2]) < len(stages[1])


def test_documents_with_benchmark_items_go(stages):
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    plain = lambda t: " ".join(t.lower().replace(".", "").replace(",", "").split())
    leaking = {i for i, t in texts(stages[2]).items() if any(plain(x) in plain(t) for x in items)}
    assert leaking and set(texts(stages[2])) - set(texts(stages[3])) >= leaking
    assert len(stages[2]) - len(stages[3]) <= len(leaking) + 1


def test_mixing_repeats_whole_documents(stages):
    count = Counter(r.doc_id for r in stages[4])
    assert set(count) <= set(texts(stages[3])) and max(count.values()) <= 2
    size, drawn = defaultdict(int), defaultdict(int)
    for r in stages[3]:
        size[r.source] += len(r.text.split())
        drawn[r.source] += len(r.text.split()) * count[r.doc_id]
    order = sorted(size)
    largest = max(len(r.text.split()) for r in stages[3])
    for source, target in zip(order, mixing.targets([size[s] for s in order])):
        assert abs(drawn[source] - target) <= largest


def test_shards(stages):
    assert Counter((r.doc_id, r.text) for r in stages[5]) == Counter((r.doc_id, r.text) for r in stages[4])
    slots = defaultdict(list)
    for r in stages[5]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "embeddings"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(map(repr, map(list, result.fetchall())))


def test_contract_columns(spark):
    want = {
        "op1_": "doc_id n_lines n_dropped kept_sha256", "op2_": "doc_id size source_size target taken", "op3_": "page_id host path rule verdict",
        "op4_": "doc_id n_shingles component_id", "op5_": "page_id url text n_chars", "op6_": "doc_id held_out score predicted",
        "op8_": "doc_id size text_crc32 law shard slot grown_shard", "op10_": "doc_id n_bytes n_removed n_spans kept_sha256",
    }
    for start, columns in want.items():
        name = next(n for n in entry.queries() if n.startswith(start))
        assert set(columns.split()) <= set(entry.queries()[name](spark, SF).columns)
    got = entry.queries()["op1_line_dedup"](spark, SF).first()
    assert len(got.kept_sha256) == len(hashlib.sha256(b"").hexdigest())


AWKWARD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t", None, "a", 3), (None, "Some words of a text without an id.", "en", "b", 35), (None, None, None, None, None),
           (5, "The same words stand here twice, and nothing else does.", "en", "b", 54), (5, "The same words stand here twice, and nothing else does.", "en", "b", 54),
           (6, "long " * 20_000, "en", "a", 100_000)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows_and_other_columns(spark, name, stage):
    """Nulls, empty and long texts, repeats, an empty table, and columns with names that stages use themselves."""
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS size", "'x' AS shard", "1 AS _row", "'y' AS quality_score", "2 AS taken", "'z' AS component_id", "'k' AS key")
    out = stage(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in out.collect()]
    given = {(r[0], r[1]) for r in AWKWARD}
    assert set(rows) <= given
    if name == "near duplicates":
        assert sorted(i for i, _ in rows if i is not None) == [1, 2, 3, 5, 6] and sum(i is None for i, _ in rows) == 2
    elif name == "decontamination":
        assert len(rows) == len(AWKWARD)
    elif name == "mixing":
        assert all(t and t.strip() for _, t in rows) and rows.count(rows[0]) <= 4
    elif name == "sharding":
        assert len(rows) == len(AWKWARD) and {"shard_size", "shard", "slot"} <= set(out.columns)
    if name != "sharding":
        assert out.columns == corpus_pipeline.COLUMNS
    assert stage(spark, docs.limit(0), SF).collect() == []
