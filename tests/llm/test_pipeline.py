import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from driftline.llm.mixing import target_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string"
ITEM = "the quick wandering fox jumps far over seven lazy sleeping hounds today"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def linked(a, b):
    a, b = grams(a), grams(b)
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "er", "and", "wh"], "es": ["que", "ción", "os", "la", "ñ"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
                        for _ in range(rng.randint(12, 60)))
        rows.append((i, text, lang, "hot" if i % 3 else f"s{i % 4}"))
    rows += [(300 + i, rows[i][1], rows[i][2], "hot") for i in range(60)]  # copies
    rows += [(400 + i, rows[i][1] + " qued", rows[i][2], None) for i in range(20, 40)]
    rows += [(500 + i, f"{rows[i][1]} {ITEM}.", rows[i][2], "s1") for i in range(80, 92)]
    rows += [(600, None, "en", "s1"), (601, "", None, "s1"), (602, "12 34 !!", "es", None),
             (5, rows[5][1], "en", "s2"), (None, rows[6][1], "en", "s1"),
             (603, "the ing " * 30_000, "en", "s3")]
    rows = [(*r, len(r[1] or ""), "extra") for r in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return rows, folder


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_each_stage_decides_as_brute_force(spark, corpus):
    rows, folder = corpus
    language, distinct, clean, mixed, shards = staged(spark, folder)
    key = lambda r: (r[0], r[1], r[3])
    assert sorted(map(key, language), key=str) == sorted(
        (key(r) for r in rows if re.search("[a-z]", r[1] or "")), key=str)
    kept = [r.text for r in distinct]
    assert not any(linked(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(linked(r.text, t) for t in kept) for r in language)
    ids = {r.doc_id for r in distinct}
    assert {r.doc_id for r in language if r.doc_id is not None and r.doc_id < 240} == {
        i for i in ids if i is not None and i < 240}
    hit = [r for r in distinct if ITEM[:50] in r.text]
    assert hit and sorted(map(key, clean), key=str) == sorted(
        (key(r) for r in distinct if r not in hit), key=str)
    allowed = {key(r): 2 for r in clean}
    times = Counter(map(key, mixed))
    assert set(times) <= set(allowed) and max(times.values()) <= 2
    size, largest, taken = Counter(), Counter(), Counter()
    for r in clean:
        size[r.source] += (n := len(r.text.split()))
        largest[r.source] = max(largest[r.source], n)
    for r in mixed:
        taken[r.source] += len(r.text.split())
    order = sorted(size, key=lambda x: (x is None, x or ""))
    for source, target in zip(order, target_words([size[x] for x in order], (3, 1, 2), 1.5, 2.0)):
        assert abs(taken[source] - target) <= largest[source] / 2 + 1  # whole documents
    counts = Counter(r.shard for r in shards)
    assert sum(counts.values()) == len(mixed)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in mixed)


def test_run_equals_the_stages_and_keeps_columns(spark, corpus):
    rows, folder = corpus
    done = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in done.collect()) == sorted(
        (r.doc_id or -1, r.shard, r.slot) for r in staged(spark, folder)[-1])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_empty_documents(spark, corpus, tmp_path):
    _, folder = corpus
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(
            f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
