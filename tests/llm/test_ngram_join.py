import random
import re

import pytest

from driftline.llm import ngram_join

DOCS = "doc_id long, text string, node string"


def brute(docs, width, percent):
    sets = []
    for _, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+",
                       re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        k = min(width, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for (doc_id, *_), s, mine in zip(docs, sets, label):
        ids = [d[0] for d, x in zip(docs, label) if x == mine and d[0] is not None]
        out.append((doc_id, len(s), min(ids) if ids and s else doc_id))
    return sorted(out, key=str)


def run(spark, docs, **kwargs):
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    found = ngram_join.ngram_components(frame, **kwargs).drop("text_hash")
    return sorted(map(tuple, found.collect()), key=str)


def family(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_equals_brute_force_on_families_edge_cases_and_common_passages(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, docs = fresh(30), []
    for size in (6, 12, 40, 90, 200):
        for _ in range(3):
            base = fresh(size)
            docs += [family(rng, base, rng.randrange(0, 1 + size // 12)) for _ in range(7)]
    docs += [" ".join(fresh(rng.randrange(3, 12)) + passage + fresh(4)) for _ in range(40)]
    docs += [None, "", " \n\t", "A b", "a B", "a b c d e", "a b c d", "a b c d e", "x " * 90_000,
             "é É", "É É", "a\x0bb"]
    rows = [(i, text, None) for i, text in enumerate(docs)]
    rows += [(3, docs[3], "x"), (None, docs[8], None), (None, "only null", None)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 5, 75)


def test_chains_longer_than_a_star_and_salted_hot_ngrams(spark):
    # neighbours in the chain link, ends do not; every text shares hot n-grams
    words = [f"c{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[4 * i:4 * i + 60]), None) for i in range(40)]
    rows += [(1000 + i, "same text for a third of all rows here " * 2, None) for i in range(40)]
    rng = random.Random(1)
    base = [f"h{i}" for i in range(120)]
    rows += [(2000 + i, family(rng, base, 3), None) for i in range(60)]
    assert run(spark, rows, salt_rows=2, bits=64) == brute(rows, 5, 75)


@pytest.mark.parametrize("width,percent", [(2, 50), (1, 90), (3, 100)])
def test_other_widths_and_thresholds(spark, width, percent):
    rng = random.Random(width)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))), None)
            for i in range(120)]
    assert run(spark, rows, width=width, percent=percent) == brute(rows, width, percent)


def test_empty_table(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], DOCS)).collect() == []
