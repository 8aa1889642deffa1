import random

import numpy as np

from driftline.llm.quality import (FEATURES, class_sums, discriminant, features, quality_scores,
                                   statistics)

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, text string"


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiostrnl") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(8, 60))]
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words] if i % 8 else words[:4] * 9
        out.append((i, " ".join(words) + ".", int(i % 4 != 0)))
    return out


def test_held_out_labels_and_edge_cases(spark):
    rows = texts(1, 500)
    odd = [(900, None, None), (901, "", None), (902, "x " * 200_000, "s"), (902, "x " * 200_000, "s"),
           (None, "ordinary words without any id.", None)]
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + odd, DOCS)
    labels = spark.createDataFrame(
        [(i, y, "t") for i, _, y in rows] + [(3, None, None), (901, 7, None), (3, 1, "again")], LABELS)
    found = quality_scores(docs, labels).toPandas()
    assert len(found) == 505 and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.3)).all()
    truth = dict((i, y) for i, _, y in rows)
    held = found[found.held_out & found.doc_id.isin(truth)]
    assert len(held) > 60 and (held.predicted == held.doc_id.map(truth)).mean() > 0.97
    by = found.set_index("doc_id").score
    assert by[900] == by[901] and by[902].nunique() == 1
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_density_equals_a_plain_gaussian(spark):
    rows = texts(2, 200)
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y, "") for i, _, y in rows], LABELS)
    table = features(docs).join(labels.selectExpr("doc_id", "quality class"), "doc_id")
    sums = class_sums(table)
    x = np.array([statistics(t) for _, t, _ in rows])
    y = np.array([c for *_, c in rows])
    means = [x[y == c].mean(axis=0) for c in (0, 1)]
    spread = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * spread[c] for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        s = 0.9 * spread[c] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(FEATURES))
        gap = x - means[c]
        density.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1]
                       - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap))
    want = 1 / (1 + np.exp(np.clip((density[0] - density[1]) / 2.0, -500, 500)))
    assert np.allclose(discriminant(sums).scores(x), want, atol=1e-6)


def test_one_class_teaches_nothing(spark):
    docs = spark.createDataFrame([(i, "a b", None) for i in range(9)], DOCS)
    labels = spark.createDataFrame([(i, 1, None) for i in range(9)], LABELS)
    assert {r.score for r in quality_scores(docs, labels).collect()} == {0.5}
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in quality_scores(docs, none).collect()} == {1}
