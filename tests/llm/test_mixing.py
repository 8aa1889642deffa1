import numpy as np
import pytest

from driftline.llm import mixing
from driftline.llm.mixing import mix, mix_documents, mixed_sizes, split_quotas, target_words

DOCS = "doc_id long, text string, source string, target string"


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(1 + i % 37), "hot" if i % 3 else f"s{i % 7}", None) for i in range(500)]
    rows += [(900, words(30_000), "long", None), (901, None, "s1", "x"), (902, " \n", "s1", "x"),
             (903, "a\x0bb c", None, "x"), (903, "a\x0bb c", None, "x"), (None, "q r s", None, None),
             (904, "", "none", None)]
    return spark.createDataFrame(rows, DOCS)


def test_targets_by_hand():
    # unit 5 for weights 3, 1, 2: the first source stops at 8, the excess is shared 1 to 2
    assert target_words([4, 8, 8], (3, 1, 2), 1.5, 2.0) == [8.0, pytest.approx(22 / 3),
                                                            pytest.approx(44 / 3)]
    assert target_words([2, 50, 9], (3, 1, 2), 1.5, 2.0) == [4.0, 69.5, 18.0]
    assert target_words([0, 0], (3, 1), 1.5, 2.0) == [0.0, 0.0]
    assert target_words([], (3, 1), 1.5, 2.0) == []


def test_splitting_tree_keeps_quotas_and_evens_shards():
    quotas = [1000, 3, 0, 71, 5_000_000_000]
    table = np.array(split_quotas(quotas, 7, np.random.default_rng(1)))
    assert table.sum(axis=0).tolist() == quotas and table.min() >= 0
    assert np.ptp(table.sum(axis=1)) <= 1


def test_mix_gives_targets_and_disjoint_blocks(spark, docs):
    documents, blocks = mix(docs, shards=4, block_words=16)
    rows = mixed_sizes(documents, blocks).join(
        documents.select("doc_id", "source").distinct(), "doc_id", "left").toPandas()
    assert len(rows) == docs.count()
    assert (rows.taken <= 2 * rows["size"]).all()
    assert rows[rows["size"] == 0].taken.sum() == 0
    by = rows.fillna({"source": "~"}).groupby("source").agg(
        size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 0.5).sum() >= len(by) - 1  # the null id joins nothing
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 6
    got = blocks.toPandas()
    pieces = got.groupby(got.row.astype(str)).apply(
        lambda g: sorted(zip(g.word_from, g.words)), include_groups=False)
    for spans in pieces:  # no word of a document more than twice
        cover = np.zeros(40_000, int)
        for a, n in spans:
            cover[a:a + n] += 1
        assert cover.max() <= 2
    sizes = got.groupby("shard").position.agg(["count", "max", "nunique"])
    assert np.ptp(sizes["count"]) <= 1
    assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes.nunique() >= 1).all()
    again = mixed_sizes(*mix(docs.repartition(5), shards=4, block_words=16)).toPandas()
    key = ["doc_id", "size", "taken"]
    plain = lambda frame: sorted(frame[key].fillna(-1).values.tolist())
    assert plain(again) == plain(rows)


def test_whole_documents(docs):
    out = mix_documents(docs)
    assert out.columns == docs.columns
    counts = out.groupBy("doc_id", "text", "source").count().toPandas()
    assert counts["count"].max() <= 4  # two equal rows, each at most twice
    assert not counts.text.isna().any()
    assert sorted(out.collect(), key=str) == sorted(
        mix_documents(docs.repartition(7)).collect(), key=str)


def test_empty_table(docs):
    assert mixed_sizes(*mix(docs.limit(0))).collect() == []
    assert mix_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_whole_documents_go_on_past_one_that_does_not_fit(spark, seed):
    rows = [(i, words(100), "a", None) for i in range(1000)] + [(1000, words(300_000), "a", None)]
    rows += [(2000 + i, words(280), "b", None) for i in range(1000)]
    rows += [(3000 + i, words(size), "b", None) for i, size in enumerate([100, 32, 16, 8, 4])]
    rows += [(4000, "x y z", "c", None)] * 5
    targets = (140_000, 540_153, 22)  # they add up to all words
    out = mix_documents(spark.createDataFrame(rows, DOCS), weights=targets, epochs=1.0, seed=seed)
    taken = dict(out.selectExpr("source", "size(split(text, ' ')) n").groupBy("source")
                 .sum("n").collect())
    assert taken["a"] == 100_000  # all but the long one, wherever it stands in the order
    assert abs(taken["b"] - targets[1]) <= 140
    assert taken["c"] == 21  # repeated rows are drawn one by one


def test_inversion_draws_the_hypergeometric_distribution():
    from math import comb

    rng = np.random.default_rng(9)
    for good, bad, draws in ((7, 9, 6), (40, 3, 20), (30, 30, 59), (5, 100, 50), (1, 1, 1), (4, 0, 2)):
        low, high = max(0, draws - bad), min(draws, good)
        seen = np.bincount([mixing.by_inversion(rng, good, bad, draws) for _ in range(4000)],
                           minlength=high + 1)
        want = [comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
                for k in range(high + 1)]
        assert seen[:low].sum() == 0 and len(seen) == high + 1
        assert np.abs(seen / 4000 - want).max() < 0.035
    # sizes that numpy draws as well, and sizes beyond: mean and deviation
    for good, bad, draws in ((3 * 10 ** 8, 6 * 10 ** 8, 4 * 10 ** 8), (2 * 10 ** 9, 10 ** 10, 10 ** 9)):
        found = np.array([mixing.by_inversion(rng, good, bad, draws) for _ in range(300)], float)
        share, n = good / (good + bad), good + bad
        spread = (draws * share * (1 - share) * (n - draws) / (n - 1)) ** 0.5
        assert abs(found.mean() - draws * share) < 5 * spread / 300 ** 0.5
        assert 0.8 < found.std() / spread < 1.2


def test_quotas_split_alike_below_and_above_the_limit_of_numpy(monkeypatch):
    quotas = [900, 20, 380, 0, 1]
    tables = []
    for limit in (10 ** 9, 1):
        monkeypatch.setattr(mixing, "NUMPY_DRAW", limit)
        table = mixing.split_quotas(quotas, 16, np.random.default_rng(3))
        assert [sum(column) for column in zip(*table)] == quotas
        assert max(map(sum, table)) - min(map(sum, table)) <= 1
        tables.append(np.std([row[0] for row in table]))
    assert abs(tables[0] - tables[1]) < 4
